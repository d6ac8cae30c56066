"""Seeded draws: settings from a grid, rows into parts."""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence
from math import prod
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drawn_settings(grid: Mapping[str, Sequence[Any]], n: int, seed: int = 0) -> list[dict[str, Any]]:
    """``n`` different settings of a grid (all, if it has no more), the same for a seed; a value that a list repeats counts as often."""
    names = sorted(grid)
    sizes = [len(grid[k]) for k in names]
    total = prod(sizes)
    out = []
    for at in random.Random(seed).sample(range(total), min(n, total)):
        own = {}
        for k, size in zip(reversed(names), reversed(sizes), strict=True):
            at, place = divmod(at, size)
            own[k] = grid[k][place]
        out.append({k: own[k] for k in names})
    return out


def split(df: DataFrame, shares: Sequence[float], by: Sequence[str], seed: int = 0) -> list[DataFrame]:
    """Parts of ``df`` of about these shares (of their sum), by a seeded hash of the columns ``by``.

    A row's part depends on its own values only, so equal rows go together, and the parts are the same however the table is partitioned.
    """
    if not shares or min(shares) < 0 or not sum(shares):
        raise ValueError("shares are positive")
    place = F.pmod(F.xxhash64(F.lit(seed), *by), F.lit(1 << 32)) / float(1 << 32)
    out, low = [], 0.0
    for k, share in enumerate(shares):
        high = low + share / sum(shares)
        own = place >= low
        out.append(df.where(own if k == len(shares) - 1 else own & (place < high)))
        low = high
    return out
