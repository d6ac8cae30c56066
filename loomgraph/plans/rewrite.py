"""Rewrites of a chain before it is compiled, each of which can be switched off by name.

Catalyst pushes filters, columns and limits itself; these passes do what it cannot see, because it happens between steps.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import fields, replace

from .steps import Chain, Degree, Expand, Has, HasNot, Identity, Limit, Paths, Reduce, Repeat, Scan, SimpleHop, SimplePath, Step, tracks

UNROLL = 4


def _children(step: Step, change: Callable[[Chain], Chain]) -> Step:
    new = {}
    for f in fields(step):
        v = getattr(step, f.name)
        if isinstance(v, tuple) and v and f.name not in ("hops", "grouped"):
            if all(isinstance(x, Step) for x in v):
                new[f.name] = change(v)
            elif f.name == "children":
                new[f.name] = tuple(change(c) for c in v)
    return replace(step, **new) if new else step


def fuse_filters(chain: Chain) -> Chain:
    """Tests right after a scan become the scan's, ids or not; nothing moves past a top-k search."""
    out: list[Step] = []
    for s in chain:
        if out and isinstance(out[-1], Scan) and isinstance(s, (Has, HasNot)) and out[-1].limit is None:
            out[-1] = replace(out[-1], tests=(*out[-1].tests, s))
        elif not isinstance(s, Identity):
            out.append(s)
    return tuple(out)


def fuse_limit(chain: Chain) -> Chain:
    """A limit right after a scan of all becomes the scan's: the smallest ids."""
    out: list[Step] = []
    for s in chain:
        if out and isinstance(out[-1], Scan) and out[-1].ids is None and isinstance(s, Limit):
            out[-1] = replace(out[-1], limit=s.n if out[-1].limit is None else min(s.n, out[-1].limit))
        else:
            out.append(s)
    return tuple(out)


def unroll(chain: Chain) -> Chain:
    """A few repetitions without emit become the body written so many times."""
    out: list[Step] = []
    for s in chain:
        if isinstance(s, Repeat) and s.times is not None and s.times <= UNROLL and s.emit is None and s.until is None:
            out += unroll(s.body) * s.times
        else:
            out.append(s)
    return tuple(out)


def degrees(chain: Chain) -> Chain:
    """A child that only counts one expansion reads a table of degrees."""
    if len(chain) == 2 and isinstance(chain[0], Expand) and chain[1] == Reduce("count"):
        return (Degree(chain[0].direction, chain[0].labels),)
    return chain


def count_paths(chain: Chain) -> Chain:
    """Expansions before a final count carry counts instead of equal rows."""
    if not chain or chain[-1] != Reduce("count"):
        return chain
    k = len(chain) - 1
    while k and isinstance(chain[k - 1], Expand) and chain[k - 1].to == "vertex":
        k -= 1
    hops = chain[k:-1]
    return (*chain[:k], Paths(hops), chain[-1]) if len(hops) > 1 else chain


def simple_hop(chain: Chain) -> Chain:
    """The last expansion before the last simplePath() goes by counts: the traversers that arrive, less those that have been there."""
    for k in range(len(chain) - 1, 0, -1):
        if isinstance(chain[k], SimplePath):
            before = chain[k - 1]
            if isinstance(before, Expand) and before.to == "vertex" and not tracks(chain[k + 1 :]):
                return (*chain[: k - 1], SimpleHop(before), *chain[k + 1 :])
            break
    return chain


#: In the order in which they run; limits come last, when scans have their tests.
TOP: dict[str, Callable[[Chain], Chain]] = {"unroll_repeat": unroll, "fuse_filters": fuse_filters, "count_paths": count_paths, "simple_hop": simple_hop, "fuse_limit": fuse_limit}
CHILD: dict[str, Callable[[Chain], Chain]] = {"unroll_repeat": unroll, "fuse_filters": fuse_filters, "degree_pattern": degrees}
NAMES = tuple(dict.fromkeys([*TOP, *CHILD]))


def rewritten(chain: Chain, off: frozenset[str] = frozenset(), child: bool = False) -> Chain:
    chain = tuple(_children(s, lambda c: rewritten(c, off, True)) for s in chain)
    for name, change in (CHILD if child else TOP).items():
        if name not in off:
            chain = change(chain)
    return chain


