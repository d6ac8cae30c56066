"""Token ids of whole texts from pieces of text whose encodings don't depend on each other, each piece encoded once."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np

#: Distinct chunks that a worker remembers; beyond, it forgets the rare ones, so that memory doesn't follow the input.
MOST = 400_000


class Chunks(dict):
    """Chunk to its number; ``ids`` gives the token ids of texts that are lists of chunks."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = MOST):
        super().__init__()
        self.encode, self.most = encode, most
        self.pending: list[str] = []
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.starts, self.sizes, self.seen = (np.zeros(1 << 16, np.int64) for _ in range(3))

    def _forget(self) -> None:
        """Keeps the chunks seen most often, half of what fits at most; how often they were seen counts half from then on."""
        n = len(self)
        seen = self.seen[:n]
        least = 2
        while (seen >= least).sum() > self.most // 2:
            least *= 2
        keep = np.flatnonzero(seen >= least)
        sizes = self.sizes[keep]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(keep) else 0
        flat = self.flat[np.repeat(self.starts[keep] - (ends - sizes), sizes) + np.arange(total)]
        names = list(self)  # in order of their numbers
        names = [names[i] for i in keep.tolist()]
        self.clear()
        self.update(zip(names, range(len(names)), strict=True))
        self.flat[:total], self.used = flat, total
        self.starts[: len(keep)], self.sizes[: len(keep)] = ends - sizes, sizes
        self.seen[: len(keep)] = seen[keep] // 2
        self.seen[len(keep) :] = 0

    def __missing__(self, chunk: str) -> int:
        self.pending.append(chunk)
        self[chunk] = n = len(self)
        return n

    def _learn(self) -> None:
        if not self.pending:
            return
        flat, sizes = self.encode(self.pending)
        first = len(self) - len(self.pending)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self) > len(self.starts):
            self.starts, self.sizes, self.seen = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes, self.seen))
        self.flat[self.used : self.used + len(flat)] = flat
        self.sizes[first : len(self)] = sizes
        self.starts[first : len(self)] = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        self.pending = []

    def ids(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each begins (one offset more than texts)."""
        if len(self) > self.most:
            self._forget()
        many = np.fromiter(map(len, texts), np.int64, len(texts))
        at = np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), np.int64, int(many.sum()))
        self._learn()
        self.seen[: len(self)] += np.bincount(at, minlength=len(self))
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(total)]
        return ids, np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(many)])]
