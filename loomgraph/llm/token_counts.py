"""Token counts by a linear longest-match automaton.

The vocabulary is a trie over bytes, in which the last byte of a word is a symbol of its own.  A node's failure link leads to the
node of what is left once the greedy matching has popped tokens off the node's string; how many it pops is computed with the link.
A word is read once, symbol by symbol: where the trie has no arc, the link is followed and its count added.  So the number of greedy
longest-match pieces comes out in time linear in the text, and no piece is ever built (Song et al., Fast WordPiece Tokenization, 2021).

All words of a slice walk the automaton side by side in numpy; the few of more than ``LONG`` bytes walk it one by one.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, in_arrow, row_slices
from .tables import Table
from .words import joined

LAST = 256  # added to a word's last byte
SYMBOLS = 512
#: Bytes of a word above which it walks by itself: side by side, each of its bytes would cost a step of its own anyway.
LONG = 200
SPACE, LETTER, DIGIT, OTHER = range(4)
KIND = np.full(256, OTHER, np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = SPACE
KIND[48:58] = DIGIT
KIND[65:91] = KIND[97:123] = KIND[128:] = LETTER
SUFFIX = "</w>"


def byte_names() -> dict[str, int]:
    """The printable character that byte-level vocabularies use for each byte: itself if printable Latin-1, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


def pieces_of(spec: str) -> list[tuple[int, ...]]:
    """The pieces of a byte-level tokenizers file with word ends, as symbols; special tokens are none."""
    data, names = json.loads(spec), byte_names()
    special = {t["content"] for t in data["added_tokens"]}
    out = []
    for token in data["model"]["vocab"]:
        if token in special:
            continue
        ends = token.endswith(SUFFIX) and token != SUFFIX
        own = [names[c] for c in (token[: -len(SUFFIX)] if ends else token)]
        if ends:
            own[-1] += LAST
        out.append(tuple(own))
    return out


class Automaton:
    """Trie, failure links and popped counts of a list of pieces (tuples of symbols)."""

    def __init__(self, pieces: list[tuple[int, ...]]):
        arcs: dict[int, int] = {}
        parents, symbols, token = [-1], [-1], [False]
        for piece in pieces:
            node = 0
            for c in piece:
                if (to := arcs.get(node * SYMBOLS + c)) is None:
                    to = arcs[node * SYMBOLS + c] = len(parents)
                    parents.append(node)
                    symbols.append(c)
                    token.append(False)
                node = to
            token[node] = bool(piece)
        depth = [0] * len(parents)
        for v in range(1, len(parents)):  # a parent comes before its children
            depth[v] = depth[parents[v]] + 1
        link, pops = [-1] * len(parents), [0] * len(parents)
        for v in sorted(range(1, len(parents)), key=depth.__getitem__):
            if token[v]:
                link[v], pops[v] = 0, 1
                continue
            z, n = link[parents[v]], pops[parents[v]]
            while z >= 0 and (to := arcs.get(z * SYMBOLS + symbols[v])) is None:
                n += pops[z]
                z = link[z]
            if z >= 0:
                link[v], pops[v] = to, n
        self.arcs = Table(np.array(list(arcs), np.int64), np.array(list(arcs.values()), np.int32))
        self.link, self.pops = np.array(link, np.int64), np.array(pops, np.int64)
        self.one_by_one = (arcs, link, pops)

    def count_long(self, word: bytes) -> int:
        """``counts`` of one word."""
        arcs, link, pops = self.one_by_one
        state = n = 0
        last = len(word) - 1
        for j, c in enumerate(word):
            symbol = c if j < last else c + LAST
            while (to := arcs.get(state * SYMBOLS + symbol)) is None:
                n += pops[state]
                state = link[state]
                if state < 0:
                    return 1
            state = to
        while state:
            n += pops[state]
            state = link[state]
            if state < 0:
                return 1
        return n

    def counts(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Pieces of each word.  A word that no pieces cover counts as one, the unknown token."""
        size = end - start
        long = np.flatnonzero(size > LONG)
        if len(long):
            out = np.empty(len(size), np.int64)
            short = np.flatnonzero(size <= LONG)
            out[short] = self.counts(buf, start[short], end[short])
            out[long] = [self.count_long(buf[a:b].tobytes()) for a, b in zip(start[long], end[long], strict=True)]
            return out
        order = np.argsort(-size, kind="stable")
        begin, size = start[order], size[order]
        state, count = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        lost = np.zeros(len(order), bool)
        longer = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left").tolist()
        for j, n in enumerate(longer):  # the n words longer than j
            symbol = buf[begin[:n] + j].astype(np.int64)
            symbol[size[:n] == j + 1] += LAST
            live = np.flatnonzero(~lost[:n]) if lost.any() else np.arange(n)
            while len(live):
                to = self.arcs.get(state[live] * SYMBOLS + symbol[live])
                went = to >= 0
                state[live[went]] = to[went]
                live = live[~went]
                count[live] += self.pops[state[live]]
                state[live] = self.link[state[live]]
                gone = state[live] < 0
                lost[live[gone]] = True
                live = live[~gone]
        live = np.flatnonzero((state > 0) & ~lost)
        while len(live):
            count[live] += self.pops[state[live]]
            state[live] = self.link[state[live]]
            lost[live[state[live] < 0]] = True
            live = live[state[live] > 0]
        out = np.empty(len(order), np.int64)
        out[order] = np.where(lost, 1, count)
        return out


def word_bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each word: a run of letters (every non-ASCII character is one), one digit, or a run of other characters."""
    kind = KIND[buf]
    change = np.ones(len(buf) + 1, bool)
    change[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    change[offsets] = True
    at = np.flatnonzero(change)
    own = kind[at[:-1]] != SPACE if len(buf) else np.zeros(0, bool)
    return at[:-1][own], at[1:][own]


_automata: dict[int, Automaton] = {}


def _automaton(spec: str) -> Automaton:
    key = zlib.crc32(spec.encode())
    if key not in _automata:
        _automata.clear()
        _automata[key] = Automaton(pieces_of(spec))
    return _automata[key]


def _count(spec: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(spec)
        for batch in batches:
            for part, text in row_slices(batch):
                buf, offsets = joined(text)
                start, end = word_bounds(buf, offsets)
                sums = np.concatenate([[0], np.cumsum(automaton.counts(buf, start, end))])
                at = np.searchsorted(start, offsets)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(np.diff(at)), pa.array(np.diff(sums[at]))], ["row", "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, spec: str) -> DataFrame:
    """``docs`` with ``n_words`` and ``n_tokens`` (suffixed if there are such columns), A-Z lower-cased.

    ``spec``: the text of a byte-level tokenizers file with word ends, of which the vocabulary is taken.  Null and empty texts: 0 and 0.
    Texts and words of any length are read whole, in a time that follows their length.  Repeated rows stay; no rows give no rows.
    """
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    out = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return in_arrow(rows, _count(spec), out).select("row.*", F.col("n_words").alias(free_name(docs, "n_words")), F.col("n_tokens").alias(free_name(docs, "n_tokens")))
