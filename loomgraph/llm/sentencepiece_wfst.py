"""SentencePiece encoding and decoding as weighted finite-state transduction.

``Model`` is compiled from a model file: the normaliser (escaped spaces, the dummy prefix), the pieces as a trie transducer and
byte fallback for characters without a piece.  Composed with an input, these give a lattice: a state for each position and last
piece, an arc for each piece that fits.  The encoding is the path of least weight in the tropical semiring (min, +).

Unigram models weigh an arc with minus the piece's score.  In a BPE model scores order merges and don't add up; there a second
acceptor is composed in, which passes two neighbouring pieces only if merging would leave the seam between them alone.
Then exactly one state of each position stays reachable and its path, of weight zero, is what the merges give.
Whether a seam stays is decided on the pieces' spines: the right-hand parts of the left piece and the left-hand parts of the
right one, in the reverse order of their merges; a pair that stands at the seam at the same time must not itself merge first.

Both searches run over many chunks at once in numpy.  Chunks are cut where no piece can span the cut, thus independent.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import Chunks
from .common import free_name, in_arrow, slices
from .tables import Table

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Bytes of text at once: larger slices meet more new chunks together, and numpy works on longer arrays.
SLICE = 1 << 20
#: A character without a piece costs this much more than the dearest piece.
UNKNOWN_PENALTY = 10.0
#: Characters of a chunk above which it is searched on its own.
LONG = 40
#: Distinct chunks that a worker remembers.
CHUNKS = 80_000
#: Characters whose lattices are in memory at once.
AT_ONCE = 100_000
#: Characters of a chunk above which its lattice is made window by window, so many positions at a time.
WINDOW = 16_384
#: Seams between two pieces that a worker remembers.
SEAMS = 50_000


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""

    def varint(i: int) -> tuple[int, int]:
        n = shift = 0
        while True:
            n |= (raw[i] & 127) << shift
            shift += 7
            i += 1
            if raw[i - 1] < 128:
                return n, i

    i = 0
    while i < len(raw):
        tag, i = varint(i)
        if tag & 7 == 0:
            value, i = varint(i)
        else:
            size, i = varint(i) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], i)
            value, i = raw[i : i + size], i + size
        yield tag >> 3, value


def merged(chars: list[str], score: dict[str, float]) -> tuple[list[str], tuple[str, str] | None]:
    """The symbols that merging leaves, best score first and leftmost among equals, and the last merge."""
    parts, after = list(chars), list(range(1, len(chars))) + [-1]
    before, last = list(range(-1, len(chars) - 1)), None
    heap: list = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] >= 0 and (z := parts[i] + parts[after[i]]) in score:
            heapq.heappush(heap, (-score[z], i, parts[i], parts[after[i]]))

    for i in range(len(parts)):
        offer(i)
    while heap:
        _, i, x, y = heapq.heappop(heap)
        j = after[i]
        if parts[i] != x or j < 0 or parts[j] != y:
            continue
        last = (x, y)
        parts[i], parts[j], after[i] = x + y, "", after[j]
        if after[j] >= 0:
            before[after[j]] = i
        after[j] = -1
        offer(before[i])
        offer(i)
    return [p for p in parts if p], last


def normaliser(prefix: bool, squeeze: bool, escape: bool) -> dict[tuple[int, bool], tuple[int, str]]:
    """The normaliser's transducer: from a state, at a space or another character, the next state and the output, in which \0 is the character.

    States: nothing written yet, after a character, after spaces that are written only if something follows.
    """
    space = SPACE if escape else " "
    first = space if prefix else ""
    return {
        (0, False): (1, first + "\0"), (0, True): (0, "") if squeeze else (1, first + space),
        (1, False): (1, "\0"), (1, True): (2, "") if squeeze else (1, space),
        (2, False): (1, space + "\0"), (2, True): (2, ""),
    }


def transduced(text: str, arcs: dict[tuple[int, bool], tuple[int, str]]) -> str:
    """What a normaliser's transducer writes for a text, arc by arc."""
    state, out = 0, []
    for c in text:
        state, template = arcs[state, c == " "]
        out.append(template.replace("\0", c))
    return "".join(out)


class Model:
    """The transducers of a SentencePiece model file (identity character map)."""

    def __init__(self, raw: bytes):
        pieces, self.kind, norm = [], UNIGRAM, {3: 1, 4: 1, 5: 1}
        for field, value in _fields(raw):
            if field == 1:
                own = dict(_fields(value))
                pieces.append((own.get(1, b"").decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
            elif field == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                norm |= dict(_fields(value))
        if norm.get(2) or self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models with an identity character map are supported")
        self.prefix, self.squeeze, self.escape = bool(norm[3]), bool(norm[4]), bool(norm[5])
        self.pieces = pieces
        self.unk = next(i for i, p in enumerate(pieces) if p[2] == UNKNOWN)
        self.byte_ids = np.full(256, self.unk, np.int32)
        for i, (p, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.byte_ids[int(p[1:-1], 16)] = i
        self.fallback = bool((self.byte_ids != self.unk).all())
        real = {p: (i, s) for i, (p, s, kind) in enumerate(pieces) if kind in (NORMAL, USER)}

        # States of the search: characters first, then merges by rank, so that a number says when a piece comes into being.
        score = {p: s for p, (_, s) in real.items()}
        self.split: list[tuple[int, int]] = []
        order = sorted((p for p in real if len(p) == 1), key=lambda p: real[p][0])
        single = len(order)
        splits = {}
        if self.kind == BPE:
            for p in real:
                if len(p) > 1 and (m := merged(list(p), score))[0] == [p]:
                    splits[p] = m[1]
            order += sorted(splits, key=lambda p: (-real[p][1], real[p][0]))
        else:
            order += [p for p in real if len(p) > 1]
        state = {p: n for n, p in enumerate(order)}
        self.none = len(order)  # the state of a character without a piece
        self.ids = np.array([real[p][0] for p in order] + [self.unk], np.int32)
        self.left, self.right = np.full(self.none + 1, -1, np.int64), np.full(self.none + 1, -1, np.int64)
        for p, (x, y) in splits.items():
            self.left[state[p]], self.right[state[p]] = state.get(x, -1), state.get(y, -1)
        low = min(score.values(), default=0.0)
        self.cost = np.array([-real[p][1] for p in order] + [UNKNOWN_PENALTY - low])
        made = np.array([(state[x] << 20 | state[y], state[p]) for p, (x, y) in splits.items() if x in state and y in state], np.int64).reshape(-1, 2)
        self.merge = Table(made[:, 0], made[:, 1].astype(np.int32))
        self.known: dict[tuple[int, int], bool] = {}

        # The pieces' trie, its characters numbered.
        alphabet = sorted({c for p in order for c in p})
        self.char = np.full(0x110000, -1, np.int32)
        self.char[[ord(c) for c in alphabet]] = np.arange(len(alphabet))
        self.width = len(alphabet)
        nodes: dict[str, int] = {"": 0}
        arcs = {}
        for p in order:
            for n in range(1, len(p) + 1):
                if p[:n] not in nodes:
                    nodes[p[:n]] = len(nodes)
                    arcs[nodes[p[: n - 1]] * self.width + int(self.char[ord(p[n - 1])])] = nodes[p[:n]]
        self.arcs = Table(np.array(list(arcs), np.int64), np.array(list(arcs.values()), np.int32))
        self.accept = np.full(len(nodes), -1, np.int64)
        for p, n in state.items():
            self.accept[nodes[p]] = n
        self.longest = max(map(len, order), default=1)
        inner = any(SPACE in p.lstrip(SPACE) for p in order)
        line = "" if "\n" in alphabet else "\n"
        # One chunk: spaces and what follows up to the next; a new line of no piece is a chunk, too.
        self.cut = re.compile(r"(?s).+" if inner else f"{SPACE}*[^{SPACE}{line}]+|{SPACE}+" + (f"|{line}" if line else ""))

        # The inverse transducer: bytes of each id.
        out = []
        for p, _, kind in pieces:
            out.append(bytes([int(p[1:-1], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.replace(SPACE, " ").encode() if self.escape else p.encode())
        self.out_sizes = np.array([len(x) for x in out], np.int64)
        self.out_starts = np.cumsum(self.out_sizes) - self.out_sizes
        self.out = np.frombuffer(b"".join(out), np.uint8)
        self.chunks = Chunks(self.encode_chunks, CHUNKS)

    def normalised(self, text: str) -> str:
        """What ``normaliser``'s transducer writes, run by string functions (the tests compare the two)."""
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if text and self.prefix:
            text = " " + text
        return text.replace(" ", SPACE) if self.escape else text

    def seam(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether piece a followed by b stays so."""
        ok = (a == self.none) | (b == self.none)
        rest = np.flatnonzero(~ok)
        x, y = a[rest].astype(np.int64), b[rest].astype(np.int64)
        # When the parts at the seam are merged into what stands there later; never, for the pieces themselves.
        end_x, end_y = np.full(len(x), 1 << 40), np.full(len(x), 1 << 40)
        ok[rest] = True
        while len(rest):
            z = self.merge.get(x << 20 | y)
            # Of equal merges the leftmost comes first.
            bad = (z >= 0) & (z < end_x) & (z <= end_y)
            ok[rest[bad]] = False
            later = x > y  # the part that came last is undone
            end_x, end_y = np.where(later, x, end_x), np.where(later, end_y, y)
            x, y = np.where(later, self.right[x], x), np.where(later, y, self.left[y])
            go = ~bad & (x >= 0) & (y >= 0)
            rest, x, y, end_x, end_y = rest[go], x[go], y[go], end_x[go], end_y[go]
        return ok

    def _arcs(self, chars: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """For each position and length: the state of the piece that fits there, or -1."""
        n = len(chars)
        fits = np.full((self.longest + 1, n), -1, np.int32)
        at = np.flatnonzero(chars >= 0)
        node = np.zeros(len(at), np.int64)
        for size in range(1, self.longest + 1):
            inside = at + size <= stop[at]
            at, node = at[inside], node[inside]
            c = chars[at + size - 1]
            good = c >= 0
            at, node = at[good], node[good]
            if not len(at):
                break
            node = self.arcs.get(node * self.width + c[good]).astype(np.int64)
            good = node >= 0
            at, node = at[good], node[good]
            fits[size, at] = self.accept[node]
        alone = fits[1] < 0
        fits[1, alone] = self.none
        return fits

    def _best(self, fits: np.ndarray, start: np.ndarray, size: np.ndarray, last: np.ndarray, length: np.ndarray) -> None:
        """The last piece of the best path to each position, for many chunks, longest first, one position of each at a time."""
        cost = np.zeros(len(last)) if self.kind == UNIGRAM else None
        for i in range(1, int(size[0]) + 1):
            n = int(np.searchsorted(-size, -i, side="right"))
            begin, end = start[:n], start[:n] + i
            if cost is not None:
                best = np.full(n, np.inf)
                for k in range(min(self.longest, i), 0, -1):
                    t = fits[k, end - k]
                    here = np.where(t >= 0, cost[end - k] + self.cost[t], np.inf)
                    better = here < best
                    best = np.where(better, here, best)
                    last[end[better]], length[end[better]] = t[better], k
                cost[end] = best
                continue
            rest = np.arange(n)
            for k in range(min(self.longest, i), 0, -1):
                s = end[rest] - k
                t = fits[k, s]
                j = np.flatnonzero(t >= 0)
                if not len(j):
                    continue
                s, t = s[j], t[j]
                good = s == begin[rest[j]]
                ask = np.flatnonzero(~good)
                good[ask] = self.seam(last[s[ask]], t[ask])
                e = end[rest[j[good]]]
                last[e], length[e] = t[good], k
                rest = np.delete(rest, j[good])
                if not len(rest):
                    break
            if len(rest):
                raise ValueError("the model's merges aren't consistent")

    def _one_seam(self, a: int, b: int) -> bool:
        if (own := self.known.get((a, b))) is None:
            if len(self.known) > SEAMS:
                self.known.clear()
            own = self.known[a, b] = bool(self.seam(np.array([a]), np.array([b]))[0])
        return own

    def _best_of_long(self, char: np.ndarray, last: np.ndarray, length: np.ndarray) -> None:
        """As ``_best`` for one long chunk.  Of its lattice only a window is there at a time; what a window needs of the one before goes along."""
        tokens, sizes, cost, low = [-1], [0], [0.0], 0
        for begin in range(0, len(char), WINDOW):
            end = min(begin + WINDOW, len(char))
            more = max(0, begin - self.longest)  # pieces that end in this window begin here at the earliest
            tokens, sizes, cost, low = tokens[more - low :], sizes[more - low :], cost[more - low :], more
            rows = [x.tolist() for x in self._arcs(char[low:end], np.full(end - low, end - low))]
            for e in range(begin + 1 - low, end + 1 - low):
                best, token, size = np.inf, -1, 0
                for k in range(min(self.longest, e), 0, -1):
                    s = e - k
                    t = rows[k][s]
                    if t < 0:
                        continue
                    if self.kind == UNIGRAM:
                        if cost[s] + self.cost[t] < best:
                            best, token, size = cost[s] + self.cost[t], t, k
                    elif not s + low or self._one_seam(tokens[s], t):
                        token, size = t, k
                        break
                tokens.append(token)
                sizes.append(size)
                cost.append(best)
            last[begin + 1 : end + 1], length[begin + 1 : end + 1] = tokens[begin + 1 - low :], sizes[begin + 1 - low :]

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all (normalised, non-empty) chunks in one array, and how many each has; so many chunks at once that their lattice stays small."""
        parts, first, total = [], 0, 0
        for i, x in enumerate(chunks):
            if total and total + len(x) > AT_ONCE:
                parts.append(self._encode(chunks[first:i]))
                first, total = i, 0
            total += len(x)
        if chunks:
            parts.append(self._encode(chunks[first:]))
        if not parts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # A slot after each chunk, so that its end isn't the next one's start.
        raw = np.frombuffer(("\0".join(chunks) + "\0").encode("utf-32-le"), np.uint32)
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        stop = np.cumsum(size + 1) - 1
        start = stop - size
        char = self.char[raw]
        char[stop] = -1
        last, length = np.full(len(raw), -1, np.int32), np.zeros(len(raw), np.int32)
        deal = np.argsort(-size, kind="stable")
        long = int((size > LONG).sum())
        for i in deal[:long]:
            a, b = int(start[i]), int(stop[i])
            self._best_of_long(char[a:b], last[a : b + 1], length[a : b + 1])
        if long < len(deal):
            # The short chunks' lattice; a long one's characters have no arcs here.
            short = np.repeat(size <= LONG, size + 1)
            place = np.cumsum(short) - 1
            fits = self._arcs(char[short], place[np.repeat(stop, size + 1)[short]])
            own = np.full(len(place[short]), -1, np.int32)
            sizes = np.zeros(len(own), np.int32)
            self._best(fits, place[start[deal[long:]]], size[deal[long:]], own, sizes)
            last[short], length[short] = own, sizes
        # Back along all paths at once; each piece is noted at its first position.
        own = np.full(len(raw), -1, np.int32)
        at, first = stop.copy(), start
        while len(at):
            before = at - length[at]
            own[before] = last[at]
            go = before > first
            at, first = before[go], first[go]
        at = np.flatnonzero(own >= 0)
        token = own[at]
        ids = self.ids[token]
        chunk = np.repeat(np.arange(len(chunks)), size + 1)[at]
        strange = np.flatnonzero(token == self.none)
        if not len(strange):
            return ids, np.bincount(chunk, minlength=len(chunks))
        if not self.fallback:
            # Neighbouring characters without a piece are one unknown.
            keep = np.ones(len(ids), bool)
            keep[1:] = ~((token[1:] == self.none) & (token[:-1] == self.none) & (chunk[1:] == chunk[:-1]))
            return ids[keep], np.bincount(chunk[keep], minlength=len(chunks))
        code = raw[at[strange]]
        many = np.ones(len(ids), np.int64)
        many[strange] = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
        wide = np.repeat(ids, many)
        blob = np.frombuffer(code.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        wide[np.repeat(token == self.none, many)] = self.byte_ids[blob]
        return wide, np.bincount(chunk, many, len(chunks)).astype(np.int64)

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each begins (one offset more than texts)."""
        cut = self.cut.findall
        return self.chunks.ids([cut(self.normalised(x)) for x in texts])

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode_all(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """The UTF-8 bytes of each run of ids, without the dummy prefix."""
        sizes = self.out_sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        blob = self.out[np.repeat(self.out_starts[ids] - (ends - sizes), sizes) + np.arange(total)].tobytes()
        seam = np.concatenate([[0], ends])[at].tolist()
        out = [blob[a:b] for a, b in zip(seam[:-1], seam[1:], strict=True)]
        return [x[1:] if self.prefix and x[:1] == b" " else x for x in out]

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(np.array(ids, np.int64), np.array([0, len(ids)]))[0].decode("utf-8", "replace")


_models: dict[int, Model] = {}


def _model(raw: bytes) -> Model:
    """Compiled once in a worker."""
    key = zlib.crc32(raw)
    if key not in _models:
        _models.clear()
        _models[key] = Model(raw)
    return _models[key]


def _encode(raw: bytes, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(raw)
        for batch in batches:
            for part in slices(batch, most=SLICE):
                texts = part.column("text").to_pylist()
                ids, at = model.encode_all(texts)
                back = model.decode_all(ids, at)
                cut = at.tolist()
                blob = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(blob[4 * a : 4 * b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                new = {"row": part.column("row"), "n_tokens": pa.array(np.diff(at)), "ids_crc32": pa.array(crc, pa.int64())}
                if "ids" in names:
                    new["ids"] = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
                if "decoded" in names:
                    new["decoded"] = pa.array(back, pa.binary()).cast(pa.string(), safe=False)
                if "round_trip" in names:
                    new["round_trip"] = pa.array([x == y.replace(SPACE, " ").encode() for x, y in zip(back, texts, strict=True)], pa.bool_())
                del texts, back, blob
                yield pa.RecordBatch.from_arrays([new[n] for n in names], names)

    return run


def model_bytes(path: str) -> bytes:
    """The model file, read on the driver and sent with the tasks (some hundred KB)."""
    with open(path, "rb") as f:
        return f.read()


NEW = {"ids": T.ArrayType(T.IntegerType()), "n_tokens": T.LongType(), "ids_crc32": T.LongType(), "decoded": T.StringType(), "round_trip": T.BooleanType()}


def encoded(docs: DataFrame, model: bytes, new: Sequence[str] = ("ids", "n_tokens", "ids_crc32", "decoded"), with_text: bool = True) -> DataFrame:
    """``docs`` (without ``text`` unless ``with_text``) with the columns ``new``, any of ``ids, n_tokens, ids_crc32, decoded, round_trip``.

    ``ids_crc32`` is of the ids as little-endian 32-bit integers.  ``decoded`` is the ids' text again: the text itself, but for
    U+2581, which stands for a space; ``round_trip`` says whether it is.  Null and empty texts have no ids and an empty ``decoded``.
    A text of any length, also without a space, is encoded whole.  Repeated rows stay; an empty table stays one.  New columns get a
    suffix if ``docs`` has such names.
    """
    kept = [c for c in docs.columns if with_text or c != "text"]
    # The text goes to the workers once, beside the rest, which alone comes back.
    body = F.struct(*([docs[c] for c in kept] or [F.lit(0).alias("none")]))
    rows = docs.select(body.alias("row"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    out = T.StructType([T.StructField("row", rows.schema["row"].dataType), *(T.StructField(n, NEW[n]) for n in new)])
    done = in_arrow(rows, _encode(model, ["row", *new]), out)
    return done.select(*[F.col("row")[c].alias(c) for c in kept], *[F.col(n).alias(free_name(docs, n)) for n in new])
