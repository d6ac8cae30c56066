"""Secret scans: fixed patterns, and a character convolutional network over every other candidate and its context.

Base spans come from three patterns and always stay.  Every run of ``RUN``, unless it lies within a base span,
goes through the network with the characters around it: embedded characters, one convolution, maximum and mean over all
positions (a candidate of any length, uncut), a logistic layer.  It is trained in numpy on labelled findings; its scores are calibrated
on findings kept apart (Platt), and the threshold is the largest that keeps ``RECALL`` of the calibration secrets.

Labelled findings are of two kinds: templates of secrets and of what looks like them (``made_findings``), and runs in the documents themselves
(``found_findings``): what a fixed pattern has found is a secret, other runs are taken for plain.
"""

from __future__ import annotations

import base64
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, in_arrow, row_slices, slices, texts

#: The base patterns (fixed values), in the order of their kinds.  Key words match in either case, of ASCII letters only.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_LEAST = 12
#: Runs are greedy and begin leftmost, so asking for the least length within the pattern drops just the runs that are too short.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
#: What the network scores: runs of 8 characters or more, with a digit or not.
RUN = re.compile(r"[A-Za-z0-9+/_=.-]{8,}")
KINDS = ("assign", "access", "hex", "model")
LEFT, RIGHT = 24, 8
RECALL = 0.98
#: Documents and findings of each label that a scanner is fitted to at most, besides templates.
MAX_DOCS, MAX_ROWS = 4000, 1500
MODEL_SEED = 11


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Start, kind's number, end of each base finding, in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST] if ":" in text or "=" in text else []
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The plainest of the runs: of 16 characters or more, with a digit, that overlap no base span."""
    out, i = [], 0
    ends = []  # base spans may overlap one another: the largest end so far
    for _, _, e in base:
        ends.append(max(e, ends[-1] if ends else 0))
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while i < len(base) and base[i][0] < b:
            i += 1
        if i and ends[i - 1] > a:
            continue
        if any(c in m[0] for c in "0123456789"):
            out.append((a, b))
    return out


def runs(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """All runs that the network scores: those that no base span covers, also where they overlap one."""
    out, i, end = [], 0, 0
    for m in RUN.finditer(text):
        a, b = m.span()
        while i < len(base) and base[i][0] <= a:
            end = max(end, base[i][2])
            i += 1
        if end < b:
            out.append((a, b))
    return out


def made_findings(n: int = 3000, seed: int = MODEL_SEED) -> list[tuple[str, str, str, int]]:
    """Labelled findings (left, candidate, right, label) from templates of secrets and of what looks like them, by a seeded rule."""
    r = random.Random(seed)
    letters, hexa, b64 = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda chars, k: "".join(r.choices(chars, k=k))
    word = lambda: some(letters, r.randint(2, 9))
    words = lambda k: " ".join(word() for _ in range(k))
    coded = lambda k: base64.b64encode(r.randbytes(k)).decode()
    upper = b64[:26] + "0123456789"
    secrets = [
        lambda: (r.choice(["key: ", "auth=", "Authorization: Bearer ", "bearer ", "credential: ", "export KEY=", "pwd="]), coded(r.randint(15, 40))),
        lambda: (r.choice([" ", '"', "=", ": "]), r.choice(["ghp_", "gho_", "ghs_"]) + some(b64, 36)),
        lambda: (r.choice([" ", '"', "=", ": "]), r.choice(["sk_live_", "pk_live_", "rk_live_"]) + some(b64, 24)),
        lambda: (r.choice([" ", '"', "="]), r.choice(["xoxb-", "xoxp-"]) + f"{some('0123456789', 12)}-{some('0123456789', 12)}-{some(b64, 24)}"),
        lambda: (r.choice(["", " ", "jwt "]), f"eyJ{some(b64, 30)}.eyJ{some(b64, 50)}.{some(b64 + '-_', 43)}"),
        lambda: (r.choice(["private_key ", "PRIVATE KEY-----\n", "client_id ", "aws_key "]), coded(48)),
        lambda: (r.choice(["://admin:", "://root:", "-p ", "login "]), some(b64, r.randint(16, 30)) + some("0123456789", 2)),
        lambda: (r.choice([" ", "key ", "google "]), "AIza" + some(b64 + "-_", 35)),
        lambda: (r.choice(["signature=", "sig=", "hmac "]), some(b64 + "+/", r.randint(28, 60)) + "="),
        lambda: (r.choice(["pwd: ", "pwd=", "pass: ", "passcode: ", "login pwd "]), some(b64, r.randint(8, 15))),
        lambda: (r.choice(["Authorization: Bearer ", "bearer ", "Bearer: "]), some(b64[:52], r.randint(18, 48))),
        lambda: (r.choice(["passphrase: ", "pwd: ", "passphrase="]), r.choice("-_.").join(some(letters, r.randint(3, 8)) for _ in range(r.randint(4, 6)))),
        lambda: (r.choice(["key: ", "auth: ", "credential: "]), some(b64, r.randint(6, 12)) + some(hexa, r.randint(16, 24)) + some(b64, r.randint(6, 12))),
    ]
    plain = [
        lambda: (" ", f"{word()}.{r.randint(1, 99)}"[:14] + "." + word() + word()),
        lambda: (r.choice(["https://", "http://", "see www."]), f"{word()}.example.{r.choice(['com', 'org'])}/{word()}/{r.randint(1, 9999)}.html"),
        lambda: ("@", f"mail{r.randint(1, 99)}.example.{r.choice(['com', 'org', 'net'])}"),
        lambda: (r.choice([" ", "on "]), f"20{r.randint(10, 29)}-{r.randint(10, 12)}-{r.randint(10, 28)}-{r.randint(10, 23)}-{r.randint(10, 59)}"),
        lambda: (r.choice([" ", "version ", "v"]), f"{word()}-{r.randint(0, 20)}.{r.randint(0, 99)}.{r.randint(0, 99)}-{word()}-{word()}"),
        lambda: (r.choice(["/usr/lib/", "file ", "in "]), f"{word()}/{word()}/{word()}_{r.randint(1, 99)}.{r.choice(['py', 'txt', 'json'])}"),
        lambda: (r.choice(["uuid ", "id ", "request "]), "-".join(some(hexa, k) for k in (8, 4, 4, 4, 12))),
        lambda: (" ", "_".join(word() for _ in range(r.randint(3, 5))) + str(r.randint(1, 99))),
        lambda: (" ", "".join(word() for _ in range(3)).capitalize()[:30] + "xyz" + str(r.randint(1, 9)) + word() * 2),
        lambda: (" ", "=" * r.randint(8, 30) + str(r.randint(1, 9)) + "-" * r.randint(8, 30)),
        lambda: (r.choice(["call ", "tel ", " "]), f"+{r.randint(1, 99)}-{some('0123456789', 3)}-{some('0123456789', 4)}-{some('0123456789', 4)}"),
        lambda: (r.choice(["placeholder ", "e.g. "]), r.choice(["your-key-here-", "xxxxxxxxxxxxxxxx", "changeme-example-", "EXAMPLE-ONLY-0000-"]) + str(r.randint(1, 999))),
        lambda: (" ", some("0123456789", r.randint(2, 6)) + "." + some("0123456789", r.randint(12, 16))),
        *[lambda: (" ", some(letters, r.randint(8, 14)))] * 4,
        *[lambda: (r.choice([" ", "!! ", f"{word().upper()}!! ", f"{word().upper()} "]), some(letters, r.randint(8, 14)).upper() + r.choice(["", ".", ",", "!!"]))] * 3,
        lambda: (" ", some(letters, r.randint(8, 14)).capitalize() + r.choice(["", "."])),
        lambda: (" ", "-".join(some(letters, r.randint(4, 8)) for _ in range(r.randint(2, 4)))),
        lambda: (r.choice([" ", "digest ", "commit "]), r.choice(["sha256-", "commit-", "rev_"]) + some(hexa, r.choice([40, 64]))),
    ]
    out = []
    for _ in range(n):
        label = r.randint(0, 1)
        before, body = r.choice(secrets if label else plain)()
        left = words(r.randint(0, 5)) + r.choice([" ", "\n", ", "]) + before
        text = left + body + r.choice([" ", "\n", '"', ". ", ", "]) + words(2)
        # The run that a scan would see, which may begin before the body; what is too short for a run is no finding.
        m = next((m for m in RUN.finditer(text) if m.end() > len(left)), None)
        if m is None or m.start() >= len(left) + len(body):
            continue
        out.append((text[: m.start()][-LEFT:], m[0], text[m.end() :][:RIGHT], label))
    return out


def labelled_runs(text: str, plain: int = 2) -> list[tuple[str, str, str, int]]:
    """Of one text: its runs that touch a base span (1), and the ``plain`` longest of the others (0), with their contexts."""
    base, out, rest = base_spans(text), [], []
    for m in RUN.finditer(text):
        a, b = m.span()
        row = (text[max(0, a - LEFT) : a], m[0], text[b : b + RIGHT])
        if any(x < b and y > a for x, _, y in base):
            out.append((*row, 1))
        else:
            rest.append((*row, 0))
    return out + sorted(rest, key=lambda x: (-len(x[1]), x))[:plain]


def found_findings(docs: DataFrame, held_out: Column, max_docs: int = MAX_DOCS, max_rows: int = MAX_ROWS) -> list[tuple[str, str, str, int]]:
    """Labelled findings from a bounded sample of ``docs`` (``doc_id``, ``text``): of ``max_docs`` documents at most, by a hash of their ids, outside
    ``held_out`` (a condition on ``doc_id``), at most ``max_rows`` of each label, by a hash of themselves.  Null ids and texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = [x for text in part.column("text").to_pylist() for x in labelled_runs(text)]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int32()))], ["l", "c", "r", "y"])

    plain = texts(docs)
    ids = plain.where("doc_id IS NOT NULL").where(~held_out).select(F.col("doc_id").alias("of")).distinct().orderBy(F.xxhash64("of"), "of").limit(max_docs)
    # At most max_docs ids: a bounded side.
    rows = in_arrow(plain.join(F.broadcast(ids), F.col("doc_id") == F.col("of"), "left_semi").select("text"), run, "l string, c string, r string, y int")
    out = []
    for label in (0, 1):
        own = rows.where(F.col("y") == label).distinct().orderBy(F.xxhash64("l", "c", "r"), "l", "c", "r").limit(max_rows)
        out += [(x.l, x.c, x.r, x.y) for x in own.collect()]
    return out


class Scanner:
    """The network, its calibration and its threshold."""

    EMBED, WIDTH, FILTERS = 8, 5, 16
    SYMBOLS = 98  # printable ASCII, other characters, and the gap beside short contexts

    def __init__(self, seed: int = MODEL_SEED):
        r = np.random.default_rng(seed)
        self.p = {
            "e": r.normal(0, 0.3, (self.SYMBOLS, self.EMBED)),
            "c": r.normal(0, 0.15, (self.WIDTH * (self.EMBED + 1), self.FILTERS)),
            "b": np.zeros(self.FILTERS),
            "w": r.normal(0, 0.1, 2 * self.FILTERS),
            "o": np.zeros(1),
        }
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}
        self.seed, self.slope, self.shift, self.threshold = seed, 1.0, 0.0, 0.5

    @classmethod
    def _symbols(cls, rows: list[tuple[str, str, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols, whether of the candidate, and whether there; contexts shorter than asked for are filled with the gap."""
        gap = "\x7f"
        lines = [left.rjust(LEFT, gap) + body + right.ljust(RIGHT, gap) for left, body, right in rows]
        most = max(map(len, lines))
        raw = np.frombuffer("".join(x.ljust(most, gap) for x in lines).encode("utf-32-le"), np.uint32).reshape(len(rows), most).astype(np.int64)
        size = np.array([len(x) for x in lines])
        step = np.arange(most)
        there = step < size[:, None]
        inside = (step >= LEFT) & (step < (size - RIGHT)[:, None])
        symbol = np.where((raw >= 32) & (raw < 127), raw - 32, np.where(raw == 127, 96, 95))
        symbol[raw == 10] = 97
        return symbol, inside.astype(np.float32), there

    def _forward(self, symbol, inside, there):
        p, n, most = self.p, *symbol.shape
        # Nothing lies beyond a row's end, whatever it is computed with.
        x = np.concatenate([p["e"][symbol] * there[:, :, None], inside[:, :, None]], 2)
        half = self.WIDTH // 2
        padded = np.zeros((n, most + 2 * half, x.shape[2]), np.float32)
        padded[:, half : half + most] = x
        cols = np.concatenate([padded[:, k : k + most] for k in range(self.WIDTH)], 2)
        act = np.maximum(cols @ p["c"] + p["b"], 0) * there[:, :, None]
        top = act.argmax(1)
        high = np.take_along_axis(act, top[:, None], 1)[:, 0]
        mean = act.sum(1) / there.sum(1, dtype=np.float32)[:, None]
        hidden = np.concatenate([high, mean], 1)
        return hidden @ p["w"] + p["o"][0], cols, act, top, hidden

    def raw(self, rows: list[tuple[str, str, str]]) -> np.ndarray:
        """Uncalibrated scores; rows of like length go together, so padding stays small."""
        out = np.zeros(len(rows))
        order = sorted(range(len(rows)), key=lambda i: len(rows[i][1]))
        i = 0
        while i < len(order):
            # Sorted, so the last row of a batch is its longest: a batch ends where padded rows would pass 20,000 characters, which stay in the cache.
            j = i + 1
            while j < len(order) and (j + 1 - i) * (len(rows[order[j]][1]) + LEFT + RIGHT) <= 20_000:
                j += 1
            own = order[i:j]
            out[own] = self._forward(*self._symbols([rows[k] for k in own]))[0]
            i = j
        return out

    def scores(self, rows: list[tuple[str, str, str]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(rows) + self.shift, -30, 30)))

    def fit(self, findings: list[tuple[str, str, str, int]], epochs: int = 10, batch: int = 64, rate: float = 0.005) -> Scanner:
        """Trains on two thirds of the findings and calibrates on the rest.  Both labels are needed."""
        if len({x[3] for x in findings}) < 2:
            raise ValueError("findings of both labels are needed")
        rows = [(a[-LEFT:], b, c[:RIGHT]) for a, b, c, _ in findings]
        label = np.array([x[3] for x in findings], np.float32)
        aside = np.arange(len(rows)) % 3 == 2
        train, held = np.flatnonzero(~aside), np.flatnonzero(aside)
        r = np.random.default_rng(self.seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        t = 0
        for _ in range(epochs):
            deal = r.permutation(train)
            for i in range(0, len(deal), batch):
                own = deal[i : i + batch]
                symbol, inside, there = self._symbols([rows[k] for k in own])
                raw, cols, act, top, hidden = self._forward(symbol, inside, there)
                g = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label[own]) / len(own)
                dh = g[:, None] * self.p["w"]
                da = (dh[:, self.FILTERS :] / there.sum(1, dtype=np.float32)[:, None])[:, None] * (act > 0)
                high = np.zeros_like(act)
                np.put_along_axis(high, top[:, None], dh[:, None, : self.FILTERS], 1)
                da = da + high * (act > 0)
                dc = da @ self.p["c"].T
                size, most, half = self.EMBED + 1, symbol.shape[1], self.WIDTH // 2
                de = np.zeros((len(own), most + 2 * half, size), np.float32)
                for k in range(self.WIDTH):
                    de[:, k : k + most] += dc[:, :, k * size : (k + 1) * size]
                flat = (de[:, half : half + most, : self.EMBED] * there[:, :, None]).reshape(-1, self.EMBED)
                grads = {"w": hidden.T @ g, "o": np.array([g.sum()]), "b": da.sum((0, 1)), "c": cols.reshape(-1, cols.shape[2]).T @ da.reshape(-1, self.FILTERS), "e": np.stack([np.bincount(symbol.ravel(), flat[:, f], self.SYMBOLS) for f in range(self.EMBED)], 1)}
                t += 1
                for k, x in grads.items():
                    x = x.astype(np.float32)
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v[k] = 0.999 * v[k] + 0.001 * x * x
                    self.p[k] -= rate * m[k] / (1 - 0.9**t) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        # Platt: a slope and a shift for the held-out findings, by Newton's method with smoothed targets.
        raw, y = self.raw([rows[k] for k in held]), label[held].astype(float)
        target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        a, b = 1.0, 0.0
        for _ in range(50):
            q = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
            w = q * (1 - q) + 1e-9
            grad = np.array([((q - target) * raw).sum(), (q - target).sum()])
            hess = np.array([[(w * raw * raw).sum() + 1e-6, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-6]])
            step = np.linalg.solve(hess, grad)
            a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
        self.slope, self.shift = float(a), float(b)
        good = np.sort(self.scores([rows[k] for k in held])[y == 1])
        self.threshold = float(good[int(np.floor((1 - RECALL) * len(good)))])
        return self


def spans_of(text: str, scanner: Scanner) -> list[tuple[int, int, int, float]]:
    """Start, kind's number, end and score (1 for base spans) of all findings of one text, by start, then kind."""
    return _spans([text], scanner)[0]


def _spans(texts: list[str], scanner: Scanner) -> list[list[tuple[int, int, int, float]]]:
    out, rows, at = [], [], []
    for k, text in enumerate(texts):
        base = base_spans(text)
        out.append([(*b, 1.0) for b in base])
        for a, b in runs(text, base):
            rows.append((text[max(0, a - LEFT) : a], text[a:b], text[b : b + RIGHT]))
            at.append((k, a, b))
    if rows:
        for (k, a, b), score in zip(at, scanner.scores(rows), strict=True):
            if score >= scanner.threshold:
                out[k].append((a, 3, b, float(score)))
    return [sorted(x) for x in out]


def _scan(scanner: Scanner):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in row_slices(batch):
                found = _spans(text.to_pylist(), scanner)
                flat = [x for own in found for x in own]
                offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
                values = pa.StructArray.from_arrays([pa.array([KINDS[x[1]] for x in flat], pa.string()), pa.array([x[0] for x in flat], pa.int64()), pa.array([x[2] for x in flat], pa.int64()), pa.array([x[3] for x in flat], pa.float64())], ["kind", "start", "end", "score"])
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.ListArray.from_arrays(pa.array(offsets), values)], ["row", "secrets"])

    return run


def secrets(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """``docs`` with ``secrets`` (suffixed if there is such a column): an array of ``kind, start, end, score`` by start, then kind.

    Places are code points, the end exclusive.  Null and empty texts have none; texts of any length are scanned whole.  Repeated rows stay, each
    with its own; no rows give no rows.
    """
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])
    out = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("secrets", T.ArrayType(span))])
    return in_arrow(rows, _scan(scanner), out).select("row.*", F.col("secrets").alias(free_name(docs, "secrets")))
