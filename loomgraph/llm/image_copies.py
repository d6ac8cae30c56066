"""Copies of images, cropped or edited, by local descriptors.

Corners of several scales get an orientation from their patch's intensity centroid and a 256-bit descriptor of brightness tests on a smoothed
patch, the test points turned to that orientation.  Descriptors meet in eight Hamming tables of 40 bits each: two that share a table's bits meet.
A pair of images is a copy if enough of its keypoints meet, lie within ``DISTANCE`` bits and agree on one turn, scale and shift.  Links make classes.

Classes don't need all pairs of a group.  In a few rounds each table entry tries its members with two hubs, the images of its smallest and its
largest hash in that round; links that hold make classes, and entries of one class are done.  Then, in entries where several classes are left, all
pairs of different classes are tried.  No pair within a class could change it, so the classes are those of all pairs that meet, however few
links the rounds have found.  Images whose keypoints are all equal are compared once, by one of them.
The tables are approximate; the tests measure their recall against all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .components import connected_components

#: Of the patch that the tests read, and of the part that gives its orientation.  A small patch has little to tell: with 12 pixels, one in a hundred
#: pairs of keypoints of unlike images lay within ``DISTANCE``, with 24 one in twenty thousand.
RADIUS, DISC_RADIUS = 24, 16
BINS = 32
BITS = 256
#: One for each half of each word, so that no part of a descriptor goes without; it takes so many bits of the next half along.  With 32 bits
#: alone, keypoints of unlike images share an entry fifteen times as often.
TABLES, MORE_BITS = 8, 8
#: Differing bits, of all 256, up to which two descriptors match.
DISTANCE = 48
#: Matches that must agree, and how far off a place may be, in pixels of the match's scale.
AGREE, OFF, TURN = 4, 3.0, 0.35
#: Pairs of proposal and match that are tried at once.
PROPOSALS = 1 << 20
#: Rounds with hubs.
ROUNDS = 3
SCALES = (1, 2, 4)
#: Keypoints whose descriptors are computed at once.
AT_ONCE = 512
CORNER = 1e-6
#: Corners nearer to the border than half a patch are left out.  A patch that crosses it repeats the border's pixels, and much of theirs would be so.
EDGE = RADIUS // 2
KEYPOINTS = "image_id long, point long, x float, y float, scale float, angle float, d0 long, d1 long, d2 long, d3 long"


def _patterns() -> np.ndarray:
    """Test points for each orientation: (bins, bits, first or second, dx or dy), within the patch."""
    r = np.random.default_rng(20)
    points = r.normal(0, RADIUS / 2.2, (BITS, 2, 2))
    norm = np.linalg.norm(points, axis=2, keepdims=True)
    points *= np.minimum(1, (RADIUS - 1) / np.maximum(norm, 1e-9))
    turn = 2 * np.pi * np.arange(BINS) / BINS
    c, s = np.cos(turn)[:, None, None], np.sin(turn)[:, None, None]
    x, y = points[None, :, :, 0], points[None, :, :, 1]
    return np.rint(np.stack([c * x - s * y, s * x + c * y], -1)).astype(np.int64)


PATTERNS = _patterns()
DISC = np.array([(x, y) for x in range(-DISC_RADIUS, DISC_RADIUS + 1) for y in range(-DISC_RADIUS, DISC_RADIUS + 1) if x * x + y * y <= DISC_RADIUS**2])


def _blur(x: np.ndarray, k: int = 1) -> np.ndarray:
    """Mean over a square of 2k+1 pixels, edges repeated."""
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (k + 1, k)
        c = np.cumsum(np.pad(x, pad, mode="edge"), axis=axis, dtype=np.float64)
        n = x.shape[axis]
        hi = np.take(c, np.arange(2 * k + 1, 2 * k + 1 + n), axis=axis)
        x = ((hi - np.take(c, np.arange(n), axis=axis)) / (2 * k + 1)).astype(np.float32)
    return x


def _corners(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Image, row and column of each corner: local maxima of the structure tensor's response, a little off the border."""
    gx, gy = np.zeros_like(x), np.zeros_like(x)
    gx[:, :, 1:-1] = x[:, :, 2:] - x[:, :, :-2]
    gy[:, 1:-1] = x[:, 2:] - x[:, :-2]
    a, b, c = _blur(gx * gx, 2), _blur(gy * gy, 2), _blur(gx * gy, 2)
    response = a * b - c * c - 0.03 * (a + b) ** 2
    best = response.copy()
    for k in (1, 2, 3):  # the largest of seven by seven
        best[:, k:] = np.maximum(best[:, k:], response[:, :-k])
        best[:, :-k] = np.maximum(best[:, :-k], response[:, k:])
    rows = best.copy()
    for k in (1, 2, 3):
        best[:, :, k:] = np.maximum(best[:, :, k:], rows[:, :, :-k])
        best[:, :, :-k] = np.maximum(best[:, :, :-k], rows[:, :, k:])
    peak = (response >= best) & (response > CORNER)
    peak[:, :EDGE] = peak[:, -EDGE:] = False
    peak[:, :, :EDGE] = peak[:, :, -EDGE:] = False
    return np.nonzero(peak)


def keypoints_of(images: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of images of one size (n, height, width; 0 to 1): each keypoint's image, its x, y, scale, angle, and its descriptor as four words."""
    of, where, words = [], [], []
    for scale in SCALES:
        n, h, w = images.shape[0], images.shape[1] // scale, images.shape[2] // scale
        if min(h, w) <= 2 * EDGE + 1:
            break
        x = images[:, : h * scale, : w * scale].reshape(n, h, scale, w, scale).mean((2, 4), dtype=np.float32)
        x = _blur(x, 1)
        i, r, c = _corners(x)
        x = _blur(x, 2)
        # Whole numbers: sums are exact, so an image's points don't depend on what it is computed with.
        x = np.rint(x * 4095)
        x = np.pad(x, [(0, 0), (RADIUS, RADIUS), (RADIUS, RADIUS)], mode="edge")
        r, c = r + RADIUS, c + RADIUS
        for k in range(0, len(i), AT_ONCE):
            ik, rk, ck = i[k : k + AT_ONCE], r[k : k + AT_ONCE], c[k : k + AT_ONCE]
            patch = x[ik[:, None], rk[:, None] + DISC[:, 1], ck[:, None] + DISC[:, 0]]
            patch = patch.astype(np.float64)
            angle = np.arctan2(patch @ DISC[:, 1].astype(float), patch @ DISC[:, 0].astype(float))
            turn = np.rint(angle * BINS / (2 * np.pi)).astype(np.int64) % BINS
            p = PATTERNS[turn]
            v = x[ik[:, None, None], rk[:, None, None] + p[..., 1], ck[:, None, None] + p[..., 0]]
            bits = v[:, :, 0] < v[:, :, 1]
            of.append(ik)
            where.append(np.stack([(ck - RADIUS + 0.5) * scale, (rk - RADIUS + 0.5) * scale, np.full(len(ik), scale), angle], 1))
            words.append(np.packbits(bits, axis=1, bitorder="little").view("<i8"))
    if not of:
        return np.zeros(0, np.int64), np.zeros((0, 4)), np.zeros((0, 4), np.int64)
    return np.concatenate(of), np.concatenate(where), np.concatenate(words)


def _keypoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, widths, heights = (batch.column(c).to_pylist() for c in ("image_id", "width", "height"))
        pixels = batch.column("pixels")
        sizes: dict[tuple[int, int], list[int]] = {}
        for k, (w, h) in enumerate(zip(widths, heights, strict=True)):
            if ids[k] is not None and w and h and pixels[k].is_valid and len(pixels[k].as_buffer()) == w * h:
                sizes.setdefault((w, h), []).append(k)
        for (w, h), rows in sizes.items():
            most = max(1, (1 << 20) // (w * h))
            for i in range(0, len(rows), most):
                own = rows[i : i + most]
                x = np.stack([np.frombuffer(pixels[k].as_buffer(), np.uint8) for k in own]).reshape(-1, h, w).astype(np.float32) / 255
                of, where, words = keypoints_of(x)
                image = np.array([ids[k] for k in own], np.int64)[of]
                order = np.argsort(of, kind="stable")
                image, of, where, words = image[order], of[order], where[order], words[order]
                point = np.arange(len(of)) - np.searchsorted(of, of)
                yield pa.RecordBatch.from_arrays([pa.array(image), pa.array(point), *(pa.array(where[:, k].astype(np.float32)) for k in range(4)), *(pa.array(words[:, k]) for k in range(4))], [f.split()[0] for f in KEYPOINTS.split(", ")])


def keypoints(images: DataFrame) -> DataFrame:
    """All keypoints of ``images`` (``image_id``, ``width``, ``height``, ``pixels``: one byte a pixel, row by row), ``point`` counting an image's own.

    A row without id or pixels, or with a wrong number of them, has none.
    """
    own = images.select(F.col("image_id").cast("long").alias("image_id"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "pixels")
    return own.mapInArrow(_keypoints, KEYPOINTS)


def agreeing(m: np.ndarray) -> int:
    """How many matches agree on one similarity, at best.  A row of ``m``: point, x, y, scale, angle of the one image, then of the other."""
    pa_, xa, ya, sa, ta, _, xb, yb, sb, tb = m.T
    turn, ratio = tb - ta, sb / sa
    c, s = ratio * np.cos(turn), ratio * np.sin(turn)

    def fits(i: np.ndarray) -> np.ndarray:
        """Each match of ``i`` proposes a turn, scale and shift, and is tried on all."""
        dx, dy = xa[None] - xa[i, None], ya[None] - ya[i, None]
        gone_x = xb[i, None] + c[i, None] * dx - s[i, None] * dy - xb[None]
        gone_y = yb[i, None] + s[i, None] * dx + c[i, None] * dy - yb[None]
        twist = np.abs((turn[None] - turn[i, None] + np.pi) % (2 * np.pi) - np.pi)
        return (np.hypot(gone_x, gone_y) <= OFF * sb[None] + 0.08 * np.hypot(dx, dy) * ratio[i, None]) & (twist <= TURN) & (ratio[None] == ratio[i, None])

    # So many proposals at a time that memory doesn't follow the square of the matches.
    step = max(1, PROPOSALS // len(m))
    many = np.concatenate([fits(np.arange(i, min(i + step, len(m)))).sum(1) for i in range(0, len(m), step)])
    best = np.argsort(-many, kind="stable")[:8]
    return max(len(np.unique(pa_[row])) for row in fits(best))


def _agreeing(lists: pd.Series) -> pd.Series:
    return pd.Series([agreeing(np.array([tuple(r.values()) if isinstance(r, dict) else tuple(r) for r in own], float)) for own in lists], dtype="int64")


def entries(points: DataFrame) -> DataFrame:
    """``key, image_id, point``: each keypoint under the eight table entries of its descriptor, if another keypoint is in the entry too.

    A key is a table and 40 bits of the descriptor.  Counts of keys are combined before they are dealt; the join on a key that many keypoints
    share is one that AQE may split.
    """
    word = lambda t: F.col(f"d{t // 2}")
    half = lambda t: F.shiftrightunsigned(word(t), 32) if t % 2 else word(t).bitwiseAND(F.lit(0xFFFFFFFF))
    more = lambda t: F.shiftleft(half((t + 1) % TABLES).bitwiseAND(F.lit((1 << MORE_BITS) - 1)), 32)
    rows = points.select(F.explode(F.array(*[half(t).bitwiseOR(more(t)).bitwiseOR(F.lit(t << (32 + MORE_BITS))) for t in range(TABLES)])).alias("key"), "image_id", "point")
    shared = written(rows.groupBy("key").count().where("count > 1").select("key"), "image-keys")
    return rows.join(shared.hint("shuffle_hash"), "key", "left_semi")


def hub_meetings(rows: DataFrame, seed: int) -> DataFrame:
    """``a, pa, b, pb``: meetings of images (``key, image_id, point, class``) with their entry's two hubs, where these are of another class."""
    h = F.xxhash64(F.lit(seed), "image_id")
    hub = lambda pick, name: [pick(c, h).alias(f"{name}_{c}") for c in ("image_id", "point", "class")]
    hubs = written(rows.groupBy("key").agg(*hub(F.min_by, "low"), *hub(F.max_by, "high")).where("low_class <> high_class OR low_image_id <> high_image_id"), "image-hubs")
    both = F.array(*[F.struct(F.col(f"{x}_image_id").alias("of"), F.col(f"{x}_point").alias("at"), F.col(f"{x}_class").alias("class")) for x in ("low", "high")])
    met = rows.join(hubs.hint("shuffle_hash"), "key").select("image_id", "point", "class", F.explode(both).alias("hub")).where("class <> hub.class")
    own, other = F.struct(F.col("image_id").alias("of"), F.col("point").alias("at")), F.struct("hub.of", "hub.at")
    met = met.select(F.least(own, other).alias("x"), F.greatest(own, other).alias("y"))
    return met.select(F.col("x.of").alias("a"), F.col("x.at").alias("pa"), F.col("y.of").alias("b"), F.col("y.at").alias("pb"))


def mixed(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` (``key, image_id, point``) with their ``class``, of those entries that still hold several; ``roots`` (``node, root``) has the classes of several images."""
    named = rows.join(roots, F.col("image_id") == F.col("node"), "left").select("key", "image_id", "point", F.coalesce("root", "image_id").alias("class"))
    named = written(named, "image-classes")
    left = named.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("key")
    return written(named.join(written(left, "image-mixed").hint("shuffle_hash"), "key", "left_semi"), "image-left")


def _off(a: str, b: str) -> Column:
    """How many bits two descriptors differ in."""
    return sum((F.bit_count(F.col(a.format(k)).bitwiseXOR(F.col(b.format(k)))) for k in range(4)), F.lit(0))


def class_meetings(points: DataFrame, rows: DataFrame) -> DataFrame:
    """``a, pa, b, pb``: all meetings of images of different classes (``key, image_id, point, class``) within ``DISTANCE``."""
    left = written(rows.join(points.select("image_id", "point", "d0", "d1", "d2", "d3"), ["image_id", "point"]), "image-words")
    side = lambda x: left.select("key", *[F.col(c).alias(f"{c}_{x}") for c in left.columns if c != "key"])
    near = side("a").join(side("b"), "key").where((F.col("class_a") < F.col("class_b")) & (_off("d{}_a", "d{}_b") <= DISTANCE))
    return near.select(F.col("image_id_a").alias("a"), F.col("point_a").alias("pa"), F.col("image_id_b").alias("b"), F.col("point_b").alias("pb"))


def agreeing_links(points: DataFrame, met: DataFrame) -> DataFrame:
    """``a, b, agree``: pairs of images of whose meetings (``a, pa, b, pb``) at least ``AGREE`` are matches that agree."""
    # A pair of images needs so many meetings; chance ones stay below and go before anything is joined to them.
    often = met.groupBy("a", "b").agg(F.collect_set(F.struct("pa", "pb")).alias("met")).where(F.size("met") >= AGREE)
    pairs = often.select("a", "b", F.explode("met").alias("met")).select("a", "met.pa", "b", "met.pb")
    side = lambda x: points.select("image_id", "point", "x", "y", "scale", "angle", "d0", "d1", "d2", "d3").toDF(x, f"p{x}", *[f"{c}{x}" for c in ("x", "y", "s", "t", "d0", "d1", "d2", "d3")])
    same = pairs.join(side("a"), ["a", "pa"]).join(side("b"), ["b", "pb"]).where(_off("d{}a", "d{}b") <= DISTANCE)
    match = F.struct(*[F.col(c).cast("double").alias(c) for c in ("pa", "xa", "ya", "sa", "ta", "pb", "xb", "yb", "sb", "tb")])
    both = same.groupBy("a", "b").agg(F.collect_list(match).alias("matches")).where(F.size("matches") >= AGREE)

    @F.pandas_udf("long")
    def consensus(lists: pd.Series) -> pd.Series:
        return _agreeing(lists)

    return both.select("a", "b", consensus("matches").alias("agree")).where(F.col("agree") >= AGREE)


def copy_links(points: DataFrame) -> DataFrame:
    """``a, b``: links between images of ``points`` that give the same classes as those of all pairs of images that meet.

    Rows with a null id have no links; no points, no links.  Keypoints that repeat (an id that recurs) count once.
    """
    rows = written(entries(points.where("image_id IS NOT NULL")), "image-entries").withColumn("class", F.col("image_id"))
    links = None
    for k in range(ROUNDS):
        found = written(agreeing_links(points, hub_meetings(rows, k)).select("a", "b"), "image-links")
        links = found if links is None else links.unionByName(found)
        rows = mixed(rows.drop("class"), connected_components(links))
        if found.isEmpty():
            break
    return links.unionByName(agreeing_links(points, class_meetings(points, rows)).select("a", "b"))


def copy_classes(images: DataFrame) -> DataFrame:
    """``image_id, class_id, n_keypoints`` for each row of ``images`` (``image_id``, ``width``, ``height``, ``pixels``; others are ignored).

    The class is the smallest id that links reach, itself included.  Images without keypoints (too small, flat, null or broken) are alone in
    theirs.  A null id has no class.  Rows that repeat an id count as one image of all their keypoints, each row with a row of its own.
    No images: no rows.  An image of any size is taken whole.
    """
    points = written(keypoints(images), "keypoints")
    # Images of the same keypoints have the same links: only the one of the smallest id is compared, and stands for the others.
    h = [F.xxhash64(F.lit(k), *points.columns[1:]) for k in range(2)]
    sums = [F.sum(x) for y in h for x in (F.shiftrightunsigned(y, 32), y.bitwiseAND(F.lit(0xFFFFFFFF)))]
    counts = points.groupBy("image_id").agg(F.count(F.lit(1)).alias("k"), F.max("point").alias("last"), F.xxhash64(*sums).alias("h0"), F.xxhash64(F.lit(1), *sums).alias("h1"))
    counts = written(counts, "images")
    alike = written(counts.groupBy("k", "h0", "h1").agg(F.min("image_id").alias("first")), "image-firsts")
    counts = written(counts.join(alike, ["k", "h0", "h1"]).select("image_id", "k", (F.col("last") + 1 >= AGREE).alias("enough"), "first"), "images")
    links = written(copy_links(points.join(counts.where("image_id = first AND enough").select("image_id"), "image_id", "left_semi")), "image-links")
    roots = connected_components(links)
    first = counts.select(F.col("image_id").alias("i"), "k", "enough", "first")
    known = first.join(roots, F.col("first") == F.col("node"), "left").select("i", "k", F.when(F.col("enough"), F.coalesce("root", "first")).alias("root"))
    own = images.select(F.col("image_id").cast("long").alias("image_id"))
    done = own.join(known, F.col("image_id") == F.col("i"), "left")
    return done.select("image_id", F.coalesce("root", "image_id").alias("class_id"), F.coalesce("k", F.lit(0).cast("long")).alias("n_keypoints"))


def rasters(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cell: int = 8) -> DataFrame:
    """Vectors of numbers as images: a square of cells, row by row, brighter for larger numbers; a null vector has null pixels.

    The square's side is the root of the length, rounded up; cells without a number, nulls and NaN are mid-grey.
    """

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pixels, sides = [], []
            for v in batch.column("v").to_pylist():
                if v is None:
                    pixels.append(None)
                    sides.append(None)
                    continue
                x = np.nan_to_num(np.array(v, float), posinf=1e9, neginf=-1e9)
                side = int(np.ceil(np.sqrt(len(x))))
                grid = np.zeros(side * side)
                grid[: len(x)] = x
                norm = np.sqrt((grid**2).mean()) if len(x) else 0.0
                grid = np.clip(128 + 42 * grid / (norm or 1), 0, 255).astype(np.uint8).reshape(side, side)
                pixels.append(grid.repeat(cell, 0).repeat(cell, 1).tobytes())
                sides.append(side * cell)
            yield pa.RecordBatch.from_arrays([batch.column("image_id"), pa.array(sides, pa.int32()), pa.array(sides, pa.int32()), pa.array(pixels, pa.binary())], ["image_id", "width", "height", "pixels"])

    own = vectors.select(F.col(id_col).cast("long").alias("image_id"), F.col(vec_col).cast("array<double>").alias("v"))
    return own.mapInArrow(draw, T.StructType([T.StructField("image_id", T.LongType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("pixels", T.BinaryType())]))
