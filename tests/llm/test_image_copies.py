import numpy as np
import pytest

from loomgraph.llm import image_copies
from loomgraph.llm.components import roots_of
from loomgraph.llm.image_copies import AGREE, DISTANCE, agreeing, copy_classes, copy_links, keypoints, keypoints_of, rasters

SCHEMA = "image_id long, width int, height int, pixels binary, class_id string"


def drawn(seed, cells=12, cell=8):
    return np.random.default_rng(seed).integers(0, 256, (cells, cells)).astype(np.uint8).repeat(cell, 0).repeat(cell, 1)


def frame(spark, images):
    return spark.createDataFrame([(i, None if x is None else x.shape[1], None if x is None else x.shape[0], None if x is None else np.ascontiguousarray(x).tobytes(), "c") for i, x in images], SCHEMA)


def test_copies(spark):
    a, b = drawn(1), drawn(2)
    edited = np.clip(a.astype(float) * 0.7 + 30, 0, 255).astype(np.uint8)
    patched = a.copy()
    patched[30:50, 30:60] = 0
    double = a.repeat(2, 0).repeat(2, 1)
    images = [(10, a), (11, a), (12, a[13:, 21:]), (13, edited), (14, patched), (15, np.rot90(a)), (16, double), (20, b), (21, b[:70, :]), (30, drawn(3)), (31, np.full((64, 64), 7, np.uint8)), (32, None), (33, drawn(4, 1, 2)), (None, a), (35, drawn(5))]
    got = {r.image_id: r for r in copy_classes(frame(spark, images)).collect()}
    assert {i: r.class_id for i, r in got.items()} == {**{i: 10 for i in range(10, 17)}, 20: 20, 21: 20, 30: 30, 31: 31, 32: 32, 33: 33, None: None, 35: 35}
    assert got[31].n_keypoints == got[32].n_keypoints == 0 < got[10].n_keypoints
    assert copy_classes(frame(spark, images).where("false")).collect() == []


def test_broken_pixels(spark):
    rows = spark.createDataFrame([(1, 64, 64, b"short"), (2, 0, 0, b"")], "image_id long, width int, height int, pixels binary")
    assert [(r.image_id, r.class_id, r.n_keypoints) for r in copy_classes(rows).orderBy("image_id").collect()] == [(1, 1, 0), (2, 2, 0)]


def test_rasters(spark):
    rows = spark.createDataFrame([(1, [1.0, None, float("nan")]), (2, None), (3, [])], "vec_id long, embedding array<float>")
    got = {r.image_id: r for r in rasters(rows, cell=2).collect()}
    assert got[1].width == 4 and len(got[1].pixels) == 16 and got[2].pixels is None and got[3].width == 0


def brute_links(points):
    """All pairs of images, all pairs of their keypoints."""
    ids = sorted({p.image_id for p in points})
    own = {i: ([p for p in points if p.image_id == i]) for i in ids}
    words = {i: np.array([[p.d0, p.d1, p.d2, p.d3] for p in own[i]]) for i in ids}
    out = set()
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            off = np.bitwise_count(words[i][:, None] ^ words[j][None]).sum(2)
            m = [(own[i][x].point, own[i][x].x, own[i][x].y, own[i][x].scale, own[i][x].angle, y, own[j][y].x, own[j][y].y, own[j][y].scale, own[j][y].angle) for x, y in zip(*np.nonzero(off <= DISTANCE), strict=True)]
            if len(m) >= AGREE and agreeing(np.array(m, float)) >= AGREE:
                out.add((i, j))
    return out


def classes(links, ids):
    """The smallest id that links reach."""
    a, b = (np.array([x[k] for x in links], np.int64) for k in range(2))
    return {i: i for i in ids} | dict(zip(*(x.tolist() for x in roots_of(a, b)), strict=True))


def vectors_of(spark, groups, noise):
    r = np.random.default_rng(0)
    rows, k = [], 0
    for size in groups:
        base = r.normal(size=64)
        for _ in range(size):
            rows.append((k, (base + noise * r.normal(size=64)).tolist()))
            k += 1
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


@pytest.mark.parametrize("groups", [[1, 2, 3, 4, 5] * 3, [60, 60, 1, 1, 30]])
def test_recall(spark, groups):
    """Of the images that the links between all pairs put in a class of several, nine in ten get it; no image gets another."""
    points = keypoints(rasters(vectors_of(spark, groups, 0.1))).cache()
    rows = points.collect()
    ids = range(sum(groups))
    want = classes(brute_links(rows), ids)
    got = classes([(x.a, x.b) for x in copy_links(points).collect()], ids)
    many = [i for i in ids if list(want.values()).count(want[i]) > 1]
    assert len(many) >= 0.9 * sum(g for g in groups if g > 1)
    assert sum(got[i] == want[i] for i in many) >= 0.9 * len(many)
    group = np.repeat(np.arange(len(groups)), groups)
    assert all(group[i] == group[c] for i, c in got.items())


def textured(seed, size=200):
    """Blobs of several sizes."""
    r = np.random.default_rng(seed)
    x = sum(r.integers(0, 256, (-(-size // c), -(-size // c))).astype(float).repeat(c, 0).repeat(c, 1)[:size, :size] * c for c in (5, 9, 17, 31))
    return np.clip((x - x.min()) / (x.max() - x.min()) * 255, 0, 255).astype(np.uint8)


EDITS = {
    "crop": lambda x, r: x[r.integers(0, 40) :, r.integers(0, 40) :],
    "narrow": lambda x, r: x[20:-20, 15:-35],
    "brighter": lambda x, r: np.clip(x * 0.75 + 40, 0, 255).astype(np.uint8),
    "turned": lambda x, r: np.rot90(x, int(r.integers(1, 4))),
    "doubled": lambda x, r: x.repeat(2, 0).repeat(2, 1),
    "halved": lambda x, r: x.reshape(100, 2, 100, 2).mean((1, 3)).astype(np.uint8),
    "noise": lambda x, r: np.clip(x + r.normal(0, 4, x.shape), 0, 255).astype(np.uint8),
    "patched": lambda x, r: np.where((np.add.outer(np.arange(200) // 50, np.arange(200) // 50) % 4 == 0), 0, x).astype(np.uint8),
}


def test_edits(spark):
    """Of the copies by each kind of edit, nine in ten have the class of their original; unlike images none."""
    r = np.random.default_rng(3)
    images, of = [], {}
    for k in range(10):
        base = textured(k)
        images.append((100 * k, base))
        for n, edit in enumerate(EDITS.values(), 1):
            images.append((100 * k + n, np.ascontiguousarray(edit(base, r))))
    got = {x.image_id: x.class_id for x in copy_classes(frame(spark, images)).collect()}
    share = {name: sum(got[100 * k + n] == 100 * k for k in range(10)) for n, name in enumerate(EDITS, 1)}
    assert min(share.values()) >= 9, share
    assert all(c // 100 == i // 100 for i, c in got.items())


def test_scales():
    of, where, words = keypoints_of(np.stack([drawn(1, 16)] * 2) / np.float32(255))
    assert set(where[:, 2]) >= {1, 2} and (where[of == 0] == where[of == 1]).all() and (words[of == 0] == words[of == 1]).all()


def made(rng, groups, size, share):
    """Keypoints in groups of images whose descriptors are equal, but for bits of which two images differ in ``share``."""
    out, image = [], 0
    for _ in range(groups):
        words = rng.integers(-(1 << 62), 1 << 62, (12, 4))
        for _ in range(size):
            own = words.copy()
            for p in range(12):
                for bit in rng.choice(256, int(256 * share), replace=False):
                    own[p, bit // 64] ^= np.int64(1) << np.int64(bit % 64 if bit % 64 < 63 else 62)
            out += [(image, p, float(9 * p), float(p * p), 1.0, 0.0, *own[p].tolist()) for p in range(12)]
            image += 1
    return out


def test_mixed_entries(spark):
    """Classes in entries that hold several groups, whose hubs are of one group: all keypoints share the bits of one table."""
    r = np.random.default_rng(6)
    points = [(*x[:6], 7, *x[7:]) for x in made(r, 6, 15, 0.03)]
    got = classes([(x.a, x.b) for x in copy_links(spark.createDataFrame(points, image_copies.KEYPOINTS)).collect()], range(90))
    assert got == {i: i // 15 * 15 for i in range(90)}


def test_agreement_in_blocks(monkeypatch):
    """A turned, shifted and scaled set of points agrees, whatever is tried at once; scattered ones don't."""
    r = np.random.default_rng(2)
    x, y, t = r.uniform(0, 200, 60), r.uniform(0, 200, 60), r.uniform(-3, 3, 60)
    c, s = 2 * np.cos(0.7), 2 * np.sin(0.7)
    good = np.stack([np.arange(60), x, y, np.ones(60), t, np.arange(60), 5 + c * x - s * y, 9 + s * x + c * y, np.full(60, 2.0), t + 0.7], 1)
    bad = good.copy()
    bad[:, 6:8] = r.uniform(0, 400, (60, 2))
    mixed = np.concatenate([good[:20], bad[20:]])
    for size in (1, 100, 1 << 20):
        monkeypatch.setattr(image_copies, "PROPOSALS", size)
        assert agreeing(good) == 60 and 20 <= agreeing(mixed) <= 22 and agreeing(bad) <= 6 and agreeing(good[:1]) == 1


def test_equal_images(spark):
    """Equal images are compared once; without enough keypoints they stay alone."""
    a = textured(1)
    small = frame(spark, [(k, a) for k in (5, 3, 9)] + [(7, a[13:, 21:]), (8, a[13:, 21:])] + [(k, np.full((64, 64), 7, np.uint8)) for k in (1, 2)])
    got = {r.image_id: r.class_id for r in copy_classes(small).collect()}
    assert got == {1: 1, 2: 2, **{k: 3 for k in (3, 5, 7, 8, 9)}}


def test_whole_distance(spark):
    """Two descriptors that differ in 48 bits and agree on the bits of any one of the eight tables meet, wherever the other bits lie."""
    r = np.random.default_rng(5)
    words = r.integers(0, 1 << 32, 8).astype(np.uint64)
    points = []
    for half in range(8):  # images 2 * half and 2 * half + 1 share this half only
        for point in range(AGREE):
            a = words ^ r.integers(0, 1 << 32, 8).astype(np.uint64)
            b = a.copy()
            for k, other in enumerate(k for k in range(8) if k != half):
                low = image_copies.MORE_BITS if other == (half + 1) % 8 else 0
                for bit in low + r.choice(32 - low, 7 if k < 6 else 6, replace=False):
                    b[other] ^= np.uint64(1 << int(bit))
            for image, d in ((2 * half, a), (2 * half + 1, b)):
                points.append((image, point, float(9 * point), float(point * point), 1.0, 0.0, *(d[::2] | d[1::2] << np.uint64(32)).view(np.int64).tolist()))
    frame_of = spark.createDataFrame(points, image_copies.KEYPOINTS)
    assert {(x.a, x.b) for x in copy_links(frame_of).collect()} == {(2 * h, 2 * h + 1) for h in range(8)}
