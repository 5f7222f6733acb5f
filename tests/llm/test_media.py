"""Image copies: decoding, descriptors, and search against brute force."""

import struct
import zlib

import numpy as np

from cytolake.llm import media
from cytolake.llm.common import table
from cytolake.llm.registry import QUERIES


def png(pixels: np.ndarray, kind: int) -> bytes:
    """A PNG of grey or colour bytes, each line with one filter."""
    h, w = pixels.shape[:2]
    flat = pixels.reshape(h, -1).astype(np.int64)
    c = flat.shape[1] // w
    lines = []
    for y in range(h):
        up = flat[y - 1] if y else np.zeros_like(flat[0])
        left, corner = (np.concatenate([np.zeros(c, np.int64), v[:-c]]) for v in (flat[y], up))
        p = left + up - corner
        near = np.select([(abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), abs(p - up) <= abs(p - corner)], [left, up], corner)
        lines.append(bytes([kind]) + ((flat[y] - [0, left, up, (left + up) // 2, near][kind]) & 255).astype(np.uint8).tobytes())
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if c == 3 else 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(b"".join(lines))) + part(b"IEND", b"")


def picture(seed: int) -> np.ndarray:
    return media.render(np.random.default_rng(seed).normal(size=64))


def test_decoding():
    grey = picture(1).astype(np.uint8)
    for kind in range(5):
        assert np.array_equal(media.decode(png(grey, kind)), grey)
        colour = np.stack([grey, grey // 2, 255 - grey], axis=2)
        assert np.allclose(media.decode(png(colour, kind)), colour.mean(axis=2))
    assert np.array_equal(media.decode(media.encode_pgm(grey)), grey)
    assert np.allclose(media.decode(b"P6 2 1 255\n" + bytes([0, 3, 6, 9, 9, 9])), [[3, 9]])
    for bad in (None, b"", b"text", b"P5 9 9 255\n", png(grey, 0)[:40], b"P5 x y 255\n"):
        assert media.decode(bad) is None


def coded(values: np.ndarray, bits: int, colour: int, interlaced: bool, palette: bytes = b"") -> bytes:
    """A PNG of samples (height, width, channels) of any depth, unfiltered but for every third line, which has the one above taken off."""
    h, w, c = values.shape
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    out = b""
    for x0, y0, dx, dy in media._PASSES if interlaced else [(0, 0, 1, 1)]:
        own = values[y0::dy, x0::dx]
        if not own.size:
            continue
        binary = ((own[..., None] >> np.arange(bits)[::-1]) & 1).astype(np.uint8).reshape(len(own), -1)
        lines = np.packbits(binary, axis=1).astype(np.int64)
        for y, line in enumerate(lines):
            out += bytes([2 if y % 3 == 1 else 0]) + ((line - (lines[y - 1] if y % 3 == 1 else 0)) & 255).astype(np.uint8).tobytes()
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, bits, colour, 0, 0, int(interlaced))) + (part(b"PLTE", palette) if palette else b"") + part(b"IDAT", zlib.compress(out)) + part(b"IEND", b"")


def test_decoding_of_every_kind_of_png():
    rnd = np.random.default_rng(3)
    for interlaced in (False, True):
        for colour, channels, depths in ((0, 1, (1, 2, 4, 8, 16)), (2, 3, (8, 16)), (3, 1, (1, 2, 4, 8)), (4, 2, (8, 16)), (6, 4, (8, 16))):
            for bits in depths:
                for h, w in ((9, 13), (1, 1), (3, 8)):
                    v = rnd.integers(0, 1 << bits, (h, w, channels))
                    palette = rnd.integers(0, 256, (1 << bits, 3)).astype(np.uint8) if colour == 3 else None
                    got = media.decode(coded(v, bits, colour, interlaced, palette.tobytes() if colour == 3 else b""))
                    want = palette.mean(axis=1)[v[..., 0]] if colour == 3 else (v[..., :3].mean(axis=2) if channels >= 3 else v[..., 0]) * 255 / ((1 << bits) - 1)
                    assert np.allclose(got, want, atol=1e-3)
    large = rnd.integers(0, 256, (300, 400)).astype(np.uint8)
    for kind in (3, 4):
        assert np.array_equal(media.decode(png(large, kind)), large)


def test_decoding_of_portable_maps():
    assert np.allclose(media.decode(b"P5 # a comment\n# another\n 2 2 # more\n255\n" + bytes([0, 35, 9, 255])), [[0, 35], [9, 255]])
    assert np.allclose(media.decode(b"P5 2 1 65535\n" + bytes([255, 255, 0, 0])), [[255, 0]])
    assert np.allclose(media.decode(b"P2\n2 1\n15\n15 3\n"), [[255, 51]]) and np.allclose(media.decode(b"P3 1 1 255 3 6 9"), [[6]])
    for bad in (b"P5 2 2 0\n0000", b"P5 2 2", b"P7 2 2 255\n0000", b"P2 2 2 255 1 2 x 4"):
        assert media.decode(bad) is None


def test_large_images_are_described_alone(spark, monkeypatch):
    """However images are stacked, their descriptors are the same; of equal ones in a task only the first is described."""
    rows = [(i, media.encode_pgm(picture(i % 4))) for i in range(9)] + [(20, media.encode_pgm(np.tile(picture(1), (1, 2))))]
    df = spark.createDataFrame(rows, "id bigint, image binary").coalesce(1)
    got = {r.id: r.corners for r in media.scanned(df).collect()}
    assert [got[i] is None for i in range(9)] == [False] * 4 + [True] * 5
    for i in (0, 1, 2, 3):
        alone = media.descriptors(picture(i)[None].astype(np.float32))
        assert sorted(np.array(c.words, np.int64).tobytes() for c in got[i]) == sorted(r.tobytes() for r in alone[5])
        assert all(c["keys"] == [int.from_bytes(np.array(c.words, np.int64).tobytes()[3 * k:3 * k + 3], "big") for k in range(media.TABLES)] for c in got[i])
    classes = {r.id: r for r in media.image_classes(media.scanned(df.repartition(4))).collect()}
    assert {i: r.class_size for i, r in classes.items()} == {0: 3, 1: 2, 2: 2, 3: 2, 20: 1} and all(r.corners for r in classes.values())


def test_descriptors_follow_edits():
    p = picture(2)
    base = media.descriptors(p[None])
    for kind in range(4):
        copy = media.descriptors(np.ascontiguousarray(media.edited(p, kind))[None])
        different = np.unpackbits(base[5][:, None] ^ copy[5][None], axis=2).sum(axis=2)
        assert (different.min(axis=0) <= media.MOST_BITS).sum() >= 5
    assert media.descriptors(np.full((1, 80, 80), 7.0, np.float32))[0].size == 0
    assert media.descriptors(np.zeros((1, 5, 5), np.float32))[0].size == 0


def test_tables_keep_every_pair_within_the_guarantee():
    """Bits that differ in fewer than twice as many places as there are tables leave one part with at most one."""
    rnd = np.random.default_rng(0)
    for _ in range(500):
        wrong = np.zeros(media.INDEXED, int)
        wrong[rnd.choice(media.INDEXED, 2 * media.TABLES - 1, replace=False)] = 1
        assert (wrong.reshape(media.TABLES, -1).sum(axis=1) <= 1).any()
    assert media.INDEXED % (8 * media.TABLES) == 0 and media.BITS % 64 == 0


def test_op3_meets_every_pair_that_it_must(spark):
    """The join against all pairs of descriptors: those of at most nine different indexed bits, and of few enough in all."""
    rnd = np.random.default_rng(7)
    some = rnd.integers(0, 256, (40, media.BITS // 8)).astype(np.uint8)
    other = np.repeat(some, 3, axis=0)
    for r in other:
        for b in rnd.choice(media.BITS, rnd.integers(0, 40), replace=False):
            r[b // 8] ^= 1 << (b % 8)

    def rows(bits):
        keys = bits[:, :15].reshape(len(bits), 5, 3).astype(int) @ np.array([65536, 256, 1])
        return spark.createDataFrame([(i, k.tolist(), w.tolist()) for i, (k, w) in enumerate(zip(keys, np.ascontiguousarray(bits).view(np.int64)))], "id bigint, keys array<int>, words array<bigint>")

    different = np.unpackbits(some[:, None] ^ other[None], axis=2)
    must = {(i, j) for i, j in zip(*np.nonzero((different[..., :media.INDEXED].sum(axis=2) <= 9) & (different.sum(axis=2) <= media.MOST_BITS)))}
    both = media._parts(rows(some), "q", True).join(media._parts(rows(other), "m"), ["part", "key"])
    got = {(r.q_id, r.m_id): r.d for r in both.select("q_id", "m_id", media.difference().alias("d")).collect()}
    assert len(must) > 30 and must <= set(got) and all(got[p] == different[p].sum() for p in got)


def test_op3_takes_every_pair_once(spark):
    """A pair that meets in several tables is one row, whichever the first is."""
    rnd = np.random.default_rng(8)
    some = rnd.integers(0, 256, (60, media.BITS // 8)).astype(np.uint8)
    other = some.copy()
    for r in other:
        for b in rnd.choice(media.INDEXED, rnd.integers(0, 14), replace=False):
            r[b // 8] ^= 1 << (b % 8)

    def rows(bits):
        keys = bits[:, :15].reshape(len(bits), 5, 3).astype(int) @ np.array([65536, 256, 1])
        return spark.createDataFrame([(i, k.tolist(), w.tolist()) for i, (k, w) in enumerate(zip(keys, np.ascontiguousarray(bits).view(np.int64)))], "id bigint, keys array<int>, words array<bigint>")

    different = np.unpackbits(some[:, None] ^ other[None], axis=2)
    parts = different[..., :media.INDEXED].reshape(60, 60, media.TABLES, -1).sum(axis=3)
    want = {(i, j): int((parts[i, j] <= 1).argmax()) for i, j in zip(*np.nonzero((parts <= 1).any(axis=2) & (different.sum(axis=2) <= media.MOST_BITS)))}
    got = [(r.q_id, r.m_id, r.part) for r in media.met(media._parts(rows(some), "q", True), media._parts(rows(other), "m")).collect()]
    assert sorted(got) == sorted((i, j, p) for (i, j), p in want.items()) and len(set(want.values())) > 2


def test_op3_counts_the_corners_of_every_bin(spark):
    """Bins of movements by cells against votes put into each bin; a vote that comes many times is expanded once."""
    rnd = np.random.default_rng(9)
    votes = [(int(rnd.integers(2)), int(rnd.integers(3)), int(rnd.integers(9)), int(rnd.integers(media.TURNS)), int(rnd.integers(-1, 2)), float(rnd.normal(0, 12)), float(rnd.normal(0, 12))) for _ in range(400)]
    want = {}
    for q, m, corner, t, s, dx, dy in votes:
        for o in range(8):
            half = [(o >> k & 1) / 2 for k in range(3)]
            key = q, m, s, o, int((t / 4 + half[2]) % (media.TURNS / 4)), int(np.floor(dx / media.SHIFT + half[0])), int(np.floor(dy / media.SHIFT + half[1]))
            own = want.setdefault(key, [set(), t])
            own[0].add(corner)
            own[1] = min(own[1], t)
    df = spark.createDataFrame(votes * 30, "q_id bigint, m_id bigint, q_corner int, t int, s int, dx double, dy double")
    got = media.movements(df)
    assert {(r.q_id, r.m_id, r.s, r.o, r.tb, r.xb, r.yb): (r.n, r.t) for r in got.collect()} == {k: (len(c), t) for k, (c, t) in want.items()}


def test_op3_finds_every_edited_copy(spark):
    vectors = table(spark, "/root/testdata/sf0.01", "embeddings")
    asked = {r.vec_id for r in vectors.where("vec_id % 100 = 0").collect()}
    got = media.find_copies(media.pictures(vectors, copies=True), media.pictures(vectors)).collect()
    assert {r.query_id for r in got if r.match_id == r.query_id} == asked
    assert all(r.turn in ((7, 8, 9) if r.query_id // 100 % 4 == 2 else (31, 0, 1)) for r in got if r.match_id == r.query_id)
    rows = QUERIES["op3_media_copies"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == vectors.count() and {r.id for r in rows if r.found} == asked
    assert all(r.class_id <= r.id for r in rows) and sum(r.n_links for r in rows) == len(got)


def test_op3_copies_classes_and_odd_rows(spark):
    rows = [(i, media.encode_pgm(picture(i))) for i in range(20)]
    rows += [(30, rows[4][1]), (30, rows[4][1]), (31, None), (32, b""), (33, b"no image"), (34, media.encode_pgm(np.zeros((60, 60)))), (None, rows[5][1]), (35, media.encode_pgm(np.ones((4, 4))))]
    images = spark.createDataFrame([(*r, "k") for r in rows], "id bigint, image binary, part string")
    asked = [(100 + i, media.encode_pgm(media.edited(picture(i), i % 4))) for i in range(0, 8)] + [(200, media.encode_pgm(picture(99))), (201, None), (None, rows[1][1])]
    got = media.find_copies(spark.createDataFrame(asked, "id bigint, image binary"), images).collect()
    assert {(r.query_id, r.match_id) for r in got} == {(100 + i, i) for i in range(8)}
    assert {r.match_id: r.class_size for r in got}[4] == 3
    found = spark.createDataFrame([(100, 0), (100, 2), (7, 2), (7, 4)], "query_id bigint, match_id bigint")
    classes = {r.id: (r.class_id, r.n_links, r.found) for r in media.copy_classes(images, found).collect()}
    assert classes[4] == classes[30] == (0, 1, False) and classes[2] == (0, 2, False) and classes[7] == (0, 0, False) and classes[31] == (31, 0, False) and classes[None][0] is None
    assert media.find_copies(images.limit(0), images).count() == 0 and media.find_copies(images, images.limit(0)).count() == 0


def test_op3_vectors_with_nulls(spark):
    v = spark.createDataFrame([(0, [1.0, None, 2.0]), (100, None), (None, [1.0]), (1, [])], "vec_id bigint, embedding array<double>")
    assert media.pictures(v).count() == 4 and media.pictures(v, copies=True).count() == 2


def test_op3_finds_resized_and_noisy_copies(spark):
    """Copies at half and double size, between, and with noise; an image that isn't there is not found."""

    def large(seed):
        spots = media._sum(np.random.default_rng(seed).normal(size=(240, 240)).astype(np.float32), 4)
        return np.clip(128 + 40 * spots / spots.std(), 0, 255).round()

    images = spark.createDataFrame([(i, media.encode_pgm(large(i))) for i in range(12)], "id bigint, image binary")
    rnd, asked = np.random.default_rng(1), {}
    for k, scale in enumerate((0.5, 0.6, 0.8, 1.3, 2.0)):
        for i in (0, 1, 2):
            asked[100 + 10 * k + i] = (i, scale, media.resized(large(i).astype(np.float32), scale))
    for i in (3, 4, 5):
        asked[200 + i] = (i, 1.0, np.clip(large(i) + rnd.normal(0, 6, large(i).shape), 0, 255).round())
    rows = [(q, media.encode_pgm(p)) for q, (_, _, p) in asked.items()] + [(300, media.encode_pgm(large(99)))]
    got = {(r.query_id, r.match_id): r for r in media.find_copies(spark.createDataFrame(rows, "id bigint, image binary"), images).collect()}
    assert set(got) == {(q, i) for q, (i, _, _) in asked.items()}
    assert all(0.8 < got[q, i].scale * scale < 1.25 for q, (i, scale, _) in asked.items())
