"""Copies of images, cropped or edited, by local descriptors.

Images are binary columns in PNG (of any kind) or portable grey or pixel maps. (There is no
decoder of JPEG here: such images are unreadable.)
At four scales an octave, as many octaves as the image has, corners (Harris) are found; around each, the direction to the centre
of intensity turns a fixed set of binary intensity tests, whose outcomes are the
descriptor (``BITS`` bits).  The first ``INDEXED`` of them are split into ``TABLES`` parts; descriptors
of which at most ``2 * TABLES - 1`` of these differ have a part with at most one, and meet there
in an equi-join, as queries are looked up by each part and by all that differ from it in one bit; a pair that meets in several
is taken in the first.  Each pair of descriptors within ``MOST_BITS`` bits votes for the movement
(turn, scale, shift) that takes one corner to the other; an image is a match if enough
corners of the query agree on one movement.  Votes are counted by aggregation, so no
image's candidates are gathered; a bin holds at most the corners of one query.

Equal images (of one SHA-256) are one class, searched once; matches name the class by its
smallest id and its size.  The search is a stated query set against all rows.

Defined cases: null, empty and unreadable images, and those too small or flat for
corners, have no descriptors and no match; repeated rows are one class; a null id can't
be named, so such rows aren't searched; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cytolake.llm.common import arrow_map, arrow_schema, columns, staged, table
from cytolake.llm.components import connected_components

#: Scales in an octave, radius of a descriptor's patch, tests in it, those in the tables, parts of these, differing bits of a match.
STEPS, RADIUS, BITS, INDEXED, TABLES, MOST_BITS = 4, 13, 256, 120, 5, 34
#: Corners closer than this are one; share of the image's strongest response that a corner needs.
APART, LEAST_RESPONSE = 4, 0.02
#: Turns in a circle, side of a bin of shifts in pixels, corners that must agree.
TURNS, SHIFT, AGREE = 32, 8.0, 5

_R = np.random.default_rng(20)
_TESTS = np.clip(np.round(_R.normal(0, RADIUS / 2.2, (BITS, 2, 2))), -RADIUS + 4, RADIUS - 4)
_ANGLES = np.arange(TURNS) * 2 * np.pi / TURNS
#: Offsets (dy, dx) of both points of each test, for each turn.
_TURNED = np.stack([np.round(_TESTS @ np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]])) for a in _ANGLES]).astype(np.int64)
_DISC = np.array([(dy, dx) for dy in range(-7, 8) for dx in range(-7, 8) if dy * dy + dx * dx <= 49])


def encode_pgm(pixels: np.ndarray) -> bytes:
    """A portable grey map of an array of bytes."""
    return b"P5 %d %d 255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.astype(np.uint8).tobytes()


def _unfiltered(raw: np.ndarray, unit: int) -> np.ndarray:
    """The bytes of a PNG's lines, each of which begins with the number of its filter; ``unit`` bytes make a pixel.

    A byte needs those to its left, above it and between, so all that lie on one diagonal are done together.
    """
    kind, h = raw[:, :1].astype(np.int16), len(raw)
    data = raw[:, 1:].reshape(h, -1, unit).astype(np.int16)
    m = data.shape[1]
    if kind.max(initial=0) > 4:
        raise ValueError("an unknown filter")
    out = np.zeros((h + 1, m + 1, unit), np.int16)  # with a line and a pixel of zeros before
    for t in range(h + m - 1):
        y = np.arange(max(0, t - m + 1), min(h, t + 1))
        x, k = t - y, kind[y]
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        p = left + up - corner
        pl, pu, pc = np.abs(p - left), np.abs(p - up), np.abs(p - corner)
        near = np.where((pl <= pu) & (pl <= pc), left, np.where(pu <= pc, up, corner))
        add = np.choose(k, [0, left, up, (left + up) >> 1, near])
        out[y + 1, x + 1] = (data[y, x] + add) & 255
    return out[1:, 1:].reshape(h, -1).astype(np.uint8)


#: First column and row, and steps, of the seven passes of an interlaced PNG.
_PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]


def _png(data: bytes) -> np.ndarray:
    at, packed, palette = 8, [], None
    while at + 8 <= len(data):
        size, name = int.from_bytes(data[at:at + 4], "big"), data[at + 4:at + 8]
        body = data[at + 8:at + 8 + size]
        if name == b"IHDR":
            width, height = int.from_bytes(body[:4], "big"), int.from_bytes(body[4:8], "big")
            bits, colour, interlaced = body[8], body[9], body[12]
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(float).mean(axis=1)
        elif name == b"IDAT":
            packed.append(body)
        at += 12 + size
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    raw, at = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8), 0
    values = np.zeros((height, width, channels), np.float32)
    for x0, y0, dx, dy in _PASSES if interlaced else [(0, 0, 1, 1)]:
        w, h = -(-(width - x0) // dx), -(-(height - y0) // dy)
        if w <= 0 or h <= 0:
            continue
        line = 1 + -(-w * channels * bits // 8)
        rows = _unfiltered(raw[at:at + h * line].reshape(h, line), max(1, channels * bits // 8))
        at += h * line
        if bits == 16:
            rows = rows.reshape(h, -1, 2).astype(np.float32) @ np.array([256, 1], np.float32)
        elif bits < 8:
            rows = np.unpackbits(rows, axis=1).reshape(h, -1, bits) @ (1 << np.arange(bits)[::-1])
        values[y0::dy, x0::dx] = rows[:, :w * channels].reshape(h, w, channels)
    if colour == 3:
        return palette[values[:, :, 0].astype(int)]
    values *= 255 / ((1 << bits) - 1)
    return values[:, :, :3].mean(axis=2) if channels >= 3 else values[:, :, 0]


def _portable(data: bytes) -> np.ndarray | None:
    """A portable grey or pixel map, as text or bytes, of up to 16 bits; comments stand anywhere in its head."""
    head, at = [], 0
    while len(head) < 4:
        m = _HEAD.match(data, at)
        head.append(m[1])
        at = m.end(1)
    kind, width, height, most = head[0], *map(int, head[1:])
    if kind not in (b"P2", b"P3", b"P5", b"P6") or not 0 < most < 1 << 16:
        return None
    shape = (height, width) + ((3,) if kind in (b"P3", b"P6") else ())
    n = int(np.prod(shape))
    if kind in (b"P2", b"P3"):
        pixels = np.array(data[at:].split()[:n], np.float32).reshape(shape)
    else:
        pixels = np.frombuffer(data, np.uint8 if most < 256 else ">u2", n, at + 1).reshape(shape).astype(np.float32)
    pixels = pixels * np.float32(255 / most) if most != 255 else pixels
    return pixels.mean(axis=2) if pixels.ndim == 3 else pixels


_HEAD = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


def decode(data: bytes | None) -> np.ndarray | None:
    """The grey values (0 to 255) of an image, or None."""
    try:
        if not data:
            return None
        return _png(data).astype(np.float32) if data[:8] == b"\x89PNG\r\n\x1a\n" else _portable(data)
    except (ValueError, TypeError, zlib.error, KeyError, IndexError, UnboundLocalError):
        return None


def resized(x: np.ndarray, scale: float) -> np.ndarray:
    """Images (the last two axes) by bilinear interpolation."""
    h, w = max(1, int(x.shape[-2] * scale)), max(1, int(x.shape[-1] * scale))
    y, z = (np.clip((np.arange(n) + 0.5) / scale - 0.5, 0, m - 1) for n, m in ((h, x.shape[-2]), (w, x.shape[-1])))
    y0, z0 = y.astype(int), z.astype(int)
    y1, z1 = np.minimum(y0 + 1, x.shape[-2] - 1), np.minimum(z0 + 1, x.shape[-1] - 1)
    fy, fz = (y - y0)[:, None].astype(np.float32), (z - z0).astype(np.float32)
    top = x[..., y0, :][..., z0] * (1 - fz) + x[..., y0, :][..., z1] * fz
    low = x[..., y1, :][..., z0] * (1 - fz) + x[..., y1, :][..., z1] * fz
    return top * (1 - fy) + low * fy


def _sum(x: np.ndarray, r: int) -> np.ndarray:
    """Sums over squares of radius ``r``; edges are repeated."""
    for axis in (-2, -1):
        pad = [(0, 0)] * x.ndim
        pad[axis] = (r + 1, r)
        c = np.cumsum(np.pad(x, pad, mode="edge"), axis=axis, dtype=np.float64)
        n = c.shape[axis]
        x = (np.take(c, range(2 * r + 1, n), axis=axis) - np.take(c, range(0, n - 2 * r - 1), axis=axis)).astype(np.float32)
    return x


def corners(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Image, row and column of the corners of a stack of images of one size."""
    gy, gx = np.gradient(x, axis=-2), np.gradient(x, axis=-1)
    a, b, c = _sum(gx * gx, 2), _sum(gy * gy, 2), _sum(gx * gy, 2)
    response = a * b - c * c - 0.05 * (a + b) ** 2
    top = response
    for axis in (-2, -1):  # largest within APART
        best = top
        for d in range(1, APART + 1):
            for s in (-d, d):
                moved = np.roll(top, s, axis=axis)
                best = np.maximum(best, moved)
        top = best
    keep = (response >= top) & (response > LEAST_RESPONSE * response.max(axis=(-2, -1), keepdims=True)) & (response > 1)
    edge = RADIUS + 1
    keep[..., :edge, :] = keep[..., -edge:, :] = keep[..., :edge] = keep[..., -edge:] = False
    return np.nonzero(keep)


def descriptors(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """``image, x, y, scale number, turn, bits`` of a stack of images of one size; places are in whole-size pixels."""
    out = []
    for level in range(STEPS * max(x.shape).bit_length()):
        scale = 2.0 ** (-level / STEPS)
        if level and level % STEPS == 0:
            x = resized(x, 0.5)  # means of four pixels
        s = resized(x, 2.0 ** (-(level % STEPS) / STEPS)) if level % STEPS else x
        if min(s.shape[-2:]) < 2 * RADIUS + 4:
            break
        smooth = _sum(s, 1) / 9
        i, y, z = corners(smooth)
        if not i.size:
            continue
        wide = _sum(smooth, 1) / 9
        disc = smooth[i[:, None], y[:, None] + _DISC[:, 0], z[:, None] + _DISC[:, 1]]
        angle = np.arctan2((disc * _DISC[:, 0]).sum(axis=1), (disc * _DISC[:, 1]).sum(axis=1))
        turn = np.round(angle / (2 * np.pi / TURNS)).astype(np.int64) % TURNS
        spots = _TURNED[turn]  # corner, test, point, (dy, dx)
        v = wide[i[:, None, None], y[:, None, None] + spots[..., 0], z[:, None, None] + spots[..., 1]]
        out.append((i, (z + 0.5) / scale, (y + 0.5) / scale, np.full(i.size, level), turn, np.packbits(v[:, :, 0] < v[:, :, 1], axis=1)))
    if not out:
        return tuple(np.zeros((0, BITS // 8) if k == 5 else 0, t) for k, t in enumerate((int, float, float, int, int, np.uint8)))
    return tuple(np.concatenate(c) for c in zip(*out))


CORNER = "struct<corner:int,x:double,y:double,level:int,turn:int,keys:array<int>,words:array<bigint>>"
SEEN = f"id bigint, digest binary, corners array<{CORNER}>"
#: Pixels that are described together; a larger image is described alone.
PIXELS = 1 << 19


def scanned(df: DataFrame) -> DataFrame:
    """``id, digest, corners`` of every image (``id``, ``image``): its SHA-256, and the descriptors of the first of its bytes in a task."""
    schema = arrow_schema(SEEN)

    def stacks(batch):
        """Rows of a batch whose images are described together: of one size, and not too many pixels."""
        open_: dict[tuple, list] = {}
        for k, image in batch:
            if image is None or not min(image.shape):
                continue
            own = open_.setdefault(image.shape, [])
            if own and (len(own) + 1) * image.size > PIXELS:
                yield own
                own = open_[image.shape] = []
            own.append((k, image))
        yield from filter(None, open_.values())

    def run(batches):
        done: set[bytes] = set()
        for b in batches:
            raw = b.column(1).to_pylist()
            digests = [None if x is None else hashlib.sha256(x).digest() for x in raw]
            first = [k for k, d in enumerate(digests) if d is not None and not (d in done or done.add(d))]
            corners = [None] * len(raw)
            for own in stacks((k, decode(raw[k])) for k in first):
                i, *columns_ = descriptors(np.stack([x for _, x in own]))
                order = np.argsort(i, kind="stable")
                edge = np.searchsorted(i[order], np.arange(len(own) + 1))
                bits = np.ascontiguousarray(columns_[4][order])
                parts = bits[:, :INDEXED // 8].reshape(len(bits), TABLES, INDEXED // 8 // TABLES).astype(np.int64) @ (256 ** np.arange(INDEXED // 8 // TABLES)[::-1])
                rows = list(zip(*(c[order].tolist() for c in columns_[:4]), parts.tolist(), bits.view(np.int64).reshape(len(bits), BITS // 64).tolist()))
                for (k, _), at, to in zip(own, edge, edge[1:]):
                    corners[k] = [dict(zip(("corner", "x", "y", "level", "turn", "keys", "words"), (n, *r))) for n, r in enumerate(rows[at:to])]
            yield pa.record_batch([b.column(0), pa.array(digests, pa.binary()), pa.array(corners, schema.field(2).type)], schema=schema)

    return arrow_map(df.select("id", "image"), run, SEEN, rows=64)


def image_classes(seen: DataFrame) -> DataFrame:
    """``digest, id, class_size, corners``: byte-equal images once, with the smallest id and the descriptors."""
    return seen.where("digest is not null and id is not null").groupBy("digest").agg(
        F.min("id").alias("id"), F.count("*").alias("class_size"), F.min_by("corners", F.when(F.col("corners").isNotNull(), F.col("id"))).alias("corners"))


def described(classes: DataFrame) -> DataFrame:
    """One row for each descriptor of each class."""
    return classes.select("id", F.inline("corners"))


def _parts(described: DataFrame, prefix: str, neighbours: bool = False) -> DataFrame:
    """One row for each part of a descriptor: ``part`` and its ``key``; with ``neighbours`` also for each key one bit away."""
    flips = [0, *(1 << k for k in range(INDEXED // TABLES))] if neighbours else [0]
    named = [F.col(c).alias(f"{prefix}_{c}") for c in described.columns if c != "keys"]
    rows = described.select(F.posexplode("keys").alias("part", "key"), *named).withColumn("flip", F.explode(F.array(*map(F.lit, flips))))
    return rows.withColumn("key", F.col("key").bitwiseXOR(F.col("flip"))).drop("flip")


def difference() -> Column:
    """The number of different bits of a query's and an image's descriptor."""
    return sum((F.bit_count(F.col("q_words")[i].bitwiseXOR(F.col("m_words")[i])) for i in range(BITS // 64)), F.lit(0))


def _word_masks(part: int) -> list[int]:
    """The bits of a part of the tables in each word of a descriptor, as signed numbers."""
    bits = ((1 << INDEXED // TABLES) - 1) << (part * (INDEXED // TABLES))
    words = [(bits >> (64 * i)) & ((1 << 64) - 1) for i in range(BITS // 64)]
    return [w - (1 << 64) if w >> 63 else w for w in words]


def met(left: DataFrame, right: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """The pairs of a query's and an image's descriptors (see :func:`_parts`) within ``most_bits`` that meet in a table, each once:
    in the first part of which at most one bit differs."""
    once = F.lit(True)
    for p in range(TABLES - 1):
        apart = sum((F.bit_count(F.col("q_words")[i].bitwiseXOR(F.col("m_words")[i]).bitwiseAND(F.lit(m))) for i, m in enumerate(_word_masks(p)) if m), F.lit(0))
        once &= (F.col("part") <= p) | (apart > 1)
    # Neither side has a size bound: nothing is broadcast.
    return left.hint("merge").join(right.hint("merge"), ["part", "key"]).where((difference() <= most_bits) & once)


def movements(votes: DataFrame) -> DataFrame:
    """``q_id, m_id, s, n, t`` of each bin of movements: the distinct corners of a query that vote for it, and the least turn.

    Bins overlap by half in the shifts and the turn, so that votes near a bin's edge meet in the next one. Votes are first
    gathered in cells of half a bin's sides, as sets of corners; eight bins hold a cell.
    """
    step = lambda c: F.floor(F.col(c) * (2 / SHIFT))
    cells = votes.groupBy("q_id", "m_id", "s", F.floor(F.col("t") / 2).alias("tc"), step("dx").alias("xc"), step("dy").alias("yc")).agg(F.collect_set("q_corner").alias("corners"), F.min("t").alias("t"))
    cells = cells.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(7))))
    bin_ = lambda c, bit: F.floor((F.col(c) + F.shiftright("o", bit).bitwiseAND(F.lit(1))) / 2)
    return cells.groupBy("q_id", "m_id", "s", "o", F.pmod(bin_("tc", 2), F.lit(TURNS // 4)).alias("tb"), bin_("xc", 0).alias("xb"), bin_("yc", 1).alias("yb")).agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("corners")))).alias("n"), F.min("t").alias("t"))


def find_copies(queries: DataFrame, images: DataFrame, most_bits: int = MOST_BITS, agree: int = AGREE) -> DataFrame:
    """``query_id, match_id, class_size, n_corners, turn, scale`` of the images that a query is a copy of, or they of it.

    ``n_corners`` corners of the query agree on the movement. Both tables have ``id`` and ``image``.
    """
    queries, images = (columns(d, id="bigint", image="binary").where("id is not null") for d in (queries, images))
    classes = staged(image_classes(scanned(images)), "images")
    seen = staged(scanned(queries), "queries")
    asked = staged(image_classes(seen), "asked")
    left, right = _parts(described(asked), "q", True), _parts(described(classes), "m")
    near = met(left, right, most_bits)
    turn = (F.col("m_turn") - F.col("q_turn") + TURNS) % TURNS
    finer = F.col("m_level") - F.col("q_level")
    scale = F.pow(F.lit(2.0), finer / STEPS)
    a = turn * F.lit(2 * np.pi / TURNS)
    dx = F.col("m_x") - scale * (F.cos(a) * F.col("q_x") - F.sin(a) * F.col("q_y"))
    dy = F.col("m_y") - scale * (F.sin(a) * F.col("q_x") + F.cos(a) * F.col("q_y"))
    votes = near.select("q_id", "m_id", "q_corner", turn.alias("t"), finer.alias("s"), dx.alias("dx"), dy.alias("dy"))
    bins = movements(votes)
    best = bins.where(F.col("n") >= agree).groupBy("q_id", "m_id").agg(F.max(F.struct("n", (-F.col("t")).alias("back"), "s")).alias("b"))
    found = best.select("q_id", F.col("m_id").alias("match_id"), F.col("b.n").alias("n_corners"), (-F.col("b.back")).alias("turn"), F.pow(F.lit(2.0), F.col("b.s") / STEPS).alias("scale"))
    found = found.join(classes.select(F.col("id").alias("match_id"), "class_size"), "match_id").join(asked.select(F.col("id").alias("q_id"), "digest"), "q_id")
    found = found.join(seen.select("digest", F.col("id").alias("query_id")).distinct(), "digest")
    return found.select("query_id", "match_id", "class_size", "n_corners", "turn", "scale")


def render(vector: np.ndarray, size: int = 80, grid: int = 16) -> np.ndarray:
    """A picture of a vector: a mosaic whose tiles mix its numbers."""
    v = np.nan_to_num(np.asarray(vector, np.float64).ravel())
    v = v if v.size else np.zeros(1)
    k = np.arange(grid * grid)
    tiles = v[k % v.size] * np.cos(k) + v[(k * 7 + 3) % v.size] * np.sin(k * 1.7)
    spread = tiles.std()
    tiles = np.clip(128 + 50 * (tiles - tiles.mean()) / (spread if spread > 0 else 1), 0, 255).reshape(grid, grid)
    return np.repeat(np.repeat(tiles, size // grid, axis=0), size // grid, axis=1).round()


def edited(picture: np.ndarray, kind: int) -> np.ndarray:
    """A copy: cropped, changed in brightness and contrast, turned and cropped, or cropped and dimmed with a frame."""
    if kind == 0:
        return picture[6:, 9:]
    if kind == 1:
        return np.clip(picture * 0.8 + 20, 0, 255).round()
    if kind == 2:
        return np.rot90(picture)[:, 5:]
    return np.pad(np.clip(picture[4:, :-7] * 0.7, 0, 255).round(), 6, constant_values=90)


def pictures(vectors: DataFrame, copies: bool = False) -> DataFrame:
    """``id, image`` of a table of vectors; with ``copies``, edited ones of the rows whose id is divisible by 100."""
    schema = arrow_schema("id bigint, image binary")

    def run(batches):
        for b in batches:
            ids, out = b.column(0).to_pylist(), []
            for i, v in zip(ids, b.column(1).to_pylist()):
                if v is None:
                    out.append(None)
                    continue
                p = render(np.array([np.nan if x is None else x for x in v], float))
                out.append(encode_pgm(edited(p, i // 100 % 4) if copies else p))
            yield pa.record_batch([b.column(0), pa.array(out, pa.binary())], schema=schema)

    rows = columns(vectors, vec_id="bigint", embedding="array<double>")
    return arrow_map(rows.where("vec_id % 100 = 0") if copies else rows, run, "id bigint, image binary")


def copy_classes(images: DataFrame, found: DataFrame) -> DataFrame:
    """``id, class_id, n_links, found`` of every image: its class under the links of a search, the class's smallest id
    standing for it, the number of queries that it is a match of, and whether the query of its own id (if there is one)
    found it. Linear in the images however large a class is.

    ``found`` comes from :func:`find_copies`, a query's id being that of the image that it was made from. Byte-equal
    images have the class of their representative; a null id has no class.
    """
    images = columns(images, id="bigint", image="binary").select("id", F.sha2("image", 256).alias("digest"))
    links = found.groupBy(F.col("match_id").alias("first")).agg(F.count("*").alias("n_links"), F.max(F.col("query_id") == F.col("match_id")).alias("found"))
    same = images.where("id is not null and digest is not null").groupBy("digest").agg(F.min("id").alias("first"))
    member = staged(images.join(same, "digest", "left").select("id", F.coalesce("first", "id").alias("first")), "members")
    edges = found.select("query_id", "match_id").unionByName(member.where("id is not null").select(F.col("id").alias("query_id"), F.col("first").alias("match_id")))
    classes = connected_components(edges)
    rows = member.join(classes, F.col("id") == F.col("node"), "left").join(links, "first", "left")
    return rows.select("id", F.coalesce("component", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("found", F.lit(False)).alias("found"))


def op3_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no pictures, so each vector is drawn as one; edited copies of every hundredth are searched among all."""
    vectors = table(spark, sf_dir, "embeddings")
    images = staged(pictures(vectors), "pictures")
    return copy_classes(images, staged(find_copies(pictures(vectors, copies=True), images), "found"))
