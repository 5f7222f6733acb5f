"""Removal of repeated byte strings by column-wise construction of collection suffix arrays.

A byte goes if a string of ``length`` bytes that covers it also starts earlier, in a
smaller doc_id or earlier in the same document.

1. *Cuts* (see :mod:`cytolake.llm.anchors`) bring all occurrences of any such string
   together by an anchor's hash; each cut is at most ``2 * length - anchor`` bytes.
2. Cuts that are equal as a whole are settled at once: all but the first go.
3. What is left are the different cuts of an anchor.  Their first occurrences form a
   collection of short strings whose suffix order is built column by column (BCR, Bauer,
   Cox and Rosone): each round inserts one symbol of every string, from the last one,
   into the collection's Burrows-Wheeler transform and updates the array of common
   prefixes; both are files that are read and rewritten in sequence in each round.
   Suffixes that share ``length`` bytes stand side by side at the end; all but the
   earliest of such a run go.

Bytes of a cut are fetched only for step 3.  Between the steps, packed arrays go through
the shuffle, one row for each batch and destination.

Defined cases: a null text is an empty one; texts shorter than ``length`` lose nothing;
a null doc_id counts as the largest; rows that share a doc_id are ordered by a hash of
their text, and rows that are equal in both are one document with several rows, which
all get the same result; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytolake.llm.anchors import cuts
from cytolake.llm.common import arrow_map, arrow_schema, byte_texts, columns, documents, mix64, numbered, shuffle_parts, staged

#: Bytes in a repeated string, and in an anchor.
LENGTH, ANCHOR = 100, 24
#: Bytes of text that are cut at a time; a longer text is cut in overlapping parts.
CHUNK = 2 << 20
#: Strings in a collection, unless one anchor has more.
COLLECTION = 3000
#: Bytes of packed cuts that a task should get.
TASK_BYTES = 24 << 20

CUT = np.dtype([("anchor", "<u8"), ("content", "<u8"), ("doc", "<i8"), ("tie", "<u8"), ("start", "<u4"), ("size", "u1"), ("at", "u1")])
SPAN = np.dtype([("doc", "<i8"), ("tie", "<u8"), ("start", "<u4"), ("size", "<u4")])
PACKED = "kind int, part int, n bigint, data binary"


def packed(rows: np.ndarray) -> bytes:
    """A structured array, column after column, which compresses better than row after row."""
    return b"".join(np.ascontiguousarray(rows[c]).tobytes() for c in rows.dtype.names)


def unpacked(data: list[bytes], dtype: np.dtype) -> np.ndarray:
    """The rows of several packed arrays."""
    sizes = [len(d) // dtype.itemsize for d in data]
    out, at = np.empty(sum(sizes), dtype), 0
    for d, n in zip(data, sizes):
        offset = 0
        for c in dtype.names:
            kind = dtype[c]
            out[c][at:at + n] = np.frombuffer(d, kind, n, offset)
            offset += kind.itemsize * n
        at += n
    return out


def dealt(rows: np.ndarray, part: np.ndarray, kind: int = 0) -> pa.RecordBatch:
    """One packed row for each destination."""
    order = np.argsort(part, kind="stable")
    rows, part = rows[order], part[order]
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if part.size else np.zeros(0, np.int64)
    last = np.append(first[1:], part.size)
    return pa.record_batch([
        pa.array(np.full(first.size, kind, np.int32)), pa.array(part[first].astype(np.int32)), pa.array(last - first),
        pa.array([packed(rows[i:j]) for i, j in zip(first.tolist(), last.tolist())], pa.binary())], schema=arrow_schema(PACKED))


def _doc_keys(ids: pa.Array, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    doc = np.array([(1 << 63) - 1 if d is None else d for d in ids.to_pylist()], np.int64)
    return doc, np.fromiter(map(xxhash.xxh3_64_intdigest, raw), np.uint64, len(raw))


def _block(doc: np.ndarray, tie: np.ndarray, parts: int) -> np.ndarray:
    return (mix64(doc.astype(np.int64).view(np.uint64) ^ tie) % np.uint64(parts)).astype(np.int32)


def once_more(rows: np.ndarray) -> np.ndarray:
    """Which of some cuts in the order of all these columns are the one before once more, from a repeated row."""
    same = np.append(False, np.ones(max(0, rows.size - 1), bool))[:rows.size]
    for c in ("anchor", "content", "doc", "tie", "start"):
        same[1:] &= rows[c][1:] == rows[c][:-1]
    return same


def later_copies(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which cuts come after another one with the same anchor and content, and which of these are that one itself once
    more, from a repeated row."""
    if not rows.size:
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.argsort(rows["content"])
    c = rows["content"][order]
    same = np.append(c[1:] == c[:-1], False)
    order = order[same | np.append(False, same[:-1])]
    got = rows[order]
    order = order[np.lexsort((got["start"], got["tie"], got["doc"], got["anchor"], got["content"]))]
    got = rows[order]
    later, again = np.zeros(rows.size, bool), np.zeros(rows.size, bool)
    again[order] = once_more(got)
    later[order[1:]] = (got["content"][1:] == got["content"][:-1]) & (got["anchor"][1:] == got["anchor"][:-1])
    return later, again


def spans_of(rows: np.ndarray) -> np.ndarray:
    """The bytes of cuts as spans."""
    spans = np.empty(rows.size, SPAN)
    for c in SPAN.names:
        spans[c] = rows[c]
    return spans


def cut_rows(df: DataFrame, parts: int, length: int, anchor: int) -> DataFrame:
    """Kind 1: cuts, packed, dealt by anchor; kind 0: spans of cuts that the same batch has before, dealt by document.

    So a passage that very many documents hold reaches its anchors' owners once for each batch.
    """

    def run(batches):
        gc.disable()

        def flush(docs, keys):
            a, content, which, start, size, at = cuts([d for d, _ in docs], length, anchor)
            rows = np.empty(a.size, CUT)
            doc, tie = (np.array([k[i] for k in keys], t) for i, t in ((0, np.int64), (1, np.uint64)))
            offset = np.array([o for _, o in docs], np.int64)
            rows["anchor"], rows["content"], rows["doc"], rows["tie"] = a, content, doc[which], tie[which]
            rows["start"], rows["size"], rows["at"] = start + offset[which], size, at
            later, again = later_copies(rows)
            spans, rows = spans_of(rows[later & ~again]), rows[~later]
            if spans.size:
                yield dealt(spans, _block(spans["doc"], spans["tie"], parts), 0)
            yield dealt(rows, (rows["anchor"] >> np.uint64(40)) % np.uint64(parts), 1)

        docs, keys, held = [], [], 0
        for b in batches:
            raw = byte_texts(b.column(1))
            for text, key in zip(raw, zip(*(x.tolist() for x in _doc_keys(b.column(0), raw)))):
                if len(text) < length:
                    continue
                for at in range(0, len(text) - length + 1, CHUNK):
                    docs.append((text[at:at + CHUNK + length - 1], at))
                    keys.append(key)
                    held += len(docs[-1][0])
                    if held >= CHUNK:
                        yield from flush(docs, keys)
                        docs, keys, held = [], [], 0
        if docs:
            yield from flush(docs, keys)

    return arrow_map(df, run, PACKED, rows=500)


def settle_equal_cuts(rows: DataFrame, parts: int) -> DataFrame:
    """Kind 0: spans of cuts that are not the first of their content (those found before pass through); kind 1: the
    first cuts of anchors with several contents."""

    def run(batches):
        data = []
        for b in batches:
            cut = b.column(0).to_numpy() == 1
            if not cut.all():
                yield b.filter(pa.array(~cut))
            data += b.filter(pa.array(cut)).column(3).to_pylist()
        if not data:
            return
        got = unpacked(data, CUT)
        del data
        order = np.argsort(got["anchor"])
        a = got["anchor"][order]
        same = np.append(a[1:] == a[:-1], False)
        several = same | np.append(False, same[:-1])
        got = got[order[several]]
        order = np.lexsort((got["start"], got["tie"], got["doc"], got["content"], got["anchor"]))
        got = got[order]
        got = got[~once_more(got)]
        del order, a, same, several
        if not got.size:
            return
        new_anchor = np.append(True, got["anchor"][1:] != got["anchor"][:-1])
        first = new_anchor | np.append(True, got["content"][1:] != got["content"][:-1])
        spans = spans_of(got[~first])
        yield dealt(spans, _block(spans["doc"], spans["tie"], parts), 0)
        got, group = got[first], (np.cumsum(new_anchor) - 1)[first]
        asked = got[np.bincount(group)[group] > 1]
        yield dealt(asked, _block(asked["doc"], asked["tie"], parts), 1)

    return rows.select("kind", "part", "n", "data").repartitionById(parts, "part").mapInArrow(run, PACKED)


def _with_texts(df: DataFrame, rows: DataFrame, parts: int) -> DataFrame:
    """The packed rows of each block of documents, then the block's documents (``doc_id``, ``text`` and, if there is one, ``rest``)."""
    out = T.StructType([T.StructField("part", T.IntegerType()), *df.schema.fields])

    def block(batches):
        for b in batches:
            doc, tie = _doc_keys(b.column(0), byte_texts(b.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(_block(doc, tie, parts)), *b.columns], ["part", *b.schema.names])

    texts = arrow_map(df, block, out, rows=500).select(F.lit(9).alias("kind"), "part", F.lit(None).cast("binary").alias("data"), *df.columns)
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]
    both = rows.select("kind", "part", "data", *none).unionByName(texts)
    return both.repartitionById(parts, "part").sortWithinPartitions("kind").select("kind", "data", *df.columns)


class _Block:
    """Rows of a block, found by document."""

    def __init__(self, data: list[bytes], dtype: np.dtype):
        rows = unpacked(data, dtype)
        rows = rows[np.lexsort((rows["start"], rows["tie"], rows["doc"]))]
        new = np.flatnonzero(np.append(True, (rows["doc"][1:] != rows["doc"][:-1]) | (rows["tie"][1:] != rows["tie"][:-1]))) if rows.size else np.zeros(0, np.int64)
        self.rows = rows
        self.place = {k: (i, j) for k, i, j in zip(zip(rows["doc"][new].tolist(), rows["tie"][new].tolist()), new.tolist(), np.append(new[1:], rows.size).tolist())}

    def of(self, doc: int, tie: int) -> np.ndarray:
        i, j = self.place.get((doc, tie), (0, 0))
        return self.rows[i:j]


def _block_batches(batches, dtype: np.dtype, rows: int = 200):
    """``block, ids, texts, rest`` of a partition's documents; packed rows come before them."""
    data, block = [], None
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            b = whole.slice(at, rows)
            kind = b.column(0).to_numpy()
            n = int((kind < 9).sum())
            if n:
                data += b.column(1).slice(0, n).to_pylist()
            if n < b.num_rows:
                if block is None:
                    block, data = _Block(data, dtype), None
                b = b.slice(n)
                yield block, b.column(2), byte_texts(b.column(3)), b.columns[4:]


def fetch_strings(df: DataFrame, asked: DataFrame, parts: int) -> DataFrame:
    """The bytes of the cuts that are asked for, dealt by anchor: the packed cuts, followed by their bytes."""
    schema = arrow_schema(PACKED)

    def run(batches):
        done = set()

        def flush(rows, strings):
            rows = np.concatenate(rows)
            part = ((rows["anchor"] >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)
            out = []
            order = np.argsort(part, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(part[order]) != 0))
            for i, j in zip(first.tolist(), np.append(first[1:], order.size).tolist()):
                own = order[i:j]
                out.append((0, int(part[own[0]]), j - i, packed(rows[own]) + b"".join([strings[x] for x in own.tolist()])))
            return pa.record_batch([pa.array([r[i] for r in out], schema.field(i).type) for i in range(4)], schema=schema)

        rows, strings = [], []
        for block, ids, raw, _ in _block_batches(batches, CUT):
            for text, key in zip(raw, zip(*(x.tolist() for x in _doc_keys(ids, raw)))):
                got = block.of(*key)
                if got.size and key not in done:
                    done.add(key)
                    rows.append(got)
                    strings += [text[i:i + n] for i, n in zip(got["start"].tolist(), got["size"].tolist())]
            if len(strings) > 20_000:
                yield flush(rows, strings)
                rows, strings = [], []
        if strings:
            yield flush(rows, strings)

    return _with_texts(df, asked, parts).mapInArrow(run, PACKED)


class ColumnFiles:
    """The collection's transform and common prefixes as two files, read and rewritten in sequence in each round."""

    def __init__(self, bwt: np.ndarray):
        self.kind, self.files, self.n = bwt.dtype, [tempfile.TemporaryFile(buffering=0) for _ in range(2)], 0
        self.write(bwt, np.zeros(bwt.size, np.uint8))

    def write(self, *arrays: np.ndarray) -> None:
        self.n = arrays[0].size
        for f, x in zip(self.files, arrays):
            f.seek(0)
            f.write(x.data)

    def read(self) -> list[np.ndarray]:
        out = []
        for f, kind in zip(self.files, (self.kind, np.dtype(np.uint8))):
            f.seek(0)
            out.append(np.frombuffer(f.read(self.n * kind.itemsize), kind))
        return out

    def __enter__(self):
        return self

    def __exit__(self, *_):
        for f in self.files:
            f.close()


def shared_suffixes(data: np.ndarray, begin: np.ndarray, size: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``string, start, run`` of every suffix of at least ``length`` bytes of a collection of strings (of at most
    255 bytes); suffixes with the same run share their first ``length`` bytes.

    Symbols are the bytes that occur, numbered from one; 0 ends a string.  After round ``j`` the transform covers
    all suffixes of at most ``j`` bytes, in their order; the ends are the first ``m`` of them, in the order of the
    strings.
    """
    m = size.size
    used = np.zeros(256, bool)
    used[data] = True
    number = np.cumsum(used)
    symbols = number.astype(np.uint8 if number[-1] < 256 else np.uint16)[data]
    place = np.arange(m)  # of the string's suffix inserted last
    with ColumnFiles(symbols[begin + size - 1]) as files:
        for j in range(1, int(size.max()) + 1):
            bwt, lcp = files.read()
            n = bwt.size
            by = np.argsort(bwt, kind="stable")  # places by preceding symbol: the order of the suffixes one symbol longer
            rank = np.empty(n, np.int32)
            rank[by] = np.arange(n, dtype=np.int32)
            ends = n - int(np.count_nonzero(bwt))
            active = np.flatnonzero(size >= j)
            k = rank[place[active]].astype(np.int64)  # among all preceding symbols
            symbol = np.where(size[active] > j, symbols[begin[active] + np.maximum(size[active] - j - 1, 0)], 0)
            # Common prefixes of the new suffixes with the one before, and of the one after with them: one more than
            # the least common prefix between the two places that they extend.
            k_sorted = np.sort(k)
            touched = np.sort(np.append(k_sorted, k_sorted[np.append(k_sorted[1:] != k_sorted[:-1] + 1, True)] + 1))
            touched = touched[(touched > ends) & (touched < n)]
            touched = touched[bwt[by[touched]] == bwt[by[touched - 1]]]
            lo, hi = by[touched - 1] + 1, by[touched] + 1
            down = np.argsort(-lo)  # descending, so that reduceat does no work between the ranges
            pairs = np.empty(2 * lo.size, np.int64)
            pairs[0::2], pairs[1::2] = lo[down], hi[down]
            least = np.empty(lo.size, np.uint8)
            if lo.size:
                least[down] = np.minimum.reduceat(np.append(lcp, np.uint8(0)), pairs)[0::2]
            # Insert: a suffix's place counts all that come before it, old and new.
            order = np.argsort(k)
            new = m + k_sorted - ends
            before = new - np.arange(new.size)  # old suffixes before each new one
            old = np.flatnonzero(size < j)
            if old.size:
                place[old] += np.searchsorted(before, place[old], side="right")
            place[active] = m + k - ends
            bwt, lcp = np.insert(bwt, before, symbol[order]), np.insert(lcp, before, 0)
            lcp[m + touched - ends] = np.minimum(least, 254) + 1
            files.write(bwt, lcp)
        bwt, lcp = files.read()
    by = np.argsort(bwt, kind="stable")
    ends = bwt.size - int(np.count_nonzero(bwt))
    run = np.cumsum(lcp < length)
    out, here, string = [], place.copy(), np.arange(m)
    start = 0
    while string.size:
        good = size[string] - start >= length
        string, here = string[good], here[good]
        out.append((string, np.full(string.size, start), run[here]))
        here = by[here - m + ends]  # the suffix without its first symbol
        start += 1
    return tuple(np.concatenate(x) for x in zip(*out))


def may_share(rows: np.ndarray, data: np.ndarray, begin: np.ndarray, length: int, anchor: int) -> np.ndarray:
    """Which cuts can share a string of ``length`` bytes with another of their anchor: a string that does holds
    half of what is around the anchor on its left or on its right side."""
    half = min(32, (length - anchor) // 2 // 8 * 8)
    at, size = rows["at"].astype(np.int64), rows["size"].astype(np.int64)
    keep = np.zeros(rows.size, bool)
    if not half:
        return ~keep
    padded = np.concatenate([np.zeros(half, np.uint8), data, np.zeros(half + anchor, np.uint8)])
    for has, first in ((at >= half, begin + at), (size - at - anchor >= half, begin + at + anchor + half)):
        where = np.flatnonzero(has)
        if not where.size:
            continue
        around = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, half)[first[where]]).view(np.uint64)
        h = rows["anchor"][where].copy()
        for i in range(half // 8):
            h = mix64(h ^ around[:, i])
        _, group, count = np.unique(h, return_inverse=True, return_counts=True)
        keep[where] |= count[group] > 1
    return keep


def settle_shared_strings(strings: DataFrame, parts: int, length: int, anchor: int) -> DataFrame:
    """Spans of the strings of ``length`` bytes inside different cuts of an anchor that are not the first of their kind."""

    def run(batches):
        gc.disable()
        heads, tails = [], []
        for b in batches:
            for n, d in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                heads.append(d[:n * CUT.itemsize])
                tails.append(d[n * CUT.itemsize:])
        if not heads:
            return
        rows, data = unpacked(heads, CUT), np.frombuffer(b"".join(tails), np.uint8)
        del heads, tails
        size = rows["size"].astype(np.int64)
        begin = np.cumsum(size) - size
        keep = may_share(rows, data, begin, length, anchor)
        rows, begin = rows[keep], begin[keep]
        order = np.argsort(rows["anchor"], kind="stable")
        rows, begin = rows[order], begin[order]
        group = np.flatnonzero(np.append(True, rows["anchor"][1:] != rows["anchor"][:-1])) if rows.size else np.zeros(0, np.int64)
        at = 0
        while at < rows.size:
            k = np.searchsorted(group, at + COLLECTION, side="right") - 1  # whole anchors
            to = int(group[k]) if group[k] > at else int(group[k + 1]) if k + 1 < group.size else rows.size
            if at + COLLECTION >= rows.size:
                to = rows.size
            own, first = rows[at:to], begin[at:to]
            at = to
            string, start, same = shared_suffixes(data, first, own["size"].astype(np.int64), length)
            doc, tie, place = own["doc"][string], own["tie"][string], own["start"][string].astype(np.int64) + start
            by = np.lexsort((place, tie, doc, same))
            later = by[1:][same[by[1:]] == same[by[:-1]]]
            spans = np.empty(later.size, SPAN)
            spans["doc"], spans["tie"], spans["start"], spans["size"] = doc[later], tie[later], place[later], length
            # Neighbours in a document that overlap become one span.
            spans = spans[np.lexsort((spans["start"], spans["tie"], spans["doc"]))]
            if spans.size:
                joins = (spans["doc"][1:] == spans["doc"][:-1]) & (spans["tie"][1:] == spans["tie"][:-1]) & (spans["start"][1:] <= spans["start"][:-1] + length)
                head = np.flatnonzero(np.append(True, ~joins))
                tail = np.append(head[1:], spans.size) - 1
                whole = spans[head]
                whole["size"] = spans["start"][tail] + length - whole["start"]
                yield dealt(whole, _block(whole["doc"], whole["tie"], parts), 0)

    return strings.repartitionById(parts, "part").mapInArrow(run, PACKED)


def removed(text: bytes, spans: np.ndarray) -> tuple[bytes, int, int]:
    """What is left of a text, the bytes removed and the number of maximal runs of them."""
    if not spans.size:
        return text, 0, 0
    edge = np.zeros(len(text) + 1, np.int32)
    np.add.at(edge, spans["start"].astype(np.int64), 1)
    np.add.at(edge, spans["start"].astype(np.int64) + spans["size"], -1)
    gone = np.cumsum(edge[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def _spans(df: DataFrame, length: int, anchor: int) -> tuple[DataFrame, int]:
    """All spans to remove, packed by block of documents, and the number of blocks."""
    spark = df.sparkSession
    total = df.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    density = 2 * CUT.itemsize / (length - anchor + 2)
    parts = max(shuffle_parts(spark), int(total * density / TASK_BYTES))
    settled = staged(settle_equal_cuts(cut_rows(df, parts, length, anchor), parts), "cuts")
    strings = fetch_strings(df, settled.where("kind = 1"), parts)
    shared = staged(settle_shared_strings(strings, parts, length, anchor), "shared")
    return settled.where("kind = 0").unionByName(shared), parts


REMOVED = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
DIGEST = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def remove_repeats(df: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, digest: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` of every row, ``kept`` being the bytes that stay (or, with
    ``digest``, their SHA-256 as ``kept_sha256``)."""
    df = columns(df, doc_id="bigint", text="string")
    spans, parts = _spans(df, length, anchor)
    ddl = DIGEST if digest else REMOVED
    schema = arrow_schema(ddl)

    def run(batches):
        for block, ids, raw, _ in _block_batches(batches, SPAN):
            out = []
            for text, key in zip(raw, zip(*(x.tolist() for x in _doc_keys(ids, raw)))):
                kept, gone, runs = removed(text, block.of(*key))
                out.append((len(text), gone, runs, hashlib.sha256(kept).hexdigest() if digest else kept))
            yield pa.record_batch([ids, *(pa.array([r[i] for r in out], schema.field(i + 1).type) for i in range(4))], schema=schema)

    return _with_texts(df, spans, parts).mapInArrow(run, ddl)


def without_repeats(df: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """The rows with all their columns, ``text`` without its repeated strings. A character of which a part goes, goes."""
    plain, at = numbered(df)
    others = [c for c in plain.columns if c not in (at["doc_id"], at["text"])]
    held = plain.select(F.col(at["doc_id"]).cast("bigint").alias("doc_id"), F.col(at["text"]).cast("string").alias("text"), F.struct(*others, F.lit(0).alias("none")).alias("rest"))
    spans, parts = _spans(held.select("doc_id", "text"), length, anchor)

    def run(batches):
        for block, ids, raw, rest in _block_batches(batches, SPAN):
            keys = zip(*(x.tolist() for x in _doc_keys(ids, raw)))
            kept = [removed(text, block.of(*key))[0].decode("utf-8", "ignore") for text, key in zip(raw, keys)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(kept, pa.string()), *rest], ["doc_id", "text", "rest"])

    out = _with_texts(held, spans, parts).mapInArrow(run, held.schema)
    own = {at["doc_id"]: "doc_id", at["text"]: "text"}
    return out.select(*[F.col(own.get(f.name, f"rest.{f.name}")).cast(f.dataType) for f in plain.schema]).toDF(*df.columns)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), digest=True)
