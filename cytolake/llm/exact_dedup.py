"""Exact deduplication through an extendible-hash index on shared files.

The scan writes one entry per row to the shared folder, and one per different text of a
task: the text's bytes, a 64-bit key (the first bits of its digest), how many of the task's rows have it
and which of them is to stay.  Equal texts within a task are found by comparing bytes.  A directory of
``2**depth`` slots maps a key's leading bits to buckets; it is doubled, as deep as it
takes, until no bucket holds more than ``capacity`` different keys.  Owner tasks, each
with a range of buckets, read their texts in key order, chain those whose keys collide
and compare their bytes.  They write the index: for each text of each task its bucket, key and place in
the chain, which are its group, with the group's size and the row that stays.  The rows look their groups up there.

What reaches an owner is one row for each text and scan task, so a group with a third of
all rows costs an owner no more than a few rows, and rows look up the text that their own task sent, so that
no key of that join has more rows than a task.  Different texts with one digest are
different groups.

Defined cases: a null text is an empty text; empty texts (and texts of only white
space) equal each other; repeated rows are members like any other, and one of them
stays; among equal code point counts the smallest doc_id stays and a null doc_id counts as the largest; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytolake.llm.common import ASCII_SPACE, arrow_map, arrow_schema, byte_texts, columns, documents, numbered, shuffle_parts, staged

#: A row (kind 0), or a text of a scan task (kind 1): its ``n`` rows, of which the given one is to stay. ``first`` names the task's text.
ENTRY = "kind int, row bigint, doc_id bigint, n_chars bigint, key bigint, digest binary, first bigint, n bigint, body binary"
INDEX = "bucket int, key bigint, chain int, first bigint, keep_row bigint, keep_id bigint, group_size bigint"
#: Bytes of texts that a scan task remembers, so as not to send copies within the task.
REMEMBERED = 32 << 20
#: Different keys in a bucket before it is split, unless buckets would be more than so many for each owner.
CAPACITY, BUCKETS = 1 << 12, 64
#: Bits of a key by which its text is dealt to an owner, at most.
DEALT_BITS = 16


def sha256(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()


def _order(n_chars: int, doc_id: int | None, row: int) -> tuple:
    """The row that stays is the least: the longest, then that with the smallest doc_id."""
    return -n_chars, doc_id is None, doc_id or 0, row


def entries(df: DataFrame, remembered: int = REMEMBERED, digest: Callable[[bytes], bytes] = sha256) -> DataFrame:
    """The entries of all rows and of the different texts of each task (a text that was forgotten meanwhile is sent again)."""
    schema = arrow_schema(ENTRY)

    def scan(batches):
        seen: OrderedDict[bytes, list] = OrderedDict()  # digest: first row, text, rows, the one that stays
        held, row = 0, TaskContext.get().partitionId() << 40

        def sent(texts_):
            rows = [(1, best[3], None if best[1] else best[2], -best[0], int.from_bytes(d[:8], "big", signed=True), d, first, n, text) for d, (first, text, n, best) in texts_]
            return pa.record_batch([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

        for b in batches:
            number, key, digests, firsts, out = [], [], [], [], []
            for doc_id, raw in zip(b.column(0).to_pylist(), byte_texts(b.column(1))):
                n = len(raw) if raw.isascii() else len(raw.decode())
                norm = raw.translate(None, ASCII_SPACE)
                d, order = digest(norm), _order(n, doc_id, row)
                same = seen.get(d)
                if same is not None and same[1] == norm:
                    same[2] += 1
                    same[3] = min(same[3], order)
                else:
                    if same is not None:
                        out.append((d, same))
                        held -= len(same[1]) + 100
                    same = seen[d] = [row, norm, 1, order]
                    held += len(norm) + 100
                    while held > remembered and len(seen) > 1:
                        out.append(seen.popitem(last=False))
                        held -= len(out[-1][1][1]) + 100
                number.append(n)
                key.append(int.from_bytes(d[:8], "big", signed=True))
                digests.append(d)
                firsts.append(same[0])
                row += 1
            m = b.num_rows
            yield pa.record_batch([
                pa.array(np.zeros(m, np.int32)), pa.array(np.arange(row - m, row)), b.column(0), pa.array(number, pa.int64()), pa.array(key, pa.int64()),
                pa.array(digests, pa.binary()), pa.array(firsts, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary())], schema=schema)
            if out:
                yield sent(out)
        rest = list(seen.items())
        seen.clear()
        for at in range(0, len(rest), 1000):
            yield sent(rest[at:at + 1000])

    return arrow_map(columns(df, doc_id="bigint", text="string"), scan, ENTRY)


def split_directory(counts: dict[int, int], capacity: int, bits: int = 16) -> tuple[int, list[int]]:
    """Global depth and the bucket of each slot, from the number of keys under each prefix of ``bits`` bits.

    Starts with one slot and one bucket.  Splitting an overfull bucket whose local depth
    is the global depth doubles the directory, as in the classic scheme.
    """
    tree = [np.zeros(1 << bits, np.int64)]
    for prefix, n in counts.items():
        tree[0][prefix] = n
    for _ in range(bits):
        tree.append(tree[-1].reshape(-1, 2).sum(axis=1))
    tree.reverse()  # tree[d][p]: keys whose first d bits are p
    depth, slots, buckets = 0, [0], [(0, 0)]  # a bucket is (local depth, prefix)
    todo = [0]
    while todo:
        k = todo.pop()
        local, prefix = buckets[k]
        if local == bits or tree[local][prefix] <= capacity:
            continue
        if local == depth:
            slots = [b for b in slots for _ in (0, 1)]
            depth += 1
        buckets[k] = (local + 1, prefix * 2)
        buckets.append((local + 1, prefix * 2 + 1))
        width = 1 << (depth - local - 1)
        first = (prefix * 2 + 1) * width
        slots[first:first + width] = [len(buckets) - 1] * width
        todo += [k, len(buckets) - 1]
    order = {b: i for i, b in enumerate(dict.fromkeys(slots))}  # numbered along the key range
    return depth, [order[b] for b in slots]


def directory(keys: DataFrame, owners: int, capacity: int = CAPACITY) -> tuple[int, list[int]]:
    """The directory for a table of different keys. At most eight counts for each ``capacity`` keys, and so for each of
    ``BUCKETS`` buckets of an owner, come to the driver; if a bucket has to be split deeper than they go, they are taken
    again with more bits."""
    n = keys.count()
    capacity = max(capacity, n // (BUCKETS * owners))
    bits = (n // capacity).bit_length() + 2
    while True:
        prefix = F.shiftrightunsigned("key", 64 - bits).alias("prefix")
        counts = {r.prefix: r.n for r in keys.groupBy(prefix).agg(F.count("*").alias("n")).collect()}
        if max(counts.values(), default=0) <= capacity:
            return split_directory(counts, capacity, bits)
        bits += 4


def owner_of(depth: int, slots: list[int], owners: int):
    """The owner of ``key`` as a column: owner ``i`` has the ``i``-th run of buckets, cut where the first ``DEALT_BITS`` bits change."""
    bits = min(depth, DEALT_BITS)
    if bits == 0:
        return F.lit(0)
    dealt = [b * owners // (slots[-1] + 1) for b in slots[::1 << (depth - bits)]]
    literal = F.from_json(F.lit("[" + ",".join(map(str, dealt)) + "]"), "array<int>")
    return F.get(literal, F.shiftrightunsigned("key", 64 - bits).cast("int"))


def own(texts_: DataFrame, depth: int, slots: list[int]) -> DataFrame:
    """Owner tasks: texts sorted by key. Chain the different texts of a key, comparing bytes, and add up each one's rows."""
    schema = arrow_schema(INDEX)
    held = texts_.sparkSession.sparkContext.broadcast(np.array(slots, np.int32))

    def owner(batches):
        slot = held.value
        key, chain = None, []  # of a key's different texts: bytes, the tasks' names of it, rows, the one that stays

        def entries_of():
            bucket = int(slot[(key & 0xFFFFFFFFFFFFFFFF) >> (64 - depth)]) if depth else 0
            return [(bucket, key, i, first, best[3], None if best[1] else best[2], n) for i, (_, firsts, n, best) in enumerate(chain) for first in firsts]

        def written(rows):
            return pa.record_batch([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

        rows = []
        for b in batches:
            for k, first, n, row, doc_id, n_chars, body in zip(*(c.to_pylist() for c in b.columns)):
                if k != key:
                    if chain:
                        rows += entries_of()
                    key, chain = k, []
                order = _order(n_chars, doc_id, row)
                for x in chain:
                    if x[0] == body:
                        x[1].append(first)
                        x[2] += n
                        x[3] = min(x[3], order)
                        break
                else:
                    chain.append([body, [first], n, order])
            if len(rows) >= 1000:
                yield written(rows)
                rows = []
        if chain:
            rows += entries_of()
        if rows:
            yield written(rows)

    return arrow_map(texts_, owner, INDEX)


def exact_dedup(df: DataFrame, capacity: int = CAPACITY, remembered: int = REMEMBERED, digest: Callable[[bytes], bytes] = sha256) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row; see the module's text for its cases."""
    spark = df.sparkSession
    entry = staged(entries(df, remembered, digest), "hash-entries")
    sent = entry.where("kind = 1")
    n = shuffle_parts(spark)
    depth, slots = directory(sent.select("key").distinct(), n, capacity)
    n = min(n, slots[-1] + 1)
    dealt = sent.select("key", "first", "n", "row", "doc_id", "n_chars", "body", owner_of(depth, slots, n).alias("owner"))
    dealt = dealt.repartitionById(n, "owner").sortWithinPartitions("key", "first").drop("owner")
    index = staged(own(dealt, depth, slots), "hash-index")
    rows = entry.where("kind = 0").select("row", "doc_id", "digest", "first").join(index.select("first", "keep_row", "keep_id", "group_size"), "first")
    return rows.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def without_copies(df: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns."""
    plain, at = numbered(df)
    doc, text = at["doc_id"], F.coalesce(F.col(at["text"]).cast("string"), F.lit(""))
    # Rows that share the id of the one that stays are told apart by their text.
    kept = exact_dedup(df).where("doc_id <=> keep_id").groupBy(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha256"))
    kept = staged(kept.agg(F.count("*").alias("n"), F.max("kept").alias("kept")).where("kept").drop("kept"), "kept")
    digest = F.sha2(F.translate(text, " \t\n\x0b\x0c\r", "").cast("binary"), 256)
    rows = plain.withColumn("own", digest).join(kept, F.col(doc).cast("bigint").eqNullSafe(F.col("id")) & (F.col("own") == F.col("sha256")))
    one = rows.where("n = 1").select(*plain.columns)
    if kept.where("n > 1").limit(1).count():
        best = F.max_by(F.struct(*plain.columns), F.struct(F.length(text), text)).alias("best")
        one = one.unionByName(rows.where("n > 1").groupBy("id", "sha256").agg(best).select("best.*"))
    return one.toDF(*df.columns)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


OP5_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS raw,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY length(raw) DESC, doc_id NULLS LAST) AS place FROM t),
k AS (SELECT norm, doc_id AS keep_id FROM g WHERE place = 1),
n AS (SELECT norm, count(*) AS group_size FROM t GROUP BY norm)
SELECT g.doc_id, k.keep_id, n.group_size, g.place = 1 AS kept, sha256(g.norm) AS text_sha256
FROM g JOIN k USING (norm) JOIN n USING (norm)
"""
