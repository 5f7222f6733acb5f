"""Near-duplicate components by a multi-index Hamming join of b-bit MinHash signatures.

Each document's set of word shingles gives a signature of ``CHUNKS * WIDTH`` symbols of
16 bits.  The signature is split into chunks and each chunk is indexed once for every
way to leave one symbol out, so two signatures share an index key exactly if some chunk
of theirs has at most one error.  By the pigeonhole principle every pair with at most
``2 * CHUNKS - 1`` (23) of 60 symbols different shares a key; a pair at similarity 0.8
has 12 on average, and one with more errors is missed only if every chunk has two (a
probability of ``0.263 ** 12``, about one pair in ten million, at 0.8; ``0.081 ** 12``, one in ten million millions, at 0.9).
No candidate is dropped for its signature: all whose sizes allow a link are confirmed on their full sets. A link
is ``100 * |intersection| >= 80 * |union|``.

Documents with the same set are one node.  Within a key's members all pairs are not
emitted: (1) each node is compared with the hub (smallest node of a key) that it shares
most keys with, (2) nodes still in another component than a hub of theirs with that hub,
(3) of all members of keys that are still in different components, those of different
components that share one of their rarest shingles, as sets this similar must; where
many share one, those that share the next one too.  Links
inside a component change nothing, so no component is lost.  Keys, hubs and links meet
only in aggregations and equi-joins; a hub's set is sent once for every ``TOGETHER`` of its members.

Defined cases: null and empty texts and those without words have an empty set, a
component of their own and no links; texts with fewer words than a shingle have one
shingle, the whole; equal texts and repeated rows share a component; rows that share a
doc_id are one node with all their links; a null doc_id has no links and a null
component_id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import gc
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cytolake.llm.common import arrow_map, arrow_schema, byte_texts, columns, documents, mix64, numbered, staged
from cytolake.llm.components import connected_components, merged

#: Chunks of a signature, symbols in each.
CHUNKS, WIDTH = 12, 5
SYMBOLS = CHUNKS * WIDTH
#: Words that a worker remembers the hashes of.
REMEMBERED = 150_000
#: Members that are compared with a hub in one place; members of other components that a member shares a shingle with, on
#: average, before the next one has to be shared too, and how often.
TOGETHER, CROWD, DEEPER = 200, 500, 3
#: Similarity in hundredths from which documents are linked.
PERCENT = 80
_ODD = mix64(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32) | np.uint32(1)


class _Words(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: bytes, words: int, memory: _Words) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    split = text.lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not split:
        return np.zeros(0, np.uint64)
    if len(split) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(split), seed=words)], np.uint64)
    h = np.fromiter(map(memory.__getitem__, split), np.uint64, len(split))
    n = len(h) - words + 1
    mixed = np.zeros(n, np.uint64)
    for i in range(words):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[i:i + n]
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mix64(mixed))


def signature(sets: np.ndarray) -> np.ndarray:
    """``SYMBOLS`` symbols of 16 bits of a non-empty set of hashes."""
    low = (sets >> np.uint64(32)).astype(np.uint32)
    best = np.full(SYMBOLS, 0xFFFFFFFF, np.uint32)
    for at in range(0, low.size, 1 << 14):
        np.minimum(best, (low[None, at:at + (1 << 14)] * _ODD[:, None]).min(axis=1), out=best)
    return (mix64(best.astype(np.uint64) + _ODD) >> np.uint64(48)).astype(np.uint16)


SIGNED = "doc_id bigint, n_shingles bigint, set_key binary, signature binary"


def signed(df: DataFrame, words: int) -> DataFrame:
    """The size, 128-bit digest and signature of every document's set; digest and signature are null for an empty one."""
    schema = arrow_schema(SIGNED)

    def run(batches):
        gc.disable()
        memory = _Words()
        for b in batches:
            if len(memory) > REMEMBERED:
                memory.clear()
            sets = [shingles(t, words, memory) for t in byte_texts(b.column(1))]
            yield pa.record_batch([
                b.column(0), pa.array([s.size for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if s.size else None for s in sets], pa.binary()),
                pa.array([signature(s).tobytes() if s.size else None for s in sets], pa.binary())], schema=schema)

    return arrow_map(columns(df, doc_id="bigint", text="string"), run, SIGNED, rows=200)


def index_keys(nodes: DataFrame) -> DataFrame:
    """``key, node``: for each chunk of a node's signature a key for every symbol left out of it."""
    schema = arrow_schema("key bigint, node bigint")
    salt = mix64(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            symbols = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, CHUNKS, WIDTH)
            keys = []
            for out in range(WIDTH):
                rest = np.ascontiguousarray(np.delete(symbols, out, axis=2)).view(np.uint64)[:, :, 0]
                keys.append(mix64(mix64(rest) ^ salt[None, out::WIDTH]))
            key = np.concatenate(keys, axis=1)
            node = np.repeat(b.column(0).to_numpy(), key.shape[1])
            yield pa.record_batch([pa.array(key.ravel().view(np.int64)), pa.array(node)], schema=schema)

    return arrow_map(nodes.select("node", "signature"), run, "key bigint, node bigint")


def near_enough(pairs: DataFrame, nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs ``a, b`` whose sizes allow a link."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent).select("a", "b")


def full_sets(df: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """``node, hashes``: the full sets, as sorted 64-bit hashes, of the documents named by ``nodes.node``."""
    schema = arrow_schema("node bigint, hashes binary")

    def run(batches):
        gc.disable()
        memory = _Words()
        for b in batches:
            if len(memory) > REMEMBERED:
                memory.clear()
            yield pa.record_batch([b.column(0), pa.array([shingles(t, words, memory).tobytes() for t in byte_texts(b.column(1))], pa.binary())], schema=schema)

    rows = df.join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    return arrow_map(rows.select("doc_id", "text"), run, "node bigint, hashes binary", rows=200)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT, together: int = TOGETHER) -> DataFrame:
    """The pairs ``a, b`` that are links on their full sets. The members ``b`` of an ``a`` come in lots of about
    ``together``, each after one copy of the set of ``a``."""
    schema = arrow_schema("a bigint, b bigint")

    def run(batches):
        lot, hub = None, None
        for batch in batches:
            found = []
            for a, k, b, x in zip(*(batch.column(i).to_pylist() for i in range(4))):
                x = np.frombuffer(x, np.uint64)
                if b is None:
                    lot, hub = (a, k), x
                    continue
                assert lot == (a, k)
                both = np.concatenate([hub, x])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (hub.size + x.size - common):
                    found.append((a, b))
            yield pa.record_batch([pa.array([r[i] for r in found], pa.int64()) for i in (0, 1)], schema=schema)

    lots = pairs.groupBy("a").agg(F.ceil(F.count("*") / together).cast("int").alias("lots"))
    hubs = lots.join(sets.withColumnRenamed("node", "a"), "a")
    hubs = hubs.select("a", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), F.lit(None).cast("bigint").alias("b"), "hashes")
    members = pairs.join(lots, "a").select("a", F.pmod(F.xxhash64("b"), F.col("lots")).cast("int").alias("lot"), "b")
    members = members.join(sets.withColumnRenamed("node", "b"), "b").select("a", "lot", "b", "hashes")
    rows = hubs.unionByName(members).repartition("a", "lot").sortWithinPartitions("a", "lot", F.col("b").asc_nulls_first())
    return arrow_map(rows, run, "a bigint, b bigint", rows=50)


def sharing_rare(members: DataFrame, sets: DataFrame, percent: int = PERCENT, crowd: int = CROWD, deeper: int = DEEPER) -> DataFrame:
    """The pairs ``a, b`` of members (``node, component, n``) of different components that can be links.

    Each member's hashes are put in one order, those in few members first (hashes of one member alone come before all
    others and are shared with none). Of the hashes that similar enough sets share, the first has at least
    ``percent / 100 * n`` hashes from it on, in either; and there must be enough for the overlap that a link needs (prefix
    and position filtering: no link is lost). The next one that they share has as many less one. So where members share a
    hash with more than ``crowd`` of other components on average, they are dealt anew by it and each that can be the next one, up to
    ``deeper`` times; a large component that meets few others stays as it is, as its pairs are no more than a few for each member.
    """
    schema = arrow_schema("token bigint, node bigint")

    def run(batches):
        for b in batches:
            sizes = [len(x) // 8 for x in b.column(1).to_pylist()]
            yield pa.record_batch([pa.array(np.frombuffer(b"".join(b.column(1).to_pylist()), np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), sizes))], schema=schema)

    tokens = arrow_map(sets.join(members.select("node"), "node").select("node", "hashes"), run, "token bigint, node bigint", rows=200)
    common = tokens.groupBy("token").agg(F.count("*").alias("f")).where("f > 1")
    rank = F.row_number().over(Window.partitionBy("node").orderBy("f", "token"))
    ranked = tokens.join(common, "token").withColumn("rank", rank).withColumn("m", F.count("*").over(Window.partitionBy("node")))
    ranked = ranked.select("token", "node", (F.col("m") - F.col("rank") + 1).alias("left"))  # this hash and those after it
    ranked = staged(ranked.join(members, "node"), "ranked")
    rare = ranked.where(F.col("left") * 100 >= F.col("n") * percent).select("token", "node", "component", "n", "left")

    def together(rows: DataFrame, overlap) -> DataFrame:
        """The pairs of different components with one token whose overlap can be, or is, enough."""
        other = rows.select("token", F.col("node").alias("b"), F.col("component").alias("c_b"), F.col("n").alias("n_b"), F.col("left").alias("left_b")).alias("y")
        enough = overlap * (100 + percent) >= (F.col("n") + F.col("n_b")) * percent
        both = rows.withColumnRenamed("node", "a").alias("x").join(other, (F.col("x.token") == F.col("y.token")) & (F.col("component") < F.col("c_b")) & enough)
        return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    out = []
    for shared in range(deeper + 1):  # hashes that members of a group share besides the last one
        groups = rare.groupBy("token", "component").agg(F.count("*").cast("double").alias("n"))
        groups = groups.groupBy("token").agg(F.sum("n").alias("size"), F.sum(F.col("n") * F.col("n")).alias("square"), F.count("*").alias("several")).where("several > 1")
        groups = staged(groups.select("token", ((F.col("size") - F.col("square") / F.col("size")) > crowd).alias("hot")), "groups")
        last = shared == deeper or not groups.where("hot").limit(1).count()
        few = rare.join(groups if last else groups.where("not hot"), "token").drop("hot")
        out.append(together(few, F.least("left", "left_b") + shared))
        if last:
            break
        hot = rare.join(groups.where("hot"), "token").drop("hot")
        # Sets so small that what they share already is enough need not share another one.
        out.append(together(hot.where(F.col("n") * percent <= (shared + 1) * 100), F.lit(shared + 1)))
        hot = hot.select(F.col("token").alias("before"), "node", F.col("left").alias("left_before"))
        then = ranked.join(hot, "node").where((F.col("left") < F.col("left_before")) & ((F.col("left") + shared + 1) * 100 >= F.col("n") * percent))
        rare = staged(then.select(F.xxhash64("before", "token").alias("token"), "node", "component", "n", "left"), "rare")
    return reduce(DataFrame.unionByName, out).distinct()


def near_components(df: DataFrame, words: int = 5) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row; see the module's text."""
    df = columns(df, doc_id="bigint", text="string")
    sign = staged(signed(df, words), "signatures")
    named = sign.where("set_key is not null and doc_id is not null")
    nodes = staged(named.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n")), "nodes")
    keys = index_keys(nodes)
    hubs = keys.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("top")).where("a < top").select("key", "a")
    shared = staged(keys.join(hubs, "key"), "keys")  # keys of several nodes only
    star = shared.where("a < node").groupBy("a", F.col("node").alias("b")).agg(F.count("*").alias("n"))
    near = near_enough(star.select("a", "b"), nodes)
    star = staged(star.join(near, ["a", "b"]), "pairs")

    members = shared.select("node").distinct()
    sets = staged(full_sets(df, members, words), "sets")

    first = star.groupBy("b").agg(F.max_by(F.struct("a"), F.struct("n", -F.col("a"))).alias("best")).select("best.a", "b")

    def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """The pairs whose ends are in different components so far."""
        of = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}"))
        both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
        return both.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")

    # Pairs are staged before they are confirmed, which reads them several times.
    first = staged(first, "first")
    labels = connected_components(confirmed(first, sets))
    labels = merged(labels, confirmed(staged(apart(star.select("a", "b").join(first, ["a", "b"], "left_anti"), labels), "apart"), sets))

    member = shared.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    mixed = member.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    member = member.join(mixed, "key").select("node", "component").distinct().join(nodes.select("node", "n"), "node")
    cross = sharing_rare(staged(member, "mixed"), sets).join(star.select("a", "b"), ["a", "b"], "left_anti")
    labels = merged(labels, confirmed(staged(near_enough(cross, nodes), "cross"), sets))

    found = nodes.select("set_key", "node").join(labels, "node", "left").select("set_key", F.coalesce("component", "node").alias("component"))
    rows = sign.select("doc_id", "n_shingles", "set_key").join(found, "set_key", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return rows.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.expr("doc_id <=> component_id"))


def one_of_each(df: DataFrame, words: int = 5) -> DataFrame:
    """The rows, with all their columns, of the documents that stay: of each component the smallest doc_id."""
    plain, at = numbered(df)
    kept = near_components(df, words).where("kept").select(F.col("doc_id").alias("id")).distinct()
    return plain.join(kept, F.col(at["doc_id"]).cast("bigint").eqNullSafe(F.col("id")), "left_semi").toDF(*df.columns)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(documents(spark, sf_dir), words=2)
