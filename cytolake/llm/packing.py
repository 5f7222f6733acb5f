"""Pattern packing by non-negative least squares.

The histogram of piece lengths (at most ``capacity`` numbers) goes to the driver.  All
patterns of one to three pieces that fill a sequence exactly are enumerated, repeat
counts are fitted to the histogram by non-negative least squares, and rounded down so
that no length is used more often than it occurs.  The residual is packed best-fit from
the longest length down, on counts.  The plan says, for each length, which of its
pieces (by rank) go into which sequences and where; its size depends on the number of
lengths and not on the number of documents.  Ranks are made from one counter for each
length and scan task, so no length's pieces meet in one task.

Defined cases: a null text is an empty one (a document of its closing id alone); only
documents longer than the capacity are cut; repeated rows and null ids are documents of
their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import gc
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytolake.llm.common import arrow_map, arrow_schema, columns, documents, staged, texts

CAPACITY, CLOSING_ID = 4096, 1
REMEMBERED = 2_000_000
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_CHUNK = re.compile("[^\t-\r \x85\xa0  -     　]+")

#: Characters that the word BPE's normaliser only lower-cases, and its pre-tokens of them.
_LATIN = re.compile("[!-~À-ÖØ-öø-įı-ſ]+")
_LATIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^a-z0-9ß-öø-ſ]+")
#: The printable character for each byte in byte-level vocabularies, as a table for ``str.translate``.
_ALPHABET = {b: c for b, c in zip(
    [b for b in range(256) if not (33 <= b < 127 or 161 <= b < 173 or 174 <= b)], range(256, 512))}


class ChunkEncoder:
    """Ids of texts from the tokenizers library, remembered for chunks between white space.

    Only for tokenizers whose pre-tokens never hold white space and whose normaliser works on
    each chunk alone, as the word BPE's does: a text's ids are then those of its chunks.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer, self.remembered = Tokenizer.from_file(path), remembered
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.tokenize = self.tokenizer.model.tokenize
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        if any(not t.content.startswith("<|") for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("this tokenizer has special tokens that chunks are not searched for")

    def word(self, word: str) -> bytes:
        """The ids of a pre-token."""
        packed = self.packed
        plain = word if word.isascii() else word.encode().decode("latin-1").translate(_ALPHABET)
        return b"".join([packed[t.id] for t in self.tokenize(plain)])

    def chunk(self, chunk: str) -> bytes:
        """The ids of a chunk, remembered from now on: plain Latin ones word by word through the library's model, others whole."""
        known = self.known
        if chunk[-1] in ".," and len(chunk) > 2 and chunk[-2].isalpha():  # the mark is a pre-token of its own
            before = known.get(chunk[:-1])
            if before is not None:
                ids = known[chunk] = before + known[chunk[-1]]
                return ids
        if not _LATIN.fullmatch(chunk) or "<|" in chunk:
            ids = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        elif chunk.isalpha():
            low = chunk.lower()
            ids = (known.get(low) if low != chunk else None) or self.word(low)
        else:
            words, own = self.words, []
            for w in _LATIN_WORDS.findall(chunk.lower()):
                got = words.get(w)
                if got is None:
                    got = words[w] = self.word(w)
                own.append(got)
            ids = b"".join(own)
        known[chunk] = ids
        return ids

    def encode(self, batch: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit numbers."""
        if len(self.known) > self.remembered:
            self.known.clear()
            self.words.clear()
        for mark in ".,":
            self.known[mark] = self.word(mark)
        out, get, chunk = [], self.known.get, self.chunk
        for t in batch:
            chunks = _CHUNK.findall(t) if _ODD_SPACE.search(t) else t.split()
            ids = list(map(get, chunks))
            at = -1
            while None in ids:
                try:
                    while True:
                        at = ids.index(None, at + 1)
                        ids[at] = get(chunks[at]) or chunk(chunks[at])
                except ValueError:
                    break
            out.append(b"".join(ids))
        return out


_ENCODERS: dict[str, ChunkEncoder] = {}
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, task_rank bigint"


def pieces(df: DataFrame, path: str, capacity: int = CAPACITY, closing_id: int = CLOSING_ID) -> DataFrame:
    """The pieces of every document, each with its rank among the pieces of its length in its scan task."""
    schema = arrow_schema(PIECES)

    def run(batches):
        gc.disable()  # nothing here makes cycles, and walking large tables is dear
        if path not in _ENCODERS:  # a worker keeps what it remembers from task to task
            _ENCODERS.clear()
            _ENCODERS[path] = ChunkEncoder(path)
        encoder, task = _ENCODERS[path], TaskContext.get().partitionId()
        closing, seen = np.array([closing_id], "<u4").tobytes(), np.zeros(capacity + 1, np.int64)
        width = 4 * capacity
        for b in batches:
            doc, piece, length, crc, rank = [], [], [], [], []
            for d, ids in zip(b.column(0).to_pylist(), encoder.encode(texts(b.column(1)))):
                ids += closing
                for k, at in enumerate(range(0, len(ids), width)):
                    part = ids[at:at + width]
                    n = len(part) // 4
                    doc.append(d)
                    piece.append(k)
                    length.append(n)
                    crc.append(zlib.crc32(part))
                    rank.append(int(seen[n]))
                    seen[n] += 1
            k = np.array(piece, np.int32)
            yield pa.record_batch([
                pa.array(doc, pa.int64()), pa.array(k), pa.array(k.astype(np.int64) * capacity), pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()), pa.array(np.full(len(k), task, np.int32)), pa.array(rank, pa.int64())], schema=schema)

    return arrow_map(columns(df, doc_id="bigint", text="string"), run, PIECES, rows=200)


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of three places in ``lengths`` (ascending, -1: none), largest first, whose lengths fill a sequence exactly."""
    place = np.full(capacity + 1, -1, np.int64)
    place[lengths] = np.arange(lengths.size)
    out = []
    if place[capacity] >= 0:
        out.append(np.array([[place[capacity], -1, -1]]))
    for a in lengths[::-1]:
        rest = capacity - a
        if rest <= 0 or a * 3 < capacity:
            continue
        if rest <= a and place[rest] >= 0:
            out.append(np.array([[place[a], place[rest], -1]]))
        b = lengths[(lengths <= min(a, rest - 1)) & (lengths * 2 >= rest)]
        c = rest - b
        good = place[c] >= 0
        if good.any():
            out.append(np.stack([np.full(good.sum(), place[a]), place[b[good]], place[c[good]]], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def fit(pattern: np.ndarray, histogram: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Repeat counts ``x >= 0`` that minimise ``|A x - histogram|``, by accelerated projected gradient."""
    n, m = len(pattern), histogram.size
    if not n:
        return np.zeros(0)
    flat = np.where(pattern < 0, m, pattern)
    target = np.append(histogram.astype(float), 0)
    # |A|^2 is at most the largest column sum times the largest row sum; a scale for each pattern makes steps long enough.
    use = np.bincount(flat.ravel(), minlength=m + 1)[:m].clip(1)
    scale = 1 / np.append(use, 1)[flat].max(axis=1)
    x = np.zeros(n)
    y, t = x, 1.0
    for _ in range(rounds):
        filled = np.bincount(flat.ravel(), np.repeat(y, 3), minlength=m + 1)
        short = target - filled
        short[m] = 0
        step = np.maximum(0, y + scale / 3 * short[flat].sum(axis=1))
        nxt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = np.maximum(0, step + (t - 1) / nxt * (step - x))
        x, t = step, nxt
    return x


def rounded(pattern: np.ndarray, x: np.ndarray, histogram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole repeat counts that use no length too often, the largest first; and what is left of the histogram."""
    left, count = histogram.astype(np.int64).copy(), np.zeros(len(x), np.int64)
    for want in (np.floor(x + 1e-9), np.ceil(x - 1e-9)):
        for i in np.argsort(-x, kind="stable"):
            n = int(want[i] - count[i])
            if n <= 0:
                if x[i] <= 0:
                    break
                continue
            row = [p for p in pattern[i] if p >= 0]
            for p in set(row):
                n = min(n, int(left[p]) // row.count(p))
            if n > 0:
                count[i] += n
                for p in row:
                    left[p] -= n
    return count, left


def best_fit(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: ``(lengths of a sequence, number of such sequences)``."""
    room: dict[int, dict[tuple[int, ...], int]] = {}  # by free room: contents and their number
    free: list[int] = []
    import bisect

    def add(space: int, content: tuple[int, ...], n: int) -> None:
        if space not in room:
            room[space] = {}
            bisect.insort(free, space)
        room[space][content] = room[space].get(content, 0) + n

    for i in np.argsort(-lengths, kind="stable"):
        size, n = int(lengths[i]), int(left[i])
        while n:
            k = bisect.bisect_left(free, size)
            if k == len(free):
                many = capacity // size
                if n >= many:
                    add(capacity - many * size, (size,) * many, n // many)
                    n %= many
                else:
                    add(capacity - n * size, (size,) * n, 1)
                    n = 0
                continue
            space = free[k]
            content, have = room[space].popitem()
            took = min(n, have)
            if have > took:
                room[space][content] = have - took
            elif not room[space]:
                del room[space]
                free.pop(k)
            add(space - size, (*content, size), took)
            n -= took
    return [(content, n) for by in room.values() for content, n in by.items()]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Rows ``length, first rank, first sequence, offset`` in the order of length and rank, and the number of sequences.

    The pieces of a length from a row's first rank up to the next row's go into consecutive sequences from its
    first sequence on, at its offset.
    """
    lengths = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[x] for x in lengths.tolist()], np.int64)
    pattern = patterns(lengths, capacity)
    repeat, left = rounded(pattern, fit(pattern, counts), counts)
    layout = [(tuple(int(lengths[p]) for p in pattern[i] if p >= 0), int(repeat[i])) for i in np.flatnonzero(repeat)]
    layout += best_fit(lengths, left, capacity)
    rank, rows, sequence = dict.fromkeys(lengths.tolist(), 0), [], 0
    for content, n in layout:
        offset = 0
        for size in content:
            rows.append((size, rank[size], sequence, offset))
            rank[size] += n
            offset += size
        sequence += n
    assert all(rank[x] == histogram[x] for x in rank)
    return np.array(sorted(rows), np.int64).reshape(-1, 4), sequence


def pack(df: DataFrame, path: str, capacity: int = CAPACITY, closing_id: int = CLOSING_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece."""
    spark = df.sparkSession
    cut = staged(pieces(df, path, capacity, closing_id), "pieces")
    per_task = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    table, _ = plan(histogram, capacity)
    held = spark.sparkContext.broadcast(table)  # bounded by the lengths: a few rows for each
    from pyspark.sql import Window

    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    base = per_task.select("task", "length", F.coalesce(before, F.lit(0)).alias("base"))
    ranked = cut.join(base, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("task_rank")).alias("rank"))
    out = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    schema = arrow_schema(out)

    def place(batches):
        rows = held.value
        wide = rows[:, 0] << 48 | rows[:, 1]
        for b in batches:
            size, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            at = np.searchsorted(wide, size << 48 | rank, side="right") - 1
            yield pa.record_batch([*(b.column(i) for i in range(5)), pa.array(rows[at, 2] + rank - rows[at, 1]), pa.array(rows[at, 3])], schema=schema)

    return ranked.mapInArrow(place, out)


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
