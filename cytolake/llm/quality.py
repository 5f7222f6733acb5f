"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages (about ``PASSAGE`` bytes each, cut at white space; the
whole text, however long).  A passage is described by how often each class of byte
follows each other one, and by how well its document compresses.  An encoder maps it to
a hidden vector; gated attention (Ilse, Tomczak and Welling, 2018), learned with it from
document labels alone, weighs the passages, and the score is read from the weighted sum.

Trained with Adam on the driver from a sample of at most ``TRAINING_ROWS`` labelled
documents.  All of them are in the fit: where they have more than ``TRAINING_PASSAGES``
passages, neighbouring passages of the longest are averaged until the number fits, so
that a long text counts whole and costs no other its place.  Everything is scored, in
one pass.

Defined cases: a null or empty text is a bag of one empty passage and has a score;
without any labels of both kinds every score is the share of ones (0.5 without labels)
and, as nothing speaks against a document, ``keep_quality`` keeps every row;
repeated rows and null ids pass through row by row; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import gc
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytolake.llm.common import arrow_map, arrow_schema, byte_texts, columns, documents, held_out, numbered
from cytolake.llm.labelled import labels_of, training_documents

PASSAGE = 512
TRAINING_ROWS, TRAINING_PASSAGES = 4000, 40_000
HIDDEN, ATTENTION, EPOCHS, SEED = 24, 12, 250, 7
THRESHOLD = 0.7

_GROUPS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r", b".", b",", b"!", b"?'\"", b"|", b"#", b"$", b"%",
           b"&", b"*", b":;-()", b"=/@_<>", bytes(range(0x80, 0xC0)), bytes(range(0xC0, 0x100))]
CLASSES = len(_GROUPS) + 1
_CLASS = np.zeros(256, np.uint8)
for _i, _g in enumerate(_GROUPS, 1):
    _CLASS[list(_g)] = _i
WIDTH = CLASSES * CLASSES + 4
#: Passages that are counted or scored at a time.
SLICE = 1024


def passages(batch: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of some texts, text by text, and the number of each text's passages."""
    size = np.fromiter(map(len, batch), np.int64, len(batch))
    data = np.frombuffer(b" ".join(batch) + b" ", np.uint8)
    begin = np.cumsum(size + 1) - size - 1
    kind = _CLASS[data]
    space = np.flatnonzero(kind[:-1] == 4)
    count = np.maximum(1, size // PASSAGE)
    first = np.cumsum(count) - count
    start = np.repeat(begin, count) + (np.arange(count.sum()) - np.repeat(first, count)) * PASSAGE
    # A cut moves on to the next space, if there is one nearby in the same text.
    inner = np.ones(start.size, bool)
    inner[first] = False
    if space.size:
        at = space[np.minimum(np.searchsorted(space, start[inner]), space.size - 1)] + 1
        start[inner] = np.where((at > start[inner]) & (at < start[inner] + PASSAGE // 2), at, start[inner])
    n, pairs = start.size, CLASSES * CLASSES
    out, edge = np.empty((n, WIDTH), np.float32), np.append(start, data.size)
    for i in range(0, n, SLICE):
        j = min(n, i + SLICE)
        own = kind[edge[i]:edge[j] + 1].astype(np.int64)  # with the first byte after them, the second of the last pair
        owner = np.repeat(np.arange(j - i), np.diff(edge[i:j + 1]))[:own.size - 1]
        pair = np.bincount(owner * pairs + own[:-1] * CLASSES + own[1:], minlength=(j - i) * pairs).reshape(j - i, -1).astype(np.float32)
        out[i:j, :-4] = np.sqrt(pair / np.maximum(pair.sum(axis=1, keepdims=True), 1))
    # How well the text compresses, for its length; and its length.
    packed = np.array([len(zlib.compress(t, 1)) for t in batch], np.float32)
    ratio = packed / np.maximum(size, 1)
    long = np.log1p(size).astype(np.float32)
    out[:, -4:] = np.repeat(np.stack([np.minimum(ratio, 2), ratio * (size > 400), long / 10, (size < 100).astype(np.float32)], axis=1), count, axis=0)
    return out, count


class GatedAttention:
    """The model: ``h = tanh(xW + b)``, weights by ``softmax(w . (tanh(hV) * sigmoid(hU)))``, score ``sigmoid(c . sum + d)``."""

    def __init__(self, width: int, seed: int = SEED):
        r = np.random.default_rng(seed)
        f = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"W": f(width, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": f(HIDDEN, ATTENTION), "U": f(HIDDEN, ATTENTION), "w": f(ATTENTION, 1)[:, 0], "c": f(HIDDEN, 1)[:, 0], "d": np.zeros(1, np.float32)}
        self.mean, self.scale, self.constant = np.zeros(width, np.float32), np.ones(width, np.float32), None

    def forward(self, x: np.ndarray, count: np.ndarray) -> dict:
        p, first = self.p, np.cumsum(count) - count
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), count))
        a = e / np.repeat(np.add.reduceat(e, first), count)
        z = np.add.reduceat(h * a[:, None], first)
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "score": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))}

    def fit(self, x: np.ndarray, count: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, decay: float = 1e-3) -> GatedAttention:
        if not y.size or y.min() == y.max():
            self.constant = float(y.mean()) if y.size else 0.5
            return self
        self.mean, self.scale = x.mean(axis=0), 1 / (x.std(axis=0) + 0.02)
        x = (x - self.mean) * self.scale
        first = np.cumsum(count) - count
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, epochs + 1):
            p, f = self.p, self.forward(x, count)
            h, t, s, a, z = (f[k] for k in "htsaz")
            dl = ((f["score"] - y) / y.size).astype(np.float32)
            g = {"c": z.T @ dl, "d": dl.sum(keepdims=True)}
            dz = np.repeat(dl[:, None] * p["c"], count, axis=0)
            da = (dz * h).sum(axis=1)
            de = a * (da - np.repeat(np.add.reduceat(a * da, first), count))
            g["w"] = (t * s).T @ de
            dg = de[:, None] * p["w"]
            dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
            g["V"], g["U"] = h.T @ dt, h.T @ ds
            dh = (dz * a[:, None] + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
            g["W"], g["b"] = x.T @ dh, dh.sum(axis=0)
            now = rate * (0.1 if step > epochs * 0.8 else 1)
            for k in p:
                grad = g[k] + (decay * p[k] if k in "WVUc" else 0)
                m[k] = 0.9 * m[k] + 0.1 * grad
                v2[k] = 0.99 * v2[k] + 0.01 * grad * grad
                p[k] = (p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def score(self, x: np.ndarray, count: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(count.size, self.constant)
        p, first = self.p, np.cumsum(count) - count
        h, e = np.empty((len(x), HIDDEN), np.float32), np.empty(len(x), np.float32)
        for i in range(0, len(x), SLICE):
            h[i:i + SLICE] = own = np.tanh((x[i:i + SLICE] - self.mean) * self.scale @ p["W"] + p["b"])
            e[i:i + SLICE] = (np.tanh(own @ p["V"]) / (1 + np.exp(-(own @ p["U"])))) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), count))
        z = np.add.reduceat(h * (e / np.repeat(np.add.reduceat(e, first), count))[:, None], first)
        return (1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))).astype(float)


def passages_each(sizes: dict[int, int], most: int) -> int:
    """The largest number of passages that a document may have if all together are to have at most ``most`` (at least
    one); ``sizes`` says how many documents have how many passages."""
    left, rows = most, sum(sizes.values())
    for k in sorted(sizes):
        if k * rows > left:
            return max(1, left // rows)
        left -= k * sizes[k]
        rows -= sizes[k]
    return max(sizes, default=1)


def averaged(x: np.ndarray, most: int) -> np.ndarray:
    """A document's passages in at most ``most`` rows, each the mean of neighbouring ones."""
    if len(x) <= most:
        return x
    edge = np.arange(most + 1) * len(x) // most
    return np.add.reduceat(x, edge[:-1]) / np.diff(edge)[:, None].astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, most_passages: int = TRAINING_PASSAGES) -> GatedAttention:
    """Fit the model on the training sample; its passages' features are all that comes to the driver."""
    ddl = "doc_id bigint, label int, n bigint, features binary"
    schema = arrow_schema(ddl)

    def run(batches):
        for b in batches:
            for d, y, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), byte_texts(b.column(1))):
                x = averaged(passages([t])[0], most)
                yield pa.record_batch([pa.array([d]), pa.array([y], pa.int32()), pa.array([len(x)]), pa.array([x.astype(np.float16).tobytes()])], schema=schema)

    sample = training_documents(docs, labels, "quality", rows)
    sizes = sample.groupBy(F.greatest(F.lit(1), F.floor(F.octet_length(F.coalesce("text", F.lit(""))) / PASSAGE)).alias("k")).agg(F.count("*").alias("rows")).collect()
    most = passages_each({r.k: r.rows for r in sizes}, most_passages)
    got = arrow_map(sample.select("doc_id", "text", "label"), run, ddl).collect()
    got.sort(key=lambda r: r.doc_id)
    x = np.concatenate([np.frombuffer(r.features, np.float16).reshape(-1, WIDTH).astype(np.float32) for r in got]) if got else np.zeros((0, WIDTH), np.float32)
    return GatedAttention(WIDTH).fit(x, np.array([r.n for r in got], np.int64), np.array([r.label for r in got], np.float32))


SCORED = "doc_id bigint, held_out boolean, score double, predicted int"


def score_quality(df: DataFrame, model: GatedAttention, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    held, schema = df.sparkSession.sparkContext.broadcast(model), arrow_schema(SCORED)

    def run(batches):
        gc.disable()
        model = held.value
        for b in batches:
            scores = _scores(model, byte_texts(b.column(1)))
            yield pa.record_batch([
                b.column(0), pa.array([held_out(d) for d in b.column(0).to_pylist()]), pa.array(scores),
                pa.array((scores >= threshold).astype(np.int32))], schema=schema)

    return arrow_map(columns(df, doc_id="bigint", text="string"), run, SCORED, rows=500)


def keep_quality(df: DataFrame, model: GatedAttention, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, of documents that the model doesn't reject; all rows if it had no labels of both kinds."""
    if model.constant is not None:
        return df
    held, at = df.sparkSession.sparkContext.broadcast(model), df.columns.index("text")
    plain, _ = numbered(df)

    def run(batches):
        gc.disable()
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(_scores(held.value, byte_texts(b.column(at))) >= threshold))

    return arrow_map(plain, run, plain.schema, rows=500).toDF(*df.columns)


def _scores(model: GatedAttention, raw: list[bytes]) -> np.ndarray:
    """Scores of texts, about a megabyte at a time."""
    out, at = [np.zeros(0)], 0
    while at < len(raw):
        to, held = at, 0
        while to < len(raw) and (to == at or held + len(raw[to]) < 1 << 20):
            held += len(raw[to])
            to += 1
        out.append(model.score(*passages(raw[at:to])))
        at = to
    return np.concatenate(out)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score_quality(docs, train(docs, labels_of(spark, sf_dir)))
