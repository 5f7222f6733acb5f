"""Documents for the odd cases, and brute force."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG = " ".join(f"w{i % 977}" for i in range(40_000))
ODD = [(3, "one two three four five six"), (1, None), (None, "one two three four five six"), (2, ""), (2, ""), (5, LONG), (6, LONG + " end"), (4, " \t\n"), (7, "one  two three four five six"), (11, "ONE two three four five six"),
       (8, "é" * 300), (9, "😀 x \x1c y <|endoftext|> z"), (10, "single")]


def odd(spark) -> DataFrame:
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns whose names clash with others'."""
    df = spark.createDataFrame(ODD, "doc_id bigint, text string")
    return df.select("doc_id", "text", F.lit("x").alias("key"), F.lit(None).cast("int").alias("rank"), F.lit(1).alias("part"), F.lit("y").alias("node"), F.lit("z").alias("TEXT_"), F.lit("t").alias("Doc_Id"))


#: Names of extra columns: those that operators use inside, and those that differ from an input's only in case.
CLASHING = "key rank part node rest _id _rows _own _digest TEXT Doc_Id _ c0 c1 none id sha256 n".split()


def wide(spark) -> DataFrame:
    """Extra columns of clashing names."""
    df = spark.createDataFrame(ODD, "doc_id bigint, text string")
    return df.select("doc_id", "text", *[F.lit(f"x{i}").alias(f"e{i}") for i in range(len(CLASHING))]).toDF("doc_id", "text", *CLASHING)


def plain(spark) -> DataFrame:
    """The same without the extra columns."""
    return spark.createDataFrame(ODD, "doc_id bigint, text string")


def empty(spark) -> DataFrame:
    return spark.createDataFrame([], "doc_id bigint, text string")


def shingle_set(text: str | None, words: int) -> set:
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())


def components(sets: dict) -> dict:
    """Smallest reachable id under similarity 0.8, all pairs compared."""
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            a, b = sets[i], sets[j]
            n = len(a & b)
            if a and b and 100 * n >= 80 * (len(a) + len(b) - n):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def without_repeats(docs: list[tuple[int, bytes]], length: int) -> dict[int, list[bool]]:
    """For each document which bytes go, window by window in order."""
    seen, out = set(), {}
    for i, b in sorted(docs):
        gone = [False] * len(b)
        for o in range(len(b) - length + 1):
            if b[o:o + length] in seen:
                gone[o:o + length] = [True] * length
            seen.add(b[o:o + length])
        out[i] = gone
    return out
