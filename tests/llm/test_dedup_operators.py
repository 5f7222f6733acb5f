"""Exact, near and suffix deduplication against brute force."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from cytolake.llm import anchors, components, exact_dedup, near_dedup, suffix_dedup
from cytolake.llm.common import documents
from cytolake.llm.registry import ORACLE_SQL, QUERIES
from tests.llm import helpers
from tests.llm.helpers import ODD, empty, odd, wide


def test_op5_against_sql(spark, tiny, duck):
    got = QUERIES["op5_exact_dedup"](spark, tiny).toPandas()
    want = duck.execute(ORACLE_SQL["op5_exact_dedup"]).df()[list(got.columns)]
    a, b = (x.sort_values("doc_id").astype(str).values.tolist() for x in (got, want))
    assert a == b


def test_op5_directory_doubles():
    rnd = random.Random(1)
    counts = {}
    for _ in range(5000):
        k = rnd.randrange(1 << 16) if rnd.random() < 0.5 else rnd.randrange(1 << 8)
        counts[k] = counts.get(k, 0) + 1
    depth, slots = exact_dedup.split_directory(counts, 100)
    assert len(slots) == 1 << depth and slots == sorted(slots) and set(slots) == set(range(slots[-1] + 1))
    held = {}
    for k, n in counts.items():
        held[slots[k >> (16 - depth)]] = held.get(slots[k >> (16 - depth)], 0) + n
    assert max(held.values()) <= 100
    assert exact_dedup.split_directory({}, 100) == (0, [0])


@pytest.mark.parametrize("capacity,remembered", [(1, 0), (1000, 1 << 20)])
def test_op5_odd_cases(spark, capacity, remembered):
    got = exact_dedup.exact_dedup(odd(spark), capacity, remembered).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert (by[3].keep_id, by[3].group_size, by[7].kept, by[None].kept) == (7, 3, True, False)  # the one with more white space
    assert by[1].keep_id == by[2].keep_id == by[4].keep_id == 4 and by[4].group_size == 4
    assert by[8].text_sha256 == hashlib.sha256(("é" * 300).encode()).hexdigest()
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_op5_different_texts_with_one_digest_are_two_groups(spark):
    """A forced collision, in one task and in several, with a directory of one bucket and of as many as can be."""
    rows = [(1, "one"), (2, "two"), (3, "o n e"), (4, "two"), (5, "three"), (6, None), (7, "one")]
    for partitions, capacity in ((1, 1), (4, 1000)):
        df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(partitions)
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df, capacity, digest=lambda text: b"\xff" * 8 + bytes(24)).collect()}
        assert got == {1: (3, 3, False), 3: (3, 3, True), 7: (3, 3, False), 2: (2, 2, True), 4: (2, 2, False), 5: (5, 1, True), 6: (6, 1, True)}


def test_op5_one_of_repeated_rows_stays(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "a b"), (1, "ab"), (2, "a  b"), (2, "a  b"), (3, "c"), (3, "c"), (None, "d"), (None, "d"), (None, None), (4, " ")]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLE_SQL['op5_exact_dedup']})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())
    assert sum(r[3] for r in want) == 4
    kept = exact_dedup.without_copies(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, [(2, "a  b"), (3, "c"), (None, "d"), (4, " ")]))


def test_op5_directory_goes_as_deep_as_it_must(spark):
    """Keys that share their first 15 bits, in buckets of two."""
    deep = [(k << 45) for k in range(16)]
    depth, slots = exact_dedup.directory(spark.createDataFrame([(k,) for k in deep], "key bigint"), 4, 2)
    held = {}
    for k in deep:
        b = slots[k >> (64 - depth)]
        held[b] = held.get(b, 0) + 1
    assert depth > 16 and max(held.values()) <= 2


def test_components(spark):
    rnd = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100 + rnd.randrange(50), 100 + rnd.randrange(50)) for _ in range(30)] + [(200, i) for i in range(201, 260)] + [(7, 7)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert all(got.get(x, x) == find(x) for x in root)
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_components_after_further_links(spark):
    """Links after others give what all give together, and stars take no round of the whole graph."""
    rnd = random.Random(5)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(260)] + [(7, 7), (900, 901)]
    frame = lambda rows: spark.createDataFrame(rows, "a bigint, b bigint")
    want = {r.node: r.component for r in components.connected_components(frame(edges)).collect()}
    for k in (0, 100, len(edges)):
        got = components.merged(components.connected_components(frame(edges[:k])), frame(edges[k:])).collect()
        assert len(got) == len({r.node for r in got}) and {r.node: r.component for r in got} == want
    stars = frame([(1, 0), (2, 0), (5, 4)]).toDF("u", "v")
    assert components._stars(stars) and components._stars(stars.limit(0)) and not components._stars(stars.union(frame([(4, 0)]))) and not components._stars(stars.union(frame([(5, 0)])))
    assert components.connected_components(stars, most_rounds=1).count() == 5


def test_op2_against_brute_force(spark, tiny):
    sets = {r.doc_id: helpers.shingle_set(r.text, 2) for r in documents(spark, tiny).collect()}
    want = helpers.components(sets)
    got = QUERIES["op2_near_dedup"](spark, tiny).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == sorted((i, len(sets[i]), want[i], want[i] == i) for i in sets)


def test_op2_one_large_group_of_near_copies(spark):
    """Copies with few to many changes, so that some are linked only through others and some not at all."""
    rnd = random.Random(3)
    base = [f"b{rnd.randrange(400)}" for _ in range(130)]
    docs = []
    for i in range(250):
        words = list(base)
        for _ in range(rnd.choice([0, 2, 4, 6, 9, 12, 20])):
            words[rnd.randrange(130)] = f"x{rnd.randrange(10**6)}"
        docs.append((i, " ".join(words)))
    docs += [(1000 + i, " ".join(base[:20] + [f"r{i}_{j}" for j in range(60)])) for i in range(60)]
    want = helpers.components({i: helpers.shingle_set(t, 2) for i, t in docs})
    got = near_dedup.near_components(spark.createDataFrame(docs, "doc_id bigint, text string"), 2).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_op2_crowds_are_dealt_by_the_next_shingle(spark):
    """Many sets around few common shingles: the same pairs however often groups are dealt anew."""
    rnd = random.Random(8)
    base = list(range(1, 9))
    sets = {i: sorted(set(rnd.sample(base, rnd.randrange(4, 9)) + [rnd.randrange(1, 40) for _ in range(rnd.randrange(4))])) for i in range(120)}
    rows = [(i, np.array(x, np.uint64).tobytes()) for i, x in sets.items()]
    hashes = spark.createDataFrame(rows, "node bigint, hashes binary")
    members = spark.createDataFrame([(i, i // 2, len(x)) for i, x in sets.items()], "node bigint, component bigint, n bigint")
    want = {(i, j) for i in sets for j in sets if i < j and i // 2 != j // 2 and 100 * len(set(sets[i]) & set(sets[j])) >= 80 * len(set(sets[i]) | set(sets[j]))}
    assert len(want) > 100
    for crowd, deeper in ((1000, 3), (5, 0), (5, 1), (2, 3), (2, 8)):
        got = near_dedup.sharing_rare(members, hashes, crowd=crowd, deeper=deeper)
        pairs = [tuple(r) for r in got.collect()]
        assert len(pairs) == len(set(pairs)) and want <= set(pairs)
        for together in (1, 3, 2000):
            assert {tuple(r) for r in near_dedup.confirmed(got, hashes, together=together).collect()} == want


def test_op2_against_brute_force_at_a_thousand_documents(spark):
    sets = {r.doc_id: helpers.shingle_set(r.text, 2) for r in documents(spark, "/root/testdata/sf0.01").collect()}
    index, root = {}, {i: i for i in sets}
    for i, x in sets.items():
        for t in x:
            index.setdefault(t, []).append(i)
    shared = {}
    for ids in index.values():
        for k, i in enumerate(ids):
            for j in ids[k + 1:]:
                shared[i, j] = shared.get((i, j), 0) + 1

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, j), n in shared.items():
        if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    got = QUERIES["op2_near_dedup"](spark, "/root/testdata/sf0.01").collect()
    assert {r.doc_id: r.component_id for r in got} == {i: find(i) for i in sets}


def test_op2_signature_guarantee():
    """Every pair of signatures with at most 23 errors shares an index key: some chunk has at most one."""
    rnd = np.random.default_rng(0)
    for _ in range(2000):
        wrong = np.zeros(near_dedup.SYMBOLS, int)
        wrong[rnd.choice(near_dedup.SYMBOLS, 2 * near_dedup.CHUNKS - 1, replace=False)] = 1
        assert wrong.reshape(near_dedup.CHUNKS, -1).sum(axis=1).min() <= 1


def test_op2_odd_cases(spark):
    got = near_dedup.near_components(odd(spark), 2).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert by[7].component_id == by[11].component_id == 3 and by[6].component_id == 5 and by[None].component_id is None and by[None].kept
    assert by[1].n_shingles == 0 and by[1].kept and by[10].n_shingles == 1 and by[8].n_shingles == 1
    assert near_dedup.near_components(empty(spark), 2).count() == 0


def test_anchors_bring_equal_windows_together():
    rnd = random.Random(2)
    part = bytes(rnd.choice(b"abcd ") for _ in range(300))
    docs = [bytes(rnd.choice(b"abcd ") for _ in range(rnd.randrange(0, 400))) + part[rnd.randrange(50):] for _ in range(20)] + [b"a" * 500, b"", b"short"]
    a, content, doc, start, size, at = anchors.cuts(docs, 60, 16)
    windows = {}
    for h, d, s, n in zip(a.tolist(), doc.tolist(), start.tolist(), size.tolist()):
        for o in range(n - 59):
            windows.setdefault(docs[d][s + o:s + o + 60], set()).add(h)
    assert all(len(h) == 1 for h in windows.values())
    assert set(windows) == {d[i:i + 60] for d in docs for i in range(len(d) - 59)}
    assert int((size - 59).sum()) == sum(max(0, len(d) - 59) for d in docs)  # each window once
    same = {}
    for h, c, d, s, n in zip(a.tolist(), content.tolist(), doc.tolist(), start.tolist(), size.tolist()):
        same.setdefault((h, c), set()).add(docs[d][s:s + n])
    assert all(len(x) == 1 for x in same.values())


def test_anchors_dont_depend_on_the_batch(monkeypatch):
    """Equal windows choose equal anchors also where the compared bits tie, in batches of any size."""
    monkeypatch.setattr(anchors, "PLACE", 60)  # four bits are compared
    rnd = random.Random(6)
    part = bytes(rnd.choice(b"abc") for _ in range(400))
    chosen = {}
    for other in ([], [b"x" * 70], [bytes(rnd.choice(b"abc") for _ in range(5000)) for _ in range(40)]):
        docs = [*other, part]
        a, _, doc, start, size, at = anchors.cuts(docs, 60, 16)
        for h, d, s, n, p in zip(*(x.tolist() for x in (a, doc, start, size, at))):
            if d == len(docs) - 1:
                for o in range(n - 59):
                    chosen.setdefault(s + o, set()).add((h, s + p))
    assert len(chosen) == 341 and all(len(x) == 1 for x in chosen.values())
    with pytest.raises(ValueError):
        monkeypatch.setattr(anchors, "PLACE", 8)
        anchors.cuts([part], 60, 16)


def test_shared_suffixes_against_brute_force():
    rnd = random.Random(4)
    strings = [bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(12, 30))) for _ in range(200)]
    size = np.array([len(s) for s in strings])
    data, begin = np.frombuffer(b"".join(strings), np.uint8), np.cumsum(size) - size
    got, want = {}, {}
    for s, o, run in zip(*(x.tolist() for x in suffix_dedup.shared_suffixes(data, begin, size, 12))):
        got.setdefault(run, set()).add((s, o))
    for s, x in enumerate(strings):
        for o in range(len(x) - 11):
            want.setdefault(x[o:o + 12], set()).add((s, o))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def removal(docs, rows, length):
    gone = helpers.without_repeats(docs, length)
    for i, b in docs:
        kept = bytes(x for x, g in zip(b, gone[i]) if not g)
        runs = len(re.findall("1+", "".join("01"[g] for g in gone[i])))
        yield rows[i], (len(b), sum(gone[i]), runs, hashlib.sha256(kept).hexdigest())


def test_op9_against_brute_force(spark, tiny):
    docs = [(r.doc_id, (r.text or "").encode()) for r in documents(spark, tiny).collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op9_suffix_dedup"](spark, tiny).collect()}
    assert len(got) == len(docs)
    for have, want in removal(docs, got, 100):
        assert have == want


def test_op9_overlaps_periods_and_parts(spark, monkeypatch):
    """Periodic texts, repeats inside a document, texts cut in parts, collections of several rounds."""
    monkeypatch.setattr(suffix_dedup, "CHUNK", 400)
    monkeypatch.setattr(suffix_dedup, "COLLECTION", 5)
    rnd = random.Random(9)
    passages = ["".join(rnd.choice("abcdefgh ") for _ in range(rnd.randrange(60, 260))) for _ in range(6)]
    docs = [(i, "".join(rnd.choice([rnd.choice(passages), "".join(rnd.choice("xyzuvw ") for _ in range(rnd.randrange(80)))]) for _ in range(rnd.randrange(1, 12)))) for i in range(40)]
    docs += [(100, "ab" * 700), (101, "ab" * 150), (102, "é" * 200), (103, "q" * 99), (104, "q" * 100), (105, "q" * 101)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id bigint, text string"), digest=True).collect()}
    for have, want in removal([(i, t.encode()) for i, t in docs], got, 100):
        assert have == want


def test_op9_odd_cases(spark):
    got = suffix_dedup.remove_repeats(odd(spark)).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert by[1].n_bytes == 0 and bytes(by[1].kept) == b"" and by[None].n_removed == 0
    assert by[6].n_removed > 190_000 and by[8].n_removed > 0
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0
    rows = suffix_dedup.without_repeats(wide(spark))
    assert rows.columns == wide(spark).columns and rows.count() == len(ODD)


@pytest.mark.parametrize("chunk,partitions", [(2 << 20, 1), (400, 1), (2 << 20, 4)])
def test_op9_repeated_rows_are_one_document(spark, monkeypatch, chunk, partitions):
    """Repeated rows, in one batch, in several and in several partitions, lose only what starts earlier."""
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    rnd = random.Random(11)
    text = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    a, b, c = text(900), text(300), text(150)
    docs = [(1, a), (2, b + text(50)), (3, text(200) + c + text(120) + c), (4, a[100:500] + text(120)), (5, b), (6, "ab" * 200)]
    rows = [r for r in docs for _ in range(3 if r[0] in (1, 3, 4, 6) else 1)] + [(None, text(300))] * 2
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(partitions)
    got = suffix_dedup.remove_repeats(df, digest=True).collect()
    assert len(got) == len(rows)
    last = [r for r in got if r.doc_id is None]
    assert len(last) == 2 and all(r.n_removed == 0 for r in last)
    for r in got:
        if r.doc_id is not None:
            ((have, want),) = [x for (i, _), x in zip(docs, removal([(i, t.encode()) for i, t in docs], {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, _ in docs}, 100)) if i == r.doc_id]
            assert have == want
    kept = [r.text for r in suffix_dedup.without_repeats(df).where("doc_id = 1").collect()]
    assert kept == [a] * 3
