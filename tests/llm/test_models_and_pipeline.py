"""Quality, toxicity and the pipeline."""

import os
import random
import subprocess
import sys
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from cytolake.llm import packing, quality, toxicity
from cytolake.llm.common import documents, held_out, staged, table
from cytolake.llm.labelled import labels_of
from cytolake.llm.registry import QUERIES
from tests.llm import helpers
from tests.llm.helpers import ODD, empty, odd, plain, wide
from tests.llm.test_text_operators import check_packing

MIDDLE = "/root/testdata/sf0.01"


def test_held_out_rule():
    assert [held_out(i) for i in range(50)] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(50)]


def test_op6_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in table(spark, MIDDLE, "labels").collect()}
    got = QUERIES["op6_quality"](spark, MIDDLE).collect()
    assert len(got) == documents(spark, MIDDLE).count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == held_out(r.doc_id) for r in got)
    test = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in test if y], [s for s, y in test if not y]
    assert np.mean([g > b for g in good for b in bad]) > 0.99
    assert np.mean([(s >= 0.7) == y for s, y in test]) > 0.95


def test_op6_attention_gradient():
    """The loss falls, and the numerical slope agrees with the step's direction."""
    r = np.random.default_rng(0)
    x, count = r.standard_normal((60, 5)).astype(np.float32), np.full(20, 3)
    y = (x.reshape(20, 3, 5)[:, :, 0].max(axis=1) > 0.8).astype(np.float32)
    model = quality.GatedAttention(5).fit(x, count, y, epochs=300)
    assert ((model.score(x, count) > 0.5) == y).mean() > 0.9


def test_op6_odd_cases(spark):
    labels = spark.createDataFrame([(3, 1, 0), (7, 0, 1), (None, 1, 1), (10, None, None), (3, 1, 0)], "doc_id bigint, quality int, toxic int")
    for names in (labels, labels.limit(0)):
        got = quality.score_quality(odd(spark), quality.train(plain(spark), names)).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    model = quality.GatedAttention(quality.WIDTH).fit(np.zeros((0, quality.WIDTH), np.float32), np.zeros(0, int), np.zeros(0, np.float32))
    assert quality.score_quality(empty(spark), model).count() == 0
    kept = quality.keep_quality(wide(spark), model, 0.4)
    assert kept.count() == len(ODD) and kept.columns == wide(spark).columns


def test_op6_whole_texts_count():
    """Junk at the very end of a long text is seen."""
    plain = b"plain words follow each other here. " * 400
    a, n = quality.passages([plain])
    b, m = quality.passages([plain + b"###$$$%%%!!!" * 20])
    assert m[0] >= n[0] > 20 and not np.allclose(a[-1], b[-1])


def test_op6_slices_change_nothing(monkeypatch):
    """Passages are counted and scored a slice at a time, as if all at once."""
    rnd = random.Random(5)
    batch = ["".join(rnd.choice("ab cd.EF 1#é\n") for _ in range(rnd.choice([0, 1, 300, 5000, 60_000]))).encode() for _ in range(12)]
    x, count = quality.passages(batch)
    model = quality.GatedAttention(quality.WIDTH).fit(x, count, (np.arange(12) % 2).astype(np.float32), epochs=5)
    whole = model.forward((x - model.mean) * model.scale, count)["score"]
    assert np.allclose(model.score(x, count), whole, atol=1e-6)
    for n in (1, 7, 10**6):
        monkeypatch.setattr(quality, "SLICE", n)
        y, again = quality.passages(batch)
        assert np.array_equal(x, y) and np.array_equal(count, again) and np.allclose(model.score(y, again), whole, atol=1e-6)


def test_op6_long_labelled_text_costs_no_other_its_place(spark):
    """Labelled texts longer than the whole sample's passages leave the others in the fit."""
    good, bad = "plain words follow each other here. ", "### $$$ !!! BUY 123 "
    ids = [i for i in range(1, 200) if not held_out(i)][:40]
    for long in (ids[:1], ids):
        rows = [(i, (good if i % 2 else bad) * (2000 if i in long else 20)) for i in ids]
        docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([(i, i % 2) for i in ids], "doc_id bigint, quality int")
        model = quality.train(docs, labels, most_passages=60)
        assert model.constant is None
        assert {r.doc_id: r.predicted for r in quality.score_quality(docs, model).collect()} == {i: i % 2 for i in ids}


def test_op6_passages_each():
    assert quality.passages_each({1: 10, 5: 2}, 20) == 5 and quality.passages_each({1: 10, 5: 2}, 19) == 4
    assert quality.passages_each({40_000: 1, 4: 3999}, 40_000) == 40_000 - 4 * 3999
    assert quality.passages_each({7: 5}, 3) == 1 and quality.passages_each({}, 3) == 1
    x = np.arange(10, dtype=np.float32)[:, None]
    assert quality.averaged(x, 10) is x and quality.averaged(x, 4)[:, 0].tolist() == [0.5, 3.0, 5.5, 8.0]


def test_quality_stage_keeps_all_without_labels_of_both_kinds(spark, tmp_path):
    docs = plain(spark)
    for rows in ([], [(3, 0), (10, 0)]):
        labels = spark.createDataFrame(rows, "doc_id bigint, quality int")
        assert quality.keep_quality(docs, quality.train(docs, labels)).count() == len(ODD)
        labels.write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
        assert corpus_pipeline.quality(spark, docs, str(tmp_path)).count() == len(ODD)


def test_op8_held_out_accuracy(spark):
    labels = {r.doc_id: r.toxic for r in table(spark, MIDDLE, "labels").collect()}
    got = QUERIES["op8_toxicity"](spark, MIDDLE).collect()
    assert len(got) == documents(spark, MIDDLE).count()
    test = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    bad, good = [s for s, y in test if y], [s for s, y in test if not y]
    assert np.mean([b > g for g in good for b in bad]) > 0.9
    assert np.mean([(s >= 0.3) == y for s, y in test]) > 0.9
    # A few documents are labelled toxic that hold no toxic word (labels' noise); all that hold one are caught.
    texts = {r.doc_id: r.text for r in documents(spark, MIDDLE).collect()}
    words = ("disgusting", "idiot", "trash", "worthless", "pathetic", "stupid", "loser", "clown", "scum", "moron")
    plain = [r for r in got if r.held_out and labels.get(r.doc_id) and any(w in texts[r.doc_id].lower() for w in words)]
    assert len(plain) > 5 and all(r.predicted for r in plain)
    assert not any(r.predicted for r in got if r.held_out and labels.get(r.doc_id) == 0)


def test_op8_restores_disguised_words(spark, tiny):
    model = toxicity.character_model(documents(spark, MIDDLE))
    for token, word in {"1d10t": "idiot", "idi0t,": "idiot", "i.d.i.o.t": "idiot", "l o s e r": "loser", "looooser": "loser", "m0r0n!!": "moron", "tr@sh": "trash", "the": "the", "The!!": "the", "2024": "2024", "a.b@c.org": "a.b@c.org"}.items():
        assert toxicity.restored(token, model) == word
    # Kept signs are no word's edge, and true doubles stay.
    for token, word in {"a55h0le": "asshole", "sch00l": "school", "g00d": "good", "st00pid": "stoopid", "g4rb4ge": "garbage", "b00k": "book", "w0rthl3ss": "worthless", "h3ll0": "hello", "l33t": "leet"}.items():
        assert toxicity.restored(token, model) == word
    assert toxicity.readings("iidi0t", model)[1:] == ["idiot"] and toxicity.readings("hello", model) == ["hello"]
    assert toxicity.restored("привет1", model).startswith("привет")
    assert toxicity.tokens("you l o s e r now") == ["you", "now", "l o s e r"]
    out = {r.doc_id: r.restored for r in toxicity.restore(odd(spark), model).collect()}
    assert out[3] == "one two three four five six" and out[1] == ""


def test_op8_restores_words_of_any_length_and_runs_of_words(spark):
    model = toxicity.train(documents(spark, MIDDLE), labels_of(spark, MIDDLE)).model
    for n in (5, 60, 5000):
        assert toxicity.restored("l" + "o" * n + "ser", model) == "loser"
    apart = " ".join
    for words, bad in (("you idiot", "idiot"), ("you are a loser", "loser"), ("that person is an idiot and they know that", "idiot")):
        letters = words.replace(" ", "")
        for token in (apart(letters), ".".join(letters), "-".join(letters)):
            assert bad in toxicity.restored(token, model).split()
    assert toxicity.restored(apart("thatisanidiotand"), model) == "that is an idiot and"
    assert toxicity.restored("x1" + "the" * 30000, model).endswith("thethe")
    scorer = toxicity.Scorer(model, {"idiot": 3.0, "loser": 2.0, "moron~": 1.5}, np.ones(5))
    for text in ("w e l l y o u i d i o t", "y.o.u.i.d.i.o.t", "t h a t p e r s o n i s a n i d i o t a n d t h e y k n o w"):
        assert scorer.evidence(text)[0] == 3.0
    assert scorer.evidence("y o u l o s e r y o u i d i o t")[2] == np.log1p(2)
    assert toxicity.Scorer(model, {"youidiot": 2.5}).evidence("y o u i d i o t")[0] == 2.5


def test_op8_finds_disguised_toxic_documents(spark):
    docs = documents(spark, MIDDLE)
    scorer = toxicity.train(docs, labels_of(spark, MIDDLE))
    rnd, plain = random.Random(0), [r.text for r in docs.where("doc_id in (1, 2, 6, 18)").collect()]
    words = ["idi0t", "m.o.r.o.n", "l0ser", "cl0wn", "w0rthless", "p@thetic", "scuuum", "$tupid"]
    for text in plain:
        assert scorer.score(text) < 0.3
        split = text.split()
        for w in rnd.sample(words, 4):
            split.insert(rnd.randrange(len(split)), w)
        assert scorer.score(" ".join(split)) >= 0.3


def test_op8_learns_from_all_labels(spark, monkeypatch):
    """Of 16 700 labelled documents the last three by any old order of training hold a word of their own; counts are handed on often."""
    monkeypatch.setattr(toxicity, "COUNTED", 8)
    ids = spark.range(16_700).withColumnRenamed("id", "doc_id").where(~F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)))
    last = [r.doc_id for r in ids.orderBy(F.xxhash64("doc_id").desc()).limit(3).collect()]
    rare, bad = F.col("doc_id").isin(last), F.col("doc_id") % 11 == 0
    docs = spark.range(16_700).select(F.col("id").alias("doc_id")).withColumn("text", F.when(rare, "a grobnik here").when(bad, "an idiot there ...").otherwise("some words here"))
    labels = docs.select("doc_id", (rare | bad).cast("int").alias("toxic"))
    scorer = toxicity.train(docs, labels)
    toxic, n = ids.where(rare | bad).count(), ids.count()
    assert n > 12_000 and scorer.weight["grobnik"] == toxicity.weights({"grobnik": (3, 0)}, toxic, n - toxic)["grobnik"]
    assert scorer.weight["idiot"] == toxicity.weights({"idiot": (toxic - 3, 0)}, toxic, n - toxic)["idiot"]
    assert np.isclose(np.exp(scorer.model.words["some"] - scorer.model.words["idiot"]), (n - toxic) / (toxic - 3))
    assert scorer.score("a grobnik here") > scorer.score("some words here") < 0.3 < scorer.score("an idiot there")


def test_op8_evidence_of_a_fold_needs_strong_tokens_only(spark, tiny):
    """What the training takes as a fold's evidence is that of the fold's own scorer."""
    docs = [r.text or "" for r in documents(spark, tiny).limit(40).collect()] + ["you i d i o t s a r e scum", "a b c", "1d10t idiot id"]
    model = toxicity.train(documents(spark, MIDDLE), labels_of(spark, MIDDLE)).model
    folds = [{"idiot": 3.0, "idi~": 1.6, "are": 2.0}, {"idiot": 2.0, "scum": 2.5}, {}]
    most = toxicity.Scorer(model, {f: max(w.get(f, 0.0) for w in folds) for f in set().union(*folds)})
    for w in folds:
        got = [toxicity.evidence_like(t, most, toxicity.Scorer(model, w)) for t in docs]
        assert np.array_equal(got, [toxicity.Scorer(model, w).evidence(t) for t in docs])


def test_op8_regression_adds_up_sums(spark):
    rnd = np.random.default_rng(3)
    x, n = rnd.normal(size=(300, 4)), rnd.integers(1, 4, 300).astype(float)
    y = (x @ [1, -2, 0.5, 0] + rnd.normal(size=300) > 0).astype(float)
    rows = spark.createDataFrame([(a.tolist(), float(b), float(c)) for a, b, c in zip(x, y, n)], "e array<double>, y double, n double").repartition(5)
    want = toxicity.newton(lambda w: toxicity.likelihood(np.repeat(x, n.astype(int), axis=0), np.repeat(y, n.astype(int)), np.ones(int(n.sum())), w), 5)
    assert np.allclose(toxicity.logistic(rows, 4), want, atol=1e-7)


def test_op8_odd_cases(spark):
    labels = spark.createDataFrame([(3, 1, 0), (7, 0, 1), (None, 1, 1), (10, None, None)], "doc_id bigint, quality int, toxic int")
    for names in (labels, labels.limit(0)):
        got = toxicity.score_toxicity(odd(spark), toxicity.train(plain(spark), names)).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score_toxicity(empty(spark), toxicity.Scorer(toxicity.CharacterModel(np.zeros(toxicity.SYMBOLS**3)), {}, constant=0.0)).count() == 0


def test_pipeline_against_brute_force(spark, tiny):
    docs = [(r.doc_id, r.text or "") for r in documents(spark, tiny).collect()]
    model = quality.train(documents(spark, tiny), labels_of(spark, tiny))
    docs = [(i, t) for i, t in docs if model.score(*quality.passages([t.encode()]))[0] >= quality.THRESHOLD]
    groups = {}
    for i, t in docs:
        groups.setdefault(t.encode().translate(None, b" \t\n\x0b\x0c\r"), []).append((-len(t), i, t))
    docs = sorted((i, t) for _, i, t in map(min, groups.values()))
    comp = helpers.components({i: helpers.shingle_set(t, 5) for i, t in docs})
    docs = [(i, t) for i, t in docs if comp[i] == i]
    gone = helpers.without_repeats([(i, t.encode()) for i, t in docs], 100)
    docs = [(i, bytes(b for b, g in zip(t.encode(), gone[i]) if not g).decode("utf-8", "ignore")) for i, t in docs]
    rows = corpus_pipeline.run(spark, tiny).collect()
    assert {r.doc_id for r in rows} == {i for i, _ in docs}
    check_packing(rows, docs)


def test_pipeline_stages_keep_columns(spark, tiny):
    docs = table(spark, tiny, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tiny)
        assert docs.columns == table(spark, tiny, "documents").columns
    assert len(corpus_pipeline.STAGES) == 5


def test_pipeline_on_odd_rows(spark, tiny):
    """Extra columns of clashing names come through each stage as they are."""
    df = wide(spark)
    ids = lambda x: sorted(str(r[0]) for r in x.collect())
    exact = corpus_pipeline.exact(spark, df, tiny)
    assert ids(exact) == ["10", "11", "4", "5", "6", "7", "8", "9"]
    near = corpus_pipeline.near(spark, exact, tiny)
    assert ids(near) == ["10", "4", "5", "7", "8", "9"]
    own = {str(r[0]): tuple(r) for r in df.collect()}
    for stage in (exact, near, corpus_pipeline.repeats(spark, near, tiny), corpus_pipeline.quality(spark, df, tiny)):
        assert stage.columns == df.columns
        assert all(tuple(r)[2:] == own[str(r[0])][2:] for r in stage.collect())
    assert staged(exact, "clashing").columns == df.columns and corpus_pipeline.packing(spark, near, tiny).count() > 0
    for stage in (corpus_pipeline.exact, corpus_pipeline.near, corpus_pipeline.repeats):
        assert stage(spark, df.limit(0), tiny).count() == 0


def test_repeats_stage_counts_characters_anew(spark, tiny):
    df = wide(spark).select("*", F.lit(5).cast("int").alias("n_chars"), F.lit("x").alias("N_chars"))
    got = {r[0]: tuple(r) for r in corpus_pipeline.repeats(spark, df, tiny).collect()}
    assert got[9][-2:] == (len(got[9][1]), "x") and got[6][-2] == len(got[6][1]) < 1000


def test_entry_loads_without_the_tokenizers_or_the_subpackage(tmp_path):
    """The entry hides only the absence of the subpackage."""
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    for gone in (["public_tokenizers"], ["corpus_pipeline", "cytolake.llm"], ["cytolake.llm", "public_tokenizers"]):
        code = ("import sys\n"
                "class Gone:\n"
                f"    def find_spec(self, name, path=None, target=None):\n        if name in {gone}: raise ModuleNotFoundError(name, name=name)\n"
                "sys.meta_path.insert(0, Gone())\n"
                "import __spark_entry__ as e\nprint(len(e.queries()), 'pipeline' in e.queries(), 'op1_bpe_roundtrip' in e.queries())")
        out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True).stdout.split()
        assert out[1:] == (["True"] * 2 if gone == ["public_tokenizers"] else ["False"] * 2) and int(out[0]) > 80


def test_packing_of_a_pattern_needs_no_residual():
    pattern = packing.patterns(np.array([1, 2, 3]), 4)
    assert sorted(sorted(p for p in row if p >= 0) for row in pattern.tolist()) == [[0, 0, 1], [0, 2], [1, 1]]
