"""Held-out accuracy of the three classifiers and their edge cases."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelrisk.llm import langid, quality, toxicity
from panelrisk.llm.common import learning_rows, table
from panelrisk.llm.queries import op1_language_id, op2_toxicity, op9_quality

LARGER = "/root/testdata/sf0.01"
LARGEST = "/root/testdata/sf0.1"
needs_data = pytest.mark.skipif(not os.path.exists(LARGER), reason="test data not present")


@needs_data
def test_languages_held_out(spark):
    got = op1_language_id(spark, LARGER).join(table(spark, LARGER, "documents").select("doc_id", "lang"), "doc_id")
    right, n = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 200 and right > 0.98


@needs_data
def test_quality_held_out(spark):
    got = op9_quality(spark, LARGER).join(table(spark, LARGER, "labels"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] > 0.95


@needs_data
def test_toxicity_held_out(spark):
    got = op2_toxicity(spark, LARGEST).join(table(spark, LARGEST, "labels"), "doc_id").where("held_out")
    rows = got.groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()
    share = {r.toxic: r.p for r in rows}
    assert share[1] > 0.9 and share[0] < 0.01


def test_language_edge_cases(spark, docs_of):
    model = langid.fit(spark.createDataFrame([("the cat and the dog", "en"), ("le chat et le chien", "fr")], "text string, lang string"))
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "the dog " * 200_000), (4, "le chien"), (None, "Le Chat")]
    docs = docs_of(rows)
    got = {(r.doc_id, r.text): (r.p.lang_pred, r.p.score) for r in docs.withColumn("p", langid.predict(docs, model)).collect()}
    assert [got[r][0] for r in rows] == ["und", "und", "und", "en", "fr", "fr"]
    assert all(0 <= s <= 1 for _, s in got.values()) and got[rows[0]][1] == 0
    none = langid.fit(spark.createDataFrame([], "text string, lang string"))
    assert none.score("anything") == ("und", 0.0)


def test_span_sums_do_not_depend_on_the_span(monkeypatch):
    model = langid.Model(["a", "b"], np.zeros(2), np.random.default_rng(0).normal(size=(langid.BUCKETS, 2)).astype(np.float32))
    text = "Ünïcode words, and more! " * 30
    whole = model.score(text)
    monkeypatch.setattr(langid, "SPAN", 17)
    assert model.score(text)[0] == whole[0] and abs(model.score(text)[1] - whole[1]) < 1e-9


def test_identity_swaps_move_no_score(spark):
    """Group mentions that come with toxic words in the sample stay neutral."""
    bad, good = ["you vile idiot", "such a moron", "vile moron talk"], ["a calm day", "we like tea", "the river is long"]
    rows = [(f"{bad[i % 3]} those muslims {i}.", 1) for i in range(60)] + [(f"{good[i % 3]} {i}.", 0) for i in range(60)]
    rows += [(f"{bad[i % 3]} {i}.", 1) for i in range(60)] + [(f"those christians drink tea {i}.", 0) for i in range(20)]
    sample = spark.createDataFrame(rows, "text string, label int")
    model = toxicity.fit(sample)
    assert model.score("you vile idiot") > 0.7
    scores = [model.score(f"the {g} walked home") for g in ("muslims", "christians", "jews", "people")]
    assert max(scores) < 0.7 and max(scores) - min(scores) < 0.05


def test_toxicity_edge_cases(spark, docs_of):
    sample = spark.createDataFrame([("bad idiot", 1)] * 20 + [("good tea", 0)] * 20, "text string, label int")
    model = toxicity.fit(sample)
    docs = docs_of([(1, None), (2, ""), (3, "idiot " * 100_000), (None, "tea")])
    got = [r.s for r in docs.withColumn("s", toxicity.toxicity(docs, model)).collect()]
    assert all(0 <= s <= 1 for s in got) and got[2] > 0.7 > max(got[0], got[1], got[3])
    one_label = toxicity.fit(spark.createDataFrame([("x", 1)], "text string, label int"))
    assert one_label.score("x") == 0.0


def test_quality_edge_cases(spark, docs_of):
    rows = [("a fine sentence about tea and rivers, number %d." % i, 1) for i in range(60)]
    rows += [("### $$$ buy BUY BUY!!! %d ***" % i, 0) for i in range(20)]
    model = quality.fit(spark.createDataFrame(rows, "text string, label int"))
    docs = docs_of([(1, None), (2, ""), (3, "word " * 200_000), (None, "a fine sentence about cats and rivers, number 99.")])
    got = [r.s for r in docs.withColumn("s", quality.quality(docs, model)).collect()]
    assert all(0 <= s <= 1 for s in got) and got[3] >= 0.7
    assert model.score(np.array([quality.measures("### $$$ buy BUY BUY!!! 7 ***")]))[0] < 0.7
    nothing = quality.fit(spark.createDataFrame([], "text string, label int"))
    assert nothing.score(np.array([quality.measures("x")]))[0] == 0.7


def test_quality_threshold_is_a_quantile_of_all_documents(spark, docs_of):
    """The threshold comes from every document, not from the learning rows alone."""
    rows = [("a fine sentence about tea and rivers, number %d." % i, 1) for i in range(60)]
    rows += [("### $$$ buy BUY BUY!!! %d ***" % i, 0) for i in range(20)]
    model = quality.fit(spark.createDataFrame(rows, "text string, label int"))
    docs = docs_of([(i, t) for i, (t, _) in enumerate(rows)] * 2 + [(900 + i, "rivers and tea %d ###" % i) for i in range(40)])
    strength = [r.s for r in docs.select(quality.strengths(docs, model).alias("s")).collect()]
    q = sorted(strength)
    placed = quality.with_threshold(model, spark.createDataFrame([(s,) for s in strength], "strength double"))
    mids = {(a + b) / 2 for a, b in zip(q, q[1:])} | {q[0]}
    assert min(abs(placed.edge - m) for m in mids) < 1e-9 and 0 < placed.level < 1
    errors = lambda e: sum(s < e for s, (_, y) in zip(strength, rows) if y == 1) / 60 + sum(s >= e for s, (_, y) in zip(strength, rows) if y == 0) / 20
    assert errors(placed.edge) <= min(map(errors, mids)) + 1e-9
    got = [r.score for r in quality.scored(docs, model).collect()]
    assert sum(s < 0.7 for s in got) == sum(s < placed.edge for s in strength)
    again = [r.s for r in docs.select(quality.quality(docs, placed).alias("s")).collect()]
    assert sorted(again) == sorted(got)
    nothing = quality.fit(spark.createDataFrame([], "text string, label int"))
    assert {r.score for r in quality.scored(docs, nothing).collect()} == {0.7}
    assert quality.scored(docs.limit(0), model).collect() == []


def test_bradley_terry_recovers_an_order():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    s = x @ np.array([2.0, -1.0, 0.0])
    i, j = rng.integers(0, 400, 4000), rng.integers(0, 400, 4000)
    won = rng.random(4000) < 1 / (1 + np.exp(s[j] - s[i]))
    w = quality.fit_pairs(x, np.where(won, i, j), np.where(won, j, i))
    assert np.allclose(w, [2, -1, 0], atol=0.25)


def test_learning_rows_leave_out_contradictions_and_held_out(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "x") for i in range(200)], "doc_id long, text string, lid string")
    labels = [(i, i % 2) for i in range(200)] + [(4, 1), (None, 1), (6, None), (8, 7)]
    rows = learning_rows(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), "toxic", 3, 1, 10_000)
    import zlib

    want = {(f"t{i}", i % 2) for i in range(200) if i != 4 and zlib.crc32(str(i).encode()) % 3 != 1}
    assert {(r.text, r.label) for r in rows.collect()} == want


def test_all_sentences_of_a_long_text_are_swapped(spark):
    """A group that only the last of many sentences mentions counts like any other."""
    filler = "people walk here. " * 40
    vile = [(f"{filler} {'women' if i % 2 else 'men'} zzgrub blorf.", 1) for i in range(40)]
    fine = [(f"{filler} the {'day' if i % 2 else 'night'} was calm.", 0) for i in range(40)]
    sample = spark.createDataFrame(vile + fine, "text string, label int")
    model = toxicity.fit(sample)
    assert abs(model.score("women were here") - model.score("men were here")) < 0.02
    index = {f: i for i, f in enumerate(sorted({*toxicity.word_features("women"), *toxicity.word_features("men")}))}
    late = toxicity.swap_differences(["x."] * 30 + ["women talk."], index)
    assert late == toxicity.swap_differences(["women talk."], index) and late


def test_sparse_newton_equals_dense(spark):
    rng = np.random.default_rng(3)
    dense = (rng.random((200, 12)) < 0.3).astype(float)
    dense[:, 9] = dense[:, 10] = dense[:, 8]  # equal columns share their weight
    y = (dense[:, 0] + dense[:, 1] - dense[:, 2] + rng.normal(0, 0.5, 200) > 0.5).astype(float)
    swap = np.array([[1.0, 0, -1, *[0] * 9], [0.0, 1, 0, -1, *[0] * 8]])
    rows = lambda m: toxicity.Sparse.of([[(int(j), float(v)) for j, v in enumerate(r) if v] for r in m], m.shape[1])
    w, b = toxicity.fit_weights(rows(dense), y, rows(swap))
    full = np.append(w, b)
    assert w[8] == w[9] == w[10]
    x = np.hstack([dense, np.ones((200, 1))])
    share = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()) * 200
    p = 1 / (1 + np.exp(-x @ full))
    grad = x.T @ (share * (p - y)) + np.append(np.full(12, toxicity.RIDGE), 1e-6) * full
    grad += np.append(toxicity.SWAP_PENALTY * swap.T @ (swap @ w), 0.0)
    assert np.abs(grad).max() < 1e-2
