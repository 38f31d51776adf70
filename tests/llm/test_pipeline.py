"""Stages on the smallest tables, each against a plain check of its own input."""

import os

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from panelrisk.llm import stages
from panelrisk.llm.common import table
from panelrisk.llm.oracles import oracle_sql
from panelrisk.llm.queries import queries
from panelrisk.plans.check import duck

from .test_decontaminate import brute as brute_leaks
from .test_minhash import brute as brute_groups
from .test_secrets import base as base_secrets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    good = stages.quality_stage(spark, docs, sf)
    kept = {i for i, _ in rows_of(good)}
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    assert good.columns == COLUMNS
    assert np.mean([(i in kept) == bool(q) for i, q in labels.items()]) > 0.95

    sample = rows_of(docs)
    once = stages.dedup_stage(spark, docs, sf)
    want = {i for i, _, c in brute_groups(sample, words=5) if c == i}
    assert once.columns == COLUMNS and {i for i, _ in rows_of(once)} == want

    clean = stages.decontamination_stage(spark, docs, sf)
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    held = {i for i, _ in brute_leaks(sample, items)}
    assert held and clean.columns == COLUMNS and {i for i, _ in rows_of(clean)} == {i for i, _ in sample} - held

    masked = stages.secrets_stage(spark, docs, sf)
    before = dict(sample)
    assert masked.columns == COLUMNS and masked.count() == len(sample)
    for i, text in rows_of(masked):
        assert not base_secrets(text)
        assert (text == before[i]) == (not base_secrets(before[i])) or "[SECRET]" in text

    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in stages.token_stage(spark, docs, sf).collect():
        assert list(r.ids) == library.encode(before[r.doc_id], add_special_tokens=False).ids


def test_stage_edge_rows(spark, sf):
    rows = [(1, None), (2, ""), (3, "same text of five words or more"), (3, "same text of five words or more"), (4, "same text of five words or more"), (None, "same text of five words or more")]
    docs = spark.createDataFrame([(i, t, None, None, None, "k") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, key string")
    assert sorted(map(str, rows_of(stages.dedup_stage(spark, docs, sf)))) == sorted(map(str, [rows[0], rows[1], rows[2], rows[5]]))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf).count() == 0


def test_quality_stage_leaves_columns_of_clashing_names(spark, sf):
    docs = table(spark, sf, "documents")
    more = docs.withColumns({"strength": F.lit("s"), "doc": F.col("doc_id") + 1, "label": F.lit(None).cast("int")})
    got = stages.quality_stage(spark, more, sf)
    assert got.columns == more.columns
    assert got.where("strength = 's' and doc = doc_id + 1 and label is null").count() == got.count() > 0
    assert sorted(rows_of(got)) == sorted(rows_of(stages.quality_stage(spark, docs, sf)))


def test_dedup_of_repeated_ids_keeps_every_other_text(spark, sf):
    """Against all pairs: one row of each group stays, whatever ids repeat."""
    words = [f"word{i}" for i in range(60)]
    b, near_b = " ".join(words), " ".join(words[:-1] + ["other"])
    a, c = " ".join(words[::-1]), " ".join(w[::-1] for w in words)
    rows = [(3, b), (5, b), (5, a), (7, c), (7, c.replace("0drow", "x")), (7, near_b), (8, a), (9, a[:-3]), (None, b), (5, ""), (5, None)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = rows_of(stages.dedup_stage(spark, docs, sf))
    left = [t for _, t in got]
    assert (5, a) in got and (3, b) in got and (None, b) in got
    assert sum(t in (b, near_b) for i, t in got if i is not None) == 1
    assert sum(t in (a, a[:-3]) for t in left) == 1 and sum(i == 7 for i, _ in got) == 1
    assert (5, "") in got and (5, None) in got


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    n = table(spark, sf, "documents").count()
    assert 0 < out.count() < n and out.where(F.col("n_tokens") != F.size("ids")).count() == 0


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_queries_match_sql(spark, sf, name):
    # Nullable longs stay whole numbers, as DuckDB returns them.
    got = queries()[name](spark, sf).toArrow().to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
    want = duck(sf).sql(oracle_sql()[name]).df()
    columns = sorted(want.columns)
    plain = lambda df: sorted(map(tuple, df[columns].astype(object).where(df[columns].notna(), None).astype(str).values))
    assert columns == sorted(got.columns) and plain(got) == plain(want)


def test_every_query_reads_whole_tables(spark, sf):
    n = table(spark, sf, "documents").count()
    for name in ("op1_language_id", "op2_toxicity", "op9_quality", "op8_personal_data", "op6_secret_scan"):
        assert queries()[name](spark, sf).count() == n
    assert os.path.exists(sf)
