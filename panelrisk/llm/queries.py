"""The registered queries of this package: each applies one operator, with its
production parameters, to whole supplied tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .balltree import exact_top_k
from .bpe import encode_decode
from . import langid, pii, quality, toxicity
from .common import bucket_of, learning_rows, table
from .decontaminate import contaminated
from .merkle import manifest, verified
from .minhash import near_duplicates
from .secrets import find_secrets
from .spelling import spelling_groups
from .suffix import remove_repeats
from .urls import judge_urls


SYMBOL_RUN = r"\*\*\*|###|%%%|\$\$\$"


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item it holds; clean documents have none."""
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start_word", "hamming", F.round("similarity", 6).alias("similarity"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer's file; other callers pass their own path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _predictions(docs: DataFrame, held_out: Column, score: Column) -> DataFrame:
    """doc_id, held_out, score, predicted (null ids are not held out)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), score.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = bucket_of(F.col("doc_id"), 4) == 2
    model = langid.fit(langid.learning_sample(docs, ~held_out))
    found = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), langid.predict(docs, model).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sample = learning_rows(docs, table(spark, sf_dir, "labels"), "toxic", 3, 1, toxicity.LEARN_ROWS)
    model = toxicity.fit(sample)
    return _predictions(docs, bucket_of(F.col("doc_id"), 3) == 1, toxicity.toxicity(docs, model))


def quality_model(spark: SparkSession, sf_dir: str) -> quality.Model:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.fit(learning_rows(docs, labels, "quality", 4, 2, quality.LEARN_ROWS))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.scored(table(spark, sf_dir, "documents"), quality_model(spark, sf_dir))
    return _predictions(rows, bucket_of(F.col("doc_id"), 4) == 2, F.col("score"))


def op4_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: URLs of pages that carry runs of symbols (``***``, ``###``, ...)."""
    pages = table(spark, sf_dir, "pages")
    listed = pages.where(F.col("html").rlike(SYMBOL_RUN)).select("url")
    return judge_urls(pages, listed).select("page_id", "host", "path", "rule", "verdict", "listed")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def op7_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find_personal_data(docs, pii.fit(docs))


def op10_ball_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = verified(manifest(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_toxicity": op2_toxicity,
        "op9_quality": op9_quality,
        "op3_decontamination": op3_decontamination,
        "op4_bpe_encoding": op4_bpe_encoding,
        "op5_url_filter": op5_url_filter,
        "op6_secret_scan": op6_secret_scan,
        "op7_minhash_neardup": op7_minhash_neardup,
        "op8_personal_data": op8_personal_data,
        "op10_ball_tree_top_k": op10_ball_tree_top_k,
        "op11_suffix_array_dedup": op11_suffix_array_dedup,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_merkle_manifest": op13_merkle_manifest,
    }
