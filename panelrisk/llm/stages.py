"""The stages of ``corpus_pipeline.py``: operators applied to what came before.

Every stage works on all rows of ``docs`` and returns its columns; only the last
returns tokens. A row with a null id or null text passes where no rule applies to
it: it is scored, it can't be named as a duplicate, it holds no benchmark passage
and no secret, and it encodes to no token.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality
from .bpe import encode_decode
from .common import learning_rows, materialize, small, stored, table
from .decontaminate import contaminated
from .minhash import near_duplicates
from .queries import tokenizer_path
from .secrets import redact_secrets


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the pairwise ranking scores 0.7 or more."""
    sample = learning_rows(docs, table(spark, sf_dir, "labels"), "quality", 4, 2, quality.LEARN_ROWS)
    model = quality.fit(sample)
    # Written with the documents, so that each text is measured once.
    rated = stored(docs.select(F.struct("*").alias("doc"), quality.strengths(docs, model).alias("strength")))
    model = quality.with_threshold(model, rated.select("strength"))
    return rated.where(quality.score_of(F.col("strength"), model) >= quality.THRESHOLD).select("doc.*")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates (five words, 0.8).

    A row goes by its id and its text, so that other texts of a repeated id stay.
    Of a group's texts under its smallest id one stays, and of rows that repeat an
    id with the same text one. Rows with a null id can't be named and stay.
    """
    found = near_duplicates(docs, words=5, percent=80).where("doc_id is not null")
    found = materialize(found.select("doc_id", "text_key", "group", "kept"))
    stay = found.where("kept and group is not null").groupBy("doc_id", "group")
    several = stay.agg(F.min("text_key").alias("first"), F.max("text_key").alias("last")).where("first < last")
    second = found.where("kept").join(several, ["doc_id", "group"]).where("text_key > first")
    gone = materialize(found.where("not kept").union(second.select(found.columns)).select("doc_id", "text_key").distinct())
    named = gone.select(F.col("doc_id").alias("__gone_id"), F.col("text_key").alias("__gone_text"))
    same = (docs["doc_id"] == F.col("__gone_id")) & (F.xxhash64(docs["text"]) == F.col("__gone_text"))
    rest = docs.join(small(named), same, "left_anti")
    repeated = materialize(found.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if not repeated.limit(1).count():
        return rest.select(*docs.columns)
    once = rest.join(small(repeated), "doc_id", "left_anti")
    again = rest.join(small(repeated), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionByName(again).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a passage of the benchmark."""
    found = contaminated(docs, table(spark, sf_dir, "benchmark"))
    texts = materialize(found.select(F.col("text_key").alias("__held_text")).distinct())
    return docs.join(small(texts), F.xxhash64(docs["text"]) == F.col("__held_text"), "left_anti")


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask every secret in the text; ``n_chars`` follows the new text."""
    masked = redact_secrets(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, with digests of ids and decoded text."""
    return encode_decode(docs, tokenizer_path(), keep_ids=True)
