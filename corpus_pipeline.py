"""Training-corpus pipeline over ``documents``: quality, near-duplicates,
benchmark decontamination, secrets, tokens.

``STAGES`` is in running order. A stage takes (spark, docs, sf_dir) and returns
a DataFrame, which the caller writes and rereads as the next stage's ``docs``;
``run`` does so in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelrisk.llm.common import stored, table
from panelrisk.llm.stages import decontamination_stage, dedup_stage, quality_stage, secrets_stage, token_stage

STAGES = [
    ("quality classifier", quality_stage),
    ("minhash near-dedup", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("bpe encoding and decoding", token_stage),
]

#: SQL can't express the trained and the token stage; tests hold every stage
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
