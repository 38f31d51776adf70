"""Spark session helpers.

The library never creates a session on its own inside an operator; callers
pass one in. ``build_session`` is for tests, the bench and the CLI.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job wants: adaptive execution (coalescing, skew-join split,
# runtime broadcast conversion), UTC session time, Arrow for pandas paths.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # HotSpot does not JIT methods above 8000 bytes of bytecode. The unrolled
    # scenario recurrence can exceed that; with this limit Spark then compiles
    # the stage per operator. It changes speed only, never a result.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(
    master: str = "local[*]",
    shuffle_partitions: int = 8,
    app_name: str = "panelrisk",
    extra: dict | None = None,
) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("PANELRISK_DRIVER_MEMORY", "16g"))
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder (``spark.checkpoint.dir``).

    On a cluster a session without one is an error: a folder of the driver's
    own would not be seen by executors. Only in local mode, where the driver
    runs everything itself, as in tests, is a scratch folder made.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            configured = tempfile.mkdtemp(prefix="panelrisk-checkpoint-")
        sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


#: Rows of a part of ``spread``.
ROWS_PER_PART = 10_000


def spread(df: DataFrame, n: int) -> DataFrame:
    """``df``, of ``n`` rows, in as many even parts as the rows need. Adaptive
    execution sizes parts by their bytes, but a model's fit works on a row many
    thousand times: a few MB left in one part keep a single core busy for minutes."""
    parts = -(-n // ROWS_PER_PART)
    return df.repartition(parts) if parts > 1 else df


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
