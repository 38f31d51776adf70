"""Model store (S7) with a commit at the end.

A save writes models and tables into a folder of its own, a version, and then
appends one row to the store's manifest: the version, the format, the JSON about
its models and a digest of all files written. What has no row in the manifest was
never published. A load reads the manifest, takes the earliest version whose files
still have their digest, and so gives all readers, and concurrent writers that
load after they saved, the same models. Models that failed aren't saved.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Layout of a version; others are not read.
FORMAT = 2
_MANIFEST = "version string, format int, about string, digest string"


class NotSaved(LookupError):
    """The store holds no whole version."""


def files_digest(spark: SparkSession, path: str) -> str:
    """Digest of the contents of all files below ``path``, whatever their names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    data = files.where(~F.col("path").rlike(r"/[._][^/]*$"))
    each = data.select(F.sha2("content", 256).alias("d"))
    return each.agg(F.sha2(F.array_join(F.sort_array(F.collect_list("d")), "").cast("binary"), 256)).first()[0]


def publish(spark: SparkSession, path: str, about: list[dict], writers: dict[str, Callable[[str], None]]) -> str:
    """Run every writer on a folder of a new version, then commit it; the version's name."""
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    for name, write in writers.items():
        write(f"{path}/{version}/{name}")
    digest = files_digest(spark, f"{path}/{version}") if writers else ""
    row = [(version, FORMAT, json.dumps(about), digest)]
    spark.createDataFrame(row, _MANIFEST).coalesce(1).write.mode("append").json(f"{path}/manifest")
    return version


def versions(spark: SparkSession, path: str) -> DataFrame:
    """The committed versions of a store."""
    return spark.read.schema(_MANIFEST).json(f"{path}/manifest").where(F.col("format") == FORMAT)


def committed(spark: SparkSession, path: str) -> tuple[str, list[dict]]:
    """Folder and models of the earliest version whose files are whole."""
    try:
        rows = versions(spark, path).orderBy("version").collect()  # a row per save of these models
    except AnalysisException as e:
        raise NotSaved(path) from e
    for r in rows:
        folder = f"{path}/{r.version}"
        try:
            whole = not r.digest or files_digest(spark, folder) == r.digest
        except AnalysisException:  # its files are gone
            whole = False
        if whole:
            return folder, json.loads(r.about)
    raise NotSaved(path)
