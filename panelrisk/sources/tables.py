"""Readers and writers.

Parquet is the default format: reads name only the columns an operator
needs so Catalyst prunes the scan, and filters reach the reader as
``PushedFilters``. CSV sources are read with an explicit schema (never
inferred) and renamed from their display headers to canonical names.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..specs import METRICS, SOURCE_HEADERS

TABLES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)


def read_table(spark: SparkSession, sf_dir: str, name: str, columns=None) -> DataFrame:
    path = os.path.join(sf_dir, f"{name}.parquet")
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def annual_schema(headers: bool = True) -> T.StructType:
    """Schema of the annual source: year + 12 metrics."""
    inv = {v: k for k, v in SOURCE_HEADERS.items()}
    label = (lambda n: inv[n]) if headers else (lambda n: n)
    fields = [T.StructField(label("year"), T.IntegerType())]
    fields += [T.StructField(label(m), T.DoubleType()) for m in METRICS]
    return T.StructType(fields)


def quarterly_schema(headers: bool = True) -> T.StructType:
    """Schema of the quarterly source: 'YYYY Tq' period label + 12 metrics."""
    inv = {v: k for k, v in SOURCE_HEADERS.items()}
    label = (lambda n: inv[n]) if headers else (lambda n: n)
    fields = [T.StructField(label("period"), T.StringType())]
    fields += [T.StructField(label(m), T.DoubleType()) for m in METRICS]
    return T.StructType(fields)


def rename_columns(df: DataFrame, mapping: dict | None = None) -> DataFrame:
    """Canonical rename (S3); columns not in the map are kept."""
    mapping = SOURCE_HEADERS if mapping is None else mapping
    present = {k: v for k, v in mapping.items() if k in df.columns}
    return df.withColumnsRenamed(present)


def read_csv_source(spark: SparkSession, path: str, schema: T.StructType, mapping=None) -> DataFrame:
    """Read a headed UTF-8 CSV with an explicit schema, then rename."""
    df = (
        spark.read.schema(schema)
        .option("header", True)
        .option("encoding", "UTF-8")
        .option("enforceSchema", False)
        .csv(path)
    )
    return rename_columns(df, mapping)


def write_table(df: DataFrame, path: str, partition_by=None, fmt: str = "parquet", mode: str = "overwrite"):
    """Write a result table (S5/S6/S9): parquet, csv (with header) or json."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)
    return path


def export_by(df: DataFrame, path: str, column: str = "scenario", fmt: str = "csv") -> dict:
    """One folder per value of ``column`` (a scenario name), written in one
    pass; returns value -> path. Meant for columns of few values."""
    write_table(df, path, partition_by=column, fmt=fmt)
    values = [r[0] for r in df.select(column).distinct().collect()]
    return {v: f"{path}/{column}={v}" for v in sorted(values)}


def to_json_records(df: DataFrame, out: str = "record") -> DataFrame:
    """One JSON string per row (S9) — for serving result tables."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(out))
