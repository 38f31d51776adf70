"""Scans along a key's time in two levels, so that one long series is many tasks.

A time block is a fixed stretch of the order column (days of a date, seconds of a
timestamp, units of a number). Rows are partitioned by (key, block) and scanned
within it. Each block gives one carry row: its number of rows and, per column,
its first and last known value with their positions. The carries of a key, one
row per block, are scanned in turn and joined back, which adds what lies before
and after a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stats import as_list, same_keys

_FIRST = -(1 << 62)  # block of null times, which sort first


def time_block(df: DataFrame, order: str, width: float) -> Column:
    """Number of the ``width``-long stretch of ``order`` that a row falls into."""
    kind = df.schema[order].dataType
    x = F.col(order)
    if isinstance(kind, T.DateType):
        x = F.unix_date(x)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        x = F.unix_micros(x.cast("timestamp")) / F.lit(1e6)
    return F.coalesce(F.floor(x / F.lit(width)).cast("long"), F.lit(_FIRST))


def _carries(inner: DataFrame, cols, keys, pos: str | None) -> DataFrame:
    """A row per (key, block): rows before it in the key and in the whole key, and
    per column the last known (value, position) before and the next one after."""
    edges = {}
    for c in cols:
        known = F.struct(F.col(c).alias("v"), F.col(pos or "__i").cast("double").alias("i"))
        at = F.when(F.col(c).isNotNull(), F.col("__i"))
        edges[f"__f_{c}"], edges[f"__l_{c}"] = F.min_by(known, at), F.max_by(known, at)
    held = inner.groupBy(*keys, "__block").agg(F.count(F.lit(1)).alias("__held"), *[a.alias(n) for n, a in edges.items()])
    of_key = Window.partitionBy(*keys)
    in_time = of_key.orderBy("__block")
    before = in_time.rowsBetween(Window.unboundedPreceding, -1)
    after = in_time.rowsBetween(1, Window.unboundedFollowing)
    placed = held.withColumn("__before", F.coalesce(F.sum("__held").over(before), F.lit(0)))
    if pos is None:  # positions within the block become positions within the key
        moved = {}
        for n in edges:
            at = (F.col(f"{n}.i") + F.col("__before")).alias("i")
            moved[n] = F.when(F.col(n).isNotNull(), F.struct(F.col(f"{n}.v").alias("v"), at))
        placed = placed.withColumns(moved)
    return placed.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        F.col("__block").alias("__k___block"),
        "__before",
        F.sum("__held").over(of_key).alias("__n"),
        *[F.last(f"__l_{c}", True).over(before).alias(f"__p_{c}") for c in cols],
        *[F.first(f"__f_{c}", True).over(after).alias(f"__s_{c}") for c in cols],
    )


def scanned(df: DataFrame, cols, by, order: str, block: float, pos: str | None = None) -> DataFrame:
    """``df`` with ``__pos`` (1-based position in the key, or the column ``pos``),
    ``__n`` (rows of the key) and per column ``__last_c`` and ``__next_c``: the
    known (v, i), value and position, at or before and at or after the row."""
    keys, cols = as_list(by), as_list(cols)
    in_block = Window.partitionBy(*keys, "__block").orderBy(order)
    pre = in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    post = in_block.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    inner = df.withColumn("__block", time_block(df, order, block)).withColumn("__i", F.row_number().over(in_block))
    carries = _carries(inner, cols, keys, pos)
    seen = {}
    for c in cols:
        known = F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), F.col(pos or "__i").cast("double").alias("i")))
        seen[f"__a_{c}"], seen[f"__b_{c}"] = F.last(known, True).over(pre), F.first(known, True).over(post)
    joined = inner.withColumns(seen).join(carries, same_keys([*keys, "__block"], "__k_"), "left")
    shift = F.lit(0) if pos else F.col("__before")

    def at(name: str) -> Column:
        moved = F.struct(F.col(f"{name}.v").alias("v"), (F.col(f"{name}.i") + shift).cast("double").alias("i"))
        return F.when(F.col(name).isNotNull(), moved)

    out = {"__pos": F.col(pos) if pos else F.col("__i") + F.col("__before")}
    for c in cols:
        out[f"__last_{c}"] = F.coalesce(at(f"__a_{c}"), F.col(f"__p_{c}"))
        out[f"__next_{c}"] = F.coalesce(at(f"__b_{c}"), F.col(f"__s_{c}"))
    return joined.withColumns(out).select(*df.columns, "__n", *out)


def positions(df: DataFrame, by, order: str, block: float) -> DataFrame:
    """``df`` with ``__pos`` and ``__n``: 1-based position in its key and the key's rows."""
    return scanned(df, [], by, order, block)
