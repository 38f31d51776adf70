"""Statistics helpers shared by operators.

``broadcast_stats`` attaches per-key or whole-table statistics to every row
without a join:

* ``by`` given -> window aggregates partitioned by the keys. All windows
  with the same partition spec share one exchange, and panel rows per key
  are bounded by the calendar length.
* ``by`` None -> uncorrelated scalar subqueries (``DataFrame.scalar``),
  which Catalyst merges into one aggregate and inlines as a literal — never
  a single-partition window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most rows of a narrow side that may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def as_list(x):
    if x is None:
        return []
    return [x] if isinstance(x, str) else list(x)


def key_window(by):
    return Window.partitionBy(*as_list(by))


def stat_columns(df: DataFrame, aggs: dict, by=None) -> dict:
    """name -> Column evaluating the aggregate per key (or whole table)."""
    keys = as_list(by)
    if keys:
        w = key_window(keys)
        return {name: agg.over(w) for name, agg in aggs.items()}
    merged = df.agg(*[agg.alias(name) for name, agg in aggs.items()])
    return {name: merged.select(name).scalar() for name in aggs}


def unpivot_metrics(df: DataFrame, keys, metrics, var: str = "metric", val: str = "value") -> DataFrame:
    """Wide -> long on ``metrics`` (all cast to double)."""
    base = df.select(*as_list(keys), *[F.col(m).cast("double").alias(m) for m in metrics])
    return base.unpivot(as_list(keys), list(metrics), var, val)


def same_keys(keys, prefix: str) -> Column:
    """Join condition: each key equals the other side's ``prefix``-named one (null
    equals null, as in a grouping)."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(prefix + k)) for k in keys], F.lit(True))


def small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a materialised narrow side for broadcast if its counted rows allow it."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
