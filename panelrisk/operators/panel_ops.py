"""Row, period and profiling operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .segments import positions
from .stats import as_list


def profile_table(df: DataFrame, date_col: str | None = None) -> DataFrame:
    """One-row profile — rows, columns and their names, date range, total
    nulls. One aggregate pass; count and names of columns are schema metadata.
    """
    nulls = [F.count_if(F.col(c).isNull()) for c in df.columns]
    total_nulls = nulls[0]
    for n in nulls[1:]:
        total_nulls = total_nulls + n
    aggs = [
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).alias("n_cols"),
        F.array(*map(F.lit, df.columns)).alias("columns"),
        total_nulls.alias("n_nulls"),
    ]
    if date_col:
        aggs += [F.min(date_col).alias("min_date"), F.max(date_col).alias("max_date")]
    return df.agg(*aggs)


def sample_rows(df: DataFrame, order, n: int = 5) -> DataFrame:
    """The first ``n`` rows in the given order (the profile's sample)."""
    return df.orderBy(*as_list(order)).limit(n)


def year_slice(df: DataFrame, first: int, last: int, year: str = "year") -> DataFrame:
    """Inclusive year range (pushed to the scan when year is a column)."""
    return df.where(F.col(year).between(first, last))


def complete_rows(df: DataFrame, cols) -> DataFrame:
    """Keep rows where every listed column is non-null."""
    return df.dropna(how="any", subset=as_list(cols))


def temporal_split(df: DataFrame, train_end: int, test_start: int, year: str = "year", date: str | None = None) -> DataFrame:
    """P5: label rows 'train' (year <= train_end) / 'test' (>= test_start);
    rows in neither are dropped. Year from the column, else from the date."""
    y = F.col(year) if year in df.columns else F.year(F.col(date))
    if year in df.columns and date:
        y = F.coalesce(F.col(year), F.year(F.col(date)))
    split = F.when(y <= train_end, F.lit("train")).when(y >= test_start, F.lit("test"))
    return df.withColumn("split", split).where(F.col("split").isNotNull())


def sample_gate(split_df: DataFrame, by, min_train: int = 5, min_test: int = 2) -> DataFrame:
    """Keys whose train / test sizes pass the minimums (one aggregate)."""
    keys = as_list(by)
    counts = split_df.groupBy(*keys).agg(
        F.count_if(F.col("split") == "train").alias("n_train"),
        F.count_if(F.col("split") == "test").alias("n_test"),
    )
    return counts.where((F.col("n_train") >= min_train) & (F.col("n_test") >= min_test))


def last_observation(df: DataFrame, by, order, cols, defaults: dict | None = None) -> DataFrame:
    """Last row per key by time; missing fields take their defaults.

    ``max_by`` over a struct is a plain aggregate with map-side partial
    aggregation — one small row per key and task crosses the shuffle.
    """
    keys = as_list(by)
    cols = as_list(cols)
    defaults = defaults or {}
    last = df.groupBy(*keys).agg(
        F.max_by(F.struct(*[F.col(c) for c in [order, *cols]]), F.col(order)).alias("__last")
    )
    out = [*keys, F.col(f"__last.{order}").alias(order)]
    for c in cols:
        v = F.col(f"__last.{c}")
        if c in defaults:
            v = F.coalesce(v, F.lit(float(defaults[c])))
        out.append(v.alias(c))
    return last.select(*out)


def quarter_calendar(df: DataFrame, by, date: str = "period_start") -> DataFrame:
    """Continuous quarterly calendar per key between its first and last
    quarter (a generator per key — no join against a date table)."""
    keys = as_list(by)
    bounds = df.groupBy(*keys).agg(F.min(date).alias("__d0"), F.max(date).alias("__d1"))
    return bounds.select(
        *keys,
        F.explode(F.sequence("__d0", "__d1", F.expr("INTERVAL 3 MONTHS"))).alias(date),
    )


def first_n(df: DataFrame, by, order, n: int, block: float | None = None) -> DataFrame:
    """P10: first n rows per key by time (row_number window, no global sort; by
    time block where ``block`` is given)."""
    if block is not None:
        return positions(df, by, order, block).where(F.col("__pos") <= n).select(*df.columns)
    w = Window.partitionBy(*as_list(by)).orderBy(order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")
