"""Exact quantiles by rank selection in rounds.

A quantile is made of the values at one or two ranks. Every rank starts with the
range from the least to the greatest value of its group. A round cuts each range
that is still open into ``BUCKETS`` parts, counts the values per part (partial
counts on the map side, at most ``BUCKETS`` rows a range) and goes on with the
part that holds the rank, drawn in to the values that are really there. Rounds
alternate between parts of equal width and of equal width on a logarithmic scale,
so heavy tails don't stop them. A range of one value is an answer; a range of at
most ``limit`` values is sorted whole. No task holds more of a group than that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .stats import as_list, same_keys, small, unpivot_metrics

#: Parts of a range, and the most values that are sorted whole.
BUCKETS, LIMIT = 1024, 10_000


def _scale(x: Column, log: bool) -> Column:
    """The value, or its signed order of magnitude (no double's logarithm is below -745)."""
    return F.when(x == 0, F.lit(0.0)).otherwise(F.signum(x) * (F.log(F.abs(x)) + 745.0)) if log else x


def _within(long: DataFrame, ranges: DataFrame, keys) -> DataFrame:
    """The values that fall into a range of their group."""
    named = ranges.select(*[F.col(k).alias(f"__r_{k}") for k in keys], "lo", "hi")
    inside = same_keys(keys, "__r_") & F.col("value").between(F.col("lo"), F.col("hi"))
    return long.join(small(named), inside).select(*keys, "value", "lo", "hi")


def _narrowed(long: DataFrame, open_: DataFrame, keys, log: bool) -> DataFrame:
    """The open ranks (keys, k, lo, hi, below, held) with narrower ranges."""
    ranges = open_.select(*keys, "lo", "hi").distinct()
    low, high, v = (_scale(F.col(c), log) for c in ("lo", "hi", "value"))
    # A range too wide for a difference of doubles falls into two parts by sign; one
    # whose ends are alike on this scale waits for the other scale.
    wide = high - low == float("inf")
    share = F.when(wide, F.when(F.col("value") >= 0, F.lit(0.5))).when(high > low, (v - low) / (high - low))
    part = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * BUCKETS), F.lit(BUCKETS - 1)).alias("part")
    parts = (
        _within(long, ranges, keys)
        .select(*keys, "lo", part, "value")
        .groupBy(*keys, "lo", "part")
        .agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
    )
    upto = Window.partitionBy(*keys, "lo").orderBy("part")
    counted = parts.withColumn("upto", F.sum("n").over(upto)).select(
        *[F.col(k).alias(f"__r_{k}") for k in keys], F.col("lo").alias("__r_lo"), "n", "least", "most", "upto"
    )
    rank = F.col("k") - F.col("below")
    met = open_.join(counted, same_keys([*keys, "lo"], "__r_")).where((rank < F.col("upto")) & (rank >= F.col("upto") - F.col("n")))
    return met.select(
        *keys,
        "k",
        F.col("least").alias("lo"),
        F.col("most").alias("hi"),
        (F.col("below") + F.col("upto") - F.col("n")).alias("below"),
        F.col("n").alias("held"),
    )


def _interpolated(at: Column, n: Column, p: float) -> Column:
    """Linear interpolation between the ranks next to p (n - 1)."""
    place = F.lit(float(p)) * (n - 1)
    low, high = F.floor(place), F.ceil(place)
    below, above = at[low], at[high]
    return F.when(low == high, below).otherwise((high - place) * below + (place - low) * above)


def exact_quantiles(df: DataFrame, cols, probs: Sequence[float], by=None, limit: int = LIMIT) -> DataFrame:
    """(keys, column, n, q): per group and column the number of its known values and
    the array of their exact quantiles (nulls where there is no value).

    Runs one job to count the groups, and one per round where a group has more
    than ``limit`` values; pass rows that are cheap to read again.
    """
    groups = [*as_list(by), "column"]
    long = unpivot_metrics(df, as_list(by), as_list(cols), "column", "value")
    known = long.where(F.col("value").isNotNull())
    sizes = materialize(
        long.groupBy(*groups).agg(F.count("value").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    )
    most = sizes.agg(F.max("n")).first()[0] or 0
    if most <= limit:  # every group is bounded: one aggregate
        exact = F.percentile("value", F.array(*[F.lit(float(p)) for p in probs]))
        return long.groupBy(*groups).agg(F.count("value").alias("n"), exact.alias("q"))

    places = [F.lit(float(p)) * (F.col("n") - 1) for p in probs]
    ranks = F.array_distinct(F.array(*[f(x) for x in places for f in (F.floor, F.ceil)]))
    open_ = sizes.where("n > 0").select(*groups, F.explode(ranks).alias("k"), "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("held"))
    settled, log = [], True
    while True:
        closed = (F.col("lo") == F.col("hi")) | (F.col("held") <= limit)
        settled.append(open_.where(closed))
        open_ = open_.where(~closed)
        if not open_.limit(1).count():
            break
        open_, log = materialize(_narrowed(known, open_, groups, log)), not log
    done = settled[0]
    for s in settled[1:]:
        done = done.unionByName(s)
    done = materialize(done)

    few = done.where("lo < hi")
    held = _within(known, few.select(*groups, "lo", "hi").distinct(), groups).groupBy(*groups, "lo").agg(
        F.sort_array(F.collect_list("value")).alias("values")
    )
    held = held.select(*[F.col(k).alias(f"__r_{k}") for k in groups], F.col("lo").alias("__r_lo"), "values")
    found = few.join(held, same_keys([*groups, "lo"], "__r_")).select(
        *groups, "k", F.col("values")[(F.col("k") - F.col("below")).cast("int")].alias("value")
    )
    found = found.unionByName(done.where("lo = hi").select(*groups, "k", F.col("lo").alias("value")))
    at = found.groupBy(*groups).agg(F.map_from_entries(F.collect_list(F.struct("k", "value"))).alias("at"))
    at = at.select(*[F.col(k).alias(f"__r_{k}") for k in groups], "at")
    q = F.array(*[_interpolated(F.col("at"), F.col("n"), p) for p in probs])
    return sizes.join(at, same_keys(groups, "__r_"), "left").select(*groups, "n", F.when(F.col("n") > 0, q).alias("q"))
