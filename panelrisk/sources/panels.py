"""Keyed panels built from the supplied tables.

A *panel* is ``(key…, period, metric…)``: one row per entity and period.
Every operator in this package works on a panel, so one job handles any
number of entities; the surveyed single-series case is a panel with one
key.

Scale notes
-----------
* ``nation_quarters``: lineitem is first reduced to one row per (order,
  quarter), map-side before its shuffle on orderkey, so the fact table's raw
  lines never cross the network. orders ⋈ customer joins it on orderkey, on
  whose partitioning each order's first quarter of a year is flagged. The
  second aggregate shrinks to (key, quarter) with a map-side partial
  aggregate, so a hot key (one nation with a third of the rows) only ever
  ships one partial row per task. Counts of rows and of first flags are the
  exact distinct orders per quarter and per year: the year panel is a sum
  over the quarter panel, not a second scan.
* ``events_daily``: events are pre-aggregated to (user, day) with a
  map-side combine before any shuffle, so a user with a third of all
  events still costs one row per day. The calendar is a generator per user
  between global bounds obtained as scalar subqueries (no cross join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import read_table

PANEL_METRICS = ("volume", "unit_price", "disc_pct", "ret_pct", "open_pct", "tax_take", "n_orders")
NATION_KEY = "nation_key"


def _order_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"])
    customer = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"])
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        "o_orderkey", F.col("c_nationkey").alias(NATION_KEY)
    )


_SUMS = ("volume", "cents", "cents_disc", "tax_units", "n_r", "n_o", "n_lines")


def nation_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additive sums of lineitem ⋈ orders ⋈ customer per nation × quarter.

    nation_key INT, period_start DATE, the sums, n_orders (orders with a line
    in the quarter), n_first (orders whose first quarter of the year it is).
    """
    li = read_table(
        spark,
        sf_dir,
        "lineitem",
        [
            "l_orderkey",
            "l_quantity",
            "l_extendedprice",
            "l_discount",
            "l_tax",
            "l_returnflag",
            "l_linestatus",
            "l_shipdate",
        ],
    )
    period = F.trunc(F.to_date("l_shipdate"), "quarter").alias("period_start")
    # Money is summed exactly as integers: cents, discount and tax in whole
    # percent (the inputs are 2-decimal values). Long sums are codegen'd,
    # order-independent, and give bit-identical ratios on any engine.
    cents = F.rint(F.col("l_extendedprice") * F.lit(100.0)).cast("long")
    disc = F.rint(F.col("l_discount") * F.lit(100.0)).cast("long")
    tax = F.rint(F.col("l_tax") * F.lit(100.0)).cast("long")
    per_order = li.groupBy("l_orderkey", period).agg(
        F.sum("l_quantity").alias("volume"),
        F.sum(cents).alias("cents"),
        F.sum(cents * disc).alias("cents_disc"),
        # c * (100 - k) * t stays an exact integer in a double (< 2^53 per
        # row); a long sum could overflow for a hot key at scale.
        F.sum((cents * (F.lit(100) - disc) * tax).cast("double")).alias("tax_units"),
        F.count_if(F.col("l_returnflag") == "R").alias("n_r"),
        F.count_if(F.col("l_linestatus") == "O").alias("n_o"),
        F.count(F.lit(1)).alias("n_lines"),
    )
    on = _order_nation(spark, sf_dir)
    joined = per_order.join(on, per_order.l_orderkey == on.o_orderkey).drop("o_orderkey")
    in_year = Window.partitionBy("l_orderkey", F.year("period_start")).orderBy("period_start")
    flagged = joined.withColumn("first", (F.row_number().over(in_year) == 1).cast("int"))
    return (
        flagged.groupBy(NATION_KEY, "period_start")
        .agg(*[F.sum(c).alias(c) for c in _SUMS], F.count(F.lit(1)).alias("n_orders"), F.sum("first").alias("n_first"))
        .withColumn(NATION_KEY, F.col(NATION_KEY).cast("int"))
    )


def panel_of(quarters: DataFrame, grain: str = "quarter") -> DataFrame:
    """The nation panel of ``nation_quarters`` rows.

    Columns: nation_key INT, period_start DATE and quarter INT (quarter grain
    only), year INT, volume, unit_price, disc_pct, ret_pct, open_pct,
    tax_take DOUBLE, n_orders BIGINT.
    """
    if grain not in ("quarter", "year"):
        raise ValueError("grain must be 'quarter' or 'year'")
    base = quarters.withColumn("year", F.year("period_start"))
    if grain == "year":
        base = base.groupBy(NATION_KEY, "year").agg(
            *[F.sum(c).alias(c) for c in _SUMS], F.sum("n_first").alias("n_orders")
        )
    dates = ["period_start", "year", F.quarter("period_start").alias("quarter")] if grain == "quarter" else ["year"]
    return base.select(
        NATION_KEY,
        *dates,
        F.col("volume"),
        (F.col("cents").cast("double") / (F.lit(100.0) * F.col("volume"))).alias("unit_price"),
        (F.col("cents_disc").cast("double") / F.col("cents").cast("double")).alias("disc_pct"),
        (F.lit(100.0) * F.col("n_r") / F.col("n_lines")).alias("ret_pct"),
        (F.lit(100.0) * F.col("n_o") / F.col("n_lines")).alias("open_pct"),
        (F.col("tax_units") / F.lit(1e6)).alias("tax_take"),
        F.col("n_orders").cast("bigint").alias("n_orders"),
    )


def nation_panel(spark: SparkSession, sf_dir: str, grain: str = "quarter") -> DataFrame:
    """lineitem ⋈ orders ⋈ customer aggregated to nation × quarter (or year)."""
    return panel_of(nation_quarters(spark, sf_dir), grain)


def events_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events aggregated to user × day over the full calendar.

    Every user gets every day between the global first and last event day;
    days without events keep null metrics (real gaps for the cleaning
    operators). Columns: user_id BIGINT, day DATE, pos INT (1-based day
    position), n_events BIGINT (0 on gaps), value DOUBLE, avg_value DOUBLE.
    """
    ev = read_table(spark, sf_dir, "events", ["user_id", "ts", "value"])
    day = F.to_date("ts")
    daily = ev.groupBy("user_id", day.alias("day")).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.sum("value").alias("value"),
        F.avg("value").alias("avg_value"),
    )
    # Users and bounds come from the small daily rows, not from the raw events.
    bounds = daily.agg(F.min("day").alias("d0"), F.max("day").alias("d1"))
    d0 = bounds.select("d0").scalar()
    d1 = bounds.select("d1").scalar()
    users = daily.select("user_id").distinct()
    calendar = users.select(
        "user_id", F.explode(F.sequence(d0, d1, F.expr("INTERVAL 1 DAY"))).alias("day")
    )
    return calendar.join(daily, ["user_id", "day"], "left").select(
        "user_id",
        "day",
        (F.datediff("day", d0) + F.lit(1)).cast("int").alias("pos"),
        F.coalesce(F.col("n_events"), F.lit(0)).cast("bigint").alias("n_events"),
        "value",
        "avg_value",
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as (vec_id, features ARRAY<DOUBLE>, label)."""
    emb = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])
    return emb.select(
        "vec_id",
        F.transform("embedding", lambda x: x.cast("double")).alias("features"),
        "label",
    )


def period_labels(panel: DataFrame) -> DataFrame:
    """Render a quarterly panel's dates as 'YYYY Tq' source labels (S2 input)."""
    return panel.select(
        NATION_KEY,
        F.concat(F.col("year").cast("string"), F.lit(" T"), F.col("quarter").cast("string")).alias("period"),
        *[c for c in panel.columns if c in PANEL_METRICS],
    )


def parse_period(df: DataFrame, col: str = "period") -> DataFrame:
    """Parse 'YYYY Tq' into year, quarter and quarter-start date."""
    year = F.regexp_extract(F.col(col), r"^\s*(\d{4})", 1).cast("int")
    quarter = F.regexp_extract(F.col(col), r"[Tt]\s*([1-4])\s*$", 1).cast("int")
    return (
        df.withColumn("year", year)
        .withColumn("quarter", quarter)
        .withColumn(
            "period_start",
            F.make_date(F.col("year"), (F.col("quarter") - 1) * 3 + 1, F.lit(1)),
        )
    )


def risk_roles(panel: DataFrame) -> DataFrame:
    """Map the nation panel onto the 12-metric roles the analysis expects.

    production = volume, price = unit_price, debt_ratio = ret_pct,
    deficit = disc_pct, employment = 100 - open_pct, rp_ratio = n_orders,
    revenue_share = unit_price / 100, vat_take = tax_take.
    """
    return panel.select(
        *[c for c in panel.columns],
        F.col("volume").alias("production"),
        F.col("unit_price").alias("price"),
        F.col("ret_pct").alias("debt_ratio"),
        F.col("disc_pct").alias("deficit"),
        (F.lit(100.0) - F.col("open_pct")).alias("employment"),
        F.col("n_orders").cast("double").alias("rp_ratio"),
        (F.col("unit_price") / F.lit(100.0)).alias("revenue_share"),
        F.col("tax_take").alias("vat_take"),
    )
