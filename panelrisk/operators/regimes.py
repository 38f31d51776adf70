"""Regimes: clustering statistics on labelled points and k-means (K1–K7).

Points are ``(id, features ARRAY<DOUBLE>, label)``. Statistics use
per-cluster sufficient statistics — count n_c, vector sum S_c and sum of
squared norms Q_c — so every point-to-cluster quantity is O(k·D) per point:
no pairwise self-join. The k × D statistics (bounded by the number of
clusters and the dimension, not by the data) reach every row as one
scalar subquery. The Euclidean silhouette meets points block by block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ..specs import REGIME_FALLBACK, REGIME_NAMES
from .stats import small


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def _norm2(a):
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v * v)


def cluster_stats(points: DataFrame, features: str = "features", label: str = "label") -> DataFrame:
    """Per cluster: n, S (vector sum as array), Q (Σ squared norms)."""
    long = points.select(label, F.posexplode(features).alias("d", "x"))
    sums = long.groupBy(label, "d").agg(F.sum("x").alias("s"))
    vec = sums.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("d", "s"))).alias("__v"))
    vec = vec.select(label, F.transform("__v", lambda e: e["s"]).alias("S"))
    base = points.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.sum(_norm2(F.col(features))).alias("Q"))
    return base.join(vec, label)


def cluster_sizes(points: DataFrame, label: str = "label") -> DataFrame:
    """K5: size of each cluster with its regime name."""
    return regime_names(points.groupBy(label).agg(F.count(F.lit(1)).alias("n")), label)


def regime_names(df: DataFrame, label: str = "label", out: str = "regime_name") -> DataFrame:
    """K6: id -> name from the fixed table; unknown ids get the fallback."""
    mapping = F.create_map(*[x for k, v in REGIME_NAMES.items() for x in (F.lit(k), F.lit(v))])
    fallback = F.format_string(REGIME_FALLBACK.replace("{}", "%d"), F.col(label))
    return df.withColumn(out, F.coalesce(mapping[F.col(label)], fallback))


def in_time_order(df: DataFrame, order: str, label: str = "label") -> DataFrame:
    """K6: labels numbered 0, 1, … by the mean of ``order`` (a date or a number)
    over their rows, ties by label. A row per label is all that is sorted."""
    is_date = df.schema[order].dataType.simpleString() == "date"
    when = F.unix_date(F.col(order)) if is_date else F.col(order).cast("double")
    means = df.groupBy(F.col(label).alias("__old")).agg(F.avg(when).alias("__mean"))
    ordered = means.agg(F.array_sort(F.collect_list(F.struct("__mean", "__old"))).alias("o")).select(F.col("o.__old").alias("o")).scalar()
    return df.withColumn("__order", ordered).withColumn(
        label, (F.array_position("__order", F.col(label)) - 1).cast("int")
    ).drop("__order")


def cluster_centroids(points: DataFrame, features: str = "features", label: str = "label") -> DataFrame:
    """K4: centroid coordinates, long form (label, dim, value)."""
    long = points.select(label, F.posexplode(features).alias("dim", "x"))
    return long.groupBy(label, "dim").agg(F.avg("x").alias("value"))


def cluster_inertia(points: DataFrame, features: str = "features", label: str = "label") -> DataFrame:
    """K3: Σ squared distance to the cluster's centroid, from the differences
    themselves (no cancellation for tight clusters far from the origin)."""
    st = cluster_stats(points, features, label)
    centre = st.select(label, "n", F.transform("S", lambda s: s / F.col("n")).alias("__c"))
    diff = F.zip_with(F.col(features), F.col("__c"), lambda x, c: x - c)
    joined = points.select(label, features).join(centre, label)
    return joined.groupBy(label).agg(F.any_value("n").alias("n"), F.sum(_norm2(diff)).alias("inertia"))


#: Points on one side of a block pair, and those of them measured at a time.
BLOCK, STRIP = 4096, 512


def _summed_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each row of ``x`` the sum of its distances to all rows of ``y``.

    Squares come from one product, around the mean of ``y``; a pair too close for
    that (its square is lost in the rounding of the norms) is measured by its
    differences, as are all where a value isn't finite.
    """
    if not (np.isfinite(x).all() and np.isfinite(y).all()):
        return np.array([np.sqrt(((y - row) ** 2).sum(axis=1)).sum() for row in x])
    mean = y.mean(axis=0)
    x, y = x - mean, y - mean
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    out = np.empty(len(x))
    for a in range(0, len(x), STRIP):
        strip = x[a : a + STRIP]
        norms = xx[a : a + STRIP, None] + yy
        squares = norms - 2 * (strip @ y.T)
        i, j = np.nonzero(~(squares > 1e-6 * norms))
        for k in range(0, len(i), 1 << 16):
            at, to = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            squares[at, to] = ((strip[at] - y[to]) ** 2).sum(axis=1)
        out[a : a + STRIP] = np.sqrt(squares).sum(axis=1)
    return out


def _vectors(side: pa.Table) -> np.ndarray:
    """The vectors of a block, a row each; they never become Python objects."""
    rows = side.column("xs").combine_chunks().flatten()
    size = np.unique(rows.value_lengths().to_numpy(zero_copy_only=False))
    if rows.null_count or len(size) > 1:
        raise ValueError("vectors must be given and of one length")
    return rows.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), -1)


def _distance_sums(group: pa.Table) -> pa.Table:
    """(id, c, total): the summed distances of a block of points to a block of a
    cluster's; a block without its partner gives none."""
    sides = {s: group.filter(pc.equal(group.column("side"), s)) for s in ("points", "cluster")}
    kind, of = group.schema.field("ids").type.value_type, group.schema.field("c").type
    if not all(len(s) for s in sides.values()):
        return pa.table({"id": pa.array([], kind), "c": pa.array([], of), "total": pa.array([], pa.float64())})
    ids = sides["points"].column("ids").combine_chunks().flatten()
    total = _summed_distances(_vectors(sides["points"]), _vectors(sides["cluster"]))
    return pa.table({"id": ids, "c": pa.array([group.column("c")[0].as_py()] * len(ids), of), "total": pa.array(total)})


def _mean_distances(wanted: DataFrame, points: DataFrame) -> DataFrame:
    """(id, c, total) for every wanted (id, x, c): the point's distances to all
    points of the cluster, block against block.

    Every pair of blocks is a group of two rows, so that neither a large cluster
    nor a point asked for by many is one task.
    """

    def blocked(rows: DataFrame, side: str) -> tuple[DataFrame, DataFrame]:
        """(c, part, ids, xs): the rows of a cluster in blocks, and their number."""
        parts = materialize(rows.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")))
        dealt = rows.join(small(parts), "c").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        held = dealt.groupBy("c", "part").agg(F.collect_list(F.struct("id", "x")).alias("held"))
        return materialize(held.select("c", "part", F.col("held.id").alias("ids"), F.col("held.x").alias("xs"), F.lit(side).alias("side"))), parts

    asked, n_asked = blocked(wanted, "points")
    held, n_held = blocked(points, "cluster")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    left = asked.join(small(n_held), "c").select("c", F.col("part").alias("a"), other, "side", "ids", "xs").withColumnRenamed("other", "b")
    right = held.join(small(n_asked), "c").select("c", F.col("part").alias("b"), other, "side", "ids", "xs").withColumnRenamed("other", "a")
    pairs = left.unionByName(right)
    schema = f"id {wanted.schema['id'].dataType.simpleString()}, c {wanted.schema['c'].dataType.simpleString()}, total double"
    return pairs.groupBy("c", "a", "b").applyInArrow(_distance_sums, schema).groupBy("id", "c").agg(F.sum("total").alias("total"))


def euclidean_silhouette(points: DataFrame, features: str = "features", label: str = "label", id_col: str = "vec_id") -> DataFrame:
    """K2: silhouette per point with Euclidean distance, exact.

    Only clusters that can be a point's nearest are met. By the triangle inequality
    a point's mean distance to a cluster is at least its distance to the centroid,
    and at most the root of its mean squared distance; both come from the cluster's
    sums. A cluster whose least value exceeds another one's greatest is left out.
    Ids must be unique. A point alone in its cluster scores 0.
    """
    st = materialize(cluster_stats(points, features, label))
    packed = st.agg(F.collect_list(F.struct(F.col(label).alias("c"), "n", "Q", "S")).alias("cs")).scalar()
    named = points.select(F.col(id_col).alias("id"), F.col(label).alias("own"), F.col(features).alias("x"))

    def bounds(c):
        apart = _norm2(F.zip_with(F.col("x"), c["S"], lambda v, s: v - s / c["n"]))
        spread = F.greatest(c["Q"] / c["n"] - _norm2(c["S"]) / (c["n"] * c["n"]), F.lit(0.0))
        return F.struct(c["c"].alias("c"), F.sqrt(apart).alias("least"), F.sqrt(apart + spread).alias("most"))

    others = F.transform(F.filter("cs", lambda c: c["c"] != F.col("own")), bounds)
    judged = named.withColumn("cs", packed).withColumn("alone", F.exists("cs", lambda c: (c["c"] == F.col("own")) & (c["n"] == 1)))
    near = judged.withColumn("others", others).withColumn("edge", F.array_min(F.transform("others", lambda o: o["most"])))
    slack = 1 + 1e-9  # rounding of the bounds
    met = F.transform(F.filter("others", lambda o: o["least"] <= F.col("edge") * slack), lambda o: o["c"])
    wanted = near.where(~F.col("alone")).select("id", "x", F.explode(F.concat(F.array("own"), met)).alias("c"))
    cluster = named.select("id", F.col("own").alias("c"), "x")
    totals = _mean_distances(wanted, cluster).join(named.select("id", "own"), "id").join(
        st.select(F.col(label).alias("c"), "n"), "c"
    )
    inside = F.col("c") == F.col("own")
    ab = totals.groupBy("id").agg(
        F.max(F.when(inside, F.col("total") / (F.col("n") - 1))).alias("a"), F.min(F.when(~inside, F.col("total") / F.col("n"))).alias("b")
    )
    s = F.when(F.col("a").isNull() | F.col("b").isNull() | (F.greatest("a", "b") == 0), F.lit(0.0)).otherwise(
        (F.col("b") - F.col("a")) / F.greatest("a", "b")
    )
    return named.join(ab, "id", "left").select(F.col("id").alias(id_col), F.col("own").alias(label), s.alias("silhouette"))


def silhouette(
    points: DataFrame, features: str = "features", label: str = "label", id_col: str = "vec_id", metric: str = "squared"
) -> DataFrame:
    """K2: silhouette per point, exact: ``metric="euclidean"`` as surveyed (see
    ``euclidean_silhouette``), or ``"squared"`` distance from the clusters' sums.

    Mean squared distance from x to cluster c is (n_c|x|² - 2x·S_c + Q_c)
    divided by n_c (other clusters) or n_c - 1 (own cluster). s = (b - a) /
    max(a, b); a point alone in its cluster scores 0. Returns one row per
    point; average it for the overall score.
    """
    if metric not in ("squared", "euclidean"):
        raise ValueError("metric must be 'squared' or 'euclidean'")
    if metric == "euclidean":
        return euclidean_silhouette(points, features, label, id_col)
    st = cluster_stats(points, features, label)
    packed = st.agg(F.collect_list(F.struct(F.col(label).alias("c"), "n", "Q", "S")).alias("cs")).scalar()
    x = F.col(features)
    df = points.select(id_col, label, x.alias("__x"), _norm2(x).alias("__xx"), packed.alias("__cs"))
    packed = F.col("__cs")

    def msd(c, own):
        total = c["n"] * F.col("__xx") - F.lit(2.0) * _dot(F.col("__x"), c["S"]) + c["Q"]
        return total / (c["n"] - F.lit(1)) if own else total / c["n"]

    own = F.filter(packed, lambda c: c["c"] == F.col(label))
    others = F.filter(packed, lambda c: c["c"] != F.col(label))
    df = df.withColumns(
        {
            "__own": own[0],
            "__b": F.array_min(F.transform(others, lambda c: msd(c, False))),
        }
    )
    a = msd(F.col("__own"), True)
    s = F.when(F.col("__own.n") <= 1, F.lit(0.0)).when(F.col("__b").isNull(), F.lit(0.0)).otherwise(
        (F.col("__b") - a) / F.greatest(a, F.col("__b"))
    )
    return df.select(id_col, label, s.alias("silhouette"))


def silhouette_score(
    points: DataFrame, features: str = "features", label: str = "label", id_col: str = "vec_id", metric: str = "squared"
) -> DataFrame:
    """Overall silhouette (mean over points); 0 with a single cluster."""
    return silhouette(points, features, label, id_col, metric).agg(F.avg("silhouette").alias("silhouette"))


def regime_summary(df: DataFrame, cols, label: str = "regime_name") -> DataFrame:
    """K7: mean and sample std of each column per regime."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std")]
    return df.groupBy(label).agg(*aggs)
