"""Exact top-k inner products by ball-tree branch and bound.

Vectors are dealt by a hash of their id into shards of about ``shard_rows``;
each shard becomes one ball tree (a row of the tree table). Queries are dealt
into blocks, and blocks travel to the trees: a tree is sent once to every run of
``GROUP`` blocks, a block to every shard. The search goes in rounds. In the first,
each block searches one shard, another one for each block; then ``WIDEN`` times as
many shards a round. After a round the kth score of every query over all shards so
far goes with its block into the next one. Nodes are taken in the order of their
upper bound q.c + |q| r and cut when it is below the kth score of every query of
the block.

Components become floor(256 * x) with x as double; scores are integer inner
products, computed in double where all sums stay below 2**53 and in Python
integers beyond (kept within 64 bits).

Cases: rows with a null id, a null vector, or null or non-finite components take
no part, neither as query nor as candidate. Vectors meet only vectors of equal
length. Rows that repeat an id are candidates each, but never for a query of
that id; queries repeated with the same vector are answered once. Ties go to the
smaller id. With fewer candidates than k all are returned. Empty tables give no
rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import io
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Vectors of a shard, of a leaf; queries of a block.
SHARD_ROWS, LEAF_ROWS, BLOCK_QUERIES = 8192, 64, 256
#: Blocks that meet a tree in one task; how many times more shards each round takes.
GROUP, WIDEN = 64, 8
EXACT = 2.0**53


def quantize(values: np.ndarray) -> np.ndarray:
    return np.floor(256.0 * values.astype(np.float64))


def narrow(x: np.ndarray) -> np.ndarray:
    """The integers of ``x`` in two bytes each where they fit: trees and blocks
    are copied to many tasks."""
    return x.astype(np.int16) if np.abs(x).max(initial=0.0) < 2**15 else x


def build_tree(ids: np.ndarray, x: np.ndarray, leaf: int = LEAF_ROWS) -> dict[str, np.ndarray]:
    """Arrays of a ball tree; a node holds the rows from ``lo`` to ``hi``.

    A node is split at the median along the line between two far points.
    """
    order = np.arange(len(x))
    lo, hi, left, centre, radius = [], [], [], [], []

    def node(a: int, b: int) -> int:
        part = x[order[a:b]]
        c = part.mean(axis=0)
        lo.append(a), hi.append(b), left.append(-1), centre.append(c)
        radius.append(math.sqrt(float(((part - c) ** 2).sum(axis=1).max())))
        return len(lo) - 1

    todo = [node(0, len(x))]
    while todo:
        n = todo.pop()
        a, b = lo[n], hi[n]
        if b - a <= leaf or radius[n] == 0:
            continue
        part = x[order[a:b]]
        far = part[((part - centre[n]) ** 2).sum(axis=1).argmax()]
        other = part[((part - far) ** 2).sum(axis=1).argmax()]
        mid = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(part @ (other - far), mid)]
        left[n] = node(a, a + mid)
        node(a + mid, b)  # the right child follows the left one
        todo += [left[n], left[n] + 1]
    return {
        "ids": ids[order], "x": narrow(x[order]), "lo": np.array(lo), "hi": np.array(hi), "left": np.array(left),
        "centre": np.array(centre), "radius": np.array(radius),
    }


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products (as double where exact, else saturated 64 bits)."""
    if not q.size or not x.size:
        return np.zeros((len(q), len(x)))
    if np.abs(q).max() * np.abs(x).max() * q.shape[1] < EXACT:
        return q @ x.T
    big = np.array([[int(v) for v in r] for r in q], object) @ np.array([[int(v) for v in r] for r in x], object).T
    return np.array([[max(-(2**63), min(2**63 - 1, int(v))) for v in r] for r in big], object)


class Best:
    """The k best (-score, id) of each query of a block, best first.

    ``kth`` starts at the scores known from elsewhere: nothing below is needed.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, kth: np.ndarray | None = None):
        self.ids, self.x, self.k = ids, x, k
        self.norm = np.sqrt((x**2).sum(axis=1))
        self.found: list[list[tuple[int, int]]] = [[] for _ in ids]
        self.kth = np.full(len(ids), -np.inf) if kth is None else kth

    def merge(self, i: int, pairs: list[tuple[int, int]]) -> None:
        best = self.found[i] = sorted(self.found[i] + pairs)[: self.k]
        if len(best) == self.k:
            self.kth[i] = max(self.kth[i], -best[-1][0])

    def search(self, tree: dict[str, np.ndarray]) -> None:
        def bound(n: int) -> np.ndarray:
            value = self.x @ tree["centre"][n] + self.norm * tree["radius"][n]
            return value + 1e-9 * (np.abs(value) + self.norm * (tree["radius"][n] + np.abs(tree["centre"][n]).sum())) + 1e-6

        ub = bound(0)
        heap = [(-float(ub.max(initial=-np.inf)), 0, ub)]
        while heap:
            _, n, ub = heapq.heappop(heap)
            live = np.flatnonzero(ub >= self.kth)
            if not len(live):
                continue
            if tree["left"][n] >= 0:
                for child in (tree["left"][n], tree["left"][n] + 1):
                    ub = bound(child)
                    heapq.heappush(heap, (-float(ub.max()), int(child), ub))
                continue
            lo, hi = tree["lo"][n], tree["hi"][n]
            ids = tree["ids"][lo:hi]
            scores = _products(self.x[live], tree["x"][lo:hi].astype(np.float64))
            for i, row in zip(live.tolist(), scores, strict=True):
                keep = np.flatnonzero((row >= self.kth[i]) & (ids != self.ids[i]))
                if len(keep):
                    self.merge(i, [(-int(row[j]), int(ids[j])) for j in keep.tolist()])


def _pack(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as z:
        return {k: z[k] for k in z.files}


def _matrix(group: pa.Table) -> np.ndarray:
    flat = group["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return quantize(flat).reshape(group.num_rows, -1)


def _tree_of(group: pa.Table) -> pa.Table:
    tree = build_tree(group["id"].to_numpy(), _matrix(group))
    return pa.table({"dim": group["dim"][:1], "shard": group["shard"][:1], "tree": pa.array([_pack(tree)], pa.binary())})


def _block_of(group: pa.Table) -> pa.Table:
    data = _pack({"ids": group["id"].to_numpy(), "x": narrow(_matrix(group))})
    return pa.table({"dim": group["dim"][:1], "block": group["block"][:1], "queries": pa.array([data], pa.binary())})


_FOUND = "dim int, block long, at int, query_id long, vec_id long, score long"


def _search(k: int):
    """Of a tree and the blocks that meet it here: what they find in it, a row each."""

    def run(trees: pa.Table, blocks: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, int, int]] = []
        if trees.num_rows:
            tree = _unpack(trees["tree"][0].as_py())
            for block, data, known in zip(blocks["block"], blocks["queries"], blocks["kth"], strict=True):
                q = _unpack(data.as_py())
                kth = np.full(len(q["ids"]), -np.inf)
                for r in known.as_py() or ():
                    kth[r["at"]] = r["kth"]
                best = Best(q["ids"], q["x"].astype(np.float64), k, kth)
                best.search(tree)
                out += [(block.as_py(), i, int(q["ids"][i]), v, -s) for i, f in enumerate(best.found) for s, v in f]
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        dim = pa.array([trees["t_dim"][0].as_py()] * len(out) if out else [], pa.int32())
        arrays = [dim, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))]
        return pa.table(arrays, names=["dim", "block", "at", "query_id", "vec_id", "score"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query; cut down before the shuffle as well as after."""
    best_first = Window.partitionBy("dim", "block", "at").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)


def exact_top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    block_queries: int = BLOCK_QUERIES,
    group: int = GROUP,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all rows for each query.

    ``is_query`` is a condition on ``id`` (the row's id).
    """
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = (
        vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
        .where(F.col("id").isNotNull() & F.col("v").isNotNull())
        .where(F.forall("v", sound))
        .withColumn("dim", F.size("v"))
    )
    queries = rows.where(is_query).dropDuplicates(["id", "v"])
    n, m = rows.count(), queries.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-m // block_queries))
    deal = lambda parts: F.pmod(F.xxhash64("id"), F.lit(parts)).cast("long")
    trees = materialize(
        rows.withColumn("shard", deal(shards)).groupBy("dim", "shard").applyInArrow(_tree_of, "dim int, shard long, tree binary")
    )
    asked = materialize(
        queries.withColumn("block", deal(blocks))
        .groupBy("dim", "block")
        .applyInArrow(_block_of, "dim int, block long, queries binary")
    )
    best = None
    done, end = 0, 1
    while done < shards:
        asking = asked.withColumn("kth", F.lit(None).cast("array<struct<at:int,kth:long>>"))
        if best is not None:
            kth = best.where(F.col("rank") == k).groupBy("dim", "block").agg(F.collect_list(F.struct("at", F.col("score").alias("kth"))).alias("kth"))
            asking = asked.join(kth, ["dim", "block"], "left")
        # Of block b the round takes the shards b + done to b + end - 1, in a ring.
        pairs = asking.withColumn("step", F.explode(F.sequence(F.lit(done), F.lit(min(end, shards) - 1)))).select(
            "dim", "block", "queries", "kth",
            F.pmod(F.col("block") + F.col("step"), F.lit(shards)).cast("long").alias("shard"),
            F.floor(F.col("block") / group).alias("part"),
        )
        meets = ["dim", "shard", "part"]
        sent = pairs.select(*meets).distinct().join(trees, ["dim", "shard"]).select("tree", *[F.col(c).alias(f"t_{c}") for c in meets])
        new = sent.groupBy("t_dim", "t_shard", "t_part").cogroup(pairs.groupBy(*meets)).applyInArrow(_search(k), _FOUND)
        best = materialize(_best(new if best is None else best.drop("rank").unionByName(new), k))
        done, end = end, end * (1 + WIDEN)
    return best.select("query_id", "rank", "vec_id", "score")
