"""Helpers shared by the training-data operators."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a side that may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in ``spark.checkpoint.dir``.

    The folder is the session's; one is made only where none is set, as in
    local tests (a cluster must name a shared folder).
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(
            spark.conf.get("spark.checkpoint.dir", None) or _test_dir(sc.master)
        )
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Like ``materialize``, as a compressed parquet table in the same folder:
    for rows that carry texts. The folder's owner clears old tables."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        materialize(df.limit(0))
    path = f"{sc.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _test_dir(master: str) -> str:
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="panelrisk-checkpoint-")


def small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a materialised side for broadcast if its counted rows allow it.

    Only for frames of a few narrow columns: the bound is on rows. Larger sides
    are returned as they are and the join shuffles.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def bucket_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus`` (null for a null id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


#: What a Python worker keeps beyond its task, for one owner at a time.
_KEPT: dict[str, object] = {}


def kept_in_worker(owner: str, make):
    """The owner's object of this Python worker, made anew if another owner came
    between: a worker never holds the memories of two stages."""
    if owner not in _KEPT:
        forget_others(owner)
        _KEPT[owner] = make()
    return _KEPT[owner]


def forget_others(owner: str | None = None) -> None:
    """Drop what other stages left in this worker."""
    for other in [o for o in _KEPT if o != owner]:
        del _KEPT[other]


def tidy(run, owner: str | None = None):
    """A batch function that leaves its worker small.

    Python workers outlive their tasks. What an earlier stage kept in this one is
    dropped first (all but the ``owner``'s own), and Arrow's unused memory, as much
    as the largest batch took, is handed back when the task ends.
    """

    @functools.wraps(run)
    def wrapped(batches):
        forget_others(owner)
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return wrapped


def drawn_share(key: Column, share: float, salt: str) -> Column:
    """True for rows whose salted key hash falls in the lowest ``share`` of its
    range. Deterministic, so a lost task draws the same rows again."""
    edge = min(1 << 31, int(share * (1 << 31)))
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 31)) < F.lit(edge)


def learning_rows(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str,
    held_out_modulus: int,
    held_out_value: int,
    max_rows: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(text, label): a sample of about ``max_rows`` labelled rows to learn from.

    Left out: held-out ids, null ids or labels, labels other than 0 and 1, ids
    with contradicting labels. Each label gives up to half of the rows, drawn by
    a hash of the id. Only this bounded sample is broadcast.
    """
    lab = (
        labels.select(F.col(id_col).cast("long").alias("lid"), F.col(label_col).cast("int").alias("label"))
        .where("lid is not null and label in (0, 1)")
        .where(bucket_of(F.col("lid"), held_out_modulus) != held_out_value)
        .groupBy("lid")
        .agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .where("label = other")
        .select("lid", "label")
    )
    counts = {r.label: r.n for r in lab.groupBy("label").agg(F.count("*").alias("n")).collect()}
    drawn = F.lit(False)
    for label, n in sorted(counts.items()):
        drawn = drawn | ((F.col("label") == label) & drawn_share(F.col("lid"), max_rows / 2 / n, label_col))
    chosen = lab.where(drawn)
    text = docs.select(F.col(id_col).cast("long").alias("lid"), F.col(text_col).alias("text"))
    return text.join(F.broadcast(chosen), "lid").select("text", "label")
