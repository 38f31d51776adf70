"""Merkle manifest of a dataset by a nested-struct rollup.

Every row is a leaf. Within a source leaves are ranked by id; the rank's last
``DIGITS`` digits to base ``RUN`` become columns, what is left of it names a
bounded block. Inside a block the digit columns are grouped away one after the
other, each time nesting the children's structs, so that a block ends up as one
row that holds its subtree. The blocks' digests are the nodes of the next round,
until every source has one digest; the sources' digests are rolled up likewise.
On the way back a block is grouped with the path above it, and a transform over
its nested structs and an explode emit each child with its whole path: no join.

Digests are SHA-256 as lowercase hex, over their inputs' concatenation. A field
counts as ``-`` if null, else as its UTF-8 byte count, ``:`` and its value.

Cases: a null source is a source of its own, before all others. Rows with a null
id come first in their source; equal ids are ordered by their leaf, and repeated
rows are leaves of their own. Empty and very long texts are ordinary values (a
digest is all that leaves the row). Columns beyond the named fields don't count.
An empty table gives no rows. A missing field is an error.

Ranks come from sorted ranges and the ranges' counts, so that no task sees a
whole source; a block holds at most ``RUN ** DIGITS`` children.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Nodes that become one, and the rank digits nested within a block.
RUN, DIGITS = 16, 2
#: The fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_HEX = 64
_PATH = "array<struct<before: string, after: string>>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(values: list[Column]) -> Column:
    """Digest of a row's fields."""
    parts = []
    for v in values:
        s = v.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return digest(F.concat(*parts))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with their rank ``pos`` (from 0) within ``g`` and ``n``, g's rows.

    ``rows`` are sorted into ranges, counted by range and ``g``, and numbered
    within a range; a hot ``g`` spreads over as many ranges as it fills. Equal
    rows are told apart by ``spread`` only, so that many of them spread too.
    """
    spread = rows.withColumn("spread", F.monotonically_increasing_id())
    placed = stored(spread.repartitionByRange("g", *order, "spread").withColumn("part", F.spark_partition_id()))
    counts = placed.groupBy("g", "part").agg(F.count("*").alias("held"))
    of_g = Window.partitionBy("g")
    before = counts.select(
        "g",
        "part",
        (F.sum("held").over(of_g.orderBy("part")) - F.col("held")).alias("before"),
        F.sum("held").over(of_g).alias("n"),
    )
    within = Window.partitionBy("g", "part").orderBy(*order, "spread")
    numbered = placed.withColumn("i", F.row_number().over(within) - 1).join(before, ["g", "part"])
    return numbered.withColumn("pos", F.col("before") + F.col("i")).drop("part", "i", "before", "spread")


def _joined(kids: Column) -> Column:
    return F.array_join(F.transform(kids, lambda k: k["hash"]), "")


def _parent(kids: Column, n: Column) -> Column:
    """Digest of a run; where only one node is left in all, that node itself."""
    return F.when(n > 1, digest(_joined(kids))).otherwise(kids[0]["hash"])


def _above(n: Column, levels: int) -> Column:
    """Nodes left after some levels."""
    for _ in range(levels):
        n = F.ceil(n / RUN)
    return n


def blocks(nodes: DataFrame) -> DataFrame:
    """(g, block, n, hash, kids): the nested subtree of every block of nodes
    (g, pos, n, hash, item)."""
    digits = [(F.floor(F.col("pos") / RUN**d) % RUN).alias(f"d{d}") for d in range(DIGITS)]
    block = F.floor(F.col("pos") / RUN**DIGITS).alias("block")
    rows = nodes.select("g", block, "n", *digits, "hash", "item").repartition("g", "block")
    inner = ["hash", "item"]
    for d in range(DIGITS):
        left = [f"d{k}" for k in range(d + 1, DIGITS)]
        kids = F.sort_array(F.collect_list(F.struct(f"d{d}", *inner)))
        rows = rows.groupBy("g", "block", "n", *left).agg(kids.alias("kids"))
        rows = rows.withColumn("hash", _parent(F.col("kids"), _above(F.col("n"), d)))
        inner = ["hash", "kids"]
    return rows.select("g", "block", "n", "hash", "kids")


def rolled_up(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of every round, and (g, hash): the one digest of each ``g``."""
    rounds = []
    left = nodes.agg(F.max("n")).first()[0] or 0
    while not rounds or left > 1:
        rounds.append(stored(blocks(nodes)))
        nodes = rounds[-1].select(
            "g",
            F.col("block").alias("pos"),
            _above(F.col("n"), DIGITS).alias("n"),
            "hash",
            F.lit(None).cast("string").alias("item"),
        )
        left = -(-left // RUN**DIGITS)
    return rounds, nodes.select("g", "hash")


def _emitted(kids: Column, level: int, path: Column, n: Column) -> Column:
    """The block's children, each with its path: its siblings' digests before
    and after it, level by level."""
    joined = _joined(kids)

    def longer(i: Column) -> Column:
        at = i * _HEX
        pair = F.struct(
            joined.substr(F.lit(1), at).alias("before"),
            joined.substr(at + _HEX + 1, F.lit(_HEX * RUN)).alias("after"),
        )
        return F.when(_above(n, level) > 1, F.concat(F.array(pair), path)).otherwise(path)

    if level == 0:
        return F.transform(
            kids, lambda k, i: F.struct(k["hash"].alias("hash"), k["item"].alias("item"), longer(i).alias("path"))
        )
    return F.flatten(F.transform(kids, lambda k, i: _emitted(k["kids"], level - 1, longer(i), n)))


def handed_down(rounds: list[DataFrame], top: DataFrame) -> DataFrame:
    """(g, pos, hash, item, path, top) of all nodes of the first round.

    ``top`` holds (g, path, top): the way on from each ``g``'s one digest.
    """
    above = top.select("g", F.lit(0).cast("long").alias("pos"), "path", "top")
    for held in reversed(rounds):
        subtree = held.select(
            "g", "block", F.struct("n", "kids").alias("tree"), F.lit(None).cast(above.schema["path"].dataType).alias("path"),
            F.lit(None).cast(above.schema["top"].dataType).alias("top"),
        )
        way = above.select("g", F.col("pos").alias("block"), F.lit(None).cast(subtree.schema["tree"].dataType).alias("tree"), "path", "top")
        met = subtree.unionByName(way).groupBy("g", "block").agg(
            *[F.first(c, ignorenulls=True).alias(c) for c in ("tree", "path", "top")]
        )
        kids = _emitted(F.col("tree.kids"), DIGITS - 1, F.col("path"), F.col("tree.n"))
        out = met.select("g", "block", "top", F.posexplode(kids).alias("i", "kid"))
        above = out.select(
            "g",
            (F.col("block") * RUN**DIGITS + F.col("i")).alias("pos"),
            F.col("kid.hash").alias("hash"),
            F.col("kid.item").alias("item"),
            F.col("kid.path").alias("path"),
            "top",
        )
    return above


def folded(path: Column, start: Column) -> Column:
    """The digest that a leaf leads to along its path."""
    return F.aggregate(path, start, lambda acc, s: digest(F.concat(s["before"], acc, s["after"])))


def manifest(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Per row: its id, leaf, subroot, root and path (the siblings' digests
    before and after it, from the leaf's level to the root), and ``checked``, the
    leaf of the row as found later: here with the last field's A-Z in lower case
    wherever 5 divides the crc32 of the id, so that verification has work to do.
    """
    values = [F.col(c) for c in fields]
    lowered = [*values[:-1], F.translate(values[-1].cast("string"), _UPPER, _LOWER)]
    tampered = F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0
    source = F.col(source_col).cast("string")
    rows = docs.select(
        F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("g"),  # null before all others
        F.col(id_col).alias("doc_id"),
        leaf(values).alias("hash"),
        F.when(tampered, leaf(lowered)).alias("changed"),
    )
    leaves = ranked(stored(rows), ["doc_id", "hash"])
    rounds, tops = rolled_up(leaves.select("g", "pos", "n", "hash", F.struct("doc_id", "changed").alias("item")))

    sources = tops.select(F.lit("").alias("g"), F.col("g").alias("item"), "hash")
    above, root = rolled_up(ranked(sources, ["item"]).select("g", "pos", "n", "hash", "item"))
    way = handed_down(
        above, root.select("g", F.array().cast(_PATH).alias("path"), F.col("hash").alias("top"))
    ).select(
        F.col("item").alias("g"), "path", F.struct(F.col("hash").alias("subroot"), F.col("top").alias("root")).alias("top")
    )
    return handed_down(rounds, way).select(
        F.col("item.doc_id").alias("doc_id"),
        F.col("hash").alias("leaf"),
        "top.subroot",
        "top.root",
        "path",
        F.coalesce("item.changed", "hash").alias("checked"),
    )


def verified(rows: DataFrame) -> DataFrame:
    """Fold every ``checked`` leaf along its path and compare with the root."""
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    out = rows.withColumn("proof_sha256", digest(siblings)).withColumn("folded_root", folded(F.col("path"), F.col("checked")))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
