"""MinHash near-duplicates by a signature-coordinate inverted join.

Every text becomes the set of its word shingles (64-bit hashes) and a signature
of ``coords`` coordinates, each a hash of two independent minima (two texts agree
in one with the square of their similarity, so that unrelated texts with common
word pairs seldom meet). Texts with equal sets form one class. Each class is posted
under its (coordinate, value) pairs; pairs held by one class only can't collide
and are dropped. What is left is ordered from rare to frequent, and the
``matches - 1`` most frequent postings of a class are skipped (prefix filter):
two signatures that agree in ``matches`` coordinates still meet in a posting.
Meeting classes are compared on whole signatures, pairs that agree in
``matches`` coordinates or more on their full sets.

Links within a group of n copies are never all listed. Every posting list has a
hub, its member with the most shared postings. First each class meets the hubs
of its lists; the verified links give components. A pair that could still join
two components meets in a list, so both met its hub: for every hub, the classes
outside the hub's component are held against all classes that met it, block by
block; a block returns which classes have a partner of a different component,
then their links, never all its pairs. No link that joins components is lost.

Cases: null text or text without a word has an empty set, links with nothing
and is its own component. Repeated rows share a class. Rows with a null id take
part but can't name a component (its smallest non-null id does, else null).
Columns other than the id and the text are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialize, small, tidy

#: Distinct words whose hashes a Python worker remembers before it starts anew.
WORD_CACHE = 150_000

#: Classes of a kind in one block around a hub; keys that a hub's members are
#: dealt over where hubs are too many to broadcast.
BLOCK, SALTS = 256, 32

_K1 = np.uint64(0x9E3779B97F4A7C15)
_K2 = np.uint64(0xD6E8FEB86659FD93)
_S31, _S32, _S33 = np.uint64(31), np.uint64(32), np.uint64(33)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, words: int, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles.

    A-Z are lower-cased and words are runs without space, tab, LF, VT, FF, CR
    (what ``bytes.lower`` and ``bytes.split`` do). Fewer words than a shingle
    holds: the whole sequence is the one shingle.
    """
    seq = (text or "").encode().lower().split()
    if not seq:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, seq), np.uint64, len(seq))
    size = min(words, len(seq))
    n = len(seq) - size + 1
    acc = h[:n].copy()
    for j in range(1, size):
        acc = acc * _K1 + ((h[j : j + n] << _S31) | (h[j : j + n] >> _S33))
        acc ^= acc >> _S32
    acc *= _K2
    acc ^= acc >> _S32
    acc *= _K2
    acc ^= acc >> _S32
    return np.unique(acc)


def _permutations(coords: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two per coordinate: of all first minima, then of all second ones."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 64, 2 * coords, dtype=np.uint64) | np.uint64(1)
    return a, rng.integers(0, 1 << 64, 2 * coords, dtype=np.uint64)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per coordinate a 32-bit hash of its two least permuted hashes, signed."""
    best = np.full(len(a), 0xFFFFFFFF, np.uint64)
    for k in range(0, len(shingles), 4096):
        part = (shingles[k : k + 4096, None] * a + b) >> _S32
        np.minimum(best, part.min(axis=0), out=best)
    half = len(a) // 2
    both = ((best[:half] << _S32) | best[half:]) * _K1
    return (both >> _S32).astype(np.uint32).view(np.int32)


def _signatures(words: int, coords: int, seed: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, (a, b) = _WordHashes(), _permutations(coords, seed)
        for batch in batches:
            n, digest, sig = [], [], []
            for text in batch.column(2):
                s = shingle_set(text.as_py(), words, hashes)
                n.append(len(s))
                digest.append(
                    int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())))) if len(s) else None
                )
                sig.append(signature(s, a, b) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(n, pa.int64()),
                    pa.array(digest, pa.int64()),
                    pa.array(sig, pa.list_(pa.int32())),
                ],
                names=["doc_id", "text_key", "n_shingles", "digest", "sig"],
            )

    return run


def _sets(words: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            digest, sets = [], []
            for text in batch.column(0):
                s = shingle_set(text.as_py(), words, hashes)
                digest.append(int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())))))
                sets.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(digest, pa.int64()), pa.array(sets, pa.list_(pa.int64()))],
                names=["digest", "shingles"],
            )

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over undirected edges (a, b).

    Min-label propagation with pointer jumping; every round is checkpointed.
    """
    both = materialize(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    )
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("l")), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("l").alias("l"))
        )
        hooked = labels.join(near, "node").select("node", F.least("label", "l").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        moved = materialize(
            hooked.join(jump, "label").select("node", F.least("label", "top").alias("label"), "old")
        )
        labels = moved.select("node", "label")
        if not moved.where("label <> old").limit(1).count():
            return labels


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 2,
    percent: int = 80,
    coords: int = 48,
    matches: int = 14,
    seed: int = 7,
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept, and besides
    text_key (xxhash64 of the text) and group, which tells components of one
    component_id apart where ids repeat (null for texts without a word).

    Texts are linked when ``100 * |A & B| >= percent * |A | B|`` on their full
    shingle sets. A pair at similarity 0.8 agrees in fewer than 14 of 48
    coordinates with probability below 1e-6; raise ``coords`` for less.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = materialize(
        base.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(
            _signatures(words, coords, seed),
            "doc_id long, text_key long, n_shingles long, digest long, sig array<int>",
        )
    )
    classes = materialize(
        rows.where("digest is not null")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("min_id"), F.any_value("sig").alias("sig"))
    )
    postings = classes.select("digest", F.posexplode("sig").alias("coord", "value")).select(
        "digest",
        F.shiftleft(F.col("coord").cast("long"), 32)
        .bitwiseOR(F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
        .alias("key"),
    )
    held = postings.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    of_class = Window.partitionBy("digest")
    prefix = materialize(
        postings.join(held, "key")
        .withColumn("skip", F.row_number().over(of_class.orderBy(F.desc("df"), F.desc("key"))))
        .withColumn("weight", F.sum("df").over(of_class))
        .where(F.col("skip") >= matches)
        .select("digest", "key", "weight")
    )

    hubs = (
        prefix.groupBy("key")
        .agg(F.max(F.struct("weight", "digest")).alias("top"), F.count("*").alias("n"))
        .where("n > 1")
        .select("key", F.col("top.digest").alias("hub"), (F.col("n") > 2).alias("more"))
    )
    met = materialize(prefix.join(hubs, "key").groupBy("hub", "digest").agg(F.bool_or("more").alias("more")))
    verify = _Verifier(base, classes, words, percent, matches)
    links = verify.pairs(met.where("hub <> digest").select(F.col("hub").alias("a"), F.col("digest").alias("b")))
    labels = components(links)
    # Where a list holds two classes, one is the hub: their pair has been seen.
    more = verify.around_hubs(met.where("more").select("hub", "digest"), labels)
    joined = components(
        labels.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b")).union(more.select("a", "b"))
    )

    named = classes.join(joined.withColumnRenamed("node", "digest"), "digest").select("digest", "label", "min_id")
    top = named.groupBy("label").agg(F.min("min_id").alias("top"))
    linked = named.join(top, "label").select("digest", "label", "top")
    own = classes.select("digest", "min_id").join(linked, "digest", "left").select(
        "digest", F.coalesce("label", "digest").alias("group"), F.coalesce("top", "min_id").alias("component")
    )
    # Rows without a shingle stay out of the join: nulls would all meet in one task.
    placed = rows.where("digest is not null").drop("sig").join(own, "digest", "left")
    none = F.lit(None).cast("long").alias("group")
    empty = rows.where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_key", none)
    found = placed.select("doc_id", "n_shingles", F.col("component").alias("component_id"), "text_key", "group").union(empty)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


class _Verifier:
    """Finds the links among classes that met, by signatures and then full sets."""

    def __init__(self, base, classes, words, percent, matches):
        self.base, self.classes = base, classes
        self.words, self.percent, self.matches = words, percent, matches

    def sets(self, wanted: DataFrame) -> DataFrame:
        """(digest, shingles) of the wanted classes, from a text of each.

        A class is found by its smallest id (null ids meet null-safely).
        """
        ids = materialize(self.classes.join(wanted, "digest").select(F.col("min_id").alias("want")).distinct())
        return materialize(
            self.base.join(small(ids), F.col("doc_id").eqNullSafe(F.col("want")), "left_semi")
            .select("text")
            .mapInArrow(_sets(self.words), "digest long, shingles array<long>")
            .join(wanted, "digest", "left_semi")
            .dropDuplicates(["digest"])
        )

    def pairs(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that are linked."""
        sig = self.classes.select("digest", "sig")
        agree = F.aggregate(
            F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x
        )
        near = materialize(
            pairs.join(sig.select(F.col("digest").alias("b"), F.col("sig").alias("sb")), "b")
            .join(sig.select(F.col("digest").alias("a"), F.col("sig").alias("sa")), "a")
            .where(agree >= self.matches)
            .select("a", "b")
        )
        sets = self.sets(near.select(F.col("a").alias("digest")).union(near.select("b")).distinct())
        na, nb = F.size("xa"), F.size("xb")
        both = F.size(F.array_intersect("xa", "xb"))
        return materialize(
            near.join(sets.select(F.col("digest").alias("b"), F.col("shingles").alias("xb")), "b")
            .join(sets.select(F.col("digest").alias("a"), F.col("shingles").alias("xa")), "a")
            .where(100 * both >= self.percent * (na + nb - both))
            .select("a", "b")
        )

    def around_hubs(self, met: DataFrame, labels: DataFrame) -> DataFrame:
        """Links (a, b) between different components among the classes of a hub."""
        named = labels.withColumnRenamed("node", "digest")
        members = met.join(named, "digest", "left").select("hub", "digest", F.coalesce("label", "digest").alias("label"))
        home = members.where("hub = digest").select("hub", F.col("label").alias("home"))
        members = materialize(_hub_join(members, home).withColumn("out", F.col("label") != F.col("home")))
        sig = self.classes.select("digest", F.col("sig").cast("array<long>").alias("items"))
        near = _blocks(members, sig, _partners(self.matches), "hub long, digest long")
        members = materialize(members.join(near.distinct(), ["hub", "digest"], "left_semi"))
        sets = self.sets(members.select("digest").distinct()).withColumnRenamed("shingles", "items")
        return materialize(_blocks(members, sets, _links(self.percent), "a long, b long").distinct())


def _hub_join(members: DataFrame, per_hub: DataFrame) -> DataFrame:
    """Join rows of many hubs with one row per hub: broadcast where these are few,
    else with every hub's members dealt over ``SALTS`` keys."""
    per_hub = materialize(per_hub)
    if per_hub.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return members.join(F.broadcast(per_hub), "hub")
    salt = F.pmod(F.xxhash64("digest"), F.lit(SALTS)).cast("int").alias("salt")
    many = per_hub.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return members.select("*", salt).join(many, ["hub", "salt"]).drop("salt")


def _blocks(members: DataFrame, items: DataFrame, fn, schema: str) -> DataFrame:
    """Apply ``fn`` to blocks of a hub's classes against blocks of its outsiders.

    Every class stands in one block of targets, every outsider also in one block
    of queries; a target meets each query block once. A group holds about
    ``BLOCK`` rows of either kind, whatever the hub's size.
    """
    sizes = members.groupBy("hub").agg(
        F.ceil(F.count("*") / BLOCK).alias("bt"), F.ceil(F.count_if("out") / BLOCK).alias("bq")
    ).where("bq > 0")
    held = _hub_join(members, sizes).join(items, "digest")
    spread = F.pmod(F.xxhash64("digest"), F.lit(1 << 30))
    columns = ["hub", "t", "q", "query", "digest", "label", "items"]
    targets = held.withColumn("query", F.lit(False)).withColumn("t", spread % F.col("bt")).withColumn(
        "q", F.explode(F.sequence(F.lit(0), F.col("bq") - 1))
    )
    queries = held.where("out").withColumn("query", F.lit(True)).withColumn("q", spread % F.col("bq")).withColumn(
        "t", F.explode(F.sequence(F.lit(0), F.col("bt") - 1))
    )
    return targets.select(columns).union(queries.select(columns)).groupBy("hub", "t", "q").applyInArrow(fn, schema)


def _sides(group: pa.Table):
    query = group["query"].to_numpy(zero_copy_only=False)
    digest, label = group["digest"].to_numpy(), group["label"].to_numpy()
    items = group["items"].to_pylist()
    q, t = np.flatnonzero(query), np.flatnonzero(~query)
    return digest, label, items, q, t


def _partners(matches: int):
    """Of a block: the classes that agree with one of another component."""

    def run(group: pa.Table) -> pa.Table:
        digest, label, items, q, t = _sides(group)
        near: set[int] = set()
        if len(q) and len(t):
            table = np.array([items[i] for i in t], np.int64)
            for i in q:
                hit = t[((table == np.array(items[i], np.int64)).sum(axis=1) >= matches) & (label[t] != label[i])]
                if len(hit):
                    near.add(int(digest[i]))
                    near.update(digest[hit].tolist())
        hub = group["hub"][0].as_py()
        return pa.table({"hub": pa.array([hub] * len(near), pa.int64()), "digest": pa.array(sorted(near), pa.int64())})

    return run


def _links(percent: int):
    """Of a block: the links between its queries and targets of other components."""

    def run(group: pa.Table) -> pa.Table:
        digest, label, items, q, t = _sides(group)
        a, b = [], []
        if len(q) and len(t):
            sizes = np.array([len(x) for x in items], np.int64)
            flat = np.concatenate([np.array(items[i], np.int64) for i in t])
            owner = np.repeat(np.arange(len(t)), sizes[t])
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            for i in q:
                own = np.array(items[i], np.int64)
                lo, hi = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
                n = hi - lo
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                both = np.bincount(owner[at], minlength=len(t))
                good = (100 * both >= percent * (sizes[i] + sizes[t] - both)) & (label[t] != label[i])
                for j in t[good]:
                    a.append(min(digest[i], digest[j]))
                    b.append(max(digest[i], digest[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run
