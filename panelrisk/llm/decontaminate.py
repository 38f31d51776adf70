"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame
operations only.

1. Windows. A document can hold a passage that is similar to an item only where
   it shares some of the item's shingles; of these the rarest are indexed, just
   so many that a similar passage can't miss them all. In a document where one
   occurs, all places of the item's shingles are looked up, and every window of
   the item's number of words that holds enough of them for the threshold is cut
   out, in whatever order they stand (the whole document, if it is shorter). All
   other windows of the item's size have a similarity below the threshold.
2. Fingerprints. A window's SimHash has 256 bits, each the majority of its words'
   hash bits, in 16 blocks. Two fingerprints within 63 bits differ by at most three
   bits in some block. Items are indexed under every block value with up to two bits
   flipped, windows look up theirs with up to one flipped, so all such pairs meet;
   two unrelated blocks meet in 1 % of the cases.
3. Verification. Candidates are compared by weighted shingles: the sum of the
   lesser over the sum of the greater number of occurrences, at least
   ``percent`` / 100.

Equal texts are searched once. Words are lower-cased and parted by white space; a
shingle is ``words`` words, or the whole text of shorter items. Cases: null or
empty texts and items match nothing; repeated rows are reported each; items that
repeat an id count as separate items; rows with null ids are reported with a null
id; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small, stored

WORDS, PERCENT = 5, 80
#: 64-bit parts of a fingerprint, its blocks, their bits, and the bits flipped in an
#: item's and in a window's block.
PARTS, BLOCKS, BLOCK_BITS, ITEM_FLIPS, WINDOW_FLIPS = 4, 16, 16, 2, 1
#: Greatest Hamming distance at which a block with so few flips must exist.
RADIUS = BLOCKS * (ITEM_FLIPS + WINDOW_FLIPS + 1) - 1


def _words(text: Column) -> Column:
    return F.split(F.btrim(F.lower(text), F.lit(" \t\n\u000b\f\r")), "[\\x20\\x09-\\x0D]+")


def _shingle_hashes(hashes: str, size: int) -> Column:
    """Hash of the ``size`` word hashes from each place on (none if fewer)."""
    at = ", ".join(f"get({hashes}, i + {j})" for j in range(size))
    return F.expr(
        f"if(size({hashes}) < {size}, array(), transform(sequence(0, size({hashes}) - {size}), i -> xxhash64({at})))"
    )


def _fingerprint(hashes: str) -> Column:
    """Array of the fingerprint's 64-bit parts; each has word hashes of its own."""
    ones = "aggregate(own, 0, (n, x) -> n + if((shiftright(x, b) & 1L) = 1L, 1, -1))"
    bits = f"aggregate(sequence(0, 63), 0L, (f, b) -> f | if({ones} > 0, shiftleft(1L, b), 0L))"
    part = f"transform(array(transform({hashes}, x -> xxhash64(x, k))), own -> {bits})[0]"
    return F.expr(f"transform(sequence(0, {PARTS - 1}), k -> {part})")


def _block_keys(fingerprint: str, flips: int) -> Column:
    """Array of (words, block, value) as one number: every block's value, and all
    values that differ from it by at most ``flips`` bits."""
    masks = [sum(1 << i for i in c) for n in range(flips + 1) for c in combinations(range(BLOCK_BITS), n)]
    a_part = BLOCKS // PARTS
    value = f"shiftrightunsigned({fingerprint}[b div {a_part}], int(b % {a_part}) * {BLOCK_BITS}) & {(1 << BLOCK_BITS) - 1}L"
    named = f"shiftleft(wanted * {BLOCKS}L + b, {BLOCK_BITS}) | ((v ^ m))"
    of_block = f"transform(array({value}), v -> transform(array({', '.join(f'{m}L' for m in masks)}), m -> {named}))[0]"
    return F.expr(f"flatten(transform(sequence(0, {BLOCKS - 1}), b -> {of_block}))")


def _hamming(a: str, b: str) -> Column:
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x ^ y)), 0, (n, x) -> n + x)")


def _shingles(words: str, size: str) -> str:
    return f"transform(sequence(0, size({words}) - {size}), i -> array_join(slice({words}, i + 1, {size}), ' '))"


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Like ``withColumn``, but the value is computed once a row: a generator, so
    that the optimizer doesn't write the expression out wherever it is used."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _shared() -> Column:
    """Weight shared by the shingles ``ws`` and ``vs``."""
    n = "size(filter({0}, y -> y = x))"
    repeats = f"aggregate(array_intersect(ws, vs), 0, (n, x) -> n + least({n.format('ws')}, {n.format('vs')}))"
    return F.expr(f"if(size(array_distinct(vs)) = size(vs), size(array_intersect(ws, vs)), {repeats})")


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    words: int = WORDS,
    percent: int = PERCENT,
) -> DataFrame:
    """A row for each document and item it holds: doc_id, text_key, item_id,
    start_word, hamming, similarity (of the most similar window)."""
    items = materialize(
        benchmark.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).alias("t"))
        .where(F.length(F.btrim("t", F.lit(" \t\n\u000b\f\r"))) > 0)
        .distinct()
        .select("item_id", _words(F.col("t")).alias("item_words"))
        .withColumn("item", F.xxhash64("item_id", "item_words"))
        .withColumn("wanted", F.size("item_words"))
        .withColumn("size", F.least(F.lit(words), F.size("item_words")))
        .withColumn("h", F.transform("item_words", lambda w: F.xxhash64(w)))
        .withColumn("item_print", _fingerprint("h"))
        .withColumn("vs", F.expr(_shingles("item_words", "size")))
    )
    sizes = [r.size for r in items.select("size").distinct().collect()]  # at most ``words`` values
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    texts = texts.withColumn("text_key", F.xxhash64("text"))

    placed = {s: _placed(items.where(F.col("size") == s), s) for s in sorted(sizes)}
    pairs = {s: materialize(_pairs(texts, placed[s], s, percent)) for s in placed}
    named = texts.limit(0).select("text_key")
    for found in pairs.values():
        named = named.union(found.select("text_key"))
    held = stored(texts.join(small(materialize(named.distinct())), "text_key", "left_semi"))
    once = held.select("text_key", "text").dropDuplicates(["text_key"])
    windows = texts.limit(0).select("text_key", F.lit(0).alias("wanted"), F.lit(0).alias("size"), F.lit(0).alias("start"))
    for s, found in pairs.items():
        windows = windows.union(_windows(once, found, placed[s], s, percent))
    windows = materialize(windows.distinct())

    cut = (
        once.select("text_key", _words(F.col("text")).alias("all_words"))
        .join(windows, "text_key")
        .select("text_key", "wanted", "size", "start", F.slice("all_words", F.col("start") + 1, F.col("wanted")).alias("w"))
    )
    # Few bytes, but much work a row: dealt anew, so that it is spread over all tasks.
    dealt = cut.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "text_key", "wanted", "start")
    hashed = _once(dealt, "h", F.transform("w", lambda w: F.xxhash64(w))).withColumn("ws", F.expr(_shingles("w", "size")))
    prints = _once(hashed, "print", _fingerprint("h")).drop("h", "w")
    prints = materialize(prints.withColumn("window", F.xxhash64("text_key", "wanted", "start")))

    index = materialize(items.select("item", F.explode(_block_keys("item_print", ITEM_FLIPS)).alias("key")).distinct())
    probes = prints.select("window", F.explode(_block_keys("print", WINDOW_FLIPS)).alias("key"))
    met = materialize(probes.join(small(index), "key").select("window", "item").distinct())
    known = items.select("item", "item_id", F.col("wanted").alias("item_wanted"), "vs", "item_print")
    near = (
        met.join(prints, "window")
        .join(known, "item")
        .withColumn("hamming", _hamming("print", "item_print"))
        .where((F.col("wanted") == F.col("item_wanted")) & (F.col("hamming") <= RADIUS))
    )
    hits = (
        _once(near, "shared", _shared())
        .withColumn("united", F.size("ws") + F.size("vs") - F.col("shared"))
        .where(100 * F.col("shared") >= percent * F.col("united"))
        .select("text_key", "item", "item_id", "start", "hamming", (F.col("shared") / F.col("united")).alias("similarity"))
    )
    best = hits.groupBy("text_key", "item", "item_id").agg(
        F.max(F.struct("similarity", -F.col("hamming"), -F.col("start"))).alias("b")
    )
    best = best.select(
        "text_key",
        "item_id",
        (-F.col("b.col3")).alias("start_word"),
        (-F.col("b.col2")).cast("int").alias("hamming"),
        F.col("b.similarity").alias("similarity"),
    )
    return held.select("doc_id", "text_key").join(best, "text_key").select(
        "doc_id", "text_key", "item_id", "start_word", "hamming", "similarity"
    )


def _placed(items: DataFrame, size: int) -> DataFrame:
    """(body, wanted, total, s, n): the shingles of each different item text of
    this shingle size, their number in it, and how many it has in all."""
    bodies = items.select(F.xxhash64("item_words").alias("body"), "wanted", "h").dropDuplicates(["body"])
    shingles = bodies.select("body", "wanted", F.explode(_shingle_hashes("h", size)).alias("s"))
    total = F.col("wanted") - size + 1
    return materialize(shingles.groupBy("body", "wanted", "s").agg(F.count("*").alias("n")).withColumn("total", total))


def _text_shingles(texts: DataFrame, size: int) -> DataFrame:
    """(text_key, n_words, pos, s) of every shingle."""
    hashed = texts.select("text_key", F.transform(_words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    return hashed.select("text_key", F.size("h").alias("n_words"), F.posexplode(_shingle_hashes("h", size)).alias("pos", "s"))


def _pairs(texts: DataFrame, placed: DataFrame, size: int, percent: int) -> DataFrame:
    """(text_key, body): texts that hold an indexed shingle of an item."""
    common = placed.groupBy("s").agg(F.sum("n").alias("df"))
    rare_first = Window.partitionBy("body").orderBy("df", "s").rowsBetween(Window.unboundedPreceding, -1)
    indexed = (
        placed.join(common, "s")
        .withColumn("before", F.coalesce(F.sum("n").over(rare_first), F.lit(0)))
        .where(100 * F.col("before") <= (100 - percent) * F.col("total"))
    )
    indexed = materialize(indexed.select("s", "body").distinct())
    shingles = _text_shingles(texts, size).select("text_key", "s")
    return shingles.join(small(indexed), "s").select("text_key", "body").distinct()


def _windows(texts: DataFrame, pairs: DataFrame, placed: DataFrame, size: int, percent: int) -> DataFrame:
    """(text_key, wanted, size, start): the windows in which enough shingles are
    the item's for the threshold.

    A window of ``held`` shingles needs ``least`` in common with the item's
    ``total``. ``least`` places in a row (p[i - 1] to p[i + least - 2]) that fit
    into a window allow the starts from ``low`` to ``high``; those up to the place
    before are left to it, so no start is listed twice.
    """
    placed = placed.select("body", "wanted", "total", "s")
    hits = _text_shingles(texts, size).join(pairs.join(placed, "body"), ["text_key", "s"])
    places = (
        hits.groupBy("text_key", "body", "wanted", "total", "n_words")
        .agg(F.sort_array(F.collect_list("pos")).alias("p"))
        .withColumn("held", F.expr(f"least(total, n_words - {size} + 1)"))
        .withColumn("least", F.expr(f"int(greatest(1, ({percent} * (held + total) + {99 + percent}) div {100 + percent}))"))
        .where(F.size("p") >= F.col("least"))
    )
    ranges = F.expr(
        """transform(sequence(1, size(p) - least + 1), i -> named_struct(
            'fits', p[i + least - 2] - p[i - 1] < held,
            'low', greatest(0, p[i + least - 2] - held + 1, if(i > 1, get(p, i - 2) + 1, 0)),
            'high', least(p[i - 1], greatest(0, n_words - wanted))))"""
    )
    starts = places.select("text_key", "wanted", F.explode(F.filter(ranges, lambda r: r["fits"] & (r["low"] <= r["high"]))).alias("r"))
    return starts.select("text_key", "wanted", F.lit(size).alias("size"), F.explode(F.sequence("r.low", "r.high")).alias("start"))
