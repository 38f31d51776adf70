"""Exact removal of repeated byte strings by sharded suffix arrays.

A window is a string of ``width`` bytes at one position of a text. Windows that
occur at two positions anywhere are found in four steps:

1. *Strings.* Every window is named by the least hash of its ``GRAM``-byte
   pieces; neighbouring windows of one name make one string. Equal windows have
   equal names, so all their occurrences are strings of one name.
2. *Names.* Names that occur once hold no repeat. Strings that occur twice as a
   whole are repeats as they are. Only names with several different strings, or
   with one that may overlap itself, go on, each different string once.
3. *Shards.* Names are dealt over shards of about ``shard_bytes``. A shard's
   strings are concatenated, its suffix array is made by Larsson-Sadakane
   refinement (sort by eight bytes, then double the depth, only within groups
   that are still equal) and its common prefixes by Kasai's rule. Neighbours that
   share ``width`` bytes are repeats.
4. *Merging.* A name with more bytes than two shards has shards of its own. First,
   strings of which no window's digest occurs twice leave; then every pair of its
   shards is merged by binary search of one's windows among the other's.

Cases: null text counts as empty; texts shorter than ``width`` have no window;
repeated rows and copies of a text repeat each other wholly; matches never cross
texts; rows with a null id are ordinary rows; long texts are read whole, in
overlapping pieces; other columns are ignored. An empty table gives no rows.

Texts are told apart by 128 bits of their SHA-256. Strings of one name are told
apart by 64 more bits: among 10^9 different ones of a single name, a confusion has
a chance of 3 %, among 10^6 of 3e-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialize, small, stored, tidy

#: Bytes of the pieces whose least hash names a window.
GRAM = 32
#: Bytes of a shard, and of a piece of text that is hashed at a time.
SHARD_BYTES, PIECE = 1 << 20, 1 << 20

_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_S29, _S32 = np.uint64(29), np.uint64(32)


def words_at(data: bytes) -> np.ndarray:
    """Of each position its next eight bytes as a number, zeros beyond the end."""
    padded = data + b"\0" * 8
    return np.ndarray((len(data),), ">u8", padded, 0, (1,)).astype(np.uint64)


def gram_hashes(words: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of the ``gram`` bytes (a multiple of 8, at most 32) at each position."""
    n = max(0, len(words) - gram + 1)
    acc = np.zeros(n, np.uint64)
    for i in range(gram // 8):
        acc += (words[8 * i : 8 * i + n] ^ (words[8 * i : 8 * i + n] >> _S29)) * _K[i]
        acc ^= acc >> _S32
        acc *= _K[3]
    acc ^= acc >> _S32
    return acc


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """Least of every ``size`` neighbours, by running minima of blocks from both ends."""
    n = len(values) - size + 1
    if n <= 0:
        return np.empty(0, values.dtype)
    full = np.full(-(-len(values) // size) * size, np.iinfo(values.dtype).max, values.dtype)
    full[: len(values)] = values
    grid = full.reshape(-1, size)
    head = np.minimum.accumulate(grid, axis=1).ravel()
    tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:n], head[size - 1 : size - 1 + n])


def _pieces(texts: list[bytes], width: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (text, offset, piece) of about ``PIECE`` bytes; a long text comes in
    pieces that overlap by ``width - 1`` bytes, so each window is in one of them."""
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for i, text in enumerate(texts):
        for at in range(0, len(text) - width + 1, PIECE):
            piece = text[at : at + PIECE + width - 1]
            held.append((i, at, piece))
            size += len(piece)
            if size >= PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


def named_strings(texts: list[bytes], width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Of all texts their strings: (text, start, windows, name, digest, again), where
    ``again`` tells whether the name's piece stands in it more than once."""
    grams = width - GRAM + 1
    for held in _pieces(texts, width):
        data = b"".join(piece for _, _, piece in held)
        hashes = gram_hashes(words_at(data))
        least = sliding_min(hashes, grams)
        ends = np.cumsum([len(piece) for _, _, piece in held])
        begins = np.concatenate([[0], ends[:-1]])
        valid = np.ones(len(least), bool)
        for e in ends[:-1]:
            valid[max(0, e - width + 1) : e] = False
        at = np.flatnonzero(valid)
        name = least[at]
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (name[1:] != name[:-1])
        first = np.flatnonzero(new)
        start, name = at[first], name[first]
        windows = np.diff(np.append(first, len(at)))
        piece = np.searchsorted(ends, start, side="right")
        digest = np.empty(len(start), np.uint64)
        again = np.empty(len(start), bool)
        view = memoryview(data)
        for k, (s, n, v) in enumerate(zip(start.tolist(), windows.tolist(), name, strict=True)):
            digest[k] = xxhash.xxh3_64_intdigest(view[s : s + n + width - 1])
            again[k] = np.count_nonzero(hashes[s : s + n + grams - 1] == v) > 1
        text = np.array([i for i, _, _ in held], np.int64)[piece]
        offset = np.array([o for _, o, _ in held], np.int64)[piece]
        yield text, start - begins[piece] + offset, windows, name.view(np.int64), digest.view(np.int64), again


def suffix_array(data: bytes) -> np.ndarray:
    """Positions of ``data`` in the order of their suffixes.

    Suffixes are sorted by eight bytes, then by 16, 32, ...: in a round only the
    groups that are still equal are sorted, by the rank of what follows.
    """
    n = len(data)
    words = words_at(data)
    # Of equal words later positions come first: those cut off by the end.
    order = n - 1 - np.argsort(words[::-1], kind="stable")
    new = np.ones(n, bool)
    new[1:] = words[order[1:]] != words[order[:-1]]
    new[1:] |= order[:-1] > n - 8
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    depth = 8
    open_ = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(open_):
        at = order[open_]
        after = at + depth
        key = rank[at] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[open_] = at
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        rank[at] = open_[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        open_ = open_[~(new & np.append(new[1:], True))]
        depth *= 2
    return order


def _equal_bytes(x: np.ndarray) -> np.ndarray:
    """Leading zero bytes of non-zero numbers."""
    out = np.zeros(len(x), np.int64)
    for step in (4, 2, 1):
        none = (x >> np.uint64(64 - 8 * step)) == 0
        out[none] += step
        x = np.where(none, x << np.uint64(8 * step), x)
    return out


def common_prefixes(data: bytes, order: np.ndarray, limit: int, chain: int = 512) -> np.ndarray:
    """Of each entry of the suffix array the bytes it shares with the one before,
    up to ``limit``.

    Kasai's rule: a position shares at least one byte less than the position
    before it did with its own neighbour. Chains of ``chain`` positions go through
    the text side by side.
    """
    n = len(data)
    words = words_at(data + b"\0" * (limit + 8))
    before = np.full(-(-n // chain) * chain, -1, np.int64)
    before[order[1:]] = order[:-1]
    shared = np.zeros(len(before), np.int64)
    starts = np.arange(0, len(before), chain)
    have = np.zeros(len(starts), np.int64)
    for step in range(chain):
        i = starts + step
        j = before[i]
        have = np.where(j >= 0, np.maximum(have - 1, 0), 0)
        go = np.flatnonzero((j >= 0) & (have < limit))
        while len(go):
            x = words[i[go] + have[go]] ^ words[j[go] + have[go]]
            equal = x == 0
            rest = go[~equal]
            have[rest] += _equal_bytes(x[~equal])
            go = go[equal]
            have[go] += 8
            go = go[have[go] < limit]
        have = np.minimum(have, np.where(j >= 0, n - np.maximum(i, j), 0))
        shared[i] = have
    return np.minimum(shared[order], limit)


class _Strings:
    """The strings of a shard, one after the other, and their windows."""

    def __init__(self, contents: list[bytes], width: int):
        self.width = width
        self.data = b"".join(contents)
        size = np.array([len(c) for c in contents], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        self.valid = np.ones(len(self.data), bool)
        for e in np.cumsum(size):
            self.valid[e - width + 1 : e] = False
        self.order = suffix_array(self.data)
        self.hit = np.zeros(len(self.data), bool)

    def within(self) -> None:
        """Mark the windows that occur twice here."""
        shared = common_prefixes(self.data, self.order, self.width)
        group = np.cumsum(shared < self.width) - 1
        valid = self.valid[self.order]
        counts = np.bincount(group[valid], minlength=len(self.order))
        self.hit[self.order[valid & (counts[group] > 1)]] = True

    def across(self, other: _Strings) -> None:
        """Mark, on both sides, the windows that occur here and in ``other``: each
        of these is looked for among the sorted windows of the other by halving."""
        mine = self.order[self.valid[self.order]]
        theirs = other.order[other.valid[other.order]]
        a, b = words_at(self.data), words_at(other.data)

        def bound(after_equal: bool) -> np.ndarray:
            low, high = np.zeros(len(mine), np.int64), np.full(len(mine), len(theirs), np.int64)
            while len(live := np.flatnonzero(low < high)):
                mid = (low[live] + high[live]) // 2
                order = _compare(a, mine[live], b, theirs[mid], self.width)
                up = (order >= 0) if after_equal else (order > 0)
                low[live[up]] = mid[up] + 1
                high[live[~up]] = mid[~up]
            return low

        first, last = bound(False), bound(True)
        found = last > first
        self.hit[mine[found]] = True
        edges = np.bincount(first[found], minlength=len(theirs) + 1) - np.bincount(last[found], minlength=len(theirs) + 1)
        other.hit[theirs[np.cumsum(edges[: len(theirs)]) > 0]] = True

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(string, first, end) of the runs of marked windows."""
        at = np.flatnonzero(self.hit)
        owner = np.searchsorted(self.begin, at, side="right") - 1
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (np.diff(owner) != 0)
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(at)))
        begin = at[first] - self.begin[owner[first]]
        return owner[first], begin, begin + n


def _compare(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, width: int) -> np.ndarray:
    """Sign of the comparison of the windows at ``i`` and ``j``, eight bytes a step."""
    sign = np.zeros(len(i), np.int64)
    live = np.arange(len(i))
    for at in [*range(0, width - 8, 8), width - 8]:
        x, y = a[i[live] + at], b[j[live] + at]
        sign[live] = (x > y).astype(np.int64) - (x < y)
        live = live[x == y]
        if not len(live):
            break
    return sign


def _shard(width: int):
    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        pair = key[0].as_py()
        rows = group.select(["part", "v", "d", "c", "content"]).to_pylist()
        once = {(r["v"], r["d"]): r for r in rows}  # a repeated row brings its strings again
        sides = [[r for r in once.values() if r["part"] == p] for p in sorted({pair["a"], pair["b"]})]
        out: list[tuple[int, int, int, int]] = []
        if all(sides):
            built = [_Strings([r["content"] for r in s], width) for s in sides]
            if len(built) == 1:
                built[0].within()
            else:
                built[0].across(built[1])
            for side, b in zip(sides, built, strict=True):
                for owner, first, end in zip(*(x.tolist() for x in b.runs()), strict=True):
                    if side[owner]["c"] == 1:
                        out.append((side[owner]["v"], side[owner]["d"], first, end))
        pa.default_memory_pool().release_unused()
        columns = zip(*out, strict=True) if out else [[], [], [], []]
        return pa.table([pa.array(list(c), pa.int64()) for c in columns], names=["v", "d", "first", "end"])

    return run


def window_digests(content: bytes, width: int) -> np.ndarray:
    """A 64-bit digest of every window (``width`` a multiple of 8), from running
    sums of its 8-byte words times powers of an odd number."""
    words = words_at(content)
    n, steps = len(content) - width + 1, width // 8
    rows = -(-len(content) // 8)
    grid = np.zeros(rows * 8, np.uint64)
    grid[: len(words)] = (words ^ (words >> _S29)) * _K[0]
    inverse = np.uint64(pow(int(_K[3]), -1, 1 << 64))
    power = np.cumprod(np.full(rows, _K[3]))
    back = np.cumprod(np.full(rows, inverse))
    sums = np.zeros((rows + 1, 8), np.uint64)
    np.cumsum(grid.reshape(-1, 8) * power[:, None], axis=0, out=sums[1:])
    at = np.arange(n)
    total = (sums[at // 8 + steps, at % 8] - sums[at // 8, at % 8]) * back[at // 8]
    return (total ^ (total >> _S32)).view(np.int64)


def _digests(width: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                found = [np.unique(window_digests(c.as_py(), width), return_counts=True) for c in part.column("content")]
                of = np.repeat(np.arange(part.num_rows), [len(w) for w, _ in found])
                yield pa.RecordBatch.from_arrays(
                    [part.column("v").take(of), part.column("d").take(of)]
                    + [pa.array(np.concatenate([f[i] for f in found])) for i in (0, 1)],
                    names=["v", "d", "w", "n"],
                )

    return run


def _with_repeated_windows(strings: DataFrame, width: int) -> DataFrame:
    """Of the strings (v, d, content) those with a window whose digest occurs twice."""
    windows = materialize(strings.select("v", "d", "content").mapInArrow(_digests(width), "v long, d long, w long, n long"))
    twice = windows.groupBy("v", "w").agg(F.sum("n").alias("n")).where("n > 1").select("v", "w")
    kept = materialize(windows.join(twice, ["v", "w"], "left_semi").select("v", "d").distinct())
    return strings.join(small(kept), ["v", "d"], "left_semi")


def _dealt(strings: DataFrame, width: int, shard_bytes: int) -> DataFrame:
    """(shard, part, v, d, c, content): strings dealt over shards; those of a name
    that fills several meet in one group for each pair of its parts."""
    size = F.sum(F.octet_length("content"))
    names = materialize(strings.groupBy("v").agg(size.alias("bytes")))
    hot = names.where(F.col("bytes") > 2 * shard_bytes).select("v")
    cold_bytes = names.where(F.col("bytes") <= 2 * shard_bytes).agg(F.sum("bytes")).first()[0] or 0
    n_shards = -(-cold_bytes // shard_bytes) or 1
    fields = ["v", "d", "c", "content"]

    def named(s: Column, a: Column, b: Column) -> Column:
        return F.struct(s.alias("s"), a.alias("a"), b.alias("b")).alias("shard")

    some_hot = hot.limit(1).count() > 0
    cold = strings.join(small(hot), "v", "left_anti") if some_hot else strings
    shard = named(F.pmod(F.xxhash64("v"), F.lit(n_shards)), F.lit(-1), F.lit(-1))
    cold = cold.select(shard, F.lit(-1).alias("part"), *fields)
    if not some_hot:
        return cold
    left = stored(_with_repeated_windows(strings.join(small(hot), "v", "left_semi"), width))
    parts = materialize(left.groupBy("v").agg(F.ceil(size / shard_bytes).cast("int").alias("parts")))
    dealt = left.join(small(parts), "v").withColumn("part", F.pmod(F.xxhash64("d"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    met = dealt.withColumn("other", other)
    pair = named(F.col("v"), F.least("part", "other"), F.greatest("part", "other"))
    return cold.union(met.select(pair, "part", *fields))


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 400, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """Per text that holds repeats: its ``text_key`` and ``spans``, the sorted byte
    ranges (start, end) covered by ``width``-byte strings that also start
    elsewhere. ``width`` is a multiple of 8, at least 40."""
    base = docs.select(F.col(id_col).alias("id"), _bytes(text_col).alias("text")).where(F.octet_length("text") >= width)
    keyed = base.select("id", text_key(F.col("text")).alias("key"), "text")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, *columns in named_strings([t.as_py() for t in batch.column(2)], width):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(text), batch.column(1).take(text), *map(pa.array, columns)],
                    names=["id", "key", "start", "n", "v", "d", "again"],
                )

    id_type = keyed.schema["id"].dataType.simpleString()
    strings = stored(
        keyed.mapInArrow(run, f"id {id_type}, key binary, start long, n long, v long, d long, again boolean")
    )
    names = strings.groupBy("v").agg(
        F.count("*").alias("c"), F.min("d").alias("least"), F.max("d").alias("most"), F.bool_or("again").alias("again")
    )
    live = materialize(
        names.where("c > 1 or again").select("v", (F.expr("least <> most") | F.col("again")).alias("search"))
    )
    different = stored(
        strings.join(small(live), "v")
        .groupBy("v", "d")
        .agg(F.count("*").alias("c"), F.any_value("search").alias("search"), F.min(F.struct("key", "id", "start", "n")).alias("at"))
        .select("v", "d", "c", "search", "at.*")
    )
    wanted = different.where("search").select("v", "d", "c", "start", "n", F.col("key").alias("of"), F.col("id").alias("whose"))
    found = keyed.join(small(wanted), (F.col("key") == F.col("of")) & F.col("id").eqNullSafe(F.col("whose")))
    content = F.col("text").substr((F.col("start") + 1).cast("int"), (F.col("n") + width - 1).cast("int"))
    contents = stored(found.select("v", "d", "c", content.alias("content")))
    hits = _dealt(contents, width, shard_bytes).groupBy("shard").applyInArrow(
        _shard(width), "v long, d long, first long, end long"
    )
    whole = different.where("c > 1").select("v", "d", F.lit(0).cast("long").alias("first"), F.col("n").alias("end"))
    hits = materialize(hits.union(whole))
    covered = strings.join(small(hits), ["v", "d"]).select(
        "key", F.struct((F.col("start") + F.col("first")).alias("start"), (F.col("start") + F.col("end") + width - 1).alias("end")).alias("span")
    )
    return covered.groupBy(F.col("key").alias("text_key")).agg(_merged(F.collect_set("span")).alias("spans"))


def _merged(spans: Column) -> Column:
    """Ranges that overlap or touch become one: a range opens where its start lies
    beyond all ends before it."""
    ordered = F.sort_array(spans)
    state = "struct<spans: array<struct<start: bigint, end: bigint>>, start: bigint, end: bigint>"
    begin = F.struct(F.array().cast("array<struct<start: bigint, end: bigint>>"), F.lit(None), F.lit(None)).cast(state)

    def add(acc: Column, s: Column) -> Column:
        def to(spans: Column, start: Column, end: Column) -> Column:
            return F.struct(spans.alias("spans"), start.alias("start"), end.alias("end"))

        one = F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end")))
        return (
            F.when(acc["start"].isNull(), to(acc["spans"], s["start"], s["end"]))
            .when(s["start"] <= acc["end"], to(acc["spans"], acc["start"], F.greatest(acc["end"], s["end"])))
            .otherwise(to(F.concat(acc["spans"], one), s["start"], s["end"]))
        )

    return F.aggregate(ordered, begin, add, lambda acc: F.concat(acc["spans"], F.array(F.struct(acc["start"], acc["end"]))))


def _bytes(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")


def text_key(data: Column) -> Column:
    """128 bits of the text's SHA-256."""
    return F.unhex(F.substring(F.sha2(data, 256), 1, 32))


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 400, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """Per row: doc_id, n_bytes, ``spans`` (the removed byte ranges) and ``kept``,
    the remaining bytes."""
    spans = materialize(repeated_spans(docs, id_col, text_col, width, shard_bytes))
    total = spans.agg(F.sum(F.size("spans"))).first()[0] or 0
    if total <= BROADCAST_ROWS:
        spans = F.broadcast(spans)
    data = _bytes(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), data.alias("data"), F.octet_length(data).cast("long").alias("n_bytes"))
    key = F.when(F.col("n_bytes") >= width, text_key(F.col("data")))  # short texts stay out of the join
    joined = rows.join(spans, key == F.col("text_key"), "left").withColumn(
        "spans", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType))
    )
    # What lies between the spans; bytes travel as strings, which Spark joins unchanged.
    edges = F.concat(F.array(F.lit(0).cast("long")), F.col("spans.end"))
    gaps = F.transform(
        F.arrays_zip(edges.alias("from"), F.concat(F.col("spans.start"), F.array("n_bytes")).alias("to")),
        lambda g: F.col("data").substr((g["from"] + 1).cast("int"), (g["to"] - g["from"]).cast("int")).cast("string"),
    )
    kept = F.when(F.size("spans") == 0, F.col("data")).otherwise(F.array_join(gaps, "").cast("binary"))
    return joined.select("doc_id", "n_bytes", "spans", kept.alias("kept"))
