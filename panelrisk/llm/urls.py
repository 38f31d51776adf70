"""URL verdicts: host and path rules, then a list of canonical URLs.

The listed URLs go into a blocked Bloom filter: a URL's hash picks one 512-bit
block and sets bits in that block only. The number of blocks follows from the
counted list, ``BITS_A_URL`` for each URL, up to a filter of 32 MiB; a longer list
makes more false positives, never a wrong verdict. Every task checks its pages
against a broadcast copy and marks possible hits. Only these go to an exact hash
join with the list, which removes the false positives; all other pages skip the
join's shuffle.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased. Path: then up to ``?``, ``#`` or the end. Canonical URL: host
without a leading ``www.`` or ``m.``, then the path without trailing slashes.

Cases: a null URL or one without ``://`` has an empty host and path, no
canonical URL, fits no rule and is allowed. Null or malformed list entries list
nothing, repeated ones count once. Repeated pages are judged each; other columns
are ignored. An empty list blocks nothing, an empty page table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, tidy

#: Least and most 512-bit blocks of the filter (64 KiB, 32 MiB), bits of the filter
#: for each listed URL, and bits set for each.
MIN_BLOCKS, MAX_BLOCKS, BITS_A_URL, BITS = 1 << 10, 1 << 19, 16, 6

# Fixed value: the rules (verdict, host, path).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Null where there is no host."""
    bare = F.regexp_replace(host, r"^(www|m)\.", "")
    return F.when(host != "", F.concat(bare, F.regexp_replace(path, r"/+$", "")))


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls.

    A rule fits its host and all subdomains if the path starts with its path.
    """
    rule = verdict = F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _masks(h: np.ndarray, blocks: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of 64-bit hashes: their block, and which of its eight words' bits."""
    h = h.astype(np.uint64)
    block = (h % np.uint64(blocks)).astype(np.int64)
    mask = np.zeros((len(h), 8), np.uint64)
    x = h
    for _ in range(bits):
        x = x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03)
        bit = x >> np.uint64(55)
        mask[np.arange(len(h)), (bit >> np.uint64(6)).astype(np.int64)] |= np.uint64(1) << (bit & np.uint64(63))
    return block, mask


def filter_blocks(urls: int) -> int:
    """Blocks for so many listed URLs: a power of two within the stated bounds."""
    wanted = -(-urls * BITS_A_URL // 512)
    return min(MAX_BLOCKS, max(MIN_BLOCKS, 1 << max(0, wanted - 1).bit_length()))


def bloom_filter(listed: DataFrame, blocks: int, bits: int = BITS) -> np.ndarray:
    """(blocks, 8) words of the filter of ``listed.canonical``.

    Each task makes one partial filter; they are joined block by block, so that
    the driver gets at most ``blocks`` rows of 64 bytes, however long the list.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = np.zeros((blocks, 8), np.uint64)
        for batch in batches:
            block, mask = _masks(batch.column(0).to_numpy(zero_copy_only=False), blocks, bits)
            np.bitwise_or.at(part, block, mask)
        used = np.flatnonzero(part.any(axis=1))
        words = part[used].view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int64()), *(pa.array(words[:, i], pa.int64()) for i in range(8))],
            names=["block", *(f"w{i}" for i in range(8))],
        )

    schema = "block long, " + ", ".join(f"w{i} long" for i in range(8))
    rows = (
        listed.where("canonical is not null")
        .select(F.xxhash64("canonical"))
        .mapInArrow(run, schema)
        .groupBy("block")
        .agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8)))
        .toArrow()
    )
    out = np.zeros((blocks, 8), np.uint64)
    at = rows["block"].to_numpy()
    for i in range(8):
        out[at, i] = rows[f"w{i}"].to_numpy().view(np.uint64)
    return out


def judge_urls(
    pages: DataFrame,
    listed: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    listed_col: str = "url",
    rules=RULES,
    blocks: int | None = None,
    bits: int = BITS,
) -> DataFrame:
    """page_id, host, path, rule, verdict, possible_hit, listed.

    The verdict is the rule's; where none fits, block if the canonical URL is
    that of a listed one, else allow.
    """
    listed_host, listed_path = host_and_path(F.col(listed_col))
    names = listed.select(canonical(listed_host, listed_path).alias("canonical")).where("canonical is not null").distinct()
    names = materialize(names)  # the list is read once, for its number, the filter and the join
    blocks = blocks or filter_blocks(names.count())
    shared = pages.sparkSession.sparkContext.broadcast(bloom_filter(names, blocks, bits))

    @tidy
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            block, mask = _masks(batch.column(0).to_numpy(zero_copy_only=False), blocks, bits)
            hit = ((words[block] & mask) == mask).all(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(hit)], names=[*batch.schema.names[1:], "possible_hit"])

    host, path = host_and_path(F.col("u"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("u")).select(
        "page_id", host.alias("host"), path.alias("path")
    )
    name = canonical(F.col("host"), F.col("path"))
    probed = rows.select(F.xxhash64(name).alias("h"), "page_id", "host", "path", name.alias("name")).mapInArrow(
        probe, "page_id long, host string, path string, name string, possible_hit boolean"
    )
    # Only possible hits go through the join's shuffle; pages without a canonical URL are none.
    probed = materialize(probed.withColumn("possible_hit", F.col("possible_hit") & F.col("name").isNotNull()))
    sure = probed.where("not possible_hit").withColumn("listed", F.lit(False))
    hits = probed.where("possible_hit").join(names.select(F.col("canonical").alias("name"), F.lit(True).alias("listed")), "name", "left")
    exact = hits.select(*sure.columns).union(sure)
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    in_list = F.coalesce("listed", F.lit(False))
    by_list = F.when(in_list, F.lit("block")).otherwise(F.lit("allow"))
    return exact.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_list).alias("verdict"), "possible_hit", in_list.alias("listed")
    )
