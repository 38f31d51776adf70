import hashlib
import zlib

from pyspark.sql import functions as F

from panelrisk.llm.merkle import FIELDS, manifest, ranked, verified

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, g string, pos string, hash string, path string"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(hashes):
    """The one digest, and of each leaf what stands before and after it on its way."""
    paths, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for i, o in enumerate(at):
            first = o // 16 * 16
            paths[i].append(("".join(hashes[first:o]), "".join(hashes[o + 1 : first + 16])))
            at[i] = o // 16
        hashes = [h("".join(hashes[k : k + 16])) for k in range(0, len(hashes), 16)]
    return hashes[0], paths


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    subs = []
    for source in sorted(by, key=lambda s: (s is not None, (s or "").encode())):
        held = sorted(by[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        subs.append((held, *tree([leaf_of(r) for r in held])))
    root, ways = tree([s[1] for s in subs]) if subs else (None, [])
    out = []
    for (held, sub, paths), way in zip(subs, ways, strict=True):
        for r, p in zip(held, paths, strict=True):
            found = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                found = (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            folded = leaf_of(found)
            for before, after in p + way:
                folded = h(before + folded + after)
            proof = h("".join(b + a for b, a in p + way))
            out.append((r[0], leaf_of(r), sub, root, proof, folded, folded == root))
    return sorted(out, key=str)


def found_in(spark, rows):
    docs = spark.createDataFrame([(*r, "g", "p", "h", "x") for r in rows], SCHEMA)
    cols = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in verified(manifest(docs)).select(cols).collect()), key=str)


def test_trees_of_every_depth(spark):
    rows = [(i, "long", "en", i, f"Text {i}") for i in range(300)]
    rows += [(i, "run", "en", 1, "A") for i in range(16)] + [(i, "over", None, 1, "b") for i in range(17)]
    rows += [(7, "single", "de", 3, "Ünï")] + [(i, f"s{i:03d}", "fr", 2, "C") for i in range(40)]
    assert found_in(spark, rows) == brute(rows)


def test_edge_rows(spark):
    rows = [
        (1, None, None, None, None),
        (2, None, "en", 0, ""),
        (None, "a", "en", 5, "Null id"),
        (None, "a", "en", 5, "Other null id"),
        (3, "a", "en", 5, "B"),
        (3, "a", "en", 5, "b"),
        (3, "a", "en", 5, "B"),
        (4, "", "en", 200_000, "Xy " * 100_000),
        (5, "-", "en", 1, "1:2"),
        (5, "é", "en", 1, "Z" * 5),
        (-10, "é", "en", 1, "Z" * 5),
    ]
    got = found_in(spark, rows)
    assert got == brute(rows)
    assert {r[0] for r in got if not r[-1]} == {r[0] for r in brute(rows) if not r[-1]}


def test_lone_row_is_leaf_subroot_and_root(spark):
    (row,) = found_in(spark, [(1, "a", "en", 1, "a")])
    assert row[1] == row[2] == row[3] == row[5] and row[4] == h("") and row[6]


def test_empty_table(spark):
    assert found_in(spark, []) == []


def test_ranks_of_a_hot_group_come_from_many_ranges(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") < 4000, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 7)).alias("g"), (F.col("id") % 900).alias("doc_id")
    )
    got = ranked(rows, ["doc_id"]).groupBy("g").agg(
        F.count("*").alias("rows"), F.countDistinct("pos").alias("places"), F.max("pos").alias("last"), F.max("n").alias("n")
    )
    for r in got.collect():
        assert r.rows == r.places == r.last + 1 == r.n


def test_fields_are_those_of_the_documents():
    assert FIELDS == ("doc_id", "source", "lang", "n_chars", "text")
