"""Contaminated documents against brute force over all item-sized windows."""

import random
from collections import Counter

from pyspark.sql import functions as F

from panelrisk.llm.decontaminate import ITEM_FLIPS, RADIUS, WINDOW_FLIPS, _block_keys, contaminated


def brute(docs, items, words=5, percent=80):
    """All windows of all documents; an item is passed over only where the whole
    document shares less with it than any union of the two could allow."""
    out = set()
    for doc, text in docs:
        w = (text or "").lower().split()
        whole = {}
        for item, t in items:
            v = (t or "").lower().split()
            k = min(words, len(v))
            if not v or len(w) < k:
                continue
            b = Counter(tuple(v[i : i + k]) for i in range(len(v) - k + 1))
            if k not in whole:
                whole[k] = Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
            if 100 * sum(min(n, whole[k][x]) for x, n in b.items()) < percent * sum(b.values()):
                continue
            for s in range(max(1, len(w) - len(v) + 1)):
                part = w[s : s + len(v)]
                a = Counter(tuple(part[i : i + k]) for i in range(len(part) - k + 1))
                if 100 * sum((a & b).values()) >= percent * sum((a | b).values()):
                    out.add((doc, item))
                    break
    return out


def run(spark, docs_of, docs, items):
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, start string")
    return contaminated(docs_of(docs), bench).collect()


def test_matches_brute_force(spark, docs_of):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(40)] + ["the", "of"] * 10
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(16, 60)))) for i in range(30)]
    items += [(100, "short one here"), (101, None), (102, ""), (103, "again and " * 12), (104, items[0][1])]
    docs = []
    for d in range(120):
        body = [rng.choice(vocabulary) for _ in range(rng.randint(0, 150))]
        passage = items[rng.randrange(30)][1].split()
        kind = d % 6
        if kind == 1:
            passage = passage[: len(passage) // 2]
        if kind == 2:
            passage[rng.randrange(len(passage))] = "changed"
        if kind == 3:
            passage = passage[1:]
        if kind < 5:
            at = rng.randint(0, len(body))
            body[at:at] = passage
        docs.append((d, ("\t" if d % 4 else "\n ").join(body).upper() if d % 3 == 0 else " ".join(body)))
    docs += [(200, None), (201, ""), (202, "a short one here b"), (203, items[3][1]), (203, items[3][1]), (None, items[4][1]), (204, "and again " * 20)]
    got = run(spark, docs_of, docs, items)
    assert {(r.doc_id, r.item_id) for r in got} == brute(docs, items)
    assert sum(r.doc_id == 203 and r.item_id == 3 for r in got) == 2
    assert all(0.8 <= r.similarity <= 1 and 0 <= r.hamming <= RADIUS for r in got)


def test_long_document_and_empty_tables(spark, docs_of):
    passage = " ".join(f"p{i}" for i in range(30))
    long = " ".join(f"x{i}" for i in range(40_000)) + " " + passage
    got = run(spark, docs_of, [(1, long)], [(5, passage)])
    assert [(r.doc_id, r.item_id, r.start_word, r.hamming) for r in got] == [(1, 5, 40_000, 0)]
    assert run(spark, docs_of, [], [(5, passage)]) == []
    assert run(spark, docs_of, [(1, passage)], []) == []


def test_reordered_passages_match_brute_force(spark, docs_of):
    rng = random.Random(3)
    items = [(i, " ".join(f"w{rng.randrange(4000)}" for _ in range(n))) for i, n in enumerate([60, 80, 100, 100, 140, 200])]
    items += [(50, items[2][1]), (51, "once more with feeling " * 15)]
    docs = []
    for i, text in items:
        passage = text.split()
        n = len(passage)
        for moved in (0, 3, n // 8, n // 5, n // 3, n // 2):
            turned = passage[n - moved :] + passage[: n - moved]
            for changed in (0, 1, 2):
                body = list(turned)
                for _ in range(changed):
                    body[rng.randrange(n)] = "changed"
                before = [f"x{rng.randrange(99)}" for _ in range(rng.randrange(40) * (changed < 2))]
                docs.append((len(docs), " ".join(before + body + before[: len(before) // 2])))
        docs.append((len(docs), " ".join(passage[n // 2 :] + passage[: n // 2] + passage)))
        docs.append((len(docs), " ".join(passage[: n - n // 10])))
    got = run(spark, docs_of, docs, items)
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id) for r in got} == want
    moved = " ".join(["x"] * 30 + items[2][1].split()[50:] + items[2][1].split()[:50] + ["y"] * 30)
    (hit,) = [r for r in run(spark, docs_of, [(1, moved)], items) if r.item_id == 2]
    assert hit.start_word == 30 and hit.hamming == 0 and round(hit.similarity, 6) == round(92 / 100, 6)


def test_fingerprints_at_the_limit(spark, docs_of):
    items = [(i, " ".join(f"i{i}w{j}" for j in range(100))) for i in range(300)]
    docs = [(i, " ".join(t.split()[:90] + [f"d{i}w{j}" for j in range(10)])) for i, t in items]
    got = run(spark, docs_of, docs, items)
    assert {(r.doc_id, r.item_id) for r in got} == {(i, i) for i in range(300)}
    assert any(r.hamming > 15 for r in got)


def test_index_meets_all_within_the_radius_and_few_others(spark):
    rng = random.Random(11)
    rows = []
    for i in range(300):
        print_ = rng.getrandbits(256)
        other = print_
        for bit in rng.sample(range(256), RADIUS if i < 150 else 128):
            other ^= 1 << bit
        signed = lambda x: [int.from_bytes(((x >> 64 * k) & (2**64 - 1)).to_bytes(8, "big"), "big", signed=True) for k in range(4)]
        rows.append((i, signed(print_), signed(other)))
    df = spark.createDataFrame(rows, "i int, left array<long>, right array<long>").withColumn("wanted", F.lit(60))
    shared = F.size(F.array_intersect(_block_keys("left", ITEM_FLIPS), _block_keys("right", WINDOW_FLIPS)))
    got = {r.i: r.n for r in df.select("i", shared.alias("n")).collect()}
    assert all(got[i] > 0 for i in range(150))
    assert sum(got[i] > 0 for i in range(150, 300)) < 60
    keys = df.where("i = 0").select(_block_keys("left", ITEM_FLIPS).alias("k")).first().k
    assert len(keys) == len(set(keys)) == 16 * 137
