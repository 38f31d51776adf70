import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from panelrisk.llm import spelling
from panelrisk.llm.spelling import near_in_blocks, near_words, roots, spelling_groups


def brute(rows, min_count=5, every=199):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            crc = None if doc_id is None else zlib.crc32(f"{doc_id}:{run}".encode())
            if crc is not None and crc % every == 0:
                run = run[: crc % len(run)] + run[crc % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= min_count}
    near = neighbours(n)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= 5 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=str)


def neighbours(words):
    near = defaultdict(set)
    patterns = defaultdict(list)
    for w in words:
        for i in range(len(w)):
            patterns[i, w[:i], w[i + 1 :]].append(w)
            shorter = w[:i] + w[i + 1 :]
            if shorter in words:
                near[w].add(shorter)
                near[shorter].add(w)
    for held in patterns.values():
        for a in held:
            near[a].update(b for b in held if b != a)
    return near


def found_in(docs, **more):
    cols = ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((tuple(r) for r in spelling_groups(docs, **more).select(cols).collect()), key=str)


def varied(seed, n_docs, letters="abcdeéß", size=(5, 9)):
    """Texts of words that are often one edit apart."""
    rng = random.Random(seed)
    base = ["".join(rng.choices(letters, k=rng.randint(*size))) for _ in range(30)]
    rows = []
    for i in range(n_docs):
        words = []
        for _ in range(rng.randint(0, 60)):
            w = base[min(rng.randrange(30), rng.randrange(30))]
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", rng.choice(letters), w[at] + rng.choice(letters)]) + w[at + 1 :]
            words.append(w.title() if rng.random() < 0.2 else w)
        rows.append((i, rng.choice([" ", ", ", "-", "1"]).join(words)))
    return rows


def test_against_brute_force(docs_of):
    rows = varied(1, 150)
    got = found_in(docs_of(rows))
    assert got == brute(rows) and any(r[1] for r in got)


def test_frequent_deletions(docs_of):
    rows = varied(2, 80)
    assert found_in(docs_of(rows), every=3) == brute(rows, every=3)


def test_blocks_split_into_parts_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK", 16)
    rng = random.Random(3)
    words = sorted({"".join(rng.choices("abr", k=rng.randint(5, 7))) for _ in range(700)})
    near = neighbours(set(words))
    got = near_words(spark.createDataFrame([(w, 1) for w in words], "word string, n long")).collect()
    assert len(got) == len({(r.word, r.near) for r in got})
    assert {(r.word, r.near) for r in got} == {(a, b) for a in words for b in near[a]}


def test_edge_rows(docs_of):
    long_word = "x" * 3000
    rows = [(1, None), (2, ""), (3, "1 2 3 -"), (None, "Nullid nullid " * 3), (4, "kürzung kürzunge " * 6)]
    rows += [(5, "kürzung")] * 7 + [(6, f"{long_word} {long_word}y " * 5), (7, "× ÷ a×b÷cd " * 9), (8, "word " * 20_000)]
    assert found_in(docs_of(rows)) == brute(rows)


def test_ties_go_to_the_smaller_word(docs_of):
    rows = [(None, "abcdefa " * 50 + "abcdefb " * 50 + "abcdefc " * 5)]
    assert {r[0]: r[1] for r in found_in(docs_of(rows))} == {"abcdefa": None, "abcdefb": None, "abcdefc": "abcdefa"}


def test_empty_table(docs_of):
    assert found_in(docs_of([])) == []


def test_roots_follow_long_chains(spark):
    chain = spark.createDataFrame([(f"w{i:02d}", f"w{i + 1:02d}") for i in range(20)], "word string, form string")
    assert {r.root for r in roots(chain).collect()} == {"w20"}


def test_distances_alone_are_not_enough():
    def points(words):
        return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)

    i, j = near_in_blocks(points(["abcdef", "abcxef"]), points(["fbcdea", "abcdex", "abcdef"]))
    assert set(zip(i.tolist(), j.tolist())) == {(0, 1), (1, 2)}
    i, j = near_in_blocks(points(["abcdef"]), points(["abcdefg", "gfedcba", "gabcdef", "abcgdef", "bacdefg"]))
    assert j.tolist() == [0, 2, 3]
