"""Near-duplicates against brute force over all pairs."""

import random

from panelrisk.llm.minhash import near_duplicates


def shingles(text, words=2):
    seq = (text or "").encode().lower().split()
    if not seq:
        return frozenset()
    k = min(words, len(seq))
    return frozenset(tuple(seq[i : i + k]) for i in range(len(seq) - k + 1))


def brute(rows, words=2):
    sets = [shingles(t, words) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    low = {}
    for (doc, _), g in zip(rows, group):
        if doc is not None:
            low[g] = min(low.get(g, doc), doc)
    return sorted(
        ((doc, len(s), doc if not s else low.get(g)) for (doc, _), s, g in zip(rows, sets, group)), key=str
    )


def fixture():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["The", "of", "and"] * 5
    rows, doc = [], 1
    for family in range(6):
        base = [rng.choice(vocabulary) for _ in range(60 + 20 * family)]
        for copy in range(12):
            words = list(base)
            for _ in range(copy):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            rows.append((doc, " ".join(words)))
            doc += 1
    rows += [(900, rows[3][1]), (901, rows[3][1].upper()), (902, rows[3][1].replace(" ", "\t\n"))]
    rows += [(910, None), (911, ""), (912, " \n\t"), (913, "alone"), (914, "ALONE"), (915, "a b"), (916, "é É")]
    rows += [(None, rows[0][1]), (None, "nobody knows"), (7, rows[6][1]), (920, " ".join(f"long{i}" for i in range(30000)))]
    return rows


def test_matches_brute_force(docs_of):
    rows = fixture()
    got = near_duplicates(docs_of(rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got)


def test_large_group_meets_in_blocks(docs_of, monkeypatch):
    """Chains and outsiders around one hub, in blocks of a few classes."""
    from panelrisk.llm import minhash

    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for doc in range(60):
        words = list(base)
        for _ in range(rng.randrange(0, 14)):
            words[rng.randrange(80)] = f"v{rng.randrange(40)}"
        rows.append((doc, " ".join(words)))
    got = near_duplicates(docs_of(rows), words=2).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)


def test_empty_table(docs_of):
    assert near_duplicates(docs_of([])).count() == 0
