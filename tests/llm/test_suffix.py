import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelrisk.llm.suffix import (
    common_prefixes,
    named_strings,
    remove_repeats,
    repeated_spans,
    sliding_min,
    suffix_array,
    window_digests,
)


def brute(rows, width):
    seen = Counter()
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, b in texts:
        seen.update(b[p : p + width] for p in range(len(b) - width + 1))
    out = []
    for i, b in texts:
        spans = []
        for p in range(len(b) - width + 1):
            if seen[b[p : p + width]] > 1:
                if spans and p <= spans[-1][1]:
                    spans[-1][1] = p + width
                else:
                    spans.append([p, p + width])
        gone = {x for a, z in spans for x in range(a, z)}
        kept = bytes(c for x, c in enumerate(b) if x not in gone)
        out.append((i, len(b), tuple(map(tuple, spans)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found_in(docs, width=400, **more):
    got = remove_repeats(docs, width=width, **more).select("doc_id", "n_bytes", "spans", F.sha2("kept", 256)).collect()
    return sorted(((r[0], r[1], tuple(map(tuple, r[2])), r[3]) for r in got), key=str)


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghijkléñ", k=rng.randint(2, 9))) for _ in range(n))


def mixed(seed, n_docs):
    """Texts with passages that others hold too, cut at any place."""
    rng = random.Random(seed)
    shared = [words(rng, 120) for _ in range(6)]
    rows = []
    for i in range(n_docs):
        parts = [words(rng, rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randrange(len(s) // 2)
            parts += [s[a : a + rng.choice([300, 398, 399, 400, 401, 500, 900])], words(rng, rng.randint(0, 30))]
        rows.append((i, "".join(parts)))
    return rows


@pytest.mark.parametrize("shard_bytes", [2 << 20, 4000])
def test_against_brute_force(docs_of, shard_bytes):
    rows = mixed(1, 120)
    got = found_in(docs_of(rows), shard_bytes=shard_bytes)
    assert got == brute(rows, 400) and any(r[2] for r in got) and any(not r[2] for r in got)


def test_short_width_and_split_names(docs_of):
    rng = random.Random(4)
    line = "This very common line stands in every text. "
    rows = [(i, words(rng, 20) + " " + line + words(rng, 20)) for i in range(200)]
    rows += [(500 + i, rows[i][1][20:150]) for i in range(40)]
    assert found_in(docs_of(rows), width=64, shard_bytes=2000) == brute(rows, 64)


def test_edge_rows(docs_of):
    rng = random.Random(5)
    one = words(rng, 200)
    rows = [(1, None), (2, ""), (3, "short"), (None, one), (None, one[:700]), (4, one), (4, one), (5, words(rng, 300))]
    rows += [(6, "a" * 3000), (7, "b" * 400), (8, "c" * 401), (9, "line again\n" * 200), (10, "é" * 500), (11, words(rng, 90)[:399])]
    assert found_in(docs_of(rows)) == brute(rows, 400)


def test_repeats_within_one_text_and_lone_text(docs_of):
    rng = random.Random(6)
    part = words(rng, 100)
    rows = [(1, part + "|" + words(rng, 50) + "|" + part)]
    got = found_in(docs_of(rows))
    assert got == brute(rows, 400) and len(got[0][2]) == 2
    assert found_in(docs_of([(1, part)]))[0][2] == ()


def test_matches_never_cross_texts(docs_of):
    rng = random.Random(7)
    x = words(rng, 150)
    rows = [(1, x), (2, x[:300]), (3, x[300:600])]
    assert all(not r[2] for r in found_in(docs_of(rows)))


def test_empty_table(docs_of):
    assert found_in(docs_of([])) == []
    assert repeated_spans(docs_of([])).collect() == []


def test_long_text_in_pieces(docs_of, monkeypatch):
    import panelrisk.llm.suffix as suffix

    rng = random.Random(8)
    text = words(rng, 3000)
    whole = Counter()
    for _, start, n, name, _, _ in named_strings([text.encode()], 400):
        whole.update((int(s) + k, int(v)) for s, c, v in zip(start, n, name) for k in range(c))
    monkeypatch.setattr(suffix, "PIECE", 1000)
    parts = Counter()
    for _, start, n, name, _, _ in named_strings([text.encode()], 400):
        parts.update((int(s) + k, int(v)) for s, c, v in zip(start, n, name) for k in range(c))
    assert parts == whole and len(whole) == len(text.encode()) - 399


def test_suffix_array_and_common_prefixes():
    rng = random.Random(9)
    for t in range(60):
        data = bytes(rng.choice(rng.choice([b"a", b"ab", b"\0a", b"abc\0"])) for _ in range(rng.randint(1, 300)))
        if t % 5 == 0:
            data = (data[:7] * 60)[: len(data)]
        order = suffix_array(data)
        want = sorted(range(len(data)), key=lambda i: data[i:])
        assert order.tolist() == want
        shared = common_prefixes(data, order, 40, chain=rng.choice([8, 16, 512]))
        for k in range(1, len(data)):
            a, b = data[want[k] :], data[want[k - 1] :]
            n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert shared[k] == min(n, 40)


def test_sliding_min():
    rng = np.random.default_rng(1)
    for size in (1, 3, 7, 50):
        v = rng.integers(0, 1 << 60, 50).astype(np.uint64)
        assert sliding_min(v, size).tolist() == [v[i : i + size].min() for i in range(50 - size + 1)]


def test_equal_windows_have_equal_digests():
    rng = random.Random(10)
    x, y = words(rng, 200).encode(), words(rng, 50).encode()
    d = window_digests(y[:37] + x, 400)[37:]
    assert (d == window_digests(x, 400)).all() and len(np.unique(d)) == len(d)
