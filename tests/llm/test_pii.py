"""Base spans against plain patterns; spans that the random field adds."""

import hashlib
import random
from collections import Counter
import re
import time

import numpy as np

from panelrisk.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0

    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_spans_equal_plain_patterns():
    rng = random.Random(6)
    parts = ["a.b", "@", "@x.y", "x@y", ".", "1", "255", "256", "1.2.3.4", "4111111111111111", "+1 (555) 123-4567", "+", "-", " ", "(", ")", "é", "\n", "00", "٣"]
    for _ in range(20000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert pii.base_spans(text) == plain(text), repr(text)


def test_long_texts_take_linear_time():
    began = time.time()
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 100_000, "+1" * 100_000, "+1" + "(" * 300_000):
        pii.base_spans(text)
    assert time.time() - began < 10


def test_repeated_number_takes_the_label_of_its_twin():
    rng = random.Random(8)
    nodes = Counter()
    for _ in range(150):
        n = f"({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
        words = ["call", f"+1 {n}", "today", str(rng.randrange(10, 99)), "times", f"+1 {n}", "or", f"{rng.randrange(1900, 2030)}"]
        text = " ".join(words)
        f = pii.build_field(text, pii.base_spans(text))
        near = [[] for _ in f.places]
        for kind, i, j in f.edges:
            near[i].append(kind * 8 + f.labels[j])
            near[j].append(kind * 8 + f.labels[i])
        nodes.update((tuple(x), y, tuple(sorted(n))) for x, y, n in zip(f.inputs, f.labels, near, strict=True))
    model = pii.fit_field(nodes)
    text = "call +1 (415) 555-2671 today or (415) 555-2671 before 1999"
    base, spans = pii.all_spans(text, model)
    at = text.rindex("(415)")
    assert base == [(5, 3, 22)]
    assert spans == [(5, 3, 22), (at, 3, at + 14)]  # both parts, as one number
    assert pii.all_spans("in 1999 there were 37 of them", model) == ([], [])


def test_whole_numbers_are_not_joined():
    assert pii.joinable(3, "(415)", "555-2671", "(415) 555-2671")
    assert not pii.joinable(3, "4155552671", "4155552672", "4155552671 4155552672")
    assert not pii.joinable(3, "4155552671", "12", "4155552671 12")  # the first is whole by itself
    assert pii.joinable(2, "4111 1111", "1111 1111", "4111 1111 1111 1111")
    assert not pii.joinable(2, "4111111111111111", "4111111111111111", "4111111111111111 4111111111111111")
    assert not pii.joinable(0, "a@b.c", "d@e.f", "a@b.c d@e.f") and not pii.joinable(1, "1.2.3.4", "1.2.3.4", "1.2.3.4 1.2.3.4")


def test_adjacent_cards_stay_apart():
    """Two numbers without a pattern match of their own, next to each other."""
    unary = np.zeros((pii.SPACE, 5))
    unary[:, 3] = 3.0  # everything looks like a card
    model = pii.Model(unary, np.zeros((3, 5, 5)))
    _, spans = pii.all_spans("x 4111111111111112 4111111111111113 y", model)
    assert [(k, a, b) for a, k, b in spans] == [(2, 2, 18), (2, 19, 35)]


def test_rare_kinds_are_drawn(docs_of):
    rows = [(i, f"in {1900 + i % 90} there were {i} of them") for i in range(3000)]
    rows += [(9000 + i, f"call +1 (415) 555-{2000 + i} today") for i in range(12)]
    model = pii.fit(docs_of(rows), learn_docs=40)
    f = pii.build_field("call +1 (415) 555-2003 today", [(5, 3, 22)])
    assert model.unary[f.inputs[0]].sum(axis=0).argmax() == 4


def test_belief_propagation_is_exact_on_chains():
    rng = np.random.default_rng(0)
    model = pii.Model(rng.normal(size=(pii.SPACE, 5)), np.stack([(m + m.T) / 2 for m in rng.normal(size=(3, 5, 5))]))
    f = pii.Field([(0, 1)] * 4, [[i, 9 + i] for i in range(4)], [0, 0, 3, 0], [(0, 0, 1), (1, 1, 2), (2, 2, 3)])
    local = np.array([model.unary[x].sum(axis=0) for x in f.inputs])
    total = np.zeros((4, 5))
    for y in np.ndindex(5, 5, 5, 5):
        if y[2] == 3:
            w = np.exp(sum(local[i, y[i]] for i in (0, 1, 3)) + sum(model.pair[k, y[i], y[j]] for k, i, j in f.edges))
            for i in range(4):
                total[i, y[i]] += w
    exact = total / total.sum(axis=1, keepdims=True)
    old, pii.ROUNDS = pii.ROUNDS, 60
    try:
        assert np.allclose(model.marginals(f), exact, atol=1e-3)
    finally:
        pii.ROUNDS = old


def test_rows(docs_of):
    rows = [(1, "mail a.b@c.de now"), (2, None), (3, ""), (1, "mail a.b@c.de now"), (None, "10.0.0.1"), (4, "no hint")]
    docs = docs_of(rows)
    got = pii.find_personal_data(docs, pii.fit(docs)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = {1: rows[0][1], None: "10.0.0.1"}.get(r.doc_id, "")
        names = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in plain(text))
        assert r.base_sha256 == hashlib.sha256(names.encode()).hexdigest()
        assert names in r.spans
    empty = docs_of([])
    assert pii.fit(empty) is None and pii.find_personal_data(empty, None).count() == 0
