"""The registered classifier queries against plain versions of their methods: every
text of the table, one character, word or feature at a time, without numpy."""

import math
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from panelrisk.llm import langid, quality, toxicity
from panelrisk.llm.common import bucket_of, learning_rows, table
from panelrisk.llm.queries import op1_language_id, op2_toxicity, op9_quality

WORD = 2**64


def grams(text):
    """Hashed 1- to 3-grams of the letters, each run of others one blank."""
    letters = []
    for c in (text or "").lower():
        if c.isalpha():
            letters.append(ord(c))
        elif letters and letters[-1] != 32:
            letters.append(32)
    for n in (1, 2, 3):
        for i in range(len(letters)):
            h = n
            for j in range(i, i + n):
                h = ((h ^ (letters[j] if j < len(letters) else 32)) * 0x9E3779B97F4A7C15) % WORD
                h ^= h >> 29
            yield h % langid.BUCKETS


def test_language_scores(spark, sf):
    docs = table(spark, sf, "documents")
    held_out = bucket_of(F.col("doc_id"), 4) == 2
    counts = defaultdict(Counter)
    for r in langid.learning_sample(docs, ~held_out).collect():
        counts[r.lang].update(grams(r.text))
    languages = sorted(counts)
    total = {x: sum(counts[x].values()) + langid.ALPHA * langid.BUCKETS for x in languages}
    got = {r.doc_id: r for r in op1_language_id(spark, sf).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        seen = Counter(grams(r.text))
        one = got[r.doc_id]
        if not any(c.isalpha() for c in (r.text or "").lower()):
            assert (one.lang_pred, one.score) == ("und", 0.0)
            continue
        logs = {x: sum(k * math.log((counts[x][b] + langid.ALPHA) / total[x]) for b, k in seen.items()) for x in languages}
        best = max(logs.values())
        assert best - logs[one.lang_pred] < 1e-3 + 1e-6 * abs(best)
        assert abs(one.score - 1 / sum(math.exp(v - logs[one.lang_pred]) for v in logs.values())) < 5e-3


def test_toxicity_scores(spark, sf):
    docs = table(spark, sf, "documents")
    model = toxicity.fit(learning_rows(docs, table(spark, sf, "labels"), "toxic", 3, 1, toxicity.LEARN_ROWS))
    weight = {f: float(model.weight[i]) for f, i in model.index.items()}
    got = {r.doc_id: r for r in op2_toxicity(spark, sf).collect()}
    rows = docs.collect()
    assert len(got) == len(rows) and weight
    for r in rows:
        held = set()
        for word in re.findall(r"[^\W\d_]+", (r.text or "").lower()):
            whole = f"<{word}>"
            held |= {word} | {"~" + whole[i : i + n] for n in (4, 5) for i in range(len(whole) - n + 1)}
        z = model.base + math.fsum(weight[f] for f in held if f in weight) + math.log(0.7 / 0.3) - 1e-6
        want = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        assert abs(got[r.doc_id].score - want) < 1e-6
        assert got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.7)


def plain_measures(text):
    words = (text or "").split()
    if not words:
        return [0.0] * 17
    kind = Counter()
    for c in text:
        if ord(c) > 127:
            kind["foreign"] += len(c.encode("utf-8", "surrogatepass"))
        elif c.isupper():
            kind["upper"] += 1
        elif c.islower():
            kind["lower"] += 1
        elif c.isdigit():
            kind["digit"] += 1
        elif c in ".,;:'\"()?-":
            kind["mark"] += 1
        elif 9 <= ord(c) <= 32:
            kind["space"] += 1
        elif c in "!|":
            kind[c] += 1
        else:
            kind["other"] += 1
    n, size = len(words), sum(kind.values())
    letters = max(1, kind["upper"] + kind["lower"] + kind["foreign"])
    mean = sum(map(len, words)) / n
    often = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    follow = [(words[i], words[i + 1]) for i in range(n - 1)]
    return [
        math.log(1 + n),
        mean,
        math.sqrt(sum((len(w) - mean) ** 2 for w in words) / n),
        sum(len(w) == 1 for w in words) / n,
        kind["upper"] / letters,
        kind["digit"] / size,
        kind["mark"] / n,
        kind["other"] / size,
        kind["!"] / n,
        kind["|"] / n,
        kind["space"] / size,
        len(often) / n,
        len(often) / math.sqrt(n),
        max(often.values()) / n,
        len(set(follow)) / max(1, n - 1),
        sum(a == b for a, b in follow) / max(1, n - 1),
        len(set(lines)) / max(1, len(lines)),
    ]


def test_quality_scores(spark, sf):
    docs = table(spark, sf, "documents")
    model = quality.fit(learning_rows(docs, table(spark, sf, "labels"), "quality", 4, 2, quality.LEARN_ROWS))
    weight, bends = model.weight.tolist(), model.bends[0].tolist()

    def strength(text):
        z = [max(-8.0, min(8.0, (x - m) / s)) for x, m, s in zip(plain_measures(text), model.mean.tolist(), model.scale.tolist())]
        parts = z + [max(0.0, v - b) for v, at in zip(z, bends) for b in at]
        return math.fsum(w * v for w, v in zip(weight, parts, strict=True))

    rows = {r.doc_id: strength(r.text) for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    got = {r.doc_id: r for r in op9_quality(spark, sf).collect()}
    assert got.keys() == rows.keys()
    # The threshold: of all documents' quantiles and their middles, one with the fewest errors per label.
    ranked = sorted(rows.values())
    edges = [*ranked, *((a + b) / 2 for a, b in zip(ranked, ranked[1:]))]
    taught = [(rows[i], y) for i, y in labels.items() if i in rows and not got[i].held_out]
    n = Counter(y for _, y in taught)

    def errors(edge):
        return sum((s < edge) / n[1] if y else (s >= edge) / n[0] for s, y in taught)

    placed = quality.with_threshold(model, docs.select(quality.strengths(docs, model).alias("strength")))
    assert min(abs(placed.edge - e) for e in edges) < 1e-6
    assert errors(placed.edge) <= min(map(errors, edges)) + 1e-9
    for i, s in rows.items():
        z = (s - placed.edge) / placed.spread + math.log(0.7 / 0.3)
        assert abs(got[i].score - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))) < 1e-6
        assert got[i].predicted == int(got[i].score >= 0.7)
