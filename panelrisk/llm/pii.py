"""Personal data: fixed patterns, extended by a skip-chain conditional random field.

The patterns find e-mail addresses, IP addresses, card and phone numbers. A text's
tokens that hold a digit or an ``@`` are the nodes of a random field with labels
other, email, ip, card and phone. Edges join neighbouring tokens, distant tokens
of equal normal form, and tokens of equal shape (each to its last occurrence
before, so that edges grow with the tokens). Tokens inside pattern matches are
observed. Loopy belief propagation passes messages over all edges; tokens whose
marginal for a label reaches ``SURE`` become further spans of that kind; parts of a
card or phone number that follow each other become one span where together, and
not alone, they have a number's digits. So a number written again without its prefix takes the label it
has elsewhere in the document.

Weights are trained by pseudo-likelihood on a bounded, documented sample of
texts, with the pattern matches as labels: about equal numbers of texts that show
each kind and of texts that show none. Equal nodes are counted in Spark; the driver
gets at most about ``LEARN_NODES`` different ones.

All patterns run in time proportional to the text. Cases: null and empty texts
have no spans; texts without a digit or ``@`` need no field; rows are returned
each, repeated or with null ids; without texts to learn from nothing is added;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drawn_share, materialize, tidy

KINDS = ["email", "ip", "card", "phone"]
#: Documents, and different nodes, to learn from, about; size of the hashed feature space.
LEARN_DOCS, LEARN_NODES, SPACE = 3000, 300_000, 512
#: What a text of each kind holds, roughly: to draw texts by.
HINTS = {
    "email": r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]+\.",
    "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){11}",
    "phone": r"\+[0-9][\x20().0-9-]{7}",
}
#: Rounds of messages, damping, marginal from which a span is added.
ROUNDS, DAMPING, SURE = 8, 0.3, 0.9
EDGE_KINDS = ["next", "equal", "similar"]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# The patterns. A look-behind or possessive quantifier only spares
# attempts that can't succeed.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_HINT = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"\S+")
_EDGES = ".,;:!?\"'*#$%&[]{}<>|"
_RUNS = re.compile(r"(.)\1+")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, 0, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[Span]:
    """Pattern matches by start, then kind."""
    if not _HINT.search(text):
        return []
    out = list(_emails(text))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def _bucket(name: str) -> int:
    return xxhash.xxh32_intdigest(name) % SPACE


@dataclass
class Field:
    """The nodes of a text: places, hashed features, observed labels, edges."""

    places: list[tuple[int, int]] = field(default_factory=list)
    inputs: list[list[int]] = field(default_factory=list)
    labels: list[int] = field(default_factory=list)  # 0 other, 1.. the kinds
    edges: list[tuple[int, int, int]] = field(default_factory=list)  # kind, i, j


def build_field(text: str, spans: list[Span]) -> Field:
    out, last, before, k = Field(), {}, "", 0
    previous_end = -1
    for number, m in enumerate(_TOKEN.finditer(text)):
        token = m.group()
        if not _HINT.search(token):
            before = token
            continue
        lead = len(token) - len(token.lstrip(_EDGES))
        core = token.strip(_EDGES)
        a, b = m.start() + lead, m.start() + lead + len(core)
        while k < len(spans) and spans[k][2] <= a:
            k += 1
        inside = [s for s in spans[k : k + 4] if s[0] < b and s[2] > a]
        digits = "".join(c for c in core if "0" <= c <= "9")
        shape = "".join("d" if "0" <= c <= "9" else "a" if c.isalpha() else c for c in core[:64])
        short = _RUNS.sub(r"\1", shape)
        i = len(out.places)
        out.places.append((a, b))
        out.labels.append(inside[0][1] + 1 if inside else 0)
        out.inputs.append(
            [
                _bucket(x)
                for x in (
                    "bias",
                    f"short {short}",
                    f"shape {shape}" if len(shape) < 24 else "long",
                    f"digits {min(len(digits), 20)}",
                    f"at {core.count('@')}",
                    f"dots {min(core.count('.'), 4)}",
                    f"plus {core[:1] == '+'}",
                    f"luhn {12 <= len(digits) <= 19 and luhn(digits)} {min(len(digits), 20)}",
                    f"before {before.lower().strip(_EDGES)[:12]}",
                )
            ]
        )
        if previous_end == number - 1 and i:
            out.edges.append((0, i - 1, i))
        previous_end = number
        normal = f"= {digits}" if len(digits) >= 3 and "@" not in core else f"= {core.lower()}"
        for kind, key in ((1, normal), (2, f"~ {shape}")):
            j = last.get(key)
            if j is not None and (kind, j, i) not in out.edges[-1:]:
                out.edges.append((kind, j, i))
            last[key] = i
        before = token
    return out


@dataclass
class Model:
    unary: np.ndarray  # (SPACE, labels)
    pair: np.ndarray  # (edge kinds, labels, labels), symmetric

    def marginals(self, f: Field) -> np.ndarray:
        """(nodes, labels) by loopy belief propagation; observed nodes are fixed."""
        n, k = len(f.places), self.unary.shape[1]
        local = np.array([self.unary[x].sum(axis=0) for x in f.inputs])
        seen = np.flatnonzero(np.array(f.labels))
        local[seen] = -30.0
        local[seen, np.array(f.labels)[seen]] = 30.0
        if f.edges:
            e = np.array(f.edges)
            kind = np.concatenate([e[:, 0], e[:, 0]])
            src, dst = np.concatenate([e[:, 1], e[:, 2]]), np.concatenate([e[:, 2], e[:, 1]])
            back = np.concatenate([np.arange(len(e), 2 * len(e)), np.arange(len(e))])
            message = np.zeros((len(src), k))
            for _ in range(ROUNDS):
                belief = local.copy()
                np.add.at(belief, dst, message)
                out = (belief[src] - message[back])[:, :, None] + self.pair[kind]
                top = out.max(axis=1)
                new = top + np.log(np.exp(out - top[:, None, :]).sum(axis=1))
                new -= new.max(axis=1, keepdims=True)
                message = DAMPING * message + (1 - DAMPING) * new
            np.add.at(local, dst, message)
        p = np.exp(local - local.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def whole_number(kind: int, text: str) -> bool:
    """Whether a text has the digits of one card or phone number."""
    digits = "".join(c for c in text if "0" <= c <= "9")
    if KINDS[kind] == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return KINDS[kind] == "phone" and 9 <= len(digits) <= 15


def joinable(kind: int, left: str, right: str, both: str) -> bool:
    """Two parts of one number: together whole, and neither whole by itself."""
    return whole_number(kind, both) and not whole_number(kind, left) and not whole_number(kind, right)


def all_spans(text: str, model: Model | None) -> tuple[list[Span], list[Span]]:
    """(base spans, base and added spans)."""
    base = base_spans(text)
    if model is None or not _HINT.search(text):
        return base, base
    f = build_field(text, base)
    if all(f.labels):
        return base, base
    p = model.marginals(f)
    added: list[Span] = []
    joined = {(i, j) for kind, i, j in f.edges if kind == 0}
    last = -1
    for i, (a, b) in enumerate(f.places):
        label = int(p[i].argmax())
        if f.labels[i] or not label or p[i, label] < SURE or b <= a:
            continue
        start = added[-1][0] if added else a
        follows = added and last == i - 1 and (last, i) in joined and added[-1][1] == label - 1
        if follows and joinable(label - 1, text[start : added[-1][2]], text[a:b], text[start:b]):
            added[-1] = (start, label - 1, b)
        else:
            added.append((a, label - 1, b))
        last = i
    return base, sorted(base + added)


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


@tidy
def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per node: features, label, and the labels next to it by edge kind."""
    for batch in batches:
        inputs, labels, around = [], [], []
        for text in batch.column(0):
            t = text.as_py() or ""
            if not _HINT.search(t):
                continue
            f = build_field(t, base_spans(t))
            near: list[list[int]] = [[] for _ in f.places]
            for kind, i, j in f.edges:
                near[i].append(kind * 8 + f.labels[j])
                near[j].append(kind * 8 + f.labels[i])
            inputs += f.inputs
            labels += f.labels
            around += map(sorted, near)
        yield pa.RecordBatch.from_arrays(
            [pa.array(inputs, pa.list_(pa.int32())), pa.array(labels, pa.int32()), pa.array(around, pa.list_(pa.int32()))], names=["x", "y", "near"]
        )


def fit_field(nodes: dict[tuple, int], steps: int = 250) -> Model:
    """Pseudo-likelihood: every node's label given its features and the labels
    around it. ``nodes``: the number of each (features, label, labels around)."""
    k = len(KINDS) + 1
    counts = nodes
    keys = sorted(counts)
    weight = np.array([counts[q] for q in keys], np.float64)
    y = np.array([q[1] for q in keys])
    node = np.repeat(np.arange(len(keys)), [len(q[0]) for q in keys])
    feature = np.array([f for q in keys for f in q[0]], np.int64)
    near_node = np.repeat(np.arange(len(keys)), [len(q[2]) for q in keys])
    near = np.array([v for q in keys for v in q[2]], np.int64)
    unary, pair = np.zeros((SPACE, k)), np.zeros((len(EDGE_KINDS) * 8, k))
    squares = [np.full_like(unary, 1e-8), np.full_like(pair, 1e-8)]
    goal = np.eye(k)[y]
    for _ in range(steps):  # full-batch steps scaled by past gradients
        z = np.zeros((len(keys), k))
        np.add.at(z, node, unary[feature])
        np.add.at(z, near_node, pair[near])
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = (p - goal) * (weight / weight.sum())[:, None]
        gu, gp = 1e-4 * unary, 1e-4 * pair
        np.add.at(gu, feature, g[node])
        np.add.at(gp, near, g[near_node])
        for w, grad, sq in ((unary, gu, squares[0]), (pair, gp, squares[1])):
            sq += grad * grad
            w -= 0.5 * grad / np.sqrt(sq)
    table = pair.reshape(len(EDGE_KINDS), 8, k)[:, :k]
    return Model(unary, (table + table.transpose(0, 2, 1)) / 2)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", learn_docs: int = LEARN_DOCS) -> Model | None:
    """Model of about ``learn_docs`` documents with a digit or an ``@``, drawn by a
    hash of their id: as many for each kind that texts show, and for those that
    show none; None if there is nothing to learn from."""
    hinted = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(
        F.col("doc_id").isNotNull() & F.col("text").rlike("[0-9@]")
    )
    shown = {k: F.col("text").rlike(pattern) for k, pattern in HINTS.items()}
    shown["none"] = ~(shown["email"] | shown["ip"] | shown["card"] | shown["phone"])
    counts = hinted.agg(*[F.count_if(c).alias(k) for k, c in shown.items()]).first()
    present = [k for k in shown if counts[k]]
    if not present:
        return None
    drawn = F.lit(False)
    for k in present:
        drawn = drawn | (shown[k] & drawn_share(F.col("doc_id"), learn_docs / len(present) / counts[k], f"pii {k}"))
    each = hinted.where(drawn).select("text").mapInArrow(_training_rows, "x array<int>, y int, near array<int>")
    nodes = materialize(each.groupBy("x", "y", "near").agg(F.count("*").alias("n")))
    different = nodes.count()
    if different > LEARN_NODES:
        nodes = nodes.where(drawn_share(F.xxhash64("x", "y", "near"), LEARN_NODES / different, "nodes"))
    held = {(tuple(r.x), r.y, tuple(r.near)): r.n for r in nodes.collect()}
    return fit_field(held) if held else None


def find_personal_data(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, listed = [], [], []
            for text in batch.column(1):
                base, spans = all_spans(text.as_py() or "", shared.value)
                counts.append([sum(k == kind for _, k, _ in base) for kind in range(len(KINDS))])
                digests.append(hashlib.sha256(_listed(base).encode()).hexdigest())
                listed.append(_listed(spans))
            columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns, pa.array(digests, pa.string()), pa.array(listed, pa.string())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
