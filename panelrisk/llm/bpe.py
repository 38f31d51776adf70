"""Byte-level BPE with a minimal acyclic transducer as lexicon.

A text is cut before every space that follows a non-space character; no token
crosses such a cut, so a unit's ids don't depend on its neighbours (texts where
white space surrounds a space are encoded as one unit). All units of the corpus
are counted; the most frequent ones are compiled into a minimal acyclic
automaton, whose arcs carry additive outputs: along a word they add up to its
number, under which its ids stand. The file is sent to every executor once and
memory-mapped. Units outside the lexicon are merged exactly, pair by pair.

Cases: null text counts as empty (no ids, empty decoded text); texts may hold the
added tokens' strings, which become their ids; repeated rows are encoded each;
other columns are ignored; an empty table gives no rows. Long words merge in
O(n log n).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import sys
import tempfile
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_in_worker, materialize, tidy

#: Units in the lexicon, and the bytes of the longest one.
LEXICON_WORDS = 262_144
LEXICON_BYTES = 48
#: Bytes of units and ids that a Python worker remembers, and distinct units it
#: counts, before it starts anew; what an entry takes besides its contents.
CACHE_BYTES, COUNT_CACHE, ENTRY_BYTES = 128 << 20, 400_000, 150
#: Texts looked up together.
GROUP = 256
#: Words merged side by side, and words so few that each is merged alone.
SIDE_BY_SIDE, FEW_WORDS = 4096, 32

# Fixed value: the byte-level pre-tokenisation pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_SPACED = re.compile(r"\s(?: \s| \Z)")


def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tables:
    """A byte-level BPE vocabulary: merges, byte ids, the bytes of each id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars, vocab = byte_chars(), spec["model"]["vocab"]
        self.byte_id = [0] * 256
        for c, b in chars.items():
            self.byte_id[b] = vocab[c]
        #: (left id << 32 | right id) -> rank; rank -> merged id
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[a] << 32 | vocab[b]] = rank
            self.made.append(vocab[a + b])
        # The same as arrays, for many words at a time.
        pairs = np.fromiter(self.rank, np.int64, len(self.rank))
        order = np.argsort(pairs)
        self.pairs, self.pair_rank = pairs[order], np.fromiter(self.rank.values(), np.int32, len(pairs))[order]
        self.made_ids, self.byte_ids = np.array(self.made, np.int64), np.array(self.byte_id, np.int64)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.piece = [b""] * size
        for token, i in vocab.items():
            self.piece[i] = bytes(chars[c] for c in token)
        for token, i in self.added.items():
            self.piece[i] = token.encode()

    def word(self, data: bytes) -> list[int]:
        """Ids of one pre-token: always merge the leftmost pair of least rank."""
        ids = [self.byte_id[b] for b in data]
        if len(ids) > 48:
            return self._long(ids)
        get, none = self.rank.get, len(self.made)
        ranks = [get(a << 32 | b, none) for a, b in pairwise(ids)]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            ids[i : i + 2] = [self.made[best]]
            del ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 32 | ids[i], none)
            if i < len(ranks):
                ranks[i] = get(ids[i] << 32 | ids[i + 1], none)
        return ids

    def words(self, data: list[bytes]) -> list[bytes]:
        """Ids, as little-endian unsigned 32-bit integers, of many pre-tokens: those
        of about one length are merged side by side, a pair of each in a round."""
        if len(data) < FEW_WORDS:
            return [_bytes(self.word(w)) for w in data]
        out = [b""] * len(data)
        order = sorted(range(len(data)), key=lambda i: len(data[i]))
        for k in range(0, len(order), SIDE_BY_SIDE):
            part = order[k : k + SIDE_BY_SIDE]
            short = [i for i in part if len(data[i]) <= 48]
            for i in part[len(short) :]:
                out[i] = _bytes(self.word(data[i]))
            if short:
                ids, size = self._merged([data[i] for i in short])
                flat = ids[np.arange(ids.shape[1]) < size[:, None]].astype("<u4").tobytes()
                ends = (4 * np.cumsum(size)).tolist()
                for i, a, b in zip(short, [0, *ends], ends, strict=False):
                    out[i] = flat[a:b]
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; ``len(made)`` where they don't merge."""
        key = left << 32 | right
        if not len(self.pairs):
            return np.zeros(key.shape, np.int32)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_rank[at], np.int32(len(self.made)))

    def _merged(self, data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids) of words, padded to the longest one."""
        size = np.fromiter(map(len, data), np.int64, len(data))
        width, none = max(1, int(size.max())), len(self.made)
        grid = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in data), np.uint8).reshape(-1, width)
        done = self.byte_ids[grid]
        live = np.flatnonzero(size > 1)
        ids, n = done[live], size[live]
        ranks = self._ranks(ids[:, :-1], ids[:, 1:])
        place = np.arange(width)
        ranks[place[:-1] >= n[:, None] - 1] = none
        while len(live):
            i = ranks.argmin(axis=1) if width > 1 else np.zeros(len(live), np.int64)
            best = ranks[np.arange(len(live)), i]
            go = best < none
            if not go.all():
                over = live[~go]
                done[over], size[over] = ids[~go], n[~go]
                live, ids, n, ranks, i, best = live[go], ids[go], n[go], ranks[go], i[go], best[go]
                if not len(live):
                    break
            rows = np.arange(len(live))
            ids[rows, i] = self.made_ids[best]
            # What follows the pair moves up by one.
            later = np.minimum(place + (place > i[:, None]), width - 1)
            ids = np.take_along_axis(ids, later, 1)
            n -= 1
            ranks = np.take_along_axis(ranks, np.minimum(later[:, :-1], width - 2), 1)
            ranks[rows, n - 1] = none
            has = np.flatnonzero(i > 0)
            ranks[has, i[has] - 1] = self._ranks(ids[has, i[has] - 1], ids[has, i[has]])
            has = np.flatnonzero(i < n - 1)
            ranks[has, i[has]] = self._ranks(ids[has, i[has]], ids[has, i[has] + 1])
        return done, size

    def _long(self, ids: list[int]) -> list[int]:
        n, rank = len(ids), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if (r := rank.get(ids[i] << 32 | ids[j])) is not None:
                heapq.heappush(heap, (r, i, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j] = self.made[r], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [x for x in ids if x >= 0]


def units(text: str) -> list[str] | None:
    """The text cut before its spaces; None if white space meets a space."""
    return None if _SPACED.search(text) else text.split(" ")


class Transducer:
    """Reader of a memory-mapped lexicon file."""

    def __init__(self, path: str):
        n_arcs, n_states, n_words, n_ids = (int(x) for x in np.fromfile(path, np.int64, 4))
        at = 32

        def part(kind, n: int) -> np.ndarray:
            nonlocal at
            got = np.asarray(np.memmap(path, kind, "r", at, (n,))) if n else np.empty(0, kind)
            at += got.nbytes
            return got

        self.key, self.next, self.add = part(np.uint32, n_arcs), part(np.uint32, n_arcs), part(np.uint32, n_arcs)
        self.start, self.ids = part(np.uint32, n_words + 1), part(np.uint32, n_ids)
        self.final = part(np.uint8, n_states)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Of each word its number in the lexicon, or -1; all walk together."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        out = np.full(len(words), -1, np.int64)
        live = np.flatnonzero((size > 0) & (size <= LEXICON_BYTES))
        if not len(live) or not len(self.key):
            return out
        width = int(size[live].max())
        grid = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in live.tolist()), np.uint8).reshape(-1, width)
        state, total = np.zeros(len(live), np.uint32), np.zeros(len(live), np.int64)
        rows = np.arange(len(live))
        for j in range(width):
            key = (state[rows] << np.uint32(8)) | grid[rows, j]
            arc = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            hit = self.key[arc] == key
            rows, arc = rows[hit], arc[hit]
            state[rows] = self.next[arc]
            total[rows] += self.add[arc]
            ended = size[live[rows]] == j + 1
            done = rows[ended]
            good = done[self.final[state[done]] == 1]
            out[live[good]] = total[good]
            rows = rows[~ended]
            if not len(rows):
                break
        return out


def compile_lexicon(words: list[bytes], ids: Sequence[Sequence[int]]) -> bytes:
    """File of the minimal acyclic transducer: sorted ``words`` -> their ``ids``.

    Words are added in order; once a branch can't grow any more, its nodes become
    states, equal ones the same state, so that suffixes are shared. Only states are
    held, as arrays. An arc's output is the number of words that sort before those
    reached through it.
    """
    # Nodes of the last word's path: their arcs so far and whether a word ends there.
    path: list[tuple[list[int], list[int], bool]] = [([], [], False)]
    # Of the finished states the end of their arcs, whether a word ends there, and how many are reached.
    ends, final, reach = array("I"), bytearray(), array("I")
    byte_of, child_of = bytearray(), array("I")
    seen: dict[bytes, int] = {}

    def freeze(depth: int) -> None:
        while len(path) > depth + 1:
            into = finish(*path.pop())
            path[-1][1].append(into)

    def finish(bytes_: list[int], children: list[int], ended: bool) -> int:
        same = seen.setdefault(bytes([ended, *bytes_]) + array("I", children).tobytes(), len(final))
        if same == len(final):
            byte_of.extend(bytes_)
            child_of.extend(children)
            ends.append(len(byte_of))
            final.append(ended)
            reach.append(ended + sum(reach[c] for c in children))
        return same

    last = b""
    for word in words:
        common = len(os.path.commonprefix([last, word]))
        freeze(common)
        for byte in word[common:]:
            path[-1][0].append(byte)
            path.append(([], [], False))
        path[-1] = (*path[-1][:2], True)
        last = word
    freeze(0)
    finish(*path.pop())
    seen.clear()

    # Finished last, the root comes first in the file.
    end, child = np.frombuffer(ends, np.uint32).astype(np.int64), np.frombuffer(child_of, np.uint32).astype(np.int64)
    ended, below = np.frombuffer(final, np.uint8), np.frombuffer(reach, np.uint32).astype(np.int64)
    n = len(end)
    begin = np.concatenate([[0], end[:-1]])
    owner = np.repeat(np.arange(n), end - begin)
    before = np.concatenate([[0], np.cumsum(below[child])])
    add = before[:-1] - before[begin][owner] + ended[owner]
    key = (n - 1 - owner) << 8 | np.frombuffer(byte_of, np.uint8)
    by = np.argsort(key)
    arcs = [x[by].astype(np.uint32) for x in (key, n - 1 - child, add)]
    start = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.uint32)
    flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(start[-1]))
    head = np.array([len(key), n, len(words), len(flat)], np.int64)
    return b"".join(x.tobytes() for x in (head, *arcs, start, flat, ended[::-1]))


def _bytes(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def _ids(data: bytes) -> array:
    out = array("I", data)
    if sys.byteorder == "big":
        out.byteswap()
    return out


class Encoder:
    """Encodes texts by a lexicon and, outside of it, exact merges."""

    def __init__(self, tables: Tables, lexicon: Transducer | None):
        self.tables, self.lexicon = tables, lexicon
        self.cut = regex.compile(PATTERN)
        self.special = re.compile("|".join(map(re.escape, sorted(tables.added, key=len, reverse=True)))) if tables.added else None
        self.cache: dict[str, bytes] = {}
        self.held = 0  # bytes of the cache
        #: A mark after a Latin letter is a pre-token of its own.
        self.marks = {m: _bytes(tables.word(m.encode())) for m in ".,;:!?"}

    def merged(self, text: str) -> list[int]:
        return _ids(self.merged_all([text])[0]).tolist()

    def merged_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; a pre-token that occurs in several is merged once."""
        cut = [self.cut.findall(t) for t in texts]
        words = list(dict.fromkeys(w for c in cut for w in c))
        ids = dict(zip(words, self.tables.words([w.encode() for w in words]), strict=True))
        return [b"".join(map(ids.__getitem__, c)) for c in cut]

    def whole(self, text: str) -> bytes:
        """Ids of a text in one piece, added tokens included."""
        between, tokens, at = [], [b""], 0
        for m in self.special.finditer(text) if self.special else ():
            between.append(text[at : m.start()])
            tokens.append(_bytes([self.tables.added[m.group()]]))
            at = m.end()
        between.append(text[at:])
        return b"".join(t + b for t, b in zip(tokens, self.merged_all(between), strict=True))

    def remember(self, unit: str, ids: bytes) -> None:
        self.cache[unit] = ids
        self.held += ENTRY_BYTES + len(unit) + len(ids)

    def learn(self, new: list[str]) -> None:
        numbers = self.lexicon.numbers([b" " + u.encode() for u in new]).tolist() if self.lexicon else [-1] * len(new)
        outside: dict[str, None] = {}  # to be merged: units, and stems of units that end with a mark
        marked = []
        for u, k in zip(new, numbers, strict=True):
            if k >= 0:
                a, b = self.lexicon.start[k], self.lexicon.start[k + 1]
                self.remember(u, self.lexicon.ids[a:b].astype("<u4").tobytes())
            elif u[-1:] in self.marks and u[-2:-1].isalpha() and u[-2] < "\u0250":
                marked.append(u)
                if u[:-1] not in self.cache:
                    outside[u[:-1]] = None
            else:
                outside[u] = None
        for u, ids in zip(outside, self.merged_all([" " + u for u in outside]), strict=True):
            if u not in self.cache:
                self.remember(u, ids)
        for u in marked:
            self.remember(u, self.cache[u[:-1]] + self.marks[u[-1]])

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Of each text its ids as little-endian unsigned 32-bit integers."""
        for k in range(0, len(texts), GROUP):
            group = texts[k : k + GROUP]
            cut = [None if self.special and self.special.search(t) else units(t) for t in group]
            if self.held > CACHE_BYTES:
                self.cache.clear()
                self.held = 0
            new: set[str] = set()
            for u in cut:
                if u is not None:
                    new.update(u[1:])
            self.learn([u for u in new if u not in self.cache])  # a difference of key views goes through the whole cache
            get = self.cache.__getitem__
            for text, u in zip(group, cut, strict=True):
                if u is None:
                    yield self.whole(text)
                else:
                    yield self.whole(u[0]) + b"".join(map(get, u[1:]))

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD."""
        piece = self.tables.piece
        return b"".join(map(piece.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def _worker_encoder(name: str, tables: Tables) -> Encoder:
    """The one encoder of a Python worker; its memory of units outlives a task, and
    goes when the worker turns to another stage."""
    return kept_in_worker(name, lambda: Encoder(tables, Transducer(SparkFiles.get(name))))


def count_units(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(unit, n): how often each space-led unit occurs in all texts."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["unit", "n"]
            )
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                cut = units(text.as_py() or "")
                if cut:
                    seen.update(cut[1:])
                if len(seen) > COUNT_CACHE:
                    yield flush()
        yield flush()

    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "unit string, n long")
    return parts.groupBy("unit").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, tables: Tables, text_col: str = "text", size: int = LEXICON_WORDS) -> bytes:
    """The lexicon of the most frequent units of all texts, at most ``size``.

    The least count is read off the histogram of counts; only units that reach
    it (a bounded number of bounded length) come to the driver.
    """
    counts = materialize(
        count_units(docs, text_col).where((F.col("n") > 1) & (F.octet_length("unit") < LEXICON_BYTES))
    )
    total, least = 0, None
    for r in counts.groupBy("n").agg(F.count("*").alias("units")).orderBy(F.desc("n")).toLocalIterator():
        total += r.units
        if total > size:
            break
        least = r.n
    top = counts.where(F.col("n") >= least) if least else counts.limit(0)
    words = sorted(b" " + r.unit.encode() for r in top.select("unit").toLocalIterator())
    exact = Encoder(tables, None)
    ids: list[array] = []
    for k in range(0, len(words), SIDE_BY_SIDE):
        ids += map(_ids, exact.merged_all([w.decode() for w in words[k : k + SIDE_BY_SIDE]]))
    return compile_lexicon(words, ids)


def encode_decode(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    lexicon_words: int = LEXICON_WORDS,
    keep_ids: bool = False,
) -> DataFrame:
    """Per row: doc_id, ids (``keep_ids`` only), n_tokens, ids_sha256,
    decoded_sha256. ``tokenizer`` is the path of a byte-level BPE file."""
    sc = docs.sparkSession.sparkContext
    tables = Tables(tokenizer)
    data = build_lexicon(docs, tables, text_col, lexicon_words)
    # The driver serves this file under a name of its own; every executor fetches a copy.
    name = f"lexicon-{uuid.uuid4().hex}.mat"
    source = os.path.join(tempfile.mkdtemp(prefix="lexicon-"), name)
    with open(source, "wb") as f:
        f.write(data)
    sc.addFile(source)
    shared = sc.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker_encoder(name, shared.value)
        for batch in batches:
            n, digest, back, all_ids = [], [], [], []
            texts = batch.column(1)
            for k in range(0, len(texts), GROUP):
                for ids in encoder.encode([t.as_py() or "" for t in texts.slice(k, GROUP)]):
                    n.append(len(ids) // 4)
                    digest.append(hashlib.sha256(ids).hexdigest())
                    back.append(hashlib.sha256(encoder.decode(ids).encode()).hexdigest())
                    if keep_ids:
                        all_ids.append(np.frombuffer(ids, "<u4").astype(np.int32))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(back, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run, name), schema)
