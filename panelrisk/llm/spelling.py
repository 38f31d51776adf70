"""Groups of spelling variants by blocked Gram matrices.

Words are counted over all texts. Words of equal length, and of equal numbers of
letters from two fixed sets, form a block; large blocks are split. One edit moves
a word to the same block or to one of a few neighbours of the same or the next
length, so those block pairs are all that has to be looked at. For a pair of
blocks the product of their letter-count matrices gives all squared distances:
one replaced letter means 2, one more letter means 1. Only pairs at those
distances are kept, and verified letter by letter.

Every near pair then counts for both its words (``n_near``), the most frequent
near word may become a word's form, and roots follow forms by pointer jumping.

Cases: null and empty texts hold no word; repeated rows count again; rows with a
null id are counted, with no letter deleted; long texts are read whole. Equal
counts of candidates go to the smaller word. Other columns are ignored. An empty
table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small, tidy

#: Distinct words a Python task counts before it hands them on.
COUNT_CACHE = 200_000
#: Words on one side of a block pair, where words have up to 32 letters; longer
#: ones make smaller blocks.
BLOCK = 2048
#: Pairs verified at a time, in letters.
VERIFY_LETTERS = 4_000_000

#: Two sets of letters that refine a block of equal length.
SETS = ("aeiouàáâãäåèéêëìíîïòóôõöùúûü", "rstvwxyzß")
#: Steps of the refined key: within a length (once each), and to the next length.
SAME, LONGER = ((0, 0), (0, 1), (1, 0), (1, -1)), ((0, 0), (0, 1), (1, 0))


def find_words(text: str, min_letters: int) -> list[str]:
    """Maximal runs of letters with at least ``min_letters``, A-Z in lower case."""
    return re.findall(f"[A-Za-zÀ-ÿ]{{{min_letters},}}", text.encode().lower().decode())


def count_words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = 6, every: int = 199
) -> DataFrame:
    """(word, n): occurrences over all texts.

    A run whose crc32 of ``<id>:<run>`` is divisible by ``every`` loses the
    letter at that crc32 modulo its length.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            words = [w for w, k in seen.items() if k > 0 and len(w) >= min_letters]
            out = pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array([seen[w] for w in words], pa.int64())], names=["word", "n"]
            )
            seen.clear()
            return out

        crc = zlib.crc32
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                found = find_words(text.as_py() or "", min_letters)
                seen.update(found)
                if doc_id.is_valid:
                    start = crc(f"{doc_id.as_py()}:".encode())
                    for w in [w for w in set(found) if crc(w.encode(), start) % every == 0]:
                        at = crc(w.encode(), start) % len(w)
                        k = found.count(w)
                        seen[w] -= k
                        seen[w[:at] + w[at + 1 :]] += k
                if len(seen) > COUNT_CACHE:
                    yield flush()
        yield flush()

    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _blocks(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of a block's part: (size, c0, c1, part, letters, counts), its words one
    after the other; and (size, c0, c1, parts) of all blocks."""
    own = [F.length("word").alias("size")] + [
        F.length(F.regexp_replace("word", f"[^{s}]", "")).alias(f"c{i}") for i, s in enumerate(SETS)
    ]
    keyed = words.select("word", "n", *own)
    parts = F.ceil(F.count("*") * F.greatest(F.col("size") / 32, F.lit(1)) / BLOCK).cast("int")
    sizes = materialize(keyed.groupBy("size", "c0", "c1").agg(parts.alias("parts")))
    spread = F.pmod(F.xxhash64("word"), F.lit(1 << 30))
    held = (
        keyed.join(small(sizes), ["size", "c0", "c1"])
        .withColumn("part", (spread % F.col("parts")).cast("int"))
        .groupBy("size", "c0", "c1", "part")
        .agg(F.collect_list(F.struct("word", "n")).alias("held"))
    )
    letters = F.array_join(F.transform("held", lambda x: x["word"]), "").alias("letters")
    return materialize(held.select("size", "c0", "c1", "part", letters, F.col("held.n").alias("counts"))), sizes


def _block_pairs(words: DataFrame) -> DataFrame:
    """(pair, side, size, letters, counts): both rows of every pair of parts to
    look at. A pair's name is the first part's key and the step and part of the
    second, so the parts of one hot block spread over as many tasks as they have
    pairs.
    """
    parts, sizes = _blocks(words)
    steps = [(0, *s) for s in SAME] + [(1, *s) for s in LONGER]

    def met(sign: int) -> DataFrame:
        """Parts with each part of the other side that they meet."""
        to = [
            F.struct(
                F.lit(i).alias("step"),
                (F.col("size") + sign * d).alias("to_size"),
                (F.col("c0") + sign * a).alias("to_c0"),
                (F.col("c1") + sign * b).alias("to_c1"),
            )
            for i, (d, a, b) in enumerate(steps)
        ]
        other = sizes.select(*[F.col(c).alias(f"to_{c}") for c in sizes.columns])
        gone = parts.withColumn("to", F.explode(F.array(*to))).select("*", "to.*").drop("to")
        found = gone.join(small(other), ["to_size", "to_c0", "to_c1"])
        return found.withColumn("to_part", F.explode(F.sequence(F.lit(0), F.col("to_parts") - 1)))

    def named(first: str, second: str) -> Column:
        key = [F.col(f"{first}{c}").alias(c) for c in ("size", "c0", "c1")]
        return F.struct(*key, F.col(f"{first}part").alias("a"), "step", F.col(f"{second}part").alias("b")).alias("pair")

    rest = ["size", "letters", "counts"]
    first = met(1).select(named("", "to_"), F.lit(0).alias("side"), *rest)
    second = met(-1).select(named("to_", ""), F.lit(1).alias("side"), *rest)
    # Two parts of one block (step 0) meet once; a part meets itself.
    return first.union(second).where("pair.step > 0 or pair.a <= pair.b")


def _table(points: np.ndarray) -> np.ndarray:
    """Letter counts of words, one a row."""
    flat = points.astype(np.int64) + 256 * np.arange(len(points))[:, None]
    return np.bincount(flat.ravel(), minlength=256 * len(points)).reshape(-1, 256)


def _one_replaced(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x != y).sum(axis=1) == 1


def _one_more(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether the rows of ``long`` are those of ``short`` with one letter more."""
    head = np.logical_and.accumulate(short == long[:, :-1], axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= short.shape[1]


def near_in_blocks(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of the near words of two blocks: code points, a word a row,
    ``b`` as long as ``a`` or one letter longer.

    One product gives all squared distances |x|^2 + |y|^2 - 2xy of the letter
    counts, in whole numbers that a float of the chosen size holds exactly.
    """
    ca, cb = _table(a), _table(b)
    used = ca.any(axis=0) | cb.any(axis=0)
    ca, cb = ca[:, used], cb[:, used]
    kind = np.float32 if b.shape[1] < 1500 else np.float64
    left = np.column_stack([-2 * ca, (ca**2).sum(axis=1), np.ones(len(a), np.int64)]).astype(kind)
    right = np.column_stack([cb, np.ones(len(b), np.int64), (cb**2).sum(axis=1)]).astype(kind)
    same = a.shape[1] == b.shape[1]
    i, j = np.nonzero(left @ right.T == (2 if same else 1))
    verify = _one_replaced if same else _one_more
    step = max(1, VERIFY_LETTERS // b.shape[1])
    good = [verify(a[i[k : k + step]], b[j[k : k + step]]) for k in range(0, len(i), step)]
    keep = np.concatenate([np.empty(0, bool), *good])
    return i[keep], j[keep]


def _near(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    """Near pairs of the two parts of a pair; a part without a partner has none."""
    pair = key[0].as_py()
    rows = {r["side"]: r for r in group.select(["side", "size", "letters", "counts"]).to_pylist()}
    left: list[str] = []
    right: list[str] = []
    n_left = n_right = np.empty(0, np.int64)
    if len(rows) == 2:
        points = [np.frombuffer(rows[s]["letters"].encode("latin-1"), np.uint8).reshape(-1, rows[s]["size"]) for s in (0, 1)]
        i, j = near_in_blocks(*points)
        if pair["step"] == 0 and pair["a"] == pair["b"]:  # a part with itself
            once = i < j
            i, j = i[once], j[once]

        def words(side: int, at: np.ndarray) -> list[str]:
            letters, size = rows[side]["letters"], rows[side]["size"]
            return [letters[k * size : (k + 1) * size] for k in at.tolist()]

        left, right = words(0, i), words(1, j)
        n_left, n_right = np.array(rows[0]["counts"], np.int64)[i], np.array(rows[1]["counts"], np.int64)[j]
    return pa.table(
        {
            "word": pa.array(left + right, pa.string()),
            "near": pa.array(right + left, pa.string()),
            "near_n": pa.array(np.concatenate([n_right, n_left]), pa.int64()),
        }
    )


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): all pairs, both ways, that differ by one inserted,
    deleted or replaced letter. ``words`` holds distinct (word, n)."""
    return _block_pairs(words).groupBy("pair").applyInArrow(_near, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of all words with a form: the last one along their forms.

    A round doubles how far each word sees; forms grow in count, so no circle.
    """
    seen = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        on = seen.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = materialize(seen.join(on, "root", "left"))
        if not moved.where("further is not null").limit(1).count():
            return moved.select("word", "root")
        seen = moved.select("word", F.coalesce("further", "root").alias("root"))


def spelling_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_letters: int = 6,
    min_count: int = 5,
    ratio: int = 5,
    every: int = 199,
) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n.

    A word's form is its near word of largest count, if that is ``ratio`` times
    its own or more.
    """
    words = materialize(
        count_words(docs, id_col, text_col, min_letters, every).where(F.col("n") >= min_count)
    )
    best = (
        near_words(words)
        .groupBy("word")
        .agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("best"))
    )
    judged = materialize(
        words.join(best, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(-F.col("best.order") >= ratio * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.order")).alias("n"))).alias("to"),
        )
    )
    ends = roots(judged.where("to is not null").select("word", F.col("to.form").alias("form")))
    return judged.join(ends, "word", "left").select(
        "word",
        F.col("to.form").alias("form"),
        F.coalesce("root", "word").alias("root"),
        "n",
        "n_near",
        F.col("to.n").alias("form_n"),
    )
