"""Secret scans with multipart credential linking, in DataFrame operations only.

Regular matches are marked in the text by ``regexp_replace``, which is then
split at the marks: odd pieces are matches, and running sums of the pieces'
lengths are their places in code points. Only lengths leave the text.

Besides the base kinds (assign, access, hex) three weak kinds are candidates:
``id`` (an access identifier given by name), ``opaque`` (a long mixed string, or
an assigned value too short for the base) and ``endpoint`` (a service address).
Parts are identifiers (access, id), secrets (assign, hex, opaque) and endpoints.
An interval join links parts that don't overlap and whose starts lie at most
``scope`` characters apart: parts are dealt by ``scope``-wide buckets of their
starts, and a candidate meets its own and the two neighbouring buckets. A weak
identifier is reported if a secret is in its scope, a weak
secret if an identifier is, an endpoint if both are.

Equal texts are scanned for spans once. Cases: a null text counts as empty;
empty texts have no spans; rows are returned each, repeated or with null ids;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialize

#: Characters between the starts of parts that belong together.
SCOPE = 400
LEAST_ASSIGNED, LEAST_WEAK = 12, 6

_MARK, _VALUE, _OTHER = "\u0001", "\u0002", "\u0003"

# The base patterns (head, value). Weak kinds follow them.
ASSIGN = (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+")
ACCESS = ("", r"AKIA[A-Z0-9]+")
HEX = ("", r"[0-9a-f]{16,}")
NAMED_ID = (
    r"""(?i:access_?key_?id|client_?id|account_?id|user_?name|user_?id|login)["']?\x20*[:=]\x20*["']?""",
    r"[A-Za-z0-9_.@-]{3,}",
)
OPAQUE = ("", r"[A-Za-z0-9+/_-]{20,}")
ENDPOINT = ("", r"""(?i:https?|ftp|amqps?|redis|mongodb|mysql|postgres(?:ql)?|jdbc:[a-z]+)://[^\s"'<>]+""")

#: Names in the order in which spans of one start are listed.
KINDS = ["assign", "access", "hex", "id", "opaque", "endpoint"]
_PATTERNS = [ASSIGN, ACCESS, HEX, NAMED_ID, OPAQUE, ENDPOINT]
_IDENTIFIER, _SECRET, _ENDPOINT = ("access", "id"), ("assign", "hex", "opaque"), ("endpoint",)


def _pieces(text: Column, head: str, value: str) -> Column:
    """Array of (length, length of the value) of the marked text's pieces."""
    marked = F.regexp_replace(text, f"({head})({value})", f"{_MARK}$1{_VALUE}$2{_MARK}")
    at = lambda p: F.instr(p, _VALUE)
    size = lambda p: F.when(at(p) > 0, F.length(p) - 1).otherwise(F.length(p))
    mixed = lambda p: p.rlike("[0-9]") & p.rlike("[a-z]") & p.rlike("[A-Z]")
    return F.transform(
        F.split(marked, _MARK, -1),
        lambda p: F.struct(size(p).alias("size"), (F.length(p) - at(p)).alias("value"), mixed(p).alias("mixed")),
    )


def _marks(text: Column) -> Column:
    """Array of (kind number, pieces) of the kinds that occur in the text."""
    clean = F.translate(text, _MARK + _VALUE, _OTHER + _OTHER)
    found = [
        F.struct(F.lit(i).alias("kind"), F.when(text.rlike(head + value), _pieces(clean, head, value)).alias("pieces"))
        for i, (head, value) in enumerate(_PATTERNS)
    ]
    return F.filter(F.array(*found), lambda m: m["pieces"].isNotNull())


def _number(kinds) -> list[int]:
    return [KINDS.index(k) for k in kinds]


def _spans_of(marked: DataFrame) -> DataFrame:
    """(key, kind, start, end) of base and weak spans of the marked texts."""
    run = Window.partitionBy("key", "mark").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        marked.select("key", F.explode("marks").alias("m"))
        .select("key", F.col("m.kind").alias("mark"), F.posexplode("m.pieces").alias("at", "p"))
        .withColumn("end", F.sum("p.size").over(run))
        .where("at % 2 = 1")
        .select("key", "mark", "p", (F.col("end") - F.col("p.size")).alias("start"), "end")
    )
    assign, access, opaque = (KINDS.index(k) for k in ("assign", "access", "opaque"))
    kind = (
        F.when(F.col("mark") == assign, F.when(F.col("p.value") >= LEAST_ASSIGNED, F.lit(assign)).when(F.col("p.value") >= LEAST_WEAK, F.lit(opaque)))
        .when(F.col("mark") == access, F.when(F.col("end") - F.col("start") >= 18, F.lit(access)))
        .when(F.col("mark") == opaque, F.when(F.col("p.mixed"), F.lit(opaque)))
        .otherwise(F.col("mark"))
    )
    return placed.withColumn("kind", kind).where("kind is not null").select("key", "kind", "start", "end").distinct()


def link_parts(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak spans that have their complementary parts within the scope.

    A complement doesn't overlap the span: no value vouches for itself. Parts meet
    within a ``scope``-wide bucket and its neighbours, so a span meets no more
    parts than fit into three scopes of text.
    """
    bucket = F.floor(F.col("start") / scope)
    role = F.when(F.col("kind").isin(_number(_IDENTIFIER)), F.lit("identifier")).when(
        F.col("kind").isin(_number(_SECRET)), F.lit("secret")
    )
    parts = (
        spans.select("key", bucket.alias("near"), role.alias("role"), F.col("start").alias("from"), F.col("end").alias("to"))
        .where("role is not null")
        .distinct()
    )
    weak = spans.where(F.col("kind").isin(_number(["id", "opaque", "endpoint"]))).withColumn(
        "near", F.explode(F.sequence(bucket - 1, bucket + 1))
    )
    apart = (F.col("to") <= F.col("start")) | (F.col("from") >= F.col("end"))
    seen = (
        weak.join(parts, ["key", "near"])
        .where(apart & (F.abs(F.col("start") - F.col("from")) <= scope))
        .groupBy("key", "kind", "start", "end")
        .agg(F.bool_or(F.col("role") == "identifier").alias("identifier"), F.bool_or(F.col("role") == "secret").alias("secret"))
    )
    wanted = (
        F.when(F.col("kind") == KINDS.index("id"), F.col("secret"))
        .when(F.col("kind") == KINDS.index("opaque"), F.col("identifier"))
        .otherwise(F.col("identifier") & F.col("secret"))
    )
    return seen.where(wanted).select("key", "kind", "start", "end")


def _scan(docs: DataFrame, id_col: str, text_col: str, scope: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, key) and the spans (key, kind, start, end) of their texts.

    The key is a digest of the text, null where no pattern matches.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
        .withColumn("marks", _marks(F.col("text")))
        .select("doc_id", F.when(F.size("marks") > 0, F.sha2("text", 256)).alias("key"), "marks")
    )
    marked = rows.where("key is not null").groupBy("key").agg(F.any_value("marks").alias("marks"))
    found = materialize(_spans_of(marked))
    base = found.where(F.col("kind").isin(_number(["assign", "access", "hex"])))
    return rows.select("doc_id", "key"), base.union(link_parts(found, scope))


def _joined(items: Column) -> Column:
    """kind:start:end, comma-joined in the order of the sorted items."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(items, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are in code points, ends exclusive, ordered by start and kind.
    """
    rows, spans = _scan(docs, id_col, text_col, scope)
    of_text = spans.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("items"))
    base = F.filter("items", lambda s: s["kind"] < 3)
    count = lambda kind: F.size(F.filter("items", lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    # Rows without a key stay out of the join: nulls would all meet in one task.
    held = rows.where("key is not null").join(of_text, "key", "left").select("doc_id", F.coalesce("items", none).alias("items"))
    return (
        held.union(rows.where("key is null").select("doc_id", none.alias("items")))
        .select(
            "doc_id",
            *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
            F.sha2(_joined(base), 256).alias("base_sha256"),
            _joined(F.col("items")).alias("spans"),
        )
    )


def _small_cuts(merged: DataFrame) -> DataFrame:
    """Cuts are broadcast by their number in all texts, not by the texts."""
    n = merged.agg(F.sum(F.size("__secret_cuts"))).first()[0] or 0
    return F.broadcast(merged) if n <= BROADCAST_ROWS else merged


def redact_secrets(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """``docs`` with every found span of the text column replaced by ``mask``.

    Overlapping spans become one mask; texts without spans stay as they are,
    null ones included.
    """
    _, spans = _scan(docs.withColumn("__secret_row", F.lit(0)), "__secret_row", text_col, scope)
    before = Window.partitionBy("key").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.col("start") >= F.max("end").over(before), F.lit(True))
    run = Window.partitionBy("key").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, 0)
    merged = (
        spans.withColumn("run", F.sum(first.cast("int")).over(run))
        .groupBy("key", "run")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .groupBy("key")
        .agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__secret_cuts"))
    )
    merged = materialize(merged.withColumnRenamed("key", "__secret_key"))
    text = F.col(text_col)
    starts = F.transform("__secret_cuts", lambda c: c["start"])
    ends = F.transform("__secret_cuts", lambda c: c["end"])
    # What stands between the cuts: from each end to the next start.
    kept = F.zip_with(
        F.concat(F.array(F.lit(0).cast("long")), ends),
        F.concat(starts, F.array(F.length(text).cast("long"))),
        lambda a, b: F.substr(text, (a + 1).cast("int"), (b - a).cast("int")),
    )
    masked = F.when(F.col("__secret_cuts").isNull(), text).otherwise(F.array_join(kept, mask))
    return (
        docs.withColumn("__secret_key", F.sha2(text, 256))
        .join(_small_cuts(merged), "__secret_key", "left")
        .select(*[masked.alias(c) if c == text_col else F.col(c) for c in docs.columns])
    )
