"""DuckDB SQL for the registered queries of this package that SQL can express."""

from __future__ import annotations

from .urls import RULES

_HOST = "translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _rule_case(column: int) -> str:
    """CASE over the rules, longest first."""
    whens = []
    for rule in sorted(RULES, key=lambda r: -len(r[1] + r[2])):
        value = rule[0] if column == 0 else rule[1] + rule[2]
        whens.append(
            f"WHEN (host = '{rule[1]}' OR ends_with(host, '.{rule[1]}')) AND starts_with(path, '{rule[2]}') THEN '{value}'"
        )
    return f"CASE {' '.join(whens)} END"


URL_SQL = f"""
WITH cut AS (
  SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, html, {_HOST} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), named AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '/+$', '') END AS name FROM parts
), listed AS (
  SELECT DISTINCT name FROM named
  WHERE name IS NOT NULL AND regexp_matches(html, '\\*\\*\\*|###|%%%|\\$\\$\\$')
), judged AS (
  SELECT page_id, host, path, {_rule_case(1)} AS rule, {_rule_case(0)} AS ruled,
         coalesce(name IN (SELECT name FROM listed), false) AS listed
  FROM named
)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed FROM judged
"""

TOP_K_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM pairs
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


NEAR_SQL = """
WITH RECURSIVE cut AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws
  FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) = 1 THEN ws[1] ELSE ws[r.i] || ' ' || ws[r.i + 1] END AS g
  FROM cut, LATERAL range(1, greatest(len(ws), 2)) AS r(i) WHERE len(ws) > 0
), size AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingle a JOIN shingle b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM shared JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
), reach(doc_id, node) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN link l ON r.node = l.a
)
SELECT doc_id, CAST(coalesce(max(s.n), 0) AS BIGINT) AS n_shingles, min(node) AS component_id, doc_id = min(node) AS kept
FROM reach LEFT JOIN size s USING (doc_id) GROUP BY doc_id
"""


# Fixed value: the reflected polynomial of crc32. Its table is made in SQL.
_CRC_TABLE = """
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 1, 2, 3, 4, 5, 6, 7],
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
"""
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _crc32(text: str) -> str:
    """crc32 of a string's UTF-8 bytes; ``t`` is the table."""
    code = f"hex(encode({text}))"
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: CAST('0x' || substr({code}, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))"
    return (
        f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}),"
        " lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295)"
    )


REPEATS_SQL = """
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents
), win AS (
  SELECT r, p.p AS p, md5(array_slice(b, p.p + 1, p.p + 400)) AS m FROM texts, LATERAL range(octet_length(b) - 399) AS p(p)
), hit AS (
  SELECT r, p FROM win WHERE m IN (SELECT m FROM win GROUP BY m HAVING count(*) > 1)
), opened AS (
  SELECT r, p, coalesce(p > lag(p) OVER (PARTITION BY r ORDER BY p) + 400, true) AS opens FROM hit
), numbered AS (
  SELECT r, p, sum(CAST(opens AS INT)) OVER (PARTITION BY r ORDER BY p) AS k FROM opened
), span AS (
  SELECT r, min(p) AS a, max(p) + 400 AS z FROM numbered GROUP BY r, k
), piece AS (
  SELECT r, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS x, a AS y FROM span
  UNION ALL
  SELECT r, coalesce((SELECT max(z) FROM span s WHERE s.r = t.r), 0), octet_length(b) FROM texts t
), kept AS (
  SELECT r, string_agg(substr(hex(b), 2 * x + 1, 2 * (y - x)), '' ORDER BY x) AS h FROM piece JOIN texts USING (r) GROUP BY r
)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(sum(z - a), 0) AS BIGINT) AS n_removed,
       count(a) AS n_spans, sha256(unhex(any_value(h))) AS kept_sha256
FROM texts JOIN kept USING (r) LEFT JOIN span USING (r) GROUP BY r, doc_id, b
"""

SPELLING_SQL = f"""
WITH RECURSIVE crc AS MATERIALIZED ({_CRC_TABLE}), run AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')), {_AZ}) AS w FROM documents
), counted AS (
  SELECT doc_id, w, count(*) AS k FROM run WHERE length(w) >= 6 GROUP BY ALL
), hashed AS (
  SELECT w, k, {_crc32("doc_id || ':' || w")} AS h FROM counted, crc
), cut AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, k FROM hashed
), word AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5
), less AS (
  SELECT word, i.i AS i, substr(word, 1, i.i - 1) AS head, substr(word, i.i + 1) AS tail FROM word, LATERAL range(1, length(word) + 1) AS i(i)
), pair AS (
  SELECT a.word AS word, b.word AS near FROM less a JOIN less b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION
  SELECT less.word, w.word FROM less JOIN word w ON w.word = head || tail
  UNION
  SELECT w.word, less.word FROM less JOIN word w ON w.word = head || tail
), counts AS (
  SELECT pair.word, near, b.n AS near_n, count(*) OVER (PARTITION BY pair.word) AS n_near,
         row_number() OVER (PARTITION BY pair.word ORDER BY b.n DESC, near) AS place
  FROM pair JOIN word b ON b.word = near
), formed AS (
  SELECT word.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n
  FROM word LEFT JOIN counts ON counts.word = word.word AND place = 1
), way(word, top, step) AS (
  SELECT word, word, 0 FROM formed
  UNION ALL
  SELECT way.word, form, step + 1 FROM way JOIN formed ON formed.word = way.top WHERE form IS NOT NULL
), ends AS (
  SELECT word, arg_max(top, step) AS root FROM way GROUP BY word
)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM formed JOIN ends USING (word)
"""


def _tree(name: str, leaves: str, levels: int) -> str:
    """CTEs of a 16-ary tree for each g of ``leaves`` (g, pos, n, h): {name}0, ... hold
    the nodes of a level, {name}p0, ... what stands before and after each in its run."""
    parts = []
    for k in range(levels + 1):
        source = f"SELECT g, pos, n, h FROM {leaves}" if k == 0 else f"""
  SELECT g, pos // 16 AS pos, CAST(ceil(any_value(n) / 16) AS BIGINT) AS n,
         CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE any_value(h) END AS h
  FROM {name}{k - 1} GROUP BY g, pos // 16"""
        parts.append(f"{name}{k} AS MATERIALIZED ({source})")
        parts.append(f"""{name}p{k} AS (SELECT g, pos, n,
    coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
    coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS z
  FROM {name}{k} WINDOW w AS (PARTITION BY g, pos // 16 ORDER BY pos))""")
    return ", ".join(parts)


def _merkle(levels: int, source_levels: int) -> str:
    """Whole trees of up to 16^levels rows a source and 16^source_levels sources."""

    def part(x: str) -> str:
        return f"CASE WHEN {x} IS NULL THEN '-' ELSE octet_length(encode(CAST({x} AS VARCHAR))) || ':' || {x} END"

    def leaf(text: str) -> str:
        return "sha256(concat(" + ", ".join(part(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + "))"

    steps = [(f"d{k}", f"x.pos // {16**k}", "docp", k, "x.g") for k in range(levels)]
    above = [(f"s{k}", f"x.spos // {16**k}", "srcp", k, "''") for k in range(source_levels)]
    joins = " ".join(
        f"JOIN {table}{k} {alias} ON {alias}.g = {g} AND {alias}.pos = {at}" for alias, at, table, k, g in [*steps, *above]
    )
    fold, proof = "checked", []
    folds = []
    for i, (alias, *_) in enumerate([*steps, *above]):
        folds.append(f"CASE WHEN {alias}_n > 1 THEN sha256({alias}_a || {fold} || {alias}_z) ELSE {fold} END AS f{i}")
        fold = f"f{i}"
        proof.append(f"CASE WHEN {alias}_n > 1 THEN {alias}_a || {alias}_z ELSE '' END")
    nested = "all_paths"
    for f in folds:
        nested = f"(SELECT *, {f} FROM {nested})"
    columns = ", ".join(f"{a}.n AS {a}_n, {a}.a AS {a}_a, {a}.z AS {a}_z" for a, *_ in [*steps, *above])
    return f"""
WITH crc AS MATERIALIZED ({_CRC_TABLE}), leaf AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS g, {leaf("text")} AS h,
         CASE WHEN doc_id IS NOT NULL AND {_crc32("coalesce(doc_id, 0) || ''")} % 5 = 0 THEN {leaf(f"translate(text, {_AZ})")} END AS changed
  FROM documents, crc
), placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaf
), {_tree("doc", "placed", levels)}, subroot AS MATERIALIZED (
  SELECT '' AS g, g AS source, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n, h FROM doc{levels}
), {_tree("src", "subroot", source_levels)}, all_paths AS (
  SELECT doc_id, x.h AS leaf, coalesce(changed, x.h) AS checked, b.h AS subroot, r.h AS root, {columns}
  FROM (SELECT placed.*, subroot.pos AS spos FROM placed JOIN subroot ON subroot.source = placed.g) x
  JOIN doc{levels} b ON b.g = x.g CROSS JOIN src{source_levels} r {joins}
)
SELECT doc_id, leaf, subroot, root, sha256(concat({", ".join(proof)})) AS proof_sha256, {fold} AS folded_root, {fold} = root AS verified
FROM {nested}
"""


#: Enough for a million rows a source and 65,536 sources.
MERKLE_SQL = _merkle(5, 4)


def oracle_sql() -> dict[str, str]:
    return {
        "op5_url_filter": URL_SQL,
        "op7_minhash_neardup": NEAR_SQL,
        "op10_ball_tree_top_k": TOP_K_SQL,
        "op11_suffix_array_dedup": REPEATS_SQL,
        "op12_spelling_variants": SPELLING_SQL,
        "op13_merkle_manifest": MERKLE_SQL,
    }
