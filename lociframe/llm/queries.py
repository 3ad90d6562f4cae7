"""The registered queries of the subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociframe.llm import decontaminate, language, licenses, linededup, merkle, mixing, pseudolm, secrets, simhash, sketches, tokens, urls, whitening
from lociframe.llm.base import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES"]


def _op1_sql() -> str:
    """Containment of every template in every window, counted from exact shingles."""
    s = licenses
    given = ", ".join(f"('{k}', '{v}')" for k, v in s.TEMPLATES.items())
    fold = r"list_filter(regexp_split_to_array(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '')"
    return f"""
WITH t AS (SELECT name, {fold} AS ws FROM (VALUES {given}) v(name, text)),
ts AS (
  SELECT name, shingle, count(*) OVER (PARTITION BY name) AS n, any_value(step) AS step
  FROM (SELECT name, array_to_string(ws[i:i + 4], ' ') AS shingle, {s.BLOCK} * CAST(2 ** greatest(0, ceil(log2((len(ws) - 4) / {s.BLOCK}.0))) AS BIGINT) AS step
        FROM (SELECT name, ws, unnest(range(1, len(ws) - 3)) AS i FROM t)) GROUP BY name, shingle),
d AS (SELECT row_number() OVER () AS rid, doc_id, {fold} AS ws FROM documents),
ds AS (SELECT rid, i - 1 AS p, array_to_string(ws[i:i + 4], ' ') AS shingle FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5)),
hit AS (SELECT rid, name, n, shingle, unnest([p // step, p // step - 1]) AS win FROM ds JOIN ts USING (shingle)),
w AS (SELECT rid, name, count(DISTINCT shingle) / max(n) AS share FROM hit WHERE win >= 0 GROUP BY rid, name, win),
m AS (SELECT rid, name, max(share) AS share FROM w WHERE share >= {s.CONTAINMENT} GROUP BY rid, name),
g AS (SELECT rid, count(*) AS n_licenses, string_agg(name, ',' ORDER BY name) AS licenses, max(share) AS best FROM m GROUP BY rid)
SELECT doc_id, coalesce(n_licenses, 0) AS n_licenses, coalesce(licenses, '') AS licenses, best FROM d LEFT JOIN g USING (rid)"""


@query("op1_license_scan", _op1_sql())
def op1(spark, sf_dir):
    return licenses.find_licenses(table(spark, sf_dir, "documents"))


@query("op2_source_mixing")
def op2(spark, sf_dir):
    return mixing.mixture(table(spark, sf_dir, "documents"))


def _op3_kind(kind: str, pattern: str, keep: str) -> str:
    """Leftmost non-overlapping matches of a pattern, with places from running sums of gap and match lengths."""
    pattern = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, '{kind}' AS kind, s AS start, s + length(m) AS stop, m FROM (
    SELECT doc_id, m, CAST(sum(gap) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY rid ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s
    FROM (SELECT rid, doc_id, unnest(range(1, len(ms) + 1)) AS k, unnest(ms) AS m, unnest(list_transform(gaps[:len(ms)], lambda g: length(g))) AS gap
          FROM (SELECT rid, doc_id, regexp_extract_all(text, '{pattern}') AS ms, regexp_split_to_array(text, '{pattern}') AS gaps FROM d WHERE regexp_matches(text, '{pattern}')))
    WINDOW w AS (PARTITION BY rid ORDER BY k)) WHERE {keep}"""


def _op3_sql() -> str:
    s = secrets
    value = s.ASSIGN.replace("'", "''")
    allowed = " OR ".join(f"regexp_matches(m, '{p}')" for p in s.ALLOWED)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
assign AS ({_op3_kind("assign", s.ASSIGN, f"length(regexp_extract(m, '{value}', 2)) >= 8")}),
access AS ({_op3_kind("access", s.ACCESS, "length(m) >= 16")}),
hex AS ({_op3_kind("hex", s.HEX, "length(m) >= 32")}),
cand AS ({_op3_kind("entropy", s.CANDIDATE, "true")}),
hot AS (
  SELECT doc_id, start, m, i FROM (
    SELECT doc_id, start, m, i, list_sum(list_transform(map_values(list_aggregate(string_split(substr(m, i + 1, {s.WINDOW}), ''), 'histogram')), lambda c: ({s.TERMS})[CAST(c AS BIGINT) + 1])) AS total
    FROM (SELECT *, unnest(range(0, length(m) - {s.WINDOW} + 1)) AS i FROM cand WHERE NOT ({allowed})))
  WHERE total <= CASE WHEN regexp_matches(m, '{s.HEX_CLASS}') THEN {s.LIMITS["hex"]} ELSE {s.LIMITS["mixed"]} END),
spans AS (
  SELECT doc_id, kind, start, stop FROM assign UNION ALL SELECT doc_id, kind, start, stop FROM access UNION ALL SELECT doc_id, kind, start, stop FROM hex
  UNION ALL SELECT doc_id, 'entropy', start + min(i), start + max(i) + {s.WINDOW} FROM hot GROUP BY doc_id, start, m),
numbered AS (SELECT doc_id, kind, start, kind || ':' || start || ':' || stop AS s, list_position(['assign', 'access', 'hex', 'entropy'], kind) AS o FROM spans),
g AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         count(*) FILTER (kind = 'entropy') AS n_entropy, string_agg(s, ',' ORDER BY start, o) FILTER (kind <> 'entropy') AS base, string_agg(s, ',' ORDER BY start, o) AS spans
  FROM numbered GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_entropy, 0) AS n_entropy,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)"""


@query("op3_secret_scan", _op3_sql())
def op3(spark, sf_dir):
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


@query("op4_simhash_near_dedup")
def op4(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op5_language_id")
def op5(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS ws
  FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS ws
  FROM benchmark),
pat AS (
  SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS win
  FROM (SELECT item_id, ws, least(len(ws), 10) AS k, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT k FROM pat),
win AS (
  SELECT doc_id, i, k, array_to_string(ws[i:i + k - 1], ' ') AS win
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, lens WHERE len(ws) >= k)),
occ AS (SELECT doc_id, i, win.k, item_id FROM win JOIN pat USING (win, k)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM occ) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM occ) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""


@query("op8_benchmark_decontamination", OP8_SQL)
def op8(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_token_counts")
def op6(spark, sf_dir):
    return tokens.section_tokens(table(spark, sf_dir, "documents"))


@query("op7_pseudo_likelihood")
def op7(spark, sf_dir):
    return pseudolm.scores(table(spark, sf_dir, "documents"))


@query("op9_document_fingerprints")
def op9(spark, sf_dir):
    return sketches.fingerprints(table(spark, sf_dir, "documents"))


def _op10_sql() -> str:
    words = "|".join(urls.BLOCKED_WORDS)
    fits = "(h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path)"
    given = ", ".join(f"('{e.split('/')[0]}', '{e[e.index('/'):]}', '{v}')" for e, v in urls.RULES.items())
    return f"""
WITH p AS (SELECT row_number() OVER () AS rid, page_id, coalesce(url, '') AS url FROM pages),
h AS (
  SELECT rid, page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (SELECT * FROM (VALUES {given}) v(host, path, verdict)),
f AS (SELECT rid, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY rid ORDER BY length(r.host || r.path) DESC) AS k FROM h JOIN r ON {fits})
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN regexp_matches(host, '(^|[.-])({words})([.:-]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN (SELECT * FROM f WHERE k = 1) USING (rid)"""


@query("op10_url_filter", _op10_sql())
def op10(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"))


@query("op11_embedding_whitening")
def op11(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    model = whitening.fit(vectors)
    return whitening.components_of(whitening.whiten(vectors, model), model)


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, i, ls[i] AS line FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM d)),
k AS (SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
r AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT rid) >= 5),
m AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id IS DISTINCT FROM r.top AS gone FROM k LEFT JOIN r USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid
"""


@query("op12_line_dedup", OP12_SQL)
def op12(spark, sf_dir):
    rows = linededup.dedupe_lines(table(spark, sf_dir, "documents"))
    return rows.select("doc.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
         n_chars, coalesce(strlen(text) || ':' || text, '-') AS z,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
             lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, u: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295::BIGINT) AS crc
  FROM documents),
f AS (
  SELECT rid, doc_id, lang, sha256(a || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || z) AS leaf,
         CASE WHEN crc % 7 = 0 THEN sha256(a || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || z) END AS touched FROM d),
o AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n,
         dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM f),
tree AS (
  SELECT 0 AS lv, g, i, n, leaf AS h FROM o
  UNION ALL
  SELECT lv + 1, g, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY lv, g, i // 2, n),
sub AS (SELECT g, h, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS lv, g AS i, n, h FROM sub
  UNION ALL
  SELECT lv + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY lv, i // 2, n),
walk AS (
  SELECT rid, false AS up, 0 AS lv, g, i, n, coalesce(touched, leaf) AS h, '' AS proof FROM o
  UNION ALL
  SELECT rid, false, w.lv + 1, w.g, w.i // 2, (w.n + 1) // 2,
         sha256(CASE WHEN w.i % 2 = 1 THEN t.h || w.h ELSE w.h || coalesce(t.h, '') END), proof || coalesce(t.h, '')
  FROM walk w LEFT JOIN tree t ON t.lv = w.lv AND t.g = w.g AND t.i = w.i + 1 - 2 * (w.i % 2) WHERE w.n > 1),
climb AS (
  SELECT rid, 0 AS lv, g AS i, (SELECT any_value(n) FROM sub) AS n, h, proof FROM walk WHERE n = 1
  UNION ALL
  SELECT rid, c.lv + 1, c.i // 2, (c.n + 1) // 2, sha256(CASE WHEN c.i % 2 = 1 THEN t.h || c.h ELSE c.h || coalesce(t.h, '') END), proof || coalesce(t.h, '')
  FROM climb c LEFT JOIN top t ON t.lv = c.lv AND t.i = c.i + 1 - 2 * (c.i % 2) WHERE c.n > 1)
SELECT o.doc_id, o.leaf, sub.h AS subroot, r.h AS root, sha256(c.proof) AS proof_sha256, c.h AS folded_root, c.h = r.h AS verified
FROM o JOIN sub USING (g) JOIN climb c ON c.rid = o.rid AND c.n = 1, (SELECT h FROM top WHERE n = 1) r
"""


@query("op13_merkle_manifest", OP13_SQL)
def op13(spark, sf_dir):
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    own = merkle.leaf([F.col(c) for c in columns])
    touched = merkle.leaf([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in columns])
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, touched)
    rows = merkle.manifest(table(spark, sf_dir, "documents"), own, tampered)
    proof = F.sha2(F.col("proof"), 256).alias("proof_sha256")
    return rows.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
