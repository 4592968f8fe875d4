"""Registered queries: ingest of scanner and graph output, packaged rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkaudit import catalogs as K0
from sparkaudit import catalogs_rules as K
from sparkaudit.operators import rules as U
from sparkaudit.operators import secrets as S0
from sparkaudit.plans import inputs as I
from sparkaudit.plans.q_intel import _values
from sparkaudit.plans.registry import register
from sparkaudit.plans.sqlfrag import q

_RULE_FILES = ("v_src_files", "v_rule_files")


@register("ingest_scan_results", ("v_scan", "v_scan_docs"), """
, ok AS (SELECT doc_id, CASE WHEN json_valid(raw) THEN raw ELSE '{}' END AS raw FROM v_scan_docs),
r AS (SELECT doc_id, unnest(generate_series(0, CAST(coalesce(json_array_length(raw, '$.results'), 0) AS BIGINT) - 1)) AS pos, raw FROM ok),
e AS (SELECT doc_id, pos, json_extract(raw, '$.results[' || CAST(pos AS STRING) || ']') AS j FROM r)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, coalesce(json_extract_string(j, '$.check_id'), '') AS check_id,
  coalesce(json_extract_string(j, '$.path'), '') AS path, coalesce(CAST(json_extract(j, '$.start.line') AS INTEGER), 0) AS line,
  trim(coalesce(json_extract_string(j, '$.extra.lines'), '')) AS code, coalesce(json_extract_string(j, '$.extra.message'), '') AS message,
  upper(coalesce(json_extract_string(j, '$.extra.severity'), 'WARNING')) AS severity FROM e
""")
def q_ingest_scan_results(spark, sf):
    """S3: nested scanner documents, some cut off or without results."""
    return U.ingest_scan_results(I.view(spark, sf, "v_scan_docs"), keep=("doc_id",))


@register("ingest_graph_rows", ("v_graph_docs",), """
, a AS (SELECT doc_id, raw, json_valid(raw) AS ok FROM v_graph_docs),
l AS (
  SELECT doc_id, CAST(i AS INTEGER) AS pos, json_extract(raw, '$[' || CAST(i AS STRING) || ']') AS j FROM (
    SELECT *, unnest(generate_series(0, CAST(json_array_length(CASE WHEN ok THEN raw ELSE '[]' END) AS BIGINT) - 1)) AS i FROM a
    WHERE starts_with(raw, '['))
  UNION ALL SELECT doc_id, CAST(i AS INTEGER), json_extract(raw, '$.rows[' || CAST(i AS STRING) || ']') FROM (
    SELECT *, unnest(generate_series(0, CAST(json_array_length(CASE WHEN ok THEN raw ELSE '{"rows": []}' END, '$.rows') AS BIGINT) - 1)) AS i FROM a
    WHERE starts_with(raw, '{"rows"'))
  UNION ALL SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER), x::JSON FROM (
    SELECT doc_id, trim(unnest(s)) AS x, unnest(generate_series(1, len(s))) AS i
    FROM (SELECT doc_id, string_split(raw, chr(10)) AS s FROM a WHERE NOT ok)) WHERE x <> '' AND json_valid(x))
SELECT doc_id, pos, json_extract_string(j, '$.name') AS name, json_extract_string(j, '$.file') AS file,
  CAST(json_extract(j, '$.line') AS INTEGER) AS line FROM l
""")
def q_ingest_graph_rows(spark, sf):
    """Arrays, wrapped rows, and JSON lines with bad ones."""
    return U.ingest_graph_rows(I.view(spark, sf, "v_graph_docs"), "name string, file string, line int", keep=("doc_id",))


_WEAK = K0.WEAK_CRYPTO
_NEAR = f"regexp_matches(ctx, {q(K0.WEAK_CONTEXT_RE)})"


@register("weak_crypto_scan", _RULE_FILES, f"""
, f AS (SELECT path AS file, regexp_split_to_array(content, '\\r\\n|\\n|\\r') AS ls FROM v_rule_files),
l AS (SELECT file, i AS line, ls[i] AS l, array_to_string(ls[greatest(i - 2, 1):i + 2], chr(10)) AS ctx
      FROM (SELECT file, ls, unnest(generate_series(1, len(ls))) AS i FROM f))
SELECT file, CAST(line AS INTEGER) AS line, t AS type, trim(l) AS code FROM l
JOIN (VALUES {_values(_WEAK)}) w(t, p) ON regexp_matches(l, p) AND (t NOT IN ('weak_hash', 'insecure_random') OR {_NEAR})
""")
def q_weak_crypto_scan(spark, sf):
    """X44 over whole files."""
    files = I.view(spark, sf, "v_rule_files").select(F.col("path").alias("file"), F.col("content").alias("text"))
    return S0.weak_crypto_scan(files)


_R = [(r[0], r[2], r[4], r[5], next(iter(K.RULE_EXTS[r[3]])), U.either(r[6]) if r[6] else "", U.either(r[7])) for r in K.RULES]


@register("rule_scan", _RULE_FILES, f"""
, l AS (SELECT repo, path AS file, content, unnest(regexp_split_to_array(content, '\\r\\n|\\n|\\r')) AS code,
          unnest(generate_series(1, len(regexp_split_to_array(content, '\\r\\n|\\n|\\r')))) AS line FROM v_rule_files)
SELECT repo, file, CAST(line AS INTEGER) AS line, rule_id, severity, cwe, owasp, trim(code) AS code FROM l
JOIN (VALUES {_values(_R)}) r(rule_id, severity, cwe, owasp, ext, src, snk)
  ON ends_with(lower(file), ext) AND regexp_matches(trim(code), snk) AND (src = '' OR regexp_matches(content, src))
""")
def q_rule_scan(spark, sf):
    """13 packaged rules over whole files."""
    return U.rule_scan(I.view(spark, sf, "v_rule_files")).select(
        "repo", "file", "line", "rule_id", "severity", "cwe", "owasp", "code")


@register("extra_source_hits", _RULE_FILES, f"""
, l AS (SELECT repo, path AS file, unnest(regexp_split_to_array(content, '\\r\\n|\\n|\\r')) AS text,
          unnest(generate_series(1, len(regexp_split_to_array(content, '\\r\\n|\\n|\\r')))) AS line FROM v_rule_files
        WHERE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) IN ({', '.join(q(e) for e in K.EXTRA_EXTS)})),
s AS (SELECT DISTINCT source, replace(replace(source, '::', '.*'), '...', '.*') AS pattern FROM (
        SELECT CASE p_partkey % 4 WHEN 0 THEN 'Queue::take' || CAST(p_partkey % 50 AS STRING) WHEN 1 THEN 'read...item'
          || CAST(p_partkey % 20 AS STRING) || '$' WHEN 2 THEN 'handler_' || CAST(p_partkey AS STRING) ELSE 'yaml' END AS source FROM part))
SELECT source, repo, file, CAST(line AS INTEGER) AS line FROM l JOIN s ON regexp_matches(text, pattern)
""")
def q_extra_source_hits(spark, sf):
    """Caller patterns (one per part) over the rule files."""
    I.register_tables(spark, sf, ["part"])
    sources = spark.sql("""SELECT CASE p_partkey % 4 WHEN 0 THEN concat('Queue::take', p_partkey % 50)
        WHEN 1 THEN concat('read...item', p_partkey % 20, '$') WHEN 2 THEN concat('handler_', p_partkey) ELSE 'yaml' END AS source
        FROM part""")
    return U.extra_source_hits(I.view(spark, sf, "v_rule_files"), sources).select(
        "source", "repo", "file", F.col("line").cast("int").alias("line"))
