"""Registered queries: sink / rule / source classification, merges, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkaudit import catalogs as K
from sparkaudit.operators import classify as C
from sparkaudit.plans import inputs as I
from sparkaudit.plans.registry import register
from sparkaudit.plans.sqlfrag import contains_any, first_contained, map_case, q


def group_case(expr: str, groups, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {contains_any(expr, kws)} THEN {q(label)}" for label, kws in groups)
    return f"(CASE {whens} ELSE {default} END)"


_CAT = first_contained("lower(n.sink_name)", [k.lower() for k, _ in K.KNOWN_SINKS],
                       [v for _, v in K.KNOWN_SINKS])

_CLASSIFY_SQL = f"""
, names AS (SELECT DISTINCT sink_name FROM (
     SELECT sink_name FROM v_paths UNION ALL SELECT sink_name FROM v_sinks) t
   WHERE sink_name IS NOT NULL),
c AS (SELECT n.sink_name,
   (SELECT x.vuln_type FROM v_ctx_sinks x
     WHERE x.name <> '' AND contains(lower(n.sink_name), lower(x.name))
       AND upper(coalesce(x.confidence, '')) = 'HIGH' AND x.vuln_type <> ''
     ORDER BY x.ord LIMIT 1) AS ctx_vt,
   {_CAT} AS cat_vt
  FROM names n)
SELECT sink_name, coalesce(ctx_vt, cat_vt, 'unknown') AS vuln_type,
  CASE WHEN ctx_vt IS NOT NULL THEN 'HIGH' WHEN cat_vt IS NOT NULL THEN 'MEDIUM' ELSE 'UNKNOWN' END AS confidence,
  CASE WHEN ctx_vt IS NOT NULL THEN 'business_context' WHEN cat_vt IS NOT NULL THEN 'lookup_table'
       ELSE 'not_found' END AS source
FROM c
"""


@register("classify_sink", ("v_paths", "v_sinks", "v_ctx_sinks"), _CLASSIFY_SQL)
def q_classify_sink(spark, sf):
    """Context sinks (HIGH) over the 133-entry catalogue, distinct names."""
    names = (I.view(spark, sf, "v_paths").select("sink_name")
             .unionByName(I.view(spark, sf, "v_sinks").select("sink_name")))
    return C.classify_sink(names, "sink_name", I.view(spark, sf, "v_ctx_sinks"))


_RL = "lower(coalesce(check_id, ''))"
_IS_SRC = contains_any(_RL, K.SOURCE_RULE_KEYWORDS)
_ST = ("(CASE " + " ".join("WHEN regexp_matches(" + _RL + ", " + q("(?:^|[^a-z0-9])(?:" + "|".join(
    p.replace(".", "[.]") for p in ps) + ")") + f") THEN {q(label)}" for label, ps in K.SINK_RULE_PREFIXES) + " ELSE NULL END)")
_SRC_TYPE = group_case("lower(coalesce(code, ''))", K.SOURCE_TYPE_KEYWORDS, "'http_param'")

_SPLIT_SQL = f"""
SELECT substring(md5(coalesce(check_id, '') || ':' || coalesce(path, '') || ':' || coalesce(CAST(line AS STRING), '0')), 1, 12) AS id,
  check_id AS pattern, path AS file, line, trim(code) AS code,
  CASE WHEN {_IS_SRC} THEN 'source' ELSE 'sink' END AS kind,
  CASE WHEN {_IS_SRC} THEN {_SRC_TYPE} ELSE coalesce({_ST}, 'semgrep_review') END AS type,
  CASE WHEN {_IS_SRC} THEN NULL
       WHEN {_ST} IS NOT NULL THEN {map_case(_ST, K.RULE_SINK_SEVERITY, "'MEDIUM'")}
       ELSE upper(coalesce(severity, 'WARNING')) END AS severity
FROM v_scan
"""


@register("split_sources_sinks", ("v_scan",), _SPLIT_SQL)
def q_split_sources_sinks(spark, sf):
    """C2 + C3 + C4 + U7 over flat scanner results."""
    return C.split_sources_sinks(I.view(spark, sf, "v_scan")).select(
        "id", "pattern", "file", "line", "code", "kind", "type", "severity")


@register("scan_counts", ("v_scan",), f"""
, s AS ({_SPLIT_SQL})
SELECT CAST(count(*) FILTER (WHERE kind = 'source') AS BIGINT) AS source_count,
       CAST(count(*) FILTER (WHERE kind = 'sink') AS BIGINT) AS sink_count,
       CAST(count(*) FILTER (WHERE type = 'semgrep_review') AS BIGINT) AS review_count
FROM s
""")
def q_scan_counts(spark, sf):
    """C3 counts."""
    return C.scan_counts(C.split_sources_sinks(I.view(spark, sf, "v_scan")))


@register("rule_to_sink_type", ("v_scan",), f"""
SELECT check_id, coalesce({_ST}, 'semgrep_review') AS sink_type,
  coalesce({map_case(_ST, K.RULE_SINK_SEVERITY, "NULL")}, 'MEDIUM') AS severity,
  CAST(count(*) AS BIGINT) AS n
FROM v_scan GROUP BY check_id
""")
def q_rule_to_sink_type(spark, sf):
    """C2 per distinct rule id (aggregate first, classify the distinct keys)."""
    rules = I.view(spark, sf, "v_scan").groupBy("check_id").agg(F.count(F.lit(1)).alias("n"))
    st = C.rule_sink_type(F.lower(F.coalesce("check_id", F.lit(""))))
    from sparkaudit.functions.core import map_lookup
    return rules.select("check_id", F.coalesce(st, F.lit("semgrep_review")).alias("sink_type"),
                        F.coalesce(map_lookup(st, K.RULE_SINK_SEVERITY), F.lit("MEDIUM")).alias("severity"),
                        "n")


@register("source_type", ("v_scan",), f"""
SELECT ord, {_SRC_TYPE} AS source_type FROM v_scan
""")
def q_source_type(spark, sf):
    """C4."""
    return I.view(spark, sf, "v_scan").select("ord", C.source_type(F.col("code")).alias("source_type"))


@register("vuln_from_known_sink", ("v_sinks",), f"""
SELECT ord, sink_name, {group_case("lower(coalesce(sink_name, ''))", [(x, [k.lower() for k in ks]) for x, ks in K.KNOWN_SINK_VULN_GROUPS], "'unknown'")} AS vuln_type
FROM v_sinks
""")
def q_vuln_from_known_sink(spark, sf):
    """C5."""
    return I.view(spark, sf, "v_sinks").select(
        "ord", "sink_name", C.vuln_from_known_sink(F.col("sink_name")).alias("vuln_type"))


@register("vuln_from_text", (), f"""
SELECT doc_id, {group_case("lower(coalesce(text, ''))", K.TEXT_VULN_GROUPS, "''")} AS vuln_type
FROM documents
""")
def q_vuln_from_text(spark, sf):
    """C6 over whole document texts."""
    I.register_tables(spark, sf, ["documents"])
    return spark.table("documents").select("doc_id", C.vuln_from_text(F.col("text")).alias("vuln_type"))


_CATEGORY = ("coalesce(CASE WHEN sink_cat <> '' THEN sink_cat END, "
             + map_case("coalesce(sink_type, '')", K.SINK_TYPE_TO_CAT) + ", 'CUSTOM')")


@register("sink_category_severity", ("v_paths",), f"""
SELECT sink_category, CAST(severity AS INTEGER) AS severity, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT {_CATEGORY} AS sink_category, {map_case(_CATEGORY, K.SINK_SEVERITY, '1')} AS severity
  FROM v_paths) t
GROUP BY 1, 2
""")
def q_sink_category_severity(spark, sf):
    """C7 per path, rolled up by category."""
    p = I.view(spark, sf, "v_paths")
    cat = C.sink_category(F.col("sink_cat"), F.col("sink_type"))
    return (p.select(cat.alias("sink_category"), C.category_severity(cat).cast("int").alias("severity"))
            .groupBy("sink_category", "severity").agg(F.count(F.lit(1)).alias("n")))


@register("merge_sink_discoveries", ("v_sinks",), f"""
, d AS (
  SELECT ord, CASE ord % 4 WHEN 0 THEN lower(sink_name) WHEN 1 THEN upper(sink_name) ELSE sink_name END AS name,
         file, confidence, pass AS detected_by
  FROM v_sinks
  UNION ALL
  SELECT ord + 1000000000 AS ord, sink_name AS name, file,
         CASE ord % 5 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'LOW' ELSE 'MEDIUM' END AS confidence,
         'fan_in' AS detected_by
  FROM v_sinks),
r AS (SELECT *, lower(name) || '::' || file AS key,
        {map_case("coalesce(confidence, 'LOW')", K.CONFIDENCE_RANK, '1')} AS rk FROM d),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rk DESC, ord ASC) AS rn FROM r) t
      WHERE rn = 1),
u AS (SELECT key, string_agg(DISTINCT detected_by, ',' ORDER BY detected_by) AS detected_by FROM r GROUP BY key)
SELECT w.key, w.ord, w.name, w.file, w.confidence, u.detected_by
FROM w JOIN u ON w.key = u.key
""")
def q_merge_sink_discoveries(spark, sf):
    """A8 over two discovery passes built from the sink table."""
    s = I.view(spark, sf, "v_sinks")
    a = s.select("ord", F.expr("CASE ord % 4 WHEN 0 THEN lower(sink_name) WHEN 1 THEN upper(sink_name) "
                               "ELSE sink_name END").alias("name"), "file", "confidence",
                 F.array(F.col("pass")).alias("detected_by"))
    b = s.select((F.col("ord") + 1000000000).alias("ord"), F.col("sink_name").alias("name"), "file",
                 F.expr("CASE ord % 5 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'LOW' ELSE 'MEDIUM' END").alias("confidence"),
                 F.array(F.lit("fan_in")).alias("detected_by"))
    m = C.merge_sink_discoveries(a.unionByName(b))
    return m.select("key", "ord", "name", "file", "confidence",
                    F.array_join(F.array_sort("detected_by"), ",").alias("detected_by"))


@register("severity_counts", ("v_scan",), f"""
, s AS ({_SPLIT_SQL}),
f AS (SELECT upper(coalesce(severity, 'MEDIUM')) AS sev FROM s WHERE kind = 'sink')
SELECT CAST(count(*) AS BIGINT) AS total,
  {', '.join(f"CAST(count(*) FILTER (WHERE sev = {q(x)}) AS BIGINT) AS {x.lower()}" for x in K.SEVERITY_ORDER)}
FROM f
""")
def q_severity_counts(spark, sf):
    """A7 over the scanner sinks."""
    s = C.split_sources_sinks(I.view(spark, sf, "v_scan")).where(F.col("kind") == "sink")
    return C.severity_counts(s)


@register("findings_by_severity", ("v_scan",), f"""
, s AS ({_SPLIT_SQL})
SELECT id, severity,
  {map_case('upper(severity)', {x: i for i, x in enumerate(K.SEVERITY_ORDER)}, str(len(K.SEVERITY_ORDER)))} AS severity_rank,
  {map_case("upper(severity)", {"CRITICAL": "CRITICAL", "HIGH": "CRITICAL", "MEDIUM": "HIGH", "LOW": "MEDIUM", "INFO": "LOW"}, "severity")} AS raised_severity,
  CASE WHEN line % 3 = 0 THEN {map_case("upper(severity)", {"CRITICAL": "HIGH", "HIGH": "MEDIUM", "MEDIUM": "LOW", "LOW": "INFO", "INFO": "INFO"}, "severity")}
       ELSE severity END AS lowered_severity
FROM s WHERE kind = 'sink'
""")
def q_findings_by_severity(spark, sf):
    """W7 review order, plus C12 raise for high business impact."""
    s = C.split_sources_sinks(I.view(spark, sf, "v_scan")).where(F.col("kind") == "sink")
    return C.findings_by_severity(s).select(
        "id", "severity", F.col("severity_rank").cast("int").alias("severity_rank"),
        C.business_severity(F.col("severity"), F.lit("high")).alias("raised_severity"),
        C.business_severity(F.col("severity"), F.when(F.col("line") % 3 == 0, "low").otherwise("medium")).alias("lowered_severity"))
