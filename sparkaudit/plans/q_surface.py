"""Registered queries: surface scan, topics, selection, models and playbook severities."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkaudit import catalogs as K
from sparkaudit import catalogs_surface as S
from sparkaudit.operators import classify as C
from sparkaudit.operators import endpoints as E
from sparkaudit.operators import intel as N
from sparkaudit.operators import models as M
from sparkaudit.operators import severity as V
from sparkaudit.operators import surface as W
from sparkaudit.plans import inputs as I
from sparkaudit.plans.q_classify import _SPLIT_SQL
from sparkaudit.plans.q_endpoints import _ID_PARAMS, _MADE
from sparkaudit.plans.q_intel import MANIFEST_SQL, _source, _values
from sparkaudit.plans.q_models import CLEAN_SQL
from sparkaudit.plans.q_rollup import DOMAINS_SQL, _flow_domains
from sparkaudit.plans.registry import register
from sparkaudit.plans.sqlfrag import contains_any, in_list, q

SRC = ("v_src_files", "v_rule_files")
_LAYER = " ".join(f"WHEN contains(lower(path), {q(t)}) THEN {q(x + ':' + c)}" for t, x, c in S.LAYERS)


@register("surface_functions", SRC, f"""
, l AS (SELECT repo, path AS file, CASE {_LAYER} END AS lc, unnest(regexp_split_to_array(content, '\\r\\n|\\n|\\r')) AS l,
          generate_subscripts(regexp_split_to_array(content, '\\r\\n|\\n|\\r'), 1) AS line FROM v_rule_files
        WHERE {_source(S.SURFACE_EXTS, K.SCAN_SKIP_DIRS)}),
n AS (SELECT repo, file, lc, line, regexp_extract(l, {q(K.FUNC_DEF_KEYWORD_RE)}, 1) AS name FROM l
      UNION ALL SELECT repo, file, lc, line, regexp_extract(l, {q(K.FUNC_DEF_TYPED_RE)}, 1) FROM l)
SELECT DISTINCT substring(md5(file || ':' || CAST(line AS STRING) || ':' || name), 1, 10) AS id, repo, name, file, CAST(line AS INTEGER) AS line,
  split_part(lc, ':', 1) AS layer, split_part(lc, ':', 2) AS confidence
FROM n WHERE lc IS NOT NULL AND name <> '' AND lower(name) NOT IN ({', '.join(q(k) for k in K.FUNC_SKIP_KEYWORDS)})
""")
def q_surface_functions(spark, sf):
    """X24, all layers and functions."""
    return W.surface_functions(I.view(spark, sf, "v_rule_files"))


def _words(*skips) -> str:
    return ", ".join(q(w) for s in skips for w in s)


KEYWORDS_SQL = f"""
, sr AS (SELECT repo, content FROM v_rule_files WHERE {_source(S.SURFACE_EXTS, K.SCAN_SKIP_DIRS)}
        AND NOT starts_with(list_reverse(string_split(path, '/'))[1], '.')),
cn AS (SELECT DISTINCT repo, unnest(list_concat(regexp_extract_all(content, {q(S.CLASS_DEF_RE)}, 1), regexp_extract_all(content, {q(S.GO_STRUCT_RE)}, 1))) AS name FROM sr),
-- words of a name: a capital with small letters, or capitals before such a word, a digit or the end
cw AS (SELECT repo, lower(rtrim(unnest(regexp_extract_all(regexp_replace(name, '([A-Z]+)([A-Z][a-z])', '\\1.\\2', 'g'), '[A-Z][a-z0-9]+|[A-Z]+')), '.')) AS keyword FROM cn),
rt AS (SELECT DISTINCT repo, unnest(regexp_extract_all(content, {q(S.ROUTE_STR_RE)}, 1)) AS r FROM sr),
rs AS (SELECT repo, lower(regexp_replace(unnest(string_split(r, '/')), '[^a-zA-Z0-9_]', '', 'g')) AS keyword FROM rt),
kw AS (SELECT DISTINCT repo, keyword FROM (
  SELECT * FROM cw WHERE length(keyword) > 3 AND keyword NOT IN ({_words(S.CLASS_LAYER_SUFFIXES, K.FLOW_TOPIC_SKIP)})
  UNION ALL SELECT * FROM rs WHERE length(keyword) > 3 AND keyword NOT IN ({_words(S.CLASS_LAYER_SUFFIXES, K.FLOW_TOPIC_SKIP, S.ROUTE_VERB_SKIP)})))
"""


@register("domain_keywords", SRC, KEYWORDS_SQL + "SELECT * FROM kw")
def q_domain_keywords(spark, sf):
    """X25 over whole files."""
    return W.domain_keywords(I.view(spark, sf, "v_rule_files"))


@register("flow_topics", (*SRC, "v_sensitive"), KEYWORDS_SQL + f"""
, tp AS (
  SELECT 'repo0' AS repo, lower(regexp_replace(entry, '[^a-zA-Z0-9_]', '', 'g')) AS topic, 0 AS rank FROM v_sensitive
  UNION ALL SELECT repo, lower(regexp_replace(d, '[^a-zA-Z0-9_]', '', 'g')), 2 FROM (
    SELECT repo, unnest(string_split(path, '/')[1:-2]) AS d FROM v_rule_files) WHERE NOT starts_with(d, '.') AND length(d) > 3
  UNION ALL SELECT repo, keyword, 3 FROM kw)
SELECT repo, topic, min(rank) AS rank FROM tp WHERE length(topic) > 2 AND topic NOT IN ({_words(K.FLOW_TOPIC_SKIP)}) GROUP BY repo, topic
""")
def q_flow_topics(spark, sf):
    """Caller topics for one repository, folders and code for all."""
    extra = I.view(spark, sf, "v_sensitive").select(F.lit("repo0").alias("repo"), F.col("entry").alias("topic"))
    return W.flow_topics(I.view(spark, sf, "v_rule_files"), extra)


@register("topic_flows", ("v_edges", "v_nodes"), """
, e AS (SELECT DISTINCT src, dst FROM v_edges WHERE kind = 'CALLS'),
tp AS (SELECT * FROM (VALUES ('guard'), ('exec'), ('supplierrepo')) t(topic)),
p1 AS (SELECT src, dst FROM e), p2 AS (SELECT DISTINCT a.src, b.dst FROM p1 a JOIN e b ON a.dst = b.src),
p3 AS (SELECT DISTINCT a.src, b.dst FROM p2 a JOIN e b ON a.dst = b.src), p4 AS (SELECT DISTINCT a.src, b.dst FROM p3 a JOIN e b ON a.dst = b.src),
p AS (SELECT * FROM p1 UNION SELECT * FROM p2 UNION SELECT * FROM p3 UNION SELECT * FROM p4),
c AS (SELECT DISTINCT topic, f.node_id, f.name AS function, f.file, f.line, t.name AS called
      FROM p JOIN v_nodes f ON f.node_id = p.src JOIN v_nodes t ON t.node_id = p.dst, tp
      WHERE contains(lower(f.name), topic) OR contains(lower(t.name), topic))
SELECT topic, upper(substring(topic, 1, 1)) || substring(topic, 2) || 'Flow' AS flow, function, file, line,
  array_to_string(list_sort(list(called))[1:8], ',') AS related FROM c GROUP BY topic, node_id, function, file, line
""")
def q_topic_flows(spark, sf):
    """G6 for three topics over the whole call graph."""
    topics = spark.range(1).select(F.explode(F.array(F.lit("guard"), F.lit("exec"), F.lit("supplierrepo"))).alias("topic"))
    out = W.topic_flows(I.view(spark, sf, "v_nodes"), I.view(spark, sf, "v_edges"), topics)
    return out.withColumn("related", F.array_join("related", ","))


_SINK_NAMES = f"(SELECT DISTINCT file, code AS name, severity FROM ({_SPLIT_SQL}) WHERE kind = 'sink')"


def _scan_sinks(spark, sf):
    return C.split_sources_sinks(I.view(spark, sf, "v_scan")).where(F.col("kind") == "sink")


@register("label_cross_catalog", ("v_src_files", "v_scan", "v_sinks"), f"""
, {_MADE.strip()}
SELECT list, source, name, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT 'api_entry_points' AS list, 'api_parse' AS source, path AS name FROM me
  UNION ALL SELECT 'semgrep_sink_names', 'semgrep', code FROM ({_SPLIT_SQL}) WHERE kind = 'sink'
  UNION ALL SELECT 'ctx_custom_sinks', 'context', sink_name FROM v_sinks) GROUP BY list, source, name
""")
def q_label_cross_catalog(spark, sf):
    """J8, counted per name."""
    eps = E.endpoint_inventory(I.view(spark, sf, "v_src_files")).select(F.col("path").alias("name"))
    out = W.label_cross_catalog(api_entry_points=eps, semgrep_sink_names=_scan_sinks(spark, sf).select(F.col("code").alias("name")),
                                ctx_custom_sinks=I.view(spark, sf, "v_sinks").select(F.col("sink_name").alias("name")))
    return out.groupBy("list", "source", "name").agg(F.count(F.lit(1)).alias("n"))


@register("trace_guide", ("v_sinks",), """
SELECT file, string_agg(DISTINCT sink_name, ',' ORDER BY sink_name) AS sinks,
  'read file, find callers of each sink, trace taint path to entry point' AS action
FROM v_sinks WHERE confidence IN ('HIGH', 'MEDIUM') AND file <> '' AND sink_name <> '' GROUP BY file
""")
def q_trace_guide(spark, sf):
    """J10 where no entry points were found."""
    sinks = I.view(spark, sf, "v_sinks").withColumnRenamed("sink_name", "name")
    return W.trace_guide(sinks, sinks.where("false")).withColumn("sinks", F.array_join("sinks", ","))


@register("traversal_targets", ("v_src_files", "v_scan", "v_fn_params", "v_sinks"), DOMAINS_SQL + """
, ne AS (SELECT least(count(DISTINCT handler), 30) AS n FROM me WHERE handler <> ''),
ns AS (SELECT least(count(DISTINCT sink_name), 30) AS n FROM v_sinks),
nc AS (SELECT least(count(DISTINCT sink_name), 20) AS n FROM v_sinks WHERE confidence = 'HIGH')
SELECT 'cross_catalog' AS label, 'HIGH' AS priority, CAST((SELECT n FROM ne) AS STRING) || ' entries + ' || CAST((SELECT n FROM ns) AS STRING)
  || ' sinks from 4 sources' AS reason WHERE (SELECT n FROM ne) > 0 OR (SELECT n FROM ns) > 0
UNION ALL SELECT 'custom_sinks', 'HIGH', CAST((SELECT n FROM nc) AS STRING) || ' custom sinks (context + gitnexus discovery)' WHERE (SELECT n FROM nc) > 0
UNION ALL SELECT 'auth_symbols', 'MEDIUM', 'Auth/JWT/guard/middleware symbol discovery'
UNION ALL SELECT 'tenant_scope', 'HIGH', 'Multi-tenant detected — check missing tenant_id/company_id scoping'
  WHERE (SELECT bool_or(contains(lower(text), 'tenant')) FROM conversations)
UNION ALL SELECT * FROM (SELECT 'domain_' || domain, CASE WHEN len(risk) > 0 THEN 'HIGH' ELSE 'MEDIUM' END,
  'Domain ''' || domain || ''' flow — risk_signals: ' || array_to_string(risk, ',') FROM d WHERE len(sink_hints) > 0 AND domain <> ''
  ORDER BY len(risk) DESC, len(sink_hints) DESC, endpoint_count DESC, domain LIMIT 5)
""")
def q_traversal_targets(spark, sf):
    """The plan of traversals (its limits are the plan's size)."""
    domains = _flow_domains(spark, sf)
    entries = E.endpoint_inventory(I.view(spark, sf, "v_src_files")).where("handler <> ''").select(F.col("handler").alias("name"))
    sinks = I.view(spark, sf, "v_sinks").withColumnRenamed("sink_name", "name")
    I.register_tables(spark, sf, ["conversations"])
    notes = spark.table("conversations").select(F.col("text").alias("note"))
    return W.traversal_targets(entries, sinks, sinks.where("confidence = 'HIGH'"), domains, notes)


# --- models and severities -------------------------------------------------------------
@register("model_classes", ("v_model_nodes", "v_model_parts"), f"""
, n AS (SELECT * FROM v_model_nodes)
SELECT m.name AS model_name, m.file, string_agg(DISTINCT f.name, ',' ORDER BY f.name) AS fields
FROM n m JOIN v_model_parts p ON p.parent = m.node_id JOIN n f ON f.node_id = p.child
WHERE {in_list('m.type', S.MODEL_TYPES)} AND {in_list('f.type', S.FIELD_TYPES)}
  AND ({contains_any('lower(m.name)', S.MODEL_NAME_WORDS)} OR {contains_any('lower(m.file)', S.MODEL_FILE_WORDS)})
GROUP BY m.name, m.file
""")
def q_model_classes(spark, sf):
    """F17 over class nodes with their parts."""
    out = V.model_classes(I.view(spark, sf, "v_model_nodes"), I.view(spark, sf, "v_model_parts"))
    return out.withColumn("fields", F.array_join("fields", ","))


_MODELS = CLEAN_SQL + f"""
, md AS (SELECT model_name, list(DISTINCT f) AS fields, count(DISTINCT f) FILTER (WHERE regexp_matches(f, {q(K.SENSITIVE_FIELD_RE)})) AS n_sens,
          count(DISTINCT f) FILTER (WHERE regexp_matches(f, {q(K.MASS_ASSIGN_RE)})) AS n_risk,
          coalesce(bool_or(regexp_matches(f, {q(S.FINANCIAL_RE)})), false) AS fin, coalesce(bool_or(regexp_matches(f, {q(S.PRIVILEGE_RE)})), false) AS priv
        FROM c2 WHERE f IS NOT NULL AND NOT (model_name IN (SELECT 'Model' || CAST(p_partkey AS STRING) FROM part WHERE p_partkey % 4 = 3) AND f = 'password')
        GROUP BY model_name)
"""


def _models(spark, sf):
    decls = I.view(spark, sf, "v_model_fields")
    clean = M.clean_field_name(F.col("raw"))
    hidden = F.pmod(F.regexp_extract("model_name", "(\\d+)$", 1).cast("long"), F.lit(4)) == 3
    return M.tag_model_fields(decls.where(~(hidden & (clean == "password"))))


@register("idor_severity", ("v_src_files", "v_model_fields"), f"""
, {_MADE.strip()}
{_MODELS}
SELECT me.id, me.repo, 'Model' || CAST(line + length(path) AS STRING) AS model_name,
  CASE WHEN n_sens > 0 THEN 'CRITICAL' WHEN fin THEN 'HIGH' ELSE 'MEDIUM' END AS severity
FROM me LEFT JOIN md ON md.model_name = 'Model' || CAST(line + length(path) AS STRING)
WHERE len({_ID_PARAMS}) > 0 AND NOT ({' OR '.join(f"contains(auth_tags, {q(m)})" for m in K.OWNERSHIP_MARKERS)})
""".replace("\n\n,", "\n,"))
def q_idor_severity(spark, sf):
    """Candidates joined with the data model that they load."""
    eps = E.idor_candidates(E.endpoint_inventory(I.view(spark, sf, "v_src_files")))
    loaded = eps.withColumn("model_name", F.concat(F.lit("Model"), (F.col("line") + F.length("path")).cast("string")))
    return V.idor_severity(loaded, _models(spark, sf)).select("id", "repo", "model_name", "severity")


@register("mass_assign_severity", ("v_sinks", "v_model_fields"), _MODELS.replace(", c0 AS", ", c0 AS", 1) + """
SELECT ord, sink_name, 'Model' || CAST(ord AS STRING) AS model_name,
  CASE WHEN priv THEN 'CRITICAL' WHEN fin THEN 'HIGH' WHEN n_risk > 0 THEN 'MEDIUM' ELSE 'LOW' END AS severity
FROM v_sinks LEFT JOIN md ON md.model_name = 'Model' || CAST(ord AS STRING) WHERE contains(sink_name, 'fill')
""")
def q_mass_assign_severity(spark, sf):
    """C10."""
    sinks = I.view(spark, sf, "v_sinks").where(F.col("sink_name").contains("fill")).select(
        "ord", "sink_name", F.concat(F.lit("Model"), F.col("ord").cast("string")).alias("model_name"))
    return V.mass_assign_severity(sinks, _models(spark, sf)).select("ord", "sink_name", "model_name", "severity")


_SCENARIOS = [s for _, s, _ in S.CONFIDENCE]


@register("confidence_calibration", ("v_scan",), f"""
, f AS (SELECT ord, CASE WHEN ord % 61 = 60 THEN 'unknown case' ELSE ([{', '.join(q(s) for s in _SCENARIOS)}])[1 + CAST(ord % {len(_SCENARIOS)} AS INTEGER)] END AS scenario FROM v_scan)
SELECT ord, f.scenario, playbook, confidence FROM f LEFT JOIN (VALUES {_values(S.CONFIDENCE)}) c(playbook, scenario, confidence) ON c.scenario = f.scenario
""")
def q_confidence_calibration(spark, sf):
    """C11: every finding with a scenario."""
    name = F.element_at(F.array(*[F.lit(s) for s in _SCENARIOS]), (F.col("ord") % len(_SCENARIOS) + 1).cast("int"))
    found = I.view(spark, sf, "v_scan").select("ord", F.when(F.col("ord") % 61 == 60, "unknown case").otherwise(name).alias("scenario"))
    return V.confidence_calibration(found)


_GROUP = "CASE " + " ".join(f"WHEN {contains_any('lower(path)', p)} THEN {q(g)}" for g, p in S.RATE_LIMIT_PATHS.items()) + " END"


@register("missing_rate_limit", ("v_src_files", "v_repo_files"), MANIFEST_SQL + f"""
, {_MADE.strip()}
SELECT id, repo, path, {_GROUP} AS risk_group, CASE WHEN repo IN (SELECT repo FROM dep WHERE {contains_any('lower(dependency)', S.RATE_LIMIT_LIBS)})
  THEN 'MEDIUM' ELSE 'HIGH' END AS confidence
FROM me WHERE {_GROUP} IS NOT NULL AND NOT {contains_any('lower(auth_tags)', S.RATE_LIMIT_TAGS)}
""")
def q_missing_rate_limit(spark, sf):
    """F11."""
    eps = E.endpoint_inventory(I.view(spark, sf, "v_src_files"))
    return V.missing_rate_limit(eps, N.dependencies(I.view(spark, sf, "v_repo_files"))).select("id", "repo", "path", "risk_group", "confidence")


@register("manual_review_flag", (), "SELECT conv_id, turn, CASE " + " ".join(
    f"WHEN regexp_matches(coalesce(text, ''), {q(p)}) THEN {q(r)}" for r, p in S.MANUAL_REVIEW.items()) + " END AS reason FROM conversations")
def q_manual_review_flag(spark, sf):
    """F14 over whole texts."""
    I.register_tables(spark, sf, ["conversations"])
    return spark.table("conversations").select("conv_id", "turn", V.manual_review(F.col("text")).alias("reason"))


@register("fast_path_union", ("v_src_files", "v_sinks", "v_scan"), f"""
, {_MADE.strip()}
SELECT origin, name, file, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT 'idor' AS origin, path AS name, file FROM me WHERE len({_ID_PARAMS}) > 0
    AND NOT ({' OR '.join(f"contains(auth_tags, {q(m)})" for m in K.OWNERSHIP_MARKERS)})
  UNION ALL SELECT 'mass_assign', sink_name, file FROM v_sinks WHERE contains(sink_name, 'fill')
  UNION ALL SELECT 'scan', code, file FROM ({_SPLIT_SQL}) WHERE kind = 'sink') GROUP BY origin, name, file
""")
def q_fast_path_union(spark, sf):
    """U9, counted per name and file."""
    idor = E.idor_candidates(E.endpoint_inventory(I.view(spark, sf, "v_src_files"))).withColumnRenamed("path", "name")
    fill = I.view(spark, sf, "v_sinks").where(F.col("sink_name").contains("fill")).withColumnRenamed("sink_name", "name")
    out = W.fast_path_union(idor=idor, mass_assign=fill, scan=_scan_sinks(spark, sf).withColumnRenamed("code", "name").drop("id"))
    return out.groupBy("origin", "name", "file").agg(F.count(F.lit(1)).alias("n"))
