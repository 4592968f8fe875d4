"""Registered queries: registries, prioritisation, flow domains, helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkaudit import catalogs as K
from sparkaudit.operators import classify as C
from sparkaudit.operators import endpoints as E
from sparkaudit.operators import rollup as R
from sparkaudit.plans import inputs as I
from sparkaudit.plans.q_classify import _SPLIT_SQL as SPLIT_SQL
from sparkaudit.plans.q_endpoints import _MADE as MADE_SQL
from sparkaudit.plans.registry import register
from sparkaudit.plans.sqlfrag import q

_PRIO = (f"CASE WHEN score >= {K.PRIORITY_HIGH} THEN 'HIGH' WHEN score >= {K.PRIORITY_MEDIUM} THEN 'MEDIUM' "
         "ELSE 'LOW' END")

REGISTRY_SQL = f"""
, r AS (SELECT * FROM v_registry_input WHERE length(name) >= 2),
f AS (SELECT name, source, arg_min(score, ord) AS score, min(ord) AS ord FROM r GROUP BY name, source),
s AS (SELECT name, CAST(sum(score) AS BIGINT) AS score, string_agg(source, ',' ORDER BY ord) AS sources,
             min(ord) AS ord FROM f GROUP BY name),
v AS (SELECT name, string_agg(vuln_type, ',' ORDER BY o) AS vuln_types FROM (
        SELECT name, vuln_type, min(ord) AS o FROM r WHERE vuln_type <> '' GROUP BY name, vuln_type) t
      GROUP BY name),
reg AS (SELECT s.name, s.score, {_PRIO} AS priority, s.sources, coalesce(v.vuln_types, '') AS vuln_types, s.ord
        FROM s LEFT JOIN v ON v.name = s.name)
"""


def _registry(spark, sf):
    return R.prioritize(R.name_registry(I.view(spark, sf, "v_registry_input")))


@register("name_registry", ("v_registry_input",), REGISTRY_SQL + "SELECT * FROM reg")
def q_name_registry(spark, sf):
    """A1 + A2: scored registry with priority bands."""
    return _registry(spark, sf).select(
        "name", "score", "priority", F.array_join("sources", ",").alias("sources"),
        F.array_join("vuln_types", ",").alias("vuln_types"), "ord")


@register("registry_priority_counts", ("v_registry_input",), REGISTRY_SQL + """
SELECT priority, CAST(count(*) AS BIGINT) AS n, CAST(max(score) AS BIGINT) AS max_score FROM reg GROUP BY priority
""")
def q_registry_priority_counts(spark, sf):
    """A2 bands rolled up."""
    return _registry(spark, sf).groupBy("priority").agg(F.count(F.lit(1)).alias("n"),
                                                        F.max("score").cast("long").alias("max_score"))


@register("ordered_distinct_union", ("v_registry_input",), f"""
SELECT name, min(list_ord * 100000000 + ord) AS first_pos FROM (
  SELECT name, CASE source WHEN 'context' THEN 0 WHEN 'semgrep' THEN 1 WHEN 'api_parse' THEN 2 ELSE 3 END AS list_ord, ord
  FROM v_registry_input) t
WHERE name IS NOT NULL AND name <> ''
GROUP BY name
""")
def q_ordered_distinct_union(spark, sf):
    """U1 over four catalog lists (context, semgrep, api, surface)."""
    v = I.view(spark, sf, "v_registry_input")
    items = v.select("name", F.expr("CASE source WHEN 'context' THEN 0 WHEN 'semgrep' THEN 1 "
                                    "WHEN 'api_parse' THEN 2 ELSE 3 END").alias("list_ord"),
                     F.col("ord").alias("pos"))
    u = R.ordered_distinct_union(items)
    return u.select("name", (F.col("list_ord") * 100000000 + F.col("pos")).alias("first_pos"))


_SEGS = "string_split(regexp_replace(coalesce(path, ''), '^/+|/+$', '', 'g'), '/')"
_DOMAIN = (f"coalesce(lower(list_filter({_SEGS}, lambda s: s <> '' AND NOT starts_with(s, '{{') AND lower(s) NOT IN ("
           + ", ".join(q(s) for s in K.SKIP_PATH_SEGMENTS) + "))[1]), 'unknown')")
_TAIL = ("list_filter(string_split(coalesce(path, ''), '/'), lambda s: s <> '' AND NOT starts_with(s, '{') AND s NOT IN ("
         + ", ".join(q(s) for s in K.API_TAIL_SKIP) + "))[-1]")


@register("domain_from_path", ("v_url_paths",), f"""
SELECT page_id, path, {_DOMAIN} AS domain, {_TAIL} AS api_tail FROM v_url_paths
""")
def q_domain_from_path(spark, sf):
    """W4 + W5 over crawled URL paths."""
    v = I.view(spark, sf, "v_url_paths")
    return v.select("page_id", "path", R.domain_from_path(F.col("path")).alias("domain"),
                    R.api_path_tail(F.col("path")).alias("api_tail"))


@register("bare_function_name", ("v_scan",), """
SELECT ord, code, list_reverse(string_split(trim(regexp_replace(coalesce(code, ''), '\\([^\\n]*', '')), '.'))[1] AS fn
FROM v_scan
""")
def q_bare_function_name(spark, sf):
    """U3 on scanner code snippets."""
    v = I.view(spark, sf, "v_scan")
    return v.select("ord", "code", R.bare_function_name(F.col("code")).alias("fn"))


def _flow_domains(spark, sf):
    eps = E.endpoint_inventory(I.view(spark, sf, "v_src_files"))
    scan = C.split_sources_sinks(I.view(spark, sf, "v_scan")).where(F.col("kind") == "sink")
    sinks = scan.select("file", R.bare_function_name(F.col("code")).alias("name")).where(F.col("name") != "")
    return R.flow_domains(eps, sinks, I.view(spark, sf, "v_fn_params"))


_STEM = f"lower(regexp_replace(p, {q(K.PARAM_STEM_RE)}, ''))"
DOMAINS_SQL = f"""
, {MADE_SQL.strip()},
e AS (SELECT *, {_DOMAIN} AS domain FROM me),
base AS (SELECT domain, CAST(count(*) AS BIGINT) AS endpoint_count, bool_or(auth_tags = '') AS has_unauth_ep FROM e GROUP BY domain),
ps AS (SELECT DISTINCT domain, split_part(p, ':', 1) AS p, split_part(p, ':', 3) AS loc
       FROM (SELECT domain, unnest(string_split(params, ',')) AS p FROM e WHERE params <> '')),
pa AS (SELECT domain, list_sort(list(DISTINCT p)) AS param_names,
         list_sort(list(DISTINCT p) FILTER (WHERE regexp_matches(p, {q(K.ID_PARAM_RE)}))) AS id_params,
         list_sort(list(DISTINCT p) FILTER (WHERE loc = 'path' AND regexp_matches(p, {q(K.ID_PARAM_RE)}))) AS path_id_params
       FROM ps GROUP BY domain),
hs AS (SELECT domain, list_sort(list(DISTINCT handler)) AS handler_names FROM e WHERE handler <> '' GROUP BY domain),
sk AS (SELECT DISTINCT lower(file) AS lfile, list_reverse(string_split(trim(regexp_replace(coalesce(code, ''), '\\([^\\n]*', '')), '.'))[1] AS name
       FROM ({SPLIT_SQL}) WHERE kind = 'sink'),
sh AS (SELECT domain, list_sort(list(DISTINCT name)) AS sink_hints FROM base JOIN sk ON contains(lfile, domain)
       WHERE name <> '' GROUP BY domain),
ts AS (SELECT domain, list_sort(list(h || '(' || ps || ')')) AS taint FROM (
         SELECT DISTINCT domain, handler AS h FROM e WHERE handler <> '') x
       JOIN (SELECT function, string_agg(DISTINCT param, '+' ORDER BY param) AS ps FROM v_fn_params GROUP BY function) y
         ON x.h = y.function GROUP BY domain),
d0 AS (SELECT base.*, coalesce(param_names, []) AS param_names, coalesce(id_params, []) AS id_params,
         coalesce(path_id_params, []) AS path_id_params, coalesce(handler_names, []) AS handler_names,
         coalesce(sink_hints, []) AS sink_hints, coalesce(taint, []) AS taint
       FROM base LEFT JOIN pa USING (domain) LEFT JOIN hs USING (domain) LEFT JOIN sh USING (domain) LEFT JOIN ts USING (domain)),
d AS (SELECT *, list_filter([CASE WHEN len(path_id_params) > 0 THEN 'path_id_params' END,
           CASE WHEN len(id_params) > 0 AND len(sink_hints) > 0 THEN 'id_param_with_sink' END,
           CASE WHEN has_unauth_ep THEN 'unauthenticated_endpoint' END,
           CASE WHEN len(taint) > 0 THEN 'taint_param_declared' END], lambda x: x IS NOT NULL) AS risk,
         list_sort(list_distinct(list_concat(CASE WHEN domain <> 'unknown' THEN [domain] ELSE [] END,
           list_filter(list_transform(id_params, lambda p: {_STEM}),
                       lambda s: s <> '' AND s <> domain AND length(s) > 2)))) AS topics FROM d0)
"""


@register("flow_domains", ("v_src_files", "v_scan", "v_fn_params"), DOMAINS_SQL + """
SELECT domain, endpoint_count, array_to_string(param_names, ',') AS param_names, array_to_string(id_params, ',') AS id_params,
  array_to_string(path_id_params, ',') AS path_id_params, array_to_string(handler_names, ',') AS handler_names, has_unauth_ep,
  array_to_string(sink_hints, ',') AS sink_hints, array_to_string(taint, ',') AS taint_signals,
  array_to_string(risk, ',') AS risk_signals, array_to_string(topics, ',') AS topic_keywords FROM d
""")
def q_flow_domains(spark, sf):
    """A3 with J3 sink hints and J4 taint signals (compare form)."""
    d = _flow_domains(spark, sf)
    j = lambda c: F.array_join(F.array_sort(c), ",")
    taint = F.transform("taint_signals", lambda t: F.concat(t["handler"], F.lit("("),
                                                            F.array_join(t["tainted_params"], "+"), F.lit(")")))
    return d.select("domain", "endpoint_count", j("param_names").alias("param_names"),
                    j("id_params").alias("id_params"), j("path_id_params").alias("path_id_params"),
                    j("handler_names").alias("handler_names"), "has_unauth_ep",
                    j("sink_hints").alias("sink_hints"), F.array_join(taint, ",").alias("taint_signals"),
                    F.array_join("risk_signals", ",").alias("risk_signals"),
                    j("topic_keywords").alias("topic_keywords"))


@register("domain_endpoints", ("v_src_files",), f"""
, {MADE_SQL.strip()}
SELECT {_DOMAIN} AS domain, id, method, path, handler FROM me
""")
def q_domain_endpoints(spark, sf):
    """A3: the endpoints of each domain."""
    return R.domain_endpoints(E.endpoint_inventory(I.view(spark, sf, "v_src_files"))).select(
        "domain", "id", "method", "path", "handler")


@register("strategy_stats", ("v_src_files", "v_scan", "v_fn_params", "v_registry_input"),
          DOMAINS_SQL + REGISTRY_SQL + """,
en AS (SELECT * FROM reg WHERE NOT starts_with(sources, 'surface_scan')),
sn AS (SELECT * FROM reg WHERE contains(sources, 'surface_scan'))
SELECT (SELECT count(*) FROM d) AS flow_domain_count, (SELECT count(*) FROM d WHERE len(risk) > 0) AS risky_domains,
  (SELECT count(*) FROM en) AS entry_count, (SELECT count(*) FROM sn) AS sink_count,
  (SELECT count(DISTINCT name) FROM en WHERE priority = 'HIGH')
    * (SELECT count(DISTINCT name) FROM sn WHERE priority IN ('HIGH', 'MEDIUM')) AS high_priority_pairs,
  (SELECT count(*) FROM v_fn_params) AS taint_param_count
""")
def q_strategy_stats(spark, sf):
    """A4 one-row summary."""
    d = _flow_domains(spark, sf)
    reg = _registry(spark, sf)
    return R.strategy_stats(d, reg.where(F.col("sources")[0] != "surface_scan"),
                            reg.where(F.array_contains("sources", "surface_scan")),
                            I.view(spark, sf, "v_fn_params"))


_NOTES = " UNION ALL ".join(
    f"SELECT unnest([{', '.join(q(t) for t in ts)}]) AS topic FROM nt WHERE "
    + " OR ".join(f"contains(lower(note), {q(k)})" for k in kws) for kws, ts in K.NOTE_TOPICS)


@register("extra_topics", ("v_sensitive", "v_url_paths"), f"""
, nt AS (SELECT text AS note FROM conversations WHERE text IS NOT NULL)
SELECT DISTINCT topic FROM (
  SELECT lower(regexp_replace(s, '[^a-zA-Z]', '', 'g')) AS topic
  FROM (SELECT unnest(regexp_split_to_array(entry, '[/\\s_-]')) AS s FROM v_sensitive)
  WHERE length(lower(regexp_replace(s, '[^a-zA-Z]', '', 'g'))) > 3
  UNION ALL SELECT lower(n) FROM (SELECT {_TAIL} AS n FROM v_url_paths) WHERE length(n) > 3
  UNION ALL SELECT dm FROM (SELECT {_DOMAIN} AS dm FROM v_url_paths) WHERE dm <> 'unknown'
  UNION ALL {_NOTES})
""")
def q_extra_topics(spark, sf):
    """A11 from sensitive-flow entries, notes (conversation texts), url-path domains and api names."""
    flows = I.view(spark, sf, "v_sensitive")
    urls = I.view(spark, sf, "v_url_paths")
    I.register_tables(spark, sf, ["conversations"])
    notes = spark.table("conversations").select(F.col("text").alias("note"))
    api = urls.select(R.api_path_tail(F.col("path")).alias("name")).where(F.col("name").isNotNull())
    kw = urls.select(R.domain_from_path(F.col("path")).alias("keyword")).where(F.col("keyword") != "unknown")
    return R.extra_topics(flow_entries=flows, notes=notes, api_names=api, domain_keywords=kw)


@register("split_camel", ("v_url_paths",), """
, n AS (SELECT p_partkey, list_reduce(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), lambda a, b: a || b) || 'Service' AS name FROM part)
SELECT p_partkey, name, array_to_string(regexp_extract_all(name, '[A-Z][a-z0-9]+'), ' ') AS words FROM n
""")
def q_split_camel(spark, sf):
    """U5 over names made of part words."""
    I.register_tables(spark, sf, ["part"])
    names = spark.table("part").select("p_partkey", F.concat(F.array_join(F.transform(F.split("p_name", " "), F.initcap), ""), F.lit("Service")).alias("name"))
    return names.select("p_partkey", "name", F.array_join(R.split_camel(F.col("name")), " ").alias("words"))


@register("param_stem", ("v_url_paths",), f"""
, p AS (SELECT p_partkey, lower(split_part(p_name, ' ', 1)) || CASE p_partkey % 5 WHEN 0 THEN '_id' WHEN 1 THEN '-UUID' WHEN 2 THEN '_number' WHEN 3 THEN 'id' ELSE '_Key' END AS p FROM part)
SELECT p_partkey, p, {_STEM} AS stem FROM p
""")
def q_param_stem(spark, sf):
    """U4."""
    I.register_tables(spark, sf, ["part"])
    p = spark.sql("""SELECT p_partkey, concat(lower(split_part(p_name, ' ', 1)), CASE p_partkey % 5 WHEN 0 THEN '_id' WHEN 1 THEN '-UUID'
        WHEN 2 THEN '_number' WHEN 3 THEN 'id' ELSE '_Key' END) AS p FROM part""")
    return p.select("p_partkey", "p", R.param_stem(F.col("p")).alias("stem"))
