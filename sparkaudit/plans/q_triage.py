"""Registered queries: candidate-path filter, decision, scoring, ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkaudit import catalogs as K
from sparkaudit.operators import triage as T
from sparkaudit.plans import inputs as I
from sparkaudit.plans.registry import register
from sparkaudit.plans.sqlfrag import contains_any, first_contained, in_list, map_case, q
from sparkaudit.session import written

TRIAGE_VIEWS = ("v_paths", "v_sensitive", "v_cx")

# --- oracle building blocks ---------------------------------------------------
_LOW_TEST = [p.lower() for p in K.TEST_PATTERNS_TRIAGE]
_FILTER_TEST = [p.lower().replace("\\", "/") for p in K.TEST_PATTERNS_FILTER]

# What a record without an id says: its own fields, nulls kept apart.
_OWN_FIELDS = ("entry_fn entry_file file src_type src_code src_file sink_name sink_type sink_file sink_cat tool detected_by "
               "query_type call_chain flow_nodes path_decision score triage_score has_flow").split()
_OWN = "md5(" + " || '|' || ".join(f"coalesce('=' || CAST({c} AS STRING), '')" for c in _OWN_FIELDS) + ")"

SCORED_SQL = f"""
p AS (
  SELECT *, coalesce(entry_file, file, '') AS ef, coalesce(entry_fn, src_code, '') AS efn,
         coalesce(sink_type, '') AS st, coalesce(sink_name, '') AS sn
  FROM v_paths),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, CASE WHEN id IS NULL THEN {_OWN} ELSE 'id:' || id END
                                                   ORDER BY ord) AS rn FROM p) t
      WHERE rn = 1),
cxr AS (
  SELECT d.ord, sum(
      CASE WHEN c.file <> '' AND contains(d.ef, c.file) THEN 2 ELSE 0 END
    + CASE WHEN c.sink <> '' AND contains(d.sn, c.sink) THEN 2 ELSE 0 END
    + CASE WHEN c.vuln_type <> '' AND c.vuln_type = d.st THEN 1 ELSE 0 END)
    OVER (PARTITION BY d.ord ORDER BY c.ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rs
  FROM d CROSS JOIN v_cx c),
cxb AS (SELECT ord, coalesce(min(CASE WHEN rs >= 5 THEN rs END), max(rs), 0) AS boost
        FROM cxr GROUP BY ord),
parts AS (
  SELECT d.*,
    {first_contained('lower(d.ef)', _LOW_TEST, K.TEST_PATTERNS_TRIAGE)} AS marker,
    {map_case("coalesce(CASE WHEN d.sink_cat <> '' THEN d.sink_cat END, " + map_case('d.st', K.SINK_TYPE_TO_CAT) + ", 'CUSTOM')", K.SINK_SEVERITY, '1')} AS sev,
    CASE WHEN d.tool = 'semgrep' OR list_contains(string_split(d.detected_by, ','), 'semgrep') THEN 3 ELSE 0 END AS sg,
    CASE WHEN d.tool = 'gitnexus' OR d.query_type IN ('structural', 'object') THEN 2 ELSE 0 END AS gx,
    CASE WHEN d.path_decision = 'confirmed' THEN 2 ELSE 0 END AS jc,
    CASE WHEN d.sink_type = 'custom_wrapper' THEN 1 ELSE 0 END AS cs,
    CASE WHEN {in_list('d.src_type', K.HTTP_SOURCE_TYPES)} THEN 1 ELSE 0 END AS hs,
    CASE WHEN {contains_any('lower(d.ef)', K.ENTRY_POINT_HINTS)} THEN 2 ELSE 0 END AS ep,
    CASE WHEN EXISTS (SELECT 1 FROM v_sensitive f WHERE f.entry <> ''
                      AND (contains(d.ef, f.entry) OR contains(d.efn, f.entry))) THEN 2 ELSE 0 END AS sf,
    coalesce(cxb.boost, 0) AS cb,
    CASE WHEN d.query_type = 'object' THEN 1 ELSE 0 END AS ob
  FROM d LEFT JOIN cxb ON d.ord = cxb.ord),
scored AS (
  SELECT *,
    CASE WHEN marker IS NOT NULL THEN -10 ELSE sev + sg + gx + jc + cs + hs + ep + sf + cb + ob END AS tscore,
    CASE WHEN marker IS NOT NULL THEN 'fp=test_file:' || marker ELSE concat_ws(',',
      'sink_severity=' || CAST(sev AS STRING),
      CASE WHEN sg <> 0 THEN 'semgrep_match=' || CAST(sg AS STRING) END,
      CASE WHEN gx <> 0 THEN 'gitnexus_structural=' || CAST(gx AS STRING) END,
      CASE WHEN jc <> 0 THEN 'joern_confirmed=' || CAST(jc AS STRING) END,
      CASE WHEN cs <> 0 THEN 'custom_sink=' || CAST(cs AS STRING) END,
      CASE WHEN hs <> 0 THEN 'direct_http_source=' || CAST(hs AS STRING) END,
      CASE WHEN ep <> 0 THEN 'entry_point_bonus=' || CAST(ep AS STRING) END,
      CASE WHEN sf <> 0 THEN 'sensitive_flow_match=' || CAST(sf AS STRING) END,
      CASE WHEN cb <> 0 THEN 'cx_boost=' || CAST(cb AS STRING) END,
      CASE WHEN ob <> 0 THEN 'object_bonus=' || CAST(ob AS STRING) END) END AS detail
  FROM parts)
"""


def _scored(spark, sf):
    paths = I.paths(spark, sf)
    flows = I.view(spark, sf, "v_sensitive")
    cx = I.view(spark, sf, "v_cx")
    return paths, flows, cx


def _out(df, *extra):
    return df.select("run_id", *extra, "id", "ord", "entry_file", F.col("sink.name").alias("sink_name"),
                     F.col("sink.type").alias("sink_type"), F.col("score").cast("int").alias("score"),
                     T.detail_string(F.col("triage_detail")).alias("detail"))


@register("triage_rank", TRIAGE_VIEWS, f"""
, {SCORED_SQL.strip()}
SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY tscore DESC, ord ASC) AS rank,
       id, ord, entry_file, sink_name, sink_type, CAST(tscore AS INTEGER) AS score, detail
FROM scored WHERE tscore >= {K.TRIAGE_THRESHOLD}
""")
def q_triage_rank(spark, sf):
    """W2 — headline: every path worth a review, ranked within its run."""
    p, fl, cx = _scored(spark, sf)
    return _out(T.triage_rank(p, fl, cx, columns=("entry_file", "sink")), "rank")


@register("triage_score", TRIAGE_VIEWS, f"""
, {SCORED_SQL.strip()}
SELECT run_id, id, ord, entry_file, sink_name, sink_type, CAST(tscore AS INTEGER) AS score, detail FROM scored
""")
def q_triage_score(spark, sf):
    """W1 with J1/J2 over every de-duplicated path."""
    p, fl, cx = _scored(spark, sf)
    return _out(T.unique_scored(p, fl, cx, ("run_id", "id", "ord", "entry_file", "sink")))


@register("triage_summary", TRIAGE_VIEWS, f"""
, {SCORED_SQL.strip()}
SELECT run_id, CAST(count(*) AS BIGINT) AS total_before,
       CAST(count(*) FILTER (WHERE tscore >= {K.TRIAGE_THRESHOLD}) AS BIGINT) AS total_after,
       CAST(count(*) FILTER (WHERE tscore < {K.TRIAGE_THRESHOLD}) AS BIGINT) AS skipped_below_threshold
FROM scored GROUP BY run_id
""")
def q_triage_summary(spark, sf):
    p, fl, cx = _scored(spark, sf)
    return T.triage_summary(p, fl, cx)


@register("score_distribution", TRIAGE_VIEWS, f"""
, {SCORED_SQL.strip()},
k AS (SELECT * FROM scored WHERE tscore >= {K.TRIAGE_THRESHOLD}),
b AS (SELECT '>=10' AS bucket UNION ALL SELECT '8-9' UNION ALL SELECT '6-7')
SELECT b.bucket, CAST(count(k.ord) AS BIGINT) AS n
FROM b LEFT JOIN k ON (CASE WHEN k.tscore >= 10 THEN '>=10' WHEN k.tscore >= 8 THEN '8-9' ELSE '6-7' END) = b.bucket
GROUP BY b.bucket
""")
def q_score_distribution(spark, sf):
    """A5 over kept rows before the cap."""
    p, fl, cx = _scored(spark, sf)
    return T.score_distribution(T.triage_scored(p, fl, cx))


@register("top_paths", TRIAGE_VIEWS, f"""
, {SCORED_SQL.strip()}
SELECT run_id, id, ord, CAST(tscore AS INTEGER) AS score, detail FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY tscore DESC, ord ASC) AS r FROM scored) t
WHERE r <= 10
""")
def q_top_paths(spark, sf):
    """Top 10 scored paths per run (WindowGroupLimit before the shuffle)."""
    p, fl, cx = _scored(spark, sf)
    s = T.unique_scored(p, fl, cx, ("run_id", "id", "ord"))
    return T.top_paths(s, 10, per="run_id").select(
        "run_id", "id", "ord", F.col("score").cast("int").alias("score"),
        T.detail_string(F.col("triage_detail")).alias("detail"))


# --- structural filter --------------------------------------------------------
def _fp_sql(require_score: bool = True) -> str:
    ef = "coalesce(entry_file, src_file, '')"
    sc = "coalesce(score, triage_score, 0)" if require_score else "coalesce(score, triage_score)"
    tst = lambda e: contains_any(f"replace(lower({e}), '\\', '/')", _FILTER_TEST)
    sfile = "coalesce(sink_file, '')"
    return f"""
fp AS (
  SELECT *,
    CASE WHEN {sc} < {K.FP_MIN_SCORE} THEN 'skip'
         WHEN {tst(ef)} THEN 'skip'
         WHEN {sfile} <> '' AND {tst(sfile)} THEN 'skip'
         WHEN {contains_any(f'lower({ef})', K.UTILITY_PATTERNS)} THEN 'low_priority'
         ELSE 'pass' END AS fp_decision,
    CASE WHEN {sc} < {K.FP_MIN_SCORE} THEN 'score_too_low:' || CAST({sc} AS STRING)
         WHEN {tst(ef)} THEN 'test_or_migration_file'
         WHEN {sfile} <> '' AND {tst(sfile)} THEN 'sink_in_test_file'
         WHEN {contains_any(f'lower({ef})', K.UTILITY_PATTERNS)} THEN 'utility_class_entry'
         WHEN query_type IN ('feedback', 'object') THEN query_type || '_path'
         ELSE 'no_structural_fp_matched' END AS fp_reason
  FROM v_paths)
"""


@register("fp_filter", ("v_paths",), f"""
, {_fp_sql().strip()}
SELECT id, ord, fp_decision, fp_reason, CASE WHEN fp_decision = 'pass' THEN 0 ELSE 1 END AS fp_rank
FROM fp WHERE fp_decision <> 'skip'
""")
def q_fp_filter(spark, sf):
    """F4 (with F1/F3): structural false-positive filter."""
    return T.fp_filter(I.paths(spark, sf)).select("id", "ord", "fp_decision", "fp_reason", "fp_rank")


@register("fp_decision", ("v_paths",), f"""
, {_fp_sql(False).strip()}
SELECT id, ord, fp_decision, fp_reason FROM fp
""")
def q_fp_decision(spark, sf):
    """F3 in pipeline mode (``require_score=False``, quirk Q1)."""
    return T.fp_decision(I.paths(spark, sf), require_score=False).select(
        "id", "ord", "fp_decision", "fp_reason")


@register("fp_filter_summary", ("v_paths",), f"""
, {_fp_sql().strip()}
SELECT CAST(count(*) FILTER (WHERE fp_decision = 'skip') AS BIGINT) AS removed_count,
       CAST(count(*) FILTER (WHERE fp_decision = 'pass') AS BIGINT) AS pass_count,
       CAST(count(*) FILTER (WHERE fp_decision = 'low_priority') AS BIGINT) AS low_priority_count
FROM fp
""")
def q_fp_filter_summary(spark, sf):
    return T.fp_filter_summary(T.fp_decision(I.paths(spark, sf)))


_REASONS = f"""
, {_fp_sql().strip()}
SELECT fp_reason AS reason, CAST(count(*) AS BIGINT) AS n, min(ord) AS first_ord
FROM fp WHERE fp_decision = 'skip' GROUP BY 1
"""


@register("skip_reasons", ("v_paths",), _REASONS)
def q_skip_reasons(spark, sf):
    """Every skip reason."""
    return T.skip_reasons(T.fp_decision(I.paths(spark, sf)))


@register("skip_reason_top5", ("v_paths",), _REASONS + "ORDER BY n DESC, first_ord ASC LIMIT 5")
def q_skip_reason_top5(spark, sf):
    """The report's five most frequent reasons."""
    return T.skip_reasons(T.fp_decision(I.paths(spark, sf)), 5)


# --- path decision ------------------------------------------------------------
_CONFIRM_TEST = contains_any("coalesce(entry_file, file, '')", K.TEST_PATTERNS_CONFIRM)
_MANUAL = ("regexp_matches(replace(call_chain, '|', ' '), "
           + q("|".join(f"(?:{p})" for p in K.MANUAL_PATTERNS)) + ")")
_HINT = ("list_bool_or(list_transform(string_split(flow_nodes, '|'), lambda n: "
         + contains_any("n", K.SANITIZER_HINTS) + "))")
_HAS_PAT = ("trim(split_part(coalesce(src_code, ''), '(', 1)) <> '' "
            "AND trim(split_part(coalesce(sink_name, ''), '(', 1)) <> ''")


@register("path_decision", ("v_paths",), f"""
SELECT id, ord, dec AS path_decision,
       CASE WHEN dec IN ('sanitizer', 'confirmed') THEN replace(flow_nodes, '|', ',') ELSE '' END AS flow_nodes
FROM (SELECT *,
  CASE WHEN {_CONFIRM_TEST} THEN 'skip_fp'
       WHEN query_type = 'object' THEN 'object_trace'
       WHEN {_MANUAL} THEN 'manual'
       WHEN NOT ({_HAS_PAT}) THEN 'full_verify'
       WHEN NOT coalesce(has_flow, false) THEN 'skip_no_flow'
       WHEN flow_nodes <> '' AND {_HINT} THEN 'sanitizer'
       ELSE 'confirmed' END AS dec
  FROM v_paths) t
""")
def q_path_decision(spark, sf):
    """F5 with F7/F8 over a flow-evidence column."""
    d = T.path_decision(I.paths(spark, sf))
    return d.select("id", "ord", "path_decision",
                    F.array_join("flow_nodes", ",").alias("flow_nodes"))


@register("path_decision_fallback", ("v_paths",), f"""
SELECT id, ord,
  CASE WHEN {_CONFIRM_TEST} THEN 'skip_fp'
       WHEN query_type = 'object' THEN 'object_trace'
       WHEN {_MANUAL} THEN 'manual'
       ELSE 'full_verify' END AS path_decision
FROM v_paths
""")
def q_path_decision_fallback(spark, sf):
    """F6 (no flow evidence)."""
    return T.path_decision(I.paths(spark, sf), with_flow=False).select("id", "ord", "path_decision")


@register("verify_queue_order", TRIAGE_VIEWS, f"""
, {SCORED_SQL.strip()}
SELECT id, ord, CAST(tscore AS INTEGER) AS score, path_decision,
  CASE WHEN path_decision = 'confirmed' AND tscore >= 10 THEN 0 WHEN path_decision = 'confirmed' THEN 1
       WHEN path_decision = 'full_verify' AND tscore >= 8 THEN 2 ELSE 3 END AS verify_rank
FROM scored
""")
def q_verify_queue_order(spark, sf):
    """F12 over scored paths."""
    p, fl, cx = _scored(spark, sf)
    # the sort reads its rows twice (bounds are sampled): the columns it needs are written once
    s = written(T.unique_scored(p, fl, cx, ("id", "ord", "path_decision")).select("id", "ord", "score", "path_decision"))
    return T.verify_queue_order(s).select("id", "ord", F.col("score").cast("int").alias("score"),
                                          "path_decision", "verify_rank")


_RAW = """CASE l_orderkey % 3 WHEN 0 THEN concat('/app/raw', CAST(l_orderkey AS STRING), '.php')
  WHEN 1 THEN concat('{"id": "', CAST(l_orderkey AS STRING), '", "entry_file": "/a.php", "score": ', CAST(l_linenumber AS STRING), ', "sink_fn": "exec", "sink_file": "/s.php"}')
  ELSE concat('{"entry_fn": "f", "sink": {"name": "query", "type": "sqli"}, "tool": "semgrep"}') END"""


@register("normalize_paths", ("v_paths",), f"""
, r AS (SELECT l_orderkey, l_linenumber, {_RAW} AS raw, l_orderkey % 3 AS k FROM lineitem)
SELECT CASE WHEN k = 1 THEN CAST(l_orderkey AS STRING) END AS id, CASE k WHEN 0 THEN raw WHEN 1 THEN '/a.php' END AS entry_file,
  CASE k WHEN 0 THEN '' WHEN 1 THEN 'exec' ELSE 'query' END AS sink_name, CASE k WHEN 0 THEN 'custom' WHEN 2 THEN 'sqli' END AS sink_type,
  CASE k WHEN 0 THEN 'manual' WHEN 2 THEN 'semgrep' END AS tool, CAST(CASE k WHEN 0 THEN 0 WHEN 1 THEN l_linenumber END AS INTEGER) AS score FROM r
""")
def q_normalize_paths(spark, sf):
    """JSON records, flat graph rows and bare strings."""
    I.register_tables(spark, sf, ["lineitem"])
    raw = spark.sql(f"SELECT l_orderkey AS ord, {_RAW} AS raw FROM lineitem")
    return T.normalize_paths(raw).select("id", "entry_file", F.col("sink.name").alias("sink_name"), F.col("sink.type").alias("sink_type"),
                                         "tool", "score")
