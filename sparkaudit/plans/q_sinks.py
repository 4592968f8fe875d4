"""Registered queries: findings report rows, completeness, runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkaudit.operators import classify as C
from sparkaudit.plans import inputs as I
from sparkaudit.plans.q_classify import _SPLIT_SQL
from sparkaudit.plans.registry import register
from sparkaudit.sinks import artifacts as A
from sparkaudit.streaming import streams as ST

_FINDINGS_SQL = f"""
, s AS ({_SPLIT_SQL.replace("SELECT substring(md5(", "SELECT ord, substring(md5(", 1)}),
f AS (SELECT 'run_' || CAST(s.ord % 4 AS STRING) AS run_id, s.ord, s.id,
        CASE WHEN s.severity = 'WARNING' THEN NULL ELSE s.severity END AS severity,
        CASE WHEN s.type = 'semgrep_review' THEN NULL ELSE s.type END AS vuln_type,
        CASE WHEN s.ord % 5 = 0 THEN NULL ELSE s.file END AS file, s.file AS entry_file,
        CASE WHEN s.ord % 3 = 0 THEN NULL ELSE s.line END AS line_start, s.line,
        CASE WHEN s.ord % 7 = 0 THEN 'FALSE_POSITIVE' ELSE NULL END AS status,
        CASE WHEN s.ord % 4 = 1 THEN 'LOW' ELSE NULL END AS confidence
      FROM s WHERE s.kind = 'sink')
"""


def _findings(spark, sf):
    v = I.view(spark, sf, "v_scan")
    j = C.split_sources_sinks(v, keep=("ord",)).where(F.col("kind") == "sink")
    o = F.col("ord")
    return j.select(
        F.concat(F.lit("run_"), (o % 4).cast("string")).alias("run_id"), "ord", "id",
        F.when(F.col("severity") != "WARNING", F.col("severity")).alias("severity"),
        F.when(F.col("type") != "semgrep_review", F.col("type")).alias("vuln_type"),
        F.when(o % 5 != 0, F.col("file")).alias("file"), F.col("file").alias("entry_file"),
        F.when(o % 3 != 0, F.col("line")).alias("line_start"), "line",
        F.when(o % 7 == 0, F.lit("FALSE_POSITIVE")).alias("status"),
        F.when(o % 4 == 1, F.lit("LOW")).alias("confidence"), F.lit(None).cast("string").alias("cwe"),
        F.lit(None).cast("string").alias("owasp"))


@register("findings_report_rows", ("v_scan",), _FINDINGS_SQL + """
SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY ord) AS INTEGER) AS n,
  upper(coalesce(severity, 'MEDIUM')) AS severity, coalesce(vuln_type, 'unknown') AS type,
  coalesce(file, entry_file) AS file,
  coalesce(CAST(line_start AS STRING), CAST(line AS STRING), '?') AS line,
  coalesce(status, 'CONFIRMED') AS status, coalesce(confidence, 'HIGH') AS confidence, 'N/A' AS cwe, 'N/A' AS owasp
FROM f
""")
def q_findings_report_rows(spark, sf):
    """K3 report rows (defaults, ordinal per run)."""
    return A.findings_report_rows(_findings(spark, sf))


@register("list_runs", ("v_paths",), """
SELECT DISTINCT run_id FROM v_paths
""")
def q_list_runs(spark, sf):
    """S6."""
    return A.list_runs(I.view(spark, sf, "v_paths"))


@register("finding_completeness", ("v_scan",), _FINDINGS_SQL + """
SELECT id, array_to_string(list_filter(['title', CASE WHEN severity IS NULL THEN 'severity' END,
   CASE WHEN vuln_type IS NULL THEN 'vuln_type' END, CASE WHEN confidence IS NULL THEN 'confidence' END,
   CASE WHEN file IS NULL THEN 'file' END, 'taint_trace', 'poc', 'remediation'],
   lambda x: x IS NOT NULL), ',') AS missing_fields
FROM f
""")
def q_finding_completeness(spark, sf):
    """F13."""
    f = A.finding_completeness(_findings(spark, sf))
    return f.select("id", F.array_join("missing_fields", ",").alias("missing_fields"))


@register("run_timestamps", ("v_calls",), """
, r AS (SELECT CASE WHEN user_id % 11 = 0 THEN 'latest_' ELSE strftime(min(ts), '%Y%m%d_%H%M%S') || '_' END || 'app_' || CAST(user_id AS STRING) AS run_id
        FROM events GROUP BY user_id)
SELECT run_id, strftime(CASE WHEN starts_with(run_id, 'latest') THEN NULL ELSE strptime(substring(run_id, 1, 15), '%Y%m%d_%H%M%S') END, '%Y-%m-%d %H:%M:%S') AS started_at,
       CASE WHEN starts_with(run_id, 'latest') THEN '' ELSE substring(run_id, 17) END AS repo FROM r
""")
def q_run_timestamps(spark, sf):
    """S6 + U8: run ids newest first, with the time and repository that they name; other ids name none."""
    first = spark.read.parquet(f"{sf.rstrip('/')}/events.parquet").groupBy("user_id").agg(F.min("ts").alias("ts"))
    head = F.when(F.col("user_id") % 11 == 0, F.lit("latest")).otherwise(F.date_format("ts", "yyyyMMdd_HHmmss"))
    runs = first.select(F.concat(head, F.lit("_app_"), F.col("user_id").cast("string")).alias("run_id"))
    named = A.list_runs(runs).withColumn("u", A.run_timestamp(F.col("run_id")))
    return named.select("run_id", F.date_format("u.ts", "yyyy-MM-dd HH:mm:ss").alias("started_at"), "u.repo")


@register("run_artifact_round_trip", ("v_scan",), """
SELECT 'scan' AS artifact, check_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(ord) AS BIGINT) AS ords FROM v_scan GROUP BY check_id
UNION ALL
SELECT 'severe', check_id, CAST(count(*) AS BIGINT), CAST(sum(ord) AS BIGINT) FROM v_scan WHERE severity = 'error' GROUP BY check_id
""")
def q_run_artifact_round_trip(spark, sf):
    """K1 + S5: two artifacts of a run written and read back; the first of them in two versions, of which the newer counts."""
    v = I.view(spark, sf, "v_scan").select("ord", "check_id", "severity")
    base, schema = ST.new_folder(spark, "artifacts"), "ord long, check_id string, severity string"
    A.write_run_artifact(v.where("severity = 'error'"), base, "run_1", "scan", "scan")
    A.write_run_artifact(v, base, "run_1", "scan", "scan")
    A.write_run_artifact(v.where("severity = 'error'"), base, "run_1", "scan", "severe")
    out = None
    for name in ("scan", "severe"):
        got = A.read_run_artifact(spark, base, "run_1", "scan", name, schema).withColumn("artifact", F.lit(name))
        out = got if out is None else out.unionByName(got)
    return out.groupBy("artifact", "check_id").agg(F.count(F.lit(1)).alias("n"), F.sum("ord").cast("long").alias("ords"))


@register("findings_round_trip", ("v_scan",), _FINDINGS_SQL + """
SELECT run_id, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE severity = 'CRITICAL') AS BIGINT) AS critical,
  CAST(count(*) FILTER (WHERE severity = 'HIGH') AS BIGINT) AS high,
  CAST(count(*) FILTER (WHERE coalesce(severity, 'MEDIUM') = 'MEDIUM') AS BIGINT) AS medium,
  CAST(count(*) FILTER (WHERE file IS NULL AND entry_file IS NOT NULL) AS BIGINT) AS by_entry
FROM f GROUP BY run_id
""")
def q_findings_round_trip(spark, sf):
    """K2: each run's findings written, counted from what was written, and the published report read back."""
    f, base = _findings(spark, sf), ST.new_folder(spark, "findings")
    out = None
    for k in range(4):  # the view's four runs
        mine = f.where(F.col("run_id") == f"run_{k}")
        counts = A.write_findings(mine, base, f"run_{k}")
        entry = mine.groupBy("run_id").agg(F.count_if(F.col("file").isNull() & F.col("entry_file").isNotNull()).alias("by_entry"))
        rows = A.read_findings(spark, base, f"run_{k}").groupBy("run_id").agg(F.count(F.lit(1)).alias("total"))
        row = rows.join(counts, "total").join(entry, "run_id")
        out = row if out is None else out.unionByName(row)
    return out.select("run_id", "total", "critical", "high", "medium", "by_entry")
