"""Registered queries: tool-call log analytics, batch and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkaudit import catalogs as K
from sparkaudit.operators import secrets as S
from sparkaudit.plans import inputs as I
from sparkaudit.plans.q_secrets import SECRETS_SQL
from sparkaudit.plans.registry import register
from sparkaudit.plans.sqlfrag import q
from sparkaudit.sources import logs as L
from sparkaudit.streaming import streams as ST

_SENS = " OR ".join(f"contains(lower(k), {q(s)})" for s in K.SENSITIVE_ARG_KEYS)


@register("redact_args", ("v_calls",), f"""
, kv AS (SELECT event_id, k, json_extract_string(args, '$."' || k || '"') AS v
         FROM (SELECT event_id, args, unnest(json_keys(args)) AS k FROM v_calls) t)
SELECT event_id, string_agg(k || '=' || CASE WHEN {_SENS} THEN {q(K.REDACTED)}
    WHEN k = 'cypher' THEN CASE WHEN length(v) > {K.MAX_CYPHER_LEN} THEN substring(v, 1, {K.MAX_CYPHER_LEN}) || '...' ELSE v END
    WHEN starts_with(v, '[') THEN '[' || CAST(json_array_length(v) AS STRING) || ' items]'
    WHEN starts_with(v, '{{') THEN '{{dict, ' || CAST(len(json_keys(v)) AS STRING) || ' keys}}'
    WHEN length(v) > {K.MAX_ARG_LEN} THEN substring(v, 1, {K.MAX_ARG_LEN}) || '...'
    ELSE v END, ',' ORDER BY k) AS args_summary
FROM kv GROUP BY event_id
""")
def q_redact_args(spark, sf):
    """U6 over every call's arguments."""
    c = I.view(spark, sf, "v_calls")
    m = L.redact_args(F.col("args"))
    return c.select("event_id", F.array_join(F.transform(F.array_sort(F.map_entries(m)),
                                                         lambda e: F.concat(e["key"], F.lit("="), e["value"])),
                                             ",").alias("args_summary"))


_USAGE = """
SELECT {by}, CAST(count(*) AS BIGINT) AS calls,
  CAST(count(*) FILTER (WHERE status = 'error') AS BIGINT) AS errors,
  round(avg(CASE WHEN status = 'error' THEN 1.0 ELSE 0.0 END), 6) AS error_rate,
  CAST(sum(duration_ms) AS BIGINT) AS total_ms, round(avg(duration_ms), 3) AS avg_ms,
  min(duration_ms) AS min_ms, max(duration_ms) AS max_ms
FROM v_calls GROUP BY {by}
"""


@register("tool_usage", ("v_calls",), _USAGE.format(by="tool"))
def q_tool_usage(spark, sf):
    """A12 per tool."""
    return L.tool_usage(I.view(spark, sf, "v_calls"))


@register("run_usage", ("v_calls",), _USAGE.format(by="run_id"))
def q_run_usage(spark, sf):
    """A12 per run."""
    return L.tool_usage(I.view(spark, sf, "v_calls"), by=("run_id",))


@register("tool_latency_quantiles", ("v_calls",), """
SELECT tool, CAST(quantile_disc(duration_ms, 0.5) AS DOUBLE) AS p50_ms, CAST(quantile_disc(duration_ms, 0.9) AS DOUBLE) AS p90_ms,
  CAST(quantile_disc(duration_ms, 0.99) AS DOUBLE) AS p99_ms FROM v_calls GROUP BY tool
""")
def q_tool_latency_quantiles(spark, sf):
    """A12 latency quantiles, exact (a count per distinct duration first)."""
    return L.tool_latency_quantiles(I.view(spark, sf, "v_calls"), exact=True).select(
        "tool", F.col("q")[0].cast("double").alias("p50_ms"), F.col("q")[1].cast("double").alias("p90_ms"),
        F.col("q")[2].cast("double").alias("p99_ms"))


_SKETCH_SQL = """
, p AS (SELECT unnest([0.5, 0.9, 0.99]) AS point)
SELECT tool, CAST(point AS DOUBLE) AS point, CAST(count(*) AS BIGINT) AS n, true AS within_bound FROM v_calls, p GROUP BY tool, point
"""


def _within_bound(sketched, calls):
    """The share of calls below and up to a sketched quantile must enclose its point, but for the sketch's error."""
    asked = sketched.select("tool", "n", F.explode(F.arrays_zip(F.array(*map(F.lit, (0.5, 0.9, 0.99))).alias("point"), F.col("q").alias("ms"))).alias("x"))
    asked = asked.select("tool", "n", "x.point", "x.ms")
    counted = calls.groupBy("tool", "duration_ms").agg(F.count(F.lit(1)).alias("c"))
    share = counted.join(asked, "tool").groupBy("tool", "point", "n").agg(
        F.sum(F.when(F.col("duration_ms") < F.col("ms"), F.col("c")).otherwise(0)).alias("below"),
        F.sum(F.when(F.col("duration_ms") <= F.col("ms"), F.col("c")).otherwise(0)).alias("upto"))
    e = L.SKETCH_RANK_ERROR
    return share.select("tool", "point", "n", ((F.col("below") <= (F.col("point") + e) * F.col("n"))
                                               & (F.col("upto") >= (F.col("point") - e) * F.col("n"))).alias("within_bound"))


@register("latency_sketches", ("v_calls",), _SKETCH_SQL)
def q_latency_sketches(spark, sf):
    """Sketches per run, tool and day, merged per tool; their quantiles' ranks against exact counts."""
    calls = I.view(spark, sf, "v_calls")
    return _within_bound(L.sketched_quantiles(L.latency_sketches(calls)), calls)


@register("stream_latency_sketches", ("v_calls",), _SKETCH_SQL)
def q_stream_latency_sketches(spark, sf):
    """A12 + ST2: the same sketches kept by the stream."""
    sketches = ST.run_to_table(ST.stream_latency_sketches(_calls_stream(spark, sf)), ST.new_folder(spark, "latency"),
                               keys=("run_id", "tool", "span_start"))
    return _within_bound(L.sketched_quantiles(sketches), I.view(spark, sf, "v_calls"))


_SUMMARY_SQL = """
, r AS (SELECT event_id, tool, json_valid(result) AS ok, CASE WHEN json_valid(result) THEN result ELSE '{}' END AS j FROM v_results)
SELECT event_id, tool, CASE WHEN json_exists(j, '$.error') THEN substring(json_extract_string(j, '$.error'), 1, 300) END AS error,
  CASE WHEN json_exists(j, '$.error') THEN NULL ELSE json_extract_string(j, '$.saved_to') END AS saved_to,
  CASE WHEN json_exists(j, '$.error') THEN NULL ELSE CAST(json_extract(j, '$.count') AS BIGINT) END AS count,
  CASE WHEN json_exists(j, '$.error') OR NOT ok THEN NULL WHEN tool = 'semgrep_scan' THEN 'sinks=' || coalesce(json_array_length(j, '$.sinks'), 0) || ',sources='
       || coalesce(json_array_length(j, '$.sources'), 0)
    WHEN tool = 'triage_score' THEN 'high_score=' || coalesce(list_max(list_transform(json_extract(j, '$.scored[*].score'), lambda x: CAST(x AS BIGINT))), 0)
       || ',total_paths=' || coalesce(json_array_length(j, '$.scored'), 0)
    WHEN tool = 'secrets_scan' THEN 'secrets_found=' || coalesce(json_array_length(j, '$.findings'), 0) || ',types='
       || array_to_string(list_sort(list_distinct(list_transform(json_extract(j, '$.findings[*]'), lambda x: coalesce(json_extract_string(x, '$.type'), '?')))), '+')
    WHEN tool = 'joern_filter' THEN 'confirmed=' || coalesce(CAST(json_extract(j, '$.confirmed_count') AS BIGINT), 0) || ',full_verify='
       || coalesce(CAST(json_extract(j, '$.full_verify_count') AS BIGINT), 0) || ',skipped=' || coalesce(CAST(json_extract(j, '$.skipped_count') AS BIGINT), 0)
    ELSE '' END AS parts FROM r
"""


@register("result_summary", ("v_results",), _SUMMARY_SQL)
def q_result_summary(spark, sf):
    """Summaries by tool."""
    s = L.result_summary(I.view(spark, sf, "v_results"))
    parts = F.array_join(F.transform(F.array_sort(F.map_entries("parts")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return s.select("event_id", "tool", "error", "saved_to", "count", parts.alias("parts"))


@register("call_log_round_trip", ("v_calls",), """
SELECT run_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started_at, arg_min(tool, (ts, event_id)) AS first_tool, CAST(count(*) AS BIGINT) AS calls
FROM v_calls GROUP BY run_id
""")
def q_call_log_round_trip(spark, sf):
    """K4 + S7: the log is written, runs in a bounded number of folders, read back, and gives the session index."""
    calls = I.view(spark, sf, "v_calls").select(
        F.col("ts").cast("timestamp").alias("ts"), "run_id", "tool", L.redact_args(F.col("args")).alias("args_summary"), "status",
        "duration_ms", F.lit(None).cast("map<string,string>").alias("result_summary"), "event_id")
    folder = ST.new_folder(spark, "call-log")
    L.append_call_log(calls, folder, "all")
    f = L.session_index(L.read_call_log(spark, folder, extra="event_id long"))
    return f.select("run_id", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("started_at"), "first_tool", "calls")


@register("first_call_per_run", ("v_calls",), """
SELECT run_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS started_at, arg_min(tool, (ts, event_id)) AS first_tool,
       CAST(count(*) AS BIGINT) AS calls
FROM v_calls GROUP BY run_id
""")
def q_first_call_per_run(spark, sf):
    """W6 / K4 session index."""
    f = L.first_call_per_run(I.view(spark, sf, "v_calls"))
    return f.select("run_id", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("started_at"),
                    "first_tool", "calls")


@register("progress_rollup", ("v_calls",), """
, latest AS (SELECT run_id, tool AS label, arg_max(status = 'ok', (ts, event_id)) AS called FROM v_calls
             GROUP BY run_id, tool)
SELECT run_id, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE called) AS BIGINT) AS called,
       CAST(count(*) FILTER (WHERE NOT called) AS BIGINT) AS pending,
       coalesce(string_agg(CASE WHEN NOT called THEN label END, ',' ORDER BY label), '') AS pending_labels
FROM latest GROUP BY run_id
""")
def q_progress_rollup(spark, sf):
    """Latest state per (run, label); label = tool, called = last call ok."""
    c = I.view(spark, sf, "v_calls")
    ev = c.select("run_id", F.col("tool").alias("label"), (F.col("status") == "ok").alias("called"),
                  "ts", F.col("event_id").alias("seq"), F.col("duration_ms").alias("row_count"))
    r = L.progress_rollup(ev)
    return r.select("run_id", "total", "called", "pending",
                    F.array_join("pending_labels", ",").alias("pending_labels"))


def _calls_stream(spark, sf):
    return ST.call_stream(spark, f"{sf.rstrip('/')}/events.parquet*")


_DAY = "strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S')"


def _usage_rows(spark, sf, name, **window):
    res = ST.run_to_table(ST.stream_tool_usage(_calls_stream(spark, sf), **window), ST.new_folder(spark, name), keys=("w", "tool"))
    return res.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "tool",
                      "calls", "errors", "total_ms")


@register("stream_tool_usage", ("v_calls",), f"""
SELECT {_DAY} AS window_start, tool, CAST(count(*) AS BIGINT) AS calls,
       CAST(count(*) FILTER (WHERE status = 'error') AS BIGINT) AS errors,
       CAST(sum(duration_ms) AS BIGINT) AS total_ms
FROM v_calls GROUP BY 1, tool
""")
def q_stream_tool_usage(spark, sf):
    """ST1 + ST2: file stream, watermark, daily tumbling windows (availableNow)."""
    return _usage_rows(spark, sf, "tool_usage")


@register("stream_tool_usage_sliding", ("v_calls",), """
, w AS (SELECT *, unnest([0, 6, 12, 18]) AS back FROM v_calls),
s AS (SELECT *, time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') - to_hours(back) AS start FROM w)
SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS window_start, tool, CAST(count(*) AS BIGINT) AS calls,
       CAST(count(*) FILTER (WHERE status = 'error') AS BIGINT) AS errors, CAST(sum(duration_ms) AS BIGINT) AS total_ms
FROM s GROUP BY 1, tool
""")
def q_stream_tool_usage_sliding(spark, sf):
    """ST2: windows of a day, every six hours."""
    return _usage_rows(spark, sf, "tool_usage_sliding", slide="6 hours")


def _progress(spark, sf):
    # the horizon outlasts the table's thirty days, so no label is dropped and the counts are A15's
    return ST.progress_tables(ST.stream_query_progress(_calls_stream(spark, sf), "60 days"), ST.new_folder(spark, "progress"))


@register("stream_query_progress", ("v_calls",), """
SELECT run_id, tool AS label, arg_max(status, (ts, event_id)) AS status,
       arg_max(duration_ms, (ts, event_id)) AS duration_ms
FROM v_calls GROUP BY run_id, tool
""")
def q_stream_query_progress(spark, sf):
    """ST3: latest state per (run, label), one value a key."""
    return _progress(spark, sf)[0]


@register("stream_pending_counts", ("v_calls",), """
, l AS (SELECT run_id, tool, arg_max(status, (ts, event_id)) AS status FROM v_calls GROUP BY run_id, tool)
SELECT run_id, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE status <> 'ok') AS BIGINT) AS pending FROM l GROUP BY run_id
""")
def q_stream_pending_counts(spark, sf):
    """ST3: pending labels per run."""
    return ST.pending_counts(_progress(spark, sf)[1])


@register("stream_sessions", ("v_calls",), """
, o AS (SELECT run_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY run_id ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM v_calls),
n AS (SELECT run_id, ts, sum(new) OVER (PARTITION BY run_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o),
s AS (SELECT run_id, min(ts) AS a, max(ts) + INTERVAL 30 MINUTES AS b, count(*) AS calls FROM n GROUP BY run_id, k)
SELECT run_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS session_start, strftime(b, '%Y-%m-%d %H:%M:%S') AS session_end,
  CAST(calls AS BIGINT) AS calls FROM s WHERE b <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM v_calls)
""")
def q_stream_sessions(spark, sf):
    """ST4: sessions that the watermark has closed (30-minute inactivity gap, 1 hour of lateness)."""
    res = ST.run_to_table(ST.stream_sessions(_calls_stream(spark, sf)), ST.new_folder(spark, "sessions"), "append")
    return res.select("run_id", F.date_format("s.start", "yyyy-MM-dd HH:mm:ss").alias("session_start"),
                      F.date_format("s.end", "yyyy-MM-dd HH:mm:ss").alias("session_end"), "calls")


@register("stream_first_calls", ("v_calls",), """
, f AS (SELECT run_id, min(ts) AS first, arg_min(tool, (ts, event_id)) AS tool FROM v_calls GROUP BY run_id)
SELECT run_id, strftime(first, '%Y-%m-%d %H:%M:%S.%f') AS started_at, tool AS first_tool FROM f
WHERE date_trunc('millisecond', first) < (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM v_calls)
""")
def q_stream_first_calls(spark, sf):
    """ST4: the first call of every run that the watermark has passed (1 hour of lateness)."""
    f = ST.run_to_table(ST.stream_first_calls(_calls_stream(spark, sf)), ST.new_folder(spark, "first"), "append", timers=True)
    return f.select("run_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("started_at"), F.col("tool").alias("first_tool"))


@register("stream_call_log", ("v_calls",), """
SELECT run_id, CAST(count(*) AS BIGINT) AS calls, CAST(coalesce(sum(duration_ms), 0) AS BIGINT) AS total_ms,
       CAST(count(*) FILTER (WHERE event_id % 10 = 3) AS BIGINT) AS malformed
FROM v_calls GROUP BY run_id
""")
def q_stream_call_log(spark, sf):
    """K4 + ST1: the log is written as JSON, every tenth call once more as a line that breaks off, and read as a stream."""
    calls = I.view(spark, sf, "v_calls").select(
        F.col("ts").cast("timestamp").alias("ts"), "run_id", "tool", L.redact_args(F.col("args")).alias("args_summary"), "status",
        "duration_ms", F.lit(None).cast("map<string,string>").alias("result_summary"), "event_id")
    folder = ST.new_folder(spark, "call-log")
    L.append_call_log(calls, f"{folder}/log", "all")
    broken = calls.where("event_id % 10 = 3").select("run_id", F.concat(
        F.regexp_replace(F.to_json(F.struct(F.col("run_id").alias("run"))), r"\}$", ""), F.lit(',"ts":"2024-01-01T00:00:00","tool":'),
        F.to_json(F.struct("tool", "duration_ms"))).alias("value"))
    L.write_log_lines(broken, f"{folder}/log", "broken", "append")
    good, bad = ST.split_log(ST.call_log_stream(spark, f"{folder}/log", "event_id long"), f"{folder}/tables")
    bad = bad.groupBy("run_id").agg(F.count(F.lit(1)).alias("malformed"))
    return (good.groupBy("run_id").agg(F.count(F.lit(1)).alias("calls"), F.sum("duration_ms").cast("long").alias("total_ms"))
            .join(bad, "run_id", "left").select("run_id", "calls", "total_ms", F.coalesce("malformed", F.lit(0)).cast("long").alias("malformed")))


@register("stream_secrets_scan", (), SECRETS_SQL)
def q_stream_secrets_scan(spark, sf):
    """ST5: the secrets scan as a stateless stream over arriving documents."""
    path = f"{sf.rstrip('/')}/documents.parquet*"
    schema = spark.read.parquet(path).schema
    docs = spark.readStream.schema(schema).parquet(path).select(
        F.concat(F.lit("doc/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("file"), "text")
    return ST.run_to_table(S.secrets_scan(docs), ST.new_folder(spark, "secrets"), "append")
