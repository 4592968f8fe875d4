"""Tool-call log: reader and batch analytics.

Log schema: ts timestamp, run_id, tool, args (JSON text or map), status,
duration_ms long, result_summary map.  Every roll-up is a hash aggregation on
(tool) or (run_id[, label]) with partial aggregation before the shuffle;
percentiles use bounded-memory sketches, kept per run and day and merged for any range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkaudit import catalogs as K

CALL_LOG_SCHEMA = ("ts timestamp, run_id string, tool string, args_summary map<string,string>, "
                   "status string, duration_ms long, result_summary map<string,string>")


#: Folders of a batch of the log, and tasks that share the rows of one.
LOG_BUCKETS, LOG_SALTS = 32, 8
_BUCKET = "~bucket-"


def run_folder(run_id: Column) -> Column:
    """The ``run_id`` folder of a run in the log: many runs share one."""
    return F.concat(F.lit(_BUCKET), F.pmod(F.xxhash64(run_id), F.lit(LOG_BUCKETS)).cast("string"))


def run_of(run: Column, folder: Column) -> Column:
    """A record's run: its own field, or its folder where a log has a folder for each run."""
    return F.coalesce(run, F.when(~folder.startswith(_BUCKET), folder))


def read_call_log(spark: SparkSession, path: str, run_id: str | None = None, extra: str = "") -> DataFrame:
    """JSON-lines call log with an explicit schema (and ``extra`` fields);
    malformed lines are dropped; with the optional run filter only the run's folder is read."""
    schema = CALL_LOG_SCHEMA + (f", {extra}" if extra else "")
    df = spark.read.schema(schema + ", run string, batch string").option("mode", "DROPMALFORMED").json(path)
    if run_id:
        df = df.where((F.col("run_id") == run_id) | (F.col("run_id") == run_folder(F.lit(run_id))))
    df = df.withColumn("run_id", run_of(F.col("run"), F.col("run_id"))).drop("run", "batch")
    return df.where(F.col("run_id") == run_id) if run_id else df


def write_log_lines(lines: DataFrame, path: str, batch: str, mode: str = "overwrite") -> None:
    """``lines`` (run_id, value) into the log's folders.

    A batch has at most ``LOG_BUCKETS`` x ``LOG_SALTS`` files, whatever the number of runs and tasks;
    a run of most rows fills several.
    """
    salt = F.pmod(F.xxhash64("value"), F.lit(LOG_SALTS))
    (lines.select(F.lit(batch).alias("batch"), run_folder(F.col("run_id")).alias("run_id"), salt.alias("_salt"), "value")
     .repartition("run_id", "_salt").drop("_salt")
     .write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("batch", "run_id").text(path))


def append_call_log(calls: DataFrame, path: str, batch: str) -> None:
    """K4: append call records to the log, runs dealt into a bounded number of folders.

    A line begins with its run, so that one that breaks off still tells it.  ``batch`` names the writer's turn:
    writing the same turn again replaces its own files, so a retry adds nothing twice.
    """
    record = F.struct(F.col("run_id").alias("run"), *[c for c in calls.columns if c != "run_id"])
    write_log_lines(calls.select("run_id", F.to_json(record).alias("value")), path, batch)


def session_index(calls: DataFrame) -> DataFrame:
    """The session record of each run (started_at, first tool, calls)."""
    return first_call_per_run(calls)


def redact_args(args_json: Column, max_text: int = K.MAX_ARG_LEN, max_cypher: int = K.MAX_CYPHER_LEN) -> Column:
    """Parse an argument object and summarise each value: sensitive keys
    redacted, ``cypher`` and other long strings cut, lists and objects
    replaced by their sizes.  The JSON type decides: a string that starts with
    a bracket stays a string."""
    m = F.from_json(args_json, "map<string,string>")
    typed = F.try_parse_json(args_json)

    def summarise(k, v):
        kl = F.lower(k)
        sens = F.lit(False)
        for s in K.SENSITIVE_ARG_KEYS:
            sens = sens | kl.contains(s)
        # a string value is quoted in the variant's own text; lists and objects are not
        raw = F.try_variant_get(typed, "$", "map<string,variant>")[k]
        kind = F.schema_of_variant(raw)
        is_list = kind.startswith("ARRAY")
        is_obj = kind.startswith("OBJECT")
        n_list = F.json_array_length(v)
        n_keys = F.size(F.json_object_keys(v))
        return (F.when(sens, F.lit(K.REDACTED))
                .when(k == "cypher", F.when(F.length(v) > max_cypher,
                                            F.concat(F.substring(v, 1, max_cypher), F.lit("...")))
                      .otherwise(v))
                .when(is_list, F.concat(F.lit("["), n_list.cast("string"), F.lit(" items]")))
                .when(is_obj, F.concat(F.lit("{dict, "), n_keys.cast("string"), F.lit(" keys}")))
                .when(F.length(v) > max_text, F.concat(F.substring(v, 1, max_text), F.lit("...")))
                .otherwise(v))
    return F.transform_values(m, summarise)


def tool_usage(calls: DataFrame, by=("tool",)) -> DataFrame:
    """Calls, errors, error rate, duration statistics per tool (or run)."""
    err = F.col("status") == "error"
    return calls.groupBy(*by).agg(
        F.count(F.lit(1)).cast("long").alias("calls"),
        F.count_if(err).cast("long").alias("errors"),
        F.round(F.avg(err.cast("double")), 6).alias("error_rate"),
        F.sum("duration_ms").cast("long").alias("total_ms"),
        F.round(F.avg("duration_ms"), 3).alias("avg_ms"),
        F.min("duration_ms").alias("min_ms"),
        F.max("duration_ms").alias("max_ms"))


def tool_latency_quantiles(calls: DataFrame, by=("tool",), exact: bool = False) -> DataFrame:
    """A12 latency quantiles: a bounded-memory sketch, or ``exact`` from a count per distinct duration."""
    points = [0.5, 0.9, 0.99]
    if not exact:
        return calls.groupBy(*by).agg(F.percentile_approx("duration_ms", points, 10000).alias("q"))
    counted = calls.groupBy(*by, "duration_ms").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(*by).orderBy("duration_ms")
    ranked = counted.withColumn("c", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
    firsts = [F.min(F.when(F.col("c") >= F.ceil(F.lit(p) * F.col("total")), F.col("duration_ms"))) for p in points]
    return ranked.groupBy(*by).agg(F.array(*firsts).alias("q"))


#: Size parameter of a latency sketch: a rank is off by about 1 % at most (0.99 of draws).
SKETCH_K = 400
#: What the tests and the query allow for.
SKETCH_RANK_ERROR = 0.02


def latency_sketches(calls: DataFrame, by=("run_id", "tool"), span: str = "day") -> DataFrame:
    """One mergeable KLL sketch of the durations for each key and ``span`` of time, (``by``, span_start, sketch).

    Kept as a table, it answers any range and any coarser key without the calls; null durations don't count.
    """
    return calls.where("duration_ms is not null").groupBy(*by, F.date_trunc(span, "ts").alias("span_start")).agg(
        F.kll_sketch_agg_bigint("duration_ms", SKETCH_K).alias("sketch"))


def sketched_quantiles(sketches: DataFrame, by=("tool",), points=(0.5, 0.9, 0.99), since=None, until=None) -> DataFrame:
    """(``by``, n, q): quantiles of the merged sketches of [since, until); ``q`` follows ``points``."""
    if since is not None:
        sketches = sketches.where(F.col("span_start") >= F.lit(since))
    if until is not None:
        sketches = sketches.where(F.col("span_start") < F.lit(until))
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_bigint("sketch", SKETCH_K).alias("_s"))
    return merged.select(*by, F.kll_sketch_get_n_bigint("_s").alias("n"),
                         F.array(*[F.kll_sketch_get_quantile_bigint("_s", F.lit(p)) for p in points]).alias("q"))


def first_call_per_run(calls: DataFrame) -> DataFrame:
    """W6 / K4 session index: first call (by ts, then event order) per run."""
    key = F.struct("ts", F.col("event_id") if "event_id" in calls.columns else F.lit(0))
    return calls.groupBy("run_id").agg(
        F.min("ts").alias("started_at"), F.min_by("tool", key).alias("first_tool"),
        F.count(F.lit(1)).cast("long").alias("calls"))


def progress_rollup(events: DataFrame) -> DataFrame:
    """Progress events (run_id, label, called, ts, row_count) -> latest
    state per (run, label) -> per run total / called / pending + labels."""
    latest = events.groupBy("run_id", "label").agg(
        F.max_by(F.struct("called", "row_count"), F.struct("ts", "seq")).alias("s"))
    called = F.col("s.called")
    return latest.groupBy("run_id").agg(
        F.count(F.lit(1)).cast("long").alias("total"),
        F.count_if(called).cast("long").alias("called"),
        F.count_if(~called).cast("long").alias("pending"),
        F.array_sort(F.collect_list(F.when(~called, F.col("label")))).alias("pending_labels"))


def result_summary(results: DataFrame, max_error: int = 300, max_types: int | None = None) -> DataFrame:
    """Per call the error, or the common fields and the counts that its tool's result has.

    ``results``: (tool, result JSON).  ``parts`` maps a count's name to its value;
    an error replaces everything else, and a result that isn't an object has no parts.
    ``max_types``: types of so many first findings only, as in the reference; of all by default.
    """
    r = F.col("result")
    ok = F.trim(r).startswith("{") & F.try_parse_json(r).isNotNull()
    error = F.when(ok, F.substring(F.get_json_object(r, "$.error"), 1, max_error))
    fine = ok & error.isNull()

    def number(path):
        return F.coalesce(F.get_json_object(r, path).cast("long"), F.lit(0)).cast("string")

    def length(path):
        return F.coalesce(F.json_array_length(F.get_json_object(r, path)), F.lit(0)).cast("string")
    scores = F.transform(F.from_json(F.get_json_object(r, "$.scored"), "array<struct<score:long>>"), lambda x: F.coalesce(x["score"], F.lit(0)))
    found = F.from_json(F.get_json_object(r, "$.findings"), "array<struct<type:string>>")
    if max_types is not None:
        found = F.slice(found, 1, max_types)
    types = F.array_sort(F.array_distinct(F.transform(found, lambda x: F.coalesce(x["type"], F.lit("?")))))
    tools = {
        "semgrep_scan": {"sources": length("$.sources"), "sinks": length("$.sinks")},
        "api_parse": {"endpoints": length("$.endpoints")},
        "secrets_scan": {"secrets_found": length("$.findings"), "types": F.coalesce(F.array_join(types, "+"), F.lit(""))},
        "gitnexus_context": {"entry_points": length("$.entry_points"), "custom_sinks": length("$.custom_sinks"),
                             "file_tree_len": F.coalesce(F.length(F.get_json_object(r, "$.file_tree")), F.lit(0)).cast("string")},
        "gitnexus_query": {"paths": length("$.paths"), "nodes": length("$.nodes")},
        "fp_filter": {"kept": length("$.kept"), "removed": length("$.removed")},
        "joern_filter": {"confirmed": number("$.confirmed_count"), "full_verify": number("$.full_verify_count"),
                         "skipped": number("$.skipped_count")},
        "triage_score": {"total_paths": length("$.scored"),
                         "high_score": F.coalesce(F.array_max(scores), F.lit(0)).cast("string")},
        "repo_intel": {"frameworks": length("$.framework_detection.frameworks"), "mechanisms": length("$.auth_detection.mechanisms"),
                       "annotations": length("$.auth_detection.annotations"), "security_notes": length("$.security_notes")},
        "write_findings": {"findings_written": length("$.findings")},
        "burp_send": {"status_code": F.coalesce(F.get_json_object(r, "$.status_code"), F.lit("")),
                      "evidence": F.coalesce(F.get_json_object(r, "$.saved_to"), F.lit(""))},
    }
    parts = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    for tool, fields in tools.items():
        parts = F.when(F.col("tool") == tool, F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)])).otherwise(parts)
    out = results.withColumn("error", error)
    for key in ("saved_to", "saved_json", "saved_md"):
        out = out.withColumn(key, F.when(fine, F.get_json_object(r, f"$.{key}")))
    for key in ("count", "total"):
        out = out.withColumn(key, F.when(fine, F.get_json_object(r, f"$.{key}").cast("long")))
    return out.withColumn("parts", F.when(fine, parts))
