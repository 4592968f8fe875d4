"""Scoring over large tables: what is shuffled and how records meet their context."""
from pyspark.sql import functions as F

from sparkaudit.operators import triage as T


def _records(spark, n=400):
    return spark.range(n).select(
        F.concat(F.lit("run_"), (F.col("id") % 2).cast("string")).alias("run_id"), F.col("id").alias("ord"),
        F.when(F.col("id") % 5 > 0, (F.col("id") % 150).cast("string")).alias("id"),
        F.concat(F.lit("fn"), (F.col("id") % 3).cast("string")).alias("entry_fn"),
        F.when(F.col("id") % 4 > 0, F.concat(F.lit("/app/controller/Pay"), (F.col("id") % 9).cast("string"))).alias("entry_file"),
        F.lit("/app/file.php").alias("file"),
        F.struct(F.lit("query").alias("type"), F.lit("c").alias("code"), F.lit(None).cast("string").alias("name"),
                 F.lit(None).cast("string").alias("file")).alias("source"),
        F.struct(F.when(F.col("id") % 7 > 0, "DB::select").alias("name"), F.lit("sqli").alias("type"),
                 F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("file")).alias("sink"),
        F.when(F.col("id") % 6 == 0, F.when(F.col("id") % 12 == 0, "EXEC_SINK").otherwise("OTHER")).alias("sink_cat"),
        F.lit("semgrep").alias("tool"), F.array(F.lit("semgrep")).alias("detected_by"), F.lit(None).cast("string").alias("query_type"),
        F.array().cast("array<string>").alias("call_chain"), F.array().cast("array<string>").alias("flow_nodes"),
        F.lit("confirmed").alias("path_decision"), F.lit(None).cast("int").alias("score"), F.lit(None).cast("int").alias("triage_score"),
        F.lit(False).alias("has_flow"))


def _lists(spark):
    flows = spark.createDataFrame([(0, "Pay1"), (1, "fn2"), (2, "")], "ord long, entry string")
    cx = spark.createDataFrame([(0, "Pay3", "DB::", ""), (1, "controller", "", "sqli"), (2, "file", "", "sqli")],
                               "ord long, file string, sink string, vuln_type string")
    return flows, cx


def _rows(df):
    return sorted((r.run_id, r.ord, r.id, r.score, tuple(sorted(r.triage_detail.items()))) for r in df.collect())


def test_scored_before_or_after_first_records(spark):
    p, (flows, cx) = _records(spark), _lists(spark)
    want = _rows(T.triage_score(T.unique_paths(p), flows, cx, p))
    assert _rows(T.unique_scored(p, flows, cx)) == want
    assert _rows(T.unique_scored(p, flows, cx, ("run_id", "id", "ord"))) == want


def test_contexts_broadcast_or_joined(spark, monkeypatch):
    p, (flows, cx) = _records(spark), _lists(spark)
    want = _rows(T.triage_score(p, flows, cx))
    monkeypatch.setattr(T, "BROADCAST_CONTEXTS", 0)
    assert _rows(T.triage_score(p, flows, cx)) == want


def test_records_are_shuffled_once(spark):
    p, (flows, cx) = _records(spark), _lists(spark)
    plan = T.unique_scored(p, flows, cx, ("run_id", "ord"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan


def test_few_ranges_are_broadcast(spark):
    p, (flows, cx) = _records(spark), _lists(spark)
    ranked = T.triage_rank(p, flows, cx, columns=("sink",))
    assert "SortMergeJoin" not in ranked._jdf.queryExecution().executedPlan().toString()
    full = T.triage_rank(p, flows, cx)
    assert sorted((r.run_id, r["rank"], r.ord) for r in ranked.collect()) == sorted((r.run_id, r["rank"], r.ord) for r in full.collect())


def test_points_stop_with_the_finding_that_reaches_five(spark):
    hits = spark.createDataFrame([([1, 2, 3], [2], [2, 9]), (None, None, None), ([4], None, [4, 5]), ([1, 2], [1], None)],
                                 "f array<bigint>, s array<bigint>, t array<bigint>")
    assert [r.b for r in hits.select(T.cx_boost(F.col("f"), F.col("s"), F.col("t")).alias("b")).collect()] == [7, 0, 4, 6]
