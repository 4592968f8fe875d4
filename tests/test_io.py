"""Readers, writers and property tests of the operators that carry keys."""
import json
import pathlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from sparkaudit.operators import intel as N
from sparkaudit.operators import rollup as R
from sparkaudit.operators import rules as U
from sparkaudit.operators import secrets as S
from sparkaudit.operators import triage as T
from sparkaudit.sinks import artifacts as A
from sparkaudit.sources import corpus, logs


def test_run_artifacts(spark, tmp_path):
    base, schema = str(tmp_path / "runs"), "a int, b string"
    assert A.read_run_artifact(spark, base, "r1", "p", "x", schema).count() == 0  # no artifact yet
    A.write_run_artifact(spark.createDataFrame([(1, "x"), (2, None)], schema), base, "r1", "p", "x")
    A.write_run_artifact(spark.createDataFrame([(9, "y")], schema), base, "r2", "p", "x")
    A.write_run_artifact(spark.createDataFrame([(3, "z")], schema), base, "r2", "p", "x")  # the newer version
    assert sorted(map(tuple, A.read_run_artifact(spark, base, "r1", "p", "x", schema).collect()), key=repr) == [(1, "x"), (2, None)]
    assert [tuple(r) for r in A.read_run_artifact(spark, base, "r2", "p", "x", schema).collect()] == [(3, "z")]

    def spoil(folder):
        pathlib.Path(folder).mkdir(parents=True)
        (pathlib.Path(folder) / "part-0.parquet").write_text("no parquet")
        return 1

    A.publish(spark, base, "r3", "p", "x", spoil)
    with pytest.raises(Exception) as e:
        A.read_run_artifact(spark, base, "r3", "p", "x", schema).count()
    assert not isinstance(e.value, AnalysisException) or "PATH_NOT_FOUND" not in str(e.value)


def test_a_failed_writer_is_invisible(spark, tmp_path):
    """A write that breaks off leaves the version before it, or none, and no half of a report."""
    base, schema = str(tmp_path / "base"), "a int, b string"
    good = spark.createDataFrame([(1, "x")], schema)
    broken = spark.range(4).select(F.when(F.col("id") == 3, F.raise_error(F.lit("lost"))).otherwise(1).cast("int").alias("a"), F.lit("y").alias("b"))
    with pytest.raises(Exception, match="lost"):
        A.write_run_artifact(broken, base, "r", "p", "x")
    assert A.read_run_artifact(spark, base, "r", "p", "x", schema).count() == 0
    A.write_run_artifact(good, base, "r", "p", "x")
    with pytest.raises(Exception, match="lost"):
        A.write_run_artifact(broken, base, "r", "p", "x")
    assert [tuple(r) for r in A.read_run_artifact(spark, base, "r", "p", "x", schema).collect()] == [(1, "x")]
    findings = spark.createDataFrame([("HIGH", 1)], "severity string, ord long")
    assert A.read_findings(spark, base, "r").count() == 0
    assert A.write_findings(findings, base, "r").first().high == 1
    with pytest.raises(Exception, match="lost"):
        A.write_findings(findings.withColumn("severity", F.raise_error(F.lit("lost")).cast("string")), base, "r")
    assert [r.severity for r in A.read_findings(spark, base, "r").collect()] == ["HIGH"]
    assert sorted((r.artifact, r.n_rows, r.versions) for r in A.list_artifacts(spark, base).collect()) == [("findings", 1, 1), ("x", 1, 1)]


def test_write_findings(spark, tmp_path):
    rows = spark.createDataFrame([("CRITICAL",), ("high",), (None,)], "severity string")
    counts = A.write_findings(rows, str(tmp_path), "run").first()
    assert (counts.total, counts.critical, counts.high, counts.medium) == (3, 1, 1, 1)
    assert spark.read.json(f"{A.published(spark, str(tmp_path), 'run', 'report', 'findings')}/findings").count() == 3
    report = A.read_findings(spark, str(tmp_path), "run").collect()
    assert sorted(r.n for r in report) == [1, 2, 3] and {r.severity for r in report} == {"CRITICAL", "HIGH", "MEDIUM"}


def test_run_timestamp(spark):
    r = spark.createDataFrame([("20240102_030405_my_repo",), ("other",)], "id string").select(
        A.run_timestamp(F.col("id")).alias("t")).collect()
    assert (str(r[0].t.ts), r[0].t.repo) == ("2024-01-02 03:04:05", "my_repo") and r[1].t.ts is None


def test_call_log(spark, tmp_path):
    calls = spark.createDataFrame([("2024-01-01 00:00:00", f"r{i % 2}", "t", {}, "ok", i, None) for i in range(6)],
                                  "ts string, run_id string, tool string, args_summary map<string,string>, status string, "
                                  "duration_ms long, result_summary map<string,string>").withColumn("ts", F.col("ts").cast("timestamp"))
    for _ in range(2):  # a retry of the same turn adds nothing
        logs.append_call_log(calls, str(tmp_path / "log"), "one")
    logs.append_call_log(calls, str(tmp_path / "log"), "two")
    assert logs.read_call_log(spark, str(tmp_path / "log")).count() == 12
    assert logs.read_call_log(spark, str(tmp_path / "log"), "r1").count() == 6
    assert {r.run_id: r.calls for r in logs.session_index(logs.read_call_log(spark, str(tmp_path / "log"))).collect()} == {"r0": 6, "r1": 6}


def test_call_log_files_do_not_grow_with_runs(spark, tmp_path):
    """Many runs share a bounded number of files; one run is read from its own folder."""
    calls = spark.range(4000).repartition(8).select(
        F.timestamp_seconds(F.col("id")).alias("ts"), F.concat(F.lit("r"), (F.col("id") % 1000).cast("string")).alias("run_id"), F.lit("t").alias("tool"),
        F.lit("ok").alias("status"), F.col("id").alias("duration_ms"))
    logs.append_call_log(calls, str(tmp_path / "log"), "one")
    assert len(list((tmp_path / "log").rglob("*.txt"))) <= logs.LOG_BUCKETS * logs.LOG_SALTS
    one = logs.read_call_log(spark, str(tmp_path / "log"), "r7")
    assert sorted(r.duration_ms for r in one.collect()) == [7, 1007, 2007, 3007] and len(one.inputFiles()) > 0
    assert logs.read_call_log(spark, str(tmp_path / "log")).count() == 4000


def test_read_corpus(spark, tmp_path):
    for name, text in (("a/x.py", "print(1)"), ("a/sub/y.js", "é"), ("b/z.py", "")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    rows = {(r.repo, r.path): r.content for r in corpus.read_corpus(spark, str(tmp_path)).collect()}
    assert rows == {("a", "x.py"): "print(1)", ("a", "sub/y.js"): "é"}  # Spark lists no files without bytes
    assert corpus.file_inventory(corpus.read_corpus(spark, str(tmp_path)), cap=1).count() == 1


def test_weak_crypto_in_long_files(spark):
    """A hash counts only near a security word; files are longer than any window."""
    lines = ["x = 1"] * 100
    lines[10], lines[60], lines[61] = "h = md5(name)", "password = read()", "h = md5(password)"
    got = S.weak_crypto_scan(spark.createDataFrame([("a.py", "\n".join(lines))], "file string, text string")).collect()
    assert [(r.line, r.type) for r in got if r.type == "weak_hash"] == [(62, "weak_hash")]


def test_one_name_with_nearly_all_registrations(spark):
    regs = spark.range(20000).select(
        F.when(F.col("id") % 100 == 0, F.concat(F.lit("n"), (F.col("id") % 700).cast("string"))).otherwise("hot").alias("name"),
        F.concat(F.lit("s"), (F.col("id") % 4).cast("string")).alias("source"), (F.col("id") % 3).alias("score"),
        (-F.col("id")).alias("ord"), F.concat(F.lit("v"), (F.col("id") % 5).cast("string")).alias("vuln_type"))
    hot = R.name_registry(regs).where("name = 'hot'").first()
    assert hot.sources == ["s3", "s2", "s1", "s0"] and hot.vuln_types == ["v4", "v3", "v2", "v1", "v0"]


def test_extra_sources_on_a_long_line(spark):
    """Many patterns on a minified file of one line: its grams are listed once and don't carry the line."""
    line = " ".join(f"x{i} handler_{i}(a)" for i in range(0, 60000, 3)) + " Queue and take7"
    files = spark.createDataFrame([("r", "a.js", "one\n" + line), ("r", "b.js", "handler_5 x"), ("r", "c.md", line)], "repo string, path string, content string")
    sources = spark.createDataFrame([(f"handler_{i}",) for i in range(50000, 52000)] + [("handler_5",), ("Queue::take7",), ("no",)], "source string")
    got = sorted((r.source, r.file, r.line) for r in U.extra_source_hits(files, sources).collect())
    want = [(f"handler_{i}", "a.js", 2) for i in range(50000, 52000) if f"handler_{i}" in line]
    assert got == sorted([*want, ("handler_5", "a.js", 2), ("handler_5", "b.js", 1), ("Queue::take7", "a.js", 2)])


def test_rule_patterns():
    assert U.rule_regex('$CURSOR.execute("..." % $VAR)') == r'[\w.]+\.execute\(".*?"\s*%\s*[\w.]+\)'


def test_intel_handles_nulls(spark):
    files = spark.createDataFrame([("r", "package.json", None), ("r", "a.py", None), ("r", "composer.json", "[broken"), ("r", ".env.example", "")],
                                  "repo string, path string, content string")
    for f in (N.detect_frameworks, N.languages, N.dependencies, N.auth_mechanisms, N.annotation_scan, N.role_constants,
              N.endpoint_role_map, N.policy_files, N.architecture_signals, N.async_signals, N.tenant_signals, N.tech_stack,
              N.security_notes, N.env_keys, N.manifest_info, N.readme):
        f(files).collect()
        f(files.limit(0)).collect()


records = st.fixed_dictionaries({}, optional={
    "id": st.one_of(st.none(), st.sampled_from(["", "a", "b"])), "entry_file": st.one_of(st.none(), st.sampled_from(["", "/api/x", "/t/tests/y"])),
    "score": st.one_of(st.none(), st.integers(0, 12)), "tool": st.sampled_from(["semgrep", "manual", "[x", "{y"])})


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(records, max_size=12))
def test_unique_paths_property(spark, recs):
    raw = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(recs)], "ord long, raw string")
    paths = T.normalize_paths(raw).withColumn("run_id", F.lit("r"))
    got = sorted(r.ord for r in T.unique_paths(paths).collect())
    seen, want = set(), []
    for i, r in enumerate(recs):
        own = {k: r.get(k) for k in ("id", "entry_file", "score", "tool")}
        key = r["id"] if r.get("id") is not None else json.dumps(own, sort_keys=True)
        if key not in seen:
            seen.add(key)
            want.append(i)
    assert got == want
