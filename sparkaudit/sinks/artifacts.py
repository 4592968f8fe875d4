"""Run artifacts and findings.

An artifact is written to a folder of its own first; only then a row of the
manifest names it as the newest version of (run, phase, artifact).  The row is one
small file that Spark's writer moves into place as a whole, so a writer that fails
leaves nothing that a reader sees, and a reader never sees half a version.  Writers
of different runs never touch each other's files; of two writers of the same
artifact the later manifest row wins.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkaudit import catalogs as K
from sparkaudit.operators.ranking import with_position


_MANIFEST = "run_id string, phase string, artifact string, version long, folder string, n_rows long"


def _manifest(spark: SparkSession, base: str) -> DataFrame:
    try:
        return spark.read.schema(_MANIFEST).json(f"{base.rstrip('/')}/_manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # only an absent manifest means "no artifact"
            raise
        return spark.createDataFrame([], _MANIFEST)


def publish(spark: SparkSession, base: str, run_id: str, phase: str, name: str, write: Callable[[str], int]) -> str:
    """``write`` fills a new folder and returns its number of rows; then the manifest is switched to the folder."""
    base = base.rstrip("/")
    folder = f"{base}/versions/{uuid.uuid4().hex}"
    n_rows = write(folder)
    row = [(run_id, phase, name, time.time_ns(), folder, n_rows)]
    spark.createDataFrame(row, _MANIFEST).coalesce(1).write.mode("append").json(f"{base}/_manifest")
    return folder


def published(spark: SparkSession, base: str, run_id: str, phase: str, name: str) -> str | None:
    """The folder of the newest version, if there is one."""
    mine = (F.col("run_id") == run_id) & (F.col("phase") == phase) & (F.col("artifact") == name)
    newest = _manifest(spark, base).where(mine).agg(F.max_by("folder", "version")).first()
    return newest[0]


def list_artifacts(spark: SparkSession, base: str) -> DataFrame:
    """(run_id, phase, artifact, n_rows, versions): the newest version's rows, and how many there were."""
    return _manifest(spark, base).groupBy("run_id", "phase", "artifact").agg(
        F.max_by("n_rows", "version").alias("n_rows"), F.count(F.lit(1)).cast("long").alias("versions"))


def write_run_artifact(df: DataFrame, base: str, run_id: str, phase: str, name: str) -> None:
    """K1: save a dataset as the newest version of run/phase/name."""
    spark = df.sparkSession

    def write(folder: str) -> int:
        df.select(F.to_json(F.struct(*df.columns)).alias("record")).write.parquet(folder)
        return spark.read.parquet(folder).count()

    publish(spark, base, run_id, phase, name, write)


def read_run_artifact(spark: SparkSession, base: str, run_id: str, phase: str, name: str,
                      schema: str) -> DataFrame:
    """The newest version of a run's artifact; missing or malformed -> empty."""
    folder = published(spark, base, run_id, phase, name)
    if folder is None:
        return spark.createDataFrame([], schema)
    parsed = spark.read.parquet(folder).select(F.from_json("record", schema).alias("r")).where(F.col("r").isNotNull())
    return parsed.select("r.*")


def list_runs(runs: DataFrame) -> DataFrame:
    """Distinct run ids, newest first."""
    return runs.select("run_id").distinct().orderBy(F.desc("run_id"))


def run_timestamp(run_id: Column) -> Column:
    """U8: ``YYYYMMDD_HHMMSS_<repo>`` -> (ts, repo)."""
    ts = F.try_to_timestamp(F.substring(run_id, 1, 15), F.lit("yyyyMMdd_HHmmss"))
    return F.struct(ts.alias("ts"), F.regexp_extract(run_id, r"^\d{8}_\d{6}_(.*)$", 1).alias("repo"))


def findings_report_rows(findings: DataFrame, order_col: str = "ord") -> DataFrame:
    """K3: report rows with the writer's defaults and a 1-based ordinal.

    The ordinal follows ``order_col`` within a run; a run of any size is
    numbered in slices."""
    line = F.coalesce(F.col("line_start").cast("string"), F.col("line").cast("string"), F.lit("?"))
    return with_position(findings, "n", ["run_id"], order_col).select(
        "run_id", F.col("n").cast("int").alias("n"),
        F.upper(F.coalesce("severity", F.lit("MEDIUM"))).alias("severity"),
        F.coalesce("vuln_type", F.lit("unknown")).alias("type"),
        F.coalesce("file", "entry_file").alias("file"), line.alias("line"),
        F.coalesce("status", F.lit("CONFIRMED")).alias("status"),
        F.coalesce("confidence", F.lit("HIGH")).alias("confidence"),
        F.coalesce("cwe", F.lit("N/A")).alias("cwe"), F.coalesce("owasp", F.lit("N/A")).alias("owasp"))


def finding_completeness(findings: DataFrame) -> DataFrame:
    """list of missing required fields per finding."""
    present = [c for c in K.REQUIRED_FINDING_FIELDS if c in findings.columns]
    missing = F.array_compact(F.array(*[
        F.when(F.col(c).isNull(), F.lit(c)) if c in present else F.lit(c) for c in K.REQUIRED_FINDING_FIELDS]))
    return findings.withColumn("missing_fields", missing)


def write_findings(findings: DataFrame, base: str, run_id: str) -> DataFrame:
    """K2: save a run's findings as JSON and their report rows, both as one version, and return the counts row of what was written.

    Missing report columns are null; without an ``ord`` column rows are numbered as they come.
    """
    spark = findings.sparkSession
    kinds = {"ord": "long", "line_start": "int", "line": "int", **{c: "string" for c in (
        "severity", "vuln_type", "file", "entry_file", "status", "confidence", "cwe", "owasp")}}
    rows = findings.withColumn("run_id", F.lit(run_id))
    for c, kind in kinds.items():
        if c not in rows.columns:
            rows = rows.withColumn(c, F.monotonically_increasing_id() if c == "ord" else F.lit(None).cast(kind))

    def write(folder: str) -> int:
        findings.write.json(f"{folder}/findings")
        findings_report_rows(rows).write.parquet(f"{folder}/report")
        return spark.read.parquet(f"{folder}/report").count()

    folder = publish(spark, base, run_id, "report", "findings", write)
    s = F.col("severity")
    return spark.read.parquet(f"{folder}/report").agg(
        F.count(F.lit(1)).cast("long").alias("total"), F.count_if(s == "CRITICAL").cast("long").alias("critical"),
        F.count_if(s == "HIGH").cast("long").alias("high"), F.count_if(s == "MEDIUM").cast("long").alias("medium"))


def read_findings(spark: SparkSession, base: str, run_id: str) -> DataFrame:
    """The report rows of a run's newest findings; none if no writer has finished."""
    folder = published(spark, base, run_id, "report", "findings")
    if folder is None:
        return spark.createDataFrame([], _REPORT)
    return spark.read.parquet(f"{folder}/report")


_REPORT = ("run_id string, n int, severity string, type string, file string, line string, status string, "
           "confidence string, cwe string, owasp string")
