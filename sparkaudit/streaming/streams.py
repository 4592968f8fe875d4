"""Structured Streaming forms of the log and document operators (ST1-ST5).

A stream's state and results live in one folder that the caller names, on
shared storage: a query started again with the same folder goes on where the
last one stopped.  Every micro-batch writes a partition of its own, named by
the batch's number, so a batch that runs twice replaces its own rows.  Queries
run in update or append mode under a watermark, so old state is dropped; a
table of updates is read as the last row of each key.

Progress and first calls keep one value a key and drop it by event-time timers
(``transformWithState`` on rows, state in RocksDB; a data frame for each key cost more than
the state itself).  Before the shuffle each Arrow batch is reduced to one row a key, so a run
with a third of all calls sends few rows to the task that holds its state.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from sparkaudit.session import checkpoint_dir
from sparkaudit.sources.ledger import Scan, incremental_scan
from sparkaudit.sources.logs import CALL_LOG_SCHEMA, SKETCH_K, run_of


def call_stream(spark: SparkSession, events_glob: str, watermark: str = "1 hour") -> DataFrame:
    """ST1: continuous ingest of call records from the events table files."""
    schema = spark.read.parquet(events_glob).schema
    s = spark.readStream.schema(schema).parquet(events_glob)
    calls = s.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("run_"), F.col("user_id").cast("string")).alias("run_id"),
        F.col("event_type").alias("tool"),
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"),
        F.floor(F.col("value") * 100 + 0.5).cast("long").alias("duration_ms"),
        F.col("props").alias("args"), "event_id")
    return calls.withWatermark("ts", watermark)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder for a single run (tests, registered queries); a service names its own and keeps it."""
    return f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


def call_log_stream(spark: SparkSession, path: str, extra: str = "", watermark: str = "1 hour") -> DataFrame:
    """ST1: continuous ingest of the JSON call log (K4's folders by batch; also with a folder for each run).

    ``extra`` names further fields.  ``malformed`` holds the line where it is no call record, else null; its run
    is that of its folder, or what the line says of it before it breaks off.
    """
    schema = CALL_LOG_SCHEMA + (f", {extra}" if extra else "") + ", run string, malformed string, batch string"
    lines = spark.readStream.schema(schema).option("columnNameOfCorruptRecord", "malformed").json(path)
    told = F.nullif(F.regexp_extract("malformed", r'"run"\s*:\s*("(?:[^"\\]|\\.)*")', 1), F.lit(""))
    said = F.when(F.col("malformed").isNotNull(), F.from_json(F.concat(F.lit("["), told, F.lit("]")), "array<string>")[0])
    run = run_of(F.coalesce(F.col("run"), said), F.col("run_id"))
    return lines.withColumn("run_id", run).drop("run").withWatermark("ts", watermark)


def split_log(lines: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """ST1: (calls, malformed lines) of a ``call_log_stream``, each a table in ``folder`` that goes on after a restart."""
    bad = F.col("malformed").isNotNull()
    calls = [c for c in lines.columns if c not in ("malformed", "batch")]
    _drain(lines, folder, {"calls": lambda b: b.where(~bad).select(*calls),
                           "malformed": lambda b: b.where(bad).select("run_id", F.col("batch").alias("writer"), "malformed")})
    spark = lines.sparkSession
    return tuple(_table(spark, folder, name, df.schema) for name, df in (
        ("calls", lines.select(*calls)), ("malformed", lines.select("run_id", F.col("batch").alias("writer"), "malformed"))))


def _table(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """A table of batches, also where no batch came."""
    where = f"{folder}/{name}"
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(0))
    return spark.read.schema(schema.add("batch", "long") if "batch" not in schema.names else schema).parquet(where)


_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _drain(df: DataFrame, folder: str, tables: dict[str, Callable[[DataFrame], DataFrame]], mode: str = "append",
           timers: bool = False) -> None:
    """Process what has arrived; each micro-batch writes its own partition of each table, and none where it has no rows."""
    spark = df.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        if len(tables) > 1:
            batch = batch.persist()
        for name, rows in tables.items():
            rows(batch).write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}")
        if len(tables) > 1:
            batch.unpersist()

    given = spark.conf.get(_PROVIDER)
    if timers:
        spark.conf.set(_PROVIDER, _ROCKS)
    try:
        query = (df.writeStream.outputMode(mode).foreachBatch(write)
                 .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
    finally:
        spark.conf.set(_PROVIDER, given)
    query.awaitTermination()


def run_to_table(df: DataFrame, folder: str, mode: str = "update", keys: tuple[str, ...] = (), timers: bool = False) -> DataFrame:
    """Process what has arrived (``availableNow``) and return the table as a batch DataFrame.

    ``folder`` holds the table and the stream's checkpoint.  With ``keys`` the
    table is read as the newest row of each key, for update mode.
    """
    _drain(df, folder, {"table": lambda batch: batch}, mode, timers)
    rows = _table(df.sparkSession, folder, "table", df.schema)
    if not keys:
        return rows.drop("batch")
    values = [c for c in df.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")


def stream_tool_usage(calls: DataFrame, window: str = "1 day", slide: str | None = None) -> DataFrame:
    """ST2: per tool and tumbling (or sliding) window: calls, errors, total duration."""
    err = F.col("status") == "error"
    return calls.groupBy(F.window("ts", window, slide).alias("w"), "tool").agg(
        F.count(F.lit(1)).cast("long").alias("calls"),
        F.count_if(err).cast("long").alias("errors"),
        F.sum("duration_ms").cast("long").alias("total_ms"))


def stream_latency_sketches(calls: DataFrame, span: str = "1 day") -> DataFrame:
    """ST2 / A12: the latency sketch of each run, tool and tumbling window, to be merged like ``logs.latency_sketches``."""
    return calls.where("duration_ms is not null").groupBy(F.window("ts", span).alias("w"), "run_id", "tool").agg(
        F.kll_sketch_agg_bigint("duration_ms", SKETCH_K).alias("sketch")).select(
        "run_id", "tool", F.col("w.start").alias("span_start"), "sketch")


def _one_a_key(calls: DataFrame, keys: list[str], newest: bool) -> DataFrame:
    """Of each Arrow batch the newest (or first) call of each key: what leaves a task for the shuffle."""
    def reduce(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.sort_values(["us", "event_id"]).drop_duplicates(keys, keep="last" if newest else "first")

    return calls.mapInPandas(reduce, calls.schema)


def _narrow(calls: DataFrame, *cols: str) -> DataFrame:
    """Event time as the watermark's column and, exact, as microseconds."""
    return calls.select("run_id", *cols, "ts", F.unix_micros("ts").alias("us"), F.coalesce("event_id", F.lit(0)).cast("long").alias("event_id"))


def _milliseconds(text: str) -> int:
    return int(pd.Timedelta(text) / pd.Timedelta(milliseconds=1))


class _Progress(StatefulProcessor):
    """The newest call of a (run, label); dropped ``horizon`` after its event time."""

    def __init__(self, horizon_ms: int):
        self.horizon_ms = horizon_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long, event_id long, status string, duration_ms long, due long")

    def _row(self, key, status, duration, us, total, pending) -> Row:
        return Row(run_id=key[0], label=key[1], status=status, duration_ms=duration, us=us, total=total, pending=pending)

    def handleInputRows(self, key, rows, timerValues):
        old = self.last.get()
        best = None if old is None else (old[0], old[1])
        new = None
        for r in rows:
            if best is None or (r.us, r.event_id) > best:
                best, new = (r.us, r.event_id), r
        if new is None:
            return
        due = best[0] // 1000 + self.horizon_ms
        if old is not None:
            self.handle.deleteTimer(old[4])
        self.handle.registerTimer(due)
        self.last.update((*best, new.status, new.duration_ms, due))
        before = 0 if old is None else int(old[2] != "ok")
        yield self._row(key, new.status, new.duration_ms, best[0], int(old is None), int(new.status != "ok") - before)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        old = self.last.get()
        if old is not None and old[4] == expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
            yield self._row(key, None, None, old[0], -1, -int(old[2] != "ok"))

    def close(self) -> None:
        pass


def stream_query_progress(calls: DataFrame, horizon: str = "7 days") -> DataFrame:
    """ST3: changes of the latest state per (run_id, label) — here label = tool and the state is (status, duration)
    of the latest call.  ``total`` and ``pending`` are what the change adds to the run's labels and to those
    whose latest call did not end well.  A label without a call for ``horizon`` of event time is dropped by a
    timer: a row with null status takes it off the counts.
    """
    narrow = _narrow(calls, F.col("tool").alias("label"), "status", "duration_ms")
    return _one_a_key(narrow, ["run_id", "label"], newest=True).groupBy("run_id", "label").transformWithState(
        _Progress(_milliseconds(horizon)),
        "run_id string, label string, status string, duration_ms long, us long, total long, pending long", "Update", "eventTime")


def progress_tables(changes: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """ST3: run the changes into ``folder``; (latest state per label, counts per run with the batch that changed them)."""
    _drain(changes, folder, {"changes": lambda b: b}, "update", timers=True)
    rows = _table(changes.sparkSession, folder, "changes", changes.schema)
    latest = (rows.groupBy("run_id", "label").agg(F.max_by(F.struct("status", "duration_ms"), F.struct("us", "batch")).alias("s"),
                                                  F.sum("total").alias("live"))
              .where("live > 0").select("run_id", "label", "s.*"))
    return latest, rows.groupBy("run_id", "batch").agg(F.sum("total").alias("total"), F.sum("pending").alias("pending"))


def pending_counts(steps: DataFrame) -> DataFrame:
    """ST3: per run the labels seen, and those whose latest call did not end well."""
    return steps.groupBy("run_id").agg(F.sum("total").cast("long").alias("total"), F.sum("pending").cast("long").alias("pending"))


def pending_history(steps: DataFrame) -> DataFrame:
    """ST3: the counts after each batch that changed them, as they were emitted: (run_id, batch, total, pending)."""
    before = Window.partitionBy("run_id").orderBy("batch")
    return steps.select("run_id", "batch", *[F.sum(c).over(before).cast("long").alias(c) for c in ("total", "pending")])


def stream_sessions(calls: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """ST4: activity sessions per run by inactivity gap; append mode gives those that the watermark has closed."""
    return calls.groupBy("run_id", F.session_window("ts", gap).alias("s")).agg(
        F.count(F.lit(1)).cast("long").alias("calls"))


class _FirstCall(StatefulProcessor):
    """The earliest call of a run, held until the watermark has passed it: then no earlier one can come."""

    def __init__(self, horizon_ms: int):
        self.horizon_ms = horizon_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "us long, event_id long, tool string, due long, told boolean")

    def handleInputRows(self, key, rows, timerValues):
        old = self.first.get()
        best = None if old is None else tuple(old[:3])
        newest = None
        for r in rows:
            newest = r.us if newest is None else max(newest, r.us)
            if best is None or (r.us, r.event_id) < best[:2]:
                best = (r.us, r.event_id, r.tool)
        told = old is not None and old[4]
        if told:  # known to the table; remembered for as long as calls go on
            best, due = tuple(old[:3]), max(old[3], newest // 1000 + self.horizon_ms)
        else:
            due = best[0] // 1000
        if old is None or due != old[3]:
            if old is not None:
                self.handle.deleteTimer(old[3])
            self.handle.registerTimer(due)
        self.first.update((*best, due, told))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        old = self.first.get()
        if old is None or old[3] != expiredTimerInfo.getExpiryTimeInMs():
            return
        if old[4]:
            self.first.clear()
            return
        due = old[0] // 1000 + self.horizon_ms
        self.handle.registerTimer(due)
        self.first.update((*old[:3], due, True))
        yield Row(run_id=key[0], us=old[0], tool=old[2])

    def close(self) -> None:
        pass


def stream_first_calls(calls: DataFrame, horizon: str = "30 days") -> DataFrame:
    """ST4: the first call of each run by event time (ties by event), in whatever order calls arrive.

    It is emitted once the watermark has passed it.  A run is remembered until ``horizon`` after its last call.
    """
    first = _one_a_key(_narrow(calls, "tool"), ["run_id"], newest=False).groupBy("run_id").transformWithState(
        _FirstCall(_milliseconds(horizon)), "run_id string, us long, tool string", "Append", "eventTime")
    return first.select("run_id", F.timestamp_micros("us").alias("ts"), "tool")


def incremental_scan_to_table(files: DataFrame, folder: str, ledger: str, scan: Scan, keys: tuple[str, ...] = ("repo", "path"),
                              text: str = "content") -> DataFrame:
    """ST5: scan arriving files, each content once for all batches, runs and batch scans that share the ``ledger``.

    A batch that runs twice finds its contents in the ledger and replaces its own rows.
    """
    found = scan.run(files.select(F.col(keys[-1]).alias("file"), F.col(text).alias("text"))).drop("file")
    schema = files.select(*keys).schema
    for field in found.schema:
        schema = schema.add(field)
    _drain(files, folder, {"table": lambda batch: incremental_scan(batch, ledger, scan, keys, text).findings})
    return _table(files.sparkSession, folder, "table", schema).drop("batch")
