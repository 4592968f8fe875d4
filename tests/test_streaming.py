"""Streams: equal to batch, restart, late rows, replayed batches."""
import datetime

from pyspark.sql import Row
from pyspark.sql import functions as F

import __spark_entry__ as E
from sparkaudit.plans import inputs as I
from sparkaudit.sources import logs as L
from sparkaudit.streaming import streams as ST


def test_stream_equals_batch(spark, sf_small):
    s = E.queries()["stream_tool_usage"](spark, sf_small)
    c = I.view(spark, sf_small, "v_calls").withColumn("ts", F.col("ts").cast("timestamp"))
    b = ST.stream_tool_usage(c).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                                       "tool", "calls", "errors", "total_ms")
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, b.collect()))


def _arrive(spark, folder, rows):
    start = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([(i, start + datetime.timedelta(hours=h), u, t, 1.0, "{}") for i, h, u, t in rows],
                          "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
                          ).coalesce(1).write.mode("append").parquet(folder)


def test_restart_goes_on_and_late_rows_are_dropped(spark, tmp_path):
    events, folder = str(tmp_path / "events"), str(tmp_path / "stream")

    def run():
        usage = ST.stream_tool_usage(ST.call_stream(spark, events, "2 hours"))
        return ST.run_to_table(usage, folder, keys=("w", "tool"))

    _arrive(spark, events, [(1, 1, 1, "view"), (2, 2, 1, "view"), (3, 30, 2, "error")])
    first = {(r.w.start.day, r.tool): r.calls for r in run().collect()}
    assert first == {(1, "view"): 2, (2, "error"): 1}
    # after a stop: a row of the open window counts, one of the closed window is late
    _arrive(spark, events, [(4, 31, 2, "error"), (5, 3, 1, "view"), (6, 50, 3, "buy")])
    again = {(r.w.start.day, r.tool): r.calls for r in run().collect()}
    assert again == {(1, "view"): 2, (2, "error"): 2, (3, "buy"): 1}
    assert {(r.w.start.day, r.tool): r.calls for r in run().collect()} == again  # nothing new


def test_a_replayed_batch_replaces_its_rows(spark, tmp_path):
    """A batch whose commit got lost runs again with the same number."""
    events, folder = str(tmp_path / "events"), tmp_path / "stream"
    _arrive(spark, events, [(1, 1, 1, "view"), (2, 5, 2, "buy")])

    def run():
        usage = ST.stream_tool_usage(ST.call_stream(spark, events, "60 days"))
        return sorted((r.tool, r.calls) for r in ST.run_to_table(usage, str(folder), keys=("w", "tool")).collect())

    assert run() == [("buy", 1), ("view", 1)]
    commits = sorted((folder / "checkpoint" / "commits").iterdir())
    for f in commits:
        if "0" in f.name:
            f.unlink()
    assert run() == [("buy", 1), ("view", 1)]


def test_first_calls_whatever_order_they_arrive_in(spark, tmp_path):
    """The earliest by event time counts, is told once, and only when the watermark has passed it."""
    events, folder = str(tmp_path / "events"), str(tmp_path / "stream")

    def run():
        rows = ST.run_to_table(ST.stream_first_calls(ST.call_stream(spark, events, "10 hours")), folder, "append", timers=True)
        return sorted((r.run_id, r.ts.hour, r.tool) for r in rows.collect())

    _arrive(spark, events, [(1, 9, 1, "late"), (2, 8, 2, "buy"), (3, 9, 1, "view")])
    assert run() == []  # the watermark is before them
    _arrive(spark, events, [(4, 3, 1, "view"), (5, 12, 2, "view"), (6, 3, 1, "buy")])  # earlier ones, out of order
    assert run() == []
    _arrive(spark, events, [(7, 23, 3, "view")])  # 13 o'clock is passed
    assert run() == [("run_1", 3, "view"), ("run_2", 8, "buy")]  # ties by event
    _arrive(spark, events, [(8, 14, 1, "buy"), (9, 1, 2, "late"), (10, 23, 4, "view")])  # later ones change nothing; 9 is too late
    assert run() == [("run_1", 3, "view"), ("run_2", 8, "buy")]
    _arrive(spark, events, [(11, 40, 5, "end")])
    assert run() == [("run_1", 3, "view"), ("run_2", 8, "buy"), ("run_3", 23, "view"), ("run_4", 23, "view")]


def _a15(spark, events):
    rows = spark.read.parquet(events).select(
        F.concat(F.lit("run_"), F.col("user_id").cast("string")).alias("run_id"), F.col("event_type").alias("label"),
        (F.col("event_type") != "error").alias("called"), "ts", F.col("event_id").alias("seq"), F.lit(1).alias("row_count"))
    return {r.run_id: (r.total, r.pending) for r in L.progress_rollup(rows).collect()}


def test_progress_after_restarts_equals_the_rollup(spark, tmp_path):
    events, folder = str(tmp_path / "events"), str(tmp_path / "stream")

    def run():
        latest, steps = ST.progress_tables(ST.stream_query_progress(ST.call_stream(spark, events, "9 days"), "90 days"), folder)
        history = {(r.run_id, r.batch): (r.total, r.pending) for r in ST.pending_history(steps).collect()}
        return latest, {r.run_id: (r.total, r.pending) for r in ST.pending_counts(steps).collect()}, history

    _arrive(spark, events, [(1, 5, 1, "view"), (2, 6, 1, "error"), (3, 7, 2, "error")])
    _, counts, first = run()
    assert counts == _a15(spark, events) == {"run_1": (2, 1), "run_2": (1, 1)}
    _arrive(spark, events, [(4, 2, 2, "view"), (5, 9, 1, "buy"), (6, 1, 1, "view")])
    latest, counts, second = run()
    assert counts == _a15(spark, events) == {"run_1": (3, 1), "run_2": (2, 1)}
    assert len(second) == len(first) + 2 and all(second[k] == v for k, v in first.items())  # emitted on change only
    assert {(r.run_id, r.label): r.status for r in latest.collect()}["run_1", "view"] == "ok"
    assert run()[1:] == (counts, second)  # nothing new


def test_an_idle_label_is_dropped_by_its_timer(spark, tmp_path):
    events, folder = str(tmp_path / "events"), str(tmp_path / "stream")

    def run():
        latest, steps = ST.progress_tables(ST.stream_query_progress(ST.call_stream(spark, events, "1 hour"), "10 hours"), folder)
        return (sorted((r.run_id, r.label) for r in latest.collect()),
                {r.run_id: (r.total, r.pending) for r in ST.pending_counts(steps).collect()})

    _arrive(spark, events, [(1, 1, 1, "error"), (2, 8, 1, "view")])
    assert run() == ([("run_1", "error"), ("run_1", "view")], {"run_1": (2, 1)})
    _arrive(spark, events, [(3, 13, 2, "view")])  # the watermark passes 11 o'clock, not 18
    assert run() == ([("run_1", "view"), ("run_2", "view")], {"run_1": (1, 0), "run_2": (1, 0)})
    _arrive(spark, events, [(4, 14, 1, "error")])  # seen again
    assert run()[1] == {"run_1": (2, 1), "run_2": (1, 0)}


def test_json_log_stream_keeps_malformed_lines_apart(spark, tmp_path):
    log, folder = str(tmp_path / "log"), str(tmp_path / "tables")
    calls = spark.createDataFrame([("run_1", "scan", "ok", 5), ("run_2", "read", "error", 7)], "run_id string, tool string, status string, duration_ms long"
                                  ).withColumn("ts", F.to_timestamp(F.lit("2024-01-01 10:00:00")))

    def write(name, lines):
        d = tmp_path / "log" / f"batch={name}" / "run_id=run_1"
        d.mkdir(parents=True)
        (d / "part.json").write_text(lines)

    def run():
        good, bad = ST.split_log(ST.call_log_stream(spark, log), folder)
        return (sorted((r.run_id, r.tool, r.duration_ms) for r in good.collect()),
                sorted((r.run_id, r.writer, r.malformed) for r in bad.collect()))

    L.append_call_log(calls, log, "a")
    first = run()
    assert first == ([("run_1", "scan", 5), ("run_2", "read", 7)], [])
    write("b", '{"ts":"2024-01-01T10:00:00Z","tool":"late","duration_ms":1}\n{"tool": "cut off\nno json\n')
    second = run()
    assert second[0] == sorted([*first[0], ("run_1", "late", 1)])
    assert second[1] == [("run_1", "b", "no json"), ("run_1", "b", '{"tool": "cut off')]
    assert run() == second  # a restart adds nothing twice
    commits = tmp_path / "tables" / "checkpoint" / "commits"
    last = max(int(f.name) for f in commits.iterdir() if f.name.isdigit())
    for name in (str(last), f".{last}.crc"):
        (commits / name).unlink()
    assert run() == second  # nor does a batch that runs again


def test_a_line_that_breaks_off_tells_its_run(spark, tmp_path):
    d = tmp_path / "log" / "batch=w" / "run_id=~bucket-3"
    d.mkdir(parents=True)
    (d / "part.txt").write_text('{"run":"a \\"b","ts":"2024-01-01T10:00:00Z","tool":"t"}\n{"run":"a \\"b","tool":{"x":1\n{"tool":"y\n')
    good, bad = ST.split_log(ST.call_log_stream(spark, str(tmp_path / "log")), str(tmp_path / "tables"))
    assert [(r.run_id, r.tool) for r in good.collect()] == [('a "b', "t")]
    assert sorted((r.run_id or "", r.writer, r.malformed) for r in bad.collect()) == [
        ("", "w", '{"tool":"y'), ('a "b', "w", '{"run":"a \\"b","tool":{"x":1')]


def test_an_empty_stream_has_empty_tables(spark, tmp_path):
    (tmp_path / "log").mkdir()
    good, bad = ST.split_log(ST.call_log_stream(spark, str(tmp_path / "log")), str(tmp_path / "tables"))
    assert good.count() == bad.count() == 0


class _Handle:
    """What a processor asks of Spark, with its calls counted."""

    def __init__(self):
        self.value, self.timers, self.calls = None, [], 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def registerTimer(self, due):
        self.calls += 1
        self.timers.append(due)

    def deleteTimer(self, due):
        self.calls += 1
        self.timers.remove(due)


def test_state_is_kept_from_rows_without_a_frame_a_key():
    """many keys of few rows each; a new key costs three calls of the state."""
    handle = _Handle()
    progress = ST._Progress(1000)
    progress.init(handle)
    rows = [Row(us=2_000, event_id=i, status=s, duration_ms=d) for i, s, d in ((1, "ok", 5), (3, "error", None), (2, "ok", 7))]
    out = list(progress.handleInputRows(("run", "view"), iter(rows), None))
    assert [r.asDict() for r in out] == [{"run_id": "run", "label": "view", "status": "error", "duration_ms": None, "us": 2_000,
                                          "total": 1, "pending": 1}]
    assert (handle.calls, handle.timers) == (3, [1002])
    out = list(progress.handleInputRows(("run", "view"), iter([Row(us=9_000, event_id=0, status="ok", duration_ms=1)]), None))
    assert [(r.status, r.total, r.pending) for r in out] == [("ok", 0, -1)] and handle.timers == [1009]
    assert list(progress.handleInputRows(("run", "view"), iter([Row(us=8_000, event_id=9, status="error", duration_ms=1)]), None)) == []
    first, handle = ST._FirstCall(1000), _Handle()
    first.init(handle)
    assert list(first.handleInputRows(("run",), iter([Row(us=5_000, event_id=4, tool="b"), Row(us=5_000, event_id=2, tool="a")]), None)) == []
    assert handle.value == (5_000, 2, "a", 5, False) and handle.timers == [5]
