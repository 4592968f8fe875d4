"""Incremental scans equal full scans, whatever the ledger has seen before."""
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkaudit.operators import secrets as S
from sparkaudit.sources import ledger as G
from sparkaudit.streaming import streams as ST

KEYS, SCHEMA = ("repo", "path"), "repo string, path string, content string, line int"
SECRET, OTHER = 'password = "abcdef123456"\n', "x\ntoken = 'zyxwvu987654'"
SCAN = G.Scan("secrets", 1, S.secrets_scan, lambda path: ~F.coalesce(path, F.lit("")).startswith("skip/"))


def files(spark, rows):
    return spark.createDataFrame([(*r, -1) for r in rows], SCHEMA)  # a further column whose name the scan has too


def found(df):
    return sorted(((r.repo, r.path, r.line, r.type) for r in df.collect()), key=repr)


def full(spark, rows):
    ids = spark.createDataFrame([(str(i), r[2]) for i, r in enumerate(rows)], "file string, text string")
    return sorted(((*rows[int(r.file)][:2], r.line, r.type) for r in S.secrets_scan(ids).collect()
                   if not (rows[int(r.file)][1] or "").startswith("skip/")), key=repr)


def run(spark, rows, base, scan=SCAN):
    r = G.incremental_scan(files(spark, rows), base, scan, KEYS)
    assert found(r.findings) == full(spark, rows)
    return r.scanned.count()


def test_only_new_contents_are_scanned(spark, tmp_path):
    base = str(tmp_path / "ledger")
    first = [("a", "x.py", SECRET), ("a", "copy.py", SECRET), ("b", "x.JS", SECRET), ("b", "skip/y.py", OTHER), ("b", "n.py", None),
             (None, None, OTHER), (None, None, SECRET), ("a", "e.py", ""), ("a", "x.py", SECRET)]
    assert run(spark, [], base) == 0
    assert run(spark, first, base) == 5  # SECRET as .py, as .js and without an extension, OTHER, and the empty text of a null
    assert run(spark, first, base) == 0
    later = [("c", "moved.py", SECRET), ("a", "x.py", SECRET + OTHER), ("b", "z.js", SECRET)]
    assert run(spark, later, base) == 1
    assert run(spark, first + later, base) == 0
    assert run(spark, first, base, SCAN._replace(version=2)) == 5  # a new version sees all again


def test_a_large_set_of_new_contents_is_joined_by_a_shuffle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(G, "BROADCAST_BLOBS", 0)
    rows = [("a", f"{i}.py", SECRET if i % 3 else f"{i}\n{OTHER}") for i in range(40)]
    assert run(spark, rows, str(tmp_path)) == 15
    assert run(spark, rows + rows, str(tmp_path)) == 0


def test_a_failed_run_and_two_runs_at_once(spark, tmp_path):
    base = str(tmp_path / "ledger")

    def fails(df):
        return df.select("file", F.raise_error(F.lit("lost")).cast("int").alias("line"))

    with pytest.raises(Exception, match="lost"):
        G.incremental_scan(files(spark, [("a", "x.py", SECRET)]), base, SCAN._replace(run=fails), KEYS)
    assert run(spark, [("a", "x.py", SECRET)], base) == 1
    one = spark.read.parquet(f"{base}/secrets/v1")
    one.write.mode("append").parquet(f"{base}/secrets/v1-twin")  # what another run wrote at the same time
    spark.read.parquet(f"{base}/secrets/v1-twin").write.mode("append").parquet(f"{base}/secrets/v1")
    assert run(spark, [("a", "x.py", SECRET), ("b", "y.py", SECRET)], base) == 0


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.sampled_from(["a", None]), st.sampled_from(["x.py", "y.js", "skip/z.py"]),
                                   st.sampled_from([SECRET, OTHER, "", None, SECRET + OTHER])), min_size=1, max_size=6), min_size=2, max_size=2))
def test_histories(spark, tmp_path_factory, history):
    base, known = str(tmp_path_factory.mktemp("ledger")), set()
    for rows in history:
        blobs = {(c or "", p[-3:]) for _, p, c in rows if not p.startswith("skip/")}
        assert run(spark, rows, base) == len(blobs - known)
        known |= blobs


def test_corpus_changes(spark):
    before = [("a", "same", "1"), ("a", "new text", "1"), ("a", "gone", "1"), (None, None, "1"), ("a", "twice", "1"), ("a", "twice", "2"),
              ("a", "once more", "1"), ("a", "empty", None)]
    after = [("a", "same", "1"), ("a", "new text", "2"), ("b", "gone", "1"), (None, None, "1"), ("a", "twice", "2"), ("a", "twice", "1"),
             ("a", "once more", "1"), ("a", "once more", "1"), ("a", "empty", "")]
    i, j = (G.corpus_index(files(spark, x), KEYS, "content") for x in (before, after))
    assert {(r.repo, r.path): r.change for r in G.corpus_changes(i, j, KEYS).collect()} == {
        ("a", "same"): "unchanged", ("a", "new text"): "changed", ("a", "gone"): "removed", ("b", "gone"): "added", (None, None): "unchanged",
        ("a", "twice"): "unchanged", ("a", "once more"): "changed", ("a", "empty"): "unchanged"}
    assert G.corpus_changes(i.limit(0), j.limit(0), KEYS).count() == 0


def test_stream_shares_the_ledger_and_restarts(spark, tmp_path):
    source, folder, base = str(tmp_path / "in"), str(tmp_path / "stream"), str(tmp_path / "ledger")
    run(spark, [("a", "x.py", SECRET)], base)
    rows = []

    def arrive(*more):
        rows.extend(more)
        files(spark, more).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        got = ST.incremental_scan_to_table(stream, folder, base, SCAN, KEYS)
        assert found(got) == full(spark, rows)
        return spark.read.parquet(f"{base}/secrets/v1").count()

    assert arrive(("b", "copy.py", SECRET), ("b", "n.py", "nothing")) == 2
    assert arrive(("c", "copy.py", SECRET), ("c", "o.py", OTHER)) == 3
    assert arrive(("d", "o.py", OTHER)) == 3
