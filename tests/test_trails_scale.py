"""Trails (G5): what stays on the disks, nodes without a row, halves with and without broadcasts, edges read by number."""
import os
import time

import pytest

from sparkaudit.operators import graph as G
from sparkaudit.plans import inputs as I

from test_graph import graph_of, trails


def shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in dirs for _, _, names in os.walk(d.getPath()) for f in names if f.startswith("shuffle_")}


def test_passes_leave_no_shuffle_files(spark):
    """Before the caller reads the trails, nothing of the passes over the edges lies in the shuffle folders; settings are as before."""
    pairs = [(f"s{i}", f"p{i % 7}") for i in range(60)] + [(f"p{i % 7}", f"q{i}") for i in range(30)] + [(f"q{i}", "eval") for i in range(30)]
    nodes, edges = graph_of(spark, pairs, {f"s{i}": "/controller/s" for i in range(60)})
    keys = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.parquet.compression.codec")
    before, settings = shuffle_files(spark), [spark.conf.get(k, None) for k in keys]
    out = G.paths_with_chain(nodes, edges.distinct(), "controller", ["eval"], 8)
    until = time.time() + 15
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert [spark.conf.get(k, None) for k in keys] == settings
    assert sorted(map(tuple, out.collect())) == trails(list(dict.fromkeys(pairs)), [f"s{i}" for i in range(60)], {"eval"}, 8)


def test_nodes_without_a_row_are_passed(spark):
    """As in the SQL: a trail over a node that ``nodes`` lacks stays, its name is left out of the chain."""
    pairs = [("x", "gone"), ("gone", "y"), ("y", "eval"), ("gone", "eval")]
    nodes, edges = graph_of(spark, pairs, {"x": "/controller/x"})
    got = sorted(map(tuple, G.paths_with_chain(nodes.where("node_id <> 'gone'"), edges, "controller", ["eval"], 6).collect()))
    assert got == [("x", "eval", 2, "x -> eval"), ("x", "eval", 3, "x -> y -> eval")]


@pytest.mark.parametrize("bound", [0, 500_000])
def test_halves_with_and_without_broadcasts(spark, monkeypatch, bound):
    """Very many callers of a hub, few starts: beginnings grow too; a cycle at the start lets edges come twice."""
    monkeypatch.setattr(G, "BROADCAST_FRONTIER", bound)
    pairs = ([("x", "a"), ("a", "b"), ("b", "hub"), ("hub", "t"), ("t", "eval"), ("b", "x")]
             + [(f"c{i}", "hub") for i in range(50)] + [(f"d{i}", f"c{i}") for i in range(50)] + [(f"e{i}", f"d{i}") for i in range(50)])
    nodes, edges = graph_of(spark, pairs, {"x": "/controller/x"})
    got = sorted(map(tuple, G.paths_with_chain(nodes, edges, "controller", ["eval"], 8).collect()))
    assert got == trails(pairs, ["x"], {"eval"}, 8) and {d for _, _, d, _ in got} == {5}
    both = pairs + [("b", "y"), ("y", "b"), ("eval", "hub")]
    nodes, edges = graph_of(spark, both, {"x": "/controller/x"})
    got = sorted(map(tuple, G.paths_with_chain(nodes, edges, "controller", ["eval"], 9).collect()))
    assert got == trails(both, ["x"], {"eval"}, 9) and len(got) > 1


def test_edges_are_dealt_in_passes_of_bounded_size(spark, monkeypatch):
    """Numbers stay apart between passes: parallel edges, a self-loop and a cycle give the same trails as in one pass."""
    monkeypatch.setattr(G, "EDGES_A_PASS", 3)
    rows, written = [], G.written

    def counted(df):
        out = written(df)
        if "edge" in out.columns:
            rows.append(out.count())
        return out

    monkeypatch.setattr(G, "written", counted)
    pairs = [("x", "y"), ("y", "x"), ("x", "eval"), ("x", "eval"), ("y", "y"), ("eval", "x"), ("y", "z"), ("z", "x"), ("a", "y"), ("b", "z")]
    nodes, edges = graph_of(spark, pairs, {"x": "/app/controller/x.py", "b": "/controller/b"})
    got = sorted(map(tuple, G.paths_with_chain(nodes, edges, "controller", ["eval"], 6).collect()))
    assert got == trails(pairs, ["x", "b"], {"eval"}, 6)
    assert len(rows) == 4 and max(rows) < len(pairs)


def test_edges_by_number_are_the_rows_of_the_view(spark, tmp_path):
    """Repeated keys, missing keys and rows without both keys; one shuffle instead of three."""
    for name, cols, rows in (
            ("lineitem", ("l_orderkey", "l_partkey", "l_suppkey"), [(1, 2, 3), (1, 2, 4), (1, 2, 3), (None, 2, 3), (None, None, 3), (None, None, None), (1, None, None), (5, -2, None)]),
            ("supplier", ("s_suppkey", "s_nationkey"), [(3, 1), (3, 1), (4, None), (None, None)]),
            ("nation", ("n_nationkey", "n_regionkey"), [(1, 1), (2, 1), (None, 1), (None, None)])):
        spark.createDataFrame(rows, ", ".join(f"{c} bigint" for c in cols)).write.parquet(f"{tmp_path}/{name}.parquet")
    view, mine = I.view(spark, str(tmp_path), "v_edges"), I.edges(spark, str(tmp_path))
    assert mine.dtypes == view.dtypes
    assert sorted(map(str, mine.collect())) == sorted(map(str, view.collect()))
    assert I.edges(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
