"""Path filter / scoring golden tests ."""
import json

import pytest
from pyspark.sql import functions as F

from sparkaudit.operators import triage as T
from sparkaudit.operators.dims import _grams, contains_join, rarest_grams
from sparkaudit.operators.ranking import in_ranges, with_position


def _raw(spark, recs):
    rows = [(i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(recs)]
    return T.normalize_paths(spark.createDataFrame(rows, "ord long, raw string"))


def test_fp_filter_sanity(spark):
    paths = _raw(spark, [
        {"entry_file": "/srv/shop/tests/CartSpec.php", "score": 7, "sink": {"name": "mysqli_query"}},
        {"entry_file": "/srv/shop/controller/CartController.php", "score": 6, "sink": {"name": "mysqli_query"}},
    ])
    d = T.fp_decision(paths)
    s = T.fp_filter_summary(d).collect()[0]
    assert (s.removed_count, s.pass_count) == (1, 1)
    got = {r.entry_file: (r.fp_decision, r.fp_reason) for r in d.collect()}
    assert got["/srv/shop/tests/CartSpec.php"] == ("skip", "test_or_migration_file")
    assert got["/srv/shop/controller/CartController.php"] == ("pass", "no_structural_fp_matched")


def test_fp_rules_order(spark):
    paths = _raw(spark, [
        {"entry_file": "/app/x.php", "score": 3},
        {"entry_file": "/app/utils/Str.php", "score": 5},
        {"entry_file": "/app/a.php", "score": 5, "query_type": "object"},
        {"entry_file": "/app/a.php", "score": 5, "sink": {"file": "/x/fixtures/s.php"}},
        "/plain/string/path.php",
    ])
    got = [(r.fp_decision, r.fp_reason) for r in T.fp_decision(paths).orderBy("ord").collect()]
    assert got == [("skip", "score_too_low:3"), ("low_priority", "utility_class_entry"),
                   ("pass", "object_path"), ("skip", "sink_in_test_file"), ("skip", "score_too_low:0")]


def test_triage_score_parts(spark):
    paths = _raw(spark, [
        {"id": "a", "entry_file": "/app/controller/PayController.php", "entry_fn": "pay",
         "sink": {"name": "DB::select", "type": "sqli"}, "tool": "semgrep",
         "source": {"type": "query"}, "path_decision": "confirmed"},
        {"id": "b", "entry_file": "/app/tests/PayTest.php", "sink": {"type": "sqli"}},
    ])
    flows = spark.createDataFrame([(0, "Pay")], "ord long, entry string")
    cx = spark.createDataFrame([(0, "controller", "DB::", "sqli"), (1, "app", "", "")],
                               "ord long, file string, sink string, vuln_type string")
    rows = {r.id: r for r in T.triage_score(paths, flows, cx).collect()}
    a = rows["a"]
    # 4 (DB_SINK) + 3 semgrep + 2 confirmed + 1 http + 2 api hint + 2 flow + 5 cx (2+2+1 stops)
    assert a.score == 19
    assert a.triage_detail["cx_boost"] == "5"
    assert rows["b"].score == -10 and rows["b"].triage_detail == {"fp": "test_file:/tests/"}


def test_cx_boost_early_stop(spark):
    paths = _raw(spark, [{"id": "a", "entry_file": "/a/b.php", "sink": {"name": "exec", "type": "rce"}}])
    cx = spark.createDataFrame([(0, "/a", None, "", "exec"), (1, "/a", "exec", "rce", None), (2, "/a", "", "rce", None)],
                               "ord long, file string, sink string, vuln_type string, sink_name string")
    out = T.triage_score(paths, None, cx).first()
    assert out.triage_detail["cx_boost"] == "9"  # 4, then 9 >= 5 stops before the third finding


def test_rank_is_top_k_stable(spark):
    recs = [{"id": f"p{i}", "entry_file": "/app/api/x.php", "sink": {"type": "rce"},
             "tool": "semgrep"} for i in range(5)]
    recs += [{"entry_file": "/app/api/y.php", "sink": {"type": "rce"}, "tool": "semgrep"}] * 3
    paths = _raw(spark, recs).withColumn("run_id", F.lit("r1"))
    both = paths.unionByName(paths.withColumn("run_id", F.lit("r2")))
    out = T.triage_rank(both).orderBy("run_id", "rank").collect()
    assert [(r.run_id, r.rank, r.id) for r in out[:6]] == [("r1", i + 1, f"p{i}") for i in range(5)] + [("r1", 6, None)]
    assert len(out) == 12  # equal records without an id are one path of their run
    first = T.triage_rank(both, max_paths=3).orderBy("run_id", "rank").collect()
    assert [r.id for r in first] == ["p0", "p1", "p2"] * 2


@pytest.mark.parametrize("rows", [3, 300])
def test_contains_join_keeps_multiplicity(spark, rows):
    left = spark.createDataFrame([("abcdef",), ("abcdef",), ("xy",), ("",), (None,)], "t string")
    pats = ["cdef", "y", "", "abcdefg", None] + [f"n{i}" for i in range(rows)] + ["cdef"]
    right = spark.createDataFrame([(i, p) for i, p in enumerate(pats)], "ord long, p string")
    got = sorted((r.t, r.p) for r in contains_join(left, right, "t", "p").collect())
    want = sorted((t, p) for t in ("abcdef", "abcdef", "xy", "") for p in pats if p is not None and p in t)
    assert got == want


def test_positions_in_a_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 100 < 99, "hot").otherwise("cold").alias("g"),
                                  (F.col("id") * 7919 % 5000).alias("ord"), (F.col("id") % 3).alias("s"))
    out = with_position(df, "n", ["g"], "ord", lead=-F.col("s")).collect()
    for g in ("hot", "cold"):
        rows = sorted((r for r in out if r.g == g), key=lambda r: (-r.s, r.ord))
        assert [r.n for r in rows] == list(range(1, len(rows) + 1))
    assert with_position(df.limit(0), "n", ["g"], "ord").count() == 0


def test_positions_with_an_outlier_and_equal_rows(spark):
    """One value lies far out and a third of the rows agree in everything; ranges still hold equally many rows."""
    df = spark.range(9000).select(
        F.when(F.col("id") % 5 == 0, "a").otherwise("b").alias("g"),
        F.when(F.col("id") == 17, F.lit(10**15)).when(F.col("id") % 3 == 0, F.lit(50)).otherwise(F.col("id")).alias("ord")).repartition(3)
    out = with_position(df, "n", ["g"], "ord", ranges=8)
    assert out.columns == ["g", "ord", "n"]
    rows = out.collect()
    for g in "ab":
        mine = sorted((r.n, r.ord) for r in rows if r.g == g)
        assert [n for n, _ in mine] == list(range(1, len(mine) + 1))
        assert [o for _, o in mine] == sorted(o for _, o in mine)
    sizes = sorted(r["count"] for r in in_ranges(df, ["g", "ord"], 8).groupBy("_range").count().collect())
    assert len(sizes) >= 6 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_patterns_under_one_folder_have_keys_of_their_own(spark):
    """10^5 patterns share their beginning; a key leads to few of them."""
    n = 100_000
    pats = spark.range(n).select(F.concat(F.lit("/srv/app/controllers/"), F.lpad(F.conv(F.col("id") * 7919 % n, 10, 36), 5, "q"), F.lit("/x.php")).alias("pat"), "id")
    keys = rarest_grams(pats, "pat")
    assert keys.count() == n
    texts = pats.where("id % 10000 = 3").select(F.concat(F.lit("/home"), "pat", F.lit(":12")).alias("text"), F.col("id").alias("want"))
    grams = texts.select(F.explode(_grams(F.col("text"), 4)).alias("_key"))
    candidates = grams.join(keys, "_key").count()
    assert candidates < 200 * texts.count()  # by their first characters all 10^5 would meet each text
    got = contains_join(texts, pats, "text", "pat").select("want", "id").collect()
    assert sorted(map(tuple, got)) == [(k, k) for k in range(3, n, 10000)]


def test_context_texts_come_from_all_records(spark, sf_small, monkeypatch):
    """The queries that score unique paths don't remove duplicates a second time to list the context texts."""
    from sparkaudit.operators import triage as T
    from sparkaudit.plans import q_triage as Q
    given, score = [], T.triage_score
    monkeypatch.setattr(T, "triage_score", lambda *a, **k: (given.append(len(a) > 3 and a[3] is not None), score(*a, **k))[1])
    for query in (Q.q_triage_score, Q.q_top_paths, Q.q_verify_queue_order):
        query(spark, sf_small)
    assert given == [True] * 3
