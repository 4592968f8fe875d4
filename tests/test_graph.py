"""Bounded reachability against a brute-force BFS on a small graph."""
import random
from collections import deque

from sparkaudit.operators import graph as G
from sparkaudit.operators import surface as W


def test_reach_matches_bfs(spark):
    rnd = random.Random(7)
    n = 40
    edges = sorted({(f"v{rnd.randrange(n)}", f"v{rnd.randrange(n)}") for _ in range(90)})
    e = spark.createDataFrame([(a, b, "CALLS") for a, b in edges], "src string, dst string, kind string")
    starts = spark.createDataFrame([("k", "v0"), ("k", "v1"), ("j", "v5")], "key string, node string")
    got = {(r.key, r.node): r.depth for r in G.reach(e, starts, 4).collect()}
    adj = {}
    for a, b in edges:
        adj.setdefault(a, []).append(b)
    want = {}
    for key, seeds in {"k": ["v0", "v1"], "j": ["v5"]}.items():
        dist = {s: 0 for s in seeds}
        dq = deque(seeds)
        while dq:
            u = dq.popleft()
            if dist[u] == 4:
                continue
            for w in adj.get(u, []):
                if w not in dist:
                    dist[w] = dist[u] + 1
                    dq.append(w)
        for v, d in dist.items():
            if d >= 1:
                want[(key, v)] = d
    assert got == want


def trails(edges, starts, sinks, depth):
    """Every path that repeats no edge, by walking the numbered edges."""
    out, work = [], [(s, s, (), (s,)) for s in starts]
    while work:
        start, at, used, chain = work.pop()
        for k, (a, b) in enumerate(edges):
            if a == at and k not in used and len(used) < depth:
                if b in sinks:
                    out.append((start, b, len(used) + 1, " -> ".join((*chain, b))))
                work.append((start, b, (*used, k), (*chain, b)))
    return sorted(out)


def graph_of(spark, pairs, files):
    e = spark.createDataFrame([(a, b, "CALLS") for a, b in pairs] + [(pairs[0][0], "eval", "IMPORTS")], "src string, dst string, kind string")
    ids = sorted({v for p in pairs for v in p} | {"eval"})
    n = spark.createDataFrame([(v, v, files.get(v, "/src/x.py"), 1, "Method") for v in ids], "node_id string, name string, file string, line int, type string")
    return n, e


def test_trails_may_pass_a_node_again(spark):
    """x -> y -> x -> eval repeats no edge; parallel edges and a self-loop give further trails."""
    pairs = [("x", "y"), ("y", "x"), ("x", "eval"), ("x", "eval"), ("y", "y"), ("eval", "x")]
    nodes, edges = graph_of(spark, pairs, {"x": "/app/controller/x.py"})
    got = sorted(map(tuple, G.paths_with_chain(nodes, edges, "controller", ["eval"], 6).collect()))
    assert got == trails(pairs, ["x"], {"eval"}, 6)
    assert sum(c == "x -> y -> x -> eval" for *_, c in got) == 2


def test_trails_match_a_walk_on_random_graphs(spark):
    rnd = random.Random(11)
    pairs = [(f"v{rnd.randrange(6)}", f"v{rnd.randrange(6)}") for _ in range(11)] + [("v1", "eval"), ("v2", "eval"), ("eval", "v0")]
    nodes, edges = graph_of(spark, pairs, {"v0": "/controller/a", "v3": "/controller/b"})
    want = trails(pairs, [v for v in ("v0", "v3") if any(v in p for p in pairs)], {"eval"}, 6)
    assert sorted(map(tuple, G.paths_with_chain(nodes, edges, "controller", ["eval"], 6).collect())) == want and want


def test_many_starts_in_words(spark):
    """Over three words of start keys; broadcast and joined frontiers give the same words, and a row covers many starts."""
    chain = [(f"a{i}", "hub") for i in range(200)] + [("hub", "t1"), ("t1", "t2"), ("t2", "hub")]
    e = spark.createDataFrame(chain, "node string, next string")
    starts = spark.createDataFrame([(f"k{i}", f"a{i}") for i in range(200)], "key string, node string").coalesce(1)
    keys, words = G.start_words(starts)
    near, far = (G.reach_words(e, words, 4, bound) for bound in (10**6, 0))
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, far.collect()))
    assert near.where("node = 't2'").count() <= 200 // G.WORD + 1 + keys.rdd.getNumPartitions()
    assert {(r.key, r.depth) for r in G.keys_of(near.where("node = 't2'"), keys).collect()} == {(f"k{i}", 3) for i in range(200)}


def test_trails_write_only_halves(spark, monkeypatch):
    """A hub between many starts and many ends: whole trails are not written, only the two halves."""
    rows = []

    def counted(df):
        rows.append(df.count())
        return df

    monkeypatch.setattr(G, "checkpointed", counted)
    monkeypatch.setattr(G, "written", counted, raising=False)
    pairs = [(f"s{i}", "hub") for i in range(40)] + [("hub", f"m{i}") for i in range(40)] + [(f"m{i}", "eval") for i in range(40)]
    nodes, edges = graph_of(spark, pairs, {f"s{i}": "/controller/s" for i in range(40)})
    assert G.paths_with_chain(nodes, edges, "controller", ["eval"], 8).count() == 1600
    assert max(rows) <= len(pairs)


def test_topic_flows_match_a_walk(spark):
    """Cycles and self-calls count, names repeat, over two words of names; only the first eight are kept."""
    rnd = random.Random(5)
    ids = [f"v{i}" for i in range(160)]
    name = {v: rnd.choice(["runGuard", "exec", "plain"]) + str(i % 90) for i, v in enumerate(ids)}
    pairs = sorted({(rnd.choice(ids), rnd.choice(ids)) for _ in range(240)} | {("v0", "v0"), ("v1", "v2"), ("v2", "v1")} | {("v3", v) for v in ids[4:150]})
    nodes = spark.createDataFrame([(v, name[v], f"/{v}", 1, "Method") for v in ids], "node_id string, name string, file string, line int, type string")
    edges = spark.createDataFrame([(a, b, "CALLS") for a, b in pairs], "src string, dst string, kind string")
    want = {}
    for v in ids:
        level, called = {v}, set()
        for _ in range(3):
            level = {b for a, b in pairs if a in level}
            called |= {name[w] for w in level}
        for t in ("guard", "exec"):
            some = sorted(c for c in called if t in name[v].lower() or t in c.lower())
            if some:
                want[t, f"/{v}"] = some[:8]
    topics = spark.createDataFrame([("guard",), ("exec",)], "topic string")
    assert {(r.topic, r.file): r.related for r in W.topic_flows(nodes, edges, topics, 3).collect()} == want


def test_names_meet_before_words_are_opened(spark, monkeypatch):
    """Many callers share a name: what is opened grows with the names, not with the callers, and equal edges change nothing."""
    opened = []
    keys_of = G.keys_of

    def counted(reached, keys):
        opened.append(reached.count())
        return keys_of(reached, keys)

    monkeypatch.setattr(G, "keys_of", counted)
    pairs = [(f"h{i}", "mid") for i in range(300)] + [("mid", "eval"), ("eval", "h0")]
    edges = spark.createDataFrame([(a, b, "CALLS") for a, b in pairs * 2], "src string, dst string, kind string")
    nodes = spark.createDataFrame([(f"h{i}", f"handle{i % 3}", "/controller/x", 1, "Method") for i in range(300)]
                                  + [("mid", "mid", "/m", 1, "Method"), ("eval", "eval", "/e", 1, "Function")],
                                  "node_id string, name string, file string, line int, type string")
    entries = nodes.where("file = '/controller/x'").select("name")
    got = {(r.from_name, r.to_name): r.depth for r in G.paths_broad(nodes, edges, entries, ["eval"], 5).collect()}
    want = {(f"handle{i}", t): d for i in range(3) for t, d in (("mid", 1), ("eval", 2))} | {("mid", "eval"): 1}
    want |= {("handle1", "handle0"): 3, ("handle2", "handle0"): 3}
    assert got == want
    assert max(opened) < 40


def test_few_start_keys_are_not_dealt_by_key(spark):
    """Words are opened and starts numbered by a broadcast of the few keys: no task gets all rows of one key."""
    e = spark.createDataFrame([(f"a{i}", "b") for i in range(50)], "node string, next string")
    starts = spark.createDataFrame([("k", f"a{i}") for i in range(50)], "key string, node string")
    keys, words = G.start_words(starts)
    plan = G.keys_of(G.reach_words(e, words, 2), keys)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
