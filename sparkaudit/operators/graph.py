"""Call-graph operators over an edge table.

The graph is two DataFrames: ``nodes(node_id, name, file, line, type)`` and
``edges(src, dst, kind)``.  Bounded reachability is a frontier expansion.
Start keys are *names* (the lists are name lists), and what has been reached is
kept as words: a row (node, word, bits) stands for up to 64 start keys, so the
state is bounded by nodes x words, never by (start, node) pairs.  A level joins
the fresh bits with the edges, ORs what arrives at a node, takes off what earlier
levels brought there, and goes on with the bits that are new.  A frontier whose
counted size allows it is broadcast, and the edge table is then read where it
lies; earlier levels are read only at the nodes that few rows arrive at.

Edges and the fresh bits of each level are written once as Parquet (in the
cluster's ``spark.checkpoint.dir``): the edge table is built once, the per-level
count is cheap and a lost executor resumes from the last level.  Words are opened
last, after what can be gathered by name has been.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkaudit import catalogs as K
from sparkaudit.functions.core import contains_any, stable_id
from sparkaudit.operators.dims import contains_join
from sparkaudit.session import checkpointed, tidied, written


def _calls(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("kind") == "CALLS").select("src", "dst")


def edges_once(edges: DataFrame, backward: bool = False) -> DataFrame:
    """(node, next), written once.  Equal rows stay: words are ORed, so they change nothing."""
    a, b = ("dst", "src") if backward else ("src", "dst")
    return written(_calls(edges).select(F.col(a).alias("node"), F.col(b).alias("next")))


#: Start keys in a word, and frontier rows (a node, two longs) that may be broadcast.
WORD = 64
BROADCAST_FRONTIER = 500_000
#: Edges that are dealt by source at once (G5); more are dealt in several passes, so what a pass shuffles is bounded.
EDGES_A_PASS = 50_000_000


def few(df: DataFrame, most: int | None = None) -> DataFrame:
    """``df``, to be broadcast where it is counted to have few rows."""
    return F.broadcast(df) if df.count() <= (BROADCAST_FRONTIER if most is None else most) else df


def start_words(starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, id) and the starts as (node, word, bits).  Ids are consecutive within a partition, so words are filled."""
    keys = checkpointed(starts.select("key").distinct().withColumn("id", F.monotonically_increasing_id()))
    bit = F.expr(f"shiftleft(1L, cast(id % {WORD} as int))")
    words = starts.join(few(keys), "key").groupBy("node", F.expr(f"id div {WORD}").alias("word")).agg(F.bit_or(bit).alias("bits"))
    return keys, words


def reach_words(e: DataFrame, words: DataFrame, max_depth: int, broadcast_rows: int = BROADCAST_FRONTIER) -> DataFrame:
    """(node, word, fresh, depth): the start keys that reach a node at ``depth`` for the first time, depth 0 the starts."""
    fresh = written(words.select("node", "word", F.col("bits").alias("fresh")))
    none = F.lit(0).cast("long")
    seen, out = fresh, fresh.withColumn("depth", F.lit(0))
    for d in range(1, max_depth + 1):
        if fresh.isEmpty():
            break
        come = written(e.join(few(fresh, broadcast_rows), "node").groupBy(F.col("next").alias("node"), "word")
                       .agg(F.bit_or("fresh").alias("new")))
        n = come.count()
        if not n:
            break
        before = seen.join(F.broadcast(come.select("node").distinct()), "node", "left_semi") if n <= broadcast_rows else seen
        fresh = written(
            before.select("node", "word", F.col("fresh").alias("old"), none.alias("new"))
            .unionByName(come.select("node", "word", none.alias("old"), "new"))
            .groupBy("node", "word").agg(F.expr("bit_or(new) & ~bit_or(old)").alias("fresh")).where("fresh <> 0"))
        seen, out = seen.unionByName(fresh), out.unionByName(fresh.withColumn("depth", F.lit(d)))
    return out


def keys_of(reached: DataFrame, keys: DataFrame) -> DataFrame:
    """Words opened: one row for each start key, ``key`` in place of (word, fresh)."""
    bits = F.expr(f"filter(sequence(0, {WORD - 1}), i -> shiftright(fresh, i) & 1 = 1)")
    rest = [c for c in reached.columns if c not in ("word", "fresh")]
    return (reached.withColumn("bit", F.explode(bits)).withColumn("id", F.col("word") * WORD + F.col("bit"))
            .join(few(keys), "id").select("key", *rest))


def reach(edges: DataFrame, starts: DataFrame, max_depth: int, backward: bool = False,
          min_depth: int = 1, targets: DataFrame | None = None) -> DataFrame:
    """Nodes reachable from each start key within ``max_depth`` hops.

    ``starts``: (key, node).  Returns (key, node, depth) with the minimum
    depth per (key, node), depth >= ``min_depth``.  ``targets`` (node, ...):
    only these nodes, with their columns; words are opened for them alone.
    """
    return _opened(edges_once(edges, backward), starts, max_depth, min_depth, targets)


def _opened(e: DataFrame, starts: DataFrame, max_depth: int, min_depth: int, targets: DataFrame | None) -> DataFrame:
    keys, words = start_words(starts.select("key", "node"))
    reached = reach_words(e, words, max_depth).where(F.col("depth") >= min_depth)
    return keys_of(reached if targets is None else reached.join(targets, "node"), keys)


def _reach_names(e: DataFrame, starts: DataFrame, names: DataFrame, max_depth: int) -> DataFrame:
    """(key, name, depth) for the names of the nodes reached, minimum depth: words meet by name before they are opened."""
    keys, words = start_words(starts)
    by_name = (reach_words(e, words, max_depth).where("depth >= 1").join(names, "node")
               .groupBy("name", "word", "depth").agg(F.bit_or("fresh").alias("fresh")))
    return keys_of(by_name, keys).groupBy("key", "name").agg(F.min("depth").alias("depth"))


def _named(nodes: DataFrame, names) -> DataFrame:
    """Nodes whose name is in ``names`` (list or DataFrame(name))."""
    if isinstance(names, DataFrame):
        return nodes.join(few(checkpointed(names.select("name").distinct())), "name", "left_semi")
    return nodes.where(F.col("name").isin(list(names)))


def paths_entry_and_sink(nodes: DataFrame, edges: DataFrame, entries, sinks,
                         max_depth: int = 6, limit: int | None = None) -> DataFrame:
    """G1: distinct (entry name, sink name) with the minimum depth."""
    starts = _named(nodes, entries).select(F.col("name").alias("key"), F.col("node_id").alias("node"))
    sink_nodes = few(written(_named(nodes, sinks).select(F.col("node_id").alias("node"), F.col("name").alias("sink"))))
    out = (reach(edges, starts, max_depth, targets=sink_nodes).groupBy(F.col("key").alias("entry"), "sink")
           .agg(F.min("depth").alias("depth")))
    return out.orderBy("depth", "entry", "sink").limit(limit) if limit else out


def paths_to_sink(nodes: DataFrame, edges: DataFrame, sinks, max_depth: int = 5) -> DataFrame:
    """Callers (node, name, file) reaching a named sink within depth.  Nodes are joined while words are closed."""
    starts = _named(nodes, sinks).select(F.col("name").alias("key"), F.col("node_id").alias("node"))
    callers = nodes.select(F.col("node_id").alias("node"), "name", "file")
    return reach(edges, starts, max_depth, backward=True, targets=callers).select(
        F.col("key").alias("sink"), F.col("node").alias("caller_id"), F.col("name").alias("caller"), "file", "depth")


def paths_broad(nodes: DataFrame, edges: DataFrame, entries, sinks, max_depth: int = 5) -> DataFrame:
    """Entry in list OR sink in list; (from_name, to_name, min depth).

    Union of a forward expansion from the entries and a backward expansion
    from the sinks -- never an all-pairs closure -- over one table of edges."""
    names = nodes.select(F.col("node_id").alias("node"), "name")
    ahead = edges_once(edges)
    back = ahead.select(F.col("next").alias("node"), F.col("node").alias("next"))

    def starts(some):
        return _named(nodes, some).select(F.col("name").alias("key"), F.col("node_id").alias("node"))
    fwd = _reach_names(ahead, starts(entries), names, max_depth).select(
        F.col("key").alias("from_name"), F.col("name").alias("to_name"), "depth")
    bwd = _reach_names(back, starts(sinks), names, max_depth).select(
        F.col("name").alias("from_name"), F.col("key").alias("to_name"), "depth")
    return fwd.unionByName(bwd).groupBy("from_name", "to_name").agg(F.min("depth").alias("depth"))


def paths_domain(nodes: DataFrame, edges: DataFrame, domains: DataFrame, hints: DataFrame,
                 max_depth: int = 6) -> DataFrame:
    """Per domain, start nodes whose file contains the domain, sinks in
    that domain's hint list.  ``domains``: (domain); ``hints``: (domain, name).

    Containment is decided on distinct files.
    """
    named = few(written(nodes.join(few(checkpointed(hints)), "name").select(
        F.col("node_id").alias("node"), F.col("domain").alias("key"), F.col("name").alias("sink")).distinct()))
    wanted = domains.select("domain").distinct().join(hints.select("domain").distinct(), "domain", "left_semi")
    files = written(contains_join(nodes.select(F.lower("file").alias("lfile")).distinct(), wanted, "lfile", "domain"))
    starts = nodes.withColumn("lfile", F.lower("file")).join(few(files), "lfile").select(
        F.col("domain").alias("key"), F.col("node_id").alias("node"))
    return (reach(edges, starts, max_depth, targets=named.select("node").distinct()).join(named, ["key", "node"])
            .groupBy(F.col("key").alias("domain"), "sink").agg(F.min("depth").alias("depth")))


def paths_with_chain(nodes: DataFrame, edges: DataFrame, file_token: str, sinks,
                     max_depth: int = 8) -> DataFrame:
    """Trails from nodes whose file contains ``file_token`` to named
    sinks, with the call chain (node names).

    A trail repeats no edge, but may pass a node again; two rows of ``edges``
    between the same nodes are two edges and give two trails, and a trail may go
    on beyond a sink to a further one.  A node without a row in ``nodes`` is
    passed, but has no name in the chain.

    Trails are halves that meet at a node: beginnings from the starts and ends
    at the sinks.  How many walks there are of each length is summed by node
    first; it tells the longest trail, and the half that has fewer rows is made
    longer.  The longest ends lack their first edge, which is joined last: ends
    that are counted to be few are broadcast then, and only (node, next) of the
    edges that lead to them is shuffled.  Whole trails go straight to the caller.

    Beyond a trail's first edge only edges whose source is called itself matter,
    so the edges are dealt by source once, in passes of bounded size, and all else
    is done on those.  Only
    where some such node has walks of different lengths to the sinks can an edge
    come twice; edge numbers are carried then, and halves share none.
    """
    with tidied(edges.sparkSession):
        return _trails(nodes, edges, file_token, sinks, max_depth)


def _chained(*names: str) -> F.Column:
    """Names or chains put together; null only where all are null."""
    return F.when(F.coalesce(*names).isNotNull(), F.concat_ws(" -> ", *names))


def _trails(nodes: DataFrame, edges: DataFrame, file_token: str, sinks, max_depth: int) -> DataFrame:
    calls = written(_calls(edges).select(F.col("src").alias("node"), F.col("dst").alias("next")))
    called = calls.select(F.col("next").alias("node")).distinct().withColumn("called", F.lit(True))
    known = written(
        nodes.select(F.col("node_id").alias("node"), "name", F.col("file").contains(file_token).alias("start"))
        .join(called, "node", "full")
        .select("node", "name", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("start", "called")]).where("start or called"))
    passes, steps = 1 + calls.count() // EDGES_A_PASS, None
    for k in range(passes):
        mine = F.pmod(F.xxhash64("node"), F.lit(passes)) == k
        some = written(calls.where(mine).join(few(known.where(mine)), "node").withColumn(
            "edge", F.when(F.col("called"), F.monotonically_increasing_id() * passes + k)))
        steps = some if steps is None else steps.unionByName(some)
    inner = steps.where("called").select("node", "name", "next", "edge")
    begins = steps.where(F.col("start") & F.lit(max_depth > 0)).select(
        F.col("node").alias("start"), F.col("next").alias("node"), F.col("name").alias("chain"), "edge")
    sink_ids = few(written(_named(nodes, sinks).select(F.col("node_id").alias("node"), F.col("name").alias("sink")).distinct()))

    # walks of each length from a node to a sink; what no inner edge leads to is not gone back from
    reached = few(written(inner.select(F.col("next").alias("node")).distinct()))
    level = sink_ids.select("node", F.lit(1.0).alias("n"))
    back, near, n_back = [level], level.select("node", F.lit(0).alias("rest")), [0.0]
    while len(back) < max_depth:
        before = written(inner.join(few(level.withColumnRenamed("node", "next")), "next").groupBy("node").agg(F.sum("n").alias("n")))
        total = before.agg(F.sum("n")).first()[0]
        if total is None:
            break
        back.append(before)
        n_back.append(total)
        level = written(before.join(reached, "node", "left_semi"))
        near = near.unionByName(level.select("node", F.lit(len(back) - 1).alias("rest")))
    walks = written(begins.groupBy("node").agg(F.count(F.lit(1)).cast("double").alias("n")))
    longest = len(back)
    while longest > 1 and back[longest - 1].join(walks, "node", "left_semi").isEmpty():
        longest -= 1
    near = written(near.where(F.col("rest") < longest).groupBy(F.col("node").alias("next")).agg(F.min("rest").alias("rest"), F.max("rest").alias("most")))
    twice = not near.where("most > rest").isEmpty()  # an edge may come twice
    near = near.drop("most")
    inner = inner.join(F.broadcast(near), "next") if near.count() <= BROADCAST_FRONTIER else written(inner.join(near, "next"))

    def ahead(walks):
        return written(walks.join(inner, "node").groupBy(F.col("next").alias("node")).agg(F.sum("n").alias("n")))

    at_first, at_last, size = 1, 0, walks.agg(F.sum("n")).first()[0] or 0.0
    further = None  # walks one step longer than the beginnings
    while at_first + at_last < longest:
        if n_back[at_last + 1] > size:
            further = ahead(walks) if further is None else further
            more = further.agg(F.sum("n")).first()[0] or 0.0
            if more < n_back[at_last + 1]:
                at_first, walks, size, further = at_first + 1, further, more, None
                continue
        at_last += 1

    none = F.array().cast("array<bigint>")

    def unused(numbers):  # by the edge that is joined
        return ~F.array_contains(numbers, F.col("edge")) if twice else F.lit(True)

    def prefixed(joined):  # ends one edge longer, by their first node
        return joined.where(unused("used")).select(
            "node", (F.concat(F.array("edge"), "used") if twice else none).alias("used"), _chained("name", "tail").alias("tail"),
            "sink", (F.col("length") + 1).alias("length"))

    def at_sink(begins, d):
        return begins.join(sink_ids, "node").select("start", "sink", F.lit(d).alias("depth"), _chained("chain", "sink").alias("call_chain"))

    begins = begins.select("start", "node", "chain", (F.array_compact(F.array("edge")) if twice else none).alias("trail"))
    met = at_sink(begins, 1)
    for d in range(2, at_first + 1):
        begins = begins.join(inner, "node").where((F.col("rest") <= longest - d) & unused("trail")).select(
            "start", F.col("next").alias("node"), _chained("chain", "name").alias("chain"),
            (F.concat("trail", F.array("edge")) if twice else none).alias("trail"))
        if d < at_first:  # the last ones are met by ends
            begins = written(begins)
        met = met.unionByName(at_sink(begins, d))
    if not at_last:
        return met

    short = end = sink_ids.select("node", none.alias("used"), F.col("sink").alias("tail"), "sink", F.lit(0).alias("length"))
    for j in range(1, at_last):
        end = written(prefixed(inner.join(few(end.withColumnRenamed("node", "next")), "next")))
        short = short.unionByName(end)
    begins = F.broadcast(begins) if size <= BROADCAST_FRONTIER else begins
    last, short = inner.where(F.col("rest") < at_last).drop("rest"), short.withColumnRenamed("node", "next")
    if short.count() <= BROADCAST_FRONTIER:
        whole = begins.join(last, "node").where(unused("trail")).join(F.broadcast(short), "next").where(unused("used")).withColumn("length", F.col("length") + 1)
    else:  # the edge is put on before they meet
        whole = begins.join(prefixed(last.join(short, "next")).withColumn("name", F.lit(None).cast("string")), "node")
    if twice:
        whole = whole.where(~F.arrays_overlap("trail", "used"))
    return met.unionByName(whole.select(
        "start", "sink", (F.col("length") + at_first).cast("int").alias("depth"), F.concat_ws(" -> ", "chain", "name", "tail").alias("call_chain")))


def fan_in(nodes: DataFrame, edges: DataFrame, min_callers: int = K.MIN_CALLERS,
           known=K.KNOWN_SINKS_GRAPH) -> DataFrame:
    """Functions with >= min_callers distinct callers (skip test/vendor
    files and known sinks); MEDIUM at >= 5 callers else LOW."""
    cnt = _calls(edges).groupBy("dst").agg(F.countDistinct("src").alias("caller_count"))
    fn = nodes.where(~contains_any(F.lower(F.col("file")), K.FAN_IN_SKIP) & ~F.col("name").isin(list(known)))
    out = cnt.where(F.col("caller_count") >= min_callers).join(fn, cnt.dst == fn.node_id)
    return out.select(
        stable_id(10, "file", "name").alias("id"),
        F.col("name").alias("sink_name"), "file", "line", F.col("caller_count").cast("long").alias("caller_count"),
        F.when(F.col("caller_count") >= 5, "MEDIUM").otherwise("LOW").alias("confidence"))


def wrapper_discovery(nodes: DataFrame, edges: DataFrame, known=K.KNOWN_SINKS_GRAPH) -> DataFrame:
    """Functions under ``src/`` calling a known sink, not themselves known;
    calls counted per (wrapper, file, line, wrapped sink)."""
    from sparkaudit.operators.classify import vuln_from_known_sink
    known_n = nodes.where(F.col("name").isin(list(known))).select(
        F.col("node_id").alias("dst"), F.col("name").alias("wraps"))
    wrappers = nodes.where(F.col("file").contains("src/") & ~F.col("name").isin(list(known))).select(
        F.col("node_id").alias("src"), F.col("name").alias("name"), "file", "line")
    j = _calls(edges).join(known_n, "dst").join(wrappers, "src")
    g = j.groupBy("name", "file", "line", "wraps").agg(F.count(F.lit(1)).alias("call_count"))
    return g.select(stable_id(10, "file", "name").alias("id"),
                    "name", "wraps", "file", "line", F.col("call_count").cast("long").alias("call_count"),
                    vuln_from_known_sink(F.col("wraps")).alias("vuln_type"))


def handler_path_tokens(files: DataFrame, file_col: str = "file") -> DataFrame:
    """distinct lower directory segments (len > 2, not generic, not
    test/vendor, not hidden); the fallback tokens when none survive."""
    parts = F.split(F.regexp_replace(F.col(file_col), r"\\", "/"), "/")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    seg = files.select(F.explode(dirs).alias("seg")).select(F.lower("seg").alias("token"))
    skip = K.FLOW_TOPIC_SKIP + K.SCAN_SKIP_DIRS
    toks = seg.where((F.length("token") > 2) & ~F.col("token").isin(skip)
                     & ~F.col("token").startswith(".")).distinct()
    fallback = files.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(t) for t in K.ENDPOINT_FALLBACK_TOKENS])).alias("token"))
    return toks.unionByName(fallback.where(toks.select(F.count(F.lit(1))).scalar() == 0))


def endpoint_middleware(nodes: DataFrame, edges: DataFrame, tokens: DataFrame) -> DataFrame:
    """Handlers whose file contains a token; callers whose name contains
    auth/middleware/guard/jwt/permission (case-sensitive) collected."""
    files = contains_join(nodes.select(F.lower("file").alias("lfile")).distinct(), tokens.select("token").distinct(),
                          "lfile", "token").select("lfile").distinct()
    handlers = nodes.withColumn("lfile", F.lower("file")).join(files, "lfile", "left_semi").drop("lfile")
    mids = nodes.where(contains_any(F.col("name"), K.MIDDLEWARE_WORDS)).select(
        F.col("node_id").alias("src"), F.col("name").alias("mw"))
    calls = _calls(edges).join(mids, "src").select(F.col("dst").alias("node_id"), "mw")
    j = handlers.join(calls, "node_id", "left")
    g = j.groupBy("node_id", "name", "file", "line").agg(
        F.array_sort(F.collect_set("mw")).alias("auth_middleware"))
    return g.select(stable_id(10, "file", "name").alias("id"),
                    F.col("name").alias("handler_fn"), "file", "line", "auth_middleware",
                    (F.size("auth_middleware") > 0).alias("auth_required"))


def direct_callers(nodes: DataFrame, edges: DataFrame, callee_names) -> DataFrame:
    """One-hop callers of named functions."""
    callee = _named(nodes, callee_names).select(F.col("node_id").alias("dst"), F.col("name").alias("callee"))
    caller = nodes.select(F.col("node_id").alias("src"), F.col("name").alias("caller"),
                          F.col("file").alias("caller_file"))
    return _calls(edges).join(callee, "dst").join(caller, "src").select("callee", "caller", "caller_file")


def auth_symbols(nodes: DataFrame) -> DataFrame:
    """F15."""
    return nodes.where(F.col("name").rlike(K.AUTH_SYMBOL_RE))


def unscoped_tenant_access(nodes: DataFrame) -> DataFrame:
    """F16."""
    return nodes.where(F.col("file").contains("Repository") & ~F.col("name").contains("company_id")
                       & ~F.col("name").contains("tenant_id"))


def sink_name_discovery(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct called functions whose name looks like a sink."""
    called = _calls(edges).select(F.col("dst").alias("node_id")).distinct()
    return nodes.join(called, "node_id", "left_semi").where(F.col("name").rlike(K.SINK_NAME_RE)).select(
        "name").distinct()


def empty_result_diagnostic(nodes: DataFrame, result: DataFrame) -> DataFrame:
    """Is the graph empty, or did the query just match nothing?"""
    n = nodes.agg(F.count(F.lit(1)).alias("node_count"))
    rc = result.select(F.count(F.lit(1))).scalar()
    return n.withColumn("result_count", rc).select(
        F.col("node_count").cast("long"), F.col("result_count").cast("long"),
        F.when(F.col("result_count") > 0, "ok").when(F.col("node_count") == 0, "graph_empty")
        .otherwise("no_match").alias("status"))
