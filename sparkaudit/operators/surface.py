"""Surface scan, domain words, topics and work selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkaudit import catalogs as K
from sparkaudit import catalogs_surface as S
from sparkaudit.operators import graph as G
from sparkaudit.operators import models as M
from sparkaudit.operators.dims import contains_join
from sparkaudit.operators.ranking import with_position
from sparkaudit.operators.rollup import split_camel
from sparkaudit.session import checkpointed


def _sources(files: DataFrame) -> DataFrame:
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    skip = F.array(*[F.lit(d) for d in K.SCAN_SKIP_DIRS])
    return files.where(ext.isin(*S.SURFACE_EXTS) & ~F.arrays_overlap(F.split("path", "/"), skip))


def surface_functions(files: DataFrame) -> DataFrame:
    """(id, repo, name, file, line, layer, confidence): every function of files in an application layer."""
    low = F.lower("path")
    layer = F.array_compact(F.array(*[F.when(low.contains(t), F.struct(F.lit(x).alias("layer"), F.lit(c).alias("confidence")))
                                      for t, x, c in S.LAYERS]))
    tagged = _sources(files).withColumn("l", F.try_element_at(layer, F.lit(1))).where("l is not null")
    names = F.struct("repo", "path", "l")
    found = M.function_defs(tagged.withColumn("place", F.to_json(names)), path_col="place")
    place = F.from_json("file", "repo string, path string, l struct<layer:string,confidence:string>")
    out = found.withColumn("p", place).select("p.repo", "p.path", "p.l.layer", "p.l.confidence", "line", "name")
    uid = F.substring(F.md5(F.concat_ws(":", "path", F.col("line").cast("string"), "name")), 1, 10)
    return out.select(uid.alias("id"), "repo", "name", F.col("path").alias("file"), "line", "layer", "confidence").dropDuplicates(
        ["repo", "id"])


def _domain_word(word: Column, *skips: list[str]) -> Column:
    return (F.length(word) > 3) & ~word.isin(*[w for s in skips for w in s])


def domain_keywords(files: DataFrame) -> DataFrame:
    """Distinct (repo, keyword) from class and struct names and from route literals."""
    src = _sources(files).where(~F.substring_index("path", "/", -1).startswith("."))
    names = src.select("repo", F.explode(F.concat(*[
        F.regexp_extract_all("content", F.lit(p), 1) for p in (S.CLASS_DEF_RE, S.GO_STRUCT_RE)])).alias("name")).distinct()
    words = names.select("repo", F.explode(F.transform(split_camel(F.col("name")), F.lower)).alias("keyword"))
    routes = src.select("repo", F.explode(F.regexp_extract_all("content", F.lit(S.ROUTE_STR_RE), 1)).alias("route")).distinct()
    segments = routes.select("repo", F.explode(F.split("route", "/")).alias("s")).select(
        "repo", F.lower(F.regexp_replace("s", "[^a-zA-Z0-9_]", "")).alias("keyword"))
    word = F.col("keyword")
    return (words.where(_domain_word(word, S.CLASS_LAYER_SUFFIXES, K.FLOW_TOPIC_SKIP)).unionByName(
        segments.where(_domain_word(word, S.CLASS_LAYER_SUFFIXES, K.FLOW_TOPIC_SKIP, S.ROUTE_VERB_SKIP))).distinct())


def flow_topics(files: DataFrame, extra: DataFrame | None = None, env: DataFrame | None = None) -> DataFrame:
    """(repo, topic, rank): distinct topics by where they come from first: the caller (0), the
    environment (1), folders (2), code (3).  ``extra`` and ``env``: (repo, topic)."""
    parts = F.split("path", "/")
    dirs = files.select("repo", F.explode(F.slice(parts, 1, F.size(parts) - 1)).alias("topic")).where(
        ~F.col("topic").startswith(".") & (F.length("topic") > 3))
    out = None
    for rank, df in ((0, extra), (1, env), (2, dirs), (3, domain_keywords(files).select("repo", F.col("keyword").alias("topic")))):
        if df is not None:
            df = df.select("repo", F.lower(F.regexp_replace("topic", "[^a-zA-Z0-9_]", "")).alias("topic"), F.lit(rank).alias("rank"))
            out = df if out is None else out.unionByName(df)
    return out.where((F.length("topic") > 2) & ~F.col("topic").isin(*K.FLOW_TOPIC_SKIP)).groupBy("repo", "topic").agg(
        F.min("rank").alias("rank"))


def topic_flows(nodes: DataFrame, edges: DataFrame, topics: DataFrame, max_depth: int = 4, related: int = 8) -> DataFrame:
    """(topic, flow, function, file, line, related): functions with a call path of 1..max_depth steps where
    their own or the called name contains the topic; the first ``related`` called names in order.

    Names meet topics by keyed containment on distinct names.  What is handed from a node to its callers is the set
    of called *names* in words of 64 (see ``graph``), never pairs of functions: the names that carry a topic over all
    edges, and every name over the edges that start at a function which one that carries a topic reaches.
    """
    named = contains_join(nodes.select(F.lower("name").alias("low")).distinct(), topics.select("topic").distinct(), "low", "topic")
    hits = checkpointed(nodes.withColumn("low", F.lower("name")).join(named, "low").select("topic", F.col("node_id").alias("node"), "name"))
    back = G.edges_once(edges, backward=True)
    tagged = _first_called(back, hits.select(F.col("topic").alias("under"), "node", F.col("name").alias("called")), max_depth, related)

    one = hits.select("node", F.lit(0).cast("long").alias("word"), F.lit(1).cast("long").alias("bits")).distinct()
    ahead = checkpointed(G.reach_words(back.select(F.col("next").alias("node"), F.col("node").alias("next")), one, max_depth)
                         .select("node").distinct())
    inside = checkpointed(back.join(ahead.withColumnRenamed("node", "next"), "next", "left_semi").select("node", "next"))
    every = nodes.select(F.lit("").alias("under"), F.col("node_id").alias("node"), F.col("name").alias("called"))
    own = _first_called(inside, every.join(ahead, "node", "left_semi"), max_depth, related)
    own = own.drop("under").join(hits.select("node", F.col("topic").alias("under")).distinct(), "node").select("node", "under", "first")

    few = tagged.unionByName(own).groupBy("node", "under").agg(
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("first")))), 1, related).alias("related"))
    return few.join(nodes.select(F.col("node_id").alias("node"), F.col("name").alias("function"), "file", "line"), "node").select(
        F.col("under").alias("topic"), F.concat(F.initcap("under"), F.lit("Flow")).alias("flow"), "function", "file", "line", "related")


def _first_called(back: DataFrame, seeds: DataFrame, max_depth: int, n: int) -> DataFrame:
    """(node, under, first): of the names of ``seeds`` (under, node, called) that a node reaches by 1..max_depth calls,
    the first ``n`` in order.  ``back``: (node, next), from a function to its callers.

    Names are numbered in their order, so the words of a node hold its names in order.
    """
    ranked = with_position(seeds.select("under", "called").distinct(), "pos", ["under"], "called")
    words = checkpointed(ranked.withColumn("part", F.expr(f"(pos - 1) div {G.WORD}")).groupBy("under", "part").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "called"))), lambda s: s["called"]).alias("names"))
        .withColumn("word", F.monotonically_increasing_id()))
    bits = words.select("under", "word", F.posexplode("names").alias("bit", "called"))
    start = seeds.join(bits, ["under", "called"]).groupBy("node", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    callers = back.join(start, "node").groupBy(F.col("next").alias("node"), "word").agg(F.bit_or("bits").alias("bits"))
    reached = G.reach_words(back, callers, max_depth - 1).groupBy("node", "word").agg(F.bit_or("fresh").alias("bits"))
    set_bits = F.filter(F.sequence(F.lit(0), F.lit(G.WORD - 1)), lambda i: F.expr("1L") == F.call_function("getbit", F.col("bits"), i))
    here = F.transform(F.slice(set_bits, 1, n), lambda i: F.get("names", i))
    return reached.join(words, "word").select("node", "under", "part", here.alias("here")).groupBy("node", "under").agg(
        F.slice(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "here"))), lambda s: s["here"])), 1, n).alias("first"))


# --- J8, J10, A14, U9 ------------------------------------------------------------------
def label_cross_catalog(**lists: DataFrame) -> DataFrame:
    """(list, source, name) of the given name lists: api_entry_points, semgrep_sink_names, ctx_api_names, ctx_custom_sinks."""
    source = {"api_entry_points": "api_parse", "semgrep_sink_names": "semgrep", "ctx_api_names": "context",
              "ctx_custom_sinks": "context"}
    out = None
    for name, df in lists.items():
        part = df.select(F.lit(name).alias("list"), F.lit(source[name]).alias("source"), "name")
        out = part if out is None else out.unionByName(part)
    return out


def trace_guide(sinks: DataFrame, entry_points: DataFrame) -> DataFrame:
    """(file, sinks, action) of HIGH and MEDIUM sinks, only where there are no entry points."""
    none = entry_points.select(F.count(F.lit(1))).scalar() == 0
    named = sinks.where(F.col("confidence").isin("HIGH", "MEDIUM") & (F.col("file") != "") & (F.col("name") != "") & none)
    return named.select("file", "name").distinct().groupBy("file").agg(F.array_sort(F.collect_list("name")).alias("sinks")).withColumn(
        "action", F.lit("read file, find callers of each sink, trace taint path to entry point"))


def traversal_targets(entries: DataFrame, sinks: DataFrame, custom: DataFrame, domains: DataFrame, notes: DataFrame,
                      max_entries: int = 30, max_sinks: int = 30, max_custom: int = 20, max_domains: int = 5) -> DataFrame:
    """(label, priority, reason) of the traversals to run; the limits are the plan's size.

    ``entries``, ``sinks``, ``custom``: (name) distinct; ``domains``: flow domains; ``notes``: (note).
    """
    def size(df, most):
        return F.least(df.select(F.count_distinct("name")).scalar(), F.lit(most)).cast("string")

    one = domains.sparkSession.range(1)
    n_in, n_out, n_own = size(entries, max_entries), size(sinks, max_sinks), size(custom, max_custom)
    multi = notes.select(F.coalesce(F.max(F.lower("note").contains("tenant")), F.lit(False))).scalar()
    fixed = one.select(F.explode(F.array(
        F.struct(F.lit("cross_catalog").alias("label"), F.lit("HIGH").alias("priority"),
                 F.concat(F.lit(""), n_in, F.lit(" entries + "), n_out, F.lit(" sinks from 4 sources")).alias("reason"),
                 ((n_in != "0") | (n_out != "0")).alias("wanted")),
        F.struct(F.lit("custom_sinks").alias("label"), F.lit("HIGH").alias("priority"),
                 F.concat(n_own, F.lit(" custom sinks (context + gitnexus discovery)")).alias("reason"), (n_own != "0").alias("wanted")),
        F.struct(F.lit("auth_symbols").alias("label"), F.lit("MEDIUM").alias("priority"),
                 F.lit("Auth/JWT/guard/middleware symbol discovery").alias("reason"), F.lit(True).alias("wanted")),
        F.struct(F.lit("tenant_scope").alias("label"), F.lit("HIGH").alias("priority"),
                 F.lit("Multi-tenant detected — check missing tenant_id/company_id scoping").alias("reason"), multi.alias("wanted")),
    )).alias("t")).select("t.*").where("wanted").drop("wanted")
    top = domains.where((F.size("sink_hints") > 0) & (F.col("domain") != "")).orderBy(
        F.desc(F.size("risk_signals")), F.desc(F.size("sink_hints")), F.desc("endpoint_count"), "domain").limit(max_domains)
    by_domain = top.select(
        F.concat(F.lit("domain_"), "domain").alias("label"), F.when(F.size("risk_signals") > 0, "HIGH").otherwise("MEDIUM").alias("priority"),
        F.concat(F.lit("Domain '"), "domain", F.lit("' flow — risk_signals: "), F.array_join("risk_signals", ",")).alias("reason"))
    return fixed.unionByName(by_domain)


def fast_path_union(**findings: DataFrame) -> DataFrame:
    """Findings that skip path scoring, and scored paths, with their ``origin``."""
    out = None
    for origin, df in findings.items():
        part = df.withColumn("origin", F.lit(origin))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
