"""Catalog synthesis: registries, prioritisation, flow domains (A1-A4, A11,
J3, J4, J8, U1-U5, W4, W5).

Order-dependent rules ("first registration wins", "first-seen order") carry
an explicit ``ord`` column; every roll-up is one hash aggregation (partial
aggregation before the shuffle) keyed by name or domain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkaudit import catalogs as K
from sparkaudit.operators.dims import contains_join


# --- scalar helpers (W4, W5, U3, U4, U5) ---------------------------------------
def domain_from_path(path: Column) -> Column:
    """First URL segment not empty, not ``{..}``, not a skip word."""
    segs = F.split(F.regexp_replace(F.coalesce(path, F.lit("")), "^/+|/+$", ""), "/")
    keep = F.filter(segs, lambda s: (s != "") & ~s.startswith("{")
                    & ~F.lower(s).isin(*K.SKIP_PATH_SEGMENTS))
    return F.coalesce(F.lower(F.try_element_at(keep, F.lit(1))), F.lit("unknown"))


def api_path_tail(path: Column) -> Column:
    """Last segment not ``{..}`` and not a version/api word (case-sensitive)."""
    segs = F.split(F.coalesce(path, F.lit("")), "/")
    keep = F.filter(segs, lambda s: (s != "") & ~s.startswith("{") & ~s.isin(*K.API_TAIL_SKIP))
    return F.try_element_at(keep, F.lit(-1))


def bare_function_name(code: Column) -> Column:
    """Cut from the first '(' to the end of that line, strip, last '.' part."""
    cut = F.regexp_replace(F.coalesce(code, F.lit("")), r"\([^\n]*", "")
    return F.element_at(F.split(F.regexp_replace(cut, r"^\s+|\s+$", ""), r"\."), -1)


def param_stem(p: Column) -> Column:
    """U4: strip an id-like suffix and lower-case."""
    return F.lower(F.regexp_replace(p, K.PARAM_STEM_RE, ""))


def split_camel(name: Column) -> Column:
    """Words of a CamelCase identifier (Java regex look-ahead)."""
    return F.regexp_extract_all(name, F.lit(r"[A-Z][a-z0-9]+|[A-Z]+(?=[A-Z][a-z]|\d|\b)"), 0)


# --- A1 / A2 registries -----------------------------------------------------------
def name_registry(regs: DataFrame) -> DataFrame:
    """A1: regs(name, source, score, ord[, vuln_type, tainted_param]).

    per name: sources in first-seen order; score = sum over DISTINCT sources
    of the score of that source's first registration; vuln types and
    tainted params distinct in order.  Names shorter than 2 are dropped.
    """
    cols = regs.columns
    r = regs.where(F.length("name") >= 2)
    vt = F.col("vuln_type") if "vuln_type" in cols else F.lit(None).cast("string")
    tp = F.col("tainted_param") if "tainted_param" in cols else F.lit(None).cast("string")
    r = r.select("name", "source", "score", "ord", vt.alias("vuln_type"), tp.alias("tainted_param"))
    first = (r.groupBy("name", "source")
             .agg(F.min_by("score", "ord").alias("score"), F.min("ord").alias("ord")))
    by_src = first.groupBy("name").agg(
        F.sum("score").cast("long").alias("score"),
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "source"))), lambda s: s["source"]).alias("sources"),
        F.min("ord").alias("ord"))
    # distinct values first, so what is gathered per name is bounded by them and not by the registrations
    for value, listed in (("vuln_type", "vuln_types"), ("tainted_param", "tainted_params")):
        by_src = by_src.join(_ordered_values(r, "name", value, listed), "name", "left")
    none = F.array().cast("array<string>")
    return by_src.withColumns({c: F.coalesce(c, none) for c in ("vuln_types", "tainted_params")})


def _ordered_values(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Per key the distinct non-empty values in order of their first ``ord``."""
    first = rows.where(F.col(value) != "").groupBy(key, value).agg(F.min("ord").alias("ord"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", value))),
                                              lambda s: s[value]).alias(name))


def prioritize(reg: DataFrame) -> DataFrame:
    """A2: HIGH >= 5, MEDIUM >= 3, else LOW; by score, first registration first."""
    s = F.col("score")
    return reg.withColumn("priority", F.when(s >= K.PRIORITY_HIGH, "HIGH")
                          .when(s >= K.PRIORITY_MEDIUM, "MEDIUM").otherwise("LOW")).orderBy(F.desc("score"), "ord")


def ordered_distinct_union(items: DataFrame, cap: int | None = None) -> DataFrame:
    """items(list_ord, pos, name) -> distinct non-empty names by first
    position (list order, then position), optionally capped."""
    d = (items.where(F.col("name").isNotNull() & (F.col("name") != ""))
         .groupBy("name").agg(F.min(F.struct("list_ord", "pos")).alias("first")))
    d = d.select("name", F.col("first.list_ord").alias("list_ord"), F.col("first.pos").alias("pos"))
    return d.orderBy("list_ord", "pos").limit(cap) if cap else d


# --- A3 flow domains (with J3 sink hints, J4 taint by handler) ------------------------
def domain_endpoints(eps: DataFrame) -> DataFrame:
    """The endpoints of each domain, one row each (a domain may have very many)."""
    return eps.withColumn("domain", domain_from_path(F.col("path")))


def flow_domains(eps: DataFrame, sinks: DataFrame | None = None,
                 fn_params: DataFrame | None = None) -> DataFrame:
    """A3.  eps: endpoint records (path, params, handler, auth_tags, file,
    line); sinks: (file, name) scanner sinks; fn_params: (function, param).

    Distinct (domain, parameter) and (domain, handler) pairs are formed first,
    so the lists of a domain are bounded by its names.  Result in review order;
    ``domain_endpoints`` has the single endpoints.
    """
    none = F.array().cast("array<string>")
    e = domain_endpoints(eps).withColumn("ord", F.struct("file", "line", "method"))
    base = e.groupBy("domain").agg(
        F.count(F.lit(1)).cast("long").alias("endpoint_count"),
        F.max((F.size("auth_tags") == 0).cast("int")).cast("boolean").alias("has_unauth_ep"))
    named = e.select("domain", "ord", F.posexplode("params").alias("pi", "p")).select(
        "domain", F.struct("ord", "pi").alias("ord"), F.col("p.name").alias("pname"), F.col("p.location").alias("location"))
    lists = [_ordered_values(named, "domain", "pname", "param_names"),
             _ordered_values(named.where("location = 'path'"), "domain", "pname", "path_names"),
             _ordered_values(e, "domain", "handler", "handler_names")]
    # Sink names whose file contains the domain (case-folded)
    if sinks is not None:
        folded = sinks.select(F.lower("file").alias("lfile"), "name").distinct()
        lists.append(contains_join(folded, base.select("domain"), "lfile", "domain").groupBy("domain").agg(
            F.array_sort(F.collect_set("name")).alias("sink_hints")))
    # Handlers with declared tainted params
    if fn_params is not None:
        handlers = e.where("handler <> ''").select("domain", F.col("handler").alias("function")).distinct()
        declared = fn_params.groupBy("function").agg(F.array_sort(F.collect_set("param")).alias("params"))
        lists.append(handlers.join(declared, "function").groupBy("domain").agg(F.array_sort(F.collect_list(
            F.struct(F.col("function").alias("handler"), F.col("params").alias("tainted_params")))).alias("taint_signals")))
    d = base
    for part in lists:
        d = d.join(part, "domain", "left")
    for name, kind in (("sink_hints", "array<string>"),
                       ("taint_signals", "array<struct<handler:string,tainted_params:array<string>>>")):
        d = d.withColumn(name, F.coalesce(F.col(name) if name in d.columns else F.lit(None).cast(kind),
                                          F.array().cast(kind)))
    d = d.withColumns({c: F.coalesce(c, none) for c in ("param_names", "path_names", "handler_names")})
    d = (d.withColumn("id_params", F.filter("param_names", lambda p: p.rlike(K.ID_PARAM_RE)))
         .withColumn("path_id_params", F.filter("path_names", lambda p: p.rlike(K.ID_PARAM_RE))).drop("path_names"))
    risk = F.array_compact(F.array(
        F.when(F.size("path_id_params") > 0, F.lit("path_id_params")),
        F.when((F.size("id_params") > 0) & (F.size("sink_hints") > 0), F.lit("id_param_with_sink")),
        F.when(F.col("has_unauth_ep"), F.lit("unauthenticated_endpoint")),
        F.when(F.size("taint_signals") > 0, F.lit("taint_param_declared"))))
    stems = F.filter(F.transform("id_params", param_stem),
                     lambda s: (s != "") & (s != F.col("domain")) & (F.length(s) > 2))
    topics = F.array_distinct(F.concat(F.when(F.col("domain") != "unknown", F.array("domain")).otherwise(none), stems))
    return d.withColumn("risk_signals", risk).withColumn("topic_keywords", topics).orderBy(
        F.desc(F.size("risk_signals")), F.desc(F.size("sink_hints")), F.desc("endpoint_count"), "domain")


def strategy_stats(domains: DataFrame, entries: DataFrame, sinks: DataFrame,
                   taint_params: DataFrame) -> DataFrame:
    """A4: one row of counts (each an uncorrelated scalar aggregate)."""
    hi_e = entries.where(F.col("priority") == "HIGH").select(F.count_distinct("name")).scalar()
    hi_s = sinks.where(F.col("priority").isin("HIGH", "MEDIUM")).select(F.count_distinct("name")).scalar()
    return domains.agg(
        F.count(F.lit(1)).cast("long").alias("flow_domain_count"),
        F.count_if(F.size("risk_signals") > 0).cast("long").alias("risky_domains")).select(
        "*", entries.select(F.count(F.lit(1))).scalar().cast("long").alias("entry_count"),
        sinks.select(F.count(F.lit(1))).scalar().cast("long").alias("sink_count"),
        (hi_e * hi_s).cast("long").alias("high_priority_pairs"),
        taint_params.select(F.count(F.lit(1))).scalar().cast("long").alias("taint_param_count"))


def extra_topics(flow_entries: DataFrame | None = None, notes: DataFrame | None = None,
                 api_names: DataFrame | None = None, domain_keywords: DataFrame | None = None) -> DataFrame:
    """Sorted distinct topic words from sensitive-flow entries, note
    keyword expansions, api names (len > 3) and flow-domain keywords."""
    parts = []
    if flow_entries is not None:
        seg = flow_entries.select(F.explode(F.split("entry", r"[/\s_-]")).alias("s"))
        parts.append(seg.select(F.lower(F.regexp_replace("s", "[^a-zA-Z]", "")).alias("topic"))
                     .where(F.length("topic") > 3))
    if notes is not None:
        low = F.lower(F.col("note"))
        arr = F.flatten(F.array(*[F.when(F.lit(False) if not kws else
                                         _any_contains(low, kws), F.array(*[F.lit(t) for t in ts]))
                                  .otherwise(F.array().cast("array<string>")) for kws, ts in K.NOTE_TOPICS]))
        parts.append(notes.select(F.explode(arr).alias("topic")))
    if api_names is not None:
        parts.append(api_names.where(F.length("name") > 3).select(F.lower("name").alias("topic")))
    if domain_keywords is not None:
        parts.append(domain_keywords.select(F.col("keyword").alias("topic")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def _any_contains(low: Column, kws) -> Column:
    c = F.lit(False)
    for k in kws:
        c = c | low.contains(k)
    return c
