"""Candidate-path pipeline: structural filter, decision, scoring, ranking.

    paths -> normalize_paths (F2) -> fp_decision / fp_filter (F3/F4)
          -> path_decision (F5/F6) -> triage_score (W1, with J1/J2)
          -> triage_rank (W2) -> classify / findings

Rules and scores are narrow projections.  The de-duplication is one shuffle on
(run, path) with a partial per-partition limit before it, after records are scored;
context lists are keyed lookups on distinct texts, joined to the records once, and
ranks are counted in slices of a run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkaudit import catalogs as K
from sparkaudit.functions.core import nonempty
from sparkaudit.functions.paths import (entry_hint, first_test_marker, is_test_path,
                                        is_utility_path, needs_manual, sanitizer_hint)
from sparkaudit.operators.dims import first_hits
from sparkaudit.operators.ranking import with_position
from sparkaudit.session import written

EMPTY_ARR = "array<string>"

PATH_SCHEMA = (
    "run_id string, ord long, id string, entry_fn string, entry_file string, file string, "
    "source struct<type:string,code:string,name:string,file:string>, "
    "sink struct<name:string,type:string,code:string,file:string>, sink_cat string, "
    "tool string, detected_by array<string>, query_type string, call_chain array<string>, "
    "flow_nodes array<string>, path_decision string, score int, triage_score int"
)


# ---------------------------------------------------------------------------
# F2 normalize_path
# ---------------------------------------------------------------------------
def normalize_paths(raw: DataFrame, col: str = "raw", ord_col: str = "ord") -> DataFrame:
    """a column of JSON records *or* bare strings -> path records.

    A JSON object is parsed with the path schema; a bare string becomes
    ``entry_fn = entry_file = string``, tool ``manual``, score 0, an empty
    custom sink.  Flat graph rows (``sink_fn``, ``sink_file``) map onto the
    nested sink.
    """
    schema = PATH_SCHEMA + ", sink_fn string, sink_file string"
    parsed = F.from_json(F.col(col), schema)
    is_obj = F.trim(F.col(col)).startswith("{")
    s = F.col("_p")
    out = raw.withColumn("_p", F.when(is_obj, parsed))
    obj_sink = F.when(s["sink"].isNotNull(), s["sink"]).otherwise(
        F.when(s["sink_fn"].isNotNull() | s["sink_file"].isNotNull(),
               F.struct(s["sink_fn"].alias("name"), F.lit(None).cast("string").alias("type"),
                        F.lit(None).cast("string").alias("code"), s["sink_file"].alias("file"))))
    str_sink = F.struct(F.lit("").alias("name"), F.lit("custom").alias("type"),
                        F.lit(None).cast("string").alias("code"), F.lit("").alias("file"))
    return out.select(
        F.col(ord_col).alias("ord"),
        F.when(is_obj, s["id"]).alias("id"),
        F.when(is_obj, s["entry_fn"]).otherwise(F.col(col)).alias("entry_fn"),
        F.when(is_obj, s["entry_file"]).otherwise(F.col(col)).alias("entry_file"),
        F.when(is_obj, s["file"]).alias("file"),
        F.when(is_obj, s["source"]).alias("source"),
        F.when(is_obj, obj_sink).otherwise(str_sink).alias("sink"),
        F.when(is_obj, s["sink_cat"]).alias("sink_cat"),
        F.when(is_obj, s["tool"]).otherwise(F.lit("manual")).alias("tool"),
        F.when(is_obj, s["detected_by"]).alias("detected_by"),
        F.when(is_obj, s["query_type"]).alias("query_type"),
        F.when(is_obj, s["call_chain"]).alias("call_chain"),
        F.when(is_obj, s["flow_nodes"]).alias("flow_nodes"),
        F.when(is_obj, s["path_decision"]).alias("path_decision"),
        F.when(is_obj, s["score"]).otherwise(F.lit(0)).alias("score"),
        F.when(is_obj, s["triage_score"]).alias("triage_score"),
    )


# ---------------------------------------------------------------------------
# F3 / F4 structural filter
# ---------------------------------------------------------------------------
def fp_decision(paths: DataFrame, min_score: int = K.FP_MIN_SCORE,
                require_score: bool = True) -> DataFrame:
    """F3.  Each path predicate is computed once into a column (a regex over
    the path is not "cheap", so Catalyst keeps it un-duplicated), then the
    ordered rules read the flags."""
    entry = F.coalesce(F.col("entry_file"), F.col("source.file"), F.lit(""))
    sink_file = F.coalesce(F.col("sink.file"), F.lit(""))
    flagged = (paths.withColumn("_te", is_test_path(entry, "filter"))
               .withColumn("_ts", (sink_file != "") & is_test_path(sink_file, "filter"))
               .withColumn("_ut", is_utility_path(entry)))
    score = F.coalesce(F.col("score"), F.col("triage_score"), F.lit(0 if require_score else None))
    qt = F.col("query_type")
    low = score.isNotNull() & (score < min_score)
    te, ts, ut = F.col("_te"), F.col("_ts"), F.col("_ut")
    decision = (F.when(low, "skip").when(te, "skip").when(ts, "skip")
                .when(ut, "low_priority").otherwise("pass"))
    reason = (F.when(low, F.concat(F.lit("score_too_low:"), score.cast("string")))
              .when(te, "test_or_migration_file").when(ts, "sink_in_test_file")
              .when(ut, "utility_class_entry")
              .when(qt.isin("feedback", "object"), F.concat(qt, F.lit("_path")))
              .otherwise("no_structural_fp_matched"))
    return (flagged.withColumn("fp_decision", decision).withColumn("fp_reason", reason)
            .drop("_te", "_ts", "_ut"))


def fp_filter(paths: DataFrame, min_score: int = K.FP_MIN_SCORE,
              require_score: bool = True) -> DataFrame:
    """``pass`` rows, then ``low_priority`` ones, each in input order."""
    d = fp_decision(paths, min_score, require_score)
    return (d.where(F.col("fp_decision") != "skip")
            .withColumn("fp_rank", F.when(F.col("fp_decision") == "pass", 0).otherwise(1))
            .orderBy("fp_rank", "ord"))


def fp_filter_summary(decided: DataFrame) -> DataFrame:
    """Counts of one F3 pass in a single aggregate."""
    dcol = F.col("fp_decision")
    return decided.agg(
        F.count_if(dcol == "skip").cast("long").alias("removed_count"),
        F.count_if(dcol == "pass").cast("long").alias("pass_count"),
        F.count_if(dcol == "low_priority").cast("long").alias("low_priority_count"),
    )


def skip_reasons(decided: DataFrame, n: int | None = None) -> DataFrame:
    """Whole skip reasons by frequency, ties by first occurrence; the first ``n`` if given."""
    out = (decided.where(F.col("fp_decision") == "skip").groupBy(F.col("fp_reason").alias("reason"))
           .agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"))
           .orderBy(F.desc("n"), F.asc("first_ord")))
    return out if n is None else out.limit(n)


# ---------------------------------------------------------------------------
# F5 / F6 path decision
# ---------------------------------------------------------------------------
def _pattern_present(node: str) -> Column:
    code = F.coalesce(F.col(f"{node}.code"), F.col(f"{node}.name"), F.lit(""))
    return F.trim(F.substring_index(code, "(", 1)) != ""


def path_decision(paths: DataFrame, hints=None, with_flow: bool = True) -> DataFrame:
    """F5 (with flow evidence columns ``has_flow``/``flow_nodes``) or F6."""
    entry = F.coalesce(F.col("entry_file"), F.col("file"), F.lit(""))
    test = is_test_path(entry, "confirm")
    obj = F.col("query_type") == "object"
    manual = needs_manual(F.col("call_chain"))
    if not with_flow:
        dec = (F.when(test, K.DECISION_SKIP_FP).when(obj, K.DECISION_OBJECT_TRACE)
               .when(manual, K.DECISION_MANUAL).otherwise(K.DECISION_FULL_VERIFY))
        return paths.withColumn("path_decision", dec).withColumn(
            "flow_nodes", F.array().cast(EMPTY_ARR))
    has_pat = _pattern_present("source") & _pattern_present("sink")
    has_flow = F.coalesce(F.col("has_flow"), F.lit(False))
    hinted = sanitizer_hint(F.col("flow_nodes"), hints)
    dec = (F.when(test, K.DECISION_SKIP_FP).when(obj, K.DECISION_OBJECT_TRACE)
           .when(manual, K.DECISION_MANUAL).when(~has_pat, K.DECISION_FULL_VERIFY)
           .when(~has_flow, K.DECISION_SKIP_NO_FLOW)
           .when(hinted, K.DECISION_SANITIZER).otherwise(K.DECISION_CONFIRMED))
    keeps_nodes = dec.isin(K.DECISION_SANITIZER, K.DECISION_CONFIRMED)
    return (paths.withColumn("path_decision", dec)
            .withColumn("flow_nodes", F.when(keeps_nodes, F.col("flow_nodes"))
                        .otherwise(F.array().cast(EMPTY_ARR))))


# ---------------------------------------------------------------------------
# W1 triage_score (with J1 sensitive flows, J2 external-finding boost)
# ---------------------------------------------------------------------------
#: Matches of each kind that decide a boost: two points each for file and sink, one for the type, stop at 5.
_BOOST_HITS = {"file": 3, "sink": 3, "vuln_type": 5}


def cx_boost(file_hits: Column, sink_hits: Column, type_hits: Column) -> Column:
    """J2 from the first matching findings of each kind (arrays of their ``ord``, at least as many as
    ``_BOOST_HITS``): points are added finding by finding and stop once they reach 5."""
    empty = F.array().cast("array<bigint>")

    def points(hits, n):
        return F.transform(F.coalesce(hits, empty), lambda o: F.struct(o.alias("ord"), F.lit(n).alias("points")))
    events = F.array_sort(F.concat(points(file_hits, 2), points(sink_hits, 2), points(type_hits, 1)))

    def add(acc, e):
        goes_on = (acc["total"] < 5) | (acc["ord"] == e["ord"])  # a finding's points count together
        return F.when(goes_on, F.struct((acc["total"] + e["points"]).alias("total"), e["ord"].alias("ord"))).otherwise(acc)
    none = F.struct(F.lit(0).alias("total"), F.lit(None).cast("bigint").alias("ord"))
    return F.aggregate(events, none, add, lambda acc: acc["total"])


#: Distinct contexts, and the characters of their texts, that may be broadcast.
BROADCAST_CONTEXTS, BROADCAST_CONTEXT_CHARS = 250_000, 32_000_000


def _context_texts(flows: DataFrame | None, cx: DataFrame | None) -> dict[str, Column]:
    """The texts of a record that its context is looked up by."""
    texts = {"entry_file": F.coalesce(F.col("entry_file"), F.col("file"), F.lit(""))}
    if flows is not None:
        texts["entry_fn"] = F.coalesce(F.col("entry_fn"), F.col("source.code"), F.lit(""))
    if cx is not None:
        texts |= {"sink": F.coalesce(F.col("sink.name"), F.lit("")), "vuln_type": F.coalesce(F.col("sink.type"), F.lit(""))}
    return texts


def contexts(records: DataFrame, flows: DataFrame | None, cx: DataFrame | None) -> DataFrame:
    """One row for each distinct context of ``records`` — entry file, entry function, sink name and sink type — written once.

    ``_flow`` (J1: some flow entry is in the entry file or function), ``_boost`` (J2), and what the entry
    file alone says: ``_marker`` and ``_hint``.  Texts meet the context lists by keyed containment on their distinct values.
    """
    wanted = _context_texts(flows, cx)
    out = written(records.select(*[c.alias(f"_{k}") for k, c in wanted.items()]).distinct())

    def lookup(df, key, hits, name):
        hits = hits.select(F.col("text").alias("_text"), F.col("ords").alias(name))
        return df.join(hits, F.col(f"_{key}") == F.col("_text"), "left").drop("_text")

    texts = {k: out.select(F.col(f"_{k}").alias("text")) for k in wanted}
    if flows is not None:
        for name, kind in (("_f1", "entry_file"), ("_f2", "entry_fn")):
            out = lookup(out, kind, first_hits(texts[kind], flows, "entry", 1), name)
        out = out.withColumn("_flow", F.col("_f1").isNotNull() | F.col("_f2").isNotNull()).drop("_f1", "_f2")
    if cx is not None:
        if "sink_name" in cx.columns:  # the other name of the same field
            cx = cx.withColumn("sink", F.coalesce("sink", "sink_name"))
        for key, kind in (("entry_file", "file"), ("sink", "sink")):
            out = lookup(out, key, first_hits(texts[key], cx, kind, _BOOST_HITS[kind]), f"_of_{kind}")
        by_type = Window.partitionBy("text").orderBy("ord")
        same = (cx.where("vuln_type <> ''").select(F.col("vuln_type").alias("text"), "ord")
                .withColumn("_rn", F.row_number().over(by_type)).where(F.col("_rn") <= _BOOST_HITS["vuln_type"])
                .groupBy("text").agg(F.collect_list("ord").alias("ords")))
        out = lookup(out, "vuln_type", same, "_of_type")
        out = out.withColumn("_boost", cx_boost(F.col("_of_file"), F.col("_of_sink"), F.col("_of_type"))).drop(
            "_of_file", "_of_sink", "_of_type")
    return written(out.withColumns({"_marker": first_test_marker(F.col("_entry_file")), "_hint": entry_hint(F.col("_entry_file"))}))


def with_context(paths: DataFrame, flows: DataFrame | None, cx: DataFrame | None, given: DataFrame | None = None) -> DataFrame:
    """``paths`` with the columns of their ``contexts``.

    These are gathered in one pass over ``given`` (records that hold at least those of ``paths``, by default
    ``paths``) and joined back once: a counted number of contexts is broadcast, so the records aren't shuffled;
    more are joined by all texts together, which spreads a text that many records share.
    """
    every = contexts(paths if given is None else given, flows, cx)
    wanted = _context_texts(flows, cx)
    n, chars = every.agg(F.count(F.lit(1)), F.sum(sum((F.length(f"_{k}") for k in wanted), F.lit(0)).cast("long"))).first()
    if n <= BROADCAST_CONTEXTS and (chars or 0) <= BROADCAST_CONTEXT_CHARS:
        every = F.broadcast(every)
    return paths.join(every, [c == every[f"_{k}"] for k, c in wanted.items()], "left").drop(*[f"_{k}" for k in wanted])


def _literal_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def _with_terms(paths: DataFrame, flows: DataFrame | None, cx: DataFrame | None, given: DataFrame | None = None) -> DataFrame:
    """``paths`` with W1's ``score``, and ``_marker`` and ``_t`` (the terms), of which the detail is made."""
    sink_type = F.coalesce(F.col("sink.type"), F.lit(""))
    det = F.coalesce(F.col("detected_by"), F.array().cast(EMPTY_ARR))
    # a record's own category, else its sink type's; maps, as a CASE over a CASE outgrows what the JVM compiles
    of_type = _literal_map({t: K.SINK_SEVERITY.get(c, 1) for t, c in K.SINK_TYPE_TO_CAT.items()})
    own = F.coalesce(F.try_element_at(_literal_map(K.SINK_SEVERITY), F.col("sink_cat")), F.lit(1))
    severity = F.when(nonempty(F.col("sink_cat")), own).otherwise(
        F.coalesce(F.try_element_at(of_type, sink_type), F.lit(K.SINK_SEVERITY.get("CUSTOM", 1))))

    def points(condition, n):
        return F.when(condition, n).otherwise(0)
    terms = {
        "sink_severity": severity,
        "semgrep_match": points((F.col("tool") == "semgrep") | F.array_contains(det, "semgrep"), 3),
        "gitnexus_structural": points((F.col("tool") == "gitnexus")
                                      | F.col("query_type").isin("structural", "object"), 2),
        "joern_confirmed": points(F.col("path_decision") == "confirmed", 2),
        "custom_sink": points(F.col("sink.type") == "custom_wrapper", 1),
        "direct_http_source": points(F.col("source.type").isin(*K.HTTP_SOURCE_TYPES), 1),
        "entry_point_bonus": points(F.col("_hint"), 2),
        "sensitive_flow_match": points(F.col("_flow"), 2) if flows is not None else F.lit(0),
        "cx_boost": F.col("_boost") if cx is not None else F.lit(0),
        "object_bonus": points(F.col("query_type") == "object", 1),
    }
    # every term is computed once, in a projection of its own
    out = with_context(paths, flows, cx, given).withColumn("_t", F.struct(*[t.cast("int").alias(k) for k, t in terms.items()]))
    total = sum((F.col("_t")[k] for k in terms), F.lit(0))
    score = F.when(F.col("_marker").isNotNull(), F.lit(-10)).otherwise(total).cast("int")
    return out.withColumn("score", score).drop("_flow", "_boost", "_hint")


def _with_detail(scored: DataFrame) -> DataFrame:
    """``_with_terms`` opened: ``triage_score`` and ``triage_detail``."""
    terms = scored.schema["_t"].dataType.names
    detail = F.when(F.col("_marker").isNotNull(),
                    F.create_map(F.lit("fp"), F.concat(F.lit("test_file:"), F.col("_marker")))).otherwise(
        F.map_filter(F.create_map(*[x for k in terms for x in (F.lit(k), F.col("_t")[k].cast("string"))]),
                     lambda k, v: v != "0"))
    return scored.withColumns({"triage_score": F.col("score"), "triage_detail": detail}).drop("_marker", "_t")


def triage_score(paths: DataFrame, flows: DataFrame | None = None,
                 cx: DataFrame | None = None, given: DataFrame | None = None, detail: bool = True) -> DataFrame:
    """Additive score and a detail map per path.

    ``flows``: (ord, entry); ``cx``: (ord, file, sink, vuln_type[, sink_name]); both of any size.
    ``given``: see ``with_context``.  Without ``detail`` the terms stay as they are (``_with_terms``).
    """
    scored = _with_terms(paths, flows, cx, given)
    return _with_detail(scored) if detail else scored


def detail_string(detail: Column) -> Column:
    """Map -> ``k=v,k=v`` in map order (compare form)."""
    return F.array_join(F.transform(F.map_entries(detail),
                                    lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


# ---------------------------------------------------------------------------
# W2 triage_rank, A5 distribution, W3 top_paths
# ---------------------------------------------------------------------------
def dedupe_first(df: DataFrame, keys: tuple[str, ...] = ("id",), order: str = "ord") -> DataFrame:
    """Keep the first row per key.  ``row_number()==1`` lets Spark insert a
    partial WindowGroupLimit before the shuffle, so a hot key ships at most
    one row per map partition."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).asc())
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


#: Columns that say where a record came from, not what it says.
_PLACE = ("ord", "run_id")


def unique_paths(paths: DataFrame) -> DataFrame:
    """The first record of each path in its run.

    A path is known by its id; one without an id by the digest of the record's
    own fields, so equal records are one path and different ones stay apart.
    Two runs may use the same id.
    """
    return dedupe_first(_with_path(paths), ("run_id", "_path")).drop("_path")


def _with_path(paths: DataFrame) -> DataFrame:
    """``paths`` with ``_path``, what a path is known by in its run.  Only records without an id make a digest."""
    own = F.md5(F.to_json(F.struct(*[F.col(c) for c in paths.columns if c not in _PLACE]),
                          {"ignoreNullFields": "false"}))
    return paths.where(F.col("id").isNotNull()).withColumn("_path", F.concat(F.lit("id:"), F.col("id"))).unionByName(
        paths.where(F.col("id").isNull()).withColumn("_path", own))


def _first_scored(paths: DataFrame, flows=None, cx=None, columns=None) -> DataFrame:
    """The first record of each path in its run with its score (``_with_terms``) and ``columns`` (all by default).

    A record's score doesn't depend on other records, so records are scored first and only what is asked for is
    shuffled to find the first ones.
    """
    columns = paths.columns if columns is None else list(columns)
    scored = triage_score(_with_path(paths), flows, cx, paths, detail=False)
    named = {"run_id": None, **{c: None for c in columns}, "ord": None, "score": None, "_marker": None, "_t": None, "_path": None}
    return dedupe_first(scored.select(*named), ("run_id", "_path")).drop("_path")


def with_path_ids(paths: DataFrame) -> DataFrame:
    """Missing ids are filled for output with 12 hexadecimal digits of the record's digest."""
    own = F.md5(F.to_json(F.struct(*[F.col(c) for c in paths.columns if c not in _PLACE])))
    return paths.withColumn("id", F.coalesce(F.col("id"), F.substring(own, 1, 12)))


def unique_scored(paths: DataFrame, flows=None, cx=None, columns=None) -> DataFrame:
    """W1 over the first record of each path in its run, with ``columns`` of ``paths`` (all by default)."""
    return _with_detail(_first_scored(paths, flows, cx, columns))


def triage_scored(paths: DataFrame, flows=None, cx=None,
                  threshold: int = K.TRIAGE_THRESHOLD) -> DataFrame:
    """Dedupe per run, score, keep rows at/above threshold."""
    return _with_detail(_first_scored(paths, flows, cx).where(F.col("score") >= threshold))


def triage_rank(paths: DataFrame, flows=None, cx=None,
                threshold: int = K.TRIAGE_THRESHOLD, max_paths: int | None = None, columns=None) -> DataFrame:
    """Every kept path with its ``rank`` in its run: score descending, then input order.

    ``max_paths`` keeps the first ones of each run (the reviewer's list, off by default).  ``columns``: those of
    ``paths`` that are wanted, all by default; others aren't carried through the sort.
    """
    wanted = paths.columns if columns is None else ["run_id", *columns, "id", "ord"]
    kept = _first_scored(paths, flows, cx, wanted).where(F.col("score") >= threshold)
    out = with_position(kept, "rank", ["run_id"], "ord", lead=-F.col("score"), ties=("id",))
    return _with_detail(out if max_paths is None else out.where(F.col("rank") <= max_paths))


def triage_summary(paths: DataFrame, flows=None, cx=None, threshold: int = K.TRIAGE_THRESHOLD,
                   max_paths: int | None = None) -> DataFrame:
    """Per run: before / after / skipped counts, in one aggregate."""
    scored = _first_scored(paths, flows, cx, ())
    keep = F.col("score") >= threshold
    after = F.count_if(keep) if max_paths is None else F.least(F.count_if(keep), F.lit(max_paths))
    return scored.groupBy("run_id").agg(
        F.count(F.lit(1)).cast("long").alias("total_before"), after.cast("long").alias("total_after"),
        F.count_if(~keep).cast("long").alias("skipped_below_threshold"))


def score_distribution(scored_kept: DataFrame) -> DataFrame:
    """A5: buckets >=10, 8-9, 6-7 (everything else); zero buckets included."""
    s = F.col("score")
    agg = scored_kept.agg(
        F.count_if(s >= 10).cast("long").alias("b10"),
        F.count_if((s >= 8) & (s < 10)).cast("long").alias("b8"),
        F.count_if(s < 8).cast("long").alias("b6"))
    return agg.select(F.expr("stack(3, '>=10', b10, '8-9', b8, '6-7', b6) AS (bucket, n)"))


def top_paths(scored: DataFrame, n: int = 10, per: str | None = None) -> DataFrame:
    """Top-n paths by score (globally or per ``per`` column)."""
    if per is None:
        return scored.orderBy(F.desc("score"), F.asc("ord")).limit(n)
    w = Window.partitionBy(per).orderBy(F.desc("score"), F.asc("ord"))
    return scored.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def verify_queue_order(paths: DataFrame) -> DataFrame:
    """confirmed & score>=10, confirmed, full_verify & score>=8, rest."""
    d, s = F.col("path_decision"), F.coalesce(F.col("score"), F.lit(0))
    rank = (F.when((d == "confirmed") & (s >= 10), 0).when(d == "confirmed", 1)
            .when((d == "full_verify") & (s >= 8), 2).otherwise(3))
    return paths.withColumn("verify_rank", rank).orderBy("verify_rank", F.desc("score"), "ord")
