"""Classification and lookups.

Catalogue lookups are "first entry in catalogue order whose key is a
substring".  With a fixed catalogue this is one CASE chain of ``contains``
tests evaluated in codegen (no join at all).  Data-driven catalogues
(business-context sinks) are looked up by keyed containment.
Big inputs are classified on their DISTINCT names first, then joined back on
the name (an equi-join), so the per-row work does not grow with duplicates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkaudit import catalogs as K
from sparkaudit.functions.core import contains_any, map_lookup, nonempty
from sparkaudit.operators.dims import first_hits


def first_group(text: Column, groups, default=None) -> Column:
    """First (label, keywords) group with any keyword contained in text."""
    out = F.lit(default)
    for label, kws in reversed(list(groups)):
        out = F.when(contains_any(text, kws), F.lit(label)).otherwise(out)
    return out


def catalogue_match(name: Column, catalogue=K.KNOWN_SINKS) -> Column:
    """C1 step 2: first catalogue entry (in order) contained, case-folded."""
    low = F.lower(F.coalesce(name, F.lit("")))
    out = F.lit(None).cast("string")
    for key, vt in reversed(catalogue):
        out = F.when(low.contains(key.lower()), F.lit(vt)).otherwise(out)
    return out


def classify_sink(names: DataFrame, name_col: str = "sink_name",
                  ctx_sinks: DataFrame | None = None) -> DataFrame:
    """C1 over the distinct sink names of ``names``.

    ``ctx_sinks``: (ord, name, vuln_type, confidence) business-context sinks.
    Returns (name, vuln_type, confidence, source).
    """
    d = names.select(F.col(name_col).alias(name_col)).where(F.col(name_col).isNotNull()).distinct()
    low = F.lower(F.col(name_col))
    cat = catalogue_match(F.col(name_col))
    if ctx_sinks is not None:
        sure = ctx_sinks.where(nonempty(F.col("vuln_type")) & (F.upper("confidence") == "HIGH")).select(
            "ord", F.lower("name").alias("name"), "vuln_type")
        first = (first_hits(d.select(low.alias("text")), sure, "name", 1)
                 .select(F.col("text").alias("_low"), F.col("ords")[0].alias("ord"))
                 .join(sure.select("ord", F.col("vuln_type").alias("_ctx")), "ord").drop("ord"))
        d = d.join(first, low == F.col("_low"), "left")
        ctx_vt = F.col("_ctx")
    else:
        ctx_vt = F.lit(None).cast("string")
    vt = F.coalesce(ctx_vt, cat, F.lit("unknown"))
    conf = F.when(ctx_vt.isNotNull(), "HIGH").when(cat.isNotNull(), "MEDIUM").otherwise("UNKNOWN")
    src = (F.when(ctx_vt.isNotNull(), "business_context").when(cat.isNotNull(), "lookup_table")
           .otherwise("not_found"))
    return d.select(F.col(name_col), vt.alias("vuln_type"), conf.alias("confidence"),
                    src.alias("source"))


def classify_paths(paths: DataFrame, ctx_sinks: DataFrame | None = None) -> DataFrame:
    """Attach C1 to every path: classify distinct names, equi-join back."""
    names = paths.select(F.col("sink.name").alias("sink_name"))
    cls = classify_sink(names, "sink_name", ctx_sinks)
    return paths.join(cls, F.col("sink.name") == cls["sink_name"], "left").drop("sink_name")


# --- scanner output (C2, C3, C4) ---------------------------------------------
def rule_sink_type(rule_lower: Column, mode: str = "token") -> Column:
    """First sink type (dict order) with a prefix in the rule.

    ``token``: the prefix begins a word of the rule id, so ``resource`` has no
    ``rce``.  ``substring``: it may stand anywhere.
    """
    if mode == "substring":
        return first_group(rule_lower, K.SINK_RULE_PREFIXES)
    out = F.lit(None).cast("string")
    for label, prefixes in reversed(K.SINK_RULE_PREFIXES):
        words = "|".join(p.replace(".", "[.]") for p in prefixes)
        out = F.when(rule_lower.rlike(f"(?:^|[^a-z0-9])(?:{words})"), F.lit(label)).otherwise(out)
    return out


def is_source_rule(rule_lower: Column) -> Column:
    """C3."""
    return contains_any(rule_lower, K.SOURCE_RULE_KEYWORDS)


def source_type(code: Column) -> Column:
    """C4: first source type by keywords in the lower-cased code."""
    return first_group(F.lower(F.coalesce(code, F.lit(""))), K.SOURCE_TYPE_KEYWORDS, "http_param")


def split_sources_sinks(results: DataFrame, keep=()) -> DataFrame:
    """C2+C3+C4 over flat scanner results (check_id, path, line, code, message,
    severity).  Adds kind (source|sink), type, severity, note, id."""
    rl = F.lower(F.coalesce(F.col("check_id"), F.lit("")))
    src = is_source_rule(rl)
    st = rule_sink_type(rl)
    kind = F.when(src, "source").otherwise("sink")
    typ = F.when(src, source_type(F.col("code"))).otherwise(F.coalesce(st, F.lit("semgrep_review")))
    sev = (F.when(src, F.lit(None).cast("string"))
           .when(st.isNotNull(), map_lookup(st, K.RULE_SINK_SEVERITY, "MEDIUM"))
           .otherwise(F.upper(F.coalesce(F.col("severity"), F.lit("WARNING")))))
    note = F.when(~src & st.isNull(),
                  F.lit("Unclassified by prefix matching - classify via raw_rule_id"))
    uid = F.substring(F.md5(F.concat_ws(":", F.coalesce("check_id", F.lit("")),
                                        F.coalesce("path", F.lit("")),
                                        F.coalesce(F.col("line").cast("string"), F.lit("0")))), 1, 12)
    return results.select(
        *keep, uid.alias("id"), F.col("check_id").alias("pattern"), F.col("check_id").alias("raw_rule_id"),
        F.col("path").alias("file"), "line", F.trim(F.col("code")).alias("code"), "message",
        F.lit("semgrep").alias("tool"), kind.alias("kind"), typ.alias("type"),
        sev.alias("severity"), note.alias("note"))


def scan_counts(classified: DataFrame) -> DataFrame:
    """C3 counts: sources, sinks, review sinks."""
    return classified.agg(
        F.count_if(F.col("kind") == "source").cast("long").alias("source_count"),
        F.count_if(F.col("kind") == "sink").cast("long").alias("sink_count"),
        F.count_if(F.col("type") == "semgrep_review").cast("long").alias("review_count"))


# --- free-text and known-sink vuln inference (C5, C6) ---------------------------
def vuln_from_known_sink(name: Column) -> Column:
    """C5; keywords are compared in lower case, in order (so ``curl_exec`` is rce)."""
    groups = [(label, [k.lower() for k in kws]) for label, kws in K.KNOWN_SINK_VULN_GROUPS]
    return first_group(F.lower(F.coalesce(name, F.lit(""))), groups, "unknown")


def vuln_from_text(text: Column) -> Column:
    """C6: '' when nothing matches."""
    return first_group(F.lower(F.coalesce(text, F.lit(""))), K.TEXT_VULN_GROUPS, "")


# --- path category / severity (C7) -------------------------------------------
def sink_category(sink_cat: Column, sink_type: Column) -> Column:
    return F.coalesce(F.when(nonempty(sink_cat), sink_cat),
                      map_lookup(F.coalesce(sink_type, F.lit("")), K.SINK_TYPE_TO_CAT),
                      F.lit("CUSTOM"))


def category_severity(cat: Column) -> Column:
    return map_lookup(cat, K.SINK_SEVERITY, 1)


# --- merge of sink discoveries (A8) --------------------------------------------
def merge_sink_discoveries(disc: DataFrame) -> DataFrame:
    """Key lower(name)+file; highest confidence wins, ties -> earliest
    (``ord`` = list order then position); detected_by = union.

    The winner is one hash aggregation on the key; the union gathers distinct
    (key, detector) pairs only.
    """
    rank = map_lookup(F.coalesce(F.col("confidence"), F.lit("LOW")), K.CONFIDENCE_RANK, 1)
    key = F.concat(F.lower(F.coalesce(F.col("name"), F.lit(""))), F.lit("::"),
                   F.coalesce(F.col("file"), F.lit("")))
    payload = F.struct(*[F.col(c) for c in disc.columns if c not in ("detected_by",)])
    keyed = disc.withColumn("_key", key)
    best = keyed.groupBy("_key").agg(
        F.max_by(payload, F.struct(rank.alias("r"), (-F.col("ord")).alias("o"))).alias("w"))
    by = (keyed.select("_key", F.explode("detected_by").alias("by")).distinct()
          .groupBy("_key").agg(F.array_sort(F.collect_list("by")).alias("detected_by")))
    return best.join(by, "_key", "left").select(
        F.col("_key").alias("key"), "w.*", F.coalesce("detected_by", F.array().cast("array<string>")).alias("detected_by"))


# --- findings (A7, W7, C12) -------------------------------------------------------
def severity_rank(sev: Column) -> Column:
    return map_lookup(F.upper(sev), {s: i for i, s in enumerate(K.SEVERITY_ORDER)}, len(K.SEVERITY_ORDER))


def severity_counts(findings: DataFrame) -> DataFrame:
    """Total and per-severity counts (one aggregate)."""
    s = F.upper(F.coalesce(F.col("severity"), F.lit("MEDIUM")))
    return findings.agg(F.count(F.lit(1)).cast("long").alias("total"),
                        *[F.count_if(s == x).cast("long").alias(x.lower()) for x in K.SEVERITY_ORDER])


def findings_by_severity(findings: DataFrame) -> DataFrame:
    """CRITICAL, HIGH, MEDIUM, LOW, INFO order, then by id."""
    return findings.withColumn("severity_rank", severity_rank(F.col("severity"))).orderBy("severity_rank", "id")


def business_severity(sev: Column, impact: Column) -> Column:
    """One step up on high business impact, down on low (clamped)."""
    r = severity_rank(sev)
    step = F.when(F.lower(impact) == "high", -1).when(F.lower(impact) == "low", 1).otherwise(0)
    nr = F.least(F.greatest(r + step, F.lit(0)), F.lit(len(K.SEVERITY_ORDER) - 1))
    arr = F.array(*[F.lit(s) for s in K.SEVERITY_ORDER])
    return F.when(r >= len(K.SEVERITY_ORDER), sev).otherwise(F.element_at(arr, (nr + 1).cast("int")))
