"""Business-context documents -> context tables.

A table of Markdown documents is split into ``##`` sections and ``###``
items with ``posexplode`` (narrow, per document); ``- Key: value`` lines
become a key/value array where the last key wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkaudit.catalogs import CONTEXT_KEYS, KV_RE, SECTION_KINDS
from sparkaudit.operators.classify import vuln_from_text
from sparkaudit.session import written


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _unquote(c: Column) -> Column:
    """strip backticks, then double quotes, then single quotes (both ends)."""
    for ch in ("`", '"', "'"):
        c = F.regexp_replace(c, f"^{ch}+|{ch}+$", "")
    return c


def sections(docs: DataFrame) -> DataFrame:
    """(doc_id, sec_pos, kind, title, body)."""
    s = docs.select("doc_id", F.posexplode(F.split("text", r"(?m)^##\s+")).alias("sec_pos", "sec"))
    s = s.where(F.trim("sec") != "")
    first = F.regexp_extract("sec", r"^([^\r\n]*)", 1)
    title = F.lower(F.trim(first))
    body = F.regexp_replace("sec", r"^[^\r\n]*(\r\n|\n|\r)?", "")
    kind = F.lit(None).cast("string")
    for k, kws in reversed(SECTION_KINDS):
        c = F.lit(False)
        for w in kws:
            c = c | title.contains(w)
        kind = F.when(c, F.lit(k)).otherwise(kind)
    return s.select("doc_id", "sec_pos", kind.alias("kind"), title.alias("title"), body.alias("body"))


def items(secs: DataFrame) -> DataFrame:
    """(doc_id, sec_pos, item_pos, kind, heading, rest, kv array<struct<k,v>>)."""
    it = secs.select("doc_id", "sec_pos", "kind",
                     F.posexplode(F.split("body", r"(?m)^###\s+")).alias("item_pos", "sub"))
    it = it.withColumn("sub", _strip(F.col("sub"))).where(F.col("sub") != "")
    heading = _strip(F.regexp_extract("sub", r"^([^\r\n]*)", 1))
    rest = F.regexp_replace("sub", r"^[^\r\n]*(\r\n|\n|\r)?", "")
    lines = F.transform(F.split(rest, r"\r\n|\n|\r"), _strip)
    kvs = F.transform(F.filter(lines, lambda l: l.rlike(KV_RE)), lambda l: F.struct(
        F.regexp_replace(F.lower(_strip(F.regexp_extract(l, KV_RE, 1))), " ", "_").alias("k"),
        _unquote(_strip(F.regexp_extract(l, KV_RE, 2))).alias("v")))
    return it.select("doc_id", "sec_pos", "item_pos", "kind", heading.alias("heading"),
                     rest.alias("rest"), kvs.alias("kv"))


def kv_get(kv: Column, key: str) -> Column:
    """The last value for ``key``; where that is empty there is none, and the default applies."""
    vals = F.transform(F.filter(kv, lambda e: e["k"] == key), lambda e: e["v"])
    return F.nullif(F.try_element_at(vals, F.lit(-1)), F.lit(""))


def _split_heading(h: Column):
    has = h.contains("::")
    cls = F.when(has, F.trim(F.substring_index(h, "::", 1))).otherwise(F.lit(""))
    name = F.when(has, F.trim(F.expr("substring(heading, instr(heading, '::') + 2)"))).otherwise(F.trim(h))
    return cls, name


def context_sinks(it: DataFrame) -> DataFrame:
    """X49 sinks: name (signature removed), class, vuln_type, confidence HIGH."""
    s = it.where(F.col("kind") == "custom_sinks")
    cls, name = _split_heading(F.col("heading"))
    nm = F.trim(F.regexp_replace(F.coalesce(kv_get(F.col("kv"), "method"), name), r"\(.*\)", ""))
    vt = F.coalesce(kv_get(F.col("kv"), "vuln_type"),
                    F.when(vuln_from_text(F.col("rest")) != "", vuln_from_text(F.col("rest"))), F.lit("unknown"))
    out = s.select("doc_id", "sec_pos", "item_pos", nm.alias("name"),
                   F.coalesce(kv_get(F.col("kv"), "class"), cls).alias("class"), vt.alias("vuln_type"),
                   F.coalesce(kv_get(F.col("kv"), "risk"), kv_get(F.col("kv"), "note"), F.lit("")).alias("note"),
                   F.lit("HIGH").alias("confidence"))
    return out.where(F.col("name") != "")


def qualify_source(cls: Column, name: Column) -> Column:
    """``SimpleClass::method`` (last segment after '\\' and '.')."""
    simple = F.substring_index(F.substring_index(F.coalesce(cls, F.lit("")), "\\", -1), ".", -1)
    return F.when(simple != "", F.concat(simple, F.lit("::"), name)).otherwise(name)


def context_sources(it: DataFrame) -> DataFrame:
    """X49 sources with the X51 qualified name."""
    s = it.where(F.col("kind") == "custom_sources")
    cls, name = _split_heading(F.col("heading"))
    nm = F.trim(F.regexp_replace(F.coalesce(kv_get(F.col("kv"), "method"), name), r"\(.*\)", ""))
    c = F.coalesce(kv_get(F.col("kv"), "class"), cls)
    out = s.select("doc_id", "sec_pos", "item_pos", nm.alias("name"), c.alias("class"),
                   F.coalesce(kv_get(F.col("kv"), "source_type"), F.lit("unknown")).alias("source_type"),
                   F.coalesce(kv_get(F.col("kv"), "note"), F.lit("")).alias("note"))
    return out.where(F.col("name") != "").withColumn("qualified", qualify_source(F.col("class"), F.col("name")))


def context_flows(it: DataFrame) -> DataFrame:
    """X49 flows: entry = heading without parentheses."""
    s = it.where(F.col("kind") == "sensitive_flows")
    entry = F.trim(F.regexp_replace("heading", r"\s*\(.*?\)", ""))
    out = s.select("doc_id", "sec_pos", "item_pos", F.col("heading").alias("description"),
                   F.coalesce(kv_get(F.col("kv"), "entry"), entry).alias("entry"),
                   F.coalesce(kv_get(F.col("kv"), "risk"), kv_get(F.col("kv"), "impact"), F.lit("")).alias("risk"))
    return out.where(F.col("entry") != "")


BULLET_RE = r"^[-*•]+"
CALL_RE = r"^(\w+)\s*(?:\(([^)]*)\))?"


def _first_value(kv: Column, *keys: str) -> Column:
    return F.coalesce(*[kv_get(kv, k) for k in keys])


def _params(text: Column) -> Column:
    """Comma-separated names, empty ones left out."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), _strip), lambda p: p != "")


def _bullets(secs: DataFrame, kind: str) -> DataFrame:
    """Lines of sections without sub-headings, list marks removed."""
    lines = secs.where((F.col("kind") == kind) & ~F.col("body").rlike(r"(?m)^###\s+")).select(
        "doc_id", "sec_pos", F.posexplode(F.split("body", r"\r\n|\n|\r")).alias("item_pos", "line"))
    clean = lines.withColumn("line", _strip(F.regexp_replace(_strip(F.col("line")), BULLET_RE, "")))
    return clean.where((F.col("line") != "") & ~F.col("line").startswith("#"))


def context_api_names(secs: DataFrame, it: DataFrame) -> DataFrame:
    """(doc_id, name, params, note) of API names, from sub-headings or bullets ``Name(p1, p2): note``."""
    kv, h = F.col("kv"), F.col("heading")
    named = it.where(F.col("kind") == "api_names").select(
        "doc_id", "sec_pos", "item_pos",
        F.trim(F.regexp_replace(F.coalesce(_first_value(kv, "name", "method_name"), F.nullif(F.regexp_extract(h, CALL_RE, 1), F.lit("")),
                                           F.trim(h)), r"\(.*\)", "")).alias("name"),
        _params(F.coalesce(_first_value(kv, "params", "param", "parameters"), F.regexp_extract(h, CALL_RE, 2))).alias("params"),
        F.coalesce(_first_value(kv, "note", "risk", "description"), F.lit("")).alias("note"))
    line = F.col("line")
    before = F.substring_index(line, ":", 1)
    note = F.when(line.contains(":") & ~before.contains("("), _strip(F.regexp_replace(line, r"^[^:]*:", ""))).otherwise("")
    short = _bullets(secs, "api_names").select(
        "doc_id", "sec_pos", "item_pos",
        _strip(F.substring_index(F.substring_index(line, "(", 1), ":", 1)).alias("name"),
        _params(F.regexp_extract(line, r"\(([^)]+)\)", 1)).alias("params"), note.alias("note"))
    return named.where("name <> ''").unionByName(short.where("name <> ''"))


def context_function_params(secs: DataFrame, it: DataFrame) -> DataFrame:
    """(doc_id, function, param, taint_reason), one row per parameter."""
    kv, h = F.col("kv"), F.col("heading")
    why = F.coalesce(_first_value(kv, "taint_reason", "taint", "note", "risk"), F.lit(""))
    headed = it.where(F.col("kind") == "function_params").select(
        "doc_id", "sec_pos", "item_pos",
        F.coalesce(F.nullif(F.regexp_extract(h, CALL_RE, 1), F.lit("")), F.trim(h)).alias("function"),
        _strip(F.coalesce(_first_value(kv, "param", "params"), F.regexp_extract(h, CALL_RE, 2))).alias("param"),
        why.alias("taint_reason"))
    line, full = F.col("line"), r"^(\w+)\s*\(([^)]+)\)\s*:?\s*(.*)"
    called = line.rlike(full)
    rest = F.when(line.contains(":"), _strip(F.regexp_replace(line, r"^[^:]*:", ""))).otherwise("")
    listed = _bullets(secs, "function_params").select(
        "doc_id", "sec_pos", "item_pos",
        F.when(called, F.regexp_extract(line, full, 1)).otherwise(_strip(F.substring_index(line, ":", 1))).alias("function"),
        F.explode(F.when(called, _params(F.regexp_extract(line, full, 2))).otherwise(F.array(F.lit("")))).alias("param"),
        F.when(called, _strip(F.regexp_extract(line, full, 3))).otherwise(rest).alias("taint_reason"))
    return headed.unionByName(listed).where("function <> ''")


def looks_structured(text: Column) -> Column:
    """The text is a JSON object with a known key."""
    keys = F.when(F.trim(text).startswith("{") & F.try_parse_json(text).isNotNull(), F.json_object_keys(text))
    return F.coalesce(F.arrays_overlap(keys, F.array(*[F.lit(k) for k in CONTEXT_KEYS])), F.lit(False))


def normalize_context(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, pos, name, detail) of structured documents, defaults applied.

    Entries that aren't objects are left out, except API names and sources,
    which may be plain strings.  ``detail`` is a sink's confidence, a source's
    note, a flow's description, a parameter's name.  The documents are written
    once, as a union of lists that still lie by document gives all of a
    partition's lists to one task.
    """
    text = F.col("text")
    good = written(docs.where(looks_structured(text)).select("doc_id", "text"))

    def entries(key, kind):
        listed = F.try_variant_get(F.try_parse_json(text), f"$.{key}", "array<variant>")
        rows = good.select("doc_id", F.lit(kind).alias("kind"), F.posexplode(listed).alias("pos", "v"))
        form = F.schema_of_variant("v")
        return rows.select("doc_id", "kind", "pos", form.startswith("OBJECT").alias("is_object"), (form == "STRING").alias("is_text"),
                           F.when(form == "STRING", F.try_variant_get("v", "$", "string")).otherwise(F.to_json("v")).alias("e"))

    def get(key, default=""):
        return F.coalesce(F.get_json_object("e", f"$.{key}"), F.lit(default) if isinstance(default, str) else default)
    is_object = F.col("is_object")
    parts = []
    for key, name, detail, test in (
            ("custom_sinks", get("name"), get("confidence", "HIGH"), is_object),
            ("custom_sources", qualify_source(get("class"), get("name")), get("note"), is_object),
            ("sensitive_flows", get("entry"), get("description", get("entry")), is_object),
            ("non_http_sources", F.col("e"), F.lit(""), F.col("is_text")),
            ("api_names", F.when(is_object, get("name")).otherwise(F.col("e")), F.lit(""), is_object | F.col("is_text")),
            ("function_params", get("function"), get("param"), is_object)):
        rows = entries(key, key).where(test).select("doc_id", "kind", "pos", name.alias("name"), detail.alias("detail"))
        if key in ("api_names", "function_params"):
            rows = rows.where("name <> ''")
        parts.append(rows)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


LISTS = ("custom_sinks", "custom_sources", "sensitive_flows", "non_http_sources", "api_names", "function_params")


def context_summary(docs: DataFrame) -> DataFrame:
    """Per document the size of each context list and a notes flag: one aggregate over all entries.

    Documents, items and structured entries are written once; each list then reads files in splits of bounded size,
    where lists that still lie by document would be read by one task a partition, all of them together.
    """
    docs = written(docs.select("doc_id", "text"))
    secs = sections(docs)
    it = written(items(secs))
    structured = written(normalize_context(docs).select("doc_id", "kind", "name"))
    sources = context_sources(it)

    def tagged(df, kind, name=None):
        return df.select("doc_id", F.lit(kind).alias("kind"), (F.col(name) if name else F.lit(None).cast("string")).alias("name"))
    rows = (tagged(context_sinks(it), "custom_sinks").unionByName(tagged(sources, "custom_sources"))
            .unionByName(tagged(sources, "non_http_sources", "qualified"))
            .unionByName(tagged(context_flows(it), "sensitive_flows"))
            .unionByName(tagged(context_api_names(secs, it), "api_names"))
            .unionByName(tagged(context_function_params(secs, it), "function_params"))
            .unionByName(tagged(secs.where((F.col("kind") == "notes") & (F.trim("body") != "")), "notes"))
            .unionByName(docs.select("doc_id", F.lit("doc").alias("kind"), F.lit(None).cast("string").alias("name")))
            .unionByName(structured.select("doc_id", "kind", F.when(F.col("kind") == "non_http_sources", F.col("name")).alias("name")))
            .unionByName(structured.where("kind = 'custom_sources' and name <> ''").select(
                "doc_id", F.lit("non_http_sources").alias("kind"), "name")))
    counts = [F.count_distinct(F.when(F.col("kind") == k, F.col("name"))).alias(k) if k == "non_http_sources"
              else F.count_if(F.col("kind") == k).alias(k) for k in LISTS]
    return rows.groupBy("doc_id").agg(*counts, F.max(F.col("kind") == "notes").alias("has_notes"))
