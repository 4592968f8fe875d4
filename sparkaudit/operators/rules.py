"""Scanner results, graph rows and packaged scan rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkaudit import catalogs_rules as K
from sparkaudit.operators.dims import contains_many

LINE_SPLIT = r"\r\n|\n|\r"
RESULT = ("struct<check_id:string,path:string,start:struct<line:int>,"
          "extra:struct<lines:string,message:string,severity:string>>")


def ingest_scan_results(raw: DataFrame, text: str = "raw", keep: tuple[str, ...] = ()) -> DataFrame:
    """S3: one row per entry of ``results`` of each scanner document.

    A document that isn't JSON, or has no such list, gives no rows; missing
    fields get the defaults of a scanner row ('' and line 0, severity WARNING).
    """
    parsed = F.from_json(F.col(text), f"struct<results:array<{RESULT}>>")["results"]
    r = raw.where(F.try_parse_json(F.col(text)).isNotNull()).select(*keep, F.posexplode(parsed).alias("pos", "r"))
    field = lambda c, default: F.coalesce(F.col(c), F.lit(default))
    return r.select(
        *keep, "pos", field("r.check_id", "").alias("check_id"), field("r.path", "").alias("path"),
        field("r.start.line", 0).alias("line"),
        F.regexp_replace(field("r.extra.lines", ""), r"^\s+|\s+$", "").alias("code"),
        field("r.extra.message", "").alias("message"), F.upper(field("r.extra.severity", "WARNING")).alias("severity"))


def ingest_graph_rows(raw: DataFrame, schema: str, text: str = "raw", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a graph query's output: a JSON array, an object with ``rows``, or JSON lines, of
    which bad ones are left out.  ``schema`` lists a row's fields."""
    t = F.trim(F.col(text))
    row = f"struct<{schema}>"

    def valid(x):  # the parser stops after a first value: what is left must not follow it
        closed = (x.startswith("{") & x.endswith("}")) | (x.startswith("[") & x.endswith("]"))
        return closed & F.try_parse_json(x).isNotNull()
    lines = F.filter(F.transform(F.split(t, LINE_SPLIT), lambda x: F.trim(x)), lambda x: x != "")
    by_line = (F.size(lines) > 1) & valid(lines[0])
    wrapped = F.from_json(t, f"struct<rows:array<{row}>>")["rows"]
    rows = (F.when(by_line | ~valid(t), F.transform(F.filter(lines, valid), lambda x: F.from_json(x, row)))
            .when(t.startswith("["), F.from_json(t, f"array<{row}>"))
            .when(wrapped.isNotNull(), wrapped).otherwise(F.array(F.from_json(t, row))))
    return raw.select(*keep, F.posexplode(rows).alias("pos", "r")).select(*keep, "pos", "r.*")


def rule_regex(pattern: str) -> str:
    """A rule pattern as a regular expression: `...` is anything on the line, `$NAME` a name, spaces may vary."""
    out = []
    for part in re.split(r"(\.\.\.|\$[A-Z]+|\s+)", pattern):
        if part == "...":
            out.append(".*?")
        elif part.startswith("$"):
            out.append(r"[\w.]+")
        elif part.isspace():
            out.append(r"\s*")
        else:
            out.append("".join("\\" + c if c in r"\.+*?()[]{}|^$" else c for c in part))
    return "".join(out)


def either(patterns: list[str]) -> str:
    return "|".join(f"(?:{rule_regex(p)})" for p in patterns)


def rule_scan(files: DataFrame) -> DataFrame:
    """(repo, file, line, rule_id, severity, cwe, owasp, code) of sink lines in files where a source
    pattern of the rule occurs too (any sink line for rules without sources).

    This is co-occurrence in a file, not taint tracking.  One projection per
    language; lines that match are kept by number before they are exploded.
    """
    out = None
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    for language, exts in K.RULE_EXTS.items():
        rules = [r for r in K.RULES if r[3] == language]
        any_sink = "|".join(either(r[7]) for r in rules)
        src = files.where(ext.isin(*exts) & F.coalesce("content", F.lit("")).rlike(any_sink)).select(
            "repo", F.col("path").alias("file"), "content", F.split("content", LINE_SPLIT).alias("lines"))
        found = src.select("repo", "file", F.explode(F.concat(*[_sink_lines(r) for r in rules])).alias("h")).select(
            "repo", "file", "h.*")
        out = found if out is None else out.unionByName(found)
    return out


def _sink_lines(rule: tuple) -> Column:
    """array<struct<line, code, rule_id, severity, cwe, owasp>> of a file for one rule."""
    rule_id, _, severity, _, cwe, owasp, sources, sinks = rule
    at = F.filter(F.transform("lines", lambda x, i: F.struct((i + 1).alias("line"), F.trim(x).alias("code"))),
                  lambda x: x["code"].rlike(either(sinks)))
    named = F.transform(at, lambda x: F.struct(
        x["line"].alias("line"), x["code"].alias("code"), F.lit(rule_id).alias("rule_id"),
        F.lit(severity).alias("severity"), F.lit(cwe).alias("cwe"), F.lit(owasp).alias("owasp")))
    return named if not sources else F.when(F.col("content").rlike(either(sources)), named).otherwise(F.slice(named, 1, 0))


def source_pattern(source: Column) -> Column:
    """A caller's source as a regular expression."""
    return F.replace(F.replace(source, F.lit("::"), F.lit(".*")), F.lit("..."), F.lit(".*"))


def extra_source_hits(files: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, repo, file, line) of lines that match a caller's source pattern.

    ``sources``: (source).  A line meets a pattern only if it contains the
    pattern's longest plain word, by keyed containment; then the expression
    decides.
    """
    pattern = source_pattern(F.col("source"))
    plain = F.array_sort(F.regexp_extract_all(pattern, F.lit(r"\w+"), 0),
                         lambda a, b: F.length(b) - F.length(a))
    # the last character may carry a quantifier
    word = F.when(pattern.contains("|"), F.lit("")).otherwise(
        F.coalesce(F.try_element_at(F.transform(plain, lambda w: F.substring(w, 1, F.length(w) - 1)), F.lit(1)), F.lit("")))
    keyed = sources.select("source").distinct().select("source", pattern.alias("pattern"), word.alias("word"))
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    lines = files.where(ext.isin(*K.EXTRA_EXTS)).select(
        "repo", F.col("path").alias("file"), F.posexplode(F.split("content", LINE_SPLIT)).alias("pos", "text"))
    texts = contains_many(lines.select("text").distinct(), keyed, "text", "word").where(
        F.regexp(F.col("text"), F.col("pattern"))).select("text", "source")
    return lines.join(texts, "text").select("source", "repo", "file", (F.col("pos") + 1).alias("line"))
