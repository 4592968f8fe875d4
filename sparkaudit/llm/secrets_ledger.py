"""Secret scan with an incremental blob ledger.

Every historical version of a path is addressed by the SHA-256 of its text.
The ledger holds one row per blob and run: which rule versions have seen it and
what they found.  A run scans only (blob, rule version) pairs that the ledger
lacks, and joins the findings back to every path that ever held the blob.

Defined cases: a null text is the empty blob; repeated rows share one blob and
get equal findings; an empty table gives an empty result; further columns of
the input are not read, so their names can't clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkaudit.llm.common import new_table_path


class Rule(NamedTuple):
    kind: str
    version: int
    pattern: str
    gate: tuple[str, ...]      # one of these (lower case) must occur in the lower-cased text
    group: int = 0             # the part whose length counts
    least: int = 0             # fewest characters of that part
    flags: int = re.ASCII

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The three base kinds come first and in this order.
BASE_RULES = (
    Rule("assign", 1,
         r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         ("password", "passwd", "secret", "token", "api_key", "apikey"), 2, 6, re.ASCII | re.IGNORECASE),
    Rule("access", 1, r"AKIA[A-Z0-9]+", ("akia",), 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", (), 0, 24),  # runs are maximal, so the length may stand in the pattern
)
MORE_RULES = (
    # up to its own END line; without one, header lines and what follows up to a hyphen
    Rule("private_key", 2, r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY(?: BLOCK)?-----"
         r"(?:(?:(?!-----BEGIN )[\s\S])*?-----END (?:[A-Z]+ )*PRIVATE KEY(?: BLOCK)?-----"
         r"|(?:\s*[A-Za-z-]+: [^\n]*\n)*[^-]*)", ("private key",)),
    Rule("code_host", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("chat", 1, r"xox[abeprs]-[A-Za-z0-9-]{10,}", ("xox",)),
    Rule("maps", 1, r"AIza[A-Za-z0-9_-]{35}", ("aiza",)),
    # starts only where a run of token characters does, so a long run is read once
    Rule("jwt", 2, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]+", ("eyj",)),
    Rule("url_login", 1, r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,64}:[^\s:/@]{3,128}@", ("://",)),
)
RULES = BASE_RULES + MORE_RULES

SPAN = "struct<kind:string,start:bigint,`end`:bigint>"


def find_spans(text: str, rules: tuple[Rule, ...]) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then by the order of ``rules``."""
    lower, found = text.lower(), []
    for order, rule in enumerate(rules):
        if rule.gate and not any(word in lower for word in rule.gate):
            continue
        for m in _compiled(rule).finditer(text):
            a, b = m.span(rule.group)
            if b - a >= rule.least:
                found.append((m.start(), order, rule.kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def _compiled(rule: Rule) -> re.Pattern:
    return re.compile(rule.pattern, rule.flags)  # re keeps compiled patterns


def versions(docs: DataFrame, path: str, text: str) -> DataFrame:
    """(path, blob_id, text): each version addressed by its content."""
    content = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(path).alias("path"), F.sha2(content, 256).alias("blob_id"), content.alias("text"))


def pending(found: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob_id, text, todo): one row per blob with the rule versions that haven't seen it."""
    blobs = found.select("blob_id", "text").dropDuplicates(["blob_id"])
    keys = F.array(*[F.lit(r.key) for r in rules])
    if ledger is None:
        return blobs.withColumn("todo", keys)
    seen = ledger.groupBy("blob_id").agg(F.array_distinct(F.flatten(F.collect_list("seen"))).alias("seen"))
    todo = F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>")))
    return (blobs.join(seen, "blob_id", "left").withColumn("todo", todo)
            .where(F.size("todo") > 0).select("blob_id", "text", "todo"))


def scan(unseen: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows (blob_id, seen, spans) of the blobs in ``unseen``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for text, todo in zip(batch.column(1), batch.column(2), strict=True):
                wanted = set(todo.as_py())
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in
                              find_spans(text.as_py(), tuple(r for r in rules if r.key in wanted))])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(spans, kind)],
                                             ["blob_id", "seen", "spans"])

    return unseen.mapInArrow(run, f"blob_id string, seen array<string>, spans array<{SPAN}>")


def run_ledger(found: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES,
               first: bool = False) -> DataFrame:
    """Scan what the ledger at ``ledger_path`` lacks, append it there, return the whole ledger.

    ``first`` says that there is no ledger yet.  Appending is a Spark write: a
    failed run leaves no rows, and a repeated one finds nothing unseen.
    """
    spark = found.sparkSession
    old = None if first else spark.read.parquet(ledger_path)
    scan(pending(found, old, rules), rules).write.mode("append").parquet(ledger_path)
    return spark.read.parquet(ledger_path)


def findings(found: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, blob_id, spans) for every version, spans in order; blobs without findings have none.

    Only blobs with findings are joined; both sides are narrow, and a blob held
    by very many paths is a skewed key of one side that Spark splits.
    """
    order = {r.kind: i for i, r in enumerate(rules)}
    rank = F.create_map(*[x for k, i in order.items() for x in (F.lit(k), F.lit(i))])
    spans = (ledger.where(F.size("spans") > 0).groupBy("blob_id")
             .agg(F.flatten(F.collect_list("spans")).alias("spans"))
             .select("blob_id", F.transform(
                 F.array_sort(F.transform("spans", lambda s: F.struct(
                     s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["kind"].alias("kind"),
                     s["end"].alias("end")))),
                 lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"),
                                    s["end"].alias("end"))).alias("spans")))
    return (found.select("path", "blob_id").join(spans, "blob_id", "left")
            .select("path", "blob_id", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans")))


def listing(spans, kinds: list[str] | None = None):
    """``kind:start:end`` of the spans, comma-joined."""
    if kinds is not None:
        spans = F.filter(spans, lambda s: s["kind"].isin(kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_documents(docs: DataFrame) -> DataFrame:
    """Digest per document: each row of ``docs`` is a version of the path ``doc_id``."""
    found = versions(docs, "doc_id", "text")
    ledger = run_ledger(found, new_table_path(docs.sparkSession, "blob-ledger"), first=True)
    base = [r.kind for r in BASE_RULES]

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return findings(found, ledger).select(
        F.col("path").alias("doc_id"), *[count(k) for k in base],
        F.sha2(listing(F.col("spans"), base), 256).alias("base_sha256"),
        listing(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, replacement: str = "[secret]") -> DataFrame:
    """``docs`` with every span replaced (overlapping spans as one) and ``n_chars`` of the new text.

    Texts without findings, and null ones, stay as they are; all columns and their types stay.
    """
    spark, columns = docs.sparkSession, docs.columns
    content = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(F.lit(0).alias("path"), F.sha2(content, 256).alias("blob_id"), content.alias("text"))
    ledger = run_ledger(found, new_table_path(spark, "blob-ledger"), first=True)
    spans = (ledger.where(F.size("spans") > 0).groupBy(F.col("blob_id").alias("llm_blob"))
             .agg(F.flatten(F.collect_list("spans")).alias("llm_spans")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = batch.column(batch.num_columns - 1)
            if hits.null_count == len(hits):
                yield pa.RecordBatch.from_arrays(batch.columns[:len(columns)], columns)
                continue
            changed = {name: batch.column(columns.index(name)).to_pylist()
                       for name in ("text", "n_chars") if name in columns}
            for i, spans in enumerate(hits.to_pylist()):
                if spans:
                    new = cut(changed["text"][i], [(s["start"], s["end"]) for s in spans], replacement)
                    for name, value in (("text", new), ("n_chars", len(new))):
                        if name in changed:
                            changed[name][i] = value
            yield pa.RecordBatch.from_arrays(
                [pa.array(changed[name], batch.column(i).type) if name in changed else batch.column(i)
                 for i, name in enumerate(columns)], columns)

    joined = (docs.withColumn("llm_blob", F.sha2(content, 256)).join(spans, "llm_blob", "left")
              .select(*[F.col(f"`{c}`") for c in columns], "llm_spans"))
    return joined.mapInArrow(run, docs.schema)


def cut(text: str, spans: list[tuple[int, int]], replacement: str) -> str:
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], replacement]
        at = max(at, end)
    return "".join([*out, text[at:]])

