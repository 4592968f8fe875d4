"""Registered queries: incremental scans of a corpus that changes between two runs.

The first corpus is `documents` as they were: every fifth had other text, every
seventh wasn't there yet, and every eleventh stood under another name as well.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkaudit import catalogs as K
from sparkaudit.functions.core import contains_any
from sparkaudit.operators import secrets as S
from sparkaudit.plans import inputs as I
from sparkaudit.plans.q_secrets import DOC_FILE, SECRETS_SQL
from sparkaudit.plans.registry import register
from sparkaudit.plans.sqlfrag import contains_any as contains_any_sql
from sparkaudit.sources import ledger as G
from sparkaudit.streaming import streams as ST

SECRETS = G.Scan("secrets", 1, S.secrets_scan, lambda path: ~contains_any(path, K.SECRET_SKIP_DIRS))
KEYS = ("source", "file")

# Both engines read these two texts.
_NOW = f"SELECT source, {DOC_FILE} AS file, text FROM documents"
_BEFORE = f"""
SELECT source, {DOC_FILE} AS file,
  CASE WHEN doc_id % 5 = 0 THEN coalesce(text, '') || chr(10) || 'draft' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0
UNION ALL SELECT source, {DOC_FILE} || '.old' AS file, text FROM documents WHERE doc_id % 11 = 0
"""


def _corpora(spark, sf):
    I.register_tables(spark, sf, ["documents"])
    return spark.sql(_BEFORE), spark.sql(_NOW)


def _two_runs(spark, sf):
    before, now = _corpora(spark, sf)
    base = ST.new_folder(spark, "ledger")
    return [G.incremental_scan(files, base, SECRETS, KEYS, "text") for files in (before, now)]


@register("incremental_secrets_scan", (), SECRETS_SQL)
def q_incremental_secrets_scan(spark, sf):
    """X43 on a corpus that was scanned before it changed: only new contents are scanned, the result is that of a full scan."""
    return _two_runs(spark, sf)[1].findings.drop("source")


_EXT = r"lower(regexp_extract(file, '(\.[^./]+)$', 1))"
_READ = f"NOT {contains_any_sql("coalesce(file, '')", K.SECRET_SKIP_DIRS)}"


@register("incremental_scan_runs", (), f"""
WITH f AS (SELECT 1 AS run, * FROM ({_BEFORE}) b UNION ALL SELECT 2 AS run, * FROM ({_NOW}) n),
x AS (SELECT run, sha256(coalesce(text, '')) || {_EXT} AS blob FROM f WHERE {_READ}),
first AS (SELECT blob, min(run) AS run FROM x GROUP BY blob)
SELECT CAST(r.run AS INTEGER) AS run, (SELECT count(*) FROM x WHERE x.run = r.run) AS files,
  (SELECT count(DISTINCT blob) FROM x WHERE x.run = r.run) AS contents,
  (SELECT count(*) FROM first WHERE first.run = r.run) AS scanned
FROM (SELECT 1 AS run UNION ALL SELECT 2) r
""")
def q_incremental_scan_runs(spark, sf):
    """Files, contents and contents scanned of both runs."""
    out = None
    for i, run in enumerate(_two_runs(spark, sf)):
        rows = run.index.select(F.lit(i + 1).alias("run"), "blob_id", F.lit(False).alias("new")).unionAll(
            run.scanned.select(F.lit(i + 1), "blob_id", F.lit(True)))
        out = rows if out is None else out.unionAll(rows)
    return out.groupBy("run").agg(F.count_if(~F.col("new")).alias("files"), F.countDistinct("blob_id").alias("contents"),
                                  F.count_if("new").alias("scanned"))


@register("corpus_changes", (), f"""
WITH b AS ({_BEFORE}), n AS ({_NOW})
SELECT coalesce(n.source, b.source) AS source, coalesce(n.file, b.file) AS file,
  CASE WHEN b.file IS NULL THEN 'added' WHEN n.file IS NULL THEN 'removed'
       WHEN coalesce(b.text, '') = coalesce(n.text, '') THEN 'unchanged' ELSE 'changed' END AS change
FROM n FULL JOIN b ON n.file = b.file AND n.source = b.source
""")
def q_corpus_changes(spark, sf):
    """What became of each file."""
    before, now = (G.corpus_index(files, KEYS, "text") for files in _corpora(spark, sf))
    return G.corpus_changes(before, now, KEYS)


@register("stream_incremental_secrets", (), SECRETS_SQL)
def q_stream_incremental_secrets(spark, sf):
    """ST5 with the ledger: a stream of documents after a scan of what they were; contents seen aren't scanned again."""
    before, _ = _corpora(spark, sf)
    folder = ST.new_folder(spark, "incremental")
    G.incremental_scan(before, f"{folder}/ledger", SECRETS, KEYS, "text")
    path = f"{sf.rstrip('/')}/documents.parquet*"
    docs = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path).selectExpr("source", f"{DOC_FILE} AS file", "text")
    return ST.incremental_scan_to_table(docs, folder, f"{folder}/ledger", SECRETS, KEYS, "text").drop("source")
