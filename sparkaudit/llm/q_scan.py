"""Queries: scans of every document."""

from __future__ import annotations

from sparkaudit.llm import license_scan, secrets_ledger, toxicity, winnowing
from sparkaudit.llm.common import table
from sparkaudit.llm.registry import register


@register("op2_secret_scan")
def op2_secret_scan(spark, sf_dir):
    """Secrets of every whole text; first run of the blob ledger over the table."""
    return secrets_ledger.scan_documents(table(spark, sf_dir, "documents"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP9_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 10) AS n FROM (
        SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
      WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
dw AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i
             FROM d JOIN (SELECT DISTINCT n FROM b) ON len(w) >= n)),
m AS (SELECT r, i, n, item_id FROM dw JOIN bw USING (n, g)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
own AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM m WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN own USING (r)
"""


@register("op9_decontamination", OP9_SQL)
def op9_decontamination(spark, sf_dir):
    """Benchmark words found in every whole document."""
    return winnowing.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op5_toxicity")
def op5_toxicity(spark, sf_dir):
    """Probabilities of the toxicity categories for every whole document."""
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op1_license_scan")
def op1_license_scan(spark, sf_dir):
    """Licences that every whole document names."""
    return license_scan.scan_documents(table(spark, sf_dir, "documents"))
