"""Queries: near duplicates, repeated passages."""

from __future__ import annotations

from sparkaudit.llm import bottomk, suffix_dedup
from sparkaudit.llm.common import table
from sparkaudit.llm.registry import register

OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                              'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (g)
      WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT a AS id, a AS seen FROM (SELECT DISTINCT a FROM l) UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.seen),
m AS (SELECT id, min(seen) AS low FROM r GROUP BY id)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(low, w.doc_id) AS component_id,
       coalesce(low, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.id = w.doc_id
"""


@register("op10_near_duplicates", OP10_SQL)
def op10_near_duplicates(spark, sf_dir):
    """Near-duplicate group of every whole document."""
    return bottomk.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


@register("op3_suffix_dedup")
def op3_suffix_dedup(spark, sf_dir):
    """What every whole document keeps when repeated 400-byte strings go."""
    return suffix_dedup.measure_documents(table(spark, sf_dir, "documents"))
