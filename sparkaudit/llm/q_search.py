"""Queries: searches over every embedding."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkaudit.llm import cover_tree, gnat
from sparkaudit.llm.common import table
from sparkaudit.llm.registry import register

# rows that take part, as whole numbers; rows that repeat an id with its vector count once
_ROWS = """
r AS (SELECT DISTINCT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
      FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""

_DOT = "list_dot_product({0}::DOUBLE[], {1}::DOUBLE[])::BIGINT"

OP13_SQL = f"""
WITH {_ROWS},
s AS (SELECT q.vec_id AS query_id, q.v AS v, c.vec_id, {_DOT.format("q.v", "c.v")} AS score
      FROM r q JOIN r c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, v ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


@register("op13_exact_top_k", OP13_SQL)
def op13_exact_top_k(spark, sf_dir):
    """The five rows nearest by inner product to every fiftieth embedding."""
    return cover_tree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


OP12_SQL = f"""
WITH {_ROWS},
l AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, v FROM r WHERE label IS NOT NULL),
s AS (SELECT a.vec_id AS anchor_id, a.v AS v, a.label AS own, c.label, c.vec_id, {_DOT.format("a.v", "c.v")} AS score
      FROM l a JOIN l c ON c.vec_id <> a.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id, v ORDER BY score DESC, vec_id) AS k FROM s WHERE label = own),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.v, p.k ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.v = p.v AND s.label <> s.own
        AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
      WHERE p.k <= 5)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


@register("op12_hard_negatives", OP12_SQL)
def op12_hard_negatives(spark, sf_dir):
    """Hard negatives of every fiftieth embedding, for each of its five positives."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return gnat.hard_negatives(rows, F.col("vec_id") % 50 == 0)
