"""Queries: mixing, quality, token counts."""

from __future__ import annotations

from sparkaudit.llm import mixing, pairwise_quality, rules_forest, token_counts
from sparkaudit.llm.common import table
from sparkaudit.llm.registry import register

OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  ('0x' || substr(sha256('20:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 13))
                      ::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3]::DOUBLE AS weight
      FROM d GROUP BY source),
f AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS fill FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (
                    ORDER BY fill, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY fill, source ASC NULLS LAST
                                    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
t AS (SELECT source, source_size, CASE WHEN stop IS NULL OR fill < stop THEN cap
                                       ELSE least(cap, level_at * weight) END AS target
      FROM (SELECT *, min(CASE WHEN level <= fill THEN fill END) OVER () AS stop,
                   max(CASE WHEN level <= fill THEN level END) OVER () AS level_at FROM l)),
p AS (SELECT doc_id, size, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       ((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM p
"""


@register("op4_mixing", OP4_SQL)
def op4_mixing(spark, sf_dir):
    """How many words the mix takes of every document."""
    return mixing.plan_documents(table(spark, sf_dir, "documents"))


@register("op8_token_counts")
def op8_token_counts(spark, sf_dir):
    """Tokens of every whole text under the 32k piece vocabulary."""
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@register("op6_quality_ranking")
def op6_quality_ranking(spark, sf_dir):
    """Quality score of every whole document."""
    return pairwise_quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op7_quality_rules")
def op7_quality_rules(spark, sf_dir):
    """Rule statistics and verdict of every whole document."""
    return rules_forest.judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
