"""Data models and playbook severities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkaudit import catalogs_surface as S
from sparkaudit.functions.core import contains_any


def model_classes(nodes: DataFrame, contains: DataFrame) -> DataFrame:
    """(model_name, file, fields): classes named or placed like models, with their distinct fields.

    ``contains``: (parent, child) node ids; nodes: (node_id, name, file, type).
    """
    name, file = F.lower("name"), F.lower("file")
    models = nodes.where(F.col("type").isin(*S.MODEL_TYPES) & (
        contains_any(name, S.MODEL_NAME_WORDS) | contains_any(file, S.MODEL_FILE_WORDS))).select(
        F.col("node_id").alias("parent"), F.col("name").alias("model_name"), "file")
    fields = nodes.where(F.col("type").isin(*S.FIELD_TYPES)).select(F.col("node_id").alias("child"), F.col("name").alias("field"))
    pairs = contains.join(models, "parent").join(fields, "child").select("model_name", "file", "field").distinct()
    return pairs.groupBy("model_name", "file").agg(F.array_sort(F.collect_list("field")).alias("fields"))


def _has(fields: str, pattern: str) -> Column:
    return F.exists(fields, lambda f: f.rlike(pattern))


def idor_severity(candidates: DataFrame, models: DataFrame) -> DataFrame:
    """``candidates`` (with ``model_name``) with a severity by the model's fields: sensitive ones are CRITICAL,
    financial ones HIGH, anything else MEDIUM."""
    m = models.select("model_name", "fields", "sensitive_fields")
    sev = F.when(F.size("sensitive_fields") > 0, "CRITICAL").when(_has("fields", S.FINANCIAL_RE), "HIGH").otherwise("MEDIUM")
    return candidates.join(m, "model_name", "left").withColumn("severity", sev).drop("fields", "sensitive_fields")


def mass_assign_severity(assignments: DataFrame, models: DataFrame) -> DataFrame:
    """A privilege field in the assigned model is CRITICAL, a financial one HIGH, another risky one MEDIUM,
    no such field LOW."""
    m = models.select("model_name", "fields", "mass_assign_risk")
    sev = (F.when(_has("fields", S.PRIVILEGE_RE), "CRITICAL").when(_has("fields", S.FINANCIAL_RE), "HIGH")
           .when(F.size("mass_assign_risk") > 0, "MEDIUM").otherwise("LOW"))
    return assignments.join(m, "model_name", "left").withColumn("severity", sev).drop("fields", "mass_assign_risk")


def confidence_calibration(findings: DataFrame) -> DataFrame:
    """C11: ``findings`` with the playbook and confidence of their ``scenario`` (null where no playbook has it)."""
    table = F.create_map(*[x for p, s, c in S.CONFIDENCE for x in (
        F.lit(s), F.struct(F.lit(p).alias("playbook"), F.lit(c).alias("confidence")))])
    rows = findings.sparkSession.range(1).select(F.explode(table).alias("scenario", "v")).select("scenario", "v.*")
    return findings.join(rows, "scenario", "left")


def missing_rate_limit(endpoints: DataFrame, dependencies: DataFrame) -> DataFrame:
    """endpoints of a risky path without a limiter tag; HIGH where the repository has no limiter library.

    ``dependencies``: (repo, dependency).
    """
    low = F.lower("path")
    group = F.array_compact(F.array(*[F.when(contains_any(low, paths), F.lit(g)) for g, paths in S.RATE_LIMIT_PATHS.items()]))
    tags = F.lower(F.array_join("auth_tags", " "))
    risky = endpoints.withColumn("risk_group", F.try_element_at(group, F.lit(1))).where(
        F.col("risk_group").isNotNull() & ~contains_any(tags, S.RATE_LIMIT_TAGS))
    limited = dependencies.where(contains_any(F.lower("dependency"), S.RATE_LIMIT_LIBS)).select("repo").distinct().withColumn(
        "limited", F.lit(True))
    return risky.join(limited, "repo", "left").withColumn(
        "confidence", F.when(F.col("limited"), "MEDIUM").otherwise("HIGH")).drop("limited")


def manual_review(text: Column) -> Column:
    """the first reason why a person must look at a finding, or null."""
    out = F.lit(None).cast("string")
    for reason, pattern in reversed(S.MANUAL_REVIEW.items()):
        out = F.when(F.coalesce(text, F.lit("")).rlike(pattern), reason).otherwise(out)
    return out
