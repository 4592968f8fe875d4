"""Registered queries: secrets and weak-crypto scans over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkaudit import catalogs as K
from sparkaudit.operators import secrets as S
from sparkaudit.plans import inputs as I
from sparkaudit.plans.registry import register
from sparkaudit.plans.sqlfrag import contains_any, map_case, q

DOC_FILE = "'doc/' || source || '/' || CAST(doc_id AS STRING)"
_ALLP = "|".join([f"(?:{K.SECRET_ASSIGN_RE})"] + [f"(?:{p})" for _, p, _ in K.SECRET_FORMATS])
_SPLIT = r"'\r\n|\n|\r'"


def _assign_type_sql(name: str) -> str:
    n = f"lower({name})"
    return (f"CASE WHEN contains({n}, 'private_key') THEN 'private_key' "
            f"WHEN contains({n}, 'access_key') THEN 'access_key' "
            f"WHEN contains({n}, 'api_key') OR contains({n}, 'apikey') THEN 'api_key' "
            f"WHEN contains({n}, 'password') OR contains({n}, 'passwd') THEN 'password' "
            f"WHEN contains({n}, 'secret') THEN 'secret' ELSE 'token' END")


def _mask(v: str) -> str:
    return f"substring({v}, 1, 4) || repeat('*', CAST(greatest(length({v}) - 4, 0) AS INTEGER))"


_fmt_union = "\n".join(
    f"  UNION ALL SELECT file, line_no, {q(t)} AS type, unnest(regexp_extract_all(line, {q(p)}, 0)) AS value, "
    f"{q(c)} AS confidence FROM l2" for t, p, c in K.SECRET_FORMATS)

SECRETS_SQL = f"""
WITH d AS (SELECT {DOC_FILE} AS file, text FROM documents),
d2 AS (SELECT * FROM d WHERE NOT {contains_any('file', K.SECRET_SKIP_DIRS)} AND regexp_matches(text, {q(_ALLP)})),
l AS (SELECT file, unnest(regexp_split_to_array(text, {_SPLIT})) AS line,
             generate_subscripts(regexp_split_to_array(text, {_SPLIT}), 1) AS line_no FROM d2),
l2 AS (SELECT * FROM l WHERE regexp_matches(line, {q(_ALLP)})),
a AS (SELECT file, line_no, unnest(CASE WHEN regexp_matches(line, {q(K.SECRET_SAFE_RE)}) THEN []::VARCHAR[]
                                    ELSE regexp_extract_all(line, {q(K.SECRET_ASSIGN_RE)}, 0) END) AS m FROM l2),
hits AS (
  SELECT file, line_no, {_assign_type_sql(f"regexp_extract(m, {q(K.SECRET_ASSIGN_RE)}, 1)")} AS type,
         regexp_extract(m, {q(K.SECRET_ASSIGN_RE)}, 2) AS value, 'MEDIUM' AS confidence FROM a
{_fmt_union})
SELECT file, CAST(line_no AS INTEGER) AS line, type, {_mask('value')} AS value_masked, confidence,
       {map_case('type', K.SECRET_SEVERITY, "'MEDIUM'")} AS severity
FROM hits
"""


def _docs(spark, sf):
    I.register_tables(spark, sf, ["documents"])
    return spark.table("documents").select(
        F.concat(F.lit("doc/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("file"),
        "text")


@register("secrets_scan", (), SECRETS_SQL)
def q_secrets_scan(spark, sf):
    """X43 + C8: hard-coded secrets in whole document texts, masked."""
    return S.secrets_scan(_docs(spark, sf))


@register("secret_types", (), f"""
SELECT type, severity, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT file) AS BIGINT) AS files
FROM ({SECRETS_SQL}) x GROUP BY type, severity
""")
def q_secret_types(spark, sf):
    """Secret counts per type (the scan's result summary, types not values)."""
    s = S.secrets_scan(_docs(spark, sf))
    return s.groupBy("type", "severity").agg(F.count(F.lit(1)).alias("n"),
                                              F.countDistinct("file").alias("files"))
