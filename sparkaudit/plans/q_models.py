"""Registered queries: model fields and function definitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkaudit import catalogs as K
from sparkaudit.operators import models as M
from sparkaudit.plans import inputs as I
from sparkaudit.plans.registry import register
from sparkaudit.plans.sqlfrag import q

_S = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_MODS = "(" + ", ".join(q(m) for m in K.FIELD_MODIFIERS) + ")"
CLEAN_SQL = f"""
, c0 AS (SELECT *, {_S.format(_S.format(_S.format('raw') + ".split('{')[1]") + ".split(':')[1]")} AS r0 FROM v_model_fields),
c1 AS (SELECT *, regexp_extract_all(regexp_replace(r0, '^[$]+', ''), {q(K.FIELD_IDENT_RE)}) AS toks FROM c0),
c2 AS (SELECT model_name, file, pos, raw,
         coalesce(list_filter(toks, lambda t: lower(t) NOT IN {_MODS})[-1], toks[-1]) AS f FROM c1)
"""


@register("clean_field_name", ("v_model_fields",), CLEAN_SQL + "SELECT model_name, pos, raw, f AS field FROM c2")
def q_clean_field_name(spark, sf):
    """X27 over raw declarations."""
    v = I.view(spark, sf, "v_model_fields")
    return v.select("model_name", "pos", "raw", M.clean_field_name(F.col("raw")).alias("field"))


@register("tag_model_fields", ("v_model_fields",), CLEAN_SQL + f"""
, g AS (SELECT model_name, file, list_distinct(list(f ORDER BY pos)) AS fields FROM c2 WHERE f IS NOT NULL
        GROUP BY model_name, file)
SELECT model_name, file, array_to_string(list_sort(fields), ',') AS fields,
  array_to_string(list_sort(list_filter(fields, lambda x: regexp_matches(x, {q(K.SENSITIVE_FIELD_RE)}))), ',') AS sensitive_fields,
  array_to_string(list_sort(list_filter(fields, lambda x: regexp_matches(x, {q(K.MASS_ASSIGN_RE)}))), ',') AS mass_assign_risk
FROM g
""")
def q_tag_model_fields(spark, sf):
    """X28 per model."""
    t = M.tag_model_fields(I.view(spark, sf, "v_model_fields"))
    j = lambda c: F.array_join(F.array_sort(c), ",")
    return t.select("model_name", "file", j("fields").alias("fields"), j("sensitive_fields").alias("sensitive_fields"),
                    j("mass_assign_risk").alias("mass_assign_risk"))


@register("function_defs", ("v_src_files",), f"""
, l AS (SELECT path AS file, unnest(regexp_split_to_array(content, '\\r\\n|\\n|\\r')) AS l,
               generate_subscripts(regexp_split_to_array(content, '\\r\\n|\\n|\\r'), 1) AS line FROM v_src_files),
n AS (SELECT file, line, regexp_extract(l, {q(K.FUNC_DEF_KEYWORD_RE)}, 1) AS name FROM l
      UNION ALL SELECT file, line, regexp_extract(l, {q(K.FUNC_DEF_TYPED_RE)}, 1) FROM l)
SELECT file, CAST(line AS INTEGER) AS line, name FROM n
WHERE name <> '' AND lower(name) NOT IN ({', '.join(q(k) for k in K.FUNC_SKIP_KEYWORDS)})
""")
def q_function_defs(spark, sf):
    """X23 over the source corpus."""
    return M.function_defs(I.view(spark, sf, "v_src_files"))


@register("file_inventory", ("v_src_files",), """
SELECT repo, path, CAST(n AS INTEGER) AS n FROM (
  SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY path) AS n FROM v_src_files
  WHERE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) IN ('.py', '.java', '.js', '.ts', '.go', '.php', '.rb', '.cs')
    AND NOT list_has_any(string_split(path, '/'), ['.git', 'node_modules', '__pycache__', 'vendor', 'dist', 'build', '.tox', 'venv'])) t
""")
def q_file_inventory(spark, sf):
    """X42 per-repo file tree (sorted, with ordinals)."""
    from sparkaudit.sources.corpus import file_inventory
    return file_inventory(I.view(spark, sf, "v_src_files")).select("repo", "path", F.col("n").cast("int"))
