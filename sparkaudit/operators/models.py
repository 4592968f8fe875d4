"""Data-model fields and function definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkaudit import catalogs as K

LINE_SPLIT = r"\r\n|\n|\r"


def clean_field_name(raw: Column) -> Column:
    """Cut at '{', cut at ':', drop leading '$', last identifier that is
    not a modifier/type word, else the last identifier."""
    r = F.regexp_replace(raw, r"^\s+|\s+$", "")
    r = F.regexp_replace(F.substring_index(r, "{", 1), r"^\s+|\s+$", "")
    r = F.regexp_replace(F.substring_index(r, ":", 1), r"^\s+|\s+$", "")
    r = F.regexp_replace(r, r"^\$+", "")
    toks = F.regexp_extract_all(r, F.lit(K.FIELD_IDENT_RE), 0)
    keep = F.filter(toks, lambda t: ~F.lower(t).isin(*K.FIELD_MODIFIERS))
    return F.coalesce(F.try_element_at(keep, F.lit(-1)), F.try_element_at(toks, F.lit(-1)))


def tag_model_fields(decls: DataFrame) -> DataFrame:
    """decls(model_name, file, pos, raw) -> per model distinct cleaned
    fields (declaration order), sensitive fields, mass-assignment risks.

    Declarations are dealt by model first: a small file is one task, whose table of
    distinct fields would hold all models.
    """
    c = decls.select("model_name", "file", "pos", "raw").repartition("model_name", "file").select("model_name", "file", "pos", clean_field_name(F.col("raw")).alias("f")).where(
        F.col("f").isNotNull())
    first = c.groupBy("model_name", "file", "f").agg(F.min("pos").alias("pos"))
    g = first.groupBy("model_name", "file").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "f"))), lambda s: s["f"]).alias("fields"))
    return (g.withColumn("sensitive_fields", F.filter("fields", lambda f: f.rlike(K.SENSITIVE_FIELD_RE)))
            .withColumn("mass_assign_risk", F.filter("fields", lambda f: f.rlike(K.MASS_ASSIGN_RE))))


def function_defs(files: DataFrame, path_col: str = "path", text_col: str = "content") -> DataFrame:
    """(file, name, line) from the keyword and typed definition regexes,
    evaluated per line (CR/LF line breaks, Q20); 15 keywords dropped."""
    lines = files.select(F.col(path_col).alias("file"),
                         F.posexplode(F.split(F.col(text_col), LINE_SPLIT)).alias("pos", "l"))
    kw = F.regexp_extract("l", K.FUNC_DEF_KEYWORD_RE, 1)
    ty = F.regexp_extract("l", K.FUNC_DEF_TYPED_RE, 1)
    names = F.array_compact(F.array(F.when(kw != "", kw), F.when(ty != "", ty)))
    out = lines.select("file", (F.col("pos") + 1).cast("int").alias("line"), F.explode(names).alias("name"))
    return out.where(~F.lower("name").isin(*K.FUNC_SKIP_KEYWORDS))
