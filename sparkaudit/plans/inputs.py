"""Load the driver's tables and derive the typed inputs of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkaudit.plans.views import BASE_TABLES, VIEWS, VIEW_DEPS


def register_tables(spark: SparkSession, sf_dir: str, names=None) -> None:
    """Register base parquet tables as temp views (lazy; nothing is read)."""
    for t in names or BASE_TABLES:
        spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet").createOrReplaceTempView(t)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A shared-SQL view over freshly registered base tables."""
    deps = VIEW_DEPS.get(name, ())
    register_tables(spark, sf_dir, [d for d in deps if d not in VIEWS])
    for d in deps:
        if d in VIEWS:  # views built on views
            spark.sql(VIEWS[d]).createOrReplaceTempView(d)
    df = spark.sql(VIEWS[name])
    df.createOrReplaceTempView(name)
    return df


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the view ``v_edges``: keys are made distinct as numbers, once, and spelled afterwards.

    As texts, the view's rows are shuffled twice, by each DISTINCT and by the UNION.  Letters tell the four kinds of
    edges apart; only rows without both keys are alike in all of them.
    """
    ends = (("lineitem", "l_orderkey", "l_partkey"), ("lineitem", "l_partkey", "l_suppkey"),
            ("supplier", "s_suppkey", "s_nationkey"), ("nation", "n_nationkey", "n_regionkey"))
    letters = [F.lit(c) for c in "opsnr"]
    keys = None
    for k, (table, a, b) in enumerate(ends):
        some = spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet").select(
            F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b")).withColumn(
            "k", F.when(F.col("a").isNull() & F.col("b").isNull(), 0).otherwise(k))
        keys = some if keys is None else keys.unionByName(some)
    return keys.distinct().select(
        *[F.concat(F.element_at(F.array(*letters), F.col("k") + at), F.col(key).cast("string")).alias(name)
          for at, key, name in ((1, "a", "src"), (2, "b", "dst"))], F.lit("CALLS").alias("kind"))


def _split(c: str, sep: str) -> F.Column:
    col = F.col(c)
    return F.when(col.isNull() | (col == ""), F.array().cast("array<string>")).otherwise(
        F.split(col, sep))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed candidate paths (nested source/sink structs, array fields)."""
    v = view(spark, sf_dir, "v_paths")
    return v.select(
        "run_id", "ord", "id", "entry_fn", "entry_file", "file",
        F.struct(F.col("src_type").alias("type"), F.col("src_code").alias("code"),
                 F.lit(None).cast("string").alias("name"), F.col("src_file").alias("file")
                 ).alias("source"),
        F.struct(F.col("sink_name").alias("name"), F.col("sink_type").alias("type"),
                 F.lit(None).cast("string").alias("code"), F.col("sink_file").alias("file")
                 ).alias("sink"),
        "sink_cat", "tool",
        _split("detected_by", ",").alias("detected_by"),
        "query_type",
        _split("call_chain", r"\|").alias("call_chain"),
        _split("flow_nodes", r"\|").alias("flow_nodes"),
        "path_decision", "score", "triage_score", "has_flow",
    )
