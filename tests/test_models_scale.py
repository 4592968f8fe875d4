"""Model fields of large tables that lie in few files."""
from pyspark.sql import functions as F

from sparkaudit.operators import models as M


def test_models_are_dealt_before_fields_are_gathered(spark):
    decls = spark.range(0, 900, 1, 1).select(
        F.concat(F.lit("M"), (F.col("id") % 100).cast("string")).alias("model_name"), F.concat(F.lit("/m"), (F.col("id") % 100).cast("string")).alias("file"),
        F.col("id").cast("int").alias("pos"), F.concat(F.lit("private String f"), (F.col("id") % 300).cast("string")).alias("raw"))
    out = M.tag_model_fields(decls)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert plan.rindex("Aggregate") < plan.index("Exchange")  # nothing is gathered in the one task that reads
    got = {r.model_name: r.fields for r in out.collect()}
    assert len(got) == 100 and got["M7"] == ["f7", "f107", "f207"]
