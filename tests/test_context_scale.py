"""Context documents that come out of an aggregation."""
from pyspark.sql import functions as F

from sparkaudit.operators import context as X


def test_lists_do_not_read_the_documents_together(spark):
    """Lists that lie by document would be read by one task a partition, all of them together: documents are read once."""
    text = F.when(F.col("id") % 2 == 0, "## Custom Sinks\n### A::b\n- Risk: x\n### C::d\n## Business Notes\nn").otherwise(
        '{"custom_sources": [{"class": "R", "name": "take"}, {"name": "poll"}], "api_names": ["Get"]}')
    docs = spark.range(40).select((F.col("id") % 20).alias("doc_id"), text.alias("text")).groupBy("doc_id").agg(F.max("text").alias("text"))
    for out in (X.context_summary(docs), X.normalize_context(docs)):
        assert "max(text" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.doc_id: (r.custom_sinks, r.custom_sources, r.non_http_sources, r.api_names, r.has_notes) for r in X.context_summary(docs).collect()}
    assert len(got) == 20 and got[4] == (2, 0, 0, 0, True) and got[5] == (0, 2, 2, 1, False)
