"""Tables and texts for the tests."""

from pyspark.sql import types as T

# extra columns bear names that the operators use inside
DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    *[T.StructField(c, T.StringType()) for c in ("spans", "copy", "size", "core", "n", "kept", "target", "label_id", "id")]])


def table_of(spark, rows):
    """rows: (doc_id, text, source)."""
    return spark.createDataFrame(
        [(i, t, None, s, None if t is None else len(t), *["x"] * 9) for i, t, s in rows], DOCS)


def prose(rng, n, vocabulary=None):
    vocabulary = vocabulary or [f"{a}{b}{c}" for a in "bdfkl" for b in "aeiou" for c in "mnrst"]
    out = []
    for i in range(n):
        w = rng.choice(vocabulary)
        out.append((w.capitalize() if i % 11 == 0 else w) + ("." if i % 11 == 10 else ""))
    return " ".join(out)
