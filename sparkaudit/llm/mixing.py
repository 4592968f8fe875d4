"""Mixing sources to target weights, with DataFrame functions only.

Sizes are words per document.  Per source the words are summed, a target is
found by weighted filling under a ceiling, and the repetition rate is target /
size.  A document is taken floor(rate) times, plus one copy drawn with the
fraction as its probability; the draw is a hash of the document and a seed, so
reruns agree.

Defined cases: a null text has size 0; the null source is a source of its own;
repeated rows get equal draws; a table without words gives targets of 0; an
empty table gives an empty result; further columns are kept by ``mix`` and not
read otherwise.  Names that begin with ``llm_`` are the package's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkaudit.llm.common import checkpointed

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5      # the mix's words, as a share of all words
CEILING = 2.0    # the most words taken from a source, as a share of its own
SEED = 20
#: Sources up to this number are broadcast (each is one narrow row); more are joined by salted keys.
BROADCAST_SOURCES = 20_000
SALTS = 32


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(*columns: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) from the values: the first 13 hexadecimal digits of their SHA-256."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    digest = F.sha2(F.concat(F.lit(f"{seed}"), *[x for p in parts for x in (F.lit(":"), p)]), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(16 ** 13))


def source_rates(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
                 ceiling: float = CEILING) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Sources weigh ``weights`` in turn, by code point, null last.  Sources whose
    ceiling / weight lies lowest fill up first: sorted by it, the first prefix
    whose rest fits at the common level gives the answer of repeated resharing.
    The windows run over one row per source.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    cap = F.lit(ceiling) * F.col("source_size")
    by_cap = Window.orderBy("fill", F.col("source").asc_nulls_last())
    whole = Window.partitionBy(F.lit(0))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = ((F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
             / F.sum("weight").over(after))
    return (totals.withColumn("weight", weight).withColumn("cap", cap).withColumn("fill", F.col("cap") / F.col("weight"))
            .withColumn("level", level)
            # filling stops at the first level that its own source can take; levels only fall after it
            .withColumn("stop", F.min(F.when(F.col("level") <= F.col("fill"), F.col("fill"))).over(whole))
            .withColumn("at", F.max(F.when(F.col("level") <= F.col("fill"), F.col("level"))).over(whole))
            .select("source", "source_size", F.when(
                (F.col("fill") < F.col("stop")) | F.col("stop").isNull(), F.col("cap")).otherwise(
                F.least(F.col("cap"), F.col("at") * F.col("weight"))).alias("target")))


def with_rates(docs: DataFrame, rates: DataFrame) -> DataFrame:
    """``docs`` with ``llm_size`` and ``llm_target`` of its source.  A hot source never meets in one task:
    few sources are broadcast after their number is known, many are joined by (source, salt)."""
    rates = rates.select(F.col("source").alias("llm_source"), F.col("source_size").alias("llm_size"),
                         F.col("target").alias("llm_target"))
    same = F.col("source").eqNullSafe(F.col("llm_source"))
    if rates.count() <= BROADCAST_SOURCES:
        return docs.join(F.broadcast(rates), same).drop("llm_source")
    salted = rates.withColumn("llm_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")
    return (docs.withColumn("llm_own_salt", salt).join(salted, same & (F.col("llm_own_salt") == F.col("llm_salt")))
            .drop("llm_source", "llm_salt", "llm_own_salt"))


def copies(u: Column) -> Column:
    """Times a document is taken: floor(rate) and one more where ``u`` lies below the fraction."""
    rate = F.when(F.col("llm_size") > 0, F.col("llm_target") / F.col("llm_size")).otherwise(F.lit(0.0))
    return (F.floor(rate) + F.when(u < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def plan_documents(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken): texts are read once, what follows is narrow."""
    sized = checkpointed(docs.select(
        "doc_id", "source", n_words(F.col("text")).alias("size"), draw(F.col("doc_id"), F.col("text")).alias("u")))
    rates = checkpointed(source_rates(sized, **options))
    return with_rates(sized, rates).select(
        "doc_id", "size", F.col("llm_size").alias("source_size"), F.col("llm_target").cast("double").alias("target"),
        (copies(F.col("u")) * F.col("size")).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: each row as often as it is taken, all columns kept, plus ``copy`` (0, 1, ...),
    which replaces a column of that name."""
    columns = [c for c in docs.columns if c != "copy"]
    rates = checkpointed(source_rates(docs.select("source", n_words(F.col("text")).alias("size")), **options))
    times = copies(draw(F.col("doc_id"), F.col("text")))
    return (with_rates(docs.select(*columns), rates).withColumn("llm_times", times).where(F.col("llm_times") > 0)
            .select(*columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("llm_times") - 1)).alias("copy")))
