"""Lookups "pattern contained in text", which have no equi-join key.

There is one plan at every size.  A pattern of four characters or more is keyed
by the one of its 4-grams that the fewest patterns have (so patterns under one
folder don't share the folder's key), a text by all its distinct 4-grams; the two
sides meet in an equi-join and the predicate is verified.  Shorter patterns are few distinct
strings, whatever the number of rows: a text lists those that it contains and
meets them by equality.  Callers reduce texts to distinct values first, and only
candidate pairs are ever produced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkaudit.session import checkpointed, written

NGRAM = 4


def _grams(text: Column, n: int) -> Column:
    """Distinct substrings of ``n`` characters, in one pass (``substring`` counts from the text's start each time)."""
    return F.when(F.length(text) >= n, F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), 1)))


def rarest_grams(patterns: DataFrame, pat_col: str, ngram: int = NGRAM) -> DataFrame:
    """(pattern, _key): each distinct pattern's gram that the fewest patterns have, ties by the gram."""
    grams = patterns.select(pat_col).distinct().withColumn("_key", F.explode(_grams(F.col(pat_col), ngram)))
    shared = grams.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    return grams.join(shared, "_key").groupBy(pat_col).agg(F.min_by("_key", F.struct("_n", "_key")).alias("_key"))


#: Distinct keys of patterns that may be broadcast to thin the texts' grams.
BROADCAST_KEYS = 2_000_000


def contains_many(left: DataFrame, right: DataFrame, text_col: str, pat_col: str, ngram: int = NGRAM) -> DataFrame:
    """``contains_join`` for many long texts and many patterns.

    Patterns of two grams' length are keyed by grams of that length, which few patterns share; the
    patterns' distinct keys, a counted number, thin the texts' grams where they are listed.  A gram stands with its
    text's number, the text itself is joined to candidates only.
    """
    size = F.length(F.col(pat_col))
    out = contains_join(left, right.where(size < ngram), text_col, pat_col, ngram)
    texts = written(left.where(F.col(text_col).isNotNull()).withColumn("_id", F.monotonically_increasing_id()))
    for n, some in ((ngram, right.where((size >= ngram) & (size < 2 * ngram))), (2 * ngram, right.where(size >= 2 * ngram))):
        rarest = checkpointed(rarest_grams(some, pat_col, n))
        keys = checkpointed(rarest.select("_key").distinct())
        grams = texts.select("_id", F.explode(_grams(F.col(text_col), n)).alias("_key"))
        if keys.count() <= BROADCAST_KEYS:
            grams = grams.join(F.broadcast(keys), "_key", "left_semi")
        met = grams.join(some.join(rarest, pat_col), "_key").drop("_key").join(texts, "_id").where(
            F.col(text_col).contains(F.col(pat_col)))
        out = out.unionByName(met.select(*out.columns))
    return out


def contains_join(left: DataFrame, right: DataFrame, text_col: str, pat_col: str, ngram: int = NGRAM) -> DataFrame:
    """Rows of ``left`` with each row of ``right`` whose pattern the text contains (exact, inner).

    A pattern has one key and a text lists a key once, so a pair of rows meets
    exactly once: equal rows keep their multiplicity.  Null texts and patterns
    match nothing; an empty pattern is in every text.
    """
    texts, size = left.where(F.col(text_col).isNotNull()), F.length(F.col(pat_col))
    long = right.where(size >= ngram)
    long = long.join(rarest_grams(long, pat_col, ngram), pat_col)
    by_gram = (texts.withColumn("_key", F.explode(_grams(F.col(text_col), ngram))).join(long, "_key")
               .where(F.col(text_col).contains(F.col(pat_col))))
    short = right.where(size < ngram).withColumn("_key", F.col(pat_col))
    few = short.select(F.collect_set("_key")).scalar()  # distinct strings of under ``ngram`` characters
    in_text = F.filter(F.col("_few"), lambda p: F.col(text_col).contains(p))
    by_name = texts.withColumn("_few", few).withColumn("_key", F.explode(in_text)).drop("_few").join(short, "_key")
    return by_gram.unionByName(by_name).drop("_key")


def first_hits(texts: DataFrame, dim: DataFrame, pat_col: str, n: int) -> DataFrame:
    """(text, ords): per distinct text the first ``n`` (by ``ord``) rows of ``dim`` whose pattern it contains.

    A pattern's own first ``n`` rows are enough for that, so nothing longer is gathered.
    """
    by_pattern = Window.partitionBy("_pat").orderBy("ord")
    few = (dim.select(F.col(pat_col).alias("_pat"), "ord").where("_pat <> ''")
           .withColumn("_rn", F.row_number().over(by_pattern)).where(F.col("_rn") <= n).drop("_rn"))
    by_text = Window.partitionBy("text").orderBy("ord")
    return (contains_join(texts.select("text").distinct(), few, "text", "_pat")
            .withColumn("_rn", F.row_number().over(by_text)).where(F.col("_rn") <= n)
            .groupBy("text").agg(F.collect_list("ord").alias("ords")))
