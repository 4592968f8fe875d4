"""Benchmark decontamination by winnowing.

Both sides are words; of every ``WIDTH`` consecutive 5-gram hashes the smallest
is kept (the rightmost among equals).  A span of 10 words holds 6 such hashes
and selects the same one wherever it stands, so documents and items that share
10 consecutive words share a fingerprint.  Items of fewer than 10 words are one
window of their own length, which is its own fingerprint at every position of a
document.

1. The items' fingerprints and windows are written as narrow tables.
2. One pass over the documents keeps, of each text's fingerprints, those that a
   bitmap of the items' has, each with the up to 6 windows of 10 words around
   it.  The bitmap has 2^26 bits at any number of items: it only thins what the
   joins read, and with very many items it thins less.
3. The fingerprints are joined with the items', those found are extended: their
   windows are joined with the items' windows.  What is found gives the hit
   words (runs of positions) and the items of each text.

Equal texts are extended once, under their digest.  Nothing of the documents or
the items is collected, and no task's memory grows with either.

Defined cases: null and empty texts have no words and no hits; null item ids
hit words but are not counted as items; repeated documents get equal results,
an item id with several rows counts once; empty tables give no hits; columns
of ``docs`` are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkaudit.llm.common import looked_up, new_table_path, text_slices
from sparkaudit.llm.words import alphanumeric, find_words, grams, sliding_min

WINDOW = 10
GRAM = 5
WIDTH = WINDOW - GRAM + 1
#: Bits of the bitmap of fingerprints (8 MB), and of one row of it.
BITS, ROW_BITS = 1 << 26, 1 << 15


def winnow(gram: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Positions of the rightmost smallest hash of every ``width`` consecutive ones."""
    low = sliding_min(gram, width)
    n = len(gram) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.zeros(n, np.int64)
    for i in range(width):
        at = np.where(gram[i:i + n] == low, i, at)
    at += np.arange(n)
    return at[np.append(True, at[1:] != at[:-1])]


def _slots(size: np.ndarray | int, code: np.ndarray) -> np.ndarray:
    """Places of fingerprints in the bitmap."""
    with np.errstate(over="ignore"):
        return ((code + np.uint64(size) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(38)).astype(np.int64) & (BITS - 1)


def item_codes(benchmark: DataFrame) -> DataFrame:
    """(print, size, code, slot, item) of every item's fingerprints and windows, each once."""
    keep = alphanumeric()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_slices(batches, "text"):
            words = find_words(data, offsets, keep)
            bounds = np.searchsorted(words.row, np.arange(rows.num_rows + 1))
            for i, item in enumerate(rows.column(rows.schema.get_field_index("item")).to_pylist()):
                code = words.hash[bounds[i]:bounds[i + 1]]
                size = min(WINDOW, len(code))
                if not size:
                    continue
                window = np.unique(grams(code, size))
                gram = grams(code, GRAM)
                seed = np.unique(gram[winnow(gram)]) if size == WINDOW else window
                both, n = np.concatenate([seed, window]), len(seed) + len(window)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(n) < len(seed)), pa.array(np.full(n, size, np.int32)), pa.array(both.view(np.int64)),
                     pa.array(_slots(size, both)), pa.array([item] * n, pa.string())],
                    ["print", "size", "code", "slot", "item"])

    return benchmark.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(
        run, "print boolean, size int, code long, slot long, item string").distinct()


def bitmap(prints: DataFrame) -> np.ndarray:
    """The bitmap of the fingerprints' slots, gathered in rows of ROW_BITS; its size is fixed."""
    place = F.col("slot") + 1
    rows = prints.groupBy(F.bitmap_bucket_number(place).alias("row")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    out = np.zeros(BITS // 8, np.uint8)
    for r in rows:
        at = (r.row - 1) * ROW_BITS // 8
        out[at:at + ROW_BITS // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def _has(bits: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0


def seeds(code: np.ndarray, row: np.ndarray, size: int, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word position, hash) of the texts' fingerprints of ``size`` that the bitmap has."""
    gram = grams(code, GRAM if size == WINDOW else size)
    at = winnow(gram) if size == WINDOW else np.arange(len(gram))
    at = at[_has(bits, _slots(size, gram[at]))]
    at = at[row[at] == row[at + (GRAM if size == WINDOW else size) - 1]] if len(at) else at
    return at, gram[at]


def windows_around(at: np.ndarray, code: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the fingerprint, word position, hash) of the windows that hold each fingerprint, inside its text."""
    if size < WINDOW:
        return np.arange(len(at)), at, grams(code, size)[at]
    start = (at[:, None] - np.arange(WIDTH)).ravel()
    number = np.repeat(np.arange(len(at)), WIDTH)
    inside = (start >= 0) & (start + size <= len(code))
    start, number = start[inside], number[inside]
    inside = row[start] == row[start + size - 1]
    start, number = start[inside], number[inside]
    return number, start, _fold(code[start[:, None] + np.arange(size)])


def _fold(span: np.ndarray) -> np.ndarray:
    """``grams`` of windows given as rows."""
    return np.array([], np.uint64) if not len(span) else np.concatenate(
        [grams(part.ravel(), span.shape[1])[::span.shape[1]] for part in np.array_split(span, len(span) // 65536 + 1)])


SEEDS = T.ArrayType(T.StructType([
    T.StructField("size", T.IntegerType()), T.StructField("code", T.LongType()),
    T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("windows", T.ArrayType(T.LongType()))]))
ARROW_SEEDS = pa.list_(pa.struct([("size", pa.int32()), ("code", pa.int64()), ("starts", pa.list_(pa.int32())),
                                  ("windows", pa.list_(pa.int64()))]))


def _texts(shared, sizes: list[int]):
    """Arrow function: number of words and seeds of each text; ``starts`` are word positions in the text."""
    keep = alphanumeric()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for rows, data, offsets in text_slices(batches, "llm_text"):
            words = find_words(data, offsets, keep)
            n = len(offsets) - 1
            total = np.bincount(words.row, minlength=n)
            begin = np.concatenate([[0], np.cumsum(total)])
            found: list[list[dict]] = [[] for _ in range(n)]
            for size in sizes:
                at, code = seeds(words.hash, words.row, size, bits)
                if not len(at):
                    continue
                number, start, window = windows_around(at, words.hash, words.row, size)
                bound = np.searchsorted(number, np.arange(len(at) + 1))
                for i, r in enumerate(words.row[at].tolist()):
                    lo, hi = bound[i], bound[i + 1]
                    if lo < hi:
                        found[r].append({"size": size, "code": int(code[i].view(np.int64)),
                                         "starts": (start[lo:hi] - begin[r]).tolist(),
                                         "windows": window[lo:hi].view(np.int64).tolist()})
            yield pa.RecordBatch.from_arrays(
                [*[rows.column(i) for i in range(rows.num_columns - 1)], pa.array(total, pa.int64()),
                 pa.array(found, ARROW_SEEDS)], [*rows.schema.names[:-1], "llm_words", "llm_seeds"])

    return run


def text_key(text: str | Column = "text") -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def found_in(docs: DataFrame, benchmark: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """Two written tables: every row of ``docs`` with ``keep``, llm_key and llm_words, and of each text with a hit
    (llm_key, llm_at: its hit words' positions, ascending, llm_items: ids of its items, sorted)."""
    spark = docs.sparkSession
    codes = _written(item_codes(benchmark), "benchmark-codes")
    prints = _written(codes.where("print").select("size", "code", "slot").distinct(), "benchmark-prints")
    owners = codes.where("not print").select("size", "code", "item")
    windows = _written(owners.select("size", "code").distinct(), "benchmark-windows")
    sizes = sorted(r.size for r in prints.select("size").distinct().collect())  # at most WINDOW of them
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("llm_key", T.BinaryType()),
                           T.StructField("llm_words", T.LongType()), T.StructField("llm_seeds", SEEDS)])
    texts = _written(
        docs.select(*keep, text_key().alias("llm_key"), F.col("text").alias("llm_text")).mapInArrow(
            _texts(spark.sparkContext.broadcast(bitmap(prints)), sizes), schema), "document-seeds")
    on, salt = ["size", "code"], F.xxhash64("llm_key")
    once = texts.where(F.size("llm_seeds") > 0).groupBy("llm_key").agg(F.first("llm_seeds").alias("s"))
    seed = once.select("llm_key", F.explode("s").alias("s")).select("llm_key", "s.*")
    near = (looked_up(seed, prints.select(*on), on, salt, "left_semi")
            .select("llm_key", "size", F.explode(F.arrays_zip("starts", "windows")).alias("w"))
            .select("llm_key", "size", F.col("w.starts").alias("start"), F.col("w.windows").alias("code")).distinct())
    hit = _written(looked_up(near, windows, on, salt, "left_semi"), "document-hits")
    at = F.array_sort(F.collect_set("at")).alias("llm_at")
    spans = (hit.select("llm_key", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("at"))
             .groupBy("llm_key").agg(at))
    items = (looked_up(hit.select("llm_key", *on).distinct(), owners.where("item is not null"), on, salt)
             .groupBy("llm_key").agg(F.array_sort(F.collect_set("item")).alias("llm_items")))
    none = F.array().cast("array<string>")
    found = spans.join(items, "llm_key", "left").withColumn("llm_items", F.coalesce("llm_items", none))
    return texts.drop("llm_seeds"), _written(found, "document-items")


def _runs(at: str) -> Column:
    """First and end of each run of ascending positions, in turn."""
    each = F.expr(f"""flatten(zip_with(
        filter({at}, (x, i) -> i = 0 or get({at}, i - 1) < x - 1),
        filter({at}, (x, i) -> i = size({at}) - 1 or get({at}, i + 1) > x + 1),
        (a, b) -> array(cast(a as bigint), cast(b + 1 as bigint))))""")
    return F.coalesce(each, F.array().cast("array<bigint>"))


def mark(docs: DataFrame, benchmark: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with llm_words (number of words), llm_hits (first and end word of each run of
    hit words, in turn) and llm_items (ids of the items found, sorted)."""
    every, found = found_in(docs, benchmark, keep)
    return every.join(found, "llm_key", "left").select(
        *keep, "llm_words", _runs("llm_at").alias("llm_hits"),
        F.coalesce("llm_items", F.array().cast("array<string>")).alias("llm_items"))


def score_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Digest per document."""
    every, found = found_in(docs.select("doc_id", "text"), benchmark, ["doc_id"])
    digest = found.select("llm_key", F.size("llm_at").cast("long").alias("hits"), F.size("llm_items").cast("long").alias("items"),
                          F.sha2(F.array_join("llm_items", ","), 256).alias("digest"))
    zero = F.lit(0).cast("long")
    return looked_up(every, digest, ["llm_key"], F.xxhash64("doc_id"), "left").select(
        "doc_id", F.col("llm_words").alias("n_words"), F.coalesce("hits", zero).alias("n_hit"),
        F.coalesce("items", zero).alias("n_items"),
        F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.coalesce(F.col("hits") > 0, F.lit(False)).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a hit, all columns kept."""
    gone = found_in(docs, benchmark, [])[1].select("llm_key")
    return looked_up(docs.withColumn("llm_key", text_key()), gone, ["llm_key"], F.xxhash64("doc_id"), "left_anti").select(
        *docs.columns)
