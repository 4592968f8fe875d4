"""Repeated passages by a depth-limited radix sort of suffixes.

Every position with ``DEPTH`` bytes before the end of its text starts a suffix,
looked at only to that depth.  The sort goes by digits, the most significant
first, and a digit is a digest of bytes, so equal digits are equal bytes; what
stands alone after a pass is repeated nowhere and leaves.

A pass over all positions would move them all.  Its first digit is therefore
the smallest digest of 100 bytes anywhere in the suffix's 400: equal suffixes
have it in common, and neighbouring positions share it, so a run of them is one
row.  A row carries a *core* (bytes common to all of its suffixes) and a *hull*
(all bytes that they cover):

- no other row has the core: nothing in the row is repeated, it leaves;
- another row has the hull: everything in the row is repeated, it is settled;
- otherwise one row for each hull goes on to the next digit, cut finer.

Pass 1 takes runs, pass 2 cuts them into buckets of 16 positions at fixed
distances from the place of the smallest digest (a function of the bytes alone,
so equal suffixes fall into like buckets), pass 3 takes single positions, where
the digit is the whole suffix and equal groups are exactly the repeated
strings.  Repeats inside a text are also found where it is read.

Groups are only counted and joined, never gathered: a passage that very many
documents share is a skewed key of a join that Spark splits.  Lists are
gathered per document, at most as long as its text.  Texts without company in
the first pass are not moved.

Defined cases: texts under 400 bytes, null and empty ones keep everything;
repeated rows count as each other's repeats; an empty table gives an empty
result; further columns are kept by ``remove_repeats`` and not read.  ``doc_id``
identifies a text; a row without one goes by its text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkaudit.llm.common import checkpointed, new_table_path, string_buffers, text_slices
from sparkaudit.llm.words import BYTE_CODE, mix, powers, sliding_min

DEPTH = 400
GRAM = DEPTH // 4
BUCKET = 16
#: Suffixes of a text that are held at once.
CHUNK = 1 << 19
#: Ids up to this number (8 bytes each) are broadcast to pick out texts; more are joined by key.
BROADCAST_IDS = 2_000_000

ROWS = "doc_id long, start long, n long, core long, hull long"


class Digests:
    """Digests of any substring of some bytes, from prefix sums."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_CODE[data] * up[:-1], out=self.total[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start])

    def all(self, size: int) -> np.ndarray:
        """Of every substring of ``size`` bytes."""
        return mix((self.total[size:] - self.total[:-size]) * self.down[:len(self.total) - size])


def first_digits(data: np.ndarray) -> tuple[list[np.ndarray], list[tuple[int, int]]]:
    """Of one text: rows (start, n, core, hull) of runs, and (start, n) of suffixes repeated inside a chunk."""
    rows, inside = [], []
    for base in range(0, len(data) - DEPTH + 1, CHUNK):
        part = data[base:base + CHUNK + DEPTH - 1]
        digest = Digests(part)
        low = sliding_min(digest.all(GRAM), DEPTH - GRAM + 1)
        start = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
        end = np.append(start[1:], len(low))
        rows.append(np.stack([start + base, end - start, low[start].view(np.int64),
                              digest(start, end + DEPTH - 1).view(np.int64)]))
        whole = digest.all(DEPTH)
        order = np.sort(whole)
        again = order[1:][order[1:] == order[:-1]]
        if len(again):
            inside += [(a + base, b - a) for a, b in _runs(np.isin(whole, again))]
    return rows, inside


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def run_rows(docs: DataFrame) -> DataFrame:
    """One pass over the texts, three kinds of rows: runs of pass 1; with a null core, suffixes that are
    settled already; with a digest, the text itself (``n`` bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_slices(batches, "text"):
            count = rows.num_rows
            out, owner, settled, whole = [np.zeros((4, 0), np.int64)], [], [], []
            for i in range(count):
                text = data[offsets[i]:offsets[i + 1]]
                found, inside = first_digits(text)
                out += found
                owner += [np.full(x.shape[1], i) for x in found]
                settled += [(i, a, n) for a, n in inside]
                whole.append(hashlib.sha256(text.tobytes()).hexdigest())
            start, n, core, hull = np.concatenate(out, axis=1)
            runs, rest = len(start), len(settled) + count
            at = np.concatenate([*owner, [s[0] for s in settled], np.arange(count)]).astype(np.int64)

            def column(values, extra):
                return pa.array(np.concatenate([values, extra, np.diff(offsets) if values is n else np.zeros(count)])
                                .astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(pa.array(at)),
                 column(start, [s[1] for s in settled]), column(n, [s[2] for s in settled]),
                 pa.concat_arrays([pa.array(core), pa.nulls(rest, pa.int64())]),
                 pa.concat_arrays([pa.array(hull), pa.nulls(rest, pa.int64())]),
                 pa.concat_arrays([pa.nulls(runs + len(settled), pa.string()), pa.array(whole, pa.string())]),
                 rows.column(2).take(pa.array(at))],
                ["doc_id", "start", "n", "core", "hull", "sha256", "given_id"])

    return docs.select("doc_id", "text", "given_id").mapInArrow(run, ROWS + ", sha256 string, given_id long")


def settle(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One pass: (doc_id, start, n) settled as repeated, those that go on, and all rows that had company.

    Counts are written before they are joined, so both sides of a join are plain exchanges and Spark can
    split a core that very many rows have.
    """
    shared = checkpointed(rows.groupBy("core").agg(
        F.count(F.lit(1)).alias("rows"), F.min("hull").alias("a"), F.max("hull").alias("b")).where("rows > 1")
        .select("core", (F.col("a") != F.col("b")).alias("mixed")))
    left = checkpointed(rows.join(shared, "core"))
    hulls = checkpointed(left.groupBy("core", "hull").agg(
        F.count(F.lit(1)).alias("rows"), F.first("mixed").alias("mixed"),
        F.min(F.struct("doc_id", "start", "n")).alias("one")))
    whole = left.join(hulls.where("rows > 1").select("core", "hull"), ["core", "hull"]).select("doc_id", "start", "n")
    return whole, hulls.where("mixed").select("one.*"), left


def with_lists(texts: DataFrame, lists: DataFrame) -> DataFrame:
    """``texts`` that have rows (start, n) in ``lists`` for their doc_id, with these as ``spans``."""
    spans = lists.groupBy(F.col("doc_id").alias("list_id")).agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    return texts.join(spans, F.col("doc_id") == F.col("list_id")).drop("list_id")


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, given_id): ``doc_id`` is never null here."""
    return docs.select(F.coalesce("doc_id", F.xxhash64("text")).alias("doc_id"), "text",
                       F.col("doc_id").alias("given_id"))


def _each_span(batches: Iterator[pa.RecordBatch]):
    """(document, bytes, starts, sizes) of a batch from ``with_lists``, one at a time."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("text"))
        offsets, data = string_buffers(column.fill_null("") if column.null_count else column)
        spans = batch.column(batch.schema.get_field_index("spans"))
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        starts, sizes = (x.to_numpy() for x in spans.flatten().flatten())
        at = spans.offsets.to_numpy() - spans.offsets[0].as_py()
        for i, doc in enumerate(ids.to_pylist()):
            mine = slice(at[i], at[i + 1])
            text, a, n = data[offsets[i]:offsets[i + 1]], starts[mine], sizes[mine]
            fits = a + n - 1 + DEPTH <= len(text)  # all do where an id has one text
            yield doc, text, a[fits], n[fits]


def cut_rows(texts: DataFrame, width: int) -> DataFrame:
    """Rows of the next pass: the listed suffixes in buckets of ``width`` positions.

    A bucket's place is counted from the first smallest digest in the suffix.  Its core is what all of
    its ``width`` suffixes share; only a bucket that is there in whole has a hull to compare,
    any other gets one that nothing equals.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], [], [], []]
        for doc, data, starts, sizes in _each_span(batches):
            for start, n in zip(starts.tolist(), sizes.tolist(), strict=True):
                found = buckets(data[start:start + n + DEPTH - 1], width)
                out[0] += [doc] * len(found[0])
                out[1].append(found[0] + start)
                for k in (1, 2, 3):
                    out[k + 1].append(found[k])
            if len(out[0]) > 50_000:
                yield _batch(out)
                out = [[], [], [], [], []]
        if out[0]:
            yield _batch(out)

    return texts.mapInArrow(run, ROWS + ", whole boolean").withColumn(
        "hull", F.when(F.col("whole"), F.col("hull")).otherwise(F.xxhash64("doc_id", "start", "hull"))).drop("whole")


def buckets(part: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, n, core, hull) of the buckets of suffixes that start at 0 .. len(part) - DEPTH; hulls of
    incomplete ones are negative in ``n``."""
    digest = Digests(part)
    at = np.arange(len(part) - DEPTH + 1)
    if width > 1:
        gram = digest.all(GRAM)
        place = np.flatnonzero(gram == gram[:len(at) + DEPTH - GRAM].min())
        anchor = place[np.searchsorted(place, at)]
        bucket = (anchor - at) // width
        first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (bucket[1:] != bucket[:-1])))
        n = np.diff(np.append(first, len(at)))
        inner = anchor[first] - width * bucket[first]   # the last suffix that a whole bucket has
        core = digest(inner, inner - (width - 1) + DEPTH)
        hull = digest(first, first + n - 1 + DEPTH)
    else:  # single suffixes: the digests of their halves, which are equal exactly where the suffixes are
        first, n, half = at, np.ones(len(at), np.int64), DEPTH // 2
        core, hull = digest(at, at + half), digest(at + half, at + DEPTH)
    return first, np.where(n == width, n, -n), core.view(np.int64), hull.view(np.int64)


def _batch(out: list[list]) -> pa.RecordBatch:
    n = np.concatenate(out[2])
    return pa.RecordBatch.from_arrays(
        [pa.array(out[0], pa.int64()), pa.array(np.concatenate(out[1])), pa.array(np.abs(n)),
         pa.array(np.concatenate(out[3])), pa.array(np.concatenate(out[4])), pa.array(n > 0)],
        ["doc_id", "start", "n", "core", "hull", "whole"])


def written(df: DataFrame, name: str) -> DataFrame:
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def repeated_suffixes(docs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, start, n): runs of positions whose suffixes are repeated, which may overlap; and
    (doc_id, text): the texts that share a first digit with another, which are all that have any.

    ``docs`` is keyed, ``rows`` are its ``run_rows``.  Later passes read these texts only.
    """
    inside = rows.where("core is null and sha256 is null").select("doc_id", "start", "n")
    whole_1, open_1, company = settle(rows.where("core is not null").select("doc_id", "start", "n", "core", "hull"))
    ids = checkpointed(company.select("doc_id").union(inside.select("doc_id")).distinct())
    some = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    # one row for each id; a row with an id and text that another has is its copy
    texts = written(docs.select("doc_id", "text").join(some, "doc_id", "left_semi").dropDuplicates(["doc_id"]),
                    "suffix-texts")
    whole_2, open_2, _ = settle(written(cut_rows(with_lists(texts, open_1), BUCKET), "suffix-buckets"))
    single = written(cut_rows(with_lists(texts, open_2), 1), "suffix-places")
    equal = checkpointed(single.groupBy("core", "hull").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
                         .select("core", "hull"))
    whole_3 = single.join(equal, ["core", "hull"]).select("doc_id", "start", "n")
    return inside.union(whole_1).union(whole_2).union(whole_3), texts


def removed_spans(starts: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes under the suffixes that start at start .. start + n - 1."""
    order, out = np.argsort(starts), []
    for a, b in zip(starts[order].tolist(), (starts + sizes - 1 + DEPTH)[order].tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without(data: np.ndarray, spans: list[tuple[int, int]]) -> bytes:
    keep, at = [], 0
    for a, b in spans:
        keep.append(data[at:a].tobytes())
        at = b
    return b"".join([*keep, data[at:].tobytes()])


def measure_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, repeats) of every row; ``repeats``: something is removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, data, starts, sizes in _each_span(iter([batch])):
                spans = removed_spans(starts, sizes)
                out.append((doc, sum(b - a for a, b in spans), len(spans),
                            hashlib.sha256(without(data, spans)).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.string() if i == 3 else pa.int64()) for i, x in enumerate(zip(*out, strict=True))],
                ["cut_id", "n_removed", "n_spans", "kept"])

    docs = _keyed(docs)
    rows = written(run_rows(docs), "suffix-runs")
    spans, texts = repeated_suffixes(docs, rows)
    cut = with_lists(texts, spans).mapInArrow(run, "cut_id long, n_removed long, n_spans long, kept string")
    return rows.where("sha256 is not null").join(cut, F.col("doc_id") == F.col("cut_id"), "left").select(
        F.col("given_id").alias("doc_id"), F.col("n").alias("n_bytes"), F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept", "sha256").alias("kept_sha256"),
        (F.coalesce("n_removed", F.lit(0)) > 0).alias("repeats"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with texts that lack every repeated string, all columns kept.

    A cut may fall inside a character; such a character goes as a whole.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(doc, without(data, removed_spans(starts, sizes)).decode(errors="ignore"))
                   for doc, data, starts, sizes in _each_span(iter([batch]))]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in out], pa.int64()),
                                              pa.array([t for _, t in out], pa.string())], ["llm_id", "llm_text"])

    keyed = _keyed(docs)
    spans, texts = repeated_suffixes(keyed, written(run_rows(keyed), "suffix-runs"))
    cut = with_lists(texts, spans).mapInArrow(run, "llm_id long, llm_text string")
    same = F.coalesce("doc_id", F.xxhash64("text")) == F.col("llm_id")
    return docs.join(cut, same, "left").withColumn("text", F.coalesce("llm_text", "text")).select(*docs.columns)
