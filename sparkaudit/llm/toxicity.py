"""Toxicity categories by a chain of linear classifiers.

The categories are predicted in turn; each logistic model sees the texts' terms
and the probabilities of the categories before it.  Training feeds it
out-of-fold probabilities, so later models meet the errors that they will meet.
Terms are words and word beginnings of 4 to 8 bytes, hashed; those that tell
toxic from other labelled documents best become features (present or not), and
two more say how many of them a text has, and how densely.

Only ``toxic`` is labelled in the tables.  The categories before it are weak
labels: a toxic document with an insult at a person, with demeaning words, or
with several of these (``SEEDS``).  A table with columns of these names can be
given instead.

The features are selected and the models fitted on a sample of labelled rows;
both are bounded and go to every task, where whole texts are scored in place.

Defined cases: null and empty texts have no terms and get the base
probability; without labels of both kinds all probabilities are 0; repeated
rows get equal results; an empty table gives an empty result; further columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkaudit.llm.common import checkpointed, text_slices
from sparkaudit.llm.linear import newton, sigmoid
from sparkaudit.llm.words import LOWER_CODE, alphanumeric, find_words, mix, powers

#: Labelled rows that features and models are fitted on, at most: those with the smallest hashes.
MAX_LABELLED = 12_000
TERMS = 256
LEAST_TOXIC = 4      # documents labelled toxic that a term occurs in, at least
LEAST_ODDS = 2.0     # log of how much likelier it is there
PREFIXES = (4, 5, 6, 7, 8)
CHAIN = ("insult", "demeaning", "severe", "toxic")
FOLDS = 3
PENALTY = 2.0
SEED = 5

# Words of the weak labels.
SEEDS = {
    "insult": ("idiot", "moron", "stupid", "clown", "loser"),
    "demeaning": ("trash", "scum", "pathetic", "worthless", "disgusting"),
}
SEVERE = 3  # occurrences of any of these


class Chain(NamedTuple):
    terms: np.ndarray            # sorted hashes
    weights: list[np.ndarray]    # by category: terms, two counts, earlier probabilities, intercept
    threshold: float             # of the last category


def term_codes(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, hash) of every word, then of every word's beginning of each length."""
    words = find_words(data, offsets, alphanumeric())
    yield words.row, words.hash
    up, _ = powers(max(PREFIXES) + 1)
    live = np.arange(len(words.row))
    code = np.zeros(len(live), np.uint64)
    for i in range(max(PREFIXES)):
        long = words.end[live] - words.start[live] > i
        live, code = live[long], code[long]
        code = code + LOWER_CODE[data[words.start[live] + i]] * up[i]
        if i + 1 in PREFIXES:
            yield words.row[live], mix(code ^ np.uint64(i + 1))


def term_table(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, terms): number of words and distinct term hashes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_slices(batches, "text"):
            found = list(term_codes(data, offsets))
            n_words = np.bincount(found[0][0], minlength=rows.num_rows)
            row, code = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((code, row))
            row, code = row[order], code[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
            ends = np.searchsorted(row[new], np.arange(rows.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(n_words, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(code[new].view(np.int64)))],
                ["doc_id", "n_words", "terms"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, terms array<long>")


def weak_labels(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, toxic) with a 0/1 column for each category of CHAIN."""
    text = F.lower(F.coalesce("text", F.lit("")))
    every = [w for words in SEEDS.values() for w in words]

    def count(words):
        return F.regexp_count(text, F.lit(rf"\b({'|'.join(words)})\b"))

    toxic = F.col("toxic") == 1
    return docs.select(
        "doc_id", "text", *[(toxic & (count(words) > 0)).cast("int").alias(k) for k, words in SEEDS.items()],
        (toxic & (count(every) >= SEVERE)).cast("int").alias("severe"), toxic.cast("int").alias("toxic"))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, text, a column for each category) of at most ``most`` labelled documents."""
    own = [c for c in CHAIN if c in labels.columns]
    ids = (labels.where("toxic is not null").groupBy(F.col("doc_id").alias("label_id"))
           .agg(*[F.max(c).alias(c) for c in own])
           .orderBy(F.xxhash64(F.lit(SEED), "label_id"), "label_id").limit(most))
    some = (docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("label_id"))
            .drop("label_id").dropDuplicates(["doc_id"]))
    return some.select("doc_id", "text", *CHAIN) if len(own) == len(CHAIN) else weak_labels(some)


def fit_chain(x: np.ndarray, y: np.ndarray, folds: int = FOLDS) -> tuple[list[np.ndarray], float]:
    """Weights by category, and the threshold of the last one with the best F1 out of fold."""
    fold = np.random.default_rng(SEED).integers(0, folds, len(x))
    weights, earlier = [], np.zeros((len(x), 0))
    for k in range(y.shape[1]):
        z, out = np.hstack([x, earlier]), np.zeros(len(x))
        for f in range(folds):
            out[fold == f] = predict(newton(z[fold != f], y[fold != f, k], PENALTY, 8), z[fold == f])
        weights.append(newton(z, y[:, k], PENALTY, 8))
        earlier = np.hstack([earlier, out[:, None]])
    cuts = np.linspace(0.05, 0.95, 91)
    hits = np.array([((out >= c) & (y[:, -1] == 1)).sum() for c in cuts])
    f1 = 2 * hits / np.maximum(1, np.array([(out >= c).sum() for c in cuts]) + (y[:, -1] == 1).sum())
    best = np.flatnonzero(f1 >= f1.max() - 1e-9)
    return weights, float(cuts[best[len(best) // 2]])


def predict(weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    return sigmoid(x @ weights[:-1] + weights[-1])


def matrix(row: np.ndarray, term: np.ndarray, n_rows: int, n_terms: int, n_words: np.ndarray) -> np.ndarray:
    """Features: terms present, how many they are, and how densely they stand."""
    x = np.zeros((n_rows, n_terms + 2))
    x[row, term] = 1
    count = x.sum(axis=1)
    x[:, -2], x[:, -1] = np.log1p(count), np.log1p(100 * count / (n_words + 20))
    return x


def train(docs: DataFrame, labels: DataFrame) -> Chain | None:
    sample = checkpointed(labelled_sample(docs, labels))
    terms = checkpointed(term_table(sample).join(sample.select("doc_id", *CHAIN), "doc_id"))
    sizes = terms.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    n, toxic = sizes[0], sizes[1] or 0
    if not 0 < toxic < n:
        return None
    odds = (F.log((F.col("a") + 0.5) / (toxic + 1)) - F.log((F.col("n") - F.col("a") + 0.5) / (n - toxic + 1)))
    # terms of toxic documents first, which are few; the others only count these
    often = checkpointed(terms.where("toxic = 1").select(F.explode("terms").alias("term")).groupBy("term")
                         .agg(F.count(F.lit(1)).alias("a")).where(F.col("a") >= LEAST_TOXIC))
    best = (terms.select(F.explode("terms").alias("term")).join(F.broadcast(often.select("term")), "term").groupBy("term")
            .agg(F.count(F.lit(1)).alias("n")).join(often, "term").withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
            .orderBy((F.col("a") * F.col("odds")).desc(), "term").limit(TERMS).select("term").toArrow())
    chosen = np.sort(best.column(0).to_numpy().view(np.uint64))
    wanted = F.array(*[F.lit(int(t)) for t in chosen.view(np.int64)]) if len(chosen) else F.array().cast("array<bigint>")
    rows = (terms.select("doc_id", "n_words", *CHAIN, F.array_intersect("terms", wanted).alias("terms"))
            .orderBy("doc_id").toArrow())
    found = rows.column("terms").combine_chunks()
    owner = np.repeat(np.arange(n), np.diff(found.offsets.to_numpy()))
    term = np.searchsorted(chosen, found.flatten().to_numpy().view(np.uint64))
    y = np.stack([rows.column(c).to_numpy() for c in CHAIN], axis=1).astype(float)
    x = matrix(owner, term, n, len(chosen), rows.column("n_words").to_numpy())
    return Chain(chosen, *fit_chain(x, y))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, a probability for each category, predicted, is_toxic): the last two say that the document is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for rows, data, offsets in text_slices(batches, "text"):
            values = score(model, data, offsets) if model else np.zeros((rows.num_rows, len(CHAIN)))
            cut = model.threshold if model else 2.0
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), *[pa.array(v) for v in values.T], pa.array((values[:, -1] >= cut).astype(np.int32)),
                 pa.array(values[:, -1] >= cut)],
                ["doc_id", *[f"p_{c}" for c in CHAIN], "predicted", "is_toxic"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, " + ", ".join(f"p_{c} double" for c in CHAIN) + ", predicted int, is_toxic boolean")


def score(model: Chain, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probabilities, a row per text and a column per category."""
    n, n_words = len(offsets) - 1, None
    maybe = np.zeros(1 << 16, bool)  # most terms miss this small table and need no search
    maybe[(model.terms & np.uint64(0xFFFF)).astype(np.int64)] = True
    rows, terms = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for row, code in term_codes(data, offsets):
        near = np.flatnonzero(maybe[(code & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(model.terms, code[near]), max(0, len(model.terms) - 1))
        hit = model.terms[at] == code[near] if len(model.terms) else np.zeros(0, bool)
        rows.append(row[near][hit])
        terms.append(at[hit])
        if n_words is None:  # the words come first
            n_words = np.bincount(row, minlength=n)
    x = matrix(np.concatenate(rows), np.concatenate(terms), n, len(model.terms), n_words)
    out = np.zeros((n, 0))
    for w in model.weights:
        out = np.hstack([out, predict(w, np.hstack([x, out]))[:, None]])
    return out

