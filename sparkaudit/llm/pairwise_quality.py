"""Quality scores by pairwise ranking.

Preference pairs set a document labelled good against one labelled bad; the
weights minimise the logistic loss of the differences of their features
(Bradley-Terry), so only order is learned, not a base rate.  A quantile of the
training scores becomes the threshold: the one that best balances both kinds.
Scores are moved so that the threshold lies at ``CUT``.

Features are ratios and counts from the texts, cut at quantiles.  The model is
fitted on a sample of labelled rows and is bounded; texts are read once.

Defined cases: null and empty texts have the features of no words and get a
score like any other; a null doc_id is not held out and gives no label;
without labels of both kinds every score is 0.5; repeated rows get equal
scores; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkaudit.llm.common import checkpointed
from sparkaudit.llm.linear import Bins, newton, sigmoid
from sparkaudit.llm.textstats import COUNTS, MORE, features, measure

#: Labelled rows that the model is fitted on, at most: those with the smallest hashes.
MAX_LABELLED = 20_000
PAIRS = 40_000
BINS = 12
PENALTY = 5.0
CUT = 0.3
FOLDS = 5
SEED = 6


class Ranking(NamedTuple):
    bins: Bins
    weights: np.ndarray
    threshold: float


def fit(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS) -> Ranking | None:
    if not good.any() or good.all():
        return None
    bins, rng = Bins.fit(x, BINS), np.random.default_rng(SEED)
    z = bins(x)
    # every row takes part as often as the others of its kind
    better = rng.permutation(np.resize(np.flatnonzero(good), pairs))
    worse = rng.permutation(np.resize(np.flatnonzero(~good), pairs))
    flip = rng.random(pairs) < 0.5
    difference = np.where(flip[:, None], -1, 1) * (z[better] - z[worse])
    weights = newton(difference, (~flip).astype(float), PENALTY, intercept=False)
    score = z @ weights
    quantiles = np.unique(np.quantile(score, np.linspace(0.005, 0.995, 199)))
    kept = 1 - np.searchsorted(np.sort(score[good]), quantiles) / good.sum()
    caught = np.searchsorted(np.sort(score[~good]), quantiles) / (~good).sum()
    return Ranking(bins, weights, float(quantiles[int(np.argmax(kept + caught))]))


def score(model: Ranking | None, x: np.ndarray) -> np.ndarray:
    if model is None:
        return np.full(len(x), 0.5)
    return sigmoid(model.bins(x) @ model.weights - model.threshold + np.log(CUT / (1 - CUT)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def train(measured: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Ranking | None:
    """Fitted on at most ``most`` labelled rows that are not held out."""
    marks = (labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy(F.col("doc_id").alias("label_id")).agg(F.max("quality").alias("quality")))
    rows = (measured.join(marks, F.col("doc_id") == F.col("label_id")).drop("label_id")
            .orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(most).toArrow())
    found = {c: rows.column(c).to_numpy() for c in COUNTS + MORE}
    return fit(features(found), rows.column("quality").to_numpy() == 1)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted)."""
    measured = checkpointed(measure(docs))
    shared = docs.sparkSession.sparkContext.broadcast(train(measured, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {c: batch.column(i + 1).to_numpy() for i, c in enumerate(COUNTS + MORE)}
            value = score(shared.value, features(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(value, pa.float64()), pa.array((value >= CUT).astype(np.int32))],
                ["doc_id", "score", "predicted"])

    return measured.mapInArrow(run, "doc_id long, score double, predicted int").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
