"""Quality rules: fixed base rules, and an isolation forest on rule statistics.

The forest is grown from all labelled documents: every tree draws a subsample of its
own among them, the bad ones thinned to ``RARE`` of the good ones, as isolation needs
anomalies to be few, and splits a random feature at a random place until points
stand alone.  Documents that few splits isolate are anomalous.  The threshold
on the anomaly is calibrated on all labelled documents, scored on Spark: it keeps at least
``KEEP`` of the documents labelled good, and within that rejects as many of the
bad ones as it can.  The forest is a bounded object that goes to every task; documents
are scored in batches where they are.

Defined cases: null and empty texts have no words and fail the base rules, as
all texts under 50 words do; without labels of both kinds only the base rules
decide; repeated rows get equal results; an empty table gives an empty result;
further columns are not read, and kept by ``keep_good``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkaudit.llm.common import checkpointed, text_slices
from sparkaudit.llm.textstats import COUNTS, MORE, features, measure, statistics

TREES = 200
#: Labelled documents that a tree draws: all of them have the same chance in each tree, but for the thinning.
SUBSAMPLE = 512
RARE = 0.02
KEEP = 0.99
SEED = 7
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words


class Forest(NamedTuple):
    """Trees as arrays of nodes: children come in pairs, a leaf has child 0 and its path length as ``cut``."""

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    root: np.ndarray
    depth: int
    threshold: float  # of the anomaly; beyond it a document is rejected


def usual_path(n: float) -> float:
    """Mean path length of an unsuccessful search among n points."""
    return 0.0 if n <= 1 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else 1.0


def grow(samples: list[np.ndarray], seed: int = SEED) -> Forest:
    """A tree for each sample of points."""
    rng = np.random.default_rng(seed)
    limit = math.ceil(math.log2(max(2, *map(len, samples))))
    feature, cut, child, roots = [], [], [], []

    def node() -> int:
        feature.append(0), cut.append(0.0), child.append(0)
        return len(cut) - 1

    for sample in samples:
        roots.append(node())
        todo = [(roots[-1], sample, 0)]
        while todo:
            at, rows, depth = todo.pop()
            low, high = rows.min(axis=0), rows.max(axis=0)
            open_features = np.flatnonzero(high > low)
            if depth >= limit or len(rows) <= 1 or not len(open_features):
                cut[at] = depth + usual_path(len(rows))
                continue
            f = int(rng.choice(open_features))
            feature[at], cut[at] = f, rng.uniform(low[f], high[f])
            left = rows[:, f] < cut[at]
            child[at] = node()
            node()
            todo += [(child[at], rows[left], depth + 1), (child[at] + 1, rows[~left], depth + 1)]
    return Forest(np.array(feature), np.array(cut), np.array(child), np.array(roots), limit,
                  math.inf)


def anomaly(forest: Forest, points: np.ndarray, subsample: int = SUBSAMPLE) -> np.ndarray:
    """2 ** -(mean path / usual path): near 1 for points that few splits isolate."""
    total = np.zeros(len(points))
    rows = np.arange(len(points))
    for root in forest.root.tolist():
        at = np.full(len(points), root)
        for _ in range(forest.depth):
            down = forest.child[at]
            at = np.where(down > 0, down + (points[rows, forest.feature[at]] >= forest.cut[at]), at)
        total += forest.cut[at]
    return 2.0 ** (-total / len(forest.root) / usual_path(subsample))


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < LEAST_WORDS) | (100 * s["n_repeat_words"] > MOST_REPEATED * s["n_words"])


def labelled(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, statistics ..., good) of every labelled document."""
    marks = (labels.where("quality is not null").groupBy(F.col("doc_id").alias("label_id"))
             .agg(F.max("quality").alias("quality")))
    return measured.join(marks, F.col("doc_id") == F.col("label_id")).select(
        "doc_id", *COUNTS, *MORE, (F.col("quality") == 1).alias("good"))


def draw(rows: DataFrame, n_good: int, n_bad: int) -> list[np.ndarray]:
    """The points of each tree, drawn among all ``rows``: those whose hashes for that tree are smallest."""
    few = min(n_bad, max(1, int(RARE * n_good)))
    size = min(SUBSAMPLE, n_good + few)
    bad = np.random.default_rng(SEED).binomial(size, few / (n_good + few), TREES)
    good, span = size - bad, 1 << 32

    def near(most: int, n: int) -> int:
        """Hashes up to this one hold ``most`` of n rows, by far; no other row is shuffled."""
        return min(span, int((most + 8 * math.sqrt(most) + 16) / n * span))

    def place(tree):
        return F.pmod(F.xxhash64(F.lit(SEED), tree, F.col("doc_id")), F.lit(span))

    cut = F.when(F.col("good"), F.lit(near(int(good.max()), n_good))).otherwise(F.lit(near(int(bad.max()), n_bad)))
    near_rows = rows.withColumn("tree", F.explode(F.filter(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: place(t) < cut)))
    wanted = F.when(F.col("good"), F.lit(good.tolist())).otherwise(F.lit(bad.tolist()))[F.col("tree")]
    order = Window.partitionBy("tree", "good").orderBy(place(F.col("tree")), "doc_id")
    drawn = near_rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= wanted).toArrow()
    points, tree = features({c: drawn.column(c).to_numpy() for c in COUNTS + MORE}), drawn.column("tree").to_numpy()
    return [points[tree == t] for t in np.unique(tree)]


def scored(rows: DataFrame, forest: Forest) -> DataFrame:
    """(anomaly, n_good, n_bad) of ``rows``: how many have each score."""
    shared = rows.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = features({c: batch.column(c).to_numpy() for c in COUNTS + MORE})
            yield pa.RecordBatch.from_arrays([pa.array(anomaly(shared.value, points)), batch.column("good")], ["anomaly", "good"])

    return rows.mapInArrow(run, "anomaly double, good boolean").groupBy("anomaly").agg(
        F.count_if("good").alias("n_good"), F.count_if(~F.col("good")).alias("n_bad"))


def calibrated(scores: DataFrame, keep: float = KEEP) -> float:
    """The threshold that keeps ``keep`` of the good at least, by all ``scores`` (anomaly, n_good, n_bad).

    Among those allowed, the one with the best balance of kept good and rejected bad; midway between
    the scores on either side of it.  Scores lie in ranges, and only a sum for each range is gathered.
    """
    ranged = checkpointed(scores.repartitionByRange("anomaly").withColumn("range", F.spark_partition_id()))
    sums = (ranged.groupBy("range").agg(F.min("anomaly").alias("low"), F.sum("n_good").alias("good"), F.sum("n_bad").alias("bad"))
            .orderBy("low").collect())
    all_good, all_bad = sum(r.good for r in sums), sum(r.bad for r in sums)
    before, good, bad = [], 0, 0
    for r, after in zip(sums, [*sums[1:], None]):
        before.append((r.range, good, bad, after.low if after else None))
        good, bad = good + r.good, bad + r.bad
    starts = ranged.sparkSession.createDataFrame(before, "range int, good long, bad long, after double")
    upto = Window.partitionBy("range").orderBy("anomaly")
    kept = (F.col("good") + F.sum("n_good").over(upto)) / F.lit(all_good)
    caught = 1 - (F.col("bad") + F.sum("n_bad").over(upto)) / F.lit(all_bad)
    above = F.coalesce(F.lead("anomaly").over(upto), "after", "anomaly")
    cuts = ranged.join(F.broadcast(starts), "range").select(
        kept.alias("kept"), caught.alias("caught"), ((F.col("anomaly") + above) / 2).alias("cut"))
    return cuts.where(F.col("kept") >= keep).agg(F.max_by("cut", F.struct(F.col("kept") + F.col("caught"), -F.col("cut")))).first()[0]


def train(measured: DataFrame, labels: DataFrame) -> Forest | None:
    """The forest and its threshold, or None without both labels.

    The base rules decide on short and repetitive texts alone, so the forest sees the others.
    """
    passed = measured.where(F.col("n_words") >= LEAST_WORDS).where(
        100 * F.col("n_repeat_words") <= MOST_REPEATED * F.col("n_words"))
    rows = checkpointed(labelled(passed, labels))
    n_good, n_bad = rows.agg(F.count_if("good"), F.count_if(~F.col("good"))).first()
    if not n_good or not n_bad:
        return None
    forest = grow(draw(rows, n_good, n_bad))
    return forest._replace(threshold=calibrated(scored(rows, forest)))


def judge(measured: DataFrame, forest: Forest | None) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, anomaly)."""
    shared = measured.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {c: batch.column(i + 1).to_numpy() for i, c in enumerate(COUNTS + MORE)}
            failed, score = base_failed(found), np.zeros(batch.num_rows)
            if shared.value is not None:
                score = anomaly(shared.value, features(found))
            kept = ~failed & (score <= (shared.value.threshold if shared.value is not None else 1.0))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(COUNTS) + 1], pa.array(failed), pa.array(kept), pa.array(score)],
                ["doc_id", *COUNTS, "base_failed", "kept", "anomaly"])

    counts = ", ".join(f"{c} long" for c in COUNTS)
    return measured.mapInArrow(run, f"doc_id long, {counts}, base_failed boolean, kept boolean, anomaly double")


def judge_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts and verdict of every document; texts are read once, what follows is narrow."""
    measured = checkpointed(measure(docs))
    return judge(measured, train(measured, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, all columns as they are; nothing is shuffled.

    The forest is fitted first, on the labelled documents alone.
    """
    marked = labels.where("quality is not null").select(F.col("doc_id").alias("label_id")).distinct()
    some = docs.select("doc_id", "text").join(marked, F.col("doc_id") == F.col("label_id"), "left_semi")
    shared = docs.sparkSession.sparkContext.broadcast(train(checkpointed(measure(some)), labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_slices(batches, "text"):
            found = statistics(data, offsets)
            kept = ~base_failed(found)
            if shared.value is not None:
                kept &= anomaly(shared.value, features(found)) <= shared.value.threshold
            yield rows.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
