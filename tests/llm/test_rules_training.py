"""The forest and its threshold come from all labelled documents."""
import numpy as np
from pyspark.sql import functions as F

from sparkaudit.llm import rules_forest
from sparkaudit.llm.textstats import COUNTS, MORE


def test_labels_beyond_any_number_of_smallest_hashes_count(spark):
    """24,000 labelled documents, the bad ones those that hash last; 20,000 with the smallest hashes were all good."""
    rows = spark.range(24_000).withColumnRenamed("id", "doc_id")
    last = [r.doc_id for r in rows.orderBy(F.xxhash64(F.lit(rules_forest.SEED), "doc_id").desc()).limit(400).collect()]
    bad = F.col("doc_id").isin(last)
    some = [(F.lit(100) + F.pmod(F.xxhash64(F.lit(i), "doc_id"), F.lit(40))).alias(c) for i, c in enumerate(COUNTS[:1] + COUNTS[2:] + MORE)]
    measured = rows.select("doc_id", *some).withColumns({
        "n_repeat_words": F.lit(3).cast("long"), "word_chars": F.when(bad, F.col("n_words") * 60).otherwise(F.col("n_words") * 5),
        **{c: F.when(bad, F.col(c) * 20).otherwise(F.col(c)) for c in ("n_symbols", "n_dup_lines", "n_long")}})
    measured = measured.select("doc_id", *COUNTS, *MORE)
    labels = rows.select("doc_id", F.when(bad, 0).otherwise(1).alias("quality"))
    forest = rules_forest.train(measured, labels)
    assert forest is not None and len(forest.root) == rules_forest.TREES
    kept = {r.doc_id: r.kept for r in rules_forest.judge(measured, forest).select("doc_id", "kept").collect()}
    good = set(kept) - set(last)
    assert sum(kept[i] for i in good) >= rules_forest.KEEP * len(good) and sum(kept[i] for i in last) < 40


def test_the_threshold_is_that_of_all_scores(spark):
    """By brute force, over several ranges of scores."""
    rng = np.random.default_rng(3)
    good = rng.random(3000) < 0.8
    score = np.round(np.where(good, rng.normal(0.4, 0.05, 3000), rng.normal(0.55, 0.06, 3000)), 4)
    table = spark.createDataFrame([(float(s), bool(g)) for s, g in zip(score, good)], "anomaly double, good boolean").groupBy("anomaly").agg(
        F.count_if("good").alias("n_good"), F.count_if(~F.col("good")).alias("n_bad"))
    for keep in (0.99, 0.9, 1.0):
        at = np.unique(score)
        cuts = np.append((at[1:] + at[:-1]) / 2, at[-1])
        value = [(score[good] <= c).mean() + (score[~good] > c).mean() if (score[good] <= c).mean() >= keep else -1 for c in cuts]
        assert abs(rules_forest.calibrated(table, keep) - cuts[int(np.argmax(value))]) < 1e-12
