"""What the licence classifier takes for unknown, and what for common."""
import random

import pytest
from conftest_llm import prose, table_of
from pyspark.sql import functions as F

from sparkaudit.llm import license_scan

SHORT = ["MIT License", "License: MIT", "SPDX-License-Identifier: GPL-2.0-or-later", "GPL-3.0", "BSD-3-Clause"]
COMMON = ["the software", "version 2 of the report was published", "he lost his driving license", "all of it", "x"]


def test_is_notice(spark):
    rows = [(t,) for t in SHORT + COMMON + ["x = 1  # Released under the MIT License, see above"]]
    words = spark.createDataFrame(rows, "text string").select("text", license_scan.words_of(F.col("text")).alias("words"))
    got = {r.text for r in words.where(license_scan.is_notice(F.col("words"))).collect()}
    assert set(SHORT) < got and not got & set(COMMON[1:]) and len(got) <= len(SHORT) + 2


@pytest.fixture(scope="module")
def code(spark):
    """A code source with one short notice a file: a third of all rows."""
    rng = random.Random(6)
    rows = [(i, prose(rng, 40) + "\n" + prose(rng, 30), "prose") for i in range(120)]
    rows += [(200 + i, SHORT[i % len(SHORT)] + "\n" + prose(rng, 20), "code") for i in range(60)]
    return table_of(spark, rows)


def test_notices_are_not_taught_as_unknown(code):
    rows = license_scan.training_rows(code).where("of_corpus").select(F.array_join("words", " ").alias("t")).collect()
    assert len(rows) == 300 and not {r.t for r in rows} & {t.lower().replace(":", "") for t in SHORT}


def test_shares_of_all_documents(code, monkeypatch):
    monkeypatch.setattr(license_scan, "SAMPLE_DOCS", 5)  # shares don't come from the sample
    got = {r.gram: r.share for r in license_scan.background_shares(
        code.unionByName(code.limit(3).withColumn("text", F.lit("He lost his License")))).collect()}
    assert got.get("license") == pytest.approx(3 / 303)
    assert not {"mit", "gpl-3.0", "spdx-license-identifier", "gpl-2.0-or-later"} & set(got)


def test_short_notices_are_confirmed(code):
    """All five kinds, and nothing else of the table."""
    found = {r.doc_id: r for r in license_scan.scan_documents(code).collect()}
    kinds = ["mit", "mit", "gpl", "gpl", "bsd"]
    assert {i: r.licenses for i, r in found.items() if r.licenses} == {200 + i: kinds[i % 5] for i in range(60)}
    assert not [i for i, r in found.items() if r.suspected]


def test_short_paragraphs_are_compared_with_names(code):
    """One or two words of a sentence of a notice are no name."""
    parts = [(0, "the license"), (1, "permission notice"), (2, "license mit"), (3, "the mit license see below"), (4, "copy"),
             (5, "under gpl-3.0 and others")]
    rows = code.sparkSession.createDataFrame([(i, 0, 0, t.split(" ")) for i, t in parts],
                                             "doc_id long, line int, part int, words array<string>")
    model = license_scan.Model(None, [], [], 0.5, [], license_scan.notices_by_gram(code.sparkSession))
    got = {(r.doc_id, r.family) for r in license_scan.compare(rows, model).where("similarity >= 0.5").collect()}
    assert {(2, "mit"), (3, "mit"), (5, "gpl")} <= got
    assert not {i for i, _ in got} & {1, 4}


def test_threshold_counts_every_paragraph(spark):
    """One likely paragraph among 2,001 is less than one in a thousand, though it alone has a feature; five are more."""
    weights = spark.createDataFrame([("gpl-3.0", [5.0, 0.0])], "gram string, w array<double>")
    model = license_scan.Model(weights, [0.0, 0.0], ["gpl", "unknown"], 0.5, ["gpl-3.0"], None)
    for likely, want in ((1, 0.0), (5, 0.9933)):
        parts = spark.range(2001).select(
            F.col("id").alias("doc_id"), F.lit(0).alias("line"), F.lit(0).alias("part"),
            F.array(F.when(F.col("id") < likely, "gpl-3.0").otherwise("word")).alias("words"))
        assert license_scan.passed_by(parts, model) == pytest.approx(want, abs=1e-3)


def test_unknown_is_learned_from_every_paragraph(spark):
    """1,000 documents of two paragraphs; those without a feature count in the threshold by their number."""
    rng = random.Random(8)
    rows = [(i, prose(rng, 12) + "\n" + prose(rng, 9), "prose") for i in range(1000)]
    docs = table_of(spark, rows)
    assert license_scan.training_rows(docs).where("of_corpus").count() == 2000
    weights = spark.createDataFrame([("gpl-3.0", [5.0, 0.0])], "gram string, w array<double>")
    model = license_scan.Model(weights, [0.0, 0.0], ["gpl", "unknown"], 0.5, ["gpl-3.0"], None)
    one = spark.createDataFrame([(0, 0, 0, ["gpl-3.0"])], "doc_id long, line int, part int, words array<string>")
    # paragraphs without a feature count where they are only counted
    assert license_scan.passed_by(one, model, without=2000) == 0.0
    assert license_scan.passed_by(one, model, without=0) == pytest.approx(0.9933, abs=1e-3)
    _, n, out = license_scan.background(docs)
    assert n == 2000 and out == license_scan.training_rows(docs).where("kept_out").count()
