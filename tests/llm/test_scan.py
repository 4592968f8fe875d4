"""Secrets, decontamination, licences and toxicity."""
import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from conftest_llm import prose, table_of
from pyspark.sql import functions as F

from sparkaudit.llm import common, license_scan, secrets_ledger, toxicity, winnowing
from sparkaudit.llm.common import new_table_path
from sparkaudit.llm.q_scan import OP9_SQL

SECRETS = [
    'token = "abcdef123456" and Password:hunter22 passwd=short secret : x api_key=ZZZZZZZZ',
    "AKIA" + "A" * 16 + " AKIA123 é😀 AKIA" + "B" * 30,
    "0123456789abcdef01234567 deadbeef 😀 " + "f" * 50,
    "apikey='q1w2e3r4' TOKEN='" + "0a" * 20 + "'", "password = password = 123456",
    "https://user:hunter2@example.com ghp_" + "a" * 36, None, "", "ſecret = abcdefgh toKen=abcdefg",
]


def base_spans(text):
    kinds = (("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
             ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24))
    out = []
    for k, (kind, pattern, group, least) in enumerate(kinds):
        out += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, text or "", re.ASCII)
                if len(m.group(group)) >= least]
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out)]


def test_secrets(spark):
    rows = [(i, t, "s") for i, t in enumerate(SECRETS + SECRETS[:2])]
    got = sorted(tuple(r) for r in secrets_ledger.scan_documents(table_of(spark, rows)).collect())
    for (i, a, b, c, digest, spans), (_, text, _) in zip(got, rows, strict=True):
        want = base_spans(text)
        assert [a, b, c] == [sum(s.startswith(k) for s in want) for k in ("assign", "access", "hex")], i
        assert digest == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(spans.split(",")) | {""}
    assert "url_login:0:21" in got[5][5] and "code_host" in got[5][5]


def test_ledger_scans_only_the_unseen(spark):
    path = new_table_path(spark, "ledger")
    one = secrets_ledger.versions(table_of(spark, [(i, t, "s") for i, t in enumerate(SECRETS)]), "doc_id", "text")
    two = secrets_ledger.versions(table_of(spark, [(9, "token=abcdefgh", "s"), (10, SECRETS[0], "s")]), "doc_id", "text")
    ledger = secrets_ledger.run_ledger(one, path, first=True)
    assert secrets_ledger.pending(one, ledger).count() == 0
    assert [r.text for r in secrets_ledger.pending(two, ledger).collect()] == ["token=abcdefgh"]
    newer = (secrets_ledger.RULES[0]._replace(version=2), *secrets_ledger.RULES[1:])
    todo = secrets_ledger.pending(two, ledger, newer).select(F.explode("todo").alias("k")).groupBy("k").count().collect()
    assert {r.k: r["count"] for r in todo}["assign@2"] == 2 and {r.k: r["count"] for r in todo}["hex@1"] == 1
    both = secrets_ledger.run_ledger(two, path)
    found = {r.path: r.spans for r in secrets_ledger.findings(two, both).collect()}
    assert len(found[9]) == 1 and [s.kind for s in found[10]] == ["assign"] * 3


def test_redact(spark, empty):
    rows = [(i, t, "s") for i, t in enumerate(SECRETS)]
    docs = table_of(spark, rows)
    out = secrets_ledger.redact(docs)
    assert out.schema == docs.schema
    got = {r.doc_id: r for r in out.collect()}
    assert got[0].text == '[secret]" and [secret] passwd=short secret : x [secret]'
    assert got[0].n_chars == len(got[0].text) and got[6].text is None and got[7].text == ""
    assert secrets_ledger.redact(empty).count() == 0 and secrets_ledger.scan_documents(empty).count() == 0


@pytest.fixture(scope="module")
def items(spark, corpus):
    rng = random.Random(8)
    w = corpus[2][1].split(" ")
    rows = [(1, " ".join(w[5:25])), (2, " ".join(w[8:40]).upper()), (3, "One TWO"), (4, None), (5, "!!"), (6, prose(rng, 30)),
            (7, "a-b c/d e"), (8, " ".join(w[30:40])), (8, " ".join(w[20:33])), (None, " ".join(w[40:60])), (9, "漢 é")]
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("broadcast", [common.BROADCAST_ROWS, 0])
def test_decontamination(spark, docs, corpus, items, broadcast, monkeypatch):
    """Items broadcast, and joined by salted key."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
    marked = winnowing.mark(docs.select("doc_id", "text"), items, ["doc_id"])
    assert marked.count() == len(corpus)
    got = winnowing.score_documents(docs, items)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toArrow())
    con.register("benchmark", items.toArrow())
    want = sorted(con.execute(OP9_SQL).fetchall(), key=repr)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    hits = sorted((r.doc_id, r.llm_words, sum(r.llm_hits[1::2]) - sum(r.llm_hits[::2]), len(r.llm_items)) for r in marked.collect())
    assert hits == sorted(w[:4] for w in want)
    kept = winnowing.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(w[0] for w in want if not w[5])


def test_full_bitmap(spark, docs, items, monkeypatch):
    """A bitmap that has every fingerprint changes no result; runs of hit words are whole."""
    key = lambda rows: sorted((tuple(r) for r in rows.collect()), key=repr)
    want = key(winnowing.score_documents(docs, items))
    monkeypatch.setattr(winnowing, "bitmap", lambda prints: np.full(winnowing.BITS // 8, 255, np.uint8))
    assert key(winnowing.score_documents(docs, items)) == want
    text = spark.createDataFrame([(1, "a b one two c One-Two one two. two one")], "doc_id long, text string")
    got = winnowing.mark(text, items, ["doc_id"]).first()
    assert got.llm_hits == [2, 4, 5, 9] and got.llm_items == ["3"] and got.llm_words == 11


def test_decontamination_empty(spark, docs, corpus, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert winnowing.score_documents(docs, none).where("contaminated").count() == 0
    assert winnowing.score_documents(empty, none).count() == 0


NOTICES = {"apache-2.0": "Licensed under the Apache License, Version 2.0.", "mit": "Released under the MIT License.",
           "gpl": "This program is distributed under the terms of the GNU General Public License, version 3.",
           "cc-by-sa": "This work is licensed under the CC BY-SA 4.0.", "proprietary": "All rights reserved.",
           "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted"}
CLEAN = ["He lost his driving license and the public noticed it.", "The general was released on Monday.",
         "All seats were reserved early.", "Work under water needs a permit of the second version."]


def test_licenses(spark, empty):
    rng = random.Random(5)
    rows = [(i, prose(rng, 80) + "\n" + prose(rng, 20), "s") for i in range(60)]
    rows += [(100 + i, prose(rng, 60) + "\n" + t, "s") for i, t in enumerate(NOTICES.values())]
    rows += [(200 + i, prose(rng, 60) + "\n" + t, "s") for i, t in enumerate(CLEAN)]
    rows += [(300, None, None), (301, "", None), (302, prose(rng, 400) + " " + NOTICES["mit"] + " " + prose(rng, 300), "s")]
    got = {r.doc_id: r for r in license_scan.scan_documents(table_of(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert [got[100 + i].licenses for i in range(len(NOTICES))] == list(NOTICES)
    assert got[302].licenses == "mit"
    assert all(not got[i].licenses for i in got if i < 100 or i in range(200, 302))


def test_license_words_find_every_feature():
    words = ["apache", "ap", "2.0", "by-nc", "x", "under"]
    found = re.compile(license_scan.pattern(words).replace("\\Q", "").replace("\\E", "").replace(".", "[.]"))
    assert all(found.search(f"a {w}, b") for w in words)
    assert not found.search("apac 20 by-n xx thunder")


def test_toxicity(spark, empty):
    rng = random.Random(4)
    bad = ["idiot", "scum", "worthless", "moron", "réeuxpa", "réeuxti"]
    rows, marks = [], []
    for i in range(400):
        toxic = i % 5 == 0
        words = prose(rng, rng.choice([20, 60, 300])).split(" ")
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), "s"))
        if i < 300:
            marks.append((i, 1, int(toxic)))
    rows += [(900, None, None), (901, "", None)]
    labels = spark.createDataFrame(marks + [(5000, 1, 1), (None, 0, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(table_of(spark, rows), labels).collect()}
    assert len(got) == len(rows)
    assert all(got[i].predicted == (i % 5 == 0) for i in range(300, 400))
    assert got[900].predicted == 0 and all(0 <= got[i].p_severe <= 1 for i in got)
    none = toxicity.score_documents(table_of(spark, rows[:3]), labels.where("false")).collect()
    assert [r.predicted for r in none] == [0, 0, 0]
    assert toxicity.score_documents(empty, labels.where("false")).count() == 0
