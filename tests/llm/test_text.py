"""Mixing, quality and token counts."""
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest_llm import prose, table_of
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkaudit.llm import mixing, pairwise_quality, rules_forest, token_counts
from sparkaudit.llm.linear import newton, sigmoid
from sparkaudit.llm.q_text import OP4_SQL

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SPACES = r"[^\x20\x09-\x0D]+"


def filled(sizes, weights, share=1.5, ceiling=2.0):
    """Targets by resharing what lies above a ceiling, again and again."""
    total, full, out = share * sum(sizes), set(), [0.0] * len(sizes)
    while True:
        rest = total - sum(ceiling * sizes[i] for i in full)
        open_ = [i for i in range(len(sizes)) if i not in full]
        out = [ceiling * s for s in sizes]
        for i in open_:
            out[i] = rest * weights[i] / sum(weights[j] for j in open_)
        over = {i for i in open_ if out[i] > ceiling * sizes[i]}
        if not over:
            return out
        full |= over


def test_mixing(spark, docs, corpus):
    got = mixing.plan_documents(docs).collect()
    size = Counter()
    for _, t, s in corpus:
        size[s] += len(re.findall(SPACES, t or ""))
    names = sorted((s for s in size if s is not None), key=str) + ([None] if None in size else [])
    want = dict(zip(names, filled([size[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))]), strict=True))
    source = {i: s for i, _, s in corpus}
    taken = Counter()
    for r in got:
        assert r.source_size == size[source[r.doc_id]] and abs(r.target - want[source[r.doc_id]]) < 1e-6
        assert r.taken in (0, r.size, 2 * r.size)
        taken[source[r.doc_id]] += r.taken
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toArrow())
    assert sorted(map(tuple, got), key=repr) == sorted(con.execute(OP4_SQL).fetchall(), key=repr)
    assert sorted(map(tuple, mixing.plan_documents(docs).collect()), key=repr) == sorted(map(tuple, got), key=repr)


def test_mixing_by_salted_keys(docs, monkeypatch):
    want = sorted(map(tuple, mixing.plan_documents(docs).collect()), key=repr)
    rows = sorted(map(tuple, mixing.mix(docs).collect()), key=repr)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mixing.plan_documents(docs).collect()), key=repr) == want
    assert sorted(map(tuple, mixing.mix(docs).collect()), key=repr) == rows
    assert mixing.mix(docs).columns == [c for c in docs.columns if c != "copy"] + ["copy"]
    assert sum(len(re.findall(SPACES, r[1] or "")) for r in rows) == sum(r[4] for r in want)


@pytest.mark.parametrize("seed", range(5))
def test_many_sources(spark, seed):
    rng = random.Random(seed)
    sizes = {f"k{i:03}": rng.choice([0, 1, 5, 50, 3000]) for i in range(40)}
    sized = spark.createDataFrame([(s, n) for s, n in sizes.items() for _ in range(2)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_rates(sized).collect()}
    want = filled([2 * n for n in sizes.values()], [(3, 1, 2)[i % 3] for i in range(40)])
    assert all(abs(got[s] - t) < 1e-6 for s, t in zip(sizes, want, strict=True))


def test_mixing_empty(spark, empty):
    assert mixing.plan_documents(empty).count() == 0 and mixing.mix(empty).count() == 0
    bare = table_of(spark, [(1, None, None), (2, "", "s")])
    assert [r.taken for r in mixing.plan_documents(bare).collect()] == [0, 0]


@pytest.fixture(scope="module")
def judged():
    """Texts with labels: prose is good; shouting, symbols and lists are bad."""
    rng = random.Random(9)
    rows, marks = [], []
    for i in range(900):
        text, kind = prose(rng, rng.choice([60, 90, 200, 400])), i % 9
        if kind == 0:
            text = " ".join(w + rng.choice(["***", "$$$", "%%%"]) for w in text.split(" "))
        elif kind == 1 and i % 2:
            text = " ".join(w.upper() + "!!" for w in text.split(" "))
        rows.append((i, text, "s"))
        marks.append((i, int(not (kind == 0 or kind == 1 and i % 2)), 0))
    return rows, marks


def stats(text):
    t = text or ""
    w, seen, dup = re.findall(SPACES, t), set(), 0
    for line in t.split("\n"):
        if re.search(SPACES, line):
            dup += line in seen
            seen.add(line)
    tri = Counter(zip(w, w[1:], w[2:]))
    cover = {j for i in range(len(w) - 2) if tri[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover)


def test_rules(spark, judged, corpus, empty):
    rows, marks = judged
    labels = spark.createDataFrame([*marks[:600], (None, None, None), (7777, 1, 0)], "doc_id long, quality int, toxic int")
    more = [(5000 + k, t, s) for k, (_, t, s) in enumerate(corpus)]
    docs = table_of(spark, rows + more)
    got = {r.doc_id: tuple(r) for r in rules_forest.judge_documents(docs, labels).collect()}
    for i, t, _ in rows + more:
        want = stats(t)
        assert got[i][1:6] == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert got[i][6] == failed and not (failed and got[i][7])
    good = [got[i][7] for i, q, _ in marks[600:] if q and not got[i][6]]
    bad = [got[i][7] for i, q, _ in marks[600:] if not q and not got[i][6]]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.1
    kept = rules_forest.keep_good(docs, labels)
    assert kept.schema == docs.schema
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in got if got[i][7])
    none = rules_forest.judge_documents(docs, labels.where("false")).collect()
    assert all(r.kept == (not r.base_failed) for r in none)
    assert rules_forest.judge_documents(empty, labels).count() == 0


def test_quality(spark, judged, corpus, empty):
    rows, marks = judged
    labels = spark.createDataFrame([*marks, (None, 1, None)], "doc_id long, quality int, toxic int")
    rows = rows + [(5000, None, None), (5001, "", "s"), (None, "no id", "s")]
    got = {r.doc_id: r for r in pairwise_quality.score_documents(table_of(spark, rows), labels).collect()}
    assert len(got) == len(rows)
    for i, r in got.items():
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(got[i].predicted, q) for i, q, _ in marks if got[i].held_out]
    assert np.mean([p == q for p, q in held]) > 0.95
    # held-out labels have no influence
    flipped = spark.createDataFrame([(i, 1 - q if got[i].held_out else q, t) for i, q, t in marks],
                                    "doc_id long, quality int, toxic int")
    again = {r.doc_id: r.score for r in pairwise_quality.score_documents(table_of(spark, rows), flipped).collect()}
    assert all(abs(again[i] - got[i].score) < 1e-9 for i in got)
    assert pairwise_quality.score_documents(empty, labels.where("false")).count() == 0


def test_newton_finds_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 4))
    y = (rng.random(500) < sigmoid(x @ [1, -2, 0.5, 0] + 0.3)).astype(float)
    w = newton(x, y, 1.0)
    z = np.hstack([x, np.ones((500, 1))])
    gradient = z.T @ (sigmoid(z @ w) - y) + np.append(w[:-1], 0)
    assert np.abs(gradient).max() < 1e-4


SP = sentencepiece.SentencePieceProcessor(model_file=MODEL)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t▁abcdeting.</s>0x😀漢é"), st.characters(
    blacklist_categories=("Cs",))), max_size=80), max_size=5))
def test_tokens_as_the_library(texts):
    assert token_counts.Counter(token_counts.load(MODEL))(texts) == [len(x) for x in SP.encode(texts, num_threads=1)]


@pytest.mark.parametrize("text", ["ab" * 3000, " " * 2000, "漢字" * 900, "the" * 700 + "😀" * 600, "=" * 4000])
def test_long_pretokens(text):
    assert token_counts.Counter(token_counts.load(MODEL))([text]) == [len(SP.encode(text))]


def test_token_counts(docs, corpus, empty):
    got = sorted((tuple(r) for r in token_counts.count_tokens(docs, MODEL).collect()), key=repr)
    want = []
    for i, t, _ in corpus:
        n = len(SP.encode(t or ""))
        want.append((i, len((t or "").encode()), n, n > 4096))
    assert got == sorted(want, key=repr)
    assert token_counts.count_tokens(empty, MODEL).count() == 0
