"""Near duplicates at similarities other than op10's."""
import random
from collections import defaultdict

import corpus_pipeline
import pytest
from conftest_llm import prose, table_of
from test_dedup import shingles

from sparkaudit.llm import bottomk


def components(rows, percent):
    """(id, n, component, kept) by comparing all pairs of rows."""
    sets, root = [shingles(t) for _, t, _ in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    low = defaultdict(list)
    for k, (i, _, _) in enumerate(rows):
        low[find(k)].append(i)
    return sorted((i, len(sets[k]), min(low[find(k)]), i == min(low[find(k)])) for k, (i, _, _) in enumerate(rows))


@pytest.fixture(scope="module")
def between():
    """Pairs of similarity 0.80 to 0.85, of short and of long texts, and others on both sides of it."""
    rng, rows = random.Random(11), []
    vocabulary = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(7)) for _ in range(3000)]
    for k in range(60):
        words = prose(rng, rng.choice([40, 68, 90, 150, 400]), vocabulary).split(" ")
        n = len(words) - 4
        rows.append((2 * k, " ".join(words), "s"))
        more = int(n / rng.choice([0.76, 0.81, 0.82, 0.83, 0.84, 0.88])) - n
        rows.append((2 * k + 1, " ".join(words + prose(rng, more, vocabulary).split(" ")), "s"))
    return rows


@pytest.mark.parametrize("percent", [80, 85])
def test_percent(spark, between, percent):
    got = sorted(tuple(r) for r in bottomk.near_duplicates(table_of(spark, between), percent).collect())
    assert got == components(between, percent)


def test_required_overlap():
    assert [bottomk.least_shared(p) for p in (80, 85, 90)] == [30, 32, 32]


@pytest.mark.parametrize("n, more", [(64, 11), (64, 9), (63, 11), (60, 10), (56, 9)])
def test_small_set_inside_larger(spark, n, more):
    """Sets of up to 64 shingles in sets of more than 64 that have all of theirs."""
    rng, rows = random.Random(n + more), []
    for k in range(40):
        words = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(9)) for _ in range(n + more + 4)]
        rows += [(2 * k, " ".join(words[:n + 4]), "s"), (2 * k + 1, " ".join(words), "s")]
    got = {r.doc_id for r in bottomk.near_duplicates(table_of(spark, rows)).where("kept").collect()}
    assert got == {i for i, _, _, k in components(rows, 85) if k} == set(range(0, 80, 2))


def test_whole_shared_is_a_bound():
    """Against every size of a partner and every overlap that makes a link."""
    for percent in (80, 85):
        for n in range(1, bottomk.K + 1):
            least = min(c - max(0, m - bottomk.K) for m in range(1, 2 * n) for c in range(1, min(m, n) + 1)
                        if 100 * c >= percent * (n + m - c))
            assert bottomk.whole_shared(n, percent) <= least
            assert least > 0


def test_rows_without_id(spark):
    """Each text is decided by itself, near copies among them too; a given id comes before none."""
    rng = random.Random(4)
    texts = [prose(rng, 120) for _ in range(8)]
    near = [t + " and more" for t in texts]
    rows = [(None, t, str(i)) for i, t in enumerate(texts)]                       # 0, 1: near copies; 2: copies
    rows += [(None, near[0], "n0"), (None, near[1], "n1"), (None, texts[2], "r2"), (None, texts[2], "r2")]
    rows += [(7, texts[3], "i3"), (2**62, near[4], "i4"), (-2**62, near[5], "i5"), (8, prose(rng, 60), "i6")]
    rows += [(None, None, "e"), (None, None, "e"), (None, "", "e"), (None, " ", "e"), (42, prose(rng, 70), "i42")]
    kept = [(r.doc_id, r.text, r.source) for r in bottomk.one_of_each(table_of(spark, rows)).collect()]
    got = [k[1] for k in kept]
    assert [sum(t in got for t in (texts[i], near[i])) for i in range(2)] == [1, 1]
    assert [got.count(texts[i]) for i in (2, 3, 4, 5, 6, 7)] == [1, 1, 0, 0, 1, 1]
    assert sorted(k[0] for k in kept if k[0] is not None) == [-2**62, 7, 8, 42, 2**62]
    assert sum(k[2] == "e" for k in kept) == 4 and len(kept) == 2 + 1 + 2 + 5 + 4
    decided = bottomk.near_duplicates(table_of(spark, rows)).where("n_shingles > 0 and doc_id is null").collect()
    assert len({r.component_id for r in decided}) == 8 and None not in {r.component_id for r in decided}


def test_pipeline_stage(spark, between, sf_small):
    """The stage links at 0.8: near copies of similarity 0.80 to 0.85 go."""
    kept = corpus_pipeline.near_duplicates(spark, table_of(spark, between), sf_small)
    want = {i for i, _, _, k in components(between, 80) if k}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == want
    assert want < {i for i, _, _, k in components(between, 85) if k}


def test_pipeline_stage_on_documents(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    kept = corpus_pipeline.near_duplicates(spark, docs, sf_small)
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, _, _, k in components(rows, 80) if k}
