"""Near duplicates and repeated passages against brute force."""
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest_llm import prose, table_of

from sparkaudit.llm import bottomk, common, suffix_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(rows, percent=85):
    sets = [(i, shingles(t)) for i, t, _ in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[find(a)] = find(b)
    low = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        low[find(k)].append(i)
    return sorted((i, len(s), min(low[find(k)]), i == min(low[find(k)])) for k, (i, s) in enumerate(sets))


def test_near_duplicates(docs, corpus):
    got = sorted(tuple(r) for r in bottomk.near_duplicates(docs).collect())
    assert got == groups(corpus)


@pytest.mark.parametrize("broadcast", [common.BROADCAST_ROWS, 0])
def test_large_groups_in_buckets(spark, monkeypatch, broadcast):
    """A hot family whose members are dealt into many blocks; a chain keeps its links, hubs broadcast or salted."""
    monkeypatch.setattr(bottomk, "BUCKET_SHINGLES", 700)
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
    rng = random.Random(1)
    words = prose(rng, 90).split(" ")
    rows = []
    for i in range(60):
        rows.append((1000 - i, " ".join(words), "s"))
        words[rng.randrange(90)] = f"new{i}"  # each member resembles its neighbours, the ends have little in common
    rows += [(2000 + i, prose(rng, 50), "s") for i in range(20)]
    got = sorted(tuple(r) for r in bottomk.near_duplicates(table_of(spark, rows)).collect())
    assert got == groups(rows)


@pytest.mark.parametrize("seed", range(6))
def test_spanning_links(seed):
    rng = np.random.default_rng(seed)
    center = np.arange(100)
    sets = [np.unique(np.where(rng.random(100) < rng.choice([0.0, 0.05, 0.1, 0.2]), rng.integers(100, 160, 100), center))
            for _ in range(40)]
    ids, asks = rng.permutation(1000)[:40], rng.random(40) < 0.5
    a, b = bottomk.spanning_links(ids, np.concatenate(sets), np.array([len(s) for s in sets]), asks, cells=200)
    want = {i: {i} for i in ids.tolist()}
    have = {i: {i} for i in ids.tolist()}
    for x in range(40):
        for y in range(x):
            n = len(np.intersect1d(sets[x], sets[y]))
            if (asks[x] or asks[y]) and 100 * n >= 85 * (len(sets[x]) + len(sets[y]) - n):
                _union(want, int(ids[x]), int(ids[y]))
    for x, y in zip(a, b, strict=True):
        _union(have, x, y)
    assert want == have


def _union(parts, x, y):
    both = parts[x] | parts[y]
    for i in both:
        parts[i] = both


def test_one_of_each(docs, corpus):
    kept = bottomk.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(ids) == sorted({i for i, _, _, k in groups(corpus) if k})


def test_null_ids_and_empty(spark, empty):
    assert bottomk.near_duplicates(empty).count() == 0
    assert bottomk.one_of_each(empty).columns == empty.columns
    rows = [(None, "a b c d e f", "s"), (None, "a b c d e f", "s"), (5, "a b c d e f", "s"), (None, None, None)]
    got = sorted((tuple(r) for r in bottomk.near_duplicates(table_of(spark, rows)).collect()), key=repr)
    assert [r[2] for r in got if r[1]] == [5, 5, 5]


def brute_kept(rows, depth):
    """(id, bytes, removed, spans, what is left) by looking at every position."""
    texts = [(i, (t or "").encode()) for i, t, _ in rows]
    seen = Counter(b[p:p + depth] for _, b in texts for p in range(len(b) - depth + 1))
    for i, b in texts:
        hit = np.zeros(len(b), bool)
        for p in range(len(b) - depth + 1):
            if seen[b[p:p + depth]] > 1:
                hit[p:p + depth] = True
        yield i, len(b), int(hit.sum()), len(suffix_dedup._runs(hit)), bytes(np.frombuffer(b, np.uint8)[~hit])


def brute_repeats(rows, depth):
    return sorted(((*x[:4], hashlib.sha256(x[4]).hexdigest()) for x in brute_kept(rows, depth)), key=repr)


def test_repeats(docs, corpus):
    got = sorted((tuple(r) for r in suffix_dedup.measure_documents(docs).collect()), key=repr)
    assert all(r[5] == (r[2] > 0) for r in got)
    got = [r[:5] for r in got]
    assert got == brute_repeats(corpus, 400)


def test_repeats_by_key_and_in_chunks(spark, corpus, monkeypatch):
    """Ids beyond the broadcast bound, and texts longer than a chunk."""
    monkeypatch.setattr(suffix_dedup, "BROADCAST_IDS", 0)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 900)
    rows = corpus[:30] + corpus[-14:] + [(None, corpus[3][1], "s"), (None, corpus[4][1] * 3, "s"), (None, None, None)]
    got = sorted((tuple(r)[:5] for r in suffix_dedup.measure_documents(table_of(spark, rows)).collect()), key=repr)
    assert got == brute_repeats(rows, 400)


@pytest.mark.parametrize("width", [16, 1])
def test_buckets_agree(width):
    """Equal suffixes fall into buckets with equal cores, whatever surrounds them."""
    rng = np.random.default_rng(2)
    shared = rng.integers(97, 101, 460, dtype=np.uint8)
    a = np.concatenate([rng.integers(97, 123, 33, dtype=np.uint8), shared])
    b = np.concatenate([shared, rng.integers(97, 123, 70, dtype=np.uint8)])
    cores = []
    for data, base in ((a, 33), (b, 0)):
        rows, _ = suffix_dedup.first_digits(data)
        mine = {}
        for start, n in np.concatenate(rows, axis=1)[:2].T.tolist():
            first, size, core, _ = suffix_dedup.buckets(data[start:start + n + 399], width)
            for p, m, c in zip((first + start).tolist(), np.abs(size).tolist(), core.tolist(), strict=True):
                mine.update({q - base: c for q in range(p, p + m)})
        cores.append(mine)
    assert all(cores[0][q] == cores[1][q] for q in range(61))


def test_repeats_empty(empty):
    assert suffix_dedup.measure_documents(empty).count() == 0
    assert suffix_dedup.remove_repeats(empty).columns == empty.columns


def test_remove_repeats(docs, corpus):
    out = suffix_dedup.remove_repeats(docs)
    assert out.schema == docs.schema
    got = Counter((r.doc_id, r.text or "") for r in out.collect())
    assert got == Counter((x[0], x[4].decode(errors="ignore")) for x in brute_kept(corpus, 400))
