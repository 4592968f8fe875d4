"""Prefix trie against a trie built in a dictionary."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import types as T

import __spark_entry__ as E
from sparkaudit.llm import prefix_trie

TURNS = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()), *[T.StructField(c, T.StringType()) for c in ("depth", "llm", "own", "h", "parent")]])


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 5) for r in rows], TURNS)


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            sha = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, sha, role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    whole = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = own.get(c - c % 100, [])[:h] + t[h:]
    members = {}
    for c, t in whole.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
    out = []
    for path, ids in members.items():
        below = [p for p in members if p[:len(path)] == path]
        leaves = [p for p in below if not any(q[:-1] == p and q for q in members)]
        ends = ",".join(str(c) for c in sorted(ids) if len(whole[c]) == len(path))
        out.append((min(ids), len(path), min(members[path[:-1]]) if path else None, len(ids),
                    sum(q[:-1] == path and q != () for q in members), len(leaves),
                    sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(seed=5):
    """Conversations around three hundreds' heads: none, short and long heads, ties, repeated rows, nulls."""
    rng = random.Random(seed)
    texts = ["", None, "hi", "çé 😀", "x" * 3000, "what?"]
    rows = []
    for c in [*range(0, 40), *range(100, 130), *range(201, 230), 1000, 1001, 1005]:
        for t in range(rng.choice([1, 2, 3, 7, 9])):
            rows.append((c, t, rng.choice(["user", "assistant", None]) if t else "system", rng.choice(texts) if t else "hello"))
    rows += [(300, t, "user", "same") for t in range(120)] + [(301 + k, t, "user", "same") for k in range(5) for t in range(60)]
    rows += [(None, 1, "user", "lost"), (7, None, "user", "first"), (7, 2, "user", "tie b"), (7, 2, "user", "tie a")]
    return rows + rows[:9]


@pytest.mark.parametrize(("block", "stretches"), [(3, 10), (3, 10**6), (prefix_trie.BLOCK_NODES, prefix_trie.BLOCK_STRETCHES)])
def test_against_brute_force(spark, block, stretches):
    rows = rows_of()
    random.Random(block).shuffle(rows)
    got = prefix_trie.prefix_trie(frame(spark, rows).repartition(5), block_nodes=block, block_stretches=stretches)
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    found = got.collect()
    assert sorted((tuple(r[c] for c in cols) for r in found), key=repr) == brute(rows)
    places = sorted(p for r in found for p in (r.enter_place, r.exit_place))
    assert places == list(range(2 * len(found)))  # the tour is one list
    at = {(r.conv_id, r.depth): r for r in found}
    for r in found:
        if r.depth:
            above = at[r.parent_conv_id, r.depth - 1]
            assert above.enter_place < r.enter_place < r.exit_place < above.exit_place
    table = spark.createDataFrame(found, got.schema)
    saved = [r.saved_tokens for r in prefix_trie.shared_prefixes(table).collect()]
    assert saved == sorted((r.saved_tokens for r in found if r.n_convs > 1), reverse=True)


def test_a_conversation_over_many_partitions(spark):
    """One conversation holds most turns; the partitions it spans carry its state on."""
    rows = [(500, t, "user", f"{t % 7}") for t in range(400)] + [(501, t, "user", f"{t % 7}") for t in range(390)] + [(502, 0, "user", "0")]
    got = prefix_trie.prefix_trie(frame(spark, rows).repartition(8), block_nodes=100)
    assert sorted((tuple(r)[:8] for r in got.collect()), key=repr) == brute(rows)


def test_empty_and_turnless(spark):
    assert prefix_trie.prefix_trie(frame(spark, [])).count() == 0
    assert prefix_trie.prefix_trie(frame(spark, [(None, 1, "user", "x")])).count() == 0
    h = lambda c: zlib.crc32(str(c).encode()) % 6
    c = next(c for c in range(701, 800) if h(c) > 1)  # its head is absent and it has fewer turns than h
    rows = [(c, 0, "user", "gone")]
    got = [tuple(r)[:8] for r in prefix_trie.prefix_trie(frame(spark, rows)).collect()]
    assert got == brute(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_ids_split_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 4)
    rows = [(c, 0, "user", "same") for c in range(900, 1000) if zlib.crc32(str(c).encode()) % 6 == 0 or c == 900]
    got = prefix_trie.prefix_trie(frame(spark, rows))
    assert sorted((tuple(r)[:8] for r in got.collect()), key=repr) == brute(rows)


def test_query_on_the_small_tables(spark, sf_small):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = E.queries()["op11_prefix_trie"](spark, sf_small).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)
