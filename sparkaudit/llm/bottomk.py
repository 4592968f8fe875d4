"""Near-duplicate groups from bottom-k sketches of one hash function.

A document's set is its distinct 5-word shingles, hashed once; its sketch is the
K smallest values (the whole set if it has no more).  Equal sets are one class.

1. Inverted lists.  Two sets with similarity 0.85 share at least half of their
   sketches: the values a pair has in the sketch of its union are K draws of
   which 85 % lie in both, and fewer than K / 2 do in less than one pair in
   10**9 (``least_shared`` has the number for other similarities).  A whole set
   shares ceil(0.85 n) with another whole one, and less what the sketch lacks
   with a larger one, for certain (``whole_shared``).  So the values that only
   few documents hold are enough: of each sketch the rarest k - need + 1 values
   are listed, and a pair that could be linked meets in one of these lists.
   Values that nothing else holds use up that budget, which leaves most
   documents without any list.
2. Stars.  In each list the member whose sketch the others share most is the
   hub.  All members of a list are compared with its hub, so the work is one
   row per (member, hub), never all pairs of a list.
3. Exact verification on full sets.  Each member meets its hub in a join; the
   members linked with it are one component, which is all of a group of alike
   copies, however large.  Only members that are not linked are compared with
   the others of their group, in blocks: both sides are dealt into buckets of
   bounded size and each pair of buckets is a block, so no task holds a whole
   hot group and no link is lost.  In a block, shingles that nothing else holds
   rule most members out; it gives links that span its components.
4. Components by label propagation with pointer jumping, checkpointed.

Defined cases: texts without words (null, empty, white space) have no shingles,
link with nothing and stay; fewer than 5 words are one shingle; repeated rows
share their component and are kept alike; ties go to the smallest doc_id; an
empty table gives an empty result; further columns are not read, and kept by
``one_of_each``.  ``doc_id`` identifies a text; a row without one goes by a key
hashed from its text, so such rows are compared like all others and each text
is decided by itself.  Given ids come before keys: a component is called by its
smallest given id, or by its smallest key where no member has an id.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkaudit.llm.common import checkpointed, looked_up, new_table_path, text_slices
from sparkaudit.llm.words import find_words, grams, not_space

SHINGLE = 5
K = 64
#: Similarity of a link, unless the caller asks for another one.
PERCENT = 85
#: A pair to be linked shares fewer values of its sketches than it should with less than this probability.
MISSED = 1e-9
#: Shingles that a bucket of a group holds; a block has two buckets.
BUCKET_SHINGLES = 250_000
#: Candidate ids up to this number (8 bytes each) are broadcast to fetch texts; more are joined by key.
BROADCAST_IDS = 1_000_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = find_words(data, offsets, not_space())
    bounds = np.searchsorted(words.row, np.arange(len(offsets)))
    every = grams(words.hash, SHINGLE)
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi - lo >= SHINGLE:
            yield np.unique(every[lo:hi - SHINGLE + 1])
        else:
            yield grams(words.hash[lo:hi], hi - lo) if hi > lo else every[:0]


def _key() -> Column:
    """``doc_id``, or for rows without one a key from the text."""
    return F.coalesce("doc_id", F.xxhash64(F.lit("text"), F.coalesce("text", F.lit(""))))


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, given): ``doc_id`` is never null here."""
    return docs.select(_key().alias("doc_id"), "text", F.col("doc_id").isNotNull().alias("given"))


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, given, n, digest, sketch) of keyed rows: size and content hash of the set, and its smallest values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_slices(batches, "text"):
            n, digest, sketch = [], [], []
            for s in shingle_sets(data, offsets):
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest())
                sketch.append(s[:K].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(2), pa.array(n, pa.int64()), pa.array(digest),
                 pa.array(sketch, pa.list_(pa.int64()))], ["doc_id", "given", "n", "digest", "sketch"])

    return docs.select("doc_id", "text", "given").mapInArrow(
        run, "doc_id long, given boolean, n long, digest string, sketch array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_slices(batches, "text"):
            found = [s.view(np.int64) for s in shingle_sets(data, offsets)]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(found, pa.list_(pa.int64()))],
                                             ["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles array<long>")


def least_shared(percent: int) -> int:
    """Of two sketches with K values each, so many at least are shared by a pair to be linked; at most half."""
    p, below = percent / 100, 0.0
    for shared in range(K // 2):
        below += math.comb(K, shared) * p**shared * (1 - p)**(K - shared)
        if below >= MISSED:
            return shared
    return K // 2


def whole_shared(n: int, percent: int) -> int:
    """The sketch of a set of n <= K values shares so many at least with that of a set it could be linked with.

    A set of m values has percent * (n + m) / (100 + percent) in common with it, of which the sketch lacks m - K at most.
    """
    sizes = range(-(-percent * n // 100), 100 * n // percent + 1)
    return min(-(-percent * (n + m) // (100 + percent)) - max(0, m - K) for m in sizes)


def star_pairs(classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(member, hub, n) from (rep, n, sketch): every member of an inverted list with the list's hub."""
    entries = classes.select("rep", "n", F.explode("sketch").alias("value"))
    common = entries.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    held = F.least("n", F.lit(K))
    whole = F.array(*[F.lit(whole_shared(n, percent)) for n in range(1, K + 1)])
    need = F.when(F.col("n") <= K, F.get(whole, F.col("n").cast("int") - 1)).otherwise(F.lit(least_shared(percent)))
    listed = (entries.join(common, "value").groupBy("rep").agg(
        F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "value"))).alias("shared"),
        F.sum("df").alias("fame"))
        # the rarest values first: those that nothing else holds need no list
        .withColumn("budget", (held - need + 1 - (held - F.size("shared"))).cast("int"))
        .where("budget > 0")
        .select("rep", "n", "fame", F.explode(F.slice("shared", F.lit(1), F.col("budget"))["value"]).alias("value")))
    listed = checkpointed(listed)
    hubs = (listed.groupBy("value").agg(F.max(F.struct("fame", (-F.col("rep")).alias("rep"))).alias("top"),
                                        F.count(F.lit(1)).alias("members")).where("members > 1")
            .select("value", (-F.col("top.rep")).alias("hub")))
    return (listed.join(hubs, "value").where("rep <> hub")
            .groupBy(F.col("rep").alias("member"), "hub").agg(F.first("n").alias("n")))


def links(docs: DataFrame, pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): verified links that span the same components as all links among the groups' members."""
    spark = docs.sparkSession
    ids = checkpointed(pairs.select(F.col("member").alias("id")).union(pairs.select("hub")).distinct())
    some = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    sets = full_sets(docs.select("doc_id", "text").join(some, F.col("doc_id") == F.col("id"), "left_semi"))
    path = new_table_path(spark, "shingle-sets")
    sets.dropDuplicates(["doc_id"]).write.parquet(path)
    sets = spark.read.parquet(path)
    stars = checkpointed(with_hubs(pairs, sets, percent))
    return stars.where("linked").select(F.col("member").alias("a"), F.col("hub").alias("b")).unionByName(
        others(stars, sets, percent))


def with_hubs(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``pairs`` with ``linked``: whether member and hub are similar.  A hub of very many is a skewed key of a
    join of two written tables, which Spark splits."""
    mine = sets.select(F.col("doc_id").alias("member"), F.col("shingles").alias("mine"))
    its = sets.select(F.col("doc_id").alias("hub"), F.col("shingles").alias("its"))
    common = F.size(F.array_intersect("mine", "its"))
    return pairs.join(mine, "member").join(its, "hub").select(
        "member", "hub", "n", (100 * common >= percent * (F.size("mine") + F.size("its") - common)).alias("linked"))


def others(stars: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): links of members that are not linked with their hub, within their groups.

    How many blocks a hub's group fills is looked up without dealing rows by hub: a hub of very many is in no one task.
    """
    sizes = checkpointed(
        stars.groupBy("hub").agg(F.sum(F.when(~F.col("linked"), F.col("n"))).alias("rows"), F.sum("n").alias("cols"))
        .where("rows is not null")
        .select("hub", *[F.ceil(F.col(x) / BUCKET_SHINGLES).cast("int").alias(x) for x in ("rows", "cols")]))
    shared = looked_up(stars.select("hub", "member", (~F.col("linked")).alias("asks")), sizes, ["hub"],
                       F.xxhash64("member"))

    def dealt(name):
        return F.pmod(F.xxhash64("member"), F.col(f"{name}s")).cast("int").alias(name)

    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(f"{name}s") - 1)).alias(name)
    rows = shared.where("asks").select("hub", dealt("row"), every("col"), "member", "asks")
    cols = shared.select("hub", every("row"), dealt("col"), "member", F.lit(False).alias("asks"))
    block = rows.unionByName(cols).groupBy("hub", "row", "col", "member").agg(F.max("asks").alias("asks"))

    def verify(block: pa.Table) -> pa.Table:
        shingles = block.column("shingles").combine_chunks()
        a, b = spanning_links(block.column("member").to_numpy(), shingles.flatten().to_numpy(),
                              np.diff(shingles.offsets.to_numpy()), block.column("asks").to_numpy(), percent=percent)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return (block.join(sets, F.col("member") == F.col("doc_id")).drop("doc_id")
            .groupBy("hub", "row", "col").applyInArrow(verify, "a long, b long"))


def spanning_links(ids: np.ndarray, shingles: np.ndarray, sizes: np.ndarray, asks: np.ndarray,
                   cells: int = 4_000_000, percent: int = PERCENT) -> tuple[list[int], list[int]]:
    """Links that connect whatever the exact links of members that ``asks`` marks with any of ``ids`` connect;
    each gives (member, root).

    ``shingles`` holds the members' sets one after the other.  ``cells`` bounds the counts (rows times
    members) held at once.
    """
    m = len(ids)
    owner = np.repeat(np.arange(m), sizes)
    _, code, held = np.unique(shingles, return_inverse=True, return_counts=True)
    # a link needs so many percent of the larger set in common with another member
    able = 100 * np.bincount(owner, held[code] > 1, m) >= percent * sizes
    open_rows, root = np.flatnonzero(able & asks), np.arange(m)
    if len(open_rows):
        keep = able[owner] & (held[code] > 1)
        owner, code = owner[keep], np.unique(code[keep], return_inverse=True)[1]
        order = np.argsort(code, kind="stable")
        by_code, first = owner[order], np.searchsorted(code[order], np.arange(code.max() + 2))
        starts = np.searchsorted(owner, np.arange(m + 1))
        for part in np.array_split(open_rows, -(-len(open_rows) * m // cells)):
            common = np.zeros((len(part), m), np.int32)
            for i, r in enumerate(part.tolist()):
                mine = code[starts[r]:starts[r + 1]]
                lo, n = first[mine], first[mine + 1] - first[mine]
                at = np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
                common[i] = np.bincount(by_code[at], minlength=m)
            for i, r in enumerate(part.tolist()):
                for other in np.flatnonzero(_similar(common[i], sizes, sizes[r], percent)).tolist():
                    if other != r and (x := _find(root, other)) != (y := _find(root, r)):
                        root[max(x, y)] = min(x, y)
    tops = [_find(root, i) for i in range(m)]
    moved = [i for i, t in enumerate(tops) if t != i]
    return ids[moved].tolist(), [int(ids[tops[i]]) for i in moved]


def _similar(common: np.ndarray, sizes: np.ndarray, size: int, percent: int) -> np.ndarray:
    return 100 * common >= percent * (sizes + size - common)


def _find(root: np.ndarray, i: int) -> int:
    while root[i] != i:
        root[i] = root[root[i]]
        i = int(root[i])
    return i


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that the links reach, for every id that has a link."""
    both = checkpointed(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    label = checkpointed(both.groupBy(F.col("a").alias("id")).agg(
        F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = (both.join(label, F.col("b") == F.col("id")).groupBy(F.col("a").alias("id"))
                .agg(F.min("label").alias("near")))
        lower = label.join(near, "id").select("id", "label", F.least("label", "near").alias("low"))
        # jump: the label of the label, which is itself an id with links
        up = label.select(F.col("id").alias("low"), F.col("label").alias("jump"))
        new = checkpointed(lower.join(up, "low").select("id", "label", F.least("low", "jump").alias("low")))
        if new.where("low <> label").isEmpty():
            return label.withColumnRenamed("label", "component")
        label = new.select("id", F.col("low").alias("label"))


def _called(groups: DataFrame, classes: DataFrame) -> DataFrame:
    """``groups`` with components called by their smallest given id, where they have one."""
    if classes.where("not given").isEmpty():
        return groups
    known = groups.join(classes.select(F.col("rep").alias("id"), "given"), "id")
    names = known.groupBy("component").agg(
        F.coalesce(F.min(F.when(F.col("given"), F.col("id"))), F.min("id")).alias("name"))
    return groups.join(names, "component").select("id", F.col("name").alias("component"))


def _decided(docs: DataFrame, percent: int) -> DataFrame:
    """(key, doc_id, n_shingles, component_id, kept) of every row."""
    spark, docs = docs.sparkSession, _keyed(docs)
    path = new_table_path(spark, "sketches")
    sketches(docs).write.parquet(path)
    every = spark.read.parquet(path)
    path = new_table_path(spark, "classes")
    rep = F.coalesce(F.min(F.when(F.col("given"), F.col("doc_id"))), F.min("doc_id"))
    (every.where("n > 0").groupBy("digest")
     .agg(rep.alias("rep"), F.max("given").alias("given"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
     .write.parquet(path))
    classes = spark.read.parquet(path)
    pairs = checkpointed(star_pairs(classes.select("rep", "n", "sketch"), percent))
    groups = _called(components(checkpointed(links(docs, pairs, percent))), classes)
    of_class = (classes.select("digest", "rep").join(groups, F.col("rep") == F.col("id"), "left")
                .select("digest", F.coalesce("component", "rep").alias("component")))
    given = F.when(F.col("given"), F.col("doc_id"))
    return (every.select("doc_id", "given", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest"))
            .join(of_class, "digest", "left")
            .select(F.col("doc_id").alias("key"), given.alias("doc_id"), F.col("n").alias("n_shingles"),
                    F.coalesce("component", given).alias("component_id"),
                    F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept")))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; a link is a similarity of ``percent`` or more."""
    return _decided(docs, percent).drop("key")


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents that are kept, all columns as they are; of repeated rows one stays.

    Rows without an id go by their text: of each text that is kept one row stays.
    """
    found = checkpointed(_decided(docs, percent))
    gone = found.where(~F.col("kept")).select(F.col("key").alias("llm_id")).distinct()
    again = (found.where("kept and n_shingles > 0").groupBy(F.col("key").alias("llm_id"))
             .agg(F.count(F.lit(1)).alias("llm_n")).where("llm_n > 1").select("llm_id"))
    once = docs.join(gone.union(again), _key() == F.col("llm_id"), "left_anti")
    if again.isEmpty():
        return once
    twice = (docs.withColumn("llm_key", _key()).join(again, F.col("llm_key") == F.col("llm_id"), "left_semi")
             .dropDuplicates(["llm_key"]).drop("llm_key"))
    return once.unionByName(twice)
