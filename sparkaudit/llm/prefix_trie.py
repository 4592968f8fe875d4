"""Prefix trie of conversations, subtree figures by the Euler-tour technique.

Every conversation is a sequence of (role, text) turns.  A node of the trie is a
distinct sequence of first turns; the root is the empty one.  What a cache of
shared prefixes saves, and how many leaves lie below a node, are sums over the
node's subtree.  They are had from a tour of the trie:

1. Turns are put in order over range partitions (a conversation may span many)
   and every prefix gets a 128-bit sum of digests that depend on turn and depth.
   What runs on from one partition to the next is one row a partition.
2. Prefixes are grouped into nodes.  A node is named by its smallest member and
   its depth; children are toured in the order of their smallest members.
3. Each node has two arcs, enter and exit.  The arcs form one list: enter leads
   to the first child's enter (or the own exit), exit to the next sibling's
   enter (or the parent's exit).
4. The list is ranked in two levels.  Blocks of nodes, neighbours in (smallest
   member, depth), contract the stretches of the list that stay inside by pointer
   jumping on arrays.  The stretches that are left, a few a block, are ranked the
   same way: as one more block if their count allows it, else by pointer jumping
   as joins, a round for each doubling.
5. Leaves and savings of a subtree are the difference of the prefix sums at its
   exit and enter arcs.

Defined cases.  Rows without a conv_id belong to no conversation and are left out.
A null role or text counts as empty; a null turn comes first.  Turns with the same
number in one conversation are ordered by the SHA-256 of role and text; repeated
rows are further turns.  An empty table has no conversation, hence no root.
Further columns are ignored.  Texts are digested whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkaudit.llm.common import checkpointed

#: Nodes in a block, which one task holds as arrays.
BLOCK_NODES = 400_000
#: Stretches of the tour (seven numbers each) that one task ranks and that are broadcast; more are joined by key.
BLOCK_STRETCHES = 200_000
#: Ids that one row of an ends list holds as text.
CHUNK_IDS = 20_000
#: Longest prefix that a conversation takes from the head of its hundred.
MAX_SHARED = 5

# fixed values: increment and multipliers of the splitmix64 generator
_GOLDEN, _MIX_A, _MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shared_turns(conv_id: Column) -> Column:
    """How many first turns of its hundred's head a conversation takes."""
    return (F.crc32(conv_id.cast("string")) % (MAX_SHARED + 1)).cast("long")


def hundred(conv_id: Column) -> Column:
    return conv_id - conv_id % 100


def in_order(df: DataFrame, cols: list[str], partitions: int | None = None) -> DataFrame:
    """``df`` range-dealt and sorted by ``cols``, written once; ``llm_part`` numbers the partitions in that order."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
    return checkpointed(ordered.withColumn("llm_part", F.spark_partition_id()))


# -- 1. prefixes -------------------------------------------------------------

def turns_of(conversations: DataFrame) -> DataFrame:
    """One narrow row a turn: order, digests, code points of the text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    sha = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), sha.alias("sha"),
        F.char_length(text).cast("long").alias("n_chars"), F.monotonically_increasing_id().alias("uid"))
    return checkpointed(rows.withColumns({"a": F.xxhash64(F.lit(1), "sha"), "b": F.xxhash64(F.lit(2), "sha")}))


def with_shared_heads(turns: DataFrame) -> DataFrame:
    """Own turns (``own`` 1), preceded by the turns that a conversation takes from its hundred's head (``own`` 0).

    The head's first turns are at most five a conversation, found with a limit
    before the shuffle, so a head with very many turns stays spread out.
    """
    convs = turns.select("conv_id").distinct()
    by_turn = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "sha", "uid")
    heads = (turns.where("conv_id % 100 = 0").withColumn("pos", F.row_number().over(by_turn))
             .where(F.col("pos") <= MAX_SHARED).withColumnRenamed("conv_id", "head"))
    taken = (convs.select("conv_id", hundred(F.col("conv_id")).alias("head"), shared_turns(F.col("conv_id")).alias("h"))
             .join(heads, "head").where("pos <= h"))
    cols = ["conv_id", "own", "turn", "sha", "uid", "a", "b", "n_chars"]
    return turns.withColumn("own", F.lit(1)).select(cols).unionByName(taken.withColumn("own", F.lit(0)).select(cols))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


class _Walk:
    """State of a walk over turns in order: the conversation, its turns so far, the sums of its prefix."""

    def __init__(self, conv=None, shared=0, own=0, s1=0, s2=0):
        self.conv, self.shared, self.own, self.s1, self.s2 = conv, shared, own, s1, s2
        self.whole = True  # no conversation but this one so far

    def step(self, batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        col = {c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
               for c in ("conv_id", "own", "a", "b", "h")}
        conv, own = col["conv_id"], col["own"].astype(np.int64)
        n = len(conv)
        new = np.empty(n, bool)
        new[0] = self.conv is None or conv[0] != self.conv
        new[1:] = conv[1:] != conv[:-1]
        run = np.cumsum(new)
        run -= run[0]  # number of the conversation within the batch
        first = np.flatnonzero(np.concatenate([[True], new[1:]]))[run]
        carried = (run == 0) & (not new[0])

        def running(x, start):
            c = np.cumsum(x)
            return c - c[first] + x[first] + np.where(carried, start, x.dtype.type(0))

        n_shared, n_own = running(1 - own, np.int64(self.shared)), running(own, np.int64(self.own))
        h = col["h"].astype(np.int64)
        counts = (own == 0) | (n_own > h)
        depth = n_shared + np.maximum(n_own - h, 0)
        with np.errstate(over="ignore"):
            salt = depth.astype(np.uint64) * _GOLDEN
            x1, x2 = (np.where(counts, _mix(col[c].astype(np.int64).view(np.uint64) + salt), np.uint64(0)) for c in "ab")
            s1, s2 = running(x1, np.uint64(self.s1)), running(x2, np.uint64(self.s2))
        self.whole &= not new[0 if self.conv is not None else 1:].any()
        self.conv, self.shared, self.own = int(conv[-1]), int(n_shared[-1]), int(n_own[-1])
        self.s1, self.s2 = int(s1[-1]), int(s2[-1])
        return {"counts": counts, "depth": depth, "s1": s1, "s2": s2, "p1": s1 - x1, "p2": s2 - x2}


_ENDS = "llm_part int, conv_id long, whole boolean, n_shared long, n_own long, s1 string, s2 string"


def _run_on(rows: DataFrame, start: dict[int, tuple]) -> dict[int, tuple]:
    """State in which each partition begins, from one row a partition.

    ``start`` holds the counts of turns where they are known; the sums need them.
    """
    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = part = None
        for batch in batches:
            if batch.num_rows:
                if walk is None:
                    part = batch.column(batch.schema.get_field_index("llm_part"))[0].as_py()
                    walk = _Walk(*start[part][:3]) if part in start else _Walk()
                    walk.whole = True
                walk.step(batch)
        if walk is not None:
            yield pa.RecordBatch.from_pydict({
                "llm_part": pa.array([part], pa.int32()), "conv_id": [walk.conv], "whole": [walk.whole], "n_shared": [walk.shared],
                "n_own": [walk.own], "s1": [str(walk.s1)], "s2": [str(walk.s2)]})

    states, state = {}, None
    for r in sorted(rows.mapInArrow(last, _ENDS).collect(), key=lambda r: r.llm_part):
        if state is not None:
            states[r.llm_part] = state
        mine = (r.conv_id, r.n_shared, r.n_own, int(r.s1), int(r.s2))
        if state is not None and r.whole and state[0] == r.conv_id:
            counts = mine[1:3] if start else (state[1] + mine[1], state[2] + mine[2])
            mine = (r.conv_id, *counts, (state[3] + mine[3]) % 2**64, (state[4] + mine[4]) % 2**64)
        state = mine
    return states


_MEMBERS = "conv_id long, depth long, s1 long, s2 long, p1 long, p2 long, n_chars long"


def prefixes(turns: DataFrame) -> DataFrame:
    """(conversation, depth): the sums that name its prefix (s1, s2) and the next shorter one (p1, p2)."""
    cols = ["conv_id", "own", "turn", "sha", "uid"]
    rows = in_order(with_shared_heads(turns), cols)
    rows = rows.select("llm_part", "conv_id", "own", "a", "b", "n_chars", shared_turns(F.col("conv_id")).alias("h"))
    counted = _run_on(rows, {})
    start = _run_on(rows, counted) if counted else {}

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if state is None:
                state = _Walk(*start.get(batch.column(0)[0].as_py(), ()))
            got = state.step(batch)
            keep = got["counts"]
            yield pa.RecordBatch.from_pydict({
                "conv_id": batch.column(1).filter(pa.array(keep)), "depth": got["depth"][keep],
                **{c: got[c][keep].view(np.int64) for c in ("s1", "s2", "p1", "p2")},
                "n_chars": batch.column(5).filter(pa.array(keep))})

    return checkpointed(rows.mapInArrow(walk, _MEMBERS))


# -- 2. nodes and links ------------------------------------------------------

def nodes_of(members: DataFrame, convs: DataFrame) -> DataFrame:
    """One row a node: smallest member, members, the parent's sums, code points of the last text."""
    inner = members.groupBy("depth", "s1", "s2").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
        F.min("n_chars").alias("n_chars"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        zero.alias("depth"), zero.alias("s1"), zero.alias("s2"), "conv_id", "n_convs", none.alias("p1"), none.alias("p2"),
        zero.alias("n_chars"))
    return checkpointed(inner.unionByName(root))


def with_next_sibling(nodes: DataFrame) -> DataFrame:
    """Nodes with ``sibling``, the smallest member of the next child of the same parent."""
    family = ["depth", "p1", "p2", "conv_id"]
    rows = in_order(nodes, family).select("llm_part", *family, *[c for c in nodes.columns if c not in family])
    heads = {r[0]: tuple(r[1]) for r in rows.groupBy("llm_part").agg(F.min(F.struct(*family))).collect()}
    parts = sorted(heads)
    following = {p: heads[q] for p, q in zip(parts, parts[1:], strict=False)}

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
            held = table.slice(table.num_rows - 1)
            if table.num_rows > 1:
                yield paired(table.slice(0, table.num_rows - 1), table.slice(1))
        if held is not None:
            after = following.get(held.column(0)[0].as_py())
            row = None if after is None else pa.RecordBatch.from_arrays(
                [pa.array([v], pa.int64()) for v in (0, *after)], names=["llm_part", *family])
            yield paired(held, row)

    def paired(a: pa.RecordBatch, b: pa.RecordBatch | None) -> pa.RecordBatch:
        if b is None:
            sibling = pa.nulls(a.num_rows, pa.int64())
        else:
            x, y = (np.array([t.column(k).fill_null(0).to_numpy() for k in (1, 2, 3)]) for t in (a, b))
            same = (x == y).all(axis=0) & (x[0] > 0)
            sibling = pa.array(b.column(4).to_numpy(), pa.int64(), mask=~same)
        return pa.RecordBatch.from_arrays([*a.columns[1:], sibling], names=[*a.schema.names[1:], "sibling"])

    return rows.mapInArrow(link, _longs([*rows.columns[1:], "sibling"]))


def linked(nodes: DataFrame) -> DataFrame:
    """Nodes with their parent's and first child's smallest members, and how many children they have."""
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("s1"), F.col("p2").alias("s2")).agg(
        F.min("conv_id").alias("child"), F.count("*").alias("n_children"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("s1").alias("p1"), F.col("s2").alias("p2"),
                         F.col("conv_id").alias("parent"))
    return (with_next_sibling(nodes).join(above, ["depth", "p1", "p2"], "left").join(kids, ["depth", "s1", "s2"], "left")
            .select("conv_id", "depth", "s1", "s2", "parent", "child", "sibling", "n_convs", "n_chars",
                    F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children")))


# -- 3. to 5. the tour --------------------------------------------------------

_NONE = -1
_ARCS = ["rank", "leaves", "saved"]


def _block(batches: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
    t = pa.Table.from_batches(batches)
    return {c: t.column(c).to_numpy() if t.column(c).null_count == 0 else
            np.ma.MaskedArray(t.column(c).fill_null(0).to_numpy(), t.column(c).is_null().to_numpy()) for c in t.column_names}


def rank_block(v: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Arcs of a block's nodes (2 i enters node i, 2 i + 1 exits it), ranked along the stretches inside the block.

    ``top``: first arc of the arc's stretch; ``sums``: arcs, leaves and savings from there to the arc,
    included; ``to_conv``, ``to_code``: the next stretch's first arc, at arcs that leave the block.
    """
    conv, depth = np.asarray(v["conv_id"]), np.asarray(v["depth"])
    n = len(conv)
    missing = {c: np.ma.getmaskarray(np.ma.asarray(v[c])) for c in ("parent", "child", "sibling")}
    parent, child, sibling = (np.ma.asarray(v[c]).filled(0) for c in ("parent", "child", "sibling"))
    # the arc that follows: its node's name and side
    to_conv, to_code = np.zeros(2 * n, np.int64), np.full(2 * n, _NONE, np.int64)
    to_conv[0::2] = np.where(missing["child"], conv, child)
    to_code[0::2] = np.where(missing["child"], 2 * depth + 1, 2 * (depth + 1))
    to_conv[1::2] = np.where(missing["sibling"], parent, sibling)
    to_code[1::2] = np.where(missing["sibling"], np.where(missing["parent"], _NONE, 2 * (depth - 1) + 1), 2 * depth)
    # nodes with one smallest member have consecutive depths
    owners, start = np.unique(conv, return_index=True)
    size = np.diff(np.append(start, n))
    at = np.minimum(np.searchsorted(owners, to_conv), len(owners) - 1)
    off = (to_code >> 1) - depth[start[at]]
    here = (owners[at] == to_conv) & (to_code >= 0) & (off >= 0) & (off < size[at])
    following = np.where(here, 2 * (start[at] + off) + (to_code & 1), _NONE)
    before = np.full(2 * n, _NONE, np.int64)
    before[following[here]] = np.flatnonzero(here)
    sums = np.zeros((3, 2 * n), np.int64)
    sums[0] = 1
    sums[1, 0::2] = missing["child"]
    sums[2, 0::2] = (np.asarray(v["n_convs"]) - 1) * np.asarray(v["n_chars"])
    top = np.arange(2 * n)
    while (i := np.flatnonzero(before >= 0)).size:
        p = before[i]
        more, higher, further = sums[:, p], top[p], before[p]
        sums[:, i] += more
        top[i], before[i] = higher, further
    leaves = ~here
    return {"top": top, "sums": sums, "to_conv": to_conv, "to_code": to_code, "last": np.flatnonzero(leaves)}


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if got := [b for b in batches if b.num_rows]:
        v = _block(got)
        r = rank_block(v)
        first, last = r["top"][r["last"]], r["last"]
        end = r["to_code"][last] == _NONE
        yield pa.RecordBatch.from_pydict({
            "conv": np.asarray(v["conv_id"])[first >> 1], "code": 2 * np.asarray(v["depth"])[first >> 1] + (first & 1),
            "to_conv": pa.array(r["to_conv"][last], pa.int64(), mask=end), "to_code": pa.array(r["to_code"][last], pa.int64(), mask=end),
            **dict(zip(_ARCS, r["sums"][:, last], strict=True))})


def _arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if got := [b for b in batches if b.num_rows]:
        v = _block(got)
        r = rank_block(v)
        out = {c: np.asarray(v[c]) for c in ("conv_id", "depth", "s1", "s2", "n_convs", "n_children")}
        out["parent"] = pa.array(np.ma.asarray(v["parent"]).filled(0), pa.int64(), mask=np.ma.getmaskarray(np.ma.asarray(v["parent"])))
        for side, name in ((0, "enter"), (1, "exit")):
            first = r["top"][side::2]
            out[f"{name}_conv"] = np.asarray(v["conv_id"])[first >> 1]
            out[f"{name}_code"] = 2 * np.asarray(v["depth"])[first >> 1] + (first & 1)
            out |= {f"{name}_{c}": s for c, s in zip(_ARCS, r["sums"][:, side::2], strict=True)}
        # what stands before the enter arc: its own weights taken off again
        out["enter_leaves"] = out["enter_leaves"] - np.ma.getmaskarray(np.ma.asarray(v["child"]))
        out["enter_saved"] = out["enter_saved"] - (np.asarray(v["n_convs"]) - 1) * np.asarray(v["n_chars"])
        for k in range(0, len(out["conv_id"]), 20_000):
            yield pa.RecordBatch.from_pydict({c: x[k:k + 20_000] for c, x in out.items()})


def _to_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums from each of a block's stretches to the end of the tour."""
    if got := [b for b in batches if b.num_rows]:
        t = pa.Table.from_batches(got)
        names = np.rec.fromarrays([t.column(c).to_numpy() for c in ("conv", "code")])
        to = np.rec.fromarrays([t.column(c).fill_null(_NONE).to_numpy() for c in ("to_conv", "to_code")], dtype=names.dtype)
        order = np.argsort(names, order=("f0", "f1"))
        after = np.where(to.f1 == _NONE, _NONE, order[np.minimum(np.searchsorted(names[order], to), len(order) - 1)])
        sums = np.array([t.column(c).to_numpy() for c in _ARCS])
        while (i := np.flatnonzero(after >= 0)).size:
            p = after[i]
            more, further = sums[:, p], after[p]
            sums[:, i] += more
            after[i] = further
        yield pa.RecordBatch.from_pydict({"conv": t.column("conv").combine_chunks(), "code": t.column("code").combine_chunks(),
                                          **dict(zip(_ARCS, sums, strict=True))})


def ranked(stretches: DataFrame, one_block: bool) -> DataFrame:
    """Sums from each stretch to the end of the tour: in one task, or by joins, of which each doubles what a row covers."""
    if one_block:
        return stretches.coalesce(1).mapInArrow(_to_end, _longs(["conv", "code", *_ARCS]))
    cur = stretches
    while not (active := cur.where("to_conv is not null")).isEmpty():
        nxt = cur.select(F.col("conv").alias("to_conv"), F.col("code").alias("to_code"), F.col("to_conv").alias("then_conv"),
                         F.col("to_code").alias("then_code"), *[F.col(c).alias(f"{c}2") for c in _ARCS])
        cur = checkpointed(active.join(nxt, ["to_conv", "to_code"]).select(
            "conv", "code", F.col("then_conv").alias("to_conv"), F.col("then_code").alias("to_code"),
            *[(F.col(c) + F.col(f"{c}2")).alias(c) for c in _ARCS]).unionByName(cur.where("to_conv is null")))
    return cur.select("conv", "code", *_ARCS)


def _longs(cols: list[str]) -> str:
    return ", ".join(f"{c} long" for c in cols)


def toured(nodes: DataFrame, block_nodes: int = BLOCK_NODES, block_stretches: int = BLOCK_STRETCHES) -> DataFrame:
    """Nodes with the leaves and savings of their subtrees and the places of their arcs on the tour."""
    spark = nodes.sparkSession
    total = nodes.count()
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // block_nodes))
    rows = in_order(linked(nodes), ["conv_id", "depth"], min(blocks, max(1, total)))
    stretches = checkpointed(rows.mapInArrow(_stretches, _longs(["conv", "code", "to_conv", "to_code", *_ARCS])))
    small = stretches.count() <= block_stretches
    ends = ranked(stretches, small)
    schema = _longs(["conv_id", "depth", "s1", "s2", "n_convs", "n_children", "parent",
                    *[f"{s}_{c}" for s in ("enter", "exit") for c in ("conv", "code", *_ARCS)]])
    arcs = rows.mapInArrow(_arcs, schema)
    for side in ("enter", "exit"):
        own = ends.select(F.col("conv").alias(f"{side}_conv"), F.col("code").alias(f"{side}_code"),
                          *[F.col(c).alias(f"{side}_rest_{c}") for c in _ARCS])
        arcs = arcs.join(F.broadcast(own) if small else own, [f"{side}_conv", f"{side}_code"])
    # along the tour: total - rest(stretch) + sum inside the stretch
    place = {s: F.lit(2 * total) - F.col(f"{s}_rest_rank") + F.col(f"{s}_rank") - 1 for s in ("enter", "exit")}
    below = {c: F.col(f"exit_{c}") - F.col(f"exit_rest_{c}") - F.col(f"enter_{c}") + F.col(f"enter_rest_{c}") for c in ("leaves", "saved")}
    return arcs.select("conv_id", "depth", "s1", "s2", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
                       below["leaves"].alias("n_leaves"), below["saved"].alias("saved_tokens"),
                       place["enter"].alias("enter_place"), place["exit"].alias("exit_place"))


# -- members that end at a node -----------------------------------------------

def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids in order, joined to texts: a row for each node and at most CHUNK_IDS ids."""
    number = 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        part, depth, s1, s2, ids = (batch.column(k).to_numpy() for k in range(5))
        new = np.concatenate([[True], (depth[1:] != depth[:-1]) | (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])])
        cuts = np.unique(np.concatenate([np.flatnonzero(new), np.arange(0, n, CHUNK_IDS), [n]]))
        first = cuts[:-1]
        texts = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(first, cuts[1:], strict=True)]
        yield pa.RecordBatch.from_pydict({
            "depth": depth[first], "s1": s1[first], "s2": s2[first], "llm_part": part[first],
            "number": np.arange(number, number + len(first)), "ids": pa.array(texts, pa.string())})
        number += len(first)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's chunks in order, one after another."""
    node, sha = None, None
    for batch in batches:
        keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
        done = []
        for key, ids in zip(keys, batch.column(5).to_pylist(), strict=True):
            if key != node:
                if node is not None:
                    done.append((*node, sha.hexdigest()))
                node, sha = key, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if done:
            yield _digest_rows(done)
    if node is not None:
        yield _digest_rows([(*node, sha.hexdigest())])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    depth, s1, s2, sha = zip(*rows, strict=True)
    return pa.RecordBatch.from_pydict({"depth": pa.array(depth, pa.int64()), "s1": pa.array(s1, pa.int64()),
                                       "s2": pa.array(s2, pa.int64()), "ends_sha256": list(sha)})


def ends_of(members: DataFrame, convs: DataFrame) -> DataFrame:
    """Digest of the conversations that end at a node, ids ascending."""
    zero = F.lit(0).cast("long")
    last = members.groupBy("conv_id").agg(F.max("depth").alias("depth"), F.max_by(F.struct("s1", "s2"), "depth").alias("s"))
    ends = convs.join(last, "conv_id", "left").select(
        F.coalesce("depth", zero).alias("depth"), F.coalesce("s.s1", zero).alias("s1"), F.coalesce("s.s2", zero).alias("s2"), "conv_id")
    node = ["depth", "s1", "s2"]
    rows = in_order(ends, [*node, "conv_id"]).select("llm_part", *node, "conv_id")
    chunks = rows.mapInArrow(_chunks, "depth long, s1 long, s2 long, llm_part int, number long, ids string")
    return chunks.repartition(*node).sortWithinPartitions(*node, "llm_part", "number").mapInArrow(
        _digests, "depth long, s1 long, s2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, block_nodes: int = BLOCK_NODES, block_stretches: int = BLOCK_STRETCHES) -> DataFrame:
    """One row a node of the trie of rebuilt conversations (see the module): figures of the node and its subtree."""
    turns = turns_of(conversations)
    convs = turns.select("conv_id").distinct()
    members = prefixes(turns)
    nodes = nodes_of(members, convs)
    empty = hashlib.sha256(b"").hexdigest()
    return (toured(nodes, block_nodes, block_stretches).join(ends_of(members, convs), ["depth", "s1", "s2"], "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"), "enter_place", "exit_place"))


def shared_prefixes(trie: DataFrame, min_convs: int = 2) -> DataFrame:
    """Nodes that a prefix cache gains from: shared by ``min_convs`` conversations or more, the most saving first."""
    return trie.where(F.col("n_convs") >= min_convs).orderBy(F.desc("saved_tokens"), "depth", "conv_id")
