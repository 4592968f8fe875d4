"""Exact top-k by inner product: dual-tree search over cover trees.

Queries and data are indexed together.  The upper level is one cover of a bounded
sample: centres in farthest-first order, so that every prefix is a cover whose
points lie at least its covering radius apart; all rows, queries too, are dealt to
their nearest centre.  Below it every block of data and every group of queries has
a cover tree of its own: a node's children are centres in farthest-first order
(the node's own centre first), each with the points nearest to it and the radius
that covers them.

A pair of nodes is left out if no inner product between the two balls can reach
the worst k-th score among the group's queries:
max <q, x> <= <c, d> + r |d| + s |c| + r s, and also half of
|q|^2 + |x|^2 - max(0, |c - d| - r - s)^2 with the largest lengths of both sides.
A group first meets one block of its own cell, whose k-th scores are true lower
bounds; then every cell and block that the bounds can't leave out.  Pairs of
leaves are multiplied out exactly.

``vectors`` states which rows take part and what holds for nulls, repeated rows,
ties and vectors of different lengths; an empty table has no queries.  Fewer than
k candidates: all are returned.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkaudit.llm.common import checkpointed
from sparkaudit.llm.vectors import (
    BLOCK_ROWS,
    GROUP_ROWS,
    MAX_CELLS,
    NOTHING,
    dealt,
    distances,
    farthest_first,
    keep_best,
    met,
    packed,
    parts_of,
    products,
    sample,
    whole_numbers,
    widened,
)

#: Points of a leaf at most (unless they are equal), children of a node at most.
LEAF, FAN = 256, 8


def cover_tree(x: np.ndarray, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """Nodes over the rows of ``x``: ``order`` puts each node's points into one range.

    Node 0 is the root; ``first``/``last`` range of points, ``centre`` the place of the centre
    among the ordered points, ``radius`` its distance from the farthest point, ``child``/``kids``
    the first child and their number (0: leaf), ``length`` the longest point.
    """
    order = np.arange(len(x))
    long = np.sqrt((x**2).sum(1))
    nodes = []
    work = [0]
    nodes.append([0, len(x), 0.0, 0, 0])
    while work:
        me = work.pop()
        a, b = nodes[me][:2]
        points = x[order[a:b]]  # the first point is the centre
        away = distances(points, points[:1])[:, 0] if len(points) else np.zeros(0)
        nodes[me][2] = float(away.max(initial=0)) * (1 + 1e-9) + 1e-6
        if b - a <= leaf or away.max() <= 0:
            continue
        centres = farthest_first(points, FAN)
        near = distances(points, points[centres]).argmin(1)
        near[centres] = np.arange(len(centres))
        is_centre = np.ones(len(points), np.int64)
        is_centre[centres] = 0
        by_child = np.lexsort((is_centre, near))  # a child's centre comes first
        order[a:b] = order[a:b][by_child]
        nodes[me][3:] = [len(nodes), len(centres)]
        start = a
        for size in np.bincount(near, minlength=len(centres)):
            work.append(len(nodes))
            nodes.append([start, start + int(size), 0.0, 0, 0])
            start += int(size)
    first, last, radius, child, kids = (np.array(c) for c in zip(*nodes, strict=True))
    return {"order": order, "first": first, "last": last, "radius": radius.astype(float), "child": child, "kids": kids,
            "length": np.array([long[order[a:b]].max(initial=0) for a, b in zip(first, last, strict=True)])}


def reach(dots: np.ndarray, apart: np.ndarray, r, s, len_c, len_d, top_q, top_x) -> np.ndarray:
    """Upper bound of inner products between balls, rounded up."""
    ball = dots + r * len_d + s * len_c + r * s
    ring = (top_q**2 + top_x**2 - np.maximum(apart - r - s, 0) ** 2) / 2
    bound = np.minimum(np.minimum(ball, ring), top_q * top_x)
    return bound + np.abs(bound) * 1e-9 + 1e-3


class _Side:
    def __init__(self, body: dict):
        self.body, self.x = body, body["vecs"].astype(np.float64)
        self.first, self.last, self.radius, self.length = (body[c] for c in ("first", "last", "radius", "length"))

    def widen(self, other: _Side) -> None:
        self.x, other.x = widened(self.x, other.x)
        for side in (self, other):
            side.centre = side.x[np.minimum(side.first, max(len(side.x) - 1, 0))]
            side.centre_length = np.sqrt((side.centre**2).sum(1))


def dual_search(queries: dict, data: dict, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids, best first, of each query's k best rows of a block that reach ``floor``; NOTHING where there are fewer."""
    q, d = _Side(queries), _Side(data)
    q.widen(d)
    n = len(q.x)
    scores, ids = np.full((n, k), NOTHING), np.full((n, k), np.iinfo(np.int64).max)
    if not n or not len(d.x):
        return scores, ids

    def bounds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        c, e = q.centre[a], d.centre[b]
        return reach((c * e).sum(1), np.sqrt(((c - e) ** 2).sum(1)), q.radius[a], d.radius[b], q.centre_length[a],
                     d.centre_length[b], q.length[a], d.length[b])

    def worst(a: np.ndarray) -> np.ndarray:
        need = np.maximum(scores[:, -1], floor)
        low = {i: need[q.first[i]:q.last[i]].min() for i in np.unique(a)}
        return np.array([low[i] for i in a], np.float64)

    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    leaves = []
    while len(a):
        bound = bounds(a, b)
        on = bound >= worst(a)
        a, b, bound = a[on], b[on], bound[on]
        qk, dk = queries["kids"][a], data["kids"][b]
        done = (qk == 0) & (dk == 0)
        leaves += zip(bound[done], a[done], b[done], strict=True)
        a, b, qk, dk = (v[~done] for v in (a, b, qk, dk))
        split_q = (qk > 0) & ((dk == 0) | (q.radius[a] >= d.radius[b]))
        times = np.where(split_q, qk, dk)
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        ra, rb, rs = np.repeat(a, times), np.repeat(b, times), np.repeat(split_q, times)
        a = np.where(rs, queries["child"][ra] + nth, ra)
        b = np.where(rs, rb, data["child"][rb] + nth)
    for bound, i, j in sorted(leaves, key=lambda x: -x[0]):
        rows, cols = slice(q.first[i], q.last[i]), slice(d.first[j], d.last[j])
        if bound < np.maximum(scores[rows, -1], floor[rows]).min():
            continue
        found = products(q.x[rows], d.x[cols])
        own = data["ids"][cols]
        ok = (found >= floor[rows][:, None]) & (own[None] != queries["ids"][rows][:, None])
        keep_best(scores[rows], ids[rows], found, own, ok)
    return scores, ids


_FOUND = "query_id long, twin long, vec_id long, score long"
_GROUP = "grp string, seed string, body binary, floor binary"


def _found(queries: dict, scores: np.ndarray, ids: np.ndarray) -> pa.Table:
    r, c = np.nonzero(scores != NOTHING)
    return pa.table({"query_id": queries["ids"][r], "twin": queries["twin"][r], "vec_id": ids[r, c], "score": scores[r, c]})


def _floors(group: dict) -> tuple[dict, np.ndarray]:
    body = pickle.loads(group["body"])
    floor = np.full(len(body["ids"]), NOTHING) if group["floor"] is None else np.frombuffer(group["floor"], np.int64)
    return body, floor


def top_k(embeddings: DataFrame, is_query: Column, k: int = 5, block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS,
          leaf: int = LEAF) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` rows of the highest score, its own id left out."""
    rows = whole_numbers(embeddings)
    points = sample(rows)
    n_cells = min(MAX_CELLS, parts_of(rows.count(), block_rows))
    centres = points[farthest_first(points, n_cells)] if len(points) else np.zeros((1, points.shape[1]))
    cells = dealt(rows, centres)
    stats = {r.cell: r for r in cells.groupBy("cell").agg(
        F.count("*").alias("n"), F.sum(is_query.cast("long")).alias("queries"), F.max("away").alias("away"), F.max("len2").alias("len2")).collect()}
    if not stats:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    tree = partial(cover_tree, leaf=leaf)
    blocks = packed(cells, {c: r.n for c, r in stats.items()}, block_rows, tree)
    groups = packed(cells.where(is_query), {c: r.queries or 0 for c, r in stats.items()}, group_rows, tree)
    n_groups = sum(parts_of(r.queries or 0, group_rows) for r in stats.values())
    bare = groups.select(F.col("block").alias("grp"), "cell", "part", "body", F.lit(None).cast("binary").alias("floor"))

    # one block of the own cell first: its k-th scores are what other blocks must reach
    parts = F.create_map(*[F.lit(x).cast("long") for c, r in sorted(stats.items()) for x in (c, parts_of(r.n, block_rows))])
    seeds = bare.withColumn("part", F.col("part") % F.element_at(parts, F.col("cell"))).select("grp", "cell", "part").join(
        blocks.select("cell", "part", "block"), ["cell", "part"]).select("grp", "block")

    def first(table: pa.Table, block: dict) -> pa.Table:
        out = []
        for g in table.to_pylist():
            body, floor = _floors(g)
            out.append((g, *dual_search(body, block, floor, k), body))
        return pa.table({
            "grp": [g["grp"] for g, *_ in out], "seed": [g["block"] for g, *_ in out],
            "body": pa.array([g["body"] for g, *_ in out], pa.binary()),
            "floor": pa.array([s[:, -1].tobytes() for _, s, _, _ in out], pa.binary()),
            "found": pa.array([pickle.dumps((s, i)) for _, s, i, _ in out], pa.binary())})

    bare = bare.select("grp", "body", "floor")
    began = met(seeds, bare, n_groups, blocks, first, _GROUP + ", found binary")
    # a part that no row was dealt to is no block: its groups begin without a floor
    seeded = checkpointed(began.unionByName(bare.join(seeds, "grp", "left_anti"), allowMissingColumns=True))

    width, keys = centres.shape[1], sorted(stats)
    mid = np.array([centres[c] for c in keys]).reshape(len(keys), width)
    away, far = (np.array([getattr(stats[c], f) for c in keys], float) for f in ("away", "len2"))
    away, far = away * (1 + 1e-9) + 1e-6, np.sqrt(far)

    def reachable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g in batch.to_pylist():
                body, floor = _floors(g)
                q, c = widened(body["vecs"].astype(np.float64), mid)
                long = np.sqrt((q**2).sum(1))
                bound = reach(q @ c.T, distances(q, c), 0.0, away[None], long[:, None], np.sqrt((c**2).sum(1))[None],
                              long[:, None], far[None])
                cell = np.flatnonzero((bound >= floor[:, None].astype(np.float64)).any(0))
                yield pa.RecordBatch.from_pydict({"grp": pa.array([g["grp"]] * len(cell), pa.string()),
                                                  "seed": pa.array([g["seed"]] * len(cell), pa.string()),
                                                  "cell": pa.array([keys[i] for i in cell], pa.int64())})

    pairs = (seeded.select("grp", "seed", "body", "floor").mapInArrow(reachable, "grp string, seed string, cell long")
             .join(blocks.select("cell", "block"), "cell").where("not block <=> seed"))

    def rest(table: pa.Table, block: dict) -> pa.Table:
        out = [pa.Table.from_pydict({c: pa.array([], pa.int64()) for c in ("query_id", "twin", "vec_id", "score")})]
        for g in table.to_pylist():
            body, floor = _floors(g)
            out.append(_found(body, *dual_search(body, block, floor, k)))
        return pa.concat_tables(out)

    def seeds_found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g in batch.filter(batch.column(1).is_valid()).to_pylist():
                yield from _found(pickle.loads(g["body"]), *pickle.loads(g["found"])).to_batches()

    others = met(pairs, seeded.select("grp", "body", "floor"), n_groups, blocks, rest, _FOUND)
    found = seeded.select("body", "found").mapInArrow(seeds_found, _FOUND).unionByName(others)
    best = Window.partitionBy("query_id", "twin").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
