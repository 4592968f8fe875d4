"""Hard negatives: near rows of another label, found in a GNAT-style multiway hyperplane tree.

A node of the tree has several split points; its points go to the nearest one, so
the pieces are bounded by hyperplanes.  For every split point and every sibling
subtree the node stores the range of distances between them.  A query looks for
scores in a window.  With the lengths of a subtree's points, a window of inner
products is an annulus of distances around the query: by the triangle inequality,
the ranges say which distances from the query the subtree can hold, and a subtree
whose range does not meet the annulus is eliminated.  Leaves are multiplied out
exactly.

The upper node is built on Spark: its split points come from a bounded sample in
farthest-first order, all rows are dealt to the nearest one, and the table of
ranges is a minimum and maximum over all rows.  Each of its subtrees is dealt into
blocks of bounded size, and every block holds a tree of its own.

Positives are searched first: the window is open above and begins at the k-th score
that a group of anchors meets in one block of its own subtree.  Each positive's
score then gives the window of its negatives.

``vectors`` states which rows take part and what holds for nulls, repeated rows,
ties and vectors of different lengths; rows without a label take no part either.
An empty table has no anchors; an anchor without positives has no negatives.
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
    matrix,
    met,
    packed,
    parts_of,
    products,
    sample,
    whole_numbers,
    widened,
)

#: Points of a leaf at most (unless they are equal), split points of a node at most.
LEAF, FAN = 512, 8
NO_END = np.iinfo(np.int64).max
#: Rows that ranges of one subtree are merged in, before the last merge.
MERGES = 32


def gnat(x: np.ndarray, leaf: int = LEAF) -> dict:
    """Tree over the rows of ``x``: ``order`` puts each node's points into one range; node 0 is the root.

    ``nodes``: first, last point, first child, children.  ``splits[node]``: places of the split
    points; ``low``/``high[node]``: ranges of distances, split point by child; ``lengths[node]``:
    least and greatest squared length of each child's points.
    """
    order = np.arange(len(x))
    squared = (x**2).sum(1)
    nodes, splits, low, high, lengths = [[0, len(x), 0, 0]], {}, {}, {}, {}
    work = [0]
    while work:
        me = work.pop()
        a, b = nodes[me][:2]
        if b - a <= leaf:
            continue
        points = x[order[a:b]]
        chosen = farthest_first(points, FAN)
        if len(chosen) < 2:
            continue
        away = distances(points, points[chosen])
        near = away.argmin(1)
        near[chosen] = np.arange(len(chosen))
        by_child = np.argsort(near, kind="stable")
        place = np.empty(len(points), np.int64)
        place[by_child] = np.arange(len(points))
        order[a:b] = order[a:b][by_child]
        cuts = np.concatenate([[0], np.cumsum(np.bincount(near, minlength=len(chosen)))])
        away = away[by_child]
        splits[me] = a + place[chosen]
        low[me] = np.minimum.reduceat(away, cuts[:-1], axis=0).T
        high[me] = np.maximum.reduceat(away, cuts[:-1], axis=0).T
        long = squared[order[a:b]]
        lengths[me] = np.array([np.minimum.reduceat(long, cuts[:-1]), np.maximum.reduceat(long, cuts[:-1])])
        nodes[me][2:] = [len(nodes), len(chosen)]
        for c, d in zip(cuts[:-1], cuts[1:], strict=True):
            work.append(len(nodes))
            nodes.append([a + int(c), a + int(d), 0, 0])
        # the order below a child changes: its split point is looked up by what it is
        splits[me] = order[splits[me]]
    where = np.empty(len(x), np.int64)
    where[order] = np.arange(len(x))
    return {"order": order, "nodes": np.array(nodes), "splits": {k: where[v] for k, v in splits.items()},
            "low": low, "high": high, "lengths": lengths}


def meets(away: np.ndarray, low: np.ndarray, high: np.ndarray, lengths: np.ndarray, own2: np.ndarray,
          window_low: np.ndarray, window_high: np.ndarray) -> np.ndarray:
    """Queries x subtrees: can a subtree hold a score in one of the query's windows?

    ``away``: queries x split points; ``low``, ``high``: split points x subtrees; windows: queries x windows.
    """
    slack = 1e-9 * (away.max(initial=0) + high.max(initial=0)) + 1e-6
    least = np.zeros((len(away), low.shape[1]))
    most = np.full((len(away), low.shape[1]), np.inf)
    for i in range(away.shape[1]):
        d = away[:, i:i + 1]
        least = np.maximum(least, np.maximum(d - high[i], low[i] - d) - slack)
        most = np.minimum(most, d + high[i] + slack)
    top = (own2[:, None] + lengths[1] - least**2) / 2
    bottom = (own2[:, None] + lengths[0] - most**2) / 2
    guard = 1e-9 * (own2[:, None] + lengths[1] + np.minimum(most, 1e300) ** 2) + 1e-3
    hit = np.zeros(top.shape, bool)
    for w in range(window_low.shape[1]):
        lo, hi = window_low[:, w:w + 1].astype(float), window_high[:, w:w + 1].astype(float)
        hit |= (lo <= hi) & (top + guard >= lo) & (bottom - guard <= hi)
    return hit


def search(queries: dict, data: dict, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """(queries x windows x k) scores and ids of a block's rows inside each window, best first, NOTHING where there are fewer.

    ``same``: rows of the query's label, else rows of other labels; never rows with the query's id.
    """
    q, x = widened(queries["vecs"].astype(np.float64), data["vecs"].astype(np.float64))
    n, windows = low.shape
    scores, ids = np.full((windows, n, k), NOTHING), np.full((windows, n, k), NO_END)
    own2 = (q**2).sum(1)
    work = [(0, np.arange(n))] if n and len(x) else []
    while work:
        node, who = work.pop()
        first, last, child, kids = data["nodes"][node]
        if kids:
            need = np.maximum(low[who], scores[:, who, -1].T)  # a full list's worst row must be reached
            away = distances(q[who], x[data["splits"][node]])
            hit = meets(away, data["low"][node], data["high"][node], data["lengths"][node], own2[who], need, high[who])
            for j in np.argsort(-away.mean(0)):  # the nearest is taken first
                if hit[:, j].any():
                    work.append((child + j, who[hit[:, j]]))
            continue
        found = products(q[who], x[first:last])
        own, labels = data["ids"][first:last], data["labels"][first:last]
        alike = labels[None] == queries["labels"][who][:, None]
        right = (alike if same else ~alike) & (own[None] != queries["ids"][who][:, None])
        for w in range(windows):
            ok = right & (found >= low[who, w][:, None]) & (found <= high[who, w][:, None])
            s, i = scores[w, who], ids[w, who]
            keep_best(s, i, found, own, ok)
            scores[w, who], ids[w, who] = s, i
    return scores.transpose(1, 0, 2), ids.transpose(1, 0, 2)


class _Upper:
    """The upper node: split points, ranges over all rows, rows and queries of each subtree."""

    def __init__(self, rows: DataFrame, is_query: Column, block_rows: int):
        points = sample(rows)
        n = min(MAX_CELLS, parts_of(rows.count(), block_rows))
        self.splits = points[farthest_first(points, n)] if len(points) else np.zeros((1, points.shape[1]))
        self.cells = dealt(rows, self.splits)
        got = {r.cell: r for r in _ranges(self.cells.withColumn("ask", F.coalesce(is_query, F.lit(False))), self.splits).collect()}
        self.keys = sorted(got)
        self.n = {c: r.n for c, r in got.items()}
        self.queries = {c: r.queries for c, r in got.items()}
        self.low, self.high = (np.array([np.frombuffer(getattr(got[c], f)) for c in self.keys]).T for f in ("low", "high"))
        self.lengths = np.array([[got[c].least for c in self.keys], [got[c].most for c in self.keys]])


_RANGES = "cell long, n long, queries long, low binary, high binary, least double, most double"


def _ranges(cells: DataFrame, splits: np.ndarray) -> DataFrame:
    """For each subtree: rows, queries, ranges of distances from all split points, least and greatest squared length."""
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[int, list] = {}
        for batch in batches:
            col = {c: batch.column(batch.schema.get_field_index(c)) for c in ("vec", "cell", "len2", "ask")}
            x, s = widened(matrix(col["vec"].to_pylist()), splits)
            away = distances(x, s)
            cell, len2, ask = (col[c].to_numpy(zero_copy_only=False) for c in ("cell", "len2", "ask"))
            for c in np.unique(cell):
                i = cell == c
                _merge(acc, int(c), [int(i.sum()), int(ask[i].sum()), away[i].min(0), away[i].max(0), len2[i].min(), len2[i].max()])
        if acc:
            yield _range_rows(acc).to_batches()[0]

    def merged(table: pa.Table) -> pa.Table:
        acc: dict[int, list] = {}
        for r in table.to_pylist():
            _merge(acc, r["cell"], [r["n"], r["queries"], np.frombuffer(r["low"]), np.frombuffer(r["high"]), r["least"], r["most"]])
        return _range_rows(acc)

    some = cells.mapInArrow(over, _RANGES).withColumn("llm_merge", F.pmod(F.xxhash64("low", "high"), F.lit(MERGES)))
    fewer = some.groupBy("cell", "llm_merge").applyInArrow(merged, _RANGES)
    return fewer.groupBy("cell").applyInArrow(merged, _RANGES)


def _merge(acc: dict[int, list], cell: int, new: list) -> None:
    old = acc.get(cell)
    acc[cell] = new if old is None else [old[0] + new[0], old[1] + new[1], np.minimum(old[2], new[2]), np.maximum(old[3], new[3]),
                                         min(old[4], new[4]), max(old[5], new[5])]


def _range_rows(acc: dict[int, list]) -> pa.Table:
    v = list(acc.values())
    return pa.table({"cell": pa.array(list(acc), pa.int64()), "n": pa.array([r[0] for r in v], pa.int64()),
                     "queries": pa.array([r[1] for r in v], pa.int64()), "low": pa.array([r[2].tobytes() for r in v], pa.binary()),
                     "high": pa.array([r[3].tobytes() for r in v], pa.binary()), "least": pa.array([r[4] for r in v], pa.float64()),
                     "most": pa.array([r[5] for r in v], pa.float64())})


_FOUND = "grp string, query_id long, twin long, place long, window long, vec_id long, score long"
_GROUP = "grp string, body binary, low binary, high binary"


def _windows(g: dict, body: dict) -> tuple[np.ndarray, np.ndarray]:
    n = len(body["ids"])
    if g["low"] is None:
        return np.full((n, 1), NOTHING), np.full((n, 1), NO_END)
    return tuple(np.frombuffer(g[c], np.int64).reshape(n, -1) for c in ("low", "high"))


def _found(grp: str, body: dict, scores: np.ndarray, ids: np.ndarray) -> pa.Table:
    r, w, c = np.nonzero(scores != NOTHING)
    return pa.table({"grp": pa.array([grp] * len(r), pa.string()), "query_id": body["ids"][r], "twin": body["twin"][r], "place": r,
                     "window": w, "vec_id": ids[r, w, c], "score": scores[r, w, c]})


def _scan(table: pa.Table, block: dict, k: int, same: bool) -> pa.Table:
    out = []
    for g in table.to_pylist():
        body = pickle.loads(g["body"])
        out.append(_found(g["grp"], body, *search(body, block, *_windows(g, body), k, same)))
    return pa.concat_tables(out)


def _pairs(upper: _Upper, groups: DataFrame, blocks: DataFrame) -> DataFrame:
    """(grp, block): blocks of the subtrees that the upper node can't eliminate for all of a group's windows."""
    splits, low, high, lengths, keys = upper.splits, upper.low, upper.high, upper.lengths, upper.keys

    def reachable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g in batch.to_pylist():
                body = pickle.loads(g["body"])
                q, s = widened(body["vecs"].astype(np.float64), splits)
                hit = meets(distances(q, s), low, high, lengths, (q**2).sum(1), *_windows(g, body)).any(0)
                cell = [keys[j] for j in np.flatnonzero(hit)]
                yield pa.RecordBatch.from_pydict({"grp": pa.array([g["grp"]] * len(cell), pa.string()), "cell": pa.array(cell, pa.int64())})

    return groups.mapInArrow(reachable, "grp string, cell long").join(blocks.select("cell", "block"), "cell").select("grp", "block")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "twin", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low_percent: int = 50,
                   high_percent: int = 95, block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS, leaf: int = LEAF) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows``: vec_id, embedding, label.  An anchor's positives are its best rows of the same label; a
    positive's negatives the best rows of other labels that score from ``low_percent`` to
    ``high_percent`` percent of the positive's score.
    """
    rows = whole_numbers(rows.where("label is not null"))
    upper = _Upper(rows, is_anchor, block_rows)
    spark = rows.sparkSession
    if not upper.keys:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    blocks = packed(upper.cells, upper.n, block_rows, partial(gnat, leaf=leaf))
    groups = packed(upper.cells.where(is_anchor), upper.queries, group_rows, lambda x: {})
    n_groups = sum(parts_of(n, group_rows) for n in upper.queries.values())
    none = F.lit(None).cast("binary")
    bare = groups.select(F.col("block").alias("grp"), "cell", "part", "body", none.alias("low"), none.alias("high"))

    # one block of the own subtree says what a positive must reach
    parts = F.create_map(*[F.lit(x).cast("long") for c, n in sorted(upper.n.items()) for x in (c, parts_of(n, block_rows))])
    seeds = bare.withColumn("part", F.col("part") % F.element_at(parts, F.col("cell"))).select("grp", "cell", "part").join(
        blocks.select("cell", "part", "block"), ["cell", "part"]).select("grp", "block")

    def first(table: pa.Table, block: dict) -> pa.Table:
        got = table.to_pylist()
        for g in got:
            body = pickle.loads(g["body"])
            scores, _ = search(body, block, *_windows(g, body), positives, same=True)
            g["low"], g["high"] = scores[:, :, -1].tobytes(), np.full(scores.shape[:2], NO_END).tobytes()
        return pa.Table.from_pylist([{c: g[c] for c in ("grp", "body", "low", "high")} for g in got],
                                    pa.schema([("grp", pa.string()), ("body", pa.binary()), ("low", pa.binary()), ("high", pa.binary())]))

    bare = bare.select("grp", "body", "low", "high")
    seeded = checkpointed(met(seeds, bare, n_groups, blocks, first, _GROUP).unionByName(bare.join(seeds, "grp", "left_anti")))
    found = met(_pairs(upper, seeded, blocks), seeded, n_groups, blocks, partial(_scan, k=positives, same=True), _FOUND)
    best = checkpointed(_best(found, positives).select(
        "grp", "query_id", "twin", "place", F.col("rank").cast("long").alias("number"), F.col("vec_id").alias("positive_id"),
        F.col("score").alias("positive_score")))

    def windows(a: pa.Table, b: pa.Table) -> pa.Table:
        g = a.to_pylist()[0]
        n = len(pickle.loads(g["body"])["ids"])
        low, high = np.ones((n, positives), np.int64), np.zeros((n, positives), np.int64)  # no positive: an empty window
        place, number, score = (b.column(c).to_numpy() for c in ("place", "number", "positive_score"))
        low[place, number - 1], high[place, number - 1] = -share(-score, low_percent), share(score, high_percent)
        return pa.table({"grp": [g["grp"]], "body": pa.array([g["body"]], pa.binary()), "low": pa.array([low.tobytes()], pa.binary()),
                         "high": pa.array([high.tobytes()], pa.binary())})

    asked = checkpointed(bare.groupBy("grp").cogroup(best.select(F.col("grp").alias("of_grp"), "place", "number", "positive_score")
                                                     .groupBy("of_grp")).applyInArrow(windows, _GROUP))
    found = met(_pairs(upper, asked, blocks), asked, n_groups, blocks, partial(_scan, k=negatives, same=False), _FOUND)
    chosen = _best(found, negatives).select("query_id", "twin", (F.col("window") + 1).alias("number"), "rank", "vec_id", "score")
    return chosen.join(best, ["query_id", "twin", "number"]).select(
        F.col("query_id").alias("anchor_id"), "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))


def share(score: np.ndarray, percent: int) -> np.ndarray:
    """floor(score * percent / 100) without overflow."""
    return score // 100 * percent + score % 100 * percent // 100
