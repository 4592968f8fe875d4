"""Whole-number vectors in blocks, shared by the searches over ``embeddings``.

A row takes part if it has an id and a vector without null or non-finite
components.  Each component x becomes floor(256 * x).  Vectors of different
lengths meet as if the shorter one ended in zeros; the empty vector scores 0 with
all.  Vectors whose squared length reaches 2^62 take no part, as their scores may
not fit a long.  Rows that repeat an id together with its vector (and label) count
once; rows that share an id only are all candidates, and each is a query of its own.

Rows are dealt into cells by their nearest centre, and a cell into blocks of
bounded size by a hash of the id, so a vector that very many rows share fills many
blocks.  Queries are dealt alike into groups.  A block or group is one row of a
table: its arrays, pickled.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkaudit.llm.common import checkpointed

SCALE = 256
#: Rows in a block, queries in a group (both on average), groups that meet a block in one task.
BLOCK_ROWS, GROUP_ROWS, GROUPS_AT_ONCE = 4096, 512, 16
#: Rows that centres are chosen from, and centres at most: both only steer how much is left out of a search.
SAMPLE_ROWS, MAX_CELLS = 2048, 256
#: Scores at once inside a task.
TILE_ROWS = 128
NOTHING = np.iinfo(np.int64).min
_TOO_LONG = 2.0**62


def whole_numbers(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, vec): rows that take part, components as little-endian int32."""
    label = F.col("label").cast("long") if "label" in embeddings.columns else F.lit(None).cast("long")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"),
                             F.col("embedding").cast("array<double>").alias("embedding"))

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column(2)
            flat = vec.flatten()
            # a null list has no items of its own in flatten(); its length counts as 0
            size = np.nan_to_num(vec.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
            x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null: nan
            at = np.concatenate([[0], np.cumsum(size)])
            with np.errstate(all="ignore"):
                q = np.floor(x * SCALE)
                bad = np.concatenate([[0], np.cumsum(~np.isfinite(x) | ~np.isfinite(q))])
                length = np.concatenate([[0.0], np.cumsum(np.where(np.abs(q) < 2.0**31, q, 0.0) ** 2)])
                huge = np.concatenate([[0], np.cumsum(np.abs(q) >= 2.0**31)])
            keep = (vec.is_valid().to_numpy(zero_copy_only=False) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
                    & (bad[at[1:]] == bad[at[:-1]]) & (huge[at[1:]] == huge[at[:-1]]) & (length[at[1:]] - length[at[:-1]] < _TOO_LONG))
            q = np.where(np.isfinite(q) & (np.abs(q) < 2.0**31), q, 0).astype("<i4").tobytes()
            kept = np.flatnonzero(keep)
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column(0).take(kept), "label": batch.column(1).take(kept),
                "vec": pa.array([q[4 * a:4 * b] for a, b in zip(at[:-1][kept], at[1:][kept], strict=True)], pa.binary())})

    return rows.mapInArrow(convert, "vec_id long, label long, vec binary")


def matrix(vecs: list[bytes]) -> np.ndarray:
    """Rows of whole numbers as float64, the shorter ones ended by zeros."""
    width = max((len(v) // 4 for v in vecs), default=0)
    if vecs and all(len(v) == 4 * width for v in vecs):
        return np.frombuffer(b"".join(vecs), "<i4").reshape(len(vecs), width).astype(np.float64)
    out = np.zeros((len(vecs), width))
    for k, v in enumerate(vecs):
        out[k, :len(v) // 4] = np.frombuffer(v, "<i4")
    return out


def widened(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both matrices with the columns of the wider one."""
    width = max(a.shape[1], b.shape[1])
    return tuple(x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows, as int64."""
    top = np.sqrt((a**2).sum(1).max(initial=0) * (b**2).sum(1).max(initial=0))
    if top < 2.0**51:  # every partial sum is below 2^53 by Cauchy-Schwarz
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * (a @ b.T), 0))


def keep_best(scores: np.ndarray, ids: np.ndarray, found: np.ndarray, own: np.ndarray, ok: np.ndarray) -> None:
    """Put what beats the worst of ``scores`` (rows x k, best first, ties by smaller id) into ``scores`` and ``ids``."""
    k = scores.shape[1]
    r, c = np.nonzero(ok & ((found > scores[:, -1:]) | ((found == scores[:, -1:]) & (own[None] < ids[:, -1:]))))
    if not len(r):
        return
    touched = np.unique(r)
    row = np.concatenate([r, np.repeat(touched, k)])
    score = np.concatenate([found[r, c], scores[touched].ravel()])
    num = np.concatenate([own[c], ids[touched].ravel()])
    order = np.lexsort((num, -score.astype(np.float64), row)) if abs(score[score != NOTHING]).max(initial=0) < 2**53 else \
        np.array(sorted(range(len(row)), key=lambda i: (row[i], -int(score[i]), num[i])))
    row, score, num = row[order], score[order], num[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    top = rank < k
    scores[row[top], rank[top]], ids[row[top], rank[top]] = score[top], num[top]


def sample(rows: DataFrame, size: int = SAMPLE_ROWS) -> np.ndarray:
    """About ``size`` vectors, chosen by a hash of the id."""
    n = rows.select("vec_id").count()
    some = rows.select("vec_id", "vec").where(F.pmod(F.xxhash64("vec_id"), F.lit(max(n, 1))) < size).limit(2 * size).collect()
    return matrix([r.vec for r in sorted(some, key=lambda r: (r.vec_id, r.vec))])


def farthest_first(points: np.ndarray, k: int) -> np.ndarray:
    """Numbers of ``k`` points at most, each the farthest from those before: every prefix is a separated cover."""
    if not len(points):
        return np.zeros(0, np.int64)
    chosen, away = [0], np.full(len(points), np.inf)
    while len(chosen) < min(k, len(points)):
        away = np.minimum(away, distances(points, points[chosen[-1]][None])[:, 0])
        i = int(away.argmax())
        if away[i] <= 0:
            break
        chosen.append(i)
    return np.array(chosen)


def dealt(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """``rows`` with the nearest centre's number, the distance from it and the squared length."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, c = widened(matrix(batch.column(2).to_pylist()), centres)
                away = distances(x, c)
                cell = away.argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cell, pa.int64()), pa.array(away[np.arange(len(x)), cell]), pa.array((x**2).sum(1))],
                    names=[*batch.schema.names, "cell", "away", "len2"])

    return rows.mapInArrow(deal, "vec_id long, label long, vec binary, cell long, away double, len2 double")


_BLOCK = "block string, cell long, part long, n long, body binary"


def packed(cells: DataFrame, sizes: dict[int, int], target: int, index: Callable[[np.ndarray], dict]) -> DataFrame:
    """One row for each block of about ``target`` rows of a cell; ``body``: ids, labels, vectors and what ``index`` adds."""
    parts = F.create_map(*[F.lit(x).cast("long") for c, n in sorted(sizes.items()) for x in (c, parts_of(n, target))]) if sizes else None
    if parts is None:
        return cells.sparkSession.createDataFrame([], _BLOCK)
    rows = cells.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.element_at(parts, F.col("cell"))))

    def pack(table: pa.Table) -> pa.Table:
        table = table.select(["vec_id", "label", "vec", "cell", "part"])
        seen = {}
        for r in zip(*(table.column(c).to_pylist() for c in ("vec_id", "label", "vec")), strict=True):
            seen.setdefault(r)
        got = sorted(seen, key=lambda r: (r[0], r[2], r[1] is None, r[1] or 0))
        vecs = matrix([r[2] for r in got])
        extra = index(vecs)
        order = extra.pop("order", np.arange(len(got)))
        body = {"ids": np.array([r[0] for r in got], np.int64)[order], "vecs": vecs[order].astype(np.int32),
                "labels": np.array([NOTHING if r[1] is None else r[1] for r in got], np.int64)[order],
                "twin": np.array([int.from_bytes(hashlib.blake2b(r[2], digest_size=8).digest(), "little", signed=True) for r in got],
                                 np.int64)[order], **extra}
        cell, part = table.column("cell")[0].as_py(), table.column("part")[0].as_py()
        return pa.table({"block": [f"{cell}/{part}"], "cell": pa.array([cell], pa.int64()), "part": pa.array([part], pa.int64()),
                         "n": pa.array([len(got)], pa.int64()), "body": pa.array([pickle.dumps(body)], pa.binary())})

    return checkpointed(rows.groupBy("cell", "part").applyInArrow(pack, _BLOCK))


def parts_of(rows: int, target: int) -> int:
    """Blocks, of about ``target`` rows each, that a cell is dealt into."""
    return max(1, -(-rows // target))


def met(pairs: DataFrame, groups: DataFrame, n_groups: int, blocks: DataFrame, scan: Callable, schema: str) -> DataFrame:
    """``scan(group rows, block body)`` for every block, some of the ``n_groups`` groups at a time.

    ``pairs``: (grp, block).  A block that many groups need goes to several tasks;
    each holds one block and the groups dealt to it, both of bounded size.
    """
    turns = parts_of(n_groups, GROUPS_AT_ONCE)
    pairs = checkpointed(pairs.select("grp", "block", F.pmod(F.xxhash64("grp"), F.lit(turns)).alias("turn")))
    left = pairs.join(groups, "grp")
    right = (pairs.select(F.col("block").alias("to_block"), F.col("turn").alias("to_turn")).distinct()
             .join(blocks.select(F.col("block").alias("to_block"), F.col("body").alias("block_body")), "to_block"))

    def both(a: pa.Table, b: pa.Table) -> pa.Table:
        return scan(a, pickle.loads(b.column("block_body")[0].as_py()))

    return left.groupBy("block", "turn").cogroup(right.groupBy("to_block", "to_turn")).applyInArrow(both, schema)
