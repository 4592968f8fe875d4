"""Token counts by rank-synchronous merging of ragged arrays.

Texts are cut into pre-tokens (a run of spaces with what follows it up to the
next space: no piece of the vocabulary crosses such a bound, which the loader
checks).  Pre-tokens not met before are held as one ragged array of symbol ids;
each round finds every sequence's lowest-rank adjacent pair (leftmost among
equals), merges all of these at once, and drops sequences without a pair.  The
symbols that survive are counted; one outside the vocabulary counts as its
UTF-8 bytes.  A very long pre-token (text without spaces) takes the same merges
in the same order from a heap instead.

Defined cases: null and empty texts have no tokens; repeated rows get equal
counts; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
_CUT = re.compile(" +[^ ]*|[^ ]+")
#: Pre-tokens remembered by a Python worker, over all of its tasks, before it starts anew.
CACHE = 600_000
LIMIT = 4096


class Merges:
    """Symbols and merge ranks of a SentencePiece BPE model."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.vocab = {p for p, _ in pieces}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.vocab):
            raise ValueError("a piece holds a space after another character: texts can't be cut at spaces")
        scores = {s: i for i, s in enumerate(sorted({s for _, s in pieces}, reverse=True))}
        rank = {p: scores[s] for p, s in pieces}
        names = sorted(self.vocab | {c for p in self.vocab for c in p})
        self.ids = {s: i for i, s in enumerate(names)}
        self.cost = [1 if s in self.vocab else len(s.encode()) for s in names]
        found = {}
        for piece, r in rank.items():
            for i in range(1, len(piece)):
                left, right = self.ids.get(piece[:i]), self.ids.get(piece[i:])
                if left is not None and right is not None:
                    found[left << 32 | right] = (r, self.ids[piece])
        self.found = found
        keys = np.array(sorted(found), np.int64)
        self.keys = np.append(keys, np.iinfo(np.int64).max)
        self.ranks = np.array([found[k][0] for k in keys.tolist()] + [NONE], np.int64)
        self.made = np.array([found[k][1] for k in keys.tolist()] + [0], np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; NONE where there is no such piece."""
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), self.made[at]

    def counts(self, sequences: list[str]) -> np.ndarray:
        """Tokens of each sequence."""
        ids, cost = dict(self.ids), list(self.cost)
        flat = []
        for s in sequences:
            for c in s:
                if (i := ids.get(c)) is None:  # a character outside the vocabulary merges with nothing
                    i = ids[c] = len(cost)
                    cost.append(len(c.encode()))
                flat.append(i)
        cost, sizes = np.array(cost, np.int64), np.array([len(s) for s in sequences], np.int64)
        symbols, owner = np.array(flat, np.int64), np.repeat(np.arange(len(sequences)), sizes)
        out = np.zeros(len(sequences), np.int64)
        while len(symbols):
            rank, made = np.full(len(symbols), NONE, np.int64), np.zeros(len(symbols), np.int64)
            inner = owner[:-1] == owner[1:]
            left = np.flatnonzero(inner)
            rank[left], made[left] = self.pairs(symbols[left], symbols[left + 1])
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            # rank and position in one number: the minimum is the leftmost of the lowest rank
            best = np.minimum.reduceat(rank << 32 | np.arange(len(symbols)), starts)
            live = (best >> 32) < NONE
            ended = np.repeat(~live, np.diff(np.append(starts, len(symbols))))
            np.add.at(out, owner[ended], cost[symbols[ended]])
            at = best[live] & 0xFFFFFFFF
            symbols[at] = made[at]
            keep = ~ended
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return out


    def long_count(self, sequence: str) -> int:
        """The same for one long sequence, whose rounds would each merge a single pair of many symbols."""
        ids = [self.ids.get(c, -1 - i) for i, c in enumerate(sequence)]
        n = len(ids)
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) < n and ids[i] >= 0 and ids[j] >= 0:
                if (hit := self.found.get(ids[i] << 32 | ids[j])) is not None:
                    heapq.heappush(heap, (hit[0], i, ids[i], ids[j], hit[1]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, left, right, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # one of the two has merged elsewhere meanwhile
            ids[i], ids[j], after[i] = made, None, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return sum(self.cost[x] if x >= 0 else len(sequence[-1 - x].encode()) for x in ids if x is not None)


NONE = (1 << 30) - 1
#: Sequences with more symbols than this are merged one pair at a time, from a heap.
LONG = 512


@lru_cache(maxsize=2)
def load(model: str) -> Merges:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    special = (sp.is_control, sp.is_unknown, sp.is_byte, sp.is_unused)
    pieces = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())
              if not any(f(i) for f in special)]
    if sp.normalize("  ﬁ  a ") != f"{SPACE * 3}ﬁ{SPACE * 2}a{SPACE}":
        raise ValueError("the model rewrites texts; only a plain one with a leading space is known here")
    return Merges(pieces)


class Counter:
    """Counts texts, remembering the counts of pre-tokens."""

    def __init__(self, merges: Merges):
        self.merges, self.known = merges, {}

    def __call__(self, texts: list[str]) -> list[int]:
        # the model puts one space before every text that isn't empty
        cut = [_CUT.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        new = list(set().union(*cut).difference(self.known)) if cut else []
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = list(set().union(*cut))
        for group in _alike([w for w in new if len(w) <= LONG]):
            n = self.merges.counts([s.replace(" ", SPACE) for s in group])
            self.known.update(zip(group, n.tolist(), strict=True))
        self.known.update((w, self.merges.long_count(w.replace(" ", SPACE))) for w in new if len(w) > LONG)
        return [sum(map(self.known.__getitem__, words)) for words in cut]


@lru_cache(maxsize=2)
def counter(model: str) -> Counter:
    """The worker's counter: what one task has counted helps the next."""
    return Counter(load(model))


def _alike(words: list[str], most: int = 1 << 18) -> Iterator[list[str]]:
    """Groups of like length with at most ``most`` characters, or a single longer word."""
    group, size = [], 0
    for w in sorted(words, key=len):
        if group and (size + len(w) > most or len(w) > 2 * len(group[0]) + 8):
            yield group
            group, size = [], 0
        group.append(w)
        size += len(w)
    if group:
        yield group


def count_tokens(docs: DataFrame, model: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                n = count(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()),
                     pa.array(n, pa.int64()), pa.array([x > limit for x in n])],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
