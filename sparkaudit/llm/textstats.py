"""Rule statistics of whole texts, for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkaudit.llm.common import text_slices
from sparkaudit.llm.words import BYTE_CODE, find_words, grams, not_space

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_chars", "n_upper", "n_lower", "n_digits", "n_marks", "n_bangs", "n_bars", "n_distinct", "top_word",
        "n_short", "n_long", "n_capital")
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS + MORE)

_NOT_NEWLINE = np.arange(256) != 0x0A


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


# Fixed values of the contract's rules come first.
_CLASSES = {"n_symbols": _flags(b"#*$%&|<>"), "n_upper": _flags(bytes(range(65, 91))),
            "n_lower": _flags(bytes(range(97, 123))), "n_digits": _flags(b"0123456789"),
            "n_marks": _flags(b".,;:!?"), "n_bangs": _flags(b"!"), "n_bars": _flags(b"|"),
            "n_chars": (np.arange(256) & 0xC0) != 0x80}


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts per text."""
    n, out = len(offsets) - 1, {}

    def per_row(rows: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(rows, weights, n).astype(np.int64)

    for name, flags in _CLASSES.items():
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(flags[data], out=total[1:])
        out[name] = total[offsets[1:]] - total[offsets[:-1]]
        if name == "n_chars":
            points = total
    words = find_words(data, offsets, not_space(), BYTE_CODE)
    length = points[words.end] - points[words.start]
    out["n_words"], out["word_chars"] = per_row(words.row), per_row(words.row, length)
    out["n_short"], out["n_long"] = per_row(words.row[length <= 3]), per_row(words.row[length > 20])
    first = data[words.start]
    out["n_capital"] = per_row(words.row[(first >= 65) & (first <= 90)])
    lines = find_words(data, offsets, _NOT_NEWLINE, BYTE_CODE)
    full = np.searchsorted(words.start, lines.end) > np.searchsorted(words.start, lines.start)
    row, code = lines.row[full], lines.hash[full]
    out["n_lines"] = per_row(row)
    out["n_dup_lines"] = per_row(row[_seen(row, code)[0]])
    new, most = _seen(words.row, words.hash)
    out["n_distinct"] = out["n_words"] - per_row(words.row[new])
    out["top_word"] = np.zeros(n, np.int64)
    np.maximum.at(out["top_word"], words.row, most)
    gram = grams(words.hash, 3)
    inside = words.row[:len(gram)] == words.row[2:]
    at = np.flatnonzero(inside)
    _, often = _seen(words.row[at], gram[at])
    at = at[often > 1]
    covered = np.zeros(len(words.row), bool)
    for i in range(3):
        covered[at + i] = True
    out["n_repeat_words"] = per_row(words.row[covered])
    return out


def _seen(row: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value: whether its row had it before, and how often its row has it."""
    if not len(row):
        return np.zeros(0, bool), np.zeros(0, np.int64)
    order = np.lexsort((code, row))
    r, c = row[order], code[order]
    new = np.append(True, (r[1:] != r[:-1]) | (c[1:] != c[:-1]))
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(r)))
    before, often = np.empty(len(r), bool), np.empty(len(r), np.int64)
    before[order], often[order] = ~new, np.repeat(times, times)  # lexsort is stable: the first stays first
    return before, often


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, counts ...) of every whole text; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_slices(batches, "text"):
            found = statistics(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), *[pa.array(found[c], pa.int64()) for c in COUNTS + MORE]],
                ["doc_id", *COUNTS, *MORE])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


#: What the models see: ratios, so that a text's length counts only by itself.
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "distinct", "upper", "digits", "marks",
            "bangs", "bars", "line_words", "top_word", "short", "long", "capital")


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """One row per text, one column per name in FEATURES."""
    words, lines = np.maximum(s["n_words"], 1), np.maximum(s["n_lines"], 1)
    chars, letters = np.maximum(s["word_chars"], 1), np.maximum(s["n_upper"] + s["n_lower"], 1)
    columns = (np.log1p(s["n_words"]), s["word_chars"] / words, s["n_symbols"] / words, s["n_dup_lines"] / lines,
               s["n_repeat_words"] / words, np.log(np.maximum(s["n_distinct"], 1)) / np.log(words + 1),
               s["n_upper"] / letters, s["n_digits"] / chars,
               s["n_marks"] / words, s["n_bangs"] / words, s["n_bars"] / words,
               np.log(words / lines), s["top_word"] / words,
               s["n_short"] / words, s["n_long"] / words, s["n_capital"] / words)
    return np.stack([np.asarray(c, np.float64) for c in columns], axis=1)
