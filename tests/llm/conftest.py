import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

from conftest_llm import prose, table_of  # noqa: E402

from sparkaudit.llm.registry import importable  # noqa: E402


@pytest.fixture(scope="session", autouse=True)
def _code(spark):
    importable(spark)


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, source) with nulls, empty and long texts, ties, repeated rows, near and exact copies."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghijklmnoprstuvwé漢😀") for _ in range(rng.randint(2, 9))) for _ in range(600)]
    base = [prose(rng, rng.randint(60, 160), vocabulary) for _ in range(20)]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(base)]
    for k in range(40):  # copies with some words changed
        words = base[k % 4].split(" ")
        for _ in range(rng.choice([0, 1, 2, 3, 5, 9])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((100 + k, " ".join(words), "s0"))
    long = prose(rng, 9000, vocabulary)
    rows += [(200, None, None), (201, "", "s1"), (202, " \n\t ", "s1"), (203, "one two", "s1"), (204, "ONE two", "s2"),
             (205, "a b c d e", "s2"), (206, "x " * 700, "s2"), (207, "x " * 699, "s2"), (208, long, "s0"),
             (209, long[:30000] + " " + base[5] + long[30000:], "s0"), (210, base[5].upper(), "s4"),
             (211, "line one\n" * 80 + "| a | b |", "s4"), (212, "é😀" * 500, None)]
    return rows + [rows[0], rows[0], rows[50]]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return table_of(spark, corpus)


@pytest.fixture(scope="session")
def empty(spark):
    return table_of(spark, [])
