"""Texts made to be slow, and rows without an id."""

import time

import pytest
from conftest_llm import table_of

from sparkaudit.llm import license_scan
from sparkaudit.llm.secrets_ledger import RULES, find_spans

SIZE = 1 << 20
RUNS = {
    "assign": ["password" * (SIZE // 8), "token" + " " * SIZE, "secret=" * (SIZE // 7)],
    "access": ["AKIA" * (SIZE // 4)], "hex": ["deadbeef" * (SIZE // 8), ("a" * 23 + "g") * (SIZE // 24)],
    "private_key": ["-----BEGIN PRIVATE KEY-----" * (SIZE // 27), "-----BEGIN " + "A " * (SIZE // 2), "-----BEGIN PRIVATE KEY-----\n" + "a: b\n" * (SIZE // 5)],
    "code_host": ["ghp_" * (SIZE // 4), "ghp_" + "a" * SIZE], "chat": ["xoxa-" * (SIZE // 5), "xox" * (SIZE // 3)], "maps": ["AIza" * (SIZE // 4)],
    "jwt": ["eyJ" * (SIZE // 3), "eyJaaaaaaaa." * (SIZE // 12), "eyJaaaaaaaa.eyJ" + "a" * SIZE],
    "url_login": ["a" * SIZE + "://", "a://" * (SIZE // 4), "x://" + "a:" * (SIZE // 2)],
}


@pytest.mark.parametrize("kind", [r.kind for r in RULES])
def test_a_megabyte_made_for_a_rule_is_read_in_linear_time(kind):
    """Four times the text takes about four times as long, not sixteen."""
    rule = tuple(r for r in RULES if r.kind == kind)
    for text in RUNS[kind]:
        took = []
        for part in (text[:SIZE // 4], text):
            began = time.perf_counter()
            find_spans(part, rule)
            took.append(time.perf_counter() - began)
        assert took[1] < 9 * took[0] + 0.5 and took[1] < 20, (kind, text[:30], took)


def test_tokens_are_found_at_the_start_of_a_run():
    token = "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl"
    for text, at in ((token, 0), (f"x {token} y", 2), (f'"{token}"', 1), (f"a.{token}", 2)):
        assert ("jwt", at, at + len(token)) in find_spans(text, RULES)


def test_licences_of_rows_without_an_id(spark):
    """Each row gets its own text's answer; equal texts get the same."""
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    apache = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."
    plain = "The river rose in the night and the men carried the sacks of grain up the hill before the morning came."
    rows = [(None, mit, "s"), (None, apache, "s"), (None, plain, "s"), (None, mit, "s"), (1, mit, "s"), (2, None, "s"), (None, None, "s")]
    rows += [(100 + i, f"{plain} Day {i} was dry and day {i + 1} was wet.", "s") for i in range(30)]
    got = license_scan.scan_documents(table_of(spark, rows)).collect()
    assert len(got) == len(rows)
    without = sorted((r.licenses or r.suspected) for r in got if r.doc_id is None)
    one = next(r for r in got if r.doc_id == 1)
    assert (one.licenses or one.suspected) and without.count(one.licenses or one.suspected) == 2
    assert without.count("") == 2  # the plain text and the null one
    assert len(set(without)) == 3  # and Apache's is another one
