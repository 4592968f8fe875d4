"""The pipeline: every stage on its predecessor's documents."""
import hashlib
import math
import re
from collections import Counter

import __spark_entry__ as E
import corpus_pipeline
import duckdb
import pyarrow as pa
import pytest
from test_dedup import groups
from test_text import SPACES, filled

from sparkaudit.llm import registry
from sparkaudit.llm.q_scan import OP9_SQL
from sparkaudit.llm.secrets_ledger import RULES, cut, find_spans

NAMES = ["quality_rules", "near_duplicates", "benchmark_decontamination", "secret_scan", "mixing"]


def test_stages(spark, sf_small):
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_small).checkpoint()
        left = {r.doc_id for r in out.select("doc_id").collect()}
        assert left and left <= ids
        assert out.columns == docs.columns + (["copy"] if name == "mixing" else [])
        if name == "secret_scan":
            assert left == ids
        docs, ids = out, left
    run = corpus_pipeline.run(spark, sf_small)
    assert sorted((r.doc_id, r.text, r.copy) for r in run.collect()) == sorted(
        (r.doc_id, r.text, r.copy) for r in docs.collect())


def test_run_against_brute_force(spark, sf_small):
    """Every decision made again without the stages: from the forest's verdicts on."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    good = {r.doc_id for r in E.queries()["op7_quality_rules"](spark, sf_small).collect() if r.kept}
    one = {i for i, _, _, kept in groups(
        [(i, docs[i].text, docs[i].source) for i in sorted(good)], corpus_pipeline.NEAR_PERCENT) if kept}
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": sorted(one), "text": [docs[i].text for i in sorted(one)]}))
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{sf_small}/benchmark.parquet'")
    clean = {r[0] for r in con.execute(OP9_SQL).fetchall() if not r[5]}
    texts = {i: cut(docs[i].text, [(a, b) for _, a, b in find_spans(docs[i].text, RULES)], "[secret]") for i in clean}
    size = {i: len(re.findall(SPACES, t)) for i, t in texts.items()}
    total = Counter()
    for i in clean:
        total[docs[i].source] += size[i]
    names = sorted(total)
    target = dict(zip(names, filled([total[n] for n in names], [(3, 1, 2)[k % 3] for k in range(len(names))]), strict=True))
    want = Counter()
    for i, t in texts.items():
        rate = target[docs[i].source] / total[docs[i].source] if total[docs[i].source] else 0
        u = int(hashlib.sha256(f"20:{i}:{t}".encode()).hexdigest()[:13], 16) / 16**13
        for k in range(math.floor(rate) + (u < rate - math.floor(rate))):
            want[i, t, k] += 1
    got = Counter((r.doc_id, r.text, r.copy) for r in corpus_pipeline.run(spark, sf_small).collect())
    assert got == want and len(got) > 50


def test_empty(spark, sf_small, tmp_path):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_small)
    assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) | {"pipeline"}))
def test_registered(name):
    assert name in E.queries()


def test_ten_operators():
    assert sorted({int(n[2:].split("_")[0]) for n in E.queries() if n.startswith("op")}) == list(range(1, 11))
