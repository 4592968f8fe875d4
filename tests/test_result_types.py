"""Types of a scan result with more than 20 findings."""
import json

from sparkaudit.sources import logs


def test_types_of_all_findings(spark):
    findings = [{"type": "a"}] * 20 + [{"type": "z"}, {}]
    rows = spark.createDataFrame([("secrets_scan", json.dumps({"findings": findings}))], "tool string, result string")
    every, some = (logs.result_summary(rows, **o).first().parts for o in ({}, {"max_types": 20}))
    assert every["types"] == "?+a+z" and every["secrets_found"] == "22"
    assert some["types"] == "a"
