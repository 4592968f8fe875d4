"""sparkaudit — security-audit analytics over code corpora, paths, call graphs
and tool logs, written as Spark DataFrame / SQL jobs.

Layout
------
sources/    readers: file corpora, scanner output, run artifacts, call logs
functions/  column-expression helpers (pure ``Column -> Column``)
operators/  DataFrame -> DataFrame operators (filters, scoring, joins,
            graph traversal, roll-ups, extraction)
sinks/      writers for run artifacts, findings and logs
streaming/  Structured Streaming forms of the log / document operators
plans/      test-table views and the registered queries used by the
            correctness oracle and the benchmark
"""

from sparkaudit.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
