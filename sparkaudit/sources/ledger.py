"""Incremental scans of a changing corpus (S1, ST5): a ledger of file contents.

A file's content is addressed by its SHA-256 and its path's extension.  For each
scan and version the ledger holds one row per content that the scan has seen, with
what it found there.  A run scans only contents that the ledger lacks and joins the
findings back to every path that holds them now.

A row of the ledger is whole by itself and rows are only appended, so a run that
fails half-way leaves nothing wrong: what it did write isn't scanned again.  Two
runs at once may both write a content; it is read once.

The corpus is read twice at most: for its addresses, and for the texts of contents
not seen before.  Every shuffle but that of new texts moves addresses, not texts.

Defined cases: a null text is the empty content; null parts of a path are values
like others; repeated rows are files of their own, which get the same findings; an
empty corpus has none.  Only the columns named are read; their names may be any but
``blob_id``, ``file`` and ``text_at``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkaudit.session import written

#: New contents up to this number (some 100 bytes each) are broadcast to the scan of the corpus; more are joined by a shuffle.
BROADCAST_BLOBS = 200_000


class Scan(NamedTuple):
    """``run`` maps (file, text) to rows with ``file``; what it finds may depend on the text and on the file's extension only."""
    name: str
    version: int
    run: Callable[[DataFrame], DataFrame]
    reads: Callable[[Column], Column] | None = None  # by path: which files the scan reads


class ScanRun(NamedTuple):
    findings: DataFrame      # keys, and what the scan found
    index: DataFrame         # keys, blob_id: the files that the scan reads
    scanned: DataFrame       # blob_id: the contents that this run was the first to see


def address(path: Column, text: Column) -> Column:
    """SHA-256 of a file's text, and its extension in lower case."""
    ext = F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"(\.[^./]+)$", 1))
    return F.concat(F.sha2(F.coalesce(text, F.lit("")), 256), ext)


def corpus_index(files: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """(keys, blob_id): one row per file; the path is the last of ``keys``."""
    return files.select(*keys, address(F.col(keys[-1]), F.col(text)).alias("blob_id"))


def corpus_changes(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, change): files ``added``, ``removed``, ``changed`` or ``unchanged`` between two indexes.

    A path with several rows is unchanged where both sides hold the same contents equally often.  Contents
    are summed as 64-bit hashes, so nothing is gathered per path.
    """
    both = before.select(*keys, "blob_id", F.lit(False).alias("text_at")).unionAll(
        after.select(*keys, "blob_id", F.lit(True).alias("text_at")))
    new, content = F.col("text_at"), F.xxhash64("blob_id").cast("decimal(38,0)")
    sides = both.groupBy(*keys).agg(
        F.count_if(~new).alias("_n0"), F.count_if(new).alias("_n1"),
        F.sum(F.when(~new, content)).alias("_s0"), F.sum(F.when(new, content)).alias("_s1"))
    same = (F.col("_n0") == F.col("_n1")) & (F.col("_s0") == F.col("_s1"))
    return sides.select(*keys, F.when(F.col("_n0") == 0, "added").when(F.col("_n1") == 0, "removed")
                        .when(same, "unchanged").otherwise("changed").alias("change"))


def _table(base: str, scan: Scan) -> str:
    return f"{base.rstrip('/')}/{scan.name}/v{scan.version}"


def seen(files: DataFrame, base: str, scan: Scan) -> DataFrame | None:
    """(blob_id, findings) of every content that this version of the scan has seen; None before its first run."""
    try:
        return files.sparkSession.read.parquet(_table(base, scan))
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # none, or only files of a failed run
            raise
        return None


def incremental_scan(files: DataFrame, base: str, scan: Scan, keys: Sequence[str] = ("repo", "path"),
                     text: str = "content") -> ScanRun:
    """Scan the contents that the ledger under ``base`` lacks, and find what all files hold.

    ``base`` is a folder on shared storage.
    """
    path, content = F.col(keys[-1]), F.coalesce(F.col(text), F.lit(""))
    if scan.reads is not None:
        files = files.where(scan.reads(path))
    at = F.xxhash64(*keys)  # one of the files with a content, the same in both reads of the corpus
    rows = written(files.select(*keys, address(path, content).alias("blob_id"), at.alias("text_at")))
    index = rows.drop("text_at")
    blobs = written(rows.groupBy("blob_id").agg(F.min("text_at").alias("text_at")))
    known = seen(files, base, scan)
    new = blobs if known is None else written(blobs.join(known.select("blob_id"), "blob_id", "left_anti"))
    n = new.count()
    if n or known is None:
        wanted = F.broadcast(new) if n <= BROADCAST_BLOBS else new
        texts = (files.select(address(path, content).alias("blob_id"), at.alias("text_at"), content.alias("text"))
                 .join(wanted, ["blob_id", "text_at"], "left_semi").dropDuplicates(["blob_id", "text_at"]))
        found = scan.run(texts.select(F.col("blob_id").alias("file"), "text"))
        what = [c for c in found.columns if c != "file"]
        found = found.groupBy(F.col("file").alias("blob_id")).agg(F.collect_list(F.struct(*what)).alias("findings"))
        new.select("blob_id").join(found, "blob_id", "left").write.mode("append").parquet(_table(base, scan))
    # written, so that adaptive execution can split a content that very many files hold
    hits = written(seen(files, base, scan).where(F.size("findings") > 0)
                   .join(blobs, "blob_id", "left_semi").dropDuplicates(["blob_id"]))
    findings = index.join(hits, "blob_id").select(*keys, F.explode("findings").alias("text_at")).select(*keys, "text_at.*")
    return ScanRun(findings, index, new.select("blob_id"))
