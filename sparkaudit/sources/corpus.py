"""Corpus readers and inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkaudit import catalogs as K
from sparkaudit import catalogs_intel as KI
from sparkaudit import catalogs_surface as KS

# FIXED VALUES — file-tree profile.
TREE_SKIP_DIRS = [".git", "node_modules", "__pycache__", "vendor", "dist", "build", ".tox", "venv"]
TREE_EXTS = [".py", ".java", ".js", ".ts", ".go", ".php", ".rb", ".cs"]


def read_corpus(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """Recursive binary-file read -> (repo, path, content).  ``repo`` is
    the first directory under ``root``; content is decoded as UTF-8.  Spark's
    reader lists no files without bytes."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.load(root)
    rel = F.regexp_replace(F.col("path"), "^.*?\\Q" + root.rstrip("/") + "/\\E", "")
    return df.select(F.substring_index(rel, "/", 1).alias("repo"),
                     F.regexp_extract(rel, "^[^/]+/(.*)$", 1).alias("path"),
                     F.decode("content", "UTF-8").alias("content"))


#: Extensions that a scan reads and folders that it leaves out.
PROFILES = {
    "api": ([e for v in K.LANG_EXTS.values() for e in v], K.API_SKIP_DIRS),
    "tree": (TREE_EXTS, TREE_SKIP_DIRS),
    "annotations": (KI.SOURCE_EXTS, KI.SKIP_DIRS),
    "roles": (KI.ROLE_EXTS, KI.SKIP_DIRS),
    "queue": (KI.SOURCE_EXTS, KI.QUEUE_SKIP_DIRS),
    "surface": (KS.SURFACE_EXTS, K.SCAN_SKIP_DIRS),
}


def scan_source_files(files: DataFrame, profile: str) -> DataFrame:
    """The files of a scan profile, by extension and folders of the relative path."""
    exts, skip = PROFILES[profile]
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return files.where(ext.isin(*exts) & ~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(d) for d in skip])))


def file_inventory(files: DataFrame, cap: int | None = None) -> DataFrame:
    """Sorted relative source paths per repo with their ordinal ``n``.

    ``cap`` keeps the first paths of each repo (a display feature, off by
    default; the per-repo limit runs as a partial WindowGroupLimit)."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    parts = F.split("path", "/")
    keep = files.where(ext.isin(*TREE_EXTS) & ~F.arrays_overlap(parts, F.array(*[F.lit(d) for d in TREE_SKIP_DIRS])))
    w = Window.partitionBy("repo").orderBy("path")
    out = keep.select("repo", "path").withColumn("n", F.row_number().over(w))
    return out if cap is None else out.where(F.col("n") <= cap)
