"""Hard-coded secret and weak-crypto scans over a text corpus.

Input: any DataFrame with a file-like column and a text column (source files,
documents, pages).  One narrow pass: texts and lines are tested for plain words
first, then every pattern is extracted in a single projection and exploded
once.  No shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkaudit import catalogs as K
from sparkaudit.functions.core import contains_any, map_lookup

LINE_SPLIT = r"\r\n|\n|\r"


#: What a text must contain (lower case) for one of the patterns to match; cheap tests before any expression.
ASSIGN_WORDS = ["password", "passwd", "secret", "token", "api_key", "apikey", "access_key", "private_key"]
FORMAT_WORDS = {"aws_access_key": "akia", "aws_secret_key": "aws_secret_access_key", "github_token": "ghp_",
                "stripe_live_key": "sk_live_", "google_api_key": "aiza", "private_key": "private key-----", "connection_string": "://"}


def _has(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def gated_lines(df: DataFrame, file_col: str, text_col: str, words) -> DataFrame:
    """(file, line_no, line) of lines that contain one of ``words``; only their numbers are kept before the explode."""
    lines = F.transform(F.split(F.col(text_col), LINE_SPLIT), lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line")))
    src = df.where(_has(F.lower(F.col(text_col)), words))
    return src.select(F.col(file_col).alias("file"), F.explode(F.filter(
        lines, lambda x: _has(F.lower(x["line"]), words))).alias("x")).select("file", "x.line_no", "x.line")


def mask(v: Column) -> Column:
    return F.concat(F.substring(v, 1, 4), F.repeat(F.lit("*"), F.greatest(F.length(v) - 4, F.lit(0))))


def assign_type(name: Column) -> Column:
    n = F.lower(name)
    return (F.when(n.contains("private_key"), "private_key")
            .when(n.contains("access_key"), "access_key")
            .when(n.contains("api_key") | n.contains("apikey"), "api_key")
            .when(n.contains("password") | n.contains("passwd"), "password")
            .when(n.contains("secret"), "secret")
            .otherwise("token"))


def secrets_scan(df: DataFrame, file_col: str = "file", text_col: str = "text") -> DataFrame:
    """X43 + C8: file, line, type, value_masked, confidence, severity.

    Lines pass a test for plain words first; a pattern runs only on lines with its own word.
    """
    words = [*ASSIGN_WORDS, *FORMAT_WORDS.values()]
    lines = gated_lines(df.where(~contains_any(F.col(file_col), K.SECRET_SKIP_DIRS)), file_col, text_col, words)
    line, low = F.col("line"), F.lower("line")
    empty = F.array().cast("array<struct<type:string,value:string,confidence:string>>")
    assign = F.when(_has(low, ASSIGN_WORDS) & ~line.rlike(K.SECRET_SAFE_RE), F.transform(
        F.regexp_extract_all(line, F.lit(K.SECRET_ASSIGN_RE), 0),
        lambda m: F.struct(assign_type(F.regexp_extract(m, K.SECRET_ASSIGN_RE, 1)).alias("type"),
                           F.regexp_extract(m, K.SECRET_ASSIGN_RE, 2).alias("value"),
                           F.lit("MEDIUM").alias("confidence")))).otherwise(empty)

    def tagger(t, c):
        return lambda m: F.struct(F.lit(t).alias("type"), m.alias("value"), F.lit(c).alias("confidence"))
    fmts = [F.when(low.contains(FORMAT_WORDS[t]), F.transform(F.regexp_extract_all(line, F.lit(p), 0), tagger(t, c))).otherwise(empty)
            for t, p, c in K.SECRET_FORMATS]
    hits = lines.select("file", "line_no", F.explode(F.concat(assign, *fmts)).alias("h"))
    return hits.select(
        "file", F.col("line_no").alias("line"), F.col("h.type").alias("type"),
        mask(F.col("h.value")).alias("value_masked"), F.col("h.confidence").alias("confidence"),
        map_lookup(F.col("h.type"), K.SECRET_SEVERITY, "MEDIUM").alias("severity"))


def weak_crypto_scan(df: DataFrame, file_col: str = "file", text_col: str = "text",
                     context_lines: int = 2) -> DataFrame:
    """Weak hash / insecure random / default JWT secret / backdoor lines.

    A hash or random call counts only when a security word appears within
    ``context_lines`` lines around it (array slice of the file's lines, so
    still narrow).
    """
    allp = "|".join(f"(?:{p})" for _, p in K.WEAK_CRYPTO)
    src = df.where(F.col(text_col).rlike(allp)).select(
        F.col(file_col).alias("file"), F.split(F.col(text_col), LINE_SPLIT).alias("lines"))
    rows = src.select("file", "lines", F.posexplode("lines").alias("pos", "line")).where(
        F.col("line").rlike(allp))
    n = context_lines
    start = F.greatest(F.col("pos") + 1 - n, F.lit(1))
    ctx = F.array_join(F.slice("lines", start, F.col("pos") + 1 + n - start + 1), "\n")
    near = ctx.rlike(K.WEAK_CONTEXT_RE)
    kinds = F.array(*[F.when(F.col("line").rlike(p) & (near if t in ("weak_hash", "insecure_random")
                                                         else F.lit(True)), F.lit(t)) for t, p in K.WEAK_CRYPTO])
    return rows.select("file", (F.col("pos") + 1).cast("int").alias("line"),
                       F.explode(F.array_compact(kinds)).alias("type"),
                       F.trim(F.col("line")).alias("code"))
