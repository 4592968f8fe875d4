"""Repository intelligence over a corpus of files.

``files`` is (repo, path, content), the path inside the repository.  Signature
tables are fixed and small: they become one array expression per file, so a
scan is a projection without a join; what follows are aggregations of short
rows by repository.  All files and whole contents are read.  Null contents
count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkaudit import catalogs_intel as K

LINE_SPLIT = r"\r\n|\n|\r"


def _any(text: Column, patterns: list[str], flags: str = "") -> Column:
    """Whether the whole text matches one of the patterns."""
    return text.rlike(f"{flags}^(?:{'|'.join(patterns)})$")


def _content() -> Column:
    return F.coalesce("content", F.lit(""))


def matched(text: Column, patterns: list[str]) -> Column:
    """Numbers of the patterns found in the text, case-insensitively."""
    return F.array_compact(F.array(*[F.when(text.rlike(f"(?i){p}"), F.lit(i)) for i, p in enumerate(patterns)]))


def _named(number: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), number + 1)


def _rank(text: Column, patterns: list[str]) -> Column:
    out = F.lit(None).cast("int")
    for i, p in reversed(list(enumerate(patterns))):
        out = F.when(text.rlike(f"^(?:{p})$"), i).otherwise(out)
    return out


def _ext() -> Column:
    return F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))


def _source_files(files: DataFrame, exts: list[str], skip: list[str] = K.SKIP_DIRS) -> DataFrame:
    return files.where(_ext().isin(*exts) & ~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(d) for d in skip])))


def manifests(files: DataFrame) -> DataFrame:
    """Manifest files with their place ``rank`` in reading order."""
    found = files.where(_any(F.col("path"), K.MANIFESTS) & (_content() != ""))
    numbers = F.array_compact(F.array(*[F.when(F.col("path").rlike(f"^(?:{p})$"), F.lit(i)) for i, p in enumerate(K.MANIFESTS)]))
    return found.withColumn("rank", numbers[0])


# --- X29 - X31 -----------------------------------------------------------------
def detect_frameworks(files: DataFrame) -> DataFrame:
    """(repo, framework, language, seen): ``seen`` counts a repository's frameworks in order of
    manifest, path and signature."""
    hits = manifests(files).select("repo", "rank", "path", F.explode(matched(F.col("content"), [p for p, _, _ in K.FRAMEWORKS]))
                                   .alias("i"))
    first = hits.groupBy("repo", _named(F.col("i"), [f for _, f, _ in K.FRAMEWORKS]).alias("framework"),
                         _named(F.col("i"), [x for _, _, x in K.FRAMEWORKS]).alias("language")).agg(
        F.min(F.struct("rank", "path", "i")).alias("at"))
    return first.withColumn("seen", F.row_number().over(Window.partitionBy("repo").orderBy("at"))).drop("at")


def languages(files: DataFrame) -> DataFrame:
    """Distinct (repo, language) from manifest names, dependencies and frameworks."""
    m = manifests(files)
    # the name is a base name, or the whole path
    known = F.array_compact(F.array(*[F.when(F.col("path").rlike(f"^(?:.*/)?(?:{p})$"), F.lit(x)) for p, x in K.MANIFEST_LANGUAGE]))
    named = m.select("repo", F.try_element_at(known, F.lit(1)).alias("language"))
    typed = dependencies(files).where("ecosystem = 'node' and contains(dependency, 'typescript')").select(
        "repo", F.lit("TypeScript").alias("language"))
    return named.unionByName(typed).unionByName(detect_frameworks(files).select("repo", "language")).where(
        "language is not null").distinct()


def dependencies(files: DataFrame) -> DataFrame:
    """(repo, ecosystem, path, pos, dependency) of all manifests."""
    m = manifests(files)
    text = F.col("content")
    none = F.array().cast("array<string>")

    def keys(field):
        return F.coalesce(F.json_object_keys(F.get_json_object(text, f"$.{field}")), none)
    lines = F.split(text, LINE_SPLIT)
    pip = F.transform(F.filter(lines, lambda x: (x != "") & ~x.startswith("#")),
                      lambda x: F.trim(F.split(F.split(x, "==")[0], ">=")[0]))
    go = F.transform(F.filter(lines, lambda x: x.startswith("\t") & x.contains("/")), lambda x: F.split(F.trim(F.ltrim(
        F.replace(x, F.lit("\t"), F.lit(" ")))), r"\s+")[0])
    kinds = [("node", F.col("path") == "package.json", F.concat(keys("dependencies"), keys("devDependencies"))),
             ("php", F.col("path") == "composer.json", keys("require")),
             ("python", F.col("path").rlike(r"^(?:Pipfile|requirements.*\.txt)$"), pip),
             ("go", F.col("path") == "go.mod", go)]
    eco, deps = F.lit(None).cast("string"), none
    for name, test, found in reversed(kinds):
        eco, deps = F.when(test, name).otherwise(eco), F.when(test, found).otherwise(deps)
    return m.select("repo", eco.alias("ecosystem"), "path", F.posexplode(deps).alias("pos", "dependency"))


def manifest_notes(files: DataFrame) -> DataFrame:
    """(repo, note): PHP version constraint, container files."""
    m = manifests(files)
    php = m.where("path = 'composer.json'").select("repo", F.get_json_object("content", "$.require.php").alias("v")).where(
        "v is not null").select("repo", F.concat(F.lit("PHP version constraint: "), "v").alias("note"))
    box = m.where(F.col("path").rlike(r"^(?:Dockerfile|docker-compose\.ya?ml)$")).select(
        "repo", F.concat(F.lit("Containerized deployment detected: "), "path").alias("note"))
    return php.unionByName(box)


# --- X32, X33, X36 ---------------------------------------------------------------
def annotation_scan(files: DataFrame) -> DataFrame:
    """(repo, file, annotation, language, implication), one row per annotation and file."""
    hits = _source_files(files, K.SOURCE_EXTS).select(
        "repo", F.col("path").alias("file"), F.explode(matched(_content(), [a[0] for a in K.ANNOTATIONS])).alias("i"))
    return hits.select("repo", "file", *[_named(F.col("i"), [a[k] for a in K.ANNOTATIONS]).alias(name)
                                         for k, name in ((1, "annotation"), (2, "language"), (3, "implication"))])


def auth_mechanisms(files: DataFrame, annotations: DataFrame | None = None) -> DataFrame:
    """Distinct (repo, mechanism) from configuration, documentation and annotations."""
    config = files.where(_any(F.col("path"), K.AUTH_FILES)).select("repo", F.explode(F.transform(
        matched(_content(), [p for p, _ in K.AUTH]), lambda i: _named(i, [m for _, m in K.AUTH]))).alias("mechanism"))
    found = annotation_scan(files) if annotations is None else annotations
    implied = found.select("repo", F.explode(F.array_compact(F.array(*[
        F.when(F.col("annotation").contains(k), F.lit(m)) for k, m in K.ANNOTATION_MECHANISM]))).alias("mechanism"))
    return config.unionByName(implied).distinct()


def public_endpoints(annotations: DataFrame) -> DataFrame:
    """Annotations that say that no login is asked for."""
    marked = F.lit(False)
    for m in K.PUBLIC_MARKERS:
        marked = marked | F.col("annotation").contains(m)
    return annotations.where(marked)


# --- X34, X35, X37 ---------------------------------------------------------------
def role_constants(files: DataFrame) -> DataFrame:
    """Distinct (repo, kind, value): role names, and permissions like ``read:orders``."""
    src = _source_files(files, K.ROLE_EXTS).select("repo", _content().alias("c"))
    out = None
    for kind, group in (("role", 1), ("permission", 2)):
        part = src.select("repo", F.lit(kind).alias("kind"), F.explode(
            F.regexp_extract_all("c", F.lit(K.ROLE_CONST_RE), group)).alias("value")).where("value <> ''")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def endpoint_role_map(files: DataFrame) -> DataFrame:
    """Distinct (repo, file, role): the role that a source line asks for, by the first pattern that matches."""
    def role(line):
        found = F.lit(None).cast("string")
        for p in reversed(K.ROLE_PATTERNS):
            found = F.when(line.rlike(f"(?i){p}"), F.trim(F.regexp_extract(line, f"(?i){p}", 1))).otherwise(found)
        return found
    anything = "(?i)" + "|".join(f"(?:{p})" for p in K.ROLE_PATTERNS)
    lines = _source_files(files, K.ROLE_EXTS).where(_content().rlike(anything)).select(
        "repo", F.col("path").alias("file"),
        F.explode(F.filter(F.split("content", LINE_SPLIT), lambda x: x.rlike(anything))).alias("line"))
    return lines.select("repo", "file", role(F.col("line")).alias("role")).distinct()


def endpoint_role_gap(endpoints: DataFrame, roles: DataFrame) -> DataFrame:
    """Endpoints of a privileged path whose file names no role."""
    privileged = endpoints.where(F.col("path").rlike("(?i)admin|manage|internal|config|role|permission|delete|orders"))
    return privileged.join(roles.select("repo", "file").distinct(), ["repo", "file"], "left_anti")


def policy_files(files: DataFrame) -> DataFrame:
    """(repo, path) of policy and permission definitions."""
    return files.where(_any(F.col("path"), K.POLICY_FILES)).select("repo", "path").distinct()


# --- X38 - X41 ---------------------------------------------------------------------
def _top_dir() -> Column:
    """First folder of the path, null for files at the top and hidden folders."""
    return F.when(F.col("path").contains("/") & ~F.col("path").startswith("."), F.substring_index("path", "/", 1))


def architecture_signals(files: DataFrame) -> DataFrame:
    """(repo, pos, note) from folder and file names, one aggregate per repository."""
    tests = [(_top_dir().isin(*names), note) for names, note in K.DIR_SIGNALS]
    tests += [(F.col("path").rlike("|".join(words)), note) for words, note in K.PATH_SIGNALS]
    flags = files.groupBy("repo").agg(*[F.max(F.coalesce(t, F.lit(False))).alias(f"f{i}") for i, (t, _) in enumerate(tests)])
    notes = F.array_compact(F.array(*[F.when(F.col(f"f{i}"), F.struct(F.lit(i).alias("pos"), F.lit(n).alias("note")))
                                      for i, (_, n) in enumerate(tests)]))
    return flags.select("repo", F.explode(notes).alias("x")).select("repo", "x.*")


def async_signals(files: DataFrame) -> DataFrame:
    """(repo, layer, note): 1 a top-level folder, 2 any folder, 3 a source file shows asynchronous work."""
    dirs = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    names = F.array(*[F.lit(d) for d in K.QUEUE_DIRS])
    skipped = F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(d) for d in K.QUEUE_SKIP_DIRS]))
    source = _ext().isin(*K.SOURCE_EXTS) & ~skipped & _content().rlike("(?i)" + "|".join(f"(?:{p})" for p in K.QUEUE_PATTERNS))
    layer = (F.when(F.lower(_top_dir()).isin(*K.QUEUE_DIRS), 1)
             .when(~skipped & F.arrays_overlap(F.transform(dirs, F.lower), names), 2).when(source, 3))
    return files.groupBy("repo").agg(F.min(layer).alias("layer")).where("layer is not null").withColumn(
        "note", F.lit(K.ASYNC_NOTE))


def tenant_signals(files: DataFrame, shown: int = K.ROLE_FILES_SHOWN) -> DataFrame:
    """(repo, kind, note): the first tenant hint in a file or folder name with its number of places,
    and role or permission files (the first ones by path are named)."""
    parts = F.split("path", "/")
    entries = files.select("repo", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)),
                                                         lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("entry")).distinct()
    name = F.substring_index("entry", "/", -1)
    hints = entries.select("repo", F.explode(F.array_compact(F.array(*[
        F.when(name.contains(h), F.lit(i)) for i, h in enumerate(K.TENANT_HINTS)]))).alias("i"))
    tenant = hints.groupBy("repo", "i").agg(F.count(F.lit(1)).alias("n")).groupBy("repo").agg(
        F.min(F.struct("i", "n")).alias("x")).select("repo", F.lit("tenant").alias("kind"), F.concat(
            F.lit("Multi-tenant indicator found: `"), _named(F.col("x.i"), K.TENANT_HINTS), F.lit("` in "),
            F.col("x.n").cast("string"), F.lit(" locations")).alias("note"))
    role = entries.where(name.rlike("|".join(K.ROLE_FILE_WORDS))).withColumn(
        "n", F.row_number().over(Window.partitionBy("repo").orderBy("entry"))).where(F.col("n") <= shown)
    files_note = role.groupBy("repo").agg(F.array_sort(F.collect_list("entry")).alias("x")).select(
        "repo", F.lit("roles").alias("kind"),
        F.concat(F.lit("RBAC/permission files detected: "), F.array_join("x", ", ")).alias("note"))
    return tenant.unionByName(files_note)


def tech_stack(files: DataFrame) -> DataFrame:
    """Distinct (repo, tech) shown by a marker file or folder."""
    found = F.array_compact(F.array(*[
        F.when(F.col("path").isin(*marks) | F.col("path").rlike("^(?:" + "|".join(f"\\Q{m}\\E" for m in marks) + ")/"), F.lit(t))
        for t, marks in K.TECH_STACK]))
    return files.select("repo", F.explode(found).alias("tech")).distinct()


def security_notes(files: DataFrame) -> DataFrame:
    """A10: distinct (repo, note, part): notes of manifests (0), access (1) and architecture (2)."""
    warned = annotation_scan(files).where(F.col("implication").contains(K.WARNING)).select("repo", F.concat(
        F.lit("⚠️  `"), "annotation", F.lit("` in `"), "file", F.lit("` — "), "implication").alias("note"))
    parts = [manifest_notes(files), warned.unionByName(tenant_signals(files).select("repo", "note")),
             architecture_signals(files).select("repo", "note").unionByName(async_signals(files).select("repo", "note"))]
    out = None
    for i, part in enumerate(parts):
        part = part.withColumn("part", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("repo", "note").agg(F.min("part").alias("part"))


# --- S8 - S10 ------------------------------------------------------------------------
def _first_of(files: DataFrame, names: list[str]) -> DataFrame:
    """Of each repository the first file that is there, by the order of ``names``."""
    rank = _rank(F.col("path"), [f"\\Q{n}\\E" for n in names])
    return files.withColumn("rank", rank).where("rank is not null").groupBy("repo").agg(
        F.min_by(F.struct("path", "content"), "rank").alias("x")).select("repo", "x.*")


def env_keys(files: DataFrame) -> DataFrame:
    """(repo, pos, key): names set in the first environment template."""
    lines = F.filter(F.split(_content(), LINE_SPLIT), lambda x: x.contains("=") & ~F.trim(x).startswith("#"))
    return _first_of(files, K.ENV_FILES).select("repo", F.posexplode(
        F.transform(lines, lambda x: F.trim(F.substring_index(x, "=", 1)))).alias("pos", "key"))


def manifest_info(files: DataFrame) -> DataFrame:
    """(repo, file, name, description) of the first manifest."""
    js = F.col("path").isin("package.json", "composer.json")
    name = (F.when(js, F.get_json_object("content", "$.name"))
            .when(F.col("path") == "pyproject.toml", F.regexp_extract("content", r"""name\s*=\s*["']([\w\-]+)""", 1))
            .otherwise(F.split("content", LINE_SPLIT)[0]))
    return _first_of(files, K.INFO_MANIFESTS).select(
        "repo", F.col("path").alias("file"), F.coalesce(name, F.lit("")).alias("name"),
        F.coalesce(F.when(js, F.get_json_object("content", "$.description")), F.lit("")).alias("description"))


def readme(files: DataFrame) -> DataFrame:
    """(repo, path, content): the whole text of the first readme."""
    return _first_of(files, K.README_NAMES)
