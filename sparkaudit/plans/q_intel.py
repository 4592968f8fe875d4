"""Registered queries: repository intelligence."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkaudit import catalogs_intel as K
from sparkaudit.operators import endpoints as E
from sparkaudit.operators import intel as N
from sparkaudit.plans import inputs as I
from sparkaudit.plans.q_endpoints import _MADE
from sparkaudit.plans.registry import register
from sparkaudit.plans.sqlfrag import contains_any, in_list, q
from sparkaudit.sources.corpus import PROFILES, scan_source_files

VIEWS = ("v_src_files", "v_repo_files")


def _files(spark, sf):
    return I.view(spark, sf, "v_repo_files")


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else q(x) for x in r) + ")" for r in rows)


def _whole(expr: str, patterns) -> str:
    return f"regexp_full_match({expr}, {q('|'.join(f'(?:{p})' for p in patterns))})"


def _source(exts, skip=K.SKIP_DIRS) -> str:
    return (f"lower(regexp_extract(path, '(\\.[^./]+)$', 1)) IN ({', '.join(q(e) for e in exts)}) "
            f"AND NOT list_has_any(string_split(path, '/'), [{', '.join(q(d) for d in skip)}])")


_SPLIT = r"regexp_split_to_array(content, '\r\n|\n|\r')"
MANIFEST_SQL = f"""
, mf AS (SELECT repo, path, content, rank FROM v_repo_files JOIN (VALUES {_values([(i, p) for i, p in enumerate(K.MANIFESTS)])}) m(rank, pat)
       ON regexp_full_match(path, pat) WHERE content <> ''),
fw0 AS (SELECT repo, framework, language, min((rank, path, i)) AS place FROM mf
  JOIN (VALUES {_values([(i, *f) for i, f in enumerate(K.FRAMEWORKS)])}) s(i, pat, framework, language)
  ON regexp_matches(content, '(?i)' || pat) GROUP BY repo, framework, language),
fw AS (SELECT repo, framework, language, CAST(row_number() OVER (PARTITION BY repo ORDER BY place) AS INTEGER) AS seen FROM fw0),
dep0 AS (
  SELECT repo, 'node' AS ecosystem, path, list_concat(coalesce(json_keys(content, '$.dependencies'), []),
         coalesce(json_keys(content, '$.devDependencies'), [])) AS d FROM mf WHERE path = 'package.json'
  UNION ALL SELECT repo, 'php', path, coalesce(json_keys(content, '$.require'), []) FROM mf WHERE path = 'composer.json'
  UNION ALL SELECT repo, 'python', path, list_transform(list_filter({_SPLIT}, lambda x: x <> '' AND NOT starts_with(x, '#')),
         lambda x: trim(string_split(string_split(x, '==')[1], '>=')[1])) FROM mf
         WHERE regexp_full_match(path, 'Pipfile|requirements.*[.]txt')
  UNION ALL SELECT repo, 'go', path, list_transform(list_filter({_SPLIT}, lambda x: starts_with(x, chr(9)) AND contains(x, '/')),
         lambda x: regexp_extract(x, '^[[:space:]]*([^[:space:]]+)', 1)) FROM mf WHERE path = 'go.mod'),
dep AS (SELECT repo, ecosystem, path, unnest(generate_series(0, len(d) - 1)) AS pos, unnest(d) AS dependency FROM dep0)
"""


@register("detect_frameworks", VIEWS, MANIFEST_SQL + "SELECT repo, framework, language, seen FROM fw")
def q_detect_frameworks(spark, sf):
    """X29 over every manifest."""
    return N.detect_frameworks(_files(spark, sf))


_LANG = " ".join(f"WHEN regexp_full_match(path, {q(p)}) OR regexp_full_match(regexp_extract(path, '([^/]+)$', 1), {q(p)}) THEN {q(x)}"
                 for p, x in K.MANIFEST_LANGUAGE)


@register("repo_languages", VIEWS, MANIFEST_SQL + f"""
SELECT DISTINCT repo, language FROM (SELECT repo, CASE {_LANG} END AS language FROM mf
  UNION ALL SELECT repo, 'TypeScript' FROM dep WHERE ecosystem = 'node' AND contains(dependency, 'typescript')
  UNION ALL SELECT repo, language FROM fw) WHERE language IS NOT NULL
""")
def q_repo_languages(spark, sf):
    """X30."""
    return N.languages(_files(spark, sf))


@register("dependencies", VIEWS, MANIFEST_SQL + "SELECT repo, ecosystem, path, CAST(pos AS INTEGER) AS pos, dependency FROM dep")
def q_dependencies(spark, sf):
    """X31, uncut."""
    return N.dependencies(_files(spark, sf))


ANN_SQL = f"""
, an AS (SELECT repo, path AS file, annotation, language, implication FROM v_repo_files
  JOIN (VALUES {_values(K.ANNOTATIONS)}) s(pat, annotation, language, implication)
  ON regexp_matches(content, '(?i)' || pat) WHERE {_source(K.SOURCE_EXTS)})
"""


@register("annotation_scan", VIEWS, ANN_SQL + "SELECT * FROM an")
def q_annotation_scan(spark, sf):
    """X33 over every source file and whole contents."""
    return N.annotation_scan(_files(spark, sf))


@register("auth_mechanisms", VIEWS, ANN_SQL + f"""
SELECT DISTINCT repo, mechanism FROM (
  SELECT repo, mechanism FROM v_repo_files JOIN (VALUES {_values(K.AUTH)}) s(pat, mechanism) ON regexp_matches(content, '(?i)' || pat)
  WHERE {_whole('path', K.AUTH_FILES)}
  UNION ALL SELECT repo, mechanism FROM an JOIN (VALUES {_values(K.ANNOTATION_MECHANISM)}) m(k, mechanism) ON contains(annotation, k))
""")
def q_auth_mechanisms(spark, sf):
    """X32."""
    return N.auth_mechanisms(_files(spark, sf))


@register("public_endpoints", VIEWS, ANN_SQL + f"SELECT * FROM an WHERE {contains_any('annotation', K.PUBLIC_MARKERS)}")
def q_public_endpoints(spark, sf):
    """X36."""
    return N.public_endpoints(N.annotation_scan(_files(spark, sf)))


@register("role_constants", VIEWS, f"""
SELECT DISTINCT repo, kind, value FROM (
  SELECT repo, 'role' AS kind, unnest(regexp_extract_all(content, {q(K.ROLE_CONST_RE)}, 1)) AS value FROM v_repo_files WHERE {_source(K.ROLE_EXTS)}
  UNION ALL SELECT repo, 'permission', unnest(regexp_extract_all(content, {q(K.ROLE_CONST_RE)}, 2)) FROM v_repo_files
  WHERE {_source(K.ROLE_EXTS)}) WHERE value <> ''
""")
def q_role_constants(spark, sf):
    """X34, uncut."""
    return N.role_constants(_files(spark, sf))


_ROLE = " ".join(f"WHEN regexp_matches(l, {q('(?i)' + p)}) THEN trim(regexp_extract(l, {q('(?i)' + p)}, 1))" for p in K.ROLE_PATTERNS)
ROLE_SQL = f"""
, ro AS (SELECT DISTINCT repo, file, role FROM (SELECT repo, file, CASE {_ROLE} END AS role FROM (
    SELECT repo, path AS file, unnest({_SPLIT}) AS l FROM v_repo_files WHERE {_source(K.ROLE_EXTS)})) WHERE role IS NOT NULL)
"""


@register("endpoint_role_map", VIEWS, ROLE_SQL + "SELECT * FROM ro")
def q_endpoint_role_map(spark, sf):
    """X35 on source lines."""
    return N.endpoint_role_map(_files(spark, sf))


@register("endpoint_role_gap", VIEWS, ROLE_SQL + f"""
, {_MADE.strip()}
SELECT repo, id, method, path, file FROM me
WHERE regexp_matches(path, '(?i)admin|manage|internal|config|role|permission|delete|orders')
  AND NOT EXISTS (SELECT 1 FROM ro WHERE ro.repo = me.repo AND ro.file = me.file)
""")
def q_endpoint_role_gap(spark, sf):
    """J9."""
    eps = E.endpoint_inventory(I.view(spark, sf, "v_src_files"))
    return N.endpoint_role_gap(eps, N.endpoint_role_map(_files(spark, sf))).select("repo", "id", "method", "path", "file")


@register("policy_files", VIEWS, f"SELECT DISTINCT repo, path FROM v_repo_files WHERE {_whole('path', K.POLICY_FILES)}")
def q_policy_files(spark, sf):
    """X37."""
    return N.policy_files(_files(spark, sf))


_TOP = "CASE WHEN contains(path, '/') AND NOT starts_with(path, '.') THEN split_part(path, '/', 1) END"
ARCH_SQL = ", ar AS (" + " UNION ALL ".join(
    [f"SELECT DISTINCT repo, {i} AS pos, {q(n)} AS note FROM v_repo_files WHERE {in_list(_TOP, d)}"
     for i, (d, n) in enumerate(K.DIR_SIGNALS)]
    + [f"SELECT DISTINCT repo, {i + len(K.DIR_SIGNALS)}, {q(n)} FROM v_repo_files WHERE {contains_any('path', w)}"
       for i, (w, n) in enumerate(K.PATH_SIGNALS)]) + ")\n"


@register("architecture_signals", VIEWS, ARCH_SQL + "SELECT * FROM ar")
def q_architecture_signals(spark, sf):
    """X38."""
    return N.architecture_signals(_files(spark, sf))


_SKIPPED = f"list_has_any(string_split(path, '/'), [{', '.join(q(d) for d in K.QUEUE_SKIP_DIRS)}])"
ASYNC_SQL = f"""
, asy AS (SELECT repo, min(layer) AS layer, {q(K.ASYNC_NOTE)} AS note FROM (SELECT repo, CASE
    WHEN lower({_TOP}) IN ({', '.join(q(d) for d in K.QUEUE_DIRS)}) THEN 1
    WHEN NOT {_SKIPPED} AND list_has_any(list_transform(string_split(path, '/')[1:-2], lambda d: lower(d)), [{', '.join(q(d) for d in K.QUEUE_DIRS)}]) THEN 2
    WHEN {_source(K.SOURCE_EXTS, K.QUEUE_SKIP_DIRS)}
      AND regexp_matches(content, {q('(?i)' + '|'.join(f'(?:{p})' for p in K.QUEUE_PATTERNS))}) THEN 3 END AS layer
  FROM v_repo_files) WHERE layer IS NOT NULL GROUP BY repo)
"""


@register("async_signals", VIEWS, ASYNC_SQL + "SELECT * FROM asy")
def q_async_signals(spark, sf):
    """X39."""
    return N.async_signals(_files(spark, sf))


TENANT_SQL = f"""
, en AS (SELECT DISTINCT repo, array_to_string(p[1:i], '/') AS entry, p[i] AS name
       FROM (SELECT repo, string_split(path, '/') AS p, unnest(generate_series(1, len(string_split(path, '/')))) AS i FROM v_repo_files)),
th AS (SELECT repo, i, h, count(*) AS n FROM en JOIN (VALUES {_values([(i, h) for i, h in enumerate(K.TENANT_HINTS)])}) t(i, h)
       ON contains(name, h) GROUP BY repo, i, h),
tn AS (SELECT repo, 'tenant' AS kind, 'Multi-tenant indicator found: `' || arg_min(h, i) || '` in ' || CAST(arg_min(n, i) AS STRING)
         || ' locations' AS note FROM th GROUP BY repo
       UNION ALL SELECT repo, 'roles', 'RBAC/permission files detected: ' || string_agg(entry, ', ' ORDER BY entry) FROM (
         SELECT repo, entry, row_number() OVER (PARTITION BY repo ORDER BY entry) AS k FROM en
         WHERE {contains_any('name', K.ROLE_FILE_WORDS)}) WHERE k <= {K.ROLE_FILES_SHOWN} GROUP BY repo)
"""


@register("tenant_signals", VIEWS, TENANT_SQL + "SELECT * FROM tn")
def q_tenant_signals(spark, sf):
    """X40."""
    return N.tenant_signals(_files(spark, sf))


_TECH = " UNION ALL ".join(
    f"SELECT repo, {q(t)} AS tech FROM v_repo_files WHERE {in_list('path', m)} OR "
    + " OR ".join(f"starts_with(path, {q(x + '/')})" for x in m) for t, m in K.TECH_STACK)


@register("tech_stack", VIEWS, f"SELECT DISTINCT repo, tech FROM ({_TECH}) t")
def q_tech_stack(spark, sf):
    """X41."""
    return N.tech_stack(_files(spark, sf))


@register("security_notes", VIEWS, MANIFEST_SQL + ANN_SQL + TENANT_SQL + ARCH_SQL + ASYNC_SQL + f"""
SELECT repo, note, min(part) AS part FROM (
  SELECT repo, 'PHP version constraint: ' || v AS note, 0 AS part FROM (
    SELECT repo, CASE WHEN path = 'composer.json' THEN json_extract_string(content, '$.require.php') END AS v FROM mf) WHERE v IS NOT NULL
  UNION ALL SELECT repo, 'Containerized deployment detected: ' || path, 0 FROM mf
  WHERE regexp_full_match(path, 'Dockerfile|docker-compose[.]ya?ml')
  UNION ALL SELECT repo, '⚠️  `' || annotation || '` in `' || file || '` — ' || implication, 1 FROM an WHERE contains(implication, {q(K.WARNING)})
  UNION ALL SELECT repo, note, 1 FROM tn UNION ALL SELECT repo, note, 2 FROM ar UNION ALL SELECT repo, note, 2 FROM asy)
GROUP BY repo, note
""")
def q_security_notes(spark, sf):
    """A10."""
    return N.security_notes(_files(spark, sf))


def _first(names) -> str:
    return (f"fi AS (SELECT repo, arg_min(path, rank) AS path, arg_min(content, rank) AS content FROM v_repo_files "
            f"JOIN (VALUES {_values([(i, n) for i, n in enumerate(names)])}) n(rank, name) ON path = name GROUP BY repo)")


@register("env_keys", VIEWS, f"""
, {_first(K.ENV_FILES)}, k0 AS (SELECT repo, list_transform(list_filter({_SPLIT}, lambda x: contains(x, '=') AND NOT starts_with(trim(x), '#')),
    lambda x: trim(split_part(x, '=', 1))) AS k FROM fi)
SELECT repo, CAST(unnest(generate_series(0, len(k) - 1)) AS INTEGER) AS pos, unnest(k) AS key FROM k0
""")
def q_env_keys(spark, sf):
    """S8, uncut."""
    return N.env_keys(_files(spark, sf))


@register("manifest_info", VIEWS, f"""
, {_first(K.INFO_MANIFESTS)}
SELECT repo, path AS file, coalesce(CASE WHEN path IN ('package.json', 'composer.json') THEN json_extract_string(content, '$.name')
    WHEN path = 'pyproject.toml' THEN regexp_extract(content, 'name\\s*=\\s*["'']([\\w\\-]+)', 1) ELSE {_SPLIT}[1] END, '') AS name,
  coalesce(CASE WHEN path IN ('package.json', 'composer.json') THEN json_extract_string(content, '$.description') END, '') AS description
FROM fi
""")
def q_manifest_info(spark, sf):
    """S9."""
    return N.manifest_info(_files(spark, sf))


@register("readme", VIEWS, f", {_first(K.README_NAMES)} SELECT repo, path, content FROM fi")
def q_readme(spark, sf):
    """Whole texts."""
    return N.readme(_files(spark, sf))


@register("scan_profiles", VIEWS, " UNION ALL ".join(
    f"SELECT {q(p)} AS profile, repo, path FROM v_repo_files WHERE {_source(exts, skip)}" for p, (exts, skip) in PROFILES.items()))
def q_scan_profiles(spark, sf):
    """The files that each scan reads."""
    files, out = _files(spark, sf).select("repo", "path"), None
    for p in PROFILES:
        part = scan_source_files(files, p).select(F.lit(p).alias("profile"), "repo", "path")
        out = part if out is None else out.unionByName(part)
    return out
