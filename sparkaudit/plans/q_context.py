"""Registered queries: business-context documents -> context tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkaudit import catalogs as K
from sparkaudit.operators import context as X
from sparkaudit.plans import inputs as I
from sparkaudit.plans.q_classify import group_case
from sparkaudit.plans.registry import register
from sparkaudit.plans.sqlfrag import q

_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_UNQ = ("regexp_replace(regexp_replace(regexp_replace({0}, '^`+|`+$', '', 'g'), "
        "'^\"+|\"+$', '', 'g'), '^''+|''+$', '', 'g')")
_KINDS = " ".join(f"WHEN {' OR '.join(f'contains(title, {q(w)})' for w in kws)} THEN {q(k)}"
                  for k, kws in K.SECTION_KINDS)

ITEMS_SQL = f"""
, secs AS (SELECT doc_id, unnest(regexp_split_to_array(text, '(?m)^##\\s+')) AS sec FROM v_context_docs),
s2 AS (SELECT doc_id, lower(trim(regexp_extract(sec, '^([^\\r\\n]*)', 1))) AS title,
         regexp_replace(sec, '^[^\\r\\n]*(\\r\\n|\\n|\\r)?', '') AS body FROM secs WHERE trim(sec) <> ''),
s3 AS (SELECT doc_id, row_number() OVER () AS sec_id, CASE {_KINDS} ELSE NULL END AS kind, body FROM s2),
it0 AS (SELECT doc_id, kind, {_STRIP.format("unnest(regexp_split_to_array(body, '(?m)^###\\s+'))")} AS sub FROM s3),
it AS (SELECT doc_id, kind, {_STRIP.format("regexp_extract(sub, '^([^\\r\\n]*)', 1)")} AS heading,
         regexp_replace(sub, '^[^\\r\\n]*(\\r\\n|\\n|\\r)?', '') AS rest FROM it0 WHERE sub <> ''),
it2 AS (SELECT *, list_transform(list_filter(list_transform(regexp_split_to_array(rest, '\\r\\n|\\n|\\r'),
           lambda l: {_STRIP.format('l')}), lambda l: regexp_matches(l, {q(K.KV_RE)})),
           lambda l: {{'k': replace(lower({_STRIP.format(f"regexp_extract(l, {q(K.KV_RE)}, 1)")}), ' ', '_'),
                      'v': {_UNQ.format(_STRIP.format(f"regexp_extract(l, {q(K.KV_RE)}, 2)"))}}}) AS kv,
         CASE WHEN contains(heading, '::') THEN trim(split_part(heading, '::', 1)) ELSE '' END AS cls,
         CASE WHEN contains(heading, '::') THEN trim(substring(heading, instr(heading, '::') + 2)) ELSE trim(heading) END AS nm
       FROM it)
"""


def _kv(key: str) -> str:
    return f"nullif(list_filter(kv, lambda e: e.k = {q(key)})[-1].v, '')"


def _items(spark, sf):
    return X.items(X.sections(I.view(spark, sf, "v_context_docs")))


@register("context_sinks", ("v_context_docs",), ITEMS_SQL + f"""
SELECT * FROM (SELECT doc_id, trim(regexp_replace(coalesce({_kv('method')}, nm), '\\(.*\\)', '')) AS name,
  coalesce({_kv('class')}, cls) AS class,
  coalesce({_kv('vuln_type')}, nullif({group_case("lower(rest)", K.TEXT_VULN_GROUPS, "''")}, ''), 'unknown') AS vuln_type,
  coalesce({_kv('risk')}, {_kv('note')}, '') AS note, 'HIGH' AS confidence
FROM it2 WHERE kind = 'custom_sinks') t WHERE name <> ''
""")
def q_context_sinks(spark, sf):
    """X47 + X48 + X49 custom sinks."""
    return X.context_sinks(_items(spark, sf)).drop("sec_pos", "item_pos")


@register("context_sources", ("v_context_docs",), ITEMS_SQL + f"""
SELECT *, CASE WHEN list_reverse(string_split(list_reverse(string_split(class, chr(92)))[1], '.'))[1] <> ''
               THEN list_reverse(string_split(list_reverse(string_split(class, chr(92)))[1], '.'))[1] || '::' || name
               ELSE name END AS qualified
FROM (SELECT doc_id, trim(regexp_replace(coalesce({_kv('method')}, nm), '\\(.*\\)', '')) AS name,
  coalesce({_kv('class')}, cls) AS class, coalesce({_kv('source_type')}, 'unknown') AS source_type,
  coalesce({_kv('note')}, '') AS note
FROM it2 WHERE kind = 'custom_sources') t WHERE name <> ''
""")
def q_context_sources(spark, sf):
    """X49 sources + X51 qualified names."""
    return X.context_sources(_items(spark, sf)).drop("sec_pos", "item_pos")


@register("context_flows", ("v_context_docs",), ITEMS_SQL + f"""
SELECT * FROM (SELECT doc_id, heading AS description,
  coalesce({_kv('entry')}, trim(regexp_replace(heading, '\\s*\\(.*?\\)', '', 'g'))) AS entry,
  coalesce({_kv('risk')}, {_kv('impact')}, '') AS risk
FROM it2 WHERE kind = 'sensitive_flows') t WHERE entry <> ''
""")
def q_context_flows(spark, sf):
    """X49 sensitive flows."""
    return X.context_flows(_items(spark, sf)).drop("sec_pos", "item_pos")


def _first(*keys: str) -> str:
    return "coalesce(" + ", ".join(_kv(k) for k in keys) + ", {})"


_CALL = q(X.CALL_RE)
_LIST = "list_filter(list_transform(string_split(coalesce({0}, ''), ','), lambda p: " + _STRIP.format("p") + "), lambda p: p <> '')"
BULLETS_SQL = rf"""
, bl0 AS (SELECT doc_id, kind, {_STRIP.format(r"regexp_replace(" + _STRIP.format(r"unnest(regexp_split_to_array(body, '\r\n|\n|\r'))") + ", '^[-*•]+', '')")} AS line
         FROM s3 WHERE NOT regexp_matches(body, '(?m)^###\s+')),
bl AS (SELECT * FROM bl0 WHERE line <> '' AND NOT starts_with(line, '#')),
api AS (SELECT * FROM (
  SELECT doc_id, trim(regexp_replace({_first('name', 'method_name').format(f"nullif(regexp_extract(heading, {_CALL}, 1), ''), trim(heading)")}, '\(.*\)', '')) AS name,
    {_LIST.format(_first('params', 'param', 'parameters').format(f"regexp_extract(heading, {_CALL}, 2)"))} AS params,
    {_first('note', 'risk', 'description').format(r"''")} AS note FROM it2 WHERE kind = 'api_names'
  UNION ALL SELECT doc_id, {_STRIP.format(r"split_part(split_part(line, '(', 1), ':', 1)")},
    {_LIST.format(r"regexp_extract(line, '\(([^)]+)\)', 1)")},
    CASE WHEN contains(line, ':') AND NOT contains(split_part(line, ':', 1), '(') THEN {_STRIP.format(r"regexp_replace(line, '^[^:]*:', '')")} ELSE '' END
  FROM bl WHERE kind = 'api_names') t WHERE name <> ''),
fpb AS (SELECT *, regexp_matches(line, '^(\w+)\s*\(([^)]+)\)\s*:?\s*(.*)') AS called FROM bl WHERE kind = 'function_params'),
fp AS (SELECT * FROM (
  SELECT doc_id, coalesce(nullif(regexp_extract(heading, {_CALL}, 1), ''), trim(heading)) AS function,
    {_STRIP.format(_first('param', 'params').format(f"regexp_extract(heading, {_CALL}, 2)"))} AS param,
    {_first('taint_reason', 'taint', 'note', 'risk').format(r"''")} AS taint_reason FROM it2 WHERE kind = 'function_params'
  UNION ALL SELECT doc_id, CASE WHEN called THEN regexp_extract(line, '^(\w+)', 1) ELSE {_STRIP.format(r"split_part(line, ':', 1)")} END,
    unnest(CASE WHEN called THEN {_LIST.format(r"regexp_extract(line, '\(([^)]+)\)', 1)")} ELSE [''] END),
    CASE WHEN called THEN {_STRIP.format(r"regexp_extract(line, '^(\w+)\s*\(([^)]+)\)\s*:?\s*(.*)', 3)")}
         WHEN contains(line, ':') THEN {_STRIP.format(r"regexp_replace(line, '^[^:]*:', '')")} ELSE '' END FROM fpb) t WHERE function <> '')
"""


@register("context_api_names", ("v_context_docs",), ITEMS_SQL + BULLETS_SQL + """
SELECT doc_id, name, array_to_string(params, ',') AS params, note FROM api
""")
def q_context_api_names(spark, sf):
    """X50 API names."""
    secs = X.sections(I.view(spark, sf, "v_context_docs"))
    return X.context_api_names(secs, X.items(secs)).select("doc_id", "name", F.array_join("params", ",").alias("params"), "note")


@register("context_function_params", ("v_context_docs",), ITEMS_SQL + BULLETS_SQL + "SELECT doc_id, function, param, taint_reason FROM fp")
def q_context_function_params(spark, sf):
    """X50 function parameters."""
    secs = X.sections(I.view(spark, sf, "v_context_docs"))
    return X.context_function_params(secs, X.items(secs)).select("doc_id", "function", "param", "taint_reason")


def _entries(key: str) -> str:
    return (f"(SELECT doc_id, CAST(i AS INTEGER) AS pos, json_extract(j, '$.{key}[' || CAST(i AS STRING) || ']') AS e FROM (SELECT doc_id, j, "
            f"unnest(generate_series(0, CAST(coalesce(json_array_length(j, '$.{key}'), 0) AS BIGINT) - 1)) AS i FROM js))")


def _get(key: str, default: str = "''") -> str:
    return f"coalesce(json_extract_string(e, '$.{key}'), {default})"


_QUAL = "list_reverse(string_split(list_reverse(string_split(" + _get("class") + ", chr(92)))[1], '.'))[1]"
NORM_SQL = f"""
, js0 AS (SELECT doc_id, CASE WHEN starts_with(trim(text), '{{') AND json_valid(text) THEN text ELSE '{{}}' END AS j FROM v_context_docs),
js AS (SELECT * FROM js0 WHERE list_has_any(json_keys(j), [{', '.join(q(k) for k in K.CONTEXT_KEYS)}])),
nm AS (
  SELECT doc_id, 'custom_sinks' AS kind, pos, {_get('name')} AS name, {_get('confidence', "'HIGH'")} AS detail FROM {_entries('custom_sinks')} WHERE json_type(e) = 'OBJECT'
  UNION ALL SELECT doc_id, 'custom_sources', pos, CASE WHEN {_QUAL} <> '' THEN {_QUAL} || '::' ELSE '' END || {_get('name')}, {_get('note')}
    FROM {_entries('custom_sources')} WHERE json_type(e) = 'OBJECT'
  UNION ALL SELECT doc_id, 'sensitive_flows', pos, {_get('entry')}, {_get('description', _get('entry'))} FROM {_entries('sensitive_flows')} WHERE json_type(e) = 'OBJECT'
  UNION ALL SELECT doc_id, 'non_http_sources', pos, e ->> '$', '' FROM {_entries('non_http_sources')} WHERE json_type(e) = 'VARCHAR'
  UNION ALL SELECT * FROM (SELECT doc_id, 'api_names', pos, CASE WHEN json_type(e) = 'OBJECT' THEN {_get('name')} ELSE e ->> '$' END AS name, '' FROM {_entries('api_names')} WHERE json_type(e) IN ('OBJECT', 'VARCHAR')) WHERE name <> ''
  UNION ALL SELECT doc_id, 'function_params', pos, {_get('function')}, {_get('param')} FROM {_entries('function_params')}
    WHERE json_type(e) = 'OBJECT' AND {_get('function')} <> '')
"""


@register("normalize_context", ("v_context_docs",), NORM_SQL + "SELECT doc_id, kind, pos, name, detail FROM nm")
def q_normalize_context(spark, sf):
    """X47 JSON branch and X52."""
    return X.normalize_context(I.view(spark, sf, "v_context_docs"))


_SINKS = rf"""SELECT doc_id FROM (SELECT doc_id, trim(regexp_replace(coalesce({_kv('method')}, nm), '\(.*\)', '')) AS name
  FROM it2 WHERE kind = 'custom_sinks') t WHERE name <> ''"""
_SOURCES = rf"""SELECT doc_id, CASE WHEN simple <> '' THEN simple || '::' || name ELSE name END AS qualified FROM (
  SELECT doc_id, trim(regexp_replace(coalesce({_kv('method')}, nm), '\(.*\)', '')) AS name,
    list_reverse(string_split(list_reverse(string_split(coalesce({_kv('class')}, cls), chr(92)))[1], '.'))[1] AS simple
  FROM it2 WHERE kind = 'custom_sources') t WHERE name <> ''"""
_FLOWS = rf"""SELECT doc_id FROM (SELECT doc_id, coalesce({_kv('entry')}, trim(regexp_replace(heading, '\s*\(.*?\)', '', 'g'))) AS entry
  FROM it2 WHERE kind = 'sensitive_flows') t WHERE entry <> ''"""


@register("context_summary", ("v_context_docs",), ITEMS_SQL + BULLETS_SQL + NORM_SQL + f"""
, al AS (SELECT doc_id, 'custom_sinks' AS kind, NULL AS name FROM ({_SINKS})
  UNION ALL SELECT doc_id, 'custom_sources', NULL FROM ({_SOURCES}) UNION ALL SELECT doc_id, 'non_http_sources', qualified FROM ({_SOURCES})
  UNION ALL SELECT doc_id, 'sensitive_flows', NULL FROM ({_FLOWS}) UNION ALL SELECT doc_id, 'api_names', NULL FROM api
  UNION ALL SELECT doc_id, 'function_params', NULL FROM fp
  UNION ALL SELECT doc_id, 'notes', NULL FROM s3 WHERE kind = 'notes' AND trim(body) <> ''
  UNION ALL SELECT doc_id, 'doc', NULL FROM v_context_docs
  UNION ALL SELECT doc_id, kind, name FROM nm UNION ALL SELECT doc_id, 'non_http_sources', name FROM nm WHERE kind = 'custom_sources' AND name <> '')
SELECT doc_id, {', '.join(f"CAST(count(*) FILTER (WHERE kind = '{k}') AS BIGINT) AS {k}" if k != 'non_http_sources' else
                          "CAST(count(DISTINCT name) FILTER (WHERE kind = 'non_http_sources') AS BIGINT) AS non_http_sources" for k in X.LISTS)},
  bool_or(kind = 'notes') AS has_notes FROM al GROUP BY doc_id
""")
def q_context_summary(spark, sf):
    """A9 per-document counts."""
    return X.context_summary(I.view(spark, sf, "v_context_docs"))
