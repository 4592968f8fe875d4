"""Registered queries: endpoint inventory over the source-file corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkaudit import catalogs as K
from sparkaudit.functions.core import join_sorted
from sparkaudit.operators import endpoints as E
from sparkaudit.plans import inputs as I
from sparkaudit.plans.registry import register
from sparkaudit.plans.sqlfrag import q

_EXTS = [e for v in K.LANG_EXTS.values() for e in v]
_SPLIT = r"'\r\n|\n|\r'"

# Route-level oracle: method, path, file, line, framework and id per endpoint.
ROUTES_SQL = f"""
f AS (SELECT repo, path AS file, content,
        lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS ext
      FROM v_src_files
      WHERE NOT list_has_any(string_split(path, '/'), [{', '.join(q(d) for d in K.API_SKIP_DIRS)}])),
f2 AS (SELECT *, CASE WHEN regexp_matches(content, '(\\r\\n|\\n|\\r)$')
                      THEN regexp_split_to_array(content, {_SPLIT})[1:-2]
                      ELSE regexp_split_to_array(content, {_SPLIT}) END AS lines,
              ext = '.cs' AND regexp_matches(content, {q(K.CS_WEBMETHOD_RE)}) AS is_wm
       FROM f WHERE ext IN ({', '.join(q(e) for e in _EXTS)})),
f3 AS (SELECT *, regexp_replace(coalesce(list_filter(list_transform(lines[1:50],
                   lambda l: regexp_extract(l, {q(K.CS_BASE_ROUTE_RE)}, 1)), lambda x: x <> '')[1], ''), '^/+', '') AS cs_base
       FROM f2),
l AS (SELECT repo, file, ext, content, lines, is_wm, cs_base,
             unnest(lines) AS line, generate_subscripts(lines, 1) AS n FROM f3),
py AS (SELECT repo, file, n AS line, 'python' AS framework,
         regexp_extract(line, {q(K.PY_DECORATOR_RE)}, 1) AS path,
         unnest(CASE WHEN regexp_matches(line, {q(K.PY_MULTI_METHOD_RE)})
                THEN list_transform(string_split(regexp_extract(line, {q(K.PY_MULTI_METHOD_RE)}, 1), ','),
                                    lambda x: upper(regexp_replace(trim(x), '^["'']+|["'']+$', '', 'g')))
                ELSE [CASE WHEN regexp_extract(line, {q(K.PY_VERB_RE)}, 1) <> ''
                           THEN upper(regexp_extract(line, {q(K.PY_VERB_RE)}, 1)) ELSE 'GET' END] END) AS method,
         0 AS sub
       FROM l WHERE ext = '.py' AND regexp_matches(line, {q(K.PY_DECORATOR_RE)})),
jv AS (SELECT repo, file, n AS line, 'spring' AS framework,
         regexp_extract(line, {q(K.SPRING_MAPPING_RE)}, 2) AS path,
         CASE WHEN upper(regexp_extract(line, {q(K.SPRING_MAPPING_RE)}, 1)) = 'REQUEST' THEN 'GET'
              ELSE upper(regexp_extract(line, {q(K.SPRING_MAPPING_RE)}, 1)) END AS method, 0 AS sub
       FROM l WHERE ext = '.java' AND regexp_matches(line, {q(K.SPRING_MAPPING_RE)})),
ns AS (SELECT repo, file, line, framework, CASE WHEN p = '' THEN '/' ELSE p END AS path, method, sub FROM (
         SELECT repo, file, n AS line, 'nestjs' AS framework,
           regexp_extract(m.m, {q(K.NESTJS_RE)}, 2) AS p, upper(regexp_extract(m.m, {q(K.NESTJS_RE)}, 1)) AS method,
           m.i - 1 AS sub
         FROM (SELECT *, unnest(list_zip(regexp_extract_all(line, {q(K.NESTJS_RE)}, 0),
                                          generate_series(1, len(regexp_extract_all(line, {q(K.NESTJS_RE)}, 0))))) AS z
               FROM l WHERE ext IN ('.js', '.ts', '.cjs', '.mjs')) t,
              LATERAL (SELECT t.z[1] AS m, t.z[2] AS i) m) u),
ex AS (SELECT repo, file, n AS line, 'express' AS framework,
         regexp_extract(line, {q(K.JS_ROUTE_RE)}, 2) AS path,
         CASE WHEN upper(regexp_extract(line, {q(K.JS_ROUTE_RE)}, 1)) = 'USE' THEN 'ALL'
              ELSE upper(regexp_extract(line, {q(K.JS_ROUTE_RE)}, 1)) END AS method, 100 AS sub
       FROM l WHERE ext IN ('.js', '.ts', '.cjs', '.mjs') AND regexp_matches(line, {q(K.JS_ROUTE_RE)})),
go AS (SELECT repo, file, n AS line, 'gin' AS framework, regexp_extract(line, {q(K.GO_ROUTE_RE)}, 2) AS path,
         upper(regexp_extract(line, {q(K.GO_ROUTE_RE)}, 1)) AS method, 0 AS sub
       FROM l WHERE ext = '.go' AND regexp_matches(line, {q(K.GO_ROUTE_RE)})),
php AS (SELECT repo, file, n AS line, 'laravel' AS framework, regexp_extract(line, {q(K.PHP_ROUTE_RE)}, 2) AS path,
         upper(regexp_extract(line, {q(K.PHP_ROUTE_RE)}, 1)) AS method, 0 AS sub
       FROM l WHERE ext = '.php' AND regexp_matches(line, {q(K.PHP_ROUTE_RE)})),
rb0 AS (SELECT repo, file, n AS line, lower(regexp_extract(line, {q(K.RAILS_ROUTE_RE)}, 1)) AS verb,
          regexp_extract(line, {q(K.RAILS_ROUTE_RE)}, 2) AS p
        FROM l WHERE ext = '.rb' AND regexp_matches(line, {q(K.RAILS_ROUTE_RE)})),
rb AS (SELECT repo, file, line, 'rails' AS framework, p AS path, upper(verb) AS method, 0 AS sub
         FROM rb0 WHERE verb NOT IN ('resources', 'resource')
       UNION ALL
       SELECT repo, file, line, 'rails', x.pth, x.mth, x.sub FROM rb0,
         (SELECT * FROM (VALUES ('GET', '', 0), ('POST', '', 1), ('GET', '/{{id}}', 2), ('PUT', '/{{id}}', 3),
                                ('DELETE', '/{{id}}', 4)) v(mth, suffix, sub)) s0,
         LATERAL (SELECT s0.mth AS mth, '/' || rb0.p || s0.suffix AS pth, s0.sub AS sub) x
       WHERE verb IN ('resources', 'resource')),
cs AS (SELECT repo, file, n AS line, 'aspnet' AS framework,
         '/' || array_to_string(list_filter([CASE WHEN cs_base <> '' THEN regexp_replace(cs_base, '/+$', '') END,
             CASE WHEN regexp_extract(line, {q(K.CS_ROUTE_RE)}, 2) <> ''
                  THEN regexp_replace(regexp_extract(line, {q(K.CS_ROUTE_RE)}, 2), '^/+', '') END],
             lambda x: x IS NOT NULL), '/') AS path,
         upper(regexp_extract(line, {q(K.CS_ROUTE_RE)}, 1)) AS method, 0 AS sub
       FROM l WHERE ext = '.cs' AND NOT is_wm AND regexp_matches(line, {q(K.CS_ROUTE_RE)})),
wm0 AS (SELECT repo, file, n, list_filter(list_transform(generate_series(1, 4),
           lambda i: CASE WHEN regexp_matches(coalesce(lines[n + i], ''), {q(K.CS_METHOD_SIG_RE)}) THEN i END),
           lambda i: i IS NOT NULL) AS js, lines
        FROM l WHERE ext = '.cs' AND is_wm AND regexp_matches(line, {q(K.CS_WEBMETHOD_RE)})),
wm AS (SELECT repo, file, n + js[1] AS line, 'asmx_webmethod' AS framework,
         '/' || regexp_extract(lines[n + js[1]], {q(K.CS_METHOD_SIG_RE)}, 1) AS path, 'POST' AS method, 0 AS sub
       FROM wm0 WHERE len(js) > 0),
eps AS (SELECT * FROM py UNION ALL SELECT * FROM jv UNION ALL SELECT * FROM ns UNION ALL SELECT * FROM ex
        UNION ALL SELECT * FROM go UNION ALL SELECT * FROM php UNION ALL SELECT * FROM rb
        UNION ALL SELECT * FROM cs UNION ALL SELECT * FROM wm),
ided AS (SELECT *, substring(md5(method || ':' || path || ':' || file || ':' || CAST(line AS STRING)), 1, 12) AS id
         FROM eps),
routes AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, id ORDER BY file, line, sub) AS rn
                          FROM ided) t WHERE rn = 1)
"""


def _eps(spark, sf):
    return E.endpoint_inventory(I.view(spark, sf, "v_src_files"))


@register("endpoint_routes", ("v_src_files",), f"""
, {ROUTES_SQL.strip()}
SELECT repo, id, method, path, file, CAST(line AS INTEGER) AS line, framework FROM routes
""")
def q_endpoint_routes(spark, sf):
    """X1-X9 + X22 route level (method, path, file, line, framework, id)."""
    return _eps(spark, sf).select("repo", "id", "method", "path", "file", "line", "framework")


# Full records, known from how each file is made (not parsed): one SELECT per endpoint of a template.
_MADE = """
mk AS (SELECT v.repo, v.path AS file, v.page_id AS id0, v.page_id % 9 AS k,
         regexp_replace(regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1), '/[0-9]+', '/{item_id}') AS rp
       FROM v_src_files v JOIN pages p ON p.page_id = v.page_id
       WHERE v.page_id % 23 <> 0),
mp AS (SELECT *, CASE WHEN contains(rp, '{item_id}') THEN 'item_id:string:path,' ELSE '' END AS pp FROM mk WHERE rp <> ''),
made AS (
  SELECT repo, file, 4 AS line, 'python' AS framework, m AS method, rp AS path, 'handler_' || CAST(id0 AS STRING) AS handler,
         pp || 'item_id:int:path,user_id:int:query' AS params,
         CASE WHEN id0 % 4 = 1 THEN '@login_required|' ELSE '' END || 'Depends(get_current_user)' AS auth_tags
  FROM (SELECT *, unnest(CASE WHEN id0 % 2 = 0 THEN ['GET'] ELSE ['GET', 'POST'] END) AS m FROM mp WHERE k = 0)
  UNION ALL
  SELECT repo, file, 5, 'spring', 'GET', rp, 'order', pp || 'item_id:string:path,sort_key:string:query,auth:string:header',
         CASE WHEN id0 % 2 = 0 THEN '@PreAuthorize("hasRole(ADMIN)|' ELSE '' END || '@Secured("ROLE_USER")' FROM mp WHERE k = 1
  UNION ALL
  SELECT repo, file, 10, 'spring', 'GET', '/orders/{orderId}', 'order', 'orderId:string:path,auth:string:header',
         CASE WHEN id0 % 2 = 0 THEN '@PreAuthorize("hasRole(ADMIN)|' ELSE '' END || '@Secured("ROLE_USER")' FROM mk WHERE k = 1
  UNION ALL
  SELECT repo, file, 4, 'nestjs', 'GET', rp, '', rtrim(pp, ','),
         CASE WHEN id0 % 2 = 0 THEN '@UseGuards(AuthGuard)|' ELSE '' END || '@Public()' FROM mp WHERE k = 2
  UNION ALL
  SELECT repo, file, 7, 'nestjs', 'POST', '/', '', '',
         CASE WHEN id0 % 2 = 0 THEN '@UseGuards(AuthGuard)|' ELSE '' END || '@Public()' FROM mk WHERE k = 2
  UNION ALL
  SELECT repo, file, 2, 'express', 'GET', rp, '', pp || 'item_id:string:path,order_id:string:query',
         'express_mw:authenticate|express_mw:isAdmin' FROM mp WHERE k = 3
  UNION ALL
  SELECT repo, file, 8, 'express', 'ALL', '/static' || CAST(id0 AS STRING), '', '', '' FROM mk WHERE k = 3
  UNION ALL
  SELECT repo, file, 2, 'gin', 'GET', rp, '', pp || 'item_id:string:path,page:string:query', '' FROM mp WHERE k = 4
  UNION ALL
  SELECT repo, file, 7, 'gin', 'POST', '/items/:itemId/pay', '', 'itemId:string:path', '' FROM mk WHERE k = 4
  UNION ALL
  SELECT repo, file, 3, 'laravel', 'GET', rp, '', rtrim(pp, ','), 'middleware:can:update' FROM mp WHERE k = 5
  UNION ALL
  SELECT repo, file, 4, 'laravel', 'POST', '/orders/{order_id}', '', 'order_id:string:path', 'middleware:can:update'
  FROM mk WHERE k = 5
  UNION ALL
  SELECT repo, file, 6, 'laravel', 'DELETE', '/pub/' || CAST(id0 AS STRING), '', '', 'middleware:can:update' FROM mk WHERE k = 5
  UNION ALL
  SELECT repo, file, 5, 'rails', v.m, '/items' || CAST(id0 AS STRING) || v.t, '',
         CASE WHEN v.t = '' THEN '' ELSE 'id:string:path' END, 'before_action:authenticate_user|before_action:set_item'
  FROM mk, (VALUES ('GET', ''), ('POST', ''), ('GET', '/{id}'), ('PUT', '/{id}'), ('DELETE', '/{id}')) v(m, t) WHERE k = 6
  UNION ALL
  SELECT repo, file, 6, 'rails', 'GET', rp, '', rtrim(pp, ','), 'before_action:authenticate_user|before_action:set_item'
  FROM mp WHERE k = 6
  UNION ALL
  SELECT repo, file, 4, 'aspnet', 'GET', '/api/items' || CASE WHEN length(rp) > 1 THEN rp ELSE '' END, '',
         pp || 'item_id:string:path,customerId:string:query,item:string:body',
         CASE WHEN id0 % 2 = 0 THEN '[Authorize(Roles = "Admin")]' ELSE '' END FROM mk2
  UNION ALL
  SELECT repo, file, 8, 'aspnet', 'POST', '/api/items', '', 'item:string:body',
         CASE WHEN id0 % 2 = 0 THEN '[Authorize(Roles = "Admin")]' ELSE '' END FROM mk WHERE k = 7
  UNION ALL
  SELECT repo, file, 4, 'asmx_webmethod', 'POST', '/GetItem' || CAST(id0 AS STRING), '', 'itemId:string:soap,token:string:soap',
         '[Authorize]' FROM mk WHERE k = 8),
me AS (SELECT *, substring(md5(method || ':' || path || ':' || file || ':' || CAST(line AS STRING)), 1, 12) AS id,
         CASE WHEN auth_tags = '' THEN NULL ELSE NOT contains(auth_tags, 'Public') END AS auth_required FROM made)
""".replace("FROM mk2", "FROM (SELECT *, CASE WHEN contains(rp, '{item_id}') THEN 'item_id:string:path,' ELSE '' END AS pp "
            "FROM mk WHERE k = 7)")

_ID_PARAMS = (f"list_sort(list_transform(list_filter(string_split(params, ','), lambda p: split_part(p, ':', 3) IN ('path', 'query') "
              f"AND regexp_matches(split_part(p, ':', 1), {q(K.IDOR_PARAM_RE)})), lambda p: split_part(p, ':', 1)))")


@register("endpoint_inventory", ("v_src_files",), f"""
, {_MADE.strip()}
SELECT repo, id, method, path, file, line, framework, handler, params, auth_tags, auth_required FROM me
""")
def q_endpoint_inventory(spark, sf):
    """X22 full records: params, handler, tags, tri-state auth (compare form)."""
    e = _eps(spark, sf)
    return e.select("repo", "id", "method", "path", "file", "line", "framework", "handler",
                    F.array_join(F.transform("params", lambda p: F.concat_ws(":", p["name"], p["type"], p["location"])),
                                 ",").alias("params"),
                    F.array_join("auth_tags", "|").alias("auth_tags"), "auth_required")


@register("idor_candidates", ("v_src_files",), f"""
, {_MADE.strip()}
SELECT repo, id, method, path, array_to_string({_ID_PARAMS}, ',') AS id_params, file, line FROM me
WHERE len({_ID_PARAMS}) > 0 AND NOT ({' OR '.join(f"contains(auth_tags, {q(m)})" for m in K.OWNERSHIP_MARKERS)})
""")
def q_idor_candidates(spark, sf):
    """F9."""
    return E.idor_candidates(_eps(spark, sf)).select(
        "repo", "id", "method", "path", join_sorted(F.col("id_params")).alias("id_params"), "file", "line")


@register("unauthenticated_endpoints", ("v_src_files",), f"""
, {_MADE.strip()}
SELECT repo, id, method, path, file, line FROM me
WHERE auth_tags = '' OR contains(auth_tags, 'Public') OR contains(auth_tags, 'AllowAnonymous')
""")
def q_unauthenticated_endpoints(spark, sf):
    """F10."""
    return E.unauthenticated_endpoints(_eps(spark, sf)).select("repo", "id", "method", "path", "file", "line")
