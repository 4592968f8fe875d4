"""Endpoint extraction from a source-file corpus.

One corpus job over many repositories.  Extraction is narrow: no shuffle until
the final de-duplication by id.

    files (repo, path, content)
      -> files that hold a route (one combined regex), written once
      -> per language: numbers of its route lines, then one row per route line
      -> endpoint structs (array functions over line windows of that language)
      -> explode -> id, auth_required -> dedupe by id (first by file, line)

Each language is a projection of its own, which keeps generated code small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkaudit import catalogs as K
from sparkaudit.functions.core import map_lookup, nonempty
from sparkaudit.session import checkpointed

LINE_SPLIT = r"\r\n|\n|\r"
PARAM_T = "array<struct<name:string,type:string,location:string>>"
STR_ARR = "array<string>"
EP_T = (f"array<struct<method:string,path:string,handler:string,params:{PARAM_T},"
        f"framework:string,auth_tags:array<string>,line:int,sub:int>>")


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _at(lines: Column, i: Column) -> Column:
    return F.try_element_at(lines, i.cast("int"))


def window(lines: Column, lo: Column, hi: Column) -> Column:
    """Lines lo..hi (1-based, inclusive, clipped to the file)."""
    lo_c = F.greatest(lo, F.lit(1))
    hi_c = F.least(hi, F.size(lines))
    return F.when(hi_c >= lo_c, F.slice(lines, lo_c, hi_c - lo_c + 1)).otherwise(
        F.array().cast(STR_ARR))


def param(name: Column, typ, loc) -> Column:
    return F.struct(name.alias("name"), (typ if isinstance(typ, Column) else F.lit(typ)).alias("type"),
                    (loc if isinstance(loc, Column) else F.lit(loc)).alias("location"))


# --- X10 path params -------------------------------------------------------
def path_params(path: Column) -> Column:
    ms = F.regexp_extract_all(path, F.lit(K.PATH_PARAM_RE), 0)
    return F.transform(ms, lambda m: param(F.regexp_replace(m, r"^[{:<](?:\w+:)?|[}>]$", ""),
                                           "string", "path"))


# --- X17 local auth tags ------------------------------------------------------
def line_tags(l: Column) -> Column:
    ann = F.regexp_extract_all(l, F.lit(K.AUTH_ANN_RE), 0)
    mw = F.transform(F.regexp_extract_all(l, F.lit(K.PHP_MIDDLEWARE_RE), 1),
                     lambda x: F.concat(F.lit("middleware:"), _strip(x)))
    dep = F.transform(F.regexp_extract_all(l, F.lit(K.FASTAPI_DEPENDS_RE), 1),
                      lambda x: F.concat(F.lit("Depends("), x, F.lit(")")))
    return F.concat(ann, mw, dep)


def tags_in(win: Column) -> Column:
    """Distinct tags, first-seen order, over a window of lines."""
    return F.array_distinct(F.flatten(F.transform(win, line_tags)))


def local_auth_tags(lines: Column, n: Column, variant: str = "default") -> Column:
    if variant == "csharp":          # lines n-8 .. n
        return tags_in(window(lines, n - 8, n))
    if variant == "webmethod":       # the 8 lines before the attribute line
        return tags_in(window(lines, n - 8, n - 1))
    return tags_in(window(lines, n - 7, n + 6))


# --- X18 class auth tags ------------------------------------------------------
def class_lines(lines: Column) -> tuple[Column, Column]:
    """Numbers of the controller lines and of all class lines of a file (computed once per file)."""
    numbered = F.transform(lines, lambda l, i: F.struct((i + 1).alias("i"), l.alias("l")))

    def where(test):
        return F.transform(F.filter(numbered, lambda x: test(x["l"])), lambda x: x["i"])
    return (where(lambda l: l.rlike(K.SPRING_CLASS_RE) | l.rlike(K.NESTJS_CONTROLLER_RE)),
            where(lambda l: l.rlike(K.CLASS_KW_RE)))


def class_auth_tags(lines: Column, n: Column) -> Column:
    """Tags over the nearest class above line ``n`` (needs ``controllers`` and ``classes`` of the file)."""
    idx = F.greatest(F.array_max(F.filter(F.col("controllers"), lambda i: i <= n - 1)),
                     F.array_max(F.filter(F.col("classes"), lambda i: i < n - 1)))
    return F.when(idx.isNull(), F.array().cast(STR_ARR)).otherwise(
        F.array_distinct(F.flatten(F.transform(window(lines, idx - 10, idx),
                                               lambda l: F.regexp_extract_all(l, F.lit(K.AUTH_ANN_RE), 0)))))


# --- X19 PHP route-group middleware -----------------------------------------------
def _count(l: Column, ch: str) -> Column:
    return F.length(l) - F.length(F.replace(l, F.lit(ch), F.lit("")))


def php_group_auth_tags(lines: Column, n: Column) -> Column:
    """Walk up from the route line (never line 1, at most 59 lines) tracking
    brace depth; on depth < 0 take ``->middleware(`` tags and reset."""
    lo = F.greatest(n - 58, F.lit(2))
    walk = F.reverse(window(lines, lo, n))
    init = F.struct(F.lit(0).alias("d"), F.array().cast(STR_ARR).alias("t"))

    def step(acc, l):
        d = acc["d"] + _count(l, "}") - _count(l, "{")
        mw = F.transform(F.regexp_extract_all(l, F.lit(K.PHP_MIDDLEWARE_RE), 1),
                         lambda x: F.concat(F.lit("middleware:"), _strip(x)))
        return F.when(d < 0, F.struct(F.lit(0).alias("d"), F.concat(acc["t"], mw).alias("t"))
                      ).otherwise(F.struct(d.alias("d"), acc["t"].alias("t")))
    return F.array_distinct(F.aggregate(walk, init, step)["t"])


# --- X20 express middleware, X21 rails before_action ---------------------------------
def express_middleware_tags(line: Column) -> Column:
    raw = F.regexp_extract(line, K.EXPRESS_MW_ARGS_RE, 1)
    parts = F.transform(F.split(raw, ","), lambda p: _strip(p))
    keep = F.filter(parts, lambda p: nonempty(p) & ~p.startswith("(") & ~p.startswith("async")
                    & (F.length(p) > 2))
    return F.transform(keep, lambda p: F.concat(F.lit("express_mw:"), p))


def rails_before_actions(content: Column) -> Column:
    return F.transform(F.regexp_extract_all(content, F.lit(K.RAILS_BEFORE_ACTION_RE), 1),
                       lambda a: F.concat(F.lit("before_action:"), a))


# --- helpers for "scan forward until a break line" (X12, X15) ----------------------
def until_break(win: Column, break_re: str) -> Column:
    """Lines of ``win`` up to and including the first line (after the first)
    matching ``break_re``."""
    stop = F.array_min(F.filter(F.sequence(F.lit(2), F.greatest(F.size(win), F.lit(2))),
                                lambda i: (i <= F.size(win)) & _at(win, i).rlike(break_re)))
    return F.when(stop.isNull(), win).otherwise(F.slice(win, 1, stop))


def _ep(method, path, handler, params, framework, tags, line, sub=None) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    sub = F.lit(0) if sub is None else sub
    return F.struct(lit(method).cast("string").alias("method"), lit(path).cast("string").alias("path"),
                    lit(handler).cast("string").alias("handler"), params.cast(PARAM_T).alias("params"),
                    lit(framework).alias("framework"), tags.cast(STR_ARR).alias("auth_tags"),
                    line.cast("int").alias("line"), sub.cast("int").alias("sub"))


# --- per-language generators (each returns array<endpoint struct>) -----------------
def _python(lines, n, line, stack, route_as_get=False):
    s = F.trim(line)
    path = F.regexp_extract(s, K.PY_DECORATOR_RE, 1)
    multi = F.regexp_extract(s, K.PY_MULTI_METHOD_RE, 1)
    verb = F.regexp_extract(s, K.PY_VERB_RE, 1)
    if route_as_get:
        verb = F.when(F.lower(verb) != "route", verb).otherwise("")
    methods = F.when(s.rlike(K.PY_MULTI_METHOD_RE),
                     F.transform(F.split(multi, ","), lambda x: F.regexp_replace(_strip(x), "^[\"']+|[\"']+$", ""))
                     ).otherwise(F.array(F.when(verb != "", F.upper(verb)).otherwise(F.lit("GET"))))
    handler = F.coalesce(F.try_element_at(F.filter(
        F.transform(window(lines, n + 1, n + 5), lambda l: F.regexp_extract(l, K.PY_DEF_RE, 1)),
        lambda h: h != ""), F.lit(1)), F.lit(""))
    # X11: from the first line with "def " (within 20 lines) up to the first
    # line holding ':' that does not end with ','.
    w = window(lines, n + 1, n + 20)
    seq = F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1)))
    d0 = F.array_min(F.filter(seq, lambda i: (i <= F.size(w)) & _at(w, i).contains("def ")))
    d1 = F.array_min(F.filter(seq, lambda i: (i <= F.size(w)) & (i >= d0) & _at(w, i).contains(":")
                              & ~_at(w, i).rlike(r",\s*$")))
    fn_text = F.when(d0.isNull(), F.lit("")).otherwise(
        F.array_join(F.slice(w, d0, F.coalesce(d1, F.size(w)) - d0 + 1), " "))
    fa = F.regexp_extract_all(fn_text, F.lit(K.PY_PARAM_RE), 0)
    fparams = F.transform(fa, lambda m: param(F.regexp_extract(m, K.PY_PARAM_RE, 1),
                                              F.regexp_extract(m, K.PY_PARAM_RE, 2),
                                              F.lower(F.regexp_extract(m, K.PY_PARAM_RE, 3))))
    params = F.concat(path_params(path), fparams)
    tags = local_auth_tags(lines, n)
    return F.transform(methods, lambda m, i: _ep(F.upper(m), path, handler, params, stack, tags, n, i))


def _java(lines, n, line, content):
    m0 = F.regexp_extract(line, K.SPRING_MAPPING_RE, 0)
    meth = F.upper(F.regexp_extract(line, K.SPRING_MAPPING_RE, 1))
    meth = F.when(meth == "REQUEST", "GET").otherwise(meth)
    path = F.regexp_extract(line, K.SPRING_MAPPING_RE, 2)
    win = until_break(window(lines, n + 1, n + 30), K.JAVA_SIG_RE)
    loc = lambda a: map_lookup(F.lower(a), K.SPRING_PARAM_LOC, "query")
    sp = F.transform(F.filter(win, lambda l: l.rlike(K.SPRING_PARAM_RE)),
                     lambda l: param(F.regexp_extract(l, K.SPRING_PARAM_RE, 2), "string",
                                     loc(F.regexp_extract(l, K.SPRING_PARAM_RE, 1))))
    after = F.substring(content, F.position(m0, content), 1 << 30)
    handler = F.regexp_extract(after, K.JAVA_SIG_RE, 2)
    tags = F.array_distinct(F.concat(local_auth_tags(lines, n), class_auth_tags(lines, n)))
    return F.array(_ep(meth, path, handler, F.concat(path_params(path), sp), F.lit("spring"), tags, n))


def _nest(lines, n, line):
    ms = F.regexp_extract_all(line, F.lit(K.NESTJS_RE), 0)
    tags = F.array_distinct(F.concat(local_auth_tags(lines, n), class_auth_tags(lines, n)))

    def one(m, i):
        p = F.regexp_extract(m, K.NESTJS_RE, 2)
        return _ep(F.upper(F.regexp_extract(m, K.NESTJS_RE, 1)), F.when(p == "", "/").otherwise(p), "",
                   path_params(p), F.lit("nestjs"), tags, n, i)
    return F.transform(ms, one)


def _express(lines, n, line, route=K.JS_ROUTE_RE):
    meth = F.upper(F.regexp_extract(line, route, 1))
    meth = F.when(meth == "USE", "ALL").otherwise(meth)
    path = F.regexp_extract(line, route, 2)
    acc = F.flatten(F.transform(window(lines, n + 1, n + 40),
                                lambda l: F.regexp_extract_all(l, F.lit(K.JS_PARAM_RE), 0)))
    pairs = F.array_distinct(F.transform(acc, lambda m: F.struct(
        F.regexp_extract(m, K.JS_PARAM_RE, 2).alias("n"), F.regexp_extract(m, K.JS_PARAM_RE, 1).alias("l"))))
    jp = F.transform(pairs, lambda p: param(p["n"], "string", map_lookup(p["l"], K.JS_PARAM_LOC, "query")))
    tags = F.array_distinct(F.concat(local_auth_tags(lines, n), express_middleware_tags(line)))
    return F.array(_ep(meth, path, "", F.concat(path_params(path), jp), F.lit("express"), tags, n, F.lit(100)))


def _go(lines, n, line):
    meth = F.upper(F.regexp_extract(line, K.GO_ROUTE_RE, 1))
    path = F.regexp_extract(line, K.GO_ROUTE_RE, 2)
    gp = F.flatten(F.transform(window(lines, n + 1, n + 40), lambda l: F.concat(
        F.transform(F.regexp_extract_all(l, F.lit(K.GO_QUERY_RE), 1), lambda x: param(x, "string", "query")),
        F.transform(F.regexp_extract_all(l, F.lit(K.GO_PARAM_RE), 1), lambda x: param(x, "string", "path")))))
    return F.array(_ep(meth, path, "", F.concat(path_params(path), gp), F.lit("gin"),
                       local_auth_tags(lines, n), n))


def _php(lines, n, line):
    meth = F.upper(F.regexp_extract(line, K.PHP_ROUTE_RE, 1))
    path = F.regexp_extract(line, K.PHP_ROUTE_RE, 2)
    tags = F.array_distinct(F.concat(local_auth_tags(lines, n), php_group_auth_tags(lines, n)))
    return F.array(_ep(meth, path, "", path_params(path), F.lit("laravel"), tags, n))


def _ruby(lines, n, line, content):
    verb = F.lower(F.regexp_extract(line, K.RAILS_ROUTE_RE, 1))
    path = F.regexp_extract(line, K.RAILS_ROUTE_RE, 2)
    tags = rails_before_actions(content)
    base = F.concat(F.lit("/"), path)
    rid = F.concat(base, F.lit("/{id}"))
    res = F.array(*[_ep(F.lit(m), p, "", path_params(p), F.lit("rails"), tags, n, F.lit(i))
                    for i, (m, p) in enumerate([("GET", base), ("POST", base), ("GET", rid),
                                                ("PUT", rid), ("DELETE", rid)])])
    single = F.array(_ep(F.upper(verb), path, "", path_params(path), F.lit("rails"), tags, n))
    return F.when(verb.isin("resources", "resource"), res).otherwise(single)


def _csharp(lines, n, line, base):
    meth = F.upper(F.regexp_extract(line, K.CS_ROUTE_RE, 1))
    sub = F.regexp_extract(line, K.CS_ROUTE_RE, 2)
    parts = F.array_compact(F.array(F.when(base != "", F.regexp_replace(base, "/+$", "")),
                                    F.when(sub != "", F.regexp_replace(sub, "^/+", ""))))
    full = F.concat(F.lit("/"), F.array_join(parts, "/"))
    win = until_break(window(lines, n + 1, n + 15), K.CS_MODIFIER_RE)
    cp = F.flatten(F.transform(win, lambda l: F.transform(
        F.regexp_extract_all(l, F.lit(K.CS_PARAM_RE), 0),
        lambda m: param(F.regexp_extract(m, K.CS_PARAM_RE, 2), "string",
                        map_lookup(F.regexp_extract(m, K.CS_PARAM_RE, 1), K.CS_PARAM_LOC, "query")))))
    return F.array(_ep(meth, full, "", F.concat(path_params(full), cp), F.lit("aspnet"),
                       local_auth_tags(lines, n, "csharp"), n))


def _webmethod(lines, n):
    """Attribute on line n; signature within the next 4 lines."""
    w = window(lines, n + 1, n + 4)
    j = F.array_min(F.filter(F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1))),
                             lambda i: (i <= F.size(w)) & _at(w, i).rlike(K.CS_METHOD_SIG_RE)))
    sig = _at(w, F.coalesce(j, F.lit(1)))
    name = F.regexp_extract(sig, K.CS_METHOD_SIG_RE, 1)
    raw = F.regexp_extract(sig, K.CS_METHOD_SIG_RE, 2)
    ps = F.filter(F.transform(F.split(raw, ","), lambda p: _strip(p)), lambda p: p != "")
    params = F.transform(ps, lambda p: param(F.element_at(F.split(p, r"\s+"), -1), "string", "soap"))
    ep = _ep(F.lit("POST"), F.concat(F.lit("/"), name), "", params, F.lit("asmx_webmethod"),
             local_auth_tags(lines, n, "webmethod"), n + j)
    return F.when(j.isNull(), F.array().cast(EP_T)).otherwise(F.array(ep))


# --- S1 corpus filter -----------------------------------------------------------------
def api_source_files(files: DataFrame, path_col: str = "path") -> DataFrame:
    """S1 (api profile): extension allow-list and skip dirs on relative parts."""
    exts = [e for v in K.LANG_EXTS.values() for e in v]
    ext = F.lower(F.regexp_extract(F.col(path_col), r"(\.[^./]+)$", 1))
    parts = F.split(F.col(path_col), "/")
    skip = F.array(*[F.lit(d) for d in K.API_SKIP_DIRS])
    return files.where(ext.isin(*exts) & ~F.arrays_overlap(parts, skip)).withColumn("ext", ext)


ROUTE_ANY = "|".join(f"(?:{p})" for p in [
    K.PY_DECORATOR_RE, K.SPRING_MAPPING_RE, K.NESTJS_RE, K.JS_ROUTE_RE, K.GO_ROUTE_RE,
    K.PHP_ROUTE_RE, K.RAILS_ROUTE_RE, K.CS_ROUTE_RE, K.CS_WEBMETHOD_RE])


def _route_lines(files: DataFrame, exts: list[str], regex: str, trimmed: bool = False) -> DataFrame:
    """One row per line that matches: the numbers of such lines are kept first, then exploded."""
    f = files.where(F.col("ext").isin(*exts))
    hits = F.filter(F.transform("lines", lambda l, i: F.struct((i + 1).cast("int").alias("n"), l.alias("line"))),
                    lambda x: (F.trim(x["line"]) if trimmed else x["line"]).rlike(regex))
    return f.withColumn("_h", F.explode(hits)).select("*", "_h.n", "_h.line").drop("_h")


def endpoints_raw(files: DataFrame, stack: str = "python", route_as_get: bool = False,
                  allow_single_quote: bool = False) -> DataFrame:
    """All endpoint rows before de-duplication.  The corpus is read once; files with a route are
    written to the shared checkpoint folder and read by each language.

    ``route_as_get`` gives a Flask ``route`` without methods GET instead of ROUTE;
    ``allow_single_quote`` also takes Express paths in single quotes.
    """
    js_route = K.JS_ROUTE_RE.replace('["`]', """["'`]""").replace('[^"`]', """[^"'`]""") if allow_single_quote else K.JS_ROUTE_RE
    anything = ROUTE_ANY + (f"|(?:{js_route})" if allow_single_quote else "")
    f = api_source_files(files).where(F.col("content").rlike(anything)).select(
        "repo", "path", "ext", "content", F.split("content", LINE_SPLIT).alias("lines"))
    # A trailing newline yields one empty last element that splitlines() drops.
    f = checkpointed(f.withColumn("lines", F.when(
        F.col("content").rlike(r"(\r\n|\n|\r)$"), F.slice("lines", 1, F.size("lines") - 1)).otherwise(F.col("lines"))))
    lines, line, content, n = F.col("lines"), F.col("line"), F.col("content"), F.col("n")
    controllers, classes = class_lines(lines)
    typed = f.withColumns({"controllers": controllers, "classes": classes})
    web = F.col("content").rlike(K.CS_WEBMETHOD_RE)
    base = F.regexp_replace(F.coalesce(F.try_element_at(F.filter(
        F.transform(F.slice("lines", 1, 50), lambda l: F.regexp_extract(l, K.CS_BASE_ROUTE_RE, 1)),
        lambda x: x != ""), F.lit(1)), F.lit("")), "^/+", "")
    js = K.LANG_EXTS["js"] + K.LANG_EXTS["ts"]
    parts = [
        (_route_lines(f, [".py"], K.PY_DECORATOR_RE, trimmed=True), _python(lines, n, line, F.lit(stack), route_as_get)),
        (_route_lines(typed, [".java"], K.SPRING_MAPPING_RE), _java(lines, n, line, content)),
        (_route_lines(typed, js, K.NESTJS_RE), _nest(lines, n, line)),
        (_route_lines(f, js, js_route), _express(lines, n, line, js_route)),
        (_route_lines(f, [".go"], K.GO_ROUTE_RE), _go(lines, n, line)),
        (_route_lines(f, [".php"], K.PHP_ROUTE_RE), _php(lines, n, line)),
        (_route_lines(f, [".rb"], K.RAILS_ROUTE_RE), _ruby(lines, n, line, content)),
        (_route_lines(f.where(web), [".cs"], K.CS_WEBMETHOD_RE), _webmethod(lines, n)),
        (_route_lines(f.where(~web).withColumn("cs_base", base), [".cs"], K.CS_ROUTE_RE),
         _csharp(lines, n, line, F.col("cs_base"))),
    ]
    out = None
    for rows, endpoints in parts:
        found = rows.select("repo", F.col("path").alias("file"), F.explode(endpoints.cast(EP_T)).alias("e")).select(
            "repo", "file", "e.*")
        out = found if out is None else out.unionByName(found)
    return out


def auth_required(tags: Column) -> Column:
    """Tri-state: null without tags, false when any tag contains 'Public'."""
    return (F.when(F.size(tags) == 0, F.lit(None).cast("boolean"))
            .when(F.exists(tags, lambda t: t.contains("Public")), F.lit(False))
            .otherwise(F.lit(True)))


def endpoint_inventory(files: DataFrame, stack: str = "python", **options) -> DataFrame:
    """Union of all frameworks, ids, tri-state auth, dedupe by id; written once."""
    raw = endpoints_raw(files, stack, **options)
    eid = F.substring(F.md5(F.concat_ws(":", "method", "path", "file", F.col("line").cast("string"))), 1, 12)
    out = (raw.withColumn("id", eid).withColumn("auth_required", auth_required(F.col("auth_tags"))))
    w = Window.partitionBy("repo", "id").orderBy("file", "line", "sub")
    return checkpointed(out.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "sub"))


# --- F9, F10 ------------------------------------------------------------------------------
def idor_candidates(eps: DataFrame) -> DataFrame:
    """id-like path/query param and no ownership marker in the tags."""
    ids = F.transform(F.filter("params", lambda p: p["location"].isin("path", "query")
                               & p["name"].rlike(K.IDOR_PARAM_RE)), lambda p: p["name"])
    joined = F.array_join("auth_tags", " ")
    owned = F.lit(False)
    for mk in K.OWNERSHIP_MARKERS:
        owned = owned | joined.contains(mk)
    return (eps.withColumn("id_params", ids)
            .where((F.size("id_params") > 0) & ~owned)
            .select("repo", "id", "method", "path", "id_params", "auth_tags", "auth_required", "file", "line"))


def unauthenticated_endpoints(eps: DataFrame) -> DataFrame:
    """no auth tags, or explicitly public (AllowAnonymous counts, Q10)."""
    public = F.exists("auth_tags", lambda t: t.contains("Public") | t.contains("AllowAnonymous"))
    return eps.where((F.size("auth_tags") == 0) | (F.col("auth_required") == F.lit(False)) | public)
