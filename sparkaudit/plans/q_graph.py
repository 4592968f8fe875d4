"""Registered queries: call-graph reachability and structural discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkaudit import catalogs as K
from sparkaudit.operators import graph as G
from sparkaudit.plans import inputs as I
from sparkaudit.plans.registry import ORACLES, register
from sparkaudit.plans.sqlfrag import contains_any, q

GV = ("v_nodes", "v_edges")
_KNOWN = "(" + ", ".join(q(s) for s in K.KNOWN_SINKS_GRAPH) + ")"
_ENTRY_WHERE = "type = 'Method' AND contains(file, 'controller')"


def _g(spark, sf):
    return I.view(spark, sf, "v_nodes"), I.view(spark, sf, "v_edges")


def _entries(nodes):
    return nodes.where((F.col("type") == "Method") & F.col("file").contains("controller")).select("name")


def _recursive(name: str) -> None:
    """Oracle SQL with recursive CTEs needs WITH RECURSIVE."""
    ORACLES[name] = ORACLES[name].replace("WITH ", "WITH RECURSIVE ", 1)


def _reach_sql(name: str, starts: str, depth: int, backward: bool = False) -> str:
    a, b = ("dst", "src") if backward else ("src", "dst")
    return f"""{name} AS (
  SELECT key, node, 0 AS depth FROM ({starts}) s
  UNION
  SELECT {name}.key, e.{b}, {name}.depth + 1 FROM {name} JOIN v_edges e ON e.{a} = {name}.node
  WHERE {name}.depth < {depth} AND e.kind = 'CALLS')"""


@register("paths_entry_and_sink", GV, f"""
, {_reach_sql('r', f"SELECT name AS key, node_id AS node FROM v_nodes WHERE {_ENTRY_WHERE}", 6)}
SELECT r.key AS entry, n.name AS sink, CAST(min(r.depth) AS INTEGER) AS depth
FROM r JOIN v_nodes n ON n.node_id = r.node
WHERE r.depth >= 1 AND n.name IN {_KNOWN}
GROUP BY r.key, n.name
""")
def q_paths_entry_and_sink(spark, sf):
    """G1: handlers -> known sinks within 6 calls (distinct pairs, min depth)."""
    nodes, edges = _g(spark, sf)
    out = G.paths_entry_and_sink(nodes, edges, _entries(nodes), K.KNOWN_SINKS_GRAPH, 6)
    return out.select("entry", "sink", F.col("depth").cast("int"))


_recursive("paths_entry_and_sink")


@register("paths_to_sink", GV, f"""
, {_reach_sql('r', f"SELECT name AS key, node_id AS node FROM v_nodes WHERE name IN {_KNOWN}", 5, True)}
SELECT r.key AS sink, r.node AS caller_id, n.name AS caller, n.file, CAST(min(r.depth) AS INTEGER) AS depth
FROM r JOIN v_nodes n ON n.node_id = r.node
WHERE r.depth >= 1
GROUP BY r.key, r.node, n.name, n.file
""")
def q_paths_to_sink(spark, sf):
    """Every caller reaching a known sink within 5 calls."""
    nodes, edges = _g(spark, sf)
    return G.paths_to_sink(nodes, edges, K.KNOWN_SINKS_GRAPH, 5).select(
        "sink", "caller_id", "caller", "file", F.col("depth").cast("int"))


_recursive("paths_to_sink")


@register("paths_broad", GV, f"""
, {_reach_sql('f', f"SELECT name AS key, node_id AS node FROM v_nodes WHERE {_ENTRY_WHERE}", 5)},
{_reach_sql('b', f"SELECT name AS key, node_id AS node FROM v_nodes WHERE name IN {_KNOWN}", 5, True)},
u AS (SELECT f.key AS from_name, n.name AS to_name, f.depth FROM f JOIN v_nodes n ON n.node_id = f.node
      WHERE f.depth >= 1
      UNION ALL
      SELECT n.name, b.key, b.depth FROM b JOIN v_nodes n ON n.node_id = b.node WHERE b.depth >= 1)
SELECT from_name, to_name, CAST(min(depth) AS INTEGER) AS depth FROM u GROUP BY from_name, to_name
""")
def q_paths_broad(spark, sf):
    """Entry in list OR sink in list."""
    nodes, edges = _g(spark, sf)
    return G.paths_broad(nodes, edges, _entries(nodes), K.KNOWN_SINKS_GRAPH, 5).select(
        "from_name", "to_name", F.col("depth").cast("int"))


_recursive("paths_broad")

_SKIP_TOK = "(" + ", ".join(q(s) for s in K.FLOW_TOPIC_SKIP + K.SCAN_SKIP_DIRS) + ")"
TOKENS_SQL = f"""
toks AS (SELECT DISTINCT lower(seg) AS token FROM (
    SELECT unnest(string_split(file, '/')[1:-2]) AS seg FROM v_nodes) t
  WHERE length(seg) > 2 AND lower(seg) NOT IN {_SKIP_TOK} AND NOT starts_with(seg, '.'))
"""


@register("handler_path_tokens", ("v_nodes",), f"""
, {TOKENS_SQL.strip()}
SELECT token FROM toks
""")
def q_handler_path_tokens(spark, sf):
    """F18 over the graph's file paths."""
    nodes, _ = _g(spark, sf)
    return G.handler_path_tokens(nodes)


@register("paths_domain", GV, f"""
, {TOKENS_SQL.strip()},
{_reach_sql('r', "SELECT t.token AS key, n.node_id AS node FROM v_nodes n JOIN toks t ON contains(lower(n.file), t.token)", 6)}
SELECT r.key AS domain, n.name AS sink, CAST(min(r.depth) AS INTEGER) AS depth
FROM r JOIN v_nodes n ON n.node_id = r.node
WHERE r.depth >= 1 AND n.name IN {_KNOWN}
GROUP BY r.key, n.name
""")
def q_paths_domain(spark, sf):
    """Per directory domain, known sinks reachable from its files."""
    nodes, edges = _g(spark, sf)
    doms = G.handler_path_tokens(nodes).select(F.col("token").alias("domain"))
    hints = doms.select("domain", F.explode(F.array(*[F.lit(s) for s in K.KNOWN_SINKS_GRAPH])).alias("name"))
    return G.paths_domain(nodes, edges, doms, hints, 6).select("domain", "sink", F.col("depth").cast("int"))


_recursive("paths_domain")

_REGION_SINKS = ["eval", "unserialize", "render_template_string"]



def _trails_sql(nodes: str, edges: str, sinks: list[str], depth: int) -> str:
    """Trails (no edge twice) by numbered edges."""
    return f"""
, e AS MATERIALIZED (SELECT src, dst, row_number() OVER () AS eid FROM {edges} WHERE kind = 'CALLS'),
t AS (
  SELECT node_id AS start, node_id AS node, [node_id] AS ids, []::BIGINT[] AS trail, 0 AS depth FROM {nodes}
  WHERE contains(file, 'controller')
  UNION ALL
  SELECT t.start, e.dst, list_append(t.ids, e.dst), list_append(t.trail, e.eid), t.depth + 1
  FROM t JOIN e ON e.src = t.node
  WHERE t.depth < {depth} AND NOT list_contains(t.trail, e.eid)),
tt AS (SELECT row_number() OVER () AS rid, t.* FROM t JOIN {nodes} n ON n.node_id = t.node
       WHERE t.depth >= 1 AND n.name IN ({', '.join(q(s) for s in sinks)})),
u AS (SELECT rid, unnest(ids) AS nid, generate_subscripts(ids, 1) AS i FROM tt),
c AS (SELECT rid, string_agg(v.name, ' -> ' ORDER BY i) AS call_chain FROM u JOIN {nodes} v ON v.node_id = u.nid
      GROUP BY rid)
SELECT tt.start, n.name AS sink, CAST(tt.depth AS INTEGER) AS depth, c.call_chain
FROM tt JOIN c ON c.rid = tt.rid JOIN {nodes} n ON n.node_id = tt.node
"""


@register("paths_with_chain", GV, _trails_sql("v_nodes", "v_edges", _REGION_SINKS, 8))
def q_paths_with_chain(spark, sf):
    """Call chains from controller files to template / eval / unserialize sinks."""
    return G.paths_with_chain(I.view(spark, sf, "v_nodes"), I.edges(spark, sf), "controller", _REGION_SINKS, 8)


_recursive("paths_with_chain")

_RING_SINKS = ["eval", "unserialize", "exec"]


@register("paths_with_chain_cycles", ("v_ring_nodes", "v_ring_edges"), _trails_sql("v_ring_nodes", "v_ring_edges", _RING_SINKS, 7))
def q_paths_with_chain_cycles(spark, sf):
    """G5 on a graph with cycles, self-loops and parallel edges."""
    return G.paths_with_chain(I.view(spark, sf, "v_ring_nodes"), I.view(spark, sf, "v_ring_edges"), "controller", _RING_SINKS, 7)


_recursive("paths_with_chain_cycles")


@register("fan_in", GV, f"""
SELECT substring(md5(n.file || ':' || n.name), 1, 10) AS id, n.name AS sink_name, n.file, n.line,
       CAST(c.cc AS BIGINT) AS caller_count, CASE WHEN c.cc >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS confidence
FROM (SELECT dst, count(DISTINCT src) AS cc FROM v_edges WHERE kind = 'CALLS' GROUP BY dst) c
JOIN v_nodes n ON n.node_id = c.dst
WHERE c.cc >= {K.MIN_CALLERS} AND NOT {contains_any('lower(n.file)', K.FAN_IN_SKIP)} AND n.name NOT IN {_KNOWN}
""")
def q_fan_in(spark, sf):
    """G7 heuristic sinks by distinct caller count."""
    nodes, edges = _g(spark, sf)
    return G.fan_in(nodes, edges)


@register("wrapper_discovery", GV, f"""
SELECT substring(md5(w.file || ':' || w.name), 1, 10) AS id, w.name, k.name AS wraps, w.file, w.line,
       CAST(count(*) AS BIGINT) AS call_count,
       CASE {' '.join(f"WHEN {contains_any('lower(k.name)', kws)} THEN {q(lab)}" for lab, kws in K.KNOWN_SINK_VULN_GROUPS)}
            ELSE 'unknown' END AS vuln_type
FROM v_edges e JOIN v_nodes k ON k.node_id = e.dst JOIN v_nodes w ON w.node_id = e.src
WHERE e.kind = 'CALLS' AND k.name IN {_KNOWN} AND contains(w.file, 'src/') AND w.name NOT IN {_KNOWN}
GROUP BY w.name, w.file, w.line, k.name
""")
def q_wrapper_discovery(spark, sf):
    """J5 known-sink wrappers."""
    nodes, edges = _g(spark, sf)
    return G.wrapper_discovery(nodes, edges)


@register("endpoint_middleware", GV, f"""
, {TOKENS_SQL.strip()},
h AS (SELECT * FROM v_nodes n WHERE EXISTS (SELECT 1 FROM toks WHERE contains(lower(n.file), toks.token))),
m AS (SELECT e.dst, mw.name AS mw FROM v_edges e JOIN v_nodes mw ON mw.node_id = e.src
      WHERE e.kind = 'CALLS' AND {contains_any('mw.name', K.MIDDLEWARE_WORDS)})
SELECT substring(md5(h.file || ':' || h.name), 1, 10) AS id, h.name AS handler_fn, h.file, h.line,
       coalesce(string_agg(DISTINCT m.mw, ',' ORDER BY m.mw), '') AS auth_middleware,
       count(m.mw) > 0 AS auth_required
FROM h LEFT JOIN m ON m.dst = h.node_id
GROUP BY h.node_id, h.name, h.file, h.line
""")
def q_endpoint_middleware(spark, sf):
    """J6 with F18 tokens."""
    nodes, edges = _g(spark, sf)
    out = G.endpoint_middleware(nodes, edges, G.handler_path_tokens(nodes))
    return out.select("id", "handler_fn", "file", "line", F.array_join("auth_middleware", ",").alias("auth_middleware"),
                      "auth_required")


@register("direct_callers", GV, f"""
SELECT k.name AS callee, c.name AS caller, c.file AS caller_file
FROM v_edges e JOIN v_nodes k ON k.node_id = e.dst JOIN v_nodes c ON c.node_id = e.src
WHERE e.kind = 'CALLS' AND k.name IN {_KNOWN}
""")
def q_direct_callers(spark, sf):
    """J7 one-hop callers of known sinks."""
    nodes, edges = _g(spark, sf)
    return G.direct_callers(nodes, edges, K.KNOWN_SINKS_GRAPH)


@register("auth_symbols", ("v_nodes",), f"""
SELECT node_id, name, file FROM v_nodes WHERE regexp_matches(name, {q(K.AUTH_SYMBOL_RE)})
""")
def q_auth_symbols(spark, sf):
    """F15."""
    nodes, _ = _g(spark, sf)
    return G.auth_symbols(nodes).select("node_id", "name", "file")


@register("unscoped_tenant_access", ("v_nodes",), """
SELECT node_id, name, file FROM v_nodes
WHERE contains(file, 'Repository') AND NOT contains(name, 'company_id') AND NOT contains(name, 'tenant_id')
""")
def q_unscoped_tenant_access(spark, sf):
    """F16."""
    nodes, _ = _g(spark, sf)
    return G.unscoped_tenant_access(nodes).select("node_id", "name", "file")


@register("sink_name_discovery", GV, f"""
SELECT DISTINCT n.name FROM v_nodes n
WHERE n.node_id IN (SELECT dst FROM v_edges WHERE kind = 'CALLS') AND regexp_matches(n.name, {q(K.SINK_NAME_RE)})
""")
def q_sink_name_discovery(spark, sf):
    """G9."""
    nodes, edges = _g(spark, sf)
    return G.sink_name_discovery(nodes, edges)


@register("empty_result_diagnostic", GV, f"""
SELECT CAST((SELECT count(*) FROM v_nodes) AS BIGINT) AS node_count,
       CAST(count(*) AS BIGINT) AS result_count,
       CASE WHEN count(*) > 0 THEN 'ok' WHEN (SELECT count(*) FROM v_nodes) = 0 THEN 'graph_empty'
            ELSE 'no_match' END AS status
FROM v_edges e JOIN v_nodes k ON k.node_id = e.dst JOIN v_nodes w ON w.node_id = e.src
WHERE e.kind = 'CALLS' AND k.name IN {_KNOWN} AND contains(w.file, 'src/') AND w.name NOT IN {_KNOWN}
""")
def q_empty_result_diagnostic(spark, sf):
    """G8 on the raw wrapper-call rows."""
    nodes, edges = _g(spark, sf)
    known_n = nodes.where(F.col("name").isin(K.KNOWN_SINKS_GRAPH)).select(F.col("node_id").alias("dst"))
    wr = nodes.where(F.col("file").contains("src/") & ~F.col("name").isin(K.KNOWN_SINKS_GRAPH)).select(
        F.col("node_id").alias("src"))
    rows = edges.where(F.col("kind") == "CALLS").join(known_n, "dst").join(wr, "src")
    return G.empty_result_diagnostic(nodes, rows)
