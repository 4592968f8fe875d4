"""Test-table views.

Each view is ONE SQL text that runs unchanged in Spark SQL and in DuckDB, so
the Spark operators and the DuckDB oracle start from identical rows.  Views
only reshape the driver's tables (lineitem, part, pages, events, ...) into the
record shapes the audit operators consume; every row of the source table is
kept, so the work grows with the data.

Array-valued fields are carried as delimited strings here (the two SQL
dialects spell array literals differently); the Spark adapters in
``sparkaudit.plans.inputs`` split them into real arrays.
"""

from __future__ import annotations

BASE_TABLES = ("region nation customer supplier part orders lineitem events "
               "documents embeddings pages benchmark labels conversations").split()

# ---------------------------------------------------------------------------
# Candidate source->sink paths (one per lineitem row).
# ---------------------------------------------------------------------------
V_PATHS = """
SELECT
  'run_' || CAST(l_orderkey % 4 AS STRING) AS run_id,
  (l_orderkey * 8 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS ord,
  CASE WHEN l_orderkey % 23 = 7 THEN NULL
       ELSE CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) END AS id,
  CASE l_partkey % 4 WHEN 0 THEN 'Order' WHEN 1 THEN 'Payment' WHEN 2 THEN 'User' ELSE 'Report' END
    || 'Controller.'
    || CASE l_suppkey % 3 WHEN 0 THEN 'store' WHEN 1 THEN 'show' ELSE 'update' END AS entry_fn,
  CASE WHEN l_orderkey % 10 = 0 THEN NULL
       WHEN l_linenumber % 4 = 0 THEN '/app/controller/Order' || CAST(l_orderkey % 50 AS STRING) || 'Controller.php'
       WHEN l_linenumber % 4 = 1 THEN '/app/service/Payment' || CAST(l_partkey % 40 AS STRING) || 'Service.php'
       WHEN l_linenumber % 4 = 2 THEN '/app/utils/Str' || CAST(l_suppkey % 30 AS STRING) || 'Helper.php'
       ELSE '/app/tests/Order' || CAST(l_orderkey % 20 AS STRING) || 'Test.php' END AS entry_file,
  CASE WHEN l_orderkey % 3 = 0 THEN '/app/api/Routes' || CAST(l_linenumber AS STRING) || '.php' ELSE NULL END AS file,
  CASE l_partkey % 7 WHEN 0 THEN 'http_param' WHEN 1 THEN 'query' WHEN 2 THEN 'body' WHEN 3 THEN 'cookie'
       WHEN 4 THEN 'queue' WHEN 5 THEN 'db_read' ELSE 'header' END AS src_type,
  CASE WHEN l_partkey % 9 = 0 THEN NULL
       ELSE '$request->input(''p' || CAST(l_partkey % 30 AS STRING) || ''')' END AS src_code,
  CASE WHEN l_linenumber % 2 = 0 THEN '/app/http/Input' || CAST(l_partkey % 10 AS STRING) || '.php'
       ELSE '/app/migrations/Seed' || CAST(l_partkey % 10 AS STRING) || '.php' END AS src_file,
  CASE l_partkey % 10 WHEN 0 THEN 'DB::statement' WHEN 1 THEN 'rawExec' WHEN 2 THEN 'shell_exec'
       WHEN 3 THEN 'file_get_contents' WHEN 4 THEN 'curl_exec' WHEN 5 THEN 'unserialize'
       WHEN 6 THEN 'echo' WHEN 7 THEN 'Mailer.send' WHEN 8 THEN 'render_template_string'
       ELSE 'doTask' || CAST(l_partkey % 100 AS STRING) END AS sink_name,
  CASE l_returnflag WHEN 'R' THEN 'sqli'
       WHEN 'A' THEN CASE WHEN l_suppkey % 2 = 0 THEN 'rce' ELSE 'xss' END
       ELSE CASE l_partkey % 3 WHEN 0 THEN 'custom_wrapper' WHEN 1 THEN 'ssrf' ELSE 'deser' END END AS sink_type,
  CASE WHEN l_suppkey % 11 = 0 THEN '/app/tests/fixtures/Sink' || CAST(l_suppkey % 5 AS STRING) || '.php'
       WHEN l_suppkey % 7 = 0 THEN ''
       ELSE '/app/lib/Sink' || CAST(l_suppkey % 20 AS STRING) || '.php' END AS sink_file,
  CASE WHEN l_partkey % 13 = 0 THEN 'EXEC_SINK' WHEN l_partkey % 17 = 0 THEN 'LOG_SINK' ELSE NULL END AS sink_cat,
  CASE l_suppkey % 3 WHEN 0 THEN 'semgrep' WHEN 1 THEN 'gitnexus' ELSE 'manual' END AS tool,
  CASE l_partkey % 4 WHEN 0 THEN 'semgrep,gitnexus' WHEN 1 THEN 'gitnexus' WHEN 2 THEN '' ELSE 'semgrep' END AS detected_by,
  CASE l_orderkey % 5 WHEN 0 THEN 'structural' WHEN 1 THEN 'object' WHEN 2 THEN 'feedback'
       WHEN 3 THEN 'taint' ELSE NULL END AS query_type,
  CASE l_orderkey % 6 WHEN 0 THEN 'handle|$svc->run|exec'
       WHEN 1 THEN 'store|call_user_func|query'
       WHEN 2 THEN 'show|Repo.find|select'
       WHEN 3 THEN 'update|$handler(|write'
       WHEN 4 THEN 'index|Model::__call|save'
       ELSE 'list|Service.load' END AS call_chain,
  CASE WHEN l_linestatus = 'O' THEN 'confirmed' ELSE NULL END AS path_decision,
  CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE CAST(floor(l_quantity) AS INTEGER) % 12 END AS score,
  CASE WHEN l_orderkey % 9 = 0 AND l_linenumber % 2 = 1 THEN CAST(floor(l_quantity) AS INTEGER) % 10
       ELSE NULL END AS triage_score,
  l_discount > 0.03 AS has_flow,
  CASE CAST(floor(l_tax * 100) AS INTEGER) % 4 WHEN 0 THEN 'input|htmlspecialchars($x)|echo'
       WHEN 1 THEN 'input|$q->prepare($sql)|execute'
       WHEN 2 THEN 'input|concat|exec'
       ELSE '' END AS flow_nodes
FROM lineitem
"""

# Business-context sensitive flows: one per nation (explicit ord).
V_SENSITIVE = """
SELECT n_nationkey AS ord,
       CASE n_nationkey % 5 WHEN 0 THEN 'Order' || CAST(n_nationkey AS STRING) || 'Controller'
            WHEN 1 THEN 'Payment' || CAST(n_nationkey AS STRING)
            WHEN 2 THEN 'User'
            WHEN 3 THEN ''
            ELSE 'Refund' || CAST(n_nationkey AS STRING) END AS entry
FROM nation
"""

# External (third-party scanner) findings: one per nation, ordered.
V_CX = """
SELECT n_nationkey AS ord,
       CASE n_nationkey % 4 WHEN 0 THEN 'controller/Order' || CAST(n_nationkey AS STRING)
            WHEN 1 THEN 'service/Payment' || CAST(n_nationkey AS STRING)
            WHEN 2 THEN ''
            ELSE 'utils/Str' || CAST(n_nationkey AS STRING) END AS file,
       CASE n_nationkey % 3 WHEN 0 THEN 'DB::' WHEN 1 THEN 'exec' ELSE '' END AS sink,
       CASE n_nationkey % 5 WHEN 0 THEN 'sqli' WHEN 1 THEN 'rce' WHEN 2 THEN 'xss'
            WHEN 3 THEN '' ELSE 'ssrf' END AS vuln_type
FROM nation
"""

# Business-context custom sinks (C1 step 1): one per region and nation.
V_CTX_SINKS = """
SELECT n_nationkey AS ord,
       CASE n_nationkey % 6 WHEN 0 THEN 'rawexec' WHEN 1 THEN 'Mailer' WHEN 2 THEN 'doTask1'
            WHEN 3 THEN 'charge' WHEN 4 THEN '' ELSE 'render' END AS name,
       CASE n_nationkey % 4 WHEN 0 THEN 'sqli' WHEN 1 THEN 'business_critical' WHEN 2 THEN 'ssti'
            ELSE '' END AS vuln_type,
       CASE n_nationkey % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'high' ELSE 'MEDIUM' END AS confidence
FROM nation
"""


# Sink names: catalogue-like words joined with part words (one per part).
V_SINKS = """
SELECT p_partkey AS ord,
  CASE p_partkey % 10
    WHEN 0 THEN replace(p_name, ' ', '_') || '.query'
    WHEN 1 THEN 'DB::' || p_type
    WHEN 2 THEN 'rawExec_' || replace(p_name, ' ', '')
    WHEN 3 THEN p_brand || '->fill'
    WHEN 4 THEN 'child_process.' || replace(p_name, ' ', '')
    WHEN 5 THEN replace(p_name, ' ', '.') || 'Markup'
    WHEN 6 THEN 'requests.get_' || lower(p_type)
    WHEN 7 THEN 'curl_exec_' || CAST(p_size AS STRING)
    WHEN 8 THEN replace(p_name, ' ', '') || 'Helper'
    ELSE upper(replace(p_name, ' ', '_')) || '.WriteFile' END AS sink_name,
  '/src/' || lower(p_type) || '/' || replace(p_name, ' ', '_') || '.py' AS file,
  CASE p_partkey % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
  CASE p_partkey % 3 WHEN 0 THEN 'known_sink' WHEN 1 THEN 'structural' ELSE 'name_pattern' END AS pass
FROM part
"""

# Flat scanner results (one per order): rule id, file, line, code, message, severity.
V_SCAN = """
SELECT o_orderkey AS ord,
  CASE o_orderkey % 16
    WHEN 0 THEN 'python.flask.security.user-input.request-get'
    WHEN 1 THEN 'php.lang.security.sql-injection.raw-query'
    WHEN 2 THEN 'javascript.express.security.xss.res-send'
    WHEN 3 THEN 'java.spring.security.ssrf.rest-template'
    WHEN 4 THEN 'custom-non-http-source'
    WHEN 5 THEN 'python.lang.security.deserialization.pickle'
    WHEN 6 THEN 'go.gin.security.open-redirect.unvalidated'
    WHEN 7 THEN 'php.lang.security.exec-shell'
    WHEN 8 THEN 'csharp.dotnet.security.xxe.xmldocument'
    WHEN 9 THEN 'python.flask.security.template-injection'
    WHEN 10 THEN 'generic.secrets.hardcoded-password'
    WHEN 11 THEN 'javascript.browser.dom-based.innerhtml'
    WHEN 12 THEN 'ruby.rails.security.crlf-injection'
    WHEN 13 THEN 'java.servlet.taint-source.getparameter'
    WHEN 14 THEN 'python.lang.path-traversal.open'
    ELSE 'java.lang.resource-leak' END AS check_id,
  '/src/' || lower(o_orderpriority) || '/Module' || CAST(o_custkey % 40 AS STRING) || '.php' AS path,
  CAST(o_custkey % 500 AS INTEGER) + 1 AS line,
  CASE o_orderkey % 7
    WHEN 0 THEN '  $sid = $_COOKIE["sid"];  '
    WHEN 1 THEN 'token = request.headers.get("X-Token")'
    WHEN 2 THEN 'save(upload.file)'
    WHEN 3 THEN 'msg = kafka.consumer.poll()'
    WHEN 4 THEN 'row = cursor.fetchone()'
    WHEN 5 THEN 'ws.on("message", cb)'
    ELSE 'q = request.args.get("q")' END AS code,
  'finding ' || CAST(o_orderkey AS STRING) AS message,
  CASE o_orderstatus WHEN 'F' THEN 'error' WHEN 'O' THEN 'warning' ELSE NULL END AS severity
FROM orders
"""

from sparkaudit.plans.views_src import (V_CALLS, V_CONTEXT_DOCS, V_MODEL_FIELDS, V_MODEL_NODES, V_MODEL_PARTS, V_RESULTS, V_EDGES, V_FN_PARAMS, V_NODES, V_REGISTRY_INPUT, V_RING_EDGES, V_RING_NODES,  # noqa: E402
                                        V_SRC_FILES, V_URL_PATHS)

from sparkaudit.plans.views_intel import V_REPO_FILES  # noqa: E402
from sparkaudit.plans.views_rules import V_GRAPH_DOCS, V_RULE_FILES, V_SCAN_DOCS  # noqa: E402

VIEWS: dict[str, str] = {
    "v_repo_files": V_REPO_FILES,
    "v_results": V_RESULTS,
    "v_model_nodes": V_MODEL_NODES,
    "v_model_parts": V_MODEL_PARTS,
    "v_scan_docs": V_SCAN_DOCS,
    "v_graph_docs": V_GRAPH_DOCS,
    "v_rule_files": V_RULE_FILES,
    "v_model_fields": V_MODEL_FIELDS,
    "v_context_docs": V_CONTEXT_DOCS,
    "v_calls": V_CALLS,
    "v_registry_input": V_REGISTRY_INPUT,
    "v_fn_params": V_FN_PARAMS,
    "v_edges": V_EDGES,
    "v_nodes": V_NODES,
    "v_ring_edges": V_RING_EDGES,
    "v_ring_nodes": V_RING_NODES,
    "v_url_paths": V_URL_PATHS,
    "v_src_files": V_SRC_FILES,
    "v_sinks": V_SINKS,
    "v_scan": V_SCAN,
    "v_paths": V_PATHS,
    "v_sensitive": V_SENSITIVE,
    "v_cx": V_CX,
    "v_ctx_sinks": V_CTX_SINKS,
}

# Which base tables each view reads (for registration).
VIEW_DEPS: dict[str, tuple[str, ...]] = {
    "v_repo_files": ("pages", "v_src_files"),
    "v_results": ("events",),
    "v_model_nodes": ("part",),
    "v_model_parts": ("part",),
    "v_scan_docs": ("orders", "v_scan"),
    "v_graph_docs": ("part",),
    "v_rule_files": ("pages", "v_src_files"),
    "v_model_fields": ("part",),
    "v_context_docs": ("conversations",),
    "v_calls": ("events",),
    "v_registry_input": ("pages", "part"),
    "v_fn_params": ("nation",),
    "v_edges": ("lineitem", "supplier", "nation"),
    "v_ring_edges": ("customer", "supplier", "nation"),
    "v_ring_nodes": ("customer", "supplier", "nation", "region"),
    "v_nodes": ("orders", "part", "supplier", "nation", "region"),
    "v_url_paths": ("pages",),
    "v_src_files": ("pages",),
    "v_sinks": ("part",),
    "v_scan": ("orders",),
    "v_paths": ("lineitem",),
    "v_sensitive": ("nation",),
    "v_cx": ("nation",),
    "v_ctx_sinks": ("nation",),
}


def with_views(sql: str, names: list[str] | tuple[str, ...]) -> str:
    """Prefix ``sql`` with the given views as CTEs (oracle form)."""
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in names)
    return f"WITH {ctes}\n{sql.strip()}"
