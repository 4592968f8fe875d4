"""Source-corpus views (shared Spark / DuckDB SQL text; no backslashes, since
the two dialects escape them differently)."""

# URL paths of the crawled pages.
V_URL_PATHS = """
SELECT page_id, url, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS path FROM pages
"""

# One synthetic source file per page; framework by page_id mod 9; the route
# path is the page's URL path with the numeric segment turned into {item_id}.
V_SRC_FILES = """
SELECT 'repo' || CAST(page_id % 7 AS STRING) AS repo,
  CASE WHEN page_id % 23 = 0 THEN 'node_modules/lib/' ELSE '' END ||
  CASE page_id % 9 WHEN 0 THEN 'app/api/views_' WHEN 1 THEN 'src/main/java/Item' WHEN 2 THEN 'src/items/items_'
       WHEN 3 THEN 'routes/items_' WHEN 4 THEN 'internal/http/items_' WHEN 5 THEN 'routes/web_'
       WHEN 6 THEN 'app/controllers/items_' WHEN 7 THEN 'Controllers/Items' ELSE 'Services/Legacy' END
  || CAST(page_id AS STRING) ||
  CASE page_id % 9 WHEN 0 THEN '.py' WHEN 1 THEN 'Controller.java' WHEN 2 THEN '.controller.ts' WHEN 3 THEN '.js'
       WHEN 4 THEN '.go' WHEN 5 THEN '.php' WHEN 6 THEN '_controller.rb' WHEN 7 THEN 'Controller.cs'
       ELSE '.asmx.cs' END AS path,
  page_id,
  CASE page_id % 9
  WHEN 0 THEN concat('from flask import Flask, request', chr(10), 'app = Flask(__name__)', chr(10), chr(10),
       CASE WHEN page_id % 2 = 0 THEN '@app.get("' || rp || '")'
            ELSE '@app.route("' || rp || '", methods=["GET", "POST"])' END, chr(10),
       CASE WHEN page_id % 4 = 1 THEN '@login_required' ELSE '# public' END, chr(10),
       'async def handler_' || CAST(page_id AS STRING) || '(item_id: int = Path(...),', chr(10),
       '        user_id: Optional[int] = Query(None), token: str = Depends(get_current_user)):', chr(10),
       '    q = "SELECT * FROM t WHERE id = %s" % request.args.get("id")', chr(10),
       '    return db.execute(q)', chr(10))
  WHEN 1 THEN concat('package app;', chr(10), '@RestController', chr(10),
       CASE WHEN page_id % 2 = 0 THEN '@PreAuthorize("hasRole(ADMIN)")' ELSE '// open' END, chr(10),
       'public class Item' || CAST(page_id AS STRING) || 'Controller {', chr(10),
       '    @GetMapping("' || rp || '")', chr(10),
       '    public ResponseEntity<String> getItem(@PathVariable Long item_id,', chr(10),
       '            @RequestParam String sort_key) {', chr(10),
       '        return svc.find(item_id);', chr(10), '    }', chr(10),
       '    @RequestMapping(value = "/orders/{orderId}")', chr(10),
       '    @Secured("ROLE_USER")', chr(10),
       '    public String order(@RequestHeader String auth) { return ""; }', chr(10), '}', chr(10))
  WHEN 2 THEN concat('@Controller("items")', chr(10),
       CASE WHEN page_id % 2 = 0 THEN '@UseGuards(AuthGuard)' ELSE '' END, chr(10),
       'export class Items' || CAST(page_id AS STRING) || ' {', chr(10),
       '  @Get("' || rp || '")', chr(10), '  find(@Param("item_id") id) {}', chr(10),
       '  @Public()', chr(10), '  @Post("")', chr(10), '  create(@Body() dto) {}', chr(10), '}', chr(10))
  WHEN 3 THEN concat('const router = express.Router();', chr(10),
       'router.get("' || rp || '", authenticate, isAdmin, (req, res) => {', chr(10),
       '  const id = req.params.item_id;', chr(10), '  const q = req.query.order_id;', chr(10),
       '  const again = req.query.order_id;', chr(10), '  res.send(q);', chr(10), '});', chr(10),
       'app.use(`/static', CAST(page_id AS STRING), '`, serveStatic);', chr(10),
       'router.post(', chr(39), '/single/quoted', chr(39), ', (req, res) => {});', chr(10))
  WHEN 4 THEN concat('func routes(r *gin.Engine) {', chr(10),
       '    r.GET("' || rp || '", func(c *gin.Context) {', chr(10),
       '        id := c.Param("item_id")', chr(10), '        q := c.Query("page")', chr(10),
       '        c.JSON(200, id)', chr(10), '    })', chr(10),
       '    r.POST("/items/:itemId/pay", authMiddleware, pay)', chr(10), '}', chr(10))
  WHEN 5 THEN concat('<?php', chr(10),
       'Route::middleware(["auth:sanctum"])->group(function () {', chr(10),
       '    Route::get("' || rp || '", [C::class, "show"]);', chr(10),
       '    Route::post("/orders/{order_id}", [C::class, "store"])->middleware("can:update");', chr(10),
       '});', chr(10), 'Route::delete("/pub/' || CAST(page_id AS STRING) || '", [C::class, "destroy"]);', chr(10))
  WHEN 6 THEN concat('class ItemsController < ApplicationController', chr(10),
       '  before_action :authenticate_user!, only: [:show, :edit]', chr(10),
       '  before_action :set_item', chr(10), 'end', chr(10),
       'resources "items' || CAST(page_id AS STRING) || '"', chr(10), 'get "' || rp || '"', chr(10))
  WHEN 7 THEN concat('[Route("api/items")]', chr(10),
       CASE WHEN page_id % 2 = 0 THEN '[Authorize(Roles = "Admin")]' ELSE '' END, chr(10),
       'public class ItemsController : ControllerBase {', chr(10),
       '    [HttpGet("' || substring(rp, 2) || '")]', chr(10),
       '    public IActionResult Get([FromRoute] int item_id, [FromQuery] string customerId) {', chr(10),
       '        return Ok();', chr(10), '    }', chr(10),
       '    [HttpPost]', chr(10), '    [AllowAnonymous]', chr(10),
       '    public IActionResult Create([FromBody] Item item) { return Ok(); }', chr(10), '}', chr(10))
  ELSE concat('public class Svc' || CAST(page_id AS STRING) || ' : WebService {', chr(10),
       '    [Authorize]', chr(10), '    [WebMethod(EnableSession = true)]', chr(10),
       '    public string GetItem' || CAST(page_id AS STRING) || '(int itemId, string token) {', chr(10),
       '        return "";', chr(10), '    }', chr(10), '}', chr(10))
  END AS content
FROM (SELECT page_id,
        regexp_replace(regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1), '/[0-9]+', '/{item_id}') AS rp
      FROM pages) t
"""

# Call graph: a depth-4 DAG order -> part -> supplier -> nation -> region.
V_EDGES = """
SELECT DISTINCT 'o' || CAST(l_orderkey AS STRING) AS src, 'p' || CAST(l_partkey AS STRING) AS dst,
       'CALLS' AS kind FROM lineitem
UNION
SELECT DISTINCT 'p' || CAST(l_partkey AS STRING), 's' || CAST(l_suppkey AS STRING), 'CALLS' FROM lineitem
UNION
SELECT 's' || CAST(s_suppkey AS STRING), 'n' || CAST(s_nationkey AS STRING), 'CALLS' FROM supplier
UNION
SELECT 'n' || CAST(n_nationkey AS STRING), 'r' || CAST(n_regionkey AS STRING), 'CALLS' FROM nation
"""

# Graph nodes: names mix handlers, helpers and sink-like callees.
V_NODES = """
SELECT 'o' || CAST(o_orderkey AS STRING) AS node_id, 'handleOrder' || CAST(o_orderkey % 50 AS STRING) AS name,
       '/app/controller/order' || CAST(o_orderkey % 20 AS STRING) || '.php' AS file,
       CAST(o_orderkey % 300 AS INTEGER) + 1 AS line, 'Method' AS type FROM orders
UNION ALL
SELECT 'p' || CAST(p_partkey AS STRING), replace(p_name, ' ', '_'),
       CASE WHEN p_partkey % 17 = 0 THEN '/src/tests/mock/part' ELSE '/src/part/' || lower(p_type) END
         || CAST(p_partkey % 20 AS STRING) || '.java',
       CAST(p_size AS INTEGER), 'Function' FROM part
UNION ALL
SELECT 's' || CAST(s_suppkey AS STRING),
       CASE s_suppkey % 4 WHEN 0 THEN 'authGuard' WHEN 1 THEN 'supplierRepository.find'
            WHEN 2 THEN 'jwtMiddleware' ELSE 'supplierService' END || CAST(s_suppkey % 7 AS STRING),
       CASE WHEN s_suppkey % 5 = 0 THEN '/lib/supplier/SupplierRepository.java'
            ELSE '/src/supplier/Supplier' || CAST(s_suppkey % 10 AS STRING) || '.java' END,
       CAST(s_suppkey % 100 AS INTEGER) + 1, 'Method' FROM supplier
UNION ALL
SELECT 'n' || CAST(n_nationkey AS STRING),
       CASE n_nationkey % 5 WHEN 0 THEN 'exec' WHEN 1 THEN 'DB::statement' WHEN 2 THEN 'curl_exec'
            WHEN 3 THEN 'sendMail' ELSE 'writeLog' END,
       '/src/nation/Nation' || CAST(n_nationkey AS STRING) || '.java', n_nationkey + 1, 'Function' FROM nation
UNION ALL
SELECT 'r' || CAST(r_regionkey AS STRING),
       CASE r_regionkey WHEN 0 THEN 'eval' WHEN 1 THEN 'unserialize' WHEN 2 THEN 'executeCommand'
            WHEN 3 THEN 'render_template_string' ELSE 'dispatchJob' END,
       '/vendor/region/Region' || CAST(r_regionkey AS STRING) || '.java', r_regionkey + 1, 'Function' FROM region
"""

# A call graph with cycles, self-loops and parallel edges: customers and suppliers
# call nations, nations their region, regions call nations back.
V_RING_EDGES = """
SELECT 'c' || CAST(c_custkey AS STRING) AS src, 'n' || CAST(c_nationkey AS STRING) AS dst, 'CALLS' AS kind FROM customer
UNION ALL
SELECT 'c' || CAST(c_custkey AS STRING), 'n' || CAST(c_nationkey AS STRING), 'CALLS' FROM customer WHERE c_custkey % 10 = 0
UNION ALL
SELECT 's' || CAST(s_suppkey AS STRING), 'n' || CAST(s_nationkey AS STRING), 'CALLS' FROM supplier
UNION ALL
SELECT 's' || CAST(s_suppkey AS STRING), 's' || CAST(s_suppkey AS STRING), 'CALLS' FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL
SELECT 'n' || CAST(n_nationkey AS STRING), 'r' || CAST(n_regionkey AS STRING), 'CALLS' FROM nation
UNION ALL
SELECT 'r' || CAST(n_nationkey % 5 AS STRING), 'n' || CAST(n_nationkey AS STRING), 'CALLS' FROM nation WHERE n_nationkey < 10
"""

V_RING_NODES = """
SELECT 'c' || CAST(c_custkey AS STRING) AS node_id, 'buy' || CAST(c_custkey % 9 AS STRING) AS name,
       '/app/controller/buy' || CAST(c_custkey % 20 AS STRING) || '.php' AS file,
       CAST(c_custkey % 300 AS INTEGER) + 1 AS line, 'Method' AS type FROM customer
UNION ALL
SELECT 's' || CAST(s_suppkey AS STRING), 'supply' || CAST(s_suppkey % 7 AS STRING),
       CASE WHEN s_suppkey % 2 = 0 THEN '/app/controller/supply.php' ELSE '/src/supply.php' END,
       CAST(s_suppkey % 100 AS INTEGER) + 1, 'Method' FROM supplier
UNION ALL
SELECT 'n' || CAST(n_nationkey AS STRING), CASE WHEN n_nationkey % 5 = 1 THEN 'exec' ELSE 'route' || CAST(n_nationkey AS STRING) END,
       '/src/nation.java', n_nationkey + 1, 'Function' FROM nation
UNION ALL
SELECT 'r' || CAST(r_regionkey AS STRING), CASE r_regionkey WHEN 0 THEN 'eval' WHEN 1 THEN 'unserialize' ELSE 'dispatchJob' END,
       '/vendor/region.java', r_regionkey + 1, 'Function' FROM region
"""

# Name registrations (A1 input): page host labels and part words, each with
# a catalog source, its score, a global order and an optional vuln type.
V_REGISTRY_INPUT = """
SELECT regexp_extract(url, '^https?://([^./]+)', 1) AS name,
       CASE page_id % 3 WHEN 0 THEN 'context' WHEN 1 THEN 'semgrep' ELSE 'api_parse' END AS source,
       CASE page_id % 3 WHEN 0 THEN CASE WHEN page_id % 2 = 0 THEN 3 ELSE 2 END WHEN 1 THEN 2 ELSE 1 END AS score,
       page_id AS ord,
       CASE page_id % 5 WHEN 0 THEN 'sqli' WHEN 1 THEN 'xss' WHEN 2 THEN '' ELSE 'ssrf' END AS vuln_type
FROM pages
UNION ALL
SELECT split_part(p_name, ' ', 2), CASE p_partkey % 3 WHEN 0 THEN 'surface_scan' WHEN 1 THEN 'context' ELSE 'semgrep' END,
       CASE p_partkey % 3 WHEN 0 THEN CASE WHEN p_size > 25 THEN 2 ELSE 1 END WHEN 1 THEN 3 ELSE 2 END,
       1000000 + p_partkey, lower(p_type)
FROM part
"""

# Context-declared tainted function parameters (J4 input).
V_FN_PARAMS = """
SELECT 'handler_' || CAST(n_nationkey * 9 AS STRING) AS function,
       CASE n_nationkey % 2 WHEN 0 THEN 'item_id' ELSE 'user_id' END AS param
FROM nation
"""

# Tool-call log (one record per event).
V_CALLS = """
SELECT ts, 'run_' || CAST(user_id AS STRING) AS run_id, event_type AS tool,
       CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status,
       CAST(floor(value * 100 + 0.5) AS BIGINT) AS duration_ms, props AS args, event_id
FROM events
"""

# One business-context document per conversation: Markdown with the conversation's own text as notes,
# or (every seventh) structured JSON.
V_CONTEXT_DOCS = """
SELECT conv_id AS doc_id, CASE WHEN conv_id % 7 = 3 THEN concat(
  '{"custom_sinks": [{"name": "exec', CAST(conv_id % 9 AS STRING), '", "vuln_type": "rce"}, "bare", {"name": "log", "confidence": "LOW"}], ',
  '"custom_sources": [{"class": "App.Queue.Reader', CAST(conv_id % 4 AS STRING), '", "name": "take"}, {"name": "poll", "note": "timer"}], ',
  '"sensitive_flows": [{"entry": "/pay', CAST(conv_id % 3 AS STRING), '"}], "non_http_sources": ["cron::run", 5], ',
  '"api_names": ["GetAll", {"name": "PutOne"}, {"path": "/x"}, ""], "function_params": [{"function": "save", "param": "sql"}, {"param": "y"}, ',
  '{"function": "load"}], "business_notes": "n"}')
 WHEN conv_id % 7 = 4 THEN '{"title": "none of these keys"}'
 ELSE concat('# Business Context ', CAST(conv_id AS STRING), chr(10), chr(10),
  '## System Overview', chr(10), 'Platform ', CAST(conv_id AS STRING), ' with ', CAST(n AS STRING), ' turns.', chr(10), chr(10),
  '## Custom Sinks (security-critical methods)', chr(10), chr(10),
  '### OrderRepository', CAST(conv_id % 7 AS STRING), '::rawExec', chr(10),
  '- Class: `App.Repositories.OrderRepository`', chr(10),
  '- Method: `rawExec(string $sql)`', chr(10),
  '- Risk: Executes raw SQL', chr(10), CASE WHEN conv_id % 5 = 0 THEN '- Risk: ""' ELSE '' END, chr(10),
  CASE WHEN conv_id % 2 = 0 THEN '- Vuln type: sqli' ELSE '- Note: shell command built from input' END, chr(10), chr(10),
  '### PaymentGateway::charge', chr(10), '- Risk: amount field is customer controlled', chr(10), chr(10),
  '## Custom Sources (non-HTTP inputs)', chr(10), chr(10),
  '### QueueConsumer::getPayload', chr(10), '- Class: `App.Queue.QueueConsumer`', chr(10),
  '- Source type: queue', chr(10), chr(10),
  '### handle', CAST(conv_id % 3 AS STRING), chr(10), '- Note: event data', chr(10), chr(10),
  CASE WHEN conv_id % 4 = 1 THEN concat('### QueueConsumer::getPayload', chr(10), '- Class: App.Queue.QueueConsumer', chr(10)) ELSE '' END,
  '## Sensitive Flows', chr(10), chr(10),
  '### /webhook/payment', CAST(conv_id % 5 AS STRING), ' (POST)', chr(10), '- Risk: No authentication', chr(10), chr(10),
  '### /checkout/guest (POST)', chr(10), '- Impact: order manipulation', chr(10), chr(10),
  '## API Names', chr(10), CASE WHEN conv_id % 2 = 0 THEN concat('- GetDataSet(sql, connStr): raw SQL', chr(10), '* Ping', CAST(conv_id % 6 AS STRING),
     ': health', chr(10), '- # hidden', chr(10), '(nameless)')
   ELSE concat('### GetRows(sql)', chr(10), '- Params: sql, top', chr(10), '- Note: raw', chr(10), '### POST /api/data', chr(10), '- Path: /api/data') END, chr(10),
  '## Function Params', chr(10), CASE WHEN conv_id % 3 = 0 THEN concat('- RunSql(sql, , conn) : goes to the driver', chr(10), 'Plain: reason', chr(10), 'Alone')
   ELSE concat('### Fill(q)', chr(10), '- Taint reason: raw', chr(10), '### Other', chr(10), '- Param: a ') END, chr(10),
  '## Business Notes', chr(10), '- Multi-tenant: company_id must be enforced', chr(10),
  '- Admin panel uses AdminGuard', chr(10), said, chr(10)) END AS text
FROM (SELECT conv_id, count(*) AS n, replace(max(text), '#', '') AS said FROM conversations GROUP BY conv_id) t
"""

# Raw field declarations of data models (one model per part).
V_MODEL_FIELDS = """
SELECT 'Model' || CAST(p_partkey AS STRING) AS model_name, '/src/models/M' || CAST(p_partkey AS STRING) || '.cs' AS file, f.pos,
  CASE f.pos WHEN 0 THEN 'password'
    WHEN 1 THEN 'private String ' || lower(split_part(p_name, ' ', 1)) || '_key'
    WHEN 2 THEN CASE WHEN p_partkey % 2 = 0 THEN 'pin_hash: str' ELSE 'role: str' END
    WHEN 3 THEN 'readonly token: string'
    WHEN 4 THEN 'protected $' || lower(replace(p_brand, '#', '_'))
    WHEN 5 THEN CASE WHEN p_partkey % 3 = 0 THEN 'public bool IsAdmin { get; set; }' ELSE 'private String password' END
    WHEN 6 THEN 'public decimal Balance { get; set; }'
    WHEN 7 THEN CASE WHEN p_size > 25 THEN 'public string Status { get; set; }' ELSE 'created_at' END
    ELSE lower(replace(p_type, ' ', '_')) || ': int' END AS raw
FROM part CROSS JOIN (SELECT 0 AS pos UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4
  UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7 UNION ALL SELECT 8) f
"""

# Class nodes and their parts: one class per part, fields from its words.
V_MODEL_NODES = """
SELECT 'c' || CAST(p_partkey AS STRING) AS node_id,
  CASE p_partkey % 3 WHEN 0 THEN 'OrderModel' || CAST(p_partkey AS STRING) WHEN 1 THEN 'Plain' || CAST(p_partkey AS STRING) ELSE 'UserEntity' END AS name,
  CASE p_partkey % 5 WHEN 0 THEN '/src/Domain/a.cs' ELSE '/src/x' || CAST(p_partkey % 7 AS STRING) || '.cs' END AS file,
  CASE p_partkey % 4 WHEN 0 THEN 'Struct' WHEN 1 THEN 'Interface' ELSE 'Class' END AS type FROM part
UNION ALL
SELECT 'f' || CAST(p_partkey AS STRING) || '_' || CAST(k AS STRING), CASE k WHEN 0 THEN split_part(p_name, ' ', 1) WHEN 1 THEN p_brand ELSE 'id' END,
  '/src/f.cs', CASE (p_partkey + k) % 3 WHEN 0 THEN 'Property' WHEN 1 THEN 'Field' ELSE 'Method' END
FROM part CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) t
"""
V_MODEL_PARTS = """
SELECT 'c' || CAST(p_partkey AS STRING) AS parent, 'f' || CAST(p_partkey AS STRING) || '_' || CAST(k AS STRING) AS child
FROM part CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) t
"""

# Results of tool calls as JSON text, one per event.
V_RESULTS = """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'semgrep_scan' WHEN 1 THEN 'triage_score' WHEN 2 THEN 'secrets_scan' WHEN 3 THEN 'joern_filter'
    ELSE 'other_tool' END AS tool,
  CASE WHEN event_id % 17 = 3 THEN '{"error": "timeout of ' || CAST(event_id AS STRING) || '", "count": 1}'
    WHEN event_id % 19 = 4 THEN 'plain text'
    ELSE CASE event_id % 5
      WHEN 0 THEN concat('{"sources": [1, 2', CASE WHEN event_id % 2 = 0 THEN ', 3' ELSE '' END, '], "sinks": [], "saved_to": "a/', CAST(event_id AS STRING), '.json"}')
      WHEN 1 THEN concat('{"scored": [{"score": ', CAST(event_id % 13 AS STRING), '}, {"score": 4}], "count": 2}')
      WHEN 2 THEN CASE WHEN event_id % 3 = 0 THEN '{"findings": []}' ELSE '{"findings": [{"type": "token"}, {"type": "password"}, {"type": "token"}, {}]}' END
      WHEN 3 THEN concat('{"confirmed_count": ', CAST(event_id % 7 AS STRING), ', "skipped_count": 2}')
      ELSE '{"total": 5}' END END AS result
FROM events
"""
