"""Fixed vocabularies of surface scan, topics and severity rules."""

from __future__ import annotations

# FIXED VALUES — (part of the lower-case path, layer, confidence), first match counts.
LAYERS = [
    ("service", "service", "MEDIUM"), ("repository", "repository", "MEDIUM"), ("/repo/", "repository", "MEDIUM"),
    ("dao", "dao", "MEDIUM"), ("gateway", "gateway", "MEDIUM"), ("adapter", "adapter", "MEDIUM"), ("handler", "handler", "LOW"),
    ("controller", "controller", "LOW"), ("action", "action", "LOW"), ("processor", "processor", "LOW"), ("store/", "store", "LOW"),
    ("manager", "manager", "LOW"), ("dispatcher", "dispatcher", "LOW"), ("executor", "executor", "LOW"), ("writer", "writer", "LOW"),
    ("sender", "sender", "LOW"),
]
SURFACE_EXTS = [".py", ".java", ".js", ".ts", ".go", ".php", ".rb", ".cs", ".kt"]

# FIXED VALUES — words of class names and route segments that are no domain words.
CLASS_LAYER_SUFFIXES = [
    "service", "repository", "repo", "controller", "handler", "manager", "adapter", "gateway", "processor", "factory", "provider",
    "builder", "listener", "observer", "decorator", "command", "query", "request", "response", "exception", "error", "helper", "util",
    "base", "abstract", "impl", "test", "spec", "mock", "facade", "interface", "contract", "trait", "mixin", "dto", "vo", "entity",
    "model", "schema", "serializer", "validator", "middleware", "interceptor", "filter", "component", "module", "config", "settings",
    "client", "server", "worker", "job", "task", "event", "message", "publisher", "subscriber", "consumer", "producer", "emitter",
]
ROUTE_VERB_SKIP = [
    "api", "v1", "v2", "v3", "v4", "rest", "graphql", "grpc", "create", "update", "delete", "remove", "edit", "patch", "list", "show",
    "index", "store", "destroy", "fetch", "find", "search", "get", "post", "put", "new", "all", "bulk", "batch", "import", "export",
    "sync", "status", "health", "ping", "info", "version", "docs", "swagger",
]
CLASS_DEF_RE = r"\bclass\s+([A-Z][A-Za-z0-9_]+)"
GO_STRUCT_RE = r"\btype\s+([A-Z][A-Za-z0-9_]+)\s+struct\b"
ROUTE_STR_RE = r"""['"](/[a-zA-Z0-9_/-]{4,})['"]"""

# FIXED VALUES — data model classes and their parts.
MODEL_TYPES = ["Class", "Struct"]
MODEL_NAME_WORDS = ["model", "entity"]
MODEL_FILE_WORDS = ["/models/", "/entities/", "/domain/", "/schemas/", "models.py", "/app/models"]
FIELD_TYPES = ["Property", "Field", "Variable", "Member"]

# FIXED VALUES — fields that raise a severity.
FINANCIAL_RE = r"(?i)balance|card|amount|price|wallet|points|discount|iban|payment|credit"
PRIVILEGE_RE = r"(?i)role|admin|permission|privilege|tier|level|clearance|account_type|superuser|is_staff"

# FIXED VALUES — paths that need a rate limit, marks of one, and libraries that give one.
RATE_LIMIT_PATHS = {
    "auth": ["/login", "/signin", "/authenticate", "/token"],
    "password": ["/password-reset", "/forgot-password", "/change-password"],
    "otp": ["/otp", "/verify", "/confirm", "/2fa"],
    "message": ["/send-email", "/resend", "/notify"],
    "signup": ["/register", "/signup", "/create-account"],
    "payment": ["/checkout", "/pay", "/order", "/purchase"],
    "admin": ["/admin", "/sudo", "/impersonate"],
}
RATE_LIMIT_TAGS = ["ratelimit", "limiter", "throttle"]
RATE_LIMIT_LIBS = ["limiter", "rate-limit", "ratelimit", "throttle"]

# FIXED VALUES — findings that a person must see.
MANUAL_REVIEW = {
    "financial": r"(?i)payment|transfer|refund|balance|price",
    "tenant": r"(?i)tenant|company_id|organization",
    "state": r"(?i)state machine|workflow|approval|order status",
    "rule": r"(?i)business rule|business logic|business_critical",
}

# FIXED VALUES — (playbook, scenario, confidence).
CONFIDENCE = [
    ("injection", "User input → string concat → query execution", "HIGH"),
    ("injection", "User input → parameterized query", "FALSE POSITIVE"),
    ("injection", "`escapeshellarg()` wrapping full input", "MED — check bypass"),
    ("injection", "`shell=True` + user input", "HIGH"),
    ("injection", "User controls template string (not context var)", "HIGH"),
    ("injection", "XML parsed with no entity-disabled parser", "HIGH"),
    ("injection", "ORM `.filter(col=val)` / `.where(col: val)`", "FALSE POSITIVE"),
    ("injection", "`intval()` in numeric-only SQL fragment", "LOW (safe)"),
    ("authz", "DB lookup by user-controlled ID, no ownership check", "HIGH"),
    ("authz", "DB lookup scoped by `user_id = current_user.id`", "FALSE POSITIVE"),
    ("authz", "Admin endpoint with only `@login_required`", "HIGH"),
    ("authz", 'JWT `algorithms=["none"]` or from header', "CRITICAL"),
    ("authz", "`session_regenerate_id()` after login", "FALSE POSITIVE"),
    ("authz", "`request.json` → `Model(**data)` no field filter", "HIGH"),
    ("authz", "`$fillable` properly set", "FALSE POSITIVE"),
    ("infosec", "CORS reflects Origin + `Allow-Credentials: true`", "HIGH"),
    ("infosec", "CORS `*` without credentials", "LOW (no auth data exposed)"),
    ("infosec", "`user.__dict__` in JSON response, model has `sensitive_fields`", "HIGH"),
    ("infosec", "`user.__dict__` in JSON response, no sensitive fields", "MEDIUM"),
    ("infosec", "Explicit field selection in response", "FALSE POSITIVE"),
    ("infosec", "DTO/serializer class that excludes sensitive fields", "FALSE POSITIVE"),
    ("infosec", "`DEBUG=True` in production config", "HIGH"),
    ("infosec", "Cookie missing `Secure` on HTTPS app", "MEDIUM"),
    ("client_side", "User input → `innerHTML` / `document.write`", "HIGH"),
    ("client_side", "User input → `textContent` / `innerText`", "FALSE POSITIVE"),
    ("client_side", "Jinja2 template with `| safe` on user data", "HIGH"),
    ("client_side", "Auto-escaped template, no `| safe`", "FALSE POSITIVE"),
    ("client_side", "State-changing POST with no CSRF token + no SameSite", "HIGH"),
    ("client_side", "Cookie has `SameSite=Strict`", "FALSE POSITIVE (CSRF)"),
    ("client_side", "`redirect(user_input)` no domain check", "HIGH"),
    ("client_side", "Open redirect + path only (no domain) accepted", "LOW"),
    ("deserialize", "`pickle.loads(user_input)`", "CRITICAL"),
    ("deserialize", "`yaml.load()` without SafeLoader + user input", "HIGH"),
    ("deserialize", "`unserialize(cookie)` — PHP gadgets present", "HIGH"),
    ("deserialize", "`ObjectInputStream.readObject()` from network", "HIGH"),
    ("deserialize", "`json.loads()` / `yaml.safe_load()`", "FALSE POSITIVE"),
    ("deserialize", "Deserialization of server-generated, signed token", "LOW — verify signature check"),
    ("availability", "Login endpoint, no rate limit middleware visible", "HIGH"),
    ("availability", "Rate limit via CDN/infrastructure (not in code)", "UNCERTAIN — note it"),
    ("availability", "User input → loop count, no cap", "HIGH"),
    ("availability", "`min(count, MAX)` cap applied", "FALSE POSITIVE"),
    ("availability", "Catastrophic backtracking regex + user input", "HIGH"),
    ("availability", "Fixed regex, no user input", "FALSE POSITIVE"),
    ("business_logic", "Read-check-write pattern, no DB lock/atomic update", "HIGH"),
    ("business_logic", "`UPDATE ... WHERE status = 'pending'` atomic", "FALSE POSITIVE"),
    ("business_logic", "Numeric user input → arithmetic, no positive check", "HIGH"),
    ("business_logic", "`abs(amount)` forces positive", "FALSE POSITIVE (if applied before arithmetic)"),
    ("business_logic", "Multi-step flow, step N accessible without step N-1 state", "HIGH"),
    ("business_logic", "Status verified from DB before action", "FALSE POSITIVE"),
    ("cache_protocol", "`X-Forwarded-Host` reflected in cacheable response", "HIGH"),
    ("cache_protocol", "`Host` header in password reset URL", "HIGH"),
    ("cache_protocol", "BASE_URL from config in reset URL", "FALSE POSITIVE"),
    ("cache_protocol", "Cache-Control: no-store on all sensitive responses", "FALSE POSITIVE (cache deception)"),
    ("cache_protocol", "CL.TE desync on HTTP/1.1 endpoint behind proxy", "HIGH — verify with PoC"),
    ("special", "User input directly in LLM prompt + agent has tool access", "HIGH"),
    ("special", "User input in LLM prompt, output only displayed (no tool)", "MEDIUM"),
    ("special", "External URL content fed to LLM without isolation", "MEDIUM"),
    ("special", "`pickle.load()` on user-uploaded model file", "CRITICAL"),
    ("special", "`safetensors` format used", "FALSE POSITIVE"),
    ("special", "`trust_remote_code=True` from untrusted source", "HIGH"),
]
