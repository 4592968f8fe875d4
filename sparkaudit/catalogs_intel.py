"""Fixed vocabularies of the repository-intelligence operators."""

from __future__ import annotations

# FIXED VALUES — manifest files, in reading order (regular expressions on the path in the repository).
MANIFESTS = [
    r"package\.json", r"composer\.json", r"requirements\.txt", r"requirements/[^/]*\.txt", r"pyproject\.toml", r"setup\.py",
    r"Pipfile", r"pom\.xml", r"build\.gradle", r"build\.gradle\.kts", r"go\.mod", r"Gemfile", r"Cargo\.toml",
    r"(?:.*/)?[^/]*\.csproj", r"(?:.*/)?[^/]*\.sln", r"Dockerfile", r"docker-compose\.yml", r"docker-compose\.yaml",
]

# FIXED VALUES — (pattern in a manifest, framework, language).
FRAMEWORKS = [
    (r'"laravel/framework"', "Laravel", "PHP"), (r'"symfony/symfony"', "Symfony", "PHP"), (r'"slim/slim"', "Slim", "PHP"),
    (r'"codeigniter4/framework"', "CodeIgniter 4", "PHP"), (r'"yiisoft/yii2"', "Yii2", "PHP"),
    (r'"cakephp/cakephp"', "CakePHP", "PHP"), (r'"express"', "Express.js", "Node.js"), (r'"fastify"', "Fastify", "Node.js"),
    (r'"nestjs/core"', "NestJS", "Node.js/TS"), (r'"koa"', "Koa.js", "Node.js"), (r'"hapi/hapi"', "Hapi.js", "Node.js"),
    (r'"next"', "Next.js", "Node.js/React"), (r"\bDjango\b|\bdjango\b", "Django", "Python"),
    (r"\bFlask\b|\bflask\b", "Flask", "Python"), (r"\bFastAPI\b|\bfastapi\b", "FastAPI", "Python"),
    (r"\bTornado\b|\btornado\b", "Tornado", "Python"), (r"org\.springframework", "Spring Boot", "Java"),
    (r'"io\.quarkus"', "Quarkus", "Java"), (r'"io\.micronaut"', "Micronaut", "Java"), (r"\bgin-gonic/gin\b", "Gin", "Go"),
    (r"\becho\b.*labstack", "Echo", "Go"), (r"\bfiber\b.*gofiber", "Fiber", "Go"),
    (r"\bruby on rails\b|\brails\b", "Ruby on Rails", "Ruby"), (r"\bsinatra\b", "Sinatra", "Ruby"),
    (r"Microsoft\.AspNetCore", "ASP.NET Core", ".NET/C#"), (r"Microsoft\.NET\.Sdk\.Web", "ASP.NET Core", ".NET/C#"),
]

# FIXED VALUES — language of a manifest by its name.
MANIFEST_LANGUAGE = [
    (r"package\.json", "Node.js / JavaScript"), (r"composer\.json", "PHP"), (r"requirements\.txt|Pipfile|.*requirements.*", "Python"),
    (r"pyproject\.toml", "Python"), (r"pom\.xml", "Java"), (r"build\.gradle(?:\.kts)?", "Java / Kotlin"), (r"go\.mod", "Go"),
    (r"Gemfile", "Ruby"), (r"Cargo\.toml", "Rust"), (r".*\.(?:csproj|sln)", ".NET / C#"),
]

# FIXED VALUES — (pattern in configuration or documentation, mechanism).
AUTH = [
    (r"\bjwt\b|\bJSON Web Token\b", "JWT"), (r"\boauth2?\b|\bopenid\b", "OAuth2/OIDC"), (r"\bpassport\b", "Passport.js"),
    (r"\bsanctum\b", "Laravel Sanctum"), (r"\bfortify\b", "Laravel Fortify"),
    (r"\btymon.*jwt\b", "tymondesigns/jwt-auth (Laravel)"), (r"\bjwt-auth\b", "JWT Auth"), (r"\bsession\b", "Session-based"),
    (r"\bapi.?key\b", "API Key"), (r"\bbasic.?auth\b", "Basic Auth"), (r"\bbearer\b", "Bearer Token"),
    (r"\bcasbin\b", "Casbin (RBAC/ABAC)"), (r"\bspring.?security\b", "Spring Security"), (r"\bkeycloak\b", "Keycloak"),
    (r"\bauth0\b", "Auth0"), (r"\bbouncer\b", "Bouncer (Laravel RBAC)"), (r"\bspatie.*permission\b", "Spatie Laravel-Permission"),
    (r"\bguard\b.*auth", "Guard-based auth"), (r"\bmiddleware.*auth\b", "Auth Middleware"),
    (r"\bFirebase.*auth\b", "Firebase Auth"), (r"\bcognito\b", "AWS Cognito"),
]

# FIXED VALUES — configuration and documentation files (regular expressions on the path).
AUTH_FILES = [
    r"[^/]*\.env[^/]*", r"config/.*\.(?:php|yml|yaml|json)", r"src/config/.*", r"bootstrap/.*\.(?:php|py)",
    r"app/Http/Middleware/.*\.php", r"app/Http/Kernel\.php", r"app/Providers/AuthServiceProvider\.php",
    r"(?:security|auth|authentication|authorization|middleware)/.*", r"application\.(?:yml|yaml|properties)",
    r"appsettings\.json", r"README\.md", r"docs/.*\.md",
]

# FIXED VALUES — annotation in source code: (pattern, name, language, implication).
ANNOTATIONS = [
    (r"@PreAuthorize\s*\(", "@PreAuthorize", "Java/Spring", "method-level RBAC — check SpEL expression"),
    (r"@PostAuthorize\s*\(", "@PostAuthorize", "Java/Spring", "post-auth on return value — check expression"),
    (r"@Secured\s*\(", "@Secured", "Java/Spring", "role check — check role list is complete"),
    (r"@RolesAllowed\s*\(", "@RolesAllowed", "Java/JSR-250", "JSR-250 role check"),
    (r"@PermitAll\b", "@PermitAll", "Java/JSR-250", "⚠️ public endpoint — no auth required"),
    (r"@DenyAll\b", "@DenyAll", "Java/JSR-250", "always denied"),
    (r"@Authenticate\b", "@Authenticate", "Java", "custom auth annotation"),
    (r"@WithMockUser\b", "@WithMockUser", "Java/Test", "test-only: ensure not in production paths"),
    (r"@EnableWebSecurity\b", "@EnableWebSecurity", "Java/Spring", "Spring Security config class"),
    (r"@EnableGlobalMethodSecurity\b", "@EnableGlobalMethodSecurity", "Java/Spring", "enables method-level security"),
    (r"@EnableMethodSecurity\b", "@EnableMethodSecurity", "Java/Spring", "Spring 6 method security"),
    (r"\[Authorize\b", "[Authorize]", ".NET/C#", "requires authentication"),
    (r"\[AllowAnonymous\]", "[AllowAnonymous]", ".NET/C#", "⚠️ public endpoint — bypasses auth"),
    (r"\[Authorize\s*\(Roles\s*=", "[Authorize(Roles=...)]", ".NET/C#", "role-based auth — check roles list"),
    (r"\[Authorize\s*\(Policy\s*=", "[Authorize(Policy=...)]", ".NET/C#", "policy-based auth — check policy definition"),
    (r"\[RequireHttps\]", "[RequireHttps]", ".NET/C#", "HTTPS enforcement"),
    (r"\[ValidateAntiForgeryToken\]", "[ValidateAntiForgeryToken]", ".NET/C#", "CSRF protection"),
    (r"\[IgnoreAntiforgeryToken\]", "[IgnoreAntiforgeryToken]", ".NET/C#", "⚠️ CSRF protection disabled"),
    (r"\[Authorize\s*\(AuthenticationSchemes\s*=", "[Authorize(AuthenticationSchemes=...)]", ".NET/C#", "multi-scheme auth"),
    (r"\[ClaimsPrincipalPermission\b", "[ClaimsPrincipalPermission]", ".NET/C#", "claims-based access"),
    (r'\[Authorize\s*\(Roles\s*=\s*".*Admin', "[Authorize(Roles=Admin)]", ".NET/C#", "admin-role protected endpoint"),
    (r"@login_required\b", "@login_required", "Python/Django", "requires login"),
    (r"@permission_required\s*\(", "@permission_required", "Python/Django", "specific permission check"),
    (r"@staff_member_required\b", "@staff_member_required", "Python/Django", "staff only"),
    (r"@superuser_required\b", "@superuser_required", "Python/Django", "superuser only"),
    (r"@user_passes_test\s*\(", "@user_passes_test", "Python/Django", "custom predicate check"),
    (r"@jwt_required\b", "@jwt_required", "Python/Flask-JWT", "JWT required"),
    (r"@jwt_optional\b", "@jwt_optional", "Python/Flask-JWT", "⚠️ JWT optional — auth not enforced"),
    (r"@fresh_jwt_required\b", "@fresh_jwt_required", "Python/Flask-JWT", "fresh JWT required"),
    (r"@token_required\b", "@token_required", "Python/Flask", "custom token check"),
    (r"@require_http_methods\s*\(", "@require_http_methods", "Python/Django", "HTTP method restriction"),
    (r"@Depends\s*\(", "@Depends", "Python/FastAPI", "dependency injection — check if security dep"),
    (r"Security\s*\(\s*oauth2_scheme", "Security(oauth2_scheme)", "Python/FastAPI", "OAuth2 scope enforcement"),
    (r"HTTPBearer\s*\(\)", "HTTPBearer", "Python/FastAPI", "Bearer token auth"),
    (r"HTTPBasic\s*\(\)", "HTTPBasic", "Python/FastAPI", "Basic auth"),
    (r"\*\s*@Security\s*\(", "@Security (annotation)", "PHP/Symfony", "Symfony security annotation"),
    (r"\*\s*@IsGranted\s*\(", "@IsGranted", "PHP/Symfony", "Symfony attribute auth"),
    (r"#\[Route.*\bname\b.*\]", "#[Route]", "PHP/Symfony", "Symfony route (check security)"),
    (r"#\[IsGranted\s*\(", "#[IsGranted]", "PHP/Symfony", "Symfony 6 attribute auth"),
    (r"->middleware\s*\(", "->middleware()", "PHP/Laravel", "Laravel route middleware — check auth guards"),
    (r"->withoutMiddleware\s*\(", "->withoutMiddleware()", "PHP/Laravel", "⚠️ middleware bypassed explicitly"),
    (r"auth\s*\(\s*\)", "auth() helper", "PHP/Laravel", "auth() call — check gate/policy"),
    (r"Gate::\s*(allows|denies|check|authorize)\s*\(", "Gate::", "PHP/Laravel", "Gate authorization check"),
    (r"\$this->authorize\s*\(", "$this->authorize()", "PHP/Laravel", "Controller authorize call"),
    (r"Policy\b.*\bauthorize\b", "Policy authorize", "PHP/Laravel", "policy-based authorization"),
    (r"@UseGuards\s*\(", "@UseGuards", "NestJS", "guard applied — check guard implementation"),
    (r"@Roles\s*\(", "@Roles", "NestJS", "role decorator — check RolesGuard impl"),
    (r"@Public\s*\(\)", "@Public()", "NestJS", "⚠️ public endpoint — no auth required"),
    (r"@Auth\s*\(", "@Auth", "NestJS", "custom auth decorator"),
    (r"@Permissions\s*\(", "@Permissions", "NestJS", "permission decorator"),
    (r"passport\.authenticate\s*\(", "passport.authenticate()", "Node.js", "Passport.js strategy"),
    (r"requireAuth\b", "requireAuth", "Node.js", "custom auth middleware"),
    (r"isAuthenticated\s*\(\)", "isAuthenticated()", "Node.js", "Passport isAuthenticated check"),
    (r"verifyToken\b", "verifyToken", "Node.js", "custom JWT verify middleware"),
    (r"middleware\.Auth\b", "middleware.Auth", "Go", "auth middleware"),
    (r"AuthMiddleware\b", "AuthMiddleware", "Go", "auth middleware"),
    (r"RequireAuth\b", "RequireAuth", "Go", "require auth helper"),
    (r"jwt\.ParseWithClaims\s*\(", "jwt.ParseWithClaims", "Go", "JWT parse — check claims validation"),
    (r"claims\.Valid\s*\(\)", "claims.Valid()", "Go", "JWT claims validation"),
    (r"before_action\s*:authenticate", "before_action :authenticate", "Ruby/Rails", "auth before action"),
    (r"before_action\s*:require_login", "before_action :require_login", "Ruby/Rails", "login required"),
    (r"authorize\s*!\b", "authorize!", "Ruby/CanCanCan", "CanCan authorization"),
    (r"can\?\s*\(", "can?", "Ruby/CanCanCan", "CanCan ability check"),
    (r"policy\s*\(", "policy()", "Ruby/Pundit", "Pundit policy check"),
    (r"pundit_authorize\b|authorize\s+@", "authorize @", "Ruby/Pundit", "Pundit authorize call"),
    (r"skip_before_action\s*:authenticate", "skip_before_action :authenticate", "Ruby/Rails", "⚠️ auth skipped for some actions"),
    (r"#\[protect\b", "#[protect]", "Rust/Actix", "route protection attribute"),
    (r"require_auth\b", "require_auth", "Rust", "auth middleware"),
]
WARNING = "⚠️"

# FIXED VALUES — part of an annotation's name -> mechanism it implies.
ANNOTATION_MECHANISM = [
    ("@PreAuthorize", "Spring Security (RBAC)"), ("@Secured", "Spring Security (RBAC)"), ("@RolesAllowed", "JSR-250 Role-based"),
    ("[Authorize]", ".NET Authorization"), ("[AllowAnonymous]", ".NET Authorization"), ("@login_required", "Django Auth"),
    ("@jwt_required", "Flask-JWT"), ("@UseGuards", "NestJS Guards"), ("authorize!", "CanCanCan (Ruby)"), ("policy()", "Pundit (Ruby)"),
    ("@IsGranted", "Symfony Authorization"), ("#[IsGranted", "Symfony Authorization"),
    ("$this->authorize()", "Laravel Gate/Policy"), ("Gate::", "Laravel Gate"),
]
PUBLIC_MARKERS = ["@Public()", "[AllowAnonymous]", "@PermitAll", "->withoutMiddleware()", "@jwt_optional"]

# FIXED VALUES — source files and folders that are not read.
SOURCE_EXTS = [".java", ".kt", ".cs", ".py", ".php", ".ts", ".js", ".go", ".rb", ".rs"]
ROLE_EXTS = [".php", ".java", ".kt", ".cs", ".py", ".ts", ".js", ".rb"]
SKIP_DIRS = ["node_modules", ".git", ".gradle", "vendor", "dist", "build", "target", "__pycache__"]
QUEUE_SKIP_DIRS = [*SKIP_DIRS, "coverage"]

# FIXED VALUES — role named by a line, first pattern that matches.
ROLE_PATTERNS = [
    r"""hasRole\s*\(\s*["']([^"']+)["']""", r"""hasAuthority\s*\(\s*["']([^"']+)["']""",
    r"""@Secured\s*\(\s*\{["']([^"']+)["']""", r"""@RolesAllowed\s*\(\s*\{?["']([^"']+)["']""",
    r"""\[Authorize\s*\(Roles\s*=\s*"([^"]+)"\)""", r"""\[Authorize\s*\(Policy\s*=\s*"([^"]+)"\)""",
    r"""@Roles\s*\(\s*(?:Role\.)?([\w.]+)""", r"""@Permissions\s*\(\s*["']([^"']+)["']""",
    r"""->middleware\s*\(\s*["']can:([^"']+)["']""", r"""Gate::define\s*\(\s*["']([^"']+)["']""",
    r"""\$this->authorize\s*\(\s*["']([^"']+)["']""",
]
ROLE_CONST_RE = (r"""(?:(?:const|ROLE_|enum\s+\w+\s*\{|Role\.\w+\s*=)\s*["']?([A-Z][A-Z0-9_]{2,})["']?"""
                 r"""|["']([a-z]+:[a-z_]+)["'])""")
# FIXED VALUES — policy definition files (patterns with braces are written out).
POLICY_FILES = [
    r"app/Policies/[^/]*\.php", r"app/policies/.*\.rb", r"src/(?:.*/)?policy[^/]*\.(?:java|kt)", r"src/(?:.*/)?[^/]*Policy\.(?:ts|js)",
    r"(?:.*/)?[^/]*Permission[^/]*\.(?:php|py|ts|rb|java|cs)", r"(?:.*/)?[^/]*Role[^/]*\.(?:php|py|ts|rb|java|cs)",
    r"(?:.*/)?[^/]*Gate[^/]*\.(?:php|java)", r"config/policies/.*", r"src/security/.*", r"src/auth/.*",
]

# FIXED VALUES — folder names and source patterns of asynchronous work.
QUEUE_DIRS = ["queue", "queues", "jobs", "job", "workers", "worker", "consumers", "consumer", "listeners", "listener", "events",
              "event", "tasks", "task", "processors", "processor", "subscribers", "subscriber", "handlers", "handler",
              "schedulers", "scheduler", "commands", "command", "messaging"]
QUEUE_PATTERNS = [
    r"@Scheduled\b", r"@RabbitListener\b", r"@KafkaListener\b", r"@JmsListener\b", r"@SqsListener\b", r"@Async\b",
    r"implements\s+Job\b", r"extends\s+QuartzJobBean\b", r"\bBackgroundService\b", r"\bIHostedService\b", r"\bIBackgroundTask\b",
    r"\[Queue\b", r"\bHangfire\b", r"\bMassTransit\b", r"@app\.task\b|@shared_task\b", r"\bcelery\b", r"\brq\.job\b|@job\b",
    r"\bdramatiq\b", r"@Processor\s*\(", r"@Process\s*\(", r"\bQueue\.process\b", r"\bnew\s+Worker\s*\(", r"\basynq\.NewWorker\b",
    r"\bmachinery\.NewWorker\b", r"implements\s+ShouldQueue\b", r"extends\s+Mailable\b", r"implements\s+ShouldBroadcast\b",
    r"\bSchedule::\b",
]
ASYNC_NOTE = "Async job/queue processing detected"

# FIXED VALUES — (top-level folders, note), then (parts of a path, note).
DIR_SIGNALS = [(["services", "apps", "packages", "microservices"], "Monorepo / microservice structure detected"),
               (["api", "rest", "graphql", "grpc", "proto"], "API-first architecture")]
PATH_SIGNALS = [
    (["upload", "storage"], "File upload/storage functionality present"),
    (["admin"], "Admin panel detected — check for separate auth path"),
    (["public", "guest"], "Public/guest-accessible routes likely present"),
    (["payment", "billing", "checkout"], "Payment/billing functionality detected — business-critical flows"),
    (["webhook", "callback"], "Webhook/callback endpoints detected — validate sender identity"),
]
TENANT_HINTS = ["company_id", "tenant_id", "organization_id", "workspace_id", "account_id"]
ROLE_FILE_WORDS = ["role", "permission"]
ROLE_FILES_SHOWN = 5

# FIXED VALUES — (stack, files or folders at the top that show it).
TECH_STACK = [
    ("Python/Django", ["manage.py", "wsgi.py", "settings.py"]), ("Python/Flask", ["app.py", "flask"]),
    ("Python/FastAPI", ["fastapi"]), ("PHP/Laravel", ["artisan", "composer.json"]), ("Node.js/Express", ["package.json", "express"]),
    ("Java/Spring", ["pom.xml", "build.gradle"]), ("Go", ["go.mod"]), ("Ruby/Rails", ["Gemfile", "config/routes.rb"]),
]
README_NAMES = ["README.md", "README.rst", "README.txt", "README", "readme.md"]
INFO_MANIFESTS = ["package.json", "composer.json", "pyproject.toml", "go.mod"]
ENV_FILES = [".env.example", ".env.sample", ".env.template"]
