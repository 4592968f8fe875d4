"""Repositories for the intelligence operators: one per page, besides the source files of ``v_src_files``.

A page gives its repository a manifest, a readme or guide (the page's own HTML), an environment template,
a source file and a file in a telling folder.
"""

V_REPO_FILES = """
SELECT repo, path, content FROM v_src_files
UNION ALL
SELECT 'svc' || CAST(page_id AS STRING) AS repo,
  CASE f WHEN 0 THEN CASE page_id % 9 WHEN 0 THEN 'package.json' WHEN 1 THEN 'composer.json' WHEN 2 THEN 'requirements.txt'
      WHEN 3 THEN 'go.mod' WHEN 4 THEN 'pom.xml' WHEN 5 THEN 'src/web/App.csproj' WHEN 6 THEN 'Gemfile'
      WHEN 7 THEN 'pyproject.toml' ELSE 'docker-compose.yml' END
    WHEN 1 THEN CASE page_id % 3 WHEN 0 THEN 'README.md' WHEN 1 THEN 'readme.md' ELSE 'docs/guide.md' END
    WHEN 2 THEN CASE page_id % 2 WHEN 0 THEN '.env.example' ELSE '.env.template' END
    WHEN 3 THEN CASE page_id % 6 WHEN 0 THEN 'src/security/RoleCheck.java' WHEN 1 THEN 'app/Policies/OrderPolicy.php'
      WHEN 2 THEN 'src/auth/roles.ts' WHEN 3 THEN 'jobs/mailer.py' WHEN 4 THEN 'app/admin/upload_controller.rb'
      ELSE 'src/guest/Checkout.cs' END
    WHEN 4 THEN CASE page_id % 5 WHEN 0 THEN 'services/api/main.go' WHEN 1 THEN 'graphql/schema.ts'
      WHEN 2 THEN 'lib/workers/run.rb' WHEN 3 THEN 'modules/tenant_id/model.py' ELSE 'vendor/queue/hook.js' END
    ELSE CASE page_id % 4 WHEN 0 THEN 'artisan' WHEN 1 THEN 'config/auth.yml' WHEN 2 THEN 'tools/composer.json' ELSE 'README.rst' END
  END AS path,
  CASE f WHEN 0 THEN CASE page_id % 9
      WHEN 0 THEN concat('{"name": "svc', CAST(page_id AS STRING), '", "description": "shop", "dependencies": {"express": "4", "lib',
        CAST(page_id AS STRING), '": "1"}, "devDependencies": {"typescript-lint": "5"}}')
      WHEN 1 THEN concat('{"name": "acme/svc', CAST(page_id AS STRING), '", "require": {"php": "^8.', CAST(page_id % 4 AS STRING),
        '", "laravel/framework": "10"}}')
      WHEN 2 THEN concat('# pinned', chr(10), 'Django==4.', CAST(page_id % 3 AS STRING), chr(10), 'celery>=5', chr(10), 'flask')
      WHEN 3 THEN concat('module example.org/svc', CAST(page_id AS STRING), chr(10), 'require (', chr(10), chr(9),
        'github.com/gin-gonic/gin v1.', CAST(page_id % 5 AS STRING), chr(10), chr(9), 'local v0', chr(10), ')')
      WHEN 4 THEN '<groupId>org.springframework.boot</groupId>'
      WHEN 5 THEN '<Project Sdk="Microsoft.NET.Sdk.Web">'
      WHEN 6 THEN concat('source "https://example.org"', chr(10), 'gem "sinatra"')
      WHEN 7 THEN concat('[project]', chr(10), 'name = "svc-', CAST(page_id AS STRING), '"', chr(10), 'dependencies = ["fastapi"]')
      ELSE 'services: {web: {image: rails}}' END
    WHEN 1 THEN html
    WHEN 2 THEN concat('# keys', chr(10), 'DB_PASSWORD=', chr(10), 'JWT_SECRET=a=b', chr(10), 'plain', chr(10), ' # off=1', chr(10),
        'API_KEY_', CAST(page_id AS STRING), '=x')
    WHEN 3 THEN CASE page_id % 6
      WHEN 0 THEN concat('@RolesAllowed({"', CASE page_id % 4 WHEN 0 THEN 'AUDITOR' ELSE 'CLERK' END, '"})', chr(10),
        'if (hasRole("admin")) {}', chr(10), 'const AUDITOR = 1; perm("read:orders")', chr(10), '@PermitAll', chr(10), '@Scheduled')
      WHEN 1 THEN concat('<?php', chr(10), '$this->authorize("update");', chr(10), 'Gate::define("close", f);', chr(10),
        '->withoutMiddleware("x")', chr(10), 'implements ShouldQueue')
      WHEN 2 THEN concat('@Roles(Role.Admin)', chr(10), '@UseGuards(G)', chr(10), 'enum Role { ADMIN }', chr(10), 'can("write:users")')
      WHEN 3 THEN concat('@shared_task', chr(10), '@jwt_optional', chr(10), 'def run(): pass')
      WHEN 4 THEN concat('before_action :authenticate', chr(10), 'authorize @item', chr(10), 'policy (x)')
      ELSE concat('[Authorize(Roles = "Boss")]', chr(10), '[AllowAnonymous]', chr(10), '[Authorize(Policy = "P', CAST(page_id % 3 AS STRING), '")]')
      END
    WHEN 4 THEN CASE page_id % 2 WHEN 0 THEN 'new Worker (q)' ELSE 'plain text' END
    ELSE CASE page_id % 4 WHEN 1 THEN concat('session: true', chr(10), 'api-key: ', CAST(page_id AS STRING), chr(10), 'basic auth')
      WHEN 2 THEN '{"require": {"slim/slim": "4"}}' ELSE concat('about ', CAST(page_id AS STRING)) END
  END AS content
FROM pages CROSS JOIN (SELECT 0 AS f UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4
  UNION ALL SELECT 5) n
"""
