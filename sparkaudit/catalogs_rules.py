"""Packaged scan rules."""

from __future__ import annotations

# FIXED VALUES — sources that C# rules share: request parts, and parameters of controller methods.
_CS = ["Request.Query[...]", "Request.Form[...]", "Request.Headers[...]"]
_CS_CLASS = ["class $CLASS : Controller", "class $CLASS : ControllerBase"]

# FIXED VALUES — (id, message, severity, language, cwe, owasp, source patterns, sink patterns).  `...` stands for
# anything, `$NAME` for a name; rules without sources report any sink.
RULES = [
    ("csharp-sqli-sqlcommand", "Tainted input used in SQL command — potential SQL Injection", "ERROR", "csharp", "CWE-89", "A03:2021",
     [*_CS, "Request.Cookies[...]", "HttpContext.Request.Query[...]", "HttpContext.Request.Form[...]", *_CS_CLASS],
     ["new SqlCommand($X, ...)", "new SqlCommand($X)", "$CMD.CommandText = $X", "$CMD.CommandText += $X"]),
    ("csharp-ef-sqli-fromsqlraw", "Tainted input used in Entity Framework FromSqlRaw — potential SQL Injection", "ERROR", "csharp",
     "CWE-89", "A03:2021", [*_CS, *_CS_CLASS],
     ["$DB.Set<$T>().FromSqlRaw($X, ...)", "$DB.Database.ExecuteSqlRaw($X, ...)", "$DB.Database.ExecuteSqlCommand($X, ...)"]),
    ("csharp-command-injection-process-start", "Process.Start() called with tainted input — potential Command Injection", "ERROR",
     "csharp", "CWE-78", "A03:2021", [*_CS, "HttpContext.Request.Query[...]", *_CS_CLASS],
     ["Process.Start($X, ...)", "Process.Start($X)", "new ProcessStartInfo($X, ...)"]),
    ("csharp-path-traversal-file-access", "File access with tainted input — potential Path Traversal", "ERROR", "csharp", "CWE-22",
     "A01:2021", [*_CS, "HttpContext.Request.Query[...]", *_CS_CLASS],
     ["File.ReadAllText($X, ...)", "File.ReadAllBytes($X)", "File.WriteAllText($X, ...)", "File.Delete($X)", "File.OpenRead($X)",
      "File.OpenWrite($X)", "File.Open($X, ...)"]),
    ("csharp-insecure-deserialization-binaryformatter", "BinaryFormatter.Deserialize() used — RCE via insecure deserialization",
     "ERROR", "csharp", "CWE-502", "A08:2021", ["Request.Body", "Request.Form[...]", "Request.Query[...]", *_CS_CLASS],
     ["$BF.Deserialize(...)"]),
    ("csharp-xss-response-write", "Tainted input written directly to response — potential XSS", "ERROR", "csharp", "CWE-79",
     "A03:2021", [*_CS, *_CS_CLASS], ["Response.Write($X)", "Response.WriteAsync($X)"]),
    ("python-jinja2-ssti-render-template-string", "render_template_string() called with tainted input — potential SSTI", "ERROR",
     "python", "CWE-94", "A03:2021",
     ["request.args.get(...)", "request.args[...]", "request.form.get(...)", "request.form[...]", "request.json",
      "request.get_json()", "request.data", "request.values.get(...)", "request.GET.get(...)", "request.POST.get(...)"],
     ["render_template_string(...)", "flask.render_template_string(...)", "jinja2.Environment().from_string(...)",
      "jinja2.Template(...)"]),
    ("python-pickle-loads-tainted", "pickle.loads() with tainted input — RCE via deserialization", "ERROR", "python", "", "",
     ["request.data", "request.body", "request.get_json()", "request.files", "open(...)"],
     ["pickle.loads(...)", "pickle.load(...)", "dill.loads(...)", "marshal.loads(...)"]),
    ("python-yaml-unsafe-load", "yaml.load() with unsafe Loader — use yaml.safe_load() instead", "ERROR", "python", "", "",
     ["request.data", "request.body", "request.get_json()", "open(...)"],
     ["yaml.load(..., Loader=yaml.Loader)", "yaml.load(..., Loader=yaml.UnsafeLoader)", "yaml.load(..., Loader=yaml.FullLoader)"]),
    ("django-orm-raw-f-string", "Django ORM raw() with f-string — potential SQLi", "ERROR", "python", "", "", [],
     ['$MODEL.objects.raw(f"...")', "$MODEL.objects.raw(f'...')", '$MODEL.objects.raw("..." + $VAR)',
      '$MODEL.objects.extra(where=[f"..."])']),
    ("python-cursor-execute-f-string", "cursor.execute() with f-string or % formatting — potential SQLi", "ERROR", "python", "", "", [],
     ['$CURSOR.execute(f"...")', "$CURSOR.execute(f'...')", '$CURSOR.execute("..." % $VAR)', '$CURSOR.execute("..." + $VAR)']),
    ("python-os-system-tainted", "os.system() with tainted input — command injection", "ERROR", "python", "", "",
     ["request.args.get(...)", "request.form.get(...)", "request.json", "request.data", "request.GET.get(...)",
      "request.POST.get(...)"],
     ["os.system(...)", "os.popen(...)", "subprocess.run(...)", "subprocess.call(...)", "subprocess.Popen(...)",
      "subprocess.check_output(...)"]),
    ("python-environ-taint-source", "os.environ value used as taint source — verify it is not attacker-controlled", "WARNING",
     "python", "", "", [], ["$X = os.environ.get(...)"]),
]
RULE_EXTS = {"csharp": [".cs"], "python": [".py"]}

# FIXED VALUES — languages that a caller's own source patterns are looked for in.
EXTRA_EXTS = [".py", ".js", ".ts", ".java", ".go", ".php", ".rb", ".cs"]
