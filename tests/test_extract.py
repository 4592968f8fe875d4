"""Golden tests for corpus extraction."""
from pyspark.sql import functions as F

from sparkaudit.operators import endpoints as E
from sparkaudit.operators import rollup as R
from sparkaudit.operators import secrets as S
from sparkaudit.operators import classify as C

SHOP_PY = """import os
from flask import Blueprint, request

shop = Blueprint("shop", __name__)


@shop.route("/orders/lookup")
def find_order():
    number = request.args.get("number")
    return render(load_order(number))
"""

MAIL_PHP = """<?php
namespace App;

// transport
$smtp_password = "tr0ub4dor-9";
$to = $_POST['to'];
send_mail($to, "hi");
"""


def _files(spark, items):
    return spark.createDataFrame([("r", p, c) for p, c in items], "repo string, path string, content string")


def test_flask_route_fixture(spark):
    eps = E.endpoint_inventory(_files(spark, [("shop.py", SHOP_PY), ("mail.php", MAIL_PHP)])).collect()
    assert len(eps) == 1
    e = eps[0]
    assert (e.method, e.path, e.handler, e.line, e.auth_tags, e.auth_required) == \
        ("ROUTE", "/orders/lookup", "find_order", 7, [], None)


def test_secret_fixture(spark):
    s = S.secrets_scan(_files(spark, [("mail.php", MAIL_PHP), ("shop.py", SHOP_PY)])
                       .withColumnRenamed("path", "file").withColumnRenamed("content", "text")).collect()
    assert [(r.file, r.line, r.type) for r in s] == [("mail.php", 5, "password")]
    assert s[0].value_masked == "tr0u" + "*" * 7


def test_env_read_is_safe(spark):
    src = 'API_TOKEN = os.environ.get("API_TOKEN_VALUE")\napi_key = "abcd1234"\n'
    s = S.secrets_scan(spark.createDataFrame([("a.py", src)], "file string, text string")).collect()
    assert [(r.line, r.type) for r in s] == [(2, "api_key")]


def test_express_middleware_and_quotes(spark):
    js = ('router.get("/a/:id", authenticate, isAdmin, (req, res) => {\n'
          "  const x = req.query.q;\n});\n"
          "router.get('/single', auth, h);\n")
    eps = E.endpoint_inventory(_files(spark, [("r.js", js)])).collect()
    assert len(eps) == 1  # single quotes are not matched (quirk kept)
    assert eps[0].auth_tags == ["express_mw:authenticate", "express_mw:isAdmin"]
    assert [(p.name, p.location) for p in eps[0].params] == [("id", "path"), ("q", "query")]
    both = E.endpoint_inventory(_files(spark, [("r.js", js)]), allow_single_quote=True).collect()
    assert sorted(e.path for e in both) == ["/a/:id", "/single"]
    flask = E.endpoint_inventory(_files(spark, [("shop.py", SHOP_PY)]), route_as_get=True).collect()
    assert [e.method for e in flask] == ["GET"]


def test_rails_resources_expand(spark):
    rb = "before_action :authenticate_user!\nresources 'photos'\n"
    eps = E.endpoint_inventory(_files(spark, [("c.rb", rb)])).collect()
    assert sorted((e.method, e.path) for e in eps) == sorted([
        ("GET", "/photos"), ("POST", "/photos"), ("GET", "/photos/{id}"),
        ("PUT", "/photos/{id}"), ("DELETE", "/photos/{id}")])
    assert all(e.auth_tags == ["before_action:authenticate_user"] for e in eps)


def test_php_group_middleware(spark):
    php = ("<?php\n$r->middleware('auth')->group(function () {\n"
           "    Route::get('/x', 'C@x');\n});\nRoute::get('/y', 'C@y');\n")
    eps = {e.path: e for e in E.endpoint_inventory(_files(spark, [("w.php", php)])).collect()}
    assert "middleware:auth" in eps["/x"].auth_tags


def test_docstring_examples(spark):
    df = spark.createDataFrame([("/api/v1/payment/checkout/{id}",), ("/order/{id}/items",), ("/health",)], "p string")
    assert [r.d for r in df.select(R.domain_from_path(F.col("p")).alias("d")).collect()] == \
        ["payment", "order", "unknown"]
    one = spark.range(1)
    assert one.select(R.api_path_tail(F.lit("/api/v1/payment/{id}"))).first()[0] == "payment"
    assert one.select(R.bare_function_name(F.lit("OracleCommand(x)"))).first()[0] == "OracleCommand"
    assert one.select(R.split_camel(F.lit("PaymentService"))).first()[0] == ["Payment", "Service"]
    assert one.select(C.vuln_from_known_sink(F.lit("curl_exec"))).first()[0] == "rce"


def test_classify_first_catalogue_match(spark):
    names = spark.createDataFrame([("rawExec",), ("foo",)], "sink_name string")
    got = {r.sink_name: (r.vuln_type, r.confidence) for r in C.classify_sink(names).collect()}
    assert got == {"rawExec": ("sqli", "MEDIUM"), "foo": ("unknown", "UNKNOWN")}


def test_clean_field_name_examples(spark):
    from sparkaudit.operators.models import clean_field_name
    cases = [("iban", "iban"), ("private Long accountId", "accountId"), ("pin_code: int", "pin_code"),
             ("readonly session: Session", "session"), ("protected $apiKey", "apiKey"),
             ("public int Level { get; set; }", "Level")]
    df = spark.createDataFrame([(a,) for a, _ in cases], "raw string")
    assert [r[0] for r in df.select(clean_field_name(F.col("raw"))).collect()] == [b for _, b in cases]
