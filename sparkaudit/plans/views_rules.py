"""Scanner documents, graph output and files for the packaged rules."""

# One scanner document per customer group of orders: results nested as JSON, some documents cut off.
V_SCAN_DOCS = """
SELECT doc_id, CASE WHEN doc_id % 29 = 3 THEN substring(raw, 1, length(raw) - 5) WHEN doc_id % 31 = 4 THEN '{"errors": []}'
  WHEN doc_id % 37 = 5 THEN NULL ELSE raw END AS raw FROM (
  SELECT ord AS doc_id, concat('{"version": "1", "results": [',
    '{"check_id": "', check_id, '", "path": "', path, '", "start": {"line": ', CAST(line AS STRING), ', "col": 1}, "extra": {"lines": "',
    replace(code, '"', chr(92) || '"'), '", "message": "', message, '"',
    CASE WHEN severity IS NULL THEN '' ELSE ', "severity": "' || severity || '"' END, '}}',
    CASE WHEN ord % 3 = 0 THEN ', {"check_id": "bare.rule"}' ELSE '' END, ']}') AS raw
  FROM v_scan) t
"""

# Output of a graph query per part: an array, wrapped rows, or JSON lines with bad ones.
V_GRAPH_DOCS = """
SELECT p_partkey AS doc_id, CASE p_partkey % 4
  WHEN 0 THEN concat('[{"name": "', p_name, '", "file": "a.py", "line": ', CAST(p_size AS STRING), '}, {"name": "x"}]')
  WHEN 1 THEN concat('{"rows": [{"name": "', p_name, '", "file": "b.py", "line": 1}]}')
  WHEN 2 THEN concat('{"name": "', p_name, '", "line": 2}', chr(10), 'Warning: slow query', chr(10), chr(10),
    ' {"name": "', p_type, '", "file": "c.py"} ', chr(10), '{"name": "cut')
  ELSE 'no results' END AS raw
FROM part
"""

# Files that the packaged rules look at, besides the source files: one per page.
V_RULE_FILES = """
SELECT repo, path, content FROM v_src_files
UNION ALL
SELECT 'svc' || CAST(page_id AS STRING), CASE page_id % 2 WHEN 0 THEN 'web/view' || CAST(page_id AS STRING) || '.py'
    ELSE 'Web/Page' || CAST(page_id AS STRING) || '.cs' END,
  CASE page_id % 8
    WHEN 0 THEN concat('name = request.args.get("n")', chr(10), 'return render_template_string(tpl % name)', chr(10), 'os.system(cmd)')
    WHEN 2 THEN concat('data = request.data', chr(10), 'obj = pickle.loads(data)', chr(10), 'cfg = yaml.load(f, Loader=yaml.Loader)')
    WHEN 4 THEN concat('cursor.execute(f"select {x}")', chr(10), 'Order.objects.raw("select " + key)', chr(10), 'HOME = os.environ.get("HOME")',
      chr(10), 'Queue and take', CAST(page_id % 50 AS STRING))
    WHEN 6 THEN concat('pickle.loads(blob)', chr(10), 'h = md5 (name)', chr(10), 'x = 1', chr(10), 'y = 2', chr(10), 'z = 3', chr(10), 'password = sha1(pw)', chr(10), 'secret_key = "changeme"', chr(10), 'n = random.randint(1, 9)', chr(10), 'debug=True', chr(10), 'subprocess.run(args)', chr(10), 'read one item', CAST(page_id % 20 AS STRING))
    WHEN 1 THEN concat('public class A : ControllerBase {', chr(10), '  cmd.CommandText = sql;', chr(10), '  var c = new SqlCommand(sql, con);', chr(10),
      '  File.Delete(name);', chr(10), '}')
    WHEN 3 THEN concat('var q = Request.Query["q"];', chr(10), 'Response.Write(q);', chr(10), 'Process.Start(q, "");', chr(10), 'db.Set<Item>().FromSqlRaw(q, 1)')
    WHEN 5 THEN concat('var b = Request.Body;', chr(10), 'formatter.Deserialize(b);', chr(10), 'Response.WriteAsync(b)')
    ELSE concat('Response.Write(x);', chr(10), 'File.Open(path, mode);') END || chr(10) || html
FROM pages
"""
