"""Query: prefix trie of conversations."""

from __future__ import annotations

from sparkaudit.llm import prefix_trie
from sparkaudit.llm.common import table
from sparkaudit.llm.registry import register

OP11_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS head,
         xor(list_reduce(range(9 * length(s)), lambda r, i: CASE
               WHEN i % 9 = 0 THEN xor(r, ascii(substr(s, (i // 9 + 1)::BIGINT, 1))::BIGINT)
               ELSE xor(r >> 1, 3988292384 * (r & 1)) END, 4294967295::BIGINT), 4294967295::BIGINT) % 6 AS h
  FROM (SELECT DISTINCT conv_id, conv_id::VARCHAR AS s FROM t)),
b AS (
  SELECT c.conv_id, 0 AS own, t.p, role, text FROM c JOIN t ON t.conv_id = c.head WHERE t.p <= c.h
  UNION ALL
  SELECT c.conv_id, 1, t.p, role, text FROM c JOIN t ON t.conv_id = c.conv_id WHERE t.p > c.h),
d AS (
  SELECT conv_id, text, row_number() OVER w AS depth,
         string_agg(sha256(strlen(role) || ':' || role || text), '' ORDER BY own, p) OVER w AS path
  FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY own, p ROWS UNBOUNDED PRECEDING)),
m AS (SELECT conv_id, depth, md5(path) AS k, length(text) AS n FROM d
      UNION ALL SELECT conv_id, 0, '', 0 FROM c),
e AS (SELECT k, depth, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends
      FROM (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS deepest FROM m) WHERE depth = deepest GROUP BY ALL),
n AS (SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n FROM m GROUP BY ALL),
up AS (SELECT n.conv_id, n.depth, m.k AS above, m.depth AS above_depth, n.n_convs, n.n
       FROM n JOIN m ON m.conv_id = n.conv_id AND m.depth <= n.depth),
kids AS (SELECT above, above_depth, count(*) AS n_children FROM up WHERE depth = above_depth + 1 GROUP BY ALL),
leaf AS (SELECT n.conv_id, n.depth, kids.above IS NULL AS leaf FROM n LEFT JOIN kids ON above = k AND above_depth = depth),
below AS (SELECT above, above_depth, count(*) FILTER (leaf) AS n_leaves, sum((n_convs - 1) * n)::BIGINT AS saved
          FROM up JOIN leaf USING (conv_id, depth) GROUP BY ALL)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children,
       n_leaves, saved AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM n JOIN below ON below.above = n.k AND below.above_depth = n.depth
LEFT JOIN kids ON kids.above = n.k AND kids.above_depth = n.depth
LEFT JOIN e ON e.k = n.k AND e.depth = n.depth
LEFT JOIN (SELECT m.conv_id AS low, m.depth, n.conv_id FROM m JOIN n USING (k, depth)) p
  ON p.low = n.conv_id AND p.depth = n.depth - 1
"""


@register("op11_prefix_trie", OP11_SQL)
def op11_prefix_trie(spark, sf_dir):
    """Every node of the trie of rebuilt conversations, with the figures of its subtree."""
    trie = prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))
    return trie.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
