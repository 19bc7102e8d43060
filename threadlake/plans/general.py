"""The general data-preparation queries and the SQL they are held against."""

from __future__ import annotations

from threadlake.operators import hierarchy, regular_grid
from threadlake.sources.tables import table


def _grid(spark, d):
    return regular_grid.regular_grid(table(spark, d, "insights_snapshots"), table(spark, d, "posts"))


def queries() -> dict:
    return {
        "p2_found": lambda s, d: regular_grid.empty_slots(_grid(s, d)),
        "p2_grid": _grid,
        "p5_found": lambda s, d: hierarchy.chain_findings(table(s, d, "posts")),
        "p5_tree": lambda s, d: hierarchy.full_tree(table(s, d, "posts")),
        "p5_descendants": lambda s, d: hierarchy.descendants(table(s, d, "posts")),
    }


_P2 = """
WITH p AS (SELECT id, min(posted_at) AS pa FROM posts WHERE id IS NOT NULL GROUP BY id),
s AS (SELECT DISTINCT post_id, floor(epoch_us(fetched_at) / 21600000000)::BIGINT AS slot_no
      FROM insights_snapshots JOIN p ON post_id = id
      WHERE fetched_at >= pa AND fetched_at < TIMESTAMPTZ '2026-07-01 00:00:00+00' AND views > 0),
b AS (SELECT post_id, min(slot_no) AS lo, max(slot_no) AS hi FROM s GROUP BY post_id),
g AS (SELECT post_id, unnest(generate_series(lo, hi)) AS slot_no FROM b)
"""

_NODES = """
WITH RECURSIVE n AS (
  SELECT id, max(nullif(regexp_replace(replied_to_id, '^\\s+|\\s+$', '', 'g'), '')) AS parent,
         max(nullif(regexp_replace(root_post_id, '^\\s+|\\s+$', '', 'g'), '')) AS root_ref,
         coalesce(bool_or(is_reply), false) AS is_reply
  FROM posts WHERE id IS NOT NULL GROUP BY id),
t AS (
  SELECT id, id AS top_id, 0 AS tree_depth, id AS path FROM n WHERE parent IS NULL OR parent NOT IN (SELECT id FROM n)
  UNION ALL
  SELECT n.id, t.top_id, t.tree_depth + 1, t.path || '/' || n.id FROM n JOIN t ON n.parent = t.id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _P2 + "SELECT post_id, slot_no FROM g ANTI JOIN s USING (post_id, slot_no)",
        "p5_found": _NODES
        + """,
u AS (SELECT id, parent FROM n WHERE id NOT IN (SELECT id FROM t)),
w AS (SELECT id AS a, parent AS b FROM u UNION SELECT w.a, u.parent FROM w JOIN u ON w.b = u.id),
c AS (SELECT a AS id FROM w WHERE a = b),
m AS (SELECT w.a AS id, min(w.b) AS top_id FROM w WHERE w.b IN (SELECT id FROM c) GROUP BY w.a)
SELECT id AS post_id, CASE WHEN id IN (SELECT id FROM c) THEN 'cycle' ELSE 'into_cycle' END AS kind, top_id, -1 AS tree_depth FROM m
UNION ALL
SELECT t.id, CASE WHEN r.parent IS NOT NULL OR r.is_reply THEN 'lost_parent' ELSE 'wrong_root' END, t.top_id, t.tree_depth
FROM t JOIN n ON t.id = n.id JOIN n AS r ON r.id = t.top_id
WHERE r.parent IS NOT NULL OR r.is_reply OR (n.root_ref IS NULL AND t.id <> t.top_id) OR n.root_ref <> t.top_id""",
        "p5_tree": _NODES
        + """,
x AS (SELECT a.id, count(*) AS k FROM t AS a JOIN t AS b ON b.top_id = a.top_id AND b.tree_depth > a.tree_depth AND starts_with(b.path, a.path || '/') GROUP BY a.id)
SELECT t.id, t.top_id, t.tree_depth, t.path, coalesce(x.k, 0)::BIGINT AS n_descendants FROM t LEFT JOIN x ON t.id = x.id""",
        "p5_descendants": _NODES
        + """
SELECT a.id AS ancestor_id, b.id AS descendant_id, b.tree_depth - a.tree_depth AS distance
FROM t AS a JOIN t AS b ON b.top_id = a.top_id AND b.tree_depth > a.tree_depth AND starts_with(b.path, a.path || '/')""",
    }
