"""Parent-child links to full hierarchies (p4)."""

from __future__ import annotations

from tracelake.operators import hierarchy as H
from tracelake.registry import query
from tracelake.sources.tables import SQL_BRANCHES, read

# every walk up to its end; a walk of more steps than there are branches is in a cycle
_WALKS = (
    "WITH RECURSIVE "
    + SQL_BRANCHES
    + """, n AS (SELECT count(*) AS n FROM br), walk(node, anc, depth) AS (
  SELECT node, node, 0 FROM br
  UNION ALL
  SELECT w.node, b.parent, w.depth + 1 FROM walk w JOIN br b ON b.node = w.anc WHERE b.parent IS NOT NULL AND w.depth < 2 * (SELECT n FROM n)),
ends AS (SELECT w.node, w.anc, w.depth, b.node IS NULL AS missing FROM walk w LEFT JOIN br b ON b.node = w.anc WHERE b.node IS NULL OR b.parent IS NULL),
turns AS (SELECT node, min(anc) AS low FROM walk WHERE depth >= (SELECT n FROM n) GROUP BY 1)"""
)


@query(
    "p4_found",
    _WALKS + " SELECT node AS branch_id, anc AS root_id, CAST(CASE WHEN missing THEN -2 ELSE depth END AS BIGINT) AS depth FROM ends UNION ALL SELECT node, low, CAST(-1 AS BIGINT) FROM turns",
)
def p4_found(spark, d):
    return H.roots_and_depths(read(spark, d, "branches")).selectExpr("node AS branch_id", "root AS root_id", "depth")


@query(
    "p4_paths",
    _WALKS
    + """, good AS (SELECT w.node, w.anc, w.depth, e.depth AS full_depth, e.anc AS root_id FROM walk w JOIN ends e ON e.node = w.node WHERE NOT e.missing)
SELECT g.node AS branch_id, g.root_id, CAST(max(g.full_depth) AS BIGINT) AS depth, (SELECT count(*) - 1 FROM good x WHERE x.anc = g.node) AS n_descendants, string_agg(g.anc, ' > ' ORDER BY g.depth DESC) AS path FROM good g GROUP BY g.node, g.root_id""",
)
def p4_paths(spark, d):
    """Full path, depth, root and number of descendants of each branch that reaches a root."""
    tree = H.hierarchy(read(spark, d, "branches"))
    return H.paths(tree).where("listed and kind = 'tree'").selectExpr("node AS branch_id", "root AS root_id", "depth", "n_descendants", "path")


@query("p4_descendants", _WALKS + " SELECT w.anc AS branch_id, w.node AS descendant_id, CAST(w.depth AS BIGINT) AS distance FROM walk w JOIN ends e ON e.node = w.node WHERE NOT e.missing AND w.depth > 0")
def p4_descendants(spark, d):
    tree = H.hierarchy(read(spark, d, "branches")).where("kind = 'tree'")
    return H.descendants(tree).selectExpr("ancestor AS branch_id", "descendant AS descendant_id", "distance")


@query("p4_unrooted", _WALKS + " SELECT node AS branch_id, 'missing' AS reason, anc AS at_id FROM ends WHERE missing UNION ALL SELECT node, 'cycle', low FROM turns")
def p4_unrooted(spark, d):
    """The branches that reach no root, with the cycle or missing id their chain runs into."""
    tree = H.hierarchy(read(spark, d, "branches"))
    return tree.where("listed and kind <> 'tree'").selectExpr("node AS branch_id", "kind AS reason", "root AS at_id")
