"""Queries of the parent-child problem and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.operators.hierarchy import closure, hierarchy, paths, unrooted
from quire.runtime import cut, table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Nodes whose chain of parents never ends at a root."""
    return unrooted(hierarchy(table(spark, d, "nodes")))


def p4_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """State, root, depth, path and number of descendants of every node."""
    placed = cut(hierarchy(table(spark, d, "nodes")))
    return placed.join(paths(placed), "node_id").select("node_id", "state", "anchor_id", "steps", "path", "descendants")


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every node with each of its descendants and their distance."""
    return closure(paths(hierarchy(table(spark, d, "nodes"))))


QUERIES = {f.__name__: f for f in (p4_found, p4_hierarchy, p4_descendants)}

_links = """
edges as (select id as node_id, min(nullif(lower(regexp_replace(parent_id, '^\\s+|\\s+$', '', 'g')), '')) as parent from nodes group by id),
ids as (select node_id as parent, true as known from edges)"""
_walk = f"""
with recursive {_links},
marked as (select e.node_id, e.parent, i.known is not null as inner_node from edges e left join ids i using (parent)),
walk(node_id, place, path) as (
  select node_id, node_id, [node_id] from marked
  union all
  select w.node_id, m.parent, list_append(w.path, m.parent) from walk w join marked m on m.node_id = w.place
  where m.inner_node and not list_contains(w.path, m.parent)),
ends as (select node_id, place, path from walk qualify row_number() over (partition by node_id order by len(path) desc) = 1),
told as (
  select e.node_id, e.path, m.parent as next, m.inner_node,
    case when m.parent is null then 'rooted' when not m.inner_node then 'orphan'
      when list_position(e.path, m.parent) = 1 then 'cycle' else 'below_cycle' end as state,
    case when not m.inner_node then e.place else list_min(e.path[list_position(e.path, m.parent):]) end as anchor_id,
    case when not m.inner_node then len(e.path) - 1 else list_position(e.path, m.parent) - 1 end as steps
  from ends e join marked m on m.node_id = e.place)
"""
_closed = """, cut as (select node_id, path[:steps + 1] as path from told),
below as (select unnest(path[2:]) as ancestor_id, node_id, cast(unnest(range(1, len(path))) as integer) as distance from cut)"""
ORACLE = {
    "p4_found": _walk + "select node_id, state, anchor_id, cast(steps as integer) as steps from told where state <> 'rooted'",
    "p4_descendants": _walk
    + _closed + " select ancestor_id, node_id, distance from below",
    "p4_hierarchy": _walk
    + _closed
    + """ select t.node_id, t.state, t.anchor_id, cast(t.steps as integer) as steps, list_reverse(c.path) as path, coalesce(n, 0) as descendants
from told t join cut c using (node_id) left join (select ancestor_id as node_id, count(*) as n from below group by 1) using (node_id)""",
}
