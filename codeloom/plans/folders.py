"""Problem 3: the folder trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.operators.hierarchy import descendants, hierarchy, latest_nodes, tree_stats
from codeloom.sources.tables import table


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_nodes(table(spark, sf_dir, "folders"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy(_nodes(spark, sf_dir), paths=False).selectExpr("id as folder_id", "root_id", "depth")


def p3_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy(_nodes(spark, sf_dir)).where("depth >= 0").selectExpr("id as folder_id", "root_id", "depth", "path")


def p3_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descendants(hierarchy(_nodes(spark, sf_dir)))


def p3_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir)
    return tree_stats(hierarchy(nodes, paths=False), nodes)


_ID = "nullif(lower(regexp_replace({}, '^\\s+|\\s+$', '', 'g')), '')"
_NODES = f"""
one as (select {_ID.format('id')} nid, id, name, repo_name grp, {_ID.format('parent_id')} par from folders where {_ID.format('id')} is not null
        qualify row_number() over (partition by {_ID.format('id')} order by updated_at desc nulls last, created_at desc nulls last, id desc, name desc, repo_name desc, parent_id desc) = 1),
nodes as (select o.nid, o.id, o.name, o.grp, p.nid parent from one o left join one p on p.nid = o.par and p.grp is not distinct from o.grp),
tree as (select nid, id, id root_id, 0 depth, '/' || coalesce(name, '') path, cast([] as varchar[]) ancestors from nodes where parent is null
         union all select n.nid, n.id, t.root_id, t.depth + 1, t.path || '/' || coalesce(n.name, ''), list_append(t.ancestors, t.id) from tree t join nodes n on n.parent = t.nid),
lost as (select * from nodes where nid not in (select nid from tree)),
walk as (select nid start, parent pos, 1 steps from lost
         union all select w.start, l.parent, w.steps + 1 from walk w join lost l on l.nid = w.pos where w.steps <= (select count(*) from lost) and w.pos <> w.start),
cyc as (select distinct start from walk where pos = start),
closed as (select w.start, l.id from walk w join lost l on l.nid = w.pos where w.start in (select start from cyc)),
least as (select start, min(id) root_id from closed group by 1),
fin as (select id folder_id, root_id, depth, nid from tree
        union all select l.id, c.root_id, -1, l.nid from lost l join least c on c.start = l.nid
        union all select l.id, min(c.root_id), -2, l.nid from lost l join walk w on w.start = l.nid join least c on c.start = w.pos
                  where l.nid not in (select start from cyc) group by l.id, l.nid)
"""
QUERIES = {"p3_found": p3_found, "p3_paths": p3_paths, "p3_descendants": p3_descendants, "p3_stats": p3_stats}
SQL = {
    "p3_found": f"with recursive {_NODES} select folder_id, root_id, depth from fin",
    "p3_paths": f"with recursive {_NODES} select id folder_id, root_id, depth, path from tree",
    "p3_descendants": f"with recursive {_NODES} select a.folder_id, id below_id, cast(depth - a.i as int) distance from (select id, depth, unnest(ancestors) folder_id, unnest(range(len(ancestors))) i from tree) a",
    "p3_stats": f"""with recursive {_NODES} select n.grp repo_name, count(*) n_folders, count(*) filter (depth = 0) n_roots, max(depth) max_depth,
                    count(*) filter (depth = -1) n_on_cycle, count(*) filter (depth = -2) n_below_cycle from fin join nodes n using (nid) group by 1""",
}
