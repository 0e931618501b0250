"""Queries that rewrite the graph for parsimony, one round each over the whole graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import flags as fl
from strandlake.operators import graph, rewrites
from strandlake.operators import mutations as mu
from strandlake.plans.catalogue import _FULL, _PARSIMONY, _WITH, query
from strandlake.plans.fixture import Fixture
from strandlake.plans.lineage import cut


@query(
    _FULL
    + """, alone as (select p, min(c) as c from edges join nodes on id = p and flags & 8388608 > 0 where l = 0 and r = (select L from k) group by 1 having count(*) = 1)
select muts.id as mutation_id, position, coalesce(alone.p, node) as node from muts left join alone on alone.c = node"""
)
def push_unary_recombinant(f: Fixture) -> DataFrame:
    return rewrites.unary_recombinant_pushed(f.nodes, f.edges, f.mutations, f.length).select("mutation_id", "position", "node")


#: The mutations that are split off: the first one of every node.
_SPLIT = """, first as (select node, min(muts.id) as id from muts group by 1), up as (select c, min(time) as above from edges join nodes on id = p group by 1),
made as (select first.id, first.node, (select max(id) from nodes) + row_number() over (order by first.node) as new_node, time + (above - time) / 2 as time from first join up on up.c = first.node join nodes on nodes.id = first.node)
"""


def _split(f: Fixture):
    first = f.mutations.groupBy("node").agg(F.min("mutation_id").alias("mutation_id"))
    return rewrites.branches_split(f.nodes, f.edges, f.mutations, first)


@query(_FULL + _SPLIT + 'select l as left, r as right, p as parent, coalesce(new_node, c) as child from edges left join made on made.node = c union all select min(l), max(r), new_node, node from made join edges on c = node group by new_node, node')
def split_branch_edges(f: Fixture) -> DataFrame:
    """The lower halves of split branches are squashed; upper halves keep the intervals of their edges."""
    return _split(f)[1]


@query(_FULL + _SPLIT + "select muts.id as mutation_id, coalesce(new_node, muts.node) as node from muts left join made on made.id = muts.id")
def split_branch_mutations(f: Fixture) -> DataFrame:
    return _split(f)[2].select("mutation_id", "node")


def _push_sql(i: str = "", nodes: str = "nodes", edges: str = "edges", muts: str = "muts") -> str:
    """One round of pushes over the named tables; its tables have the suffix i."""
    return f""", full{i}_ as (select p, c from {edges} where l = 0 and r = (select L from k)),
found{i} as materialized (select x.c as child, x.p as parent, y.p as grand, v.position, v.id as reversion, u.parent as before from full{i}_ x join full{i}_ y on y.c = x.p join {muts} v on v.node = x.c join {muts} u on u.node = x.p and u.position = v.position and u.inherited = v.derived),
counted{i} as (select parent, child, grand, count(*) as n from found{i} group by 1, 2, 3), best{i} as materialized (select parent, grand, arg_min(child, -n * 1000000000000 + child) as child from counted{i} group by 1, 2),
chains{i}(child, parent, place) as (select child, parent, 0 from best{i} where child not in (select parent from best{i}) union all select b.child, b.parent, place + 1 from chains{i} c join best{i} b on b.child = c.parent),
taken{i} as (select b.* from best{i} b join chains{i} using (child, parent) where place % 2 = 0),
made{i} as materialized (select child, parent, grand, (select max(id) from {nodes}) + row_number() over (order by parent) as new_node from taken{i}),
undone{i} as materialized (select f.* from found{i} f join made{i} using (child, parent)),
follow{i}(gone, target) as (select reversion, before from undone{i} union all select f.gone, u.before from follow{i} f join undone{i} u on u.reversion = f.target),
final{i} as (select gone, target from follow{i} where target not in (select reversion from undone{i})),
pushed{i} as (select m.id, position, case when (node, position) in (select parent, position from undone{i}) then node else coalesce(new_node, node) end as node, inherited, derived, coalesce(target, m.parent) as parent
from {muts} m left join made{i} on made{i}.parent = node left join final{i} on gone = m.parent where m.id not in (select reversion from undone{i})),
pushed_edges{i} as (select l, r, p, c from {edges} where c not in (select child from made{i} union all select parent from made{i})
union all select 0, (select L from k), new_node, parent from made{i} union all select 0, (select L from k), new_node, child from made{i} union all select 0, (select L from k), grand, new_node from made{i})
"""


def _pushed(f: Fixture):
    return rewrites.reversions_pushed(f.nodes, f.edges, f.mutations, f.length)


@query(_FULL + _push_sql() + "select l as left, r as right, p as parent, c as child from pushed_edges")
def push_reversions_edges(f: Fixture) -> DataFrame:
    return _pushed(f)[1]


@query(_FULL + _push_sql() + "select id as mutation_id, position, node, parent from pushed")
def push_reversions_mutations(f: Fixture) -> DataFrame:
    return _pushed(f)[2].select("mutation_id", "position", "node", "parent")


def _coalesce_sql(i: str = "", nodes: str = "nodes", edges: str = "edges", muts: str = "muts") -> str:
    """One round of joins over the named tables; its tables have the suffix i."""
    return f""", full{i}_ as (select p, c from {edges} where l = 0 and r = (select L from k)),
own{i} as materialized (select f.p as up, f.c as node, m.id, position || inherited || derived || ':' || parent as m, position, inherited, derived, parent from full{i}_ f join {muts} m on m.node = f.c),
pairs{i} as (select a.up, a.node, b.node as other, list(a.m order by a.position, a.inherited, a.derived, a.parent) as overlap, list([lpad(a.position::varchar, 12, '0'), a.inherited, a.derived, lpad((a.parent + 1)::varchar, 12, '0')] order by a.position, a.inherited, a.derived, a.parent) as key
  from own{i} a join own{i} b on a.up = b.up and a.m = b.m and a.node <> b.node group by 1, 2, 3),
proposed{i} as (select distinct up, overlap, key from (select *, row_number() over (partition by node order by len(overlap) desc, key) as place from pairs{i}) x where place = 1),
meets{i} as (select pr.up, node, overlap, key from proposed{i} pr join own{i} o on o.up = pr.up and list_contains(overlap, m) group by 1, 2, 3, 4 having count(*) = len(overlap)),
joins{i} as (select * from (select *, row_number() over (partition by node order by len(overlap) desc, key) as place from meets{i}) x where place = 1),
groups{i} as (select up, overlap, count(*) as n, min(node) as least from joins{i} group by 1, 2 having count(*) > 1),
made{i} as materialized (select up, overlap, least, (select max(id) from {nodes}) + row_number() over (order by least) as new_node from groups{i}),
under{i} as materialized (select j.up, node, j.overlap, new_node from joins{i} j join made{i} d on d.up = j.up and d.overlap = j.overlap),
fresh{i} as materialized (select (select max(id) from {muts}) + row_number() over (order by new_node, position, derived) as id, position, new_node as node, inherited, derived, parent, m from made{i} join own{i} o on o.node = least and list_contains(overlap, m)),
lost{i} as materialized (select o.id, f.id as fresh from own{i} o join under{i} u using (node) join fresh{i} f on f.node = u.new_node and f.m = o.m where list_contains(overlap, o.m)),
joined{i} as (select x.id, position, node, inherited, derived, coalesce(lost{i}.fresh, parent) as parent
  from (select id, position, node, inherited, derived, parent from {muts} where id not in (select id from lost{i}) union all select id, position, node, inherited, derived, parent from fresh{i}) x left join lost{i} on lost{i}.id = x.parent),
joined_edges{i} as (select l, r, p, c from {edges} where c not in (select node from under{i})
union all select 0, (select L from k), up, new_node from made{i} union all select 0, (select L from k), new_node, node from under{i})
"""


def _coalesced(f: Fixture):
    return rewrites.mutations_coalesced(f.nodes, f.edges, f.mutations, f.length)


@query(_FULL + _coalesce_sql() + "select l as left, r as right, p as parent, c as child from joined_edges")
def coalesce_edges(f: Fixture) -> DataFrame:
    return _coalesced(f)[1]


@query(_FULL + _coalesce_sql() + "select id as mutation_id, node, position, inherited as inherited_state, derived as derived_state, parent from joined")
def coalesce_mutations(f: Fixture) -> DataFrame:
    return _coalesced(f)[2].select("mutation_id", "node", "position", "inherited_state", "derived_state", "parent")


#: Rounds that the statements of the fixpoint are written for; rounds that change nothing are no rows of its report.
ROUNDS = {"coalesce_mutations": 5, "reversion_push": 6}


def _fixpoint_sql() -> str:
    out, rows = [], []
    nodes, edges, muts, i = "nodes", "edges", "muts", 0

    def summary(op: str) -> str:
        return f"""select {i} as round, '{op}' as op, (select count(*) from {nodes}) as nodes, (select count(*) from {edges}) as edges, (select count(*) from {muts}) as mutations,
  (select min(a.time - b.time) from {edges} e join {nodes} a on a.id = e.p join {nodes} b on b.id = e.c) as min_edge_time"""

    rows.append(summary("noop"))
    for op, sql, made_edges, made_muts in (("coalesce_mutations", _coalesce_sql, "joined_edges", "joined"), ("reversion_push", _push_sql, "pushed_edges", "pushed")):
        for _ in range(ROUNDS[op]):
            i += 1
            out.append(sql(str(i), nodes, edges, muts))
            if op == "coalesce_mutations":
                time = f"select new_node as id, low + (high - low) / 2 as time from (select new_node, max(a.time) as low, any_value(b.time) as high from under{i} u join {nodes} a on a.id = u.node join {nodes} b on b.id = u.up group by 1) t"
            else:
                time = f"select new_node as id, a.time + (b.time - a.time) / 2 as time from made{i} d join {nodes} a on a.id = d.parent join {nodes} b on b.id = d.grand"
            out.append(f", n{i} as materialized (select id, time from {nodes} union all {time}), e{i} as materialized (select * from {made_edges}{i}), x{i} as materialized (select * from {made_muts}{i})\n")
            nodes, edges, muts = f"n{i}", f"e{i}", f"x{i}"
            rows.append(summary(op))
    return "".join(out) + f", report as (select *, lag(mutations) over (order by round) as before from ({' union all '.join(rows)}) r), last as (select * from x{i}), last_edges as (select * from e{i})\n"


def _fixpoint(f: Fixture):
    return rewrites.parsimony_fixpoint(f.nodes, f.edges, f.mutations, f.length)


@query(_FULL + _fixpoint_sql() + "select cast(row_number() over (order by round) - 1 as integer) as round, op, nodes, edges, mutations, min_edge_time from report where before is null or before <> mutations")
def node_parsimony_report(f: Fixture) -> DataFrame:
    return f.spark.createDataFrame([tuple(r.values()) for r in _fixpoint(f)[3]], "round int, op string, nodes bigint, edges bigint, mutations bigint, min_edge_time double")


@query(_FULL + _fixpoint_sql() + "select id as mutation_id, position, node, inherited as inherited_state, derived as derived_state, parent from last")
def node_parsimony_mutations(f: Fixture) -> DataFrame:
    return _fixpoint(f)[2].select("mutation_id", "position", "node", "inherited_state", "derived_state", "parent")


@query(_FULL + _fixpoint_sql() + "select l as left, r as right, p as parent, c as child from last_edges")
def node_parsimony_edges(f: Fixture) -> DataFrame:
    return _fixpoint(f)[1]


@query(_WITH + "select l as left, r as right, p as parent, c as child from edges union all select 0, (select L from k), (select max(id) + 1 from nodes), (select p from edges where p not in (select c from edges) group by 1)")
def insert_root_edge(f: Fixture) -> DataFrame:
    return graph.with_root_edge(f.edges, f.nodes)[0]


def _immediate(f: Fixture) -> DataFrame:
    return cut(mu.parsimony(f.mutations, f.edges).where("is_immediate_reversion").select("mutation_id", "position", "node"), "immediate")


#: Every seventh node is marked.
_MARKED = """, marked as (select id from nodes where id % 7 = 0 and id in (select c from edges where l = 0 and r = (select L from k)) and id not in (select p from edges where l > 0 or r < (select L from k)) and id in (select p from edges) and id not in (select node from ps where is_immediate)),
up(c, p) as (select c, p from edges union all select up.c, e.p from up join edges e on e.c = up.p where up.p in (select id from marked))
"""


@query(_FULL + _PARSIMONY + _MARKED + "select distinct l as left, r as right, coalesce(top.p, edges.p) as parent, edges.c as child from edges left join (select c, p from up where p not in (select id from marked)) top on edges.p in (select id from marked) and top.c = edges.c where edges.c not in (select id from marked)")
def delete_reversion_markers(f: Fixture) -> DataFrame:
    """With every seventh node marked, and immediate reversions as the only mutations."""
    nodes = f.nodes.withColumn("flags", F.when(F.col("node_id") % 7 == 0, fl.REVERSION_MARKER).otherwise(0))
    return rewrites.markers_deleted(nodes, f.edges, _immediate(f), f.length)[1]


@query(
    _FULL
    + _PARSIMONY
    + """, full_ as (select p, c from edges where l = 0 and r = (select L from k)), kept as (select node from ps where is_immediate union select id from nodes where flags & 1 > 0 union select p from full_ where p not in (select c from full_)),
up(c, p) as (select c, p from full_ union all select up.c, e.p from up join full_ e on e.c = up.p where up.p not in (select node from kept))
select cast(0 as bigint) as left, (select L from k) as right, p as parent, c as child from up where p in (select node from kept) and c in (select node from kept)"""
)
def trim_branches(f: Fixture) -> DataFrame:
    """The tree of full-span edges, with immediate reversions as the only mutations."""
    samples = f.nodes.where(fl.has(F.col("flags"), fl.SAMPLE)).select(F.col("node_id").alias("node"))
    return rewrites.branches_trimmed(f.edges, _immediate(f), samples, f.length)
