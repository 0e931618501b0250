"""Queries that check graphs and compare sets of sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators import invariants, sets
from strandlake.plans.catalogue import _FULL, query
from strandlake.plans.fixture import Fixture

#: The fixture's graph with faults: some edges end early or hang from a younger node, some mutations change nothing or have a wrong parent.
_FAULTY = """, fe as (select l, case when c % 13 = 5 then r - 1 else r end as r, case when c % 17 = 3 then c + 1 else p end as p, c from edges),
fm as (select id, position, case when id % 103 = 9 then node + (select n from k) else node end as node, inherited, case when id % 101 = 7 then inherited else derived end as derived, case when id % 97 = 5 then id - 1 else parent end as parent from muts),
ordered as (select fe.*, lag(r) over w as before, lead(l) over w as next, count(*) over (partition by c) as edges_, pn.time as high, cn.time as low, cn.flags & 8388608 > 0 as recombinant
  from fe left join nodes pn on pn.id = p left join nodes cn on cn.id = c window w as (partition by c order by l, r)),
stated3 as (select a.*, b.position as at_, b.derived as from_, x.id as known, row_number() over (partition by a.position, a.node order by a.id) as place from fm a left join fm b on b.id = a.parent left join nodes x on x.id = a.node)
"""


@query(
    _FULL
    + _FAULTY
    + """select 'node_ids' as invariant, cast(0 as bigint) as violations union all select 'sample_ids', 0
union all select 'edge_nodes', count(*) filter (high is null or low is null) from ordered union all select 'edge_times', count(*) filter (high <= low) from ordered
union all select 'edge_bounds', count(*) filter (not (l >= 0 and l < r and r <= (select L from k))) from ordered
union all select 'edge_cover', count(*) filter ((before is null and l <> 0) or before <> l or (next is null and r <> (select L from k))) from ordered
union all select 'edge_kinds', count(*) filter (before is null and ((edges_ > 1) <> recombinant)) from ordered
union all select 'mutation_nodes', count(*) filter (known is null) from stated3 union all select 'mutation_states', count(*) filter (derived = inherited) from stated3
union all select 'mutation_repeats', count(*) filter (place > 1) from stated3 union all select 'mutation_parents', count(*) filter (parent <> -1 and coalesce(at_ <> position or from_ <> inherited, true)) from stated3"""
)
def graph_invariants(f: Fixture) -> DataFrame:
    c, i = F.col("child"), F.col("mutation_id")
    edges = f.edges.select("left", F.when(c % 13 == 5, F.col("right") - 1).otherwise(F.col("right")).alias("right"), F.when(c % 17 == 3, c + 1).otherwise(F.col("parent")).alias("parent"), "child")
    m = f.mutations
    m = m.withColumn("node", F.when(i % 103 == 9, F.col("node") + f.size).otherwise(F.col("node"))).withColumn("derived_state", F.when(i % 101 == 7, F.col("inherited_state")).otherwise(F.col("derived_state")))
    m = m.withColumn("parent", F.when(i % 97 == 5, i - 1).otherwise(F.col("parent")))
    counts = invariants.written(f.nodes, edges, m, f.length)[3]
    return f.spark.createDataFrame(list(counts.items()), "invariant string, violations bigint")


@query(
    _FULL
    + """, gone as (select distinct n_name as c, position from muts join customer on c_custkey = node join nation on n_nationkey = c_nationkey where derived = '-'),
sizes as (select c, count(*) as n from gone group by 1), pairs2 as (select a.c as a, b.c as b from sizes a join sizes b on a.c < b.c),
both2 as (select x.c as a, y.c as b, count(*) as n from gone x join gone y on x.position = y.position and x.c < y.c group by 1, 2)
select a as name_a, b as name_b, x.n as in_a, y.n as in_b, coalesce(both2.n, 0) as in_both, x.n + y.n - coalesce(both2.n, 0) as in_either, x.n - coalesce(both2.n, 0) as only_a, y.n - coalesce(both2.n, 0) as only_b
from pairs2 left join both2 using (a, b) join sizes x on x.c = a join sizes y on y.c = b"""
)
def shared_deletion_sites(f: Fixture) -> DataFrame:
    """Sites that mutations of two countries' nodes delete, for each pair of countries."""
    country = f.samples.select(F.col("node_id").alias("node"), "country")
    return sets.compared(sets.bitmaps(f.mutations.where("derived_state = '-'").join(country, "node"), "country", "position"), "country")
