"""Registered queries over the fixture tables, and for each an independent SQL statement for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions import flags as fl
from strandlake.functions import sequences as sq
from strandlake.operators import graph, matching
from strandlake.operators import mutations as mu
from strandlake.operators.ordering import numbered
from strandlake.plans.fixture import Fixture

QUERIES: dict = {}
ORACLE_SQL: dict = {}
#: The date of time 0.
TIME_ZERO = "2023-01-01"

#: The fixture in SQL: constants, nodes, edges, trees, tree edges.
_GRAPH = """
k as (select (select count(*) from part) + 1 as L, cast(floor((select count(*) from part) / 8.0) as bigint) as W, (select count(*) from customer) as n),
nodes as (select c_custkey as id, cast(n - 1 - c_custkey as double) as time,
  cast((case when c_custkey % 3 <> 0 then 1 else 0 end) + (case when c_custkey >= 8 and c_custkey % 29 = 7 then 8388608 else 0 end) + (case when c_custkey = 1 then 67108864 else 0 end) as integer) as flags
  from customer cross join k),
edges as (select cast(0 as bigint) l, cast(L as bigint) r, cast(0 as bigint) p, cast(1 as bigint) c from k
 union all select 0, L, cast(floor(id / 2.0) as bigint), id from nodes cross join k where id >= 2 and not (id >= 8 and id % 29 = 7)
 union all select 0, W * (1 + id % 7), cast(floor(id / 2.0) as bigint), id from nodes cross join k where id >= 8 and id % 29 = 7
 union all select W * (1 + id % 7), L, cast(floor(id / 2.0) - 1 as bigint), id from nodes cross join k where id >= 8 and id % 29 = 7),
trees as (select l tl, r tr from (select b l, lead(b) over (order by b) r from (select l b from edges union select r from edges)) x where r is not null),
te as (select tl, p, c from edges join trees on l <= tl and tr <= r),
sites as (select p_partkey + 1 as position, substr('ACGT', cast(p_size % 4 + 1 as integer), 1) as ancestral from part)
"""
#: Proper ancestors with distance; samples below.
_REACH = """,
reach(tl, node, a, depth) as (select tl, c, p, 1 from te union all select reach.tl, reach.node, te.p, depth + 1 from reach join te on te.tl = reach.tl and te.c = reach.a)
"""
_COUNTS = """,
below as (select tl, a as node, count(*) as samples from (
  select tl, a, node from reach union all select tl, id, id from nodes cross join trees) x join nodes on nodes.id = x.node and nodes.flags & 1 = 1 group by tl, a)
"""
_MUTATIONS = """,
raw as (select l_partkey + 1 as position, 1 + l_orderkey % ((select n from k) - 1) as node, substr('ACGT-', cast(min(l_linenumber + l_suppkey) % 5 + 1 as integer), 1) as derived
  from lineitem group by 1, 2),
placed as (select raw.*, tl from raw join trees on tl <= position and position < tr),
above as (select x.position, x.node, arg_min(y.derived, depth) as derived from placed x join raw y on x.position = y.position and x.node <> y.node
  join reach on reach.tl = x.tl and reach.node = x.node and reach.a = y.node group by 1, 2),
stated as (select placed.*, coalesce(above.derived, ancestral) as inherited from placed left join above using (position, node) join sites using (position)),
named as (select row_number() over (order by position, node) - 1 as id, * from stated where inherited <> derived),
parents as (select x.id, arg_min(y.id, depth) as parent from named x join named y on x.position = y.position and x.node <> y.node
  join reach on reach.tl = x.tl and reach.node = x.node and reach.a = y.node group by 1),
muts as (select named.*, coalesce(parents.parent, -1) as parent from named left join parents using (id))
"""
_WITH = "with recursive " + _GRAPH
_CLOSED = _WITH + _REACH
_FULL = _CLOSED + _MUTATIONS


def query(sql: str | None = None):
    """Registers a query, and its statement if it has one."""

    def register(function):
        QUERIES[function.__name__] = lambda spark, sf_dir: function(Fixture(spark, sf_dir))
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


# --- trees -------------------------------------------------------------------------------------------------------------------


@query(_WITH + "select tl as tree_left, tr as tree_right from trees")
def marginal_trees(f: Fixture) -> DataFrame:
    return graph.trees(f.edges)


@query(_WITH + "select tl as tree_left, p as parent, c as child from te")
def tree_edges(f: Fixture) -> DataFrame:
    return f.tree_edges


@query(_CLOSED + "select tl as tree_left, count(*) as pairs, max(depth) as deepest, cast(sum(depth) as bigint) as total_depth from reach group by tl")
def ancestor_closure(f: Fixture) -> DataFrame:
    # Intervals are summed before they are written out for the trees in them.
    spans = f.closure.groupBy("left", "right").agg(F.count("*").alias("n"), F.max("depth").alias("deepest"), F.sum("depth").alias("total"))
    return graph.per_tree(spans, f.edges).groupBy("tree_left").agg(F.sum("n").alias("pairs"), F.max("deepest").alias("deepest"), F.sum("total").alias("total_depth"))


@query(_CLOSED + "select tl as tree_left, node, a as ancestor, depth from reach")
def root_path(f: Fixture) -> DataFrame:
    return graph.per_tree(f.closure.select("left", "right", "node", "ancestor", "depth"), f.edges)


@query(_CLOSED + _COUNTS + "select tl as tree_left, node, samples from below where samples > 0")
def sample_counts_per_tree(f: Fixture) -> DataFrame:
    return graph.per_tree(f.sample_counts, f.edges).select("tree_left", "node", "samples")


@query(_CLOSED + _COUNTS + "select id as node_id, flags & 1 = 1 as is_sample, coalesce(max(samples), 0) as max_descendant_samples from nodes left join below on below.node = nodes.id group by 1, 2")
def node_data_inheritance(f: Fixture) -> DataFrame:
    most = graph.max_descendant_samples(f.sample_counts)
    return f.nodes.join(most, "node_id", "left").select("node_id", fl.has(F.col("flags"), fl.SAMPLE).alias("is_sample"), F.coalesce("max_descendant_samples", F.lit(0)).cast("bigint").alias("max_descendant_samples"))


@query(
    _CLOSED
    + """, pairs as (select tl, c_custkey as a, cast(floor(c_custkey * 7 / 5.0) as bigint) % (select n from k) as b from customer cross join trees),
up as (select tl, id as node, id as a from nodes cross join trees union all select tl, node, a from reach),
met as (select x.tl, x.a, x.b, arg_min(u.a, time) as mrca from pairs x join up u on u.tl = x.tl and u.node = x.a join up v on v.tl = x.tl and v.node = x.b and v.a = u.a join nodes on nodes.id = u.a group by 1, 2, 3)
select pairs.tl as tree_left, pairs.a, pairs.b, mrca from pairs left join met using (tl, a, b)"""
)
def mrca_pairs(f: Fixture) -> DataFrame:
    pairs = f.nodes.select(F.lit(0).cast("bigint").alias("left"), F.lit(f.length).cast("bigint").alias("right"), F.col("node_id").alias("a"), (F.floor(F.col("node_id") * 7 / 5).cast("bigint") % f.size).alias("b"))
    pairs = graph.per_tree(pairs, f.edges)
    return graph.mrca(pairs, f.closure, f.nodes)


@query(
    _CLOSED
    + """, up as (select tl, id as node, id as a, 0 as depth from nodes join trees on true union all select tl, node, a, depth from reach)
select tl as tree_left, node, arg_min(a, depth) as recombinant, min(depth) as distance from up join nodes on nodes.id = a and flags & 8388608 > 0 group by 1, 2"""
)
def closest_recombinant(f: Fixture) -> DataFrame:
    return graph.closest_recombinant(f.edges, f.closure, f.nodes)


@query(_WITH + "select x.c as node, y.c as sibling from edges x join edges y on x.p = y.p cross join k where x.l = 0 and x.r = k.L and y.l = 0 and y.r = k.L")
def full_span_siblings(f: Fixture) -> DataFrame:
    return graph.full_span_siblings(f.edges, f.nodes, f.length)


@query(_WITH + "select k.L - edges.r as left, k.L - edges.l as right, p as parent, c as child from edges cross join k")
def mirror_coordinates(f: Fixture) -> DataFrame:
    return graph.mirrored(f.edges, f.length)


@query(_WITH + "select l as left, r as right, p as parent, c as child from edges")
def squash_edges(f: Fixture) -> DataFrame:
    return graph.squashed(graph.tree_edges(f.edges).join(graph.trees(f.edges), "tree_left").select(F.col("tree_left").alias("left"), F.col("tree_right").alias("right"), "parent", "child"))


@query(_WITH + "select l as left, r as right, p as parent, c as child from edges where not (p = 0 and c = 1)")
def drop_root_edge(f: Fixture) -> DataFrame:
    return graph.without_root_edge(f.edges)


@query(_WITH + "select c as child, count(*) as segments, string_agg('(' || l || ':' || r || ', ' || p || ')', ', ' order by l) as path from edges group by c having count(*) > 1")
def recombinant_paths(f: Fixture) -> DataFrame:
    part = F.struct("left", F.format_string("(%d:%d, %d)", "left", "right", "parent").alias("text"))
    return f.edges.groupBy("child").agg(F.count("*").alias("segments"), F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda s: s["text"]), ", ").alias("path")).where("segments > 1")


@query(_WITH + "select cast(floor(b.time - a.time) as bigint) as branch_length, count(*) as edges from edges join nodes a on a.id = c join nodes b on b.id = p group by 1")
def branch_lengths(f: Fixture) -> DataFrame:
    time = f.nodes.select("node_id", "time")
    both = f.edges.join(time.toDF("child", "tc"), "child").join(time.toDF("parent", "tp"), "parent")
    return both.groupBy(F.floor(F.col("tp") - F.col("tc")).alias("branch_length")).agg(F.count("*").alias("edges"))


# --- nodes and flags ----------------------------------------------------------------------------------------------------------


@query(
    _FULL
    + """select nodes.id as node_id, 'S' || nodes.id as sample_id, n_name as country, c_mktsegment as segment, flags & 1 = 1 as is_sample, flags & 8388608 > 0 as is_recombinant, coalesce(m, 0) as num_mutations,
cast(date '2023-01-01' - cast(time as integer) as date) as date from nodes join customer on c_custkey = nodes.id join nation on n_nationkey = c_nationkey left join (select node, count(*) as m from muts group by node) x on x.node = nodes.id"""
)
def node_data(f: Fixture) -> DataFrame:
    counts = f.mutations.groupBy(F.col("node").alias("node_id")).agg(F.count("*").alias("num_mutations"))
    flags, metadata = F.col("flags"), f.samples.select("node_id", "country", "segment")
    return f.nodes.join(metadata, "node_id", "left").join(counts, "node_id", "left").select(
        "node_id", "sample_id", "country", "segment", fl.has(flags, fl.SAMPLE).alias("is_sample"), fl.has(flags, fl.RECOMBINANT).alias("is_recombinant"),
        F.coalesce("num_mutations", F.lit(0)).alias("num_mutations"), F.date_sub(F.lit(TIME_ZERO).cast("date"), F.col("time").cast("int")).alias("date"),
    )


@query(
    _WITH
    + "select id as node_id, (case when flags & 1 > 0 then 'S' else '_' end) || '__' || (case when flags & 8388608 > 0 then 'R' else '_' end) || '__' || (case when flags & 67108864 > 0 then 'F' else '_' end) || '_' as summary from nodes"
)
def flags_summary(f: Fixture) -> DataFrame:
    return f.nodes.select("node_id", fl.summary(F.col("flags")).alias("summary"))


@query(_WITH + "select id as node_id, concat_ws(',', case when flags & 1 > 0 then 'Sample' end, case when flags & 8388608 > 0 then 'Recombinant' end, case when flags & 67108864 > 0 then 'Reference' end) as names from nodes")
def decode_flags(f: Fixture) -> DataFrame:
    return f.nodes.select("node_id", F.array_join(fl.names(F.col("flags")), ",").alias("names"))


@query(
    _WITH
    + """, kids as (select p, count(*) as kids from edges group by p), t(name, bit) as (values ('Sample', 1), ('Recombinant', 8388608), ('Reference', 67108864))
select name, greatest(1, count(*) filter (where flags & bit > 0)) as total, round(count(*) filter (where flags & bit > 0 and coalesce(kids, 0) > 0) / greatest(1, count(*) filter (where flags & bit > 0)), 6) as with_children
from nodes left join kids on kids.p = nodes.id cross join t group by name"""
)
def node_type_summary(f: Fixture) -> DataFrame:
    kids = f.edges.select(F.col("parent").alias("node_id")).distinct().withColumn("has", F.lit(True))
    rows = f.nodes.join(kids, "node_id", "left").select(F.explode(fl.names(F.col("flags"))).alias("name"), F.coalesce("has", F.lit(False)).cast("int").alias("has"))
    return rows.groupBy("name").agg(F.greatest(F.lit(1), F.count("*")).cast("bigint").alias("total"), F.round(F.avg("has"), 6).alias("with_children"))


@query(_FULL + "select num_mutations, count(*) as nodes from (select id, count(node) as num_mutations from nodes left join (select node from muts) m on m.node = nodes.id group by id) x group by 1")
def mutations_per_node(f: Fixture) -> DataFrame:
    counts = f.mutations.groupBy(F.col("node").alias("node_id")).agg(F.count("*").alias("c"))
    return f.nodes.join(counts, "node_id", "left").groupBy(F.coalesce("c", F.lit(0)).alias("num_mutations")).agg(F.count("*").alias("nodes"))


@query(_FULL + "select node, count(*) as num_mutations from muts group by node having count(*) > 10")
def mutators(f: Fixture) -> DataFrame:
    return f.mutations.groupBy("node").agg(F.count("*").alias("num_mutations")).where("num_mutations > 10")


@query(
    _CLOSED
    + _COUNTS
    + """, most as (select node, max(samples) as m from below group by node), kids as (select distinct p, c from edges),
r as (select p as parent, c as child, coalesce(m, 0) as samples, row_number() over (partition by p order by coalesce(m, 0) desc, c) as rank from kids left join most on most.node = c)
select parent, child, cast(samples as bigint) as samples, rank from r where rank <= 10"""
)
def top_children(f: Fixture) -> DataFrame:
    most = graph.max_descendant_samples(f.sample_counts).toDF("child", "samples")
    kids = f.edges.select("parent", "child").distinct().join(most, "child", "left").withColumn("samples", F.coalesce("samples", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("samples"), "child")).cast("bigint")
    return kids.select("parent", "child", "samples", rank.alias("rank")).where("rank <= 10")


# --- mutations ----------------------------------------------------------------------------------------------------------------


@query(
    _FULL
    + """, ids as (select position, row_number() over (order by position) - 1 as site_id from sites)
select muts.id as mutation_id, site_id, muts.position, node, parent, inherited as inherited_state, derived as derived_state, cast(date '2023-01-01' - cast(time as integer) as date) as date
from muts join ids using (position) join nodes on nodes.id = node"""
)
def mutation_data(f: Fixture) -> DataFrame:
    """A mutation's time is that of its node."""
    ids = numbered(f.sites, "site_id", F.expr("position div 4096"), ["position"]).select("position", "site_id")
    time = f.nodes.select(F.col("node_id").alias("node"), F.date_sub(F.lit(TIME_ZERO).cast("date"), F.col("time").cast("int")).alias("date"))
    return f.mutations.join(ids, "position").join(time, "node").select("mutation_id", "site_id", "position", "node", "parent", "inherited_state", "derived_state", "date")


@query(
    _FULL
    + _COUNTS
    + """, d as (select muts.id, muts.parent, coalesce(samples, 0) as num_descendants from muts left join below on below.tl = muts.tl and below.node = muts.node),
lost as (select parent as id, sum(num_descendants) as lost from d where parent >= 0 group by 1)
select d.id as mutation_id, num_descendants, cast(num_descendants - coalesce(lost, 0) as bigint) as num_inheritors from d left join lost using (id)"""
)
def mutation_data_inheritance(f: Fixture) -> DataFrame:
    return mu.inheritance(f.mutations, f.sample_counts).select("mutation_id", F.col("num_descendants").cast("bigint").alias("num_descendants"), F.col("num_inheritors").cast("bigint").alias("num_inheritors"))


_PARSIMONY = """, ps as (select m.*, e.p as node_parent, u.node as parent_mutation_node, u.inherited as parent_inherited,
  coalesce(u.inherited = m.derived, false) as is_reversion, coalesce(u.inherited = m.derived and u.node = e.p, false) as is_immediate
  from muts m left join edges e on e.c = m.node and e.l <= m.position and m.position < e.r left join muts u on u.id = m.parent)
"""


@query(
    _FULL
    + _PARSIMONY
    + "select id as mutation_id, coalesce(node_parent, -1) as node_parent, coalesce(parent_inherited, 'N') as parent_inherited_state, coalesce(parent_mutation_node, -1) as parent_mutation_node, is_reversion, is_immediate as is_immediate_reversion from ps"
)
def mutation_data_parsimony(f: Fixture) -> DataFrame:
    return mu.parsimony(f.mutations, f.edges).select("mutation_id", "node_parent", "parent_inherited_state", "parent_mutation_node", "is_reversion", "is_immediate_reversion")


@query(_FULL + _PARSIMONY + "select count(*) as mutations, count(*) filter (where is_reversion) as reversions, count(*) filter (where is_immediate) as immediate, count(*) filter (where parent >= 0) as with_parent from ps")
def reversion_counts(f: Fixture) -> DataFrame:
    rows = mu.parsimony(f.mutations, f.edges)
    return rows.agg(F.count("*").alias("mutations"), F.count_if("is_reversion").alias("reversions"), F.count_if("is_immediate_reversion").alias("immediate"), F.count_if(F.col("parent") >= 0).alias("with_parent"))


@query(_FULL + ", chain(id, parent, n) as (select id, parent, 0 from muts union all select chain.id, muts.parent, n + 1 from chain join muts on muts.id = chain.parent) select id as mutation_id, cast(max(n) as bigint) as num_parents from chain group by 1")
def mutation_num_parents(f: Fixture) -> DataFrame:
    return mu.num_parents(f.mutations)


@query(
    _FULL
    + """, own as (select node as node_id, 1 as n from muts union all select reach.node, 1 from muts join reach on reach.tl = muts.tl and reach.a = muts.node)
select node_id, cast(sum(n) as bigint) as num_mutations_on_path from own group by 1"""
)
def root_path_mutation_counts(f: Fixture) -> DataFrame:
    return mu.root_path_counts(f.mutations, f.closure)


@query(_FULL + "select p as node_parent, position, inherited as inherited_state, derived as derived_state, count(*) as n from muts join edges on c = node cross join k where edges.l = 0 and edges.r = k.L group by 1, 2, 3, 4 having count(*) > 1")
def sibling_shared_mutations(f: Fixture) -> DataFrame:
    return mu.sibling_shared(f.mutations, f.edges, f.length)


@query(_FULL + "select inherited || '>' || derived as change, count(*) as n from muts group by 1")
def mutation_spectrum(f: Fixture) -> DataFrame:
    return f.mutations.groupBy(F.concat("inherited_state", F.lit(">"), "derived_state").alias("change")).agg(F.count("*").alias("n"))


@query(
    _FULL
    + """select position, count(*) filter (where inherited || derived in ('AG', 'GA', 'CT', 'TC')) as transitions,
count(*) filter (where inherited || derived not in ('AG', 'GA', 'CT', 'TC') and inherited <> '-' and derived <> '-') as transversions from muts group by 1"""
)
def ts_tv_per_site(f: Fixture) -> DataFrame:
    pair = F.concat("inherited_state", "derived_state")
    ts = pair.isin("AG", "GA", "CT", "TC")
    return f.mutations.groupBy("position").agg(F.count_if(ts).alias("transitions"), F.count_if(~ts & (F.col("inherited_state") != "-") & (F.col("derived_state") != "-")).alias("transversions"))


@query(
    _FULL
    + """select sites.position, ancestral as ancestral_state, count(id) as num_mutations, count(distinct node) as num_nodes, count(*) filter (where derived = '-') as num_deletions
from sites left join muts using (position) group by 1, 2"""
)
def site_summary(f: Fixture) -> DataFrame:
    per = f.mutations.groupBy("position").agg(F.count("*").alias("m"), F.countDistinct("node").alias("n"), F.count_if(F.col("derived_state") == "-").alias("d"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return f.sites.join(per, "position", "left").select("position", "ancestral_state", zero("m").alias("num_mutations"), zero("n").alias("num_nodes"), zero("d").alias("num_deletions"))


_EVENTS = """, del as (select node, position, position - row_number() over (partition by node order by position) as g from muts where derived = '-'),
events as (select node, min(position) as s, max(position) as e, count(*) as length from del group by node, g)
"""


@query(_FULL + _EVENTS + 'select node, s as start, e as "end", length from events')
def deletion_events(f: Fixture) -> DataFrame:
    return mu.runs(f.mutations.where("derived_state = '-'"), ["node"], "position")


@query(_FULL + _EVENTS + "select position, count(*) as overlaps from events join sites on s <= position and position <= e group by 1")
def deletion_overlaps(f: Fixture) -> DataFrame:
    return mu.covered(mu.runs(f.mutations.where("derived_state = '-'"), ["node"], "position"))


@query(_FULL + "select position, derived as derived_state, id as mutation_id, '(' || row_number() over (partition by position, derived order by id) || '/' || count(*) over (partition by position, derived) || ')' as label from muts")
def recurrence_labels(f: Fixture) -> DataFrame:
    same = Window.partitionBy("position", "derived_state")
    label = F.format_string("(%d/%d)", F.row_number().over(same.orderBy("mutation_id")), F.count("*").over(same))
    return f.mutations.select("position", "derived_state", "mutation_id", label.alias("label"))


@query(
    _FULL
    + """select (select count(*) from nodes) as nodes, (select count(*) from edges) as edges, (select count(*) from trees) as trees, (select count(*) from sites) as sites, count(*) as mutations,
(select count(*) from nodes where flags & 1 > 0) as samples, (select count(*) from nodes where flags & 8388608 > 0) as recombinants, count(distinct position) as sites_with_mutations, count(distinct node) as nodes_with_mutations,
(select cast(max(c) as bigint) from (select count(*) as c from muts group by position)) as max_mutations_per_site, (select round(median(c), 6) from (select count(*) as c from muts group by node)) as median_mutations_per_node from muts"""
)
def arg_summary(f: Fixture) -> DataFrame:
    one = lambda df, *c: F.broadcast(df.agg(*c))
    flags = F.col("flags")
    out = one(f.nodes, F.count("*").alias("nodes"), F.count_if(fl.has(flags, fl.SAMPLE)).alias("samples"), F.count_if(fl.has(flags, fl.RECOMBINANT)).alias("recombinants"))
    out = out.join(one(f.edges, F.count("*").alias("edges"))).join(one(graph.trees(f.edges), F.count("*").alias("trees"))).join(one(f.sites, F.count("*").alias("sites")))
    out = out.join(one(f.mutations, F.count("*").alias("mutations"), F.countDistinct("position").alias("sites_with_mutations"), F.countDistinct("node").alias("nodes_with_mutations")))
    out = out.join(one(f.mutations.groupBy("position").count(), F.max("count").alias("max_mutations_per_site")))
    return out.join(one(f.mutations.groupBy("node").count(), F.round(F.percentile("count", F.lit(0.5)), 6).alias("median_mutations_per_node")))


@query(
    _FULL
    + """, genes(s, e, gene) as (values (1, 40, 'g1'), (41, 300, 'g2'), (301, 900, 'g3'), (1001, 100000, 'g4'))
select gene, count(*) as mutations, count(distinct position) as sites from muts join genes on s <= position and position < e group by 1"""
)
def gene_annotation(f: Fixture) -> DataFrame:
    genes = f.spark.createDataFrame([(1, 40, "g1"), (41, 300, "g2"), (301, 900, "g3"), (1001, 100000, "g4")], "start bigint, end bigint, gene string")
    return f.mutations.join(F.broadcast(genes), (F.col("start") <= F.col("position")) & (F.col("position") < F.col("end"))).groupBy("gene").agg(F.count("*").alias("mutations"), F.countDistinct("position").alias("sites"))


# --- haplotypes and matching --------------------------------------------------------------------------------------------------

_STATES = """, asked as (select id as node from nodes),
up as (select node, tl, a, depth from reach union all select id, tl, id, 0 from nodes cross join trees),
near as (select asked.node, muts.position, arg_min(muts.derived, depth) as state from asked join up on up.node = asked.node join muts on muts.tl = up.tl and muts.node = up.a group by 1, 2)
"""


@query(_FULL + _STATES + "select asked.node, position, coalesce(state, ancestral) as state from asked cross join sites left join near using (node, position) where coalesce(state, ancestral) <> ancestral")
def extract_haplotypes(f: Fixture) -> DataFrame:
    asked = f.nodes.select(F.col("node_id").alias("node"))
    return matching.differing_states(asked, f.mutations, f.closure, f.sites)


@query(
    _FULL
    + _STATES.replace("asked as (select id as node from nodes)", "asked as (select id as node from nodes where flags & 8388608 > 0 or id in (select p from edges join nodes on id = c where flags & 8388608 > 0))")
    + """, st as (select asked.node, position, coalesce(state, ancestral) as state from asked cross join sites left join near using (node, position)),
two as (select x.c as child, x.p as left_parent, y.p as right_parent, x.r as breakpoint from edges x join edges y on x.c = y.c and x.r = y.l),
diff as (select child, left_parent, right_parent, breakpoint, a.position from two join st a on a.node = left_parent join (select node as bn, position as bp, state from st) b on bn = right_parent and a.position = bp where a.state <> b.state)
select two.child, two.left_parent, two.right_parent, two.breakpoint, count(position) as differing, coalesce(max(position) filter (where position < two.breakpoint) + 1, 0) as interval_left
from two left join diff using (child, left_parent, right_parent, breakpoint) group by 1, 2, 3, 4"""
)
def breakpoint_intervals(f: Fixture) -> DataFrame:
    return matching.breakpoint_intervals(f.edges, f.mutations, f.closure, f.sites)


@query("select cast(o_custkey % 8 as integer) as cost, count(*) as matches, round(count(*) * 100.0 / sum(count(*)) over (), 4) as percent from orders group by 1")
def match_cost_histogram(f: Fixture) -> DataFrame:
    total = F.sum(F.count("*")).over(Window.partitionBy())
    return f.matches.groupBy(F.col("hmm_cost").cast("int").alias("cost")).agg(F.count("*").alias("matches"), F.round(F.count("*") * 100.0 / total, 4).cast("double").alias("percent"))


@query(_WITH + "select 'S' || o_orderkey as sample_id, cast(o_orderdate as date) as match_date from orders where o_orderkey not in (select id from nodes where flags & 1 = 1)")
def match_unused(f: Fixture) -> DataFrame:
    return matching.unused(f.matches, f.nodes).select("sample_id", "match_date")


@query(
    _WITH
    + """select o_custkey as parent, count(*) as exact_matches from orders where o_custkey % 8 = 0 group by 1"""
)
def exact_match_counts(f: Fixture) -> DataFrame:
    return f.matches.where("hmm_cost = 0").groupBy("parent").agg(F.count("*").alias("exact_matches"))


@query(
    """with d as (select max(cast(o_orderdate as date)) as m from orders)
select cast(o_orderdate as date) as match_date, count(*) as matches from orders cross join d where o_custkey % 8 > 0 and o_custkey % 8 <= 5 and cast(o_orderdate as date) > m - 30 and cast(o_orderdate as date) < m group by 1"""
)
def retro_window(f: Fixture) -> DataFrame:
    return matching.retro_window(f.matches, days=30, cost=5.0).groupBy("match_date").agg(F.count("*").alias("matches"))


@query(
    """with g as (select o_custkey % 8 as c, o_custkey as p, string_agg('S' || o_orderkey, '' order by 'S' || o_orderkey) as s, count(*) as samples, count(distinct cast(o_orderdate as date)) as dates from orders group by 1, 2)
select md5(s) as group_id, p as parent, samples, dates from g where samples >= 3 and dates >= 2"""
)
def sample_groups(f: Fixture) -> DataFrame:
    return matching.sample_groups(f.matches, min_size=3, min_dates=2).drop("hmm_cost")


@query(
    """select cast(o_orderdate as date) as date, o_orderstatus as scorpio, count(*) as total, count(*) filter (where o_custkey % 8 = 0) as exact, count(*) filter (where o_custkey % 8 > 5) as rejected,
cast(sum(o_custkey % 8) as double) as sum_cost, round(avg(o_custkey % 8), 2) as mean_cost, cast(median(o_custkey % 8) as double) as median_cost from orders group by 1, 2"""
)
def daily_stats(f: Fixture) -> DataFrame:
    return matching.daily_stats(f.matches)


@query("select date, coalesce(max(n) filter (where s = 'F'), 0) as f, coalesce(max(n) filter (where s = 'O'), 0) as o, coalesce(max(n) filter (where s = 'P'), 0) as p from (select cast(o_orderdate as date) as date, o_orderstatus as s, count(*) as n from orders group by 1, 2) x group by 1")
def scorpio_pivot(f: Fixture) -> DataFrame:
    wide = f.matches.groupBy(F.col("match_date").alias("date")).pivot("scorpio", ["F", "O", "P"]).agg(F.count("sample_id"))
    return wide.na.fill(0).toDF("date", "f", "o", "p")


@query(
    """with d as (select o_custkey as c, min(cast(o_orderdate as date)) as date from orders group by 1)
select date, n_name as country, count(*) as samples from customer join nation on c_nationkey = n_nationkey left join d on d.c = c_custkey group by 1, 2"""
)
def samples_per_day(f: Fixture) -> DataFrame:
    return f.samples.groupBy("date", "country").agg(F.count("*").alias("samples"))


@query(
    """with d as (select o_custkey as c, min(cast(o_orderdate as date)) as date from orders group by 1)
select 'S' || c_custkey as sample_id, n_name as country, r_name as region, c_mktsegment as segment, date, row_number() over (order by date nulls last, n_name, c_custkey) as place
from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey left join d on d.c = c_custkey where date is not null"""
)
def reorder_samples(f: Fixture) -> DataFrame:
    dated = f.samples.where("date is not null")
    placed = numbered(dated, "place", F.unix_date("date"), ["date", "country", "node_id"])
    return placed.select("sample_id", "country", "region", "segment", "date", (F.col("place") + 1).alias("place"))


# --- sequences ----------------------------------------------------------------------------------------------------------------

_LETTERS = """with s as (select doc_id, regexp_replace(translate(coalesce(text, ''), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^ACGTRYSWKMBDHV.\\-]', 'N', 'gs') as letters from documents)
"""


@query(_LETTERS + "select doc_id, md5(replace(array_to_string(list_transform(regexp_extract_all(letters, '.'), lambda x: instr('ACGT-RYSWKMBDHV.', x) - 1), ','), '', '')) as codes_md5 from s")
def encode_alleles(f: Fixture) -> DataFrame:
    return f.sequences.select("doc_id", F.md5(F.array_join(sq.encode(F.col("letters")).cast("array<string>"), ",")).alias("codes_md5"))


@query(_LETTERS + "select doc_id, md5(letters) as letters_md5, length(letters) as letters from s")
def decode_alleles(f: Fixture) -> DataFrame:
    back = sq.decode(sq.encode(F.col("letters")))
    return f.sequences.select("doc_id", F.md5(back).alias("letters_md5"), F.length(back).cast("bigint").alias("letters"))


@query(_LETTERS + "select doc_id, md5(regexp_replace(letters, '[RYSWKMBDHV.]', 'N', 'g')) as masked_md5 from s")
def mask_ambiguous(f: Fixture) -> DataFrame:
    return f.sequences.select("doc_id", F.md5(sq.ambiguous_masked(F.col("letters"))).alias("masked_md5"))


@query(_LETTERS + """select doc_id, md5(case when regexp_matches(letters, '^-*$') then repeat('N', length(letters)) else
repeat('N', length(letters) - length(ltrim(letters, '-'))) || trim(letters, '-') || repeat('N', length(letters) - length(rtrim(letters, '-'))) end) as masked_md5 from s""")
def mask_flanks(f: Fixture) -> DataFrame:
    return f.sequences.select("doc_id", F.md5(sq.flanks_masked(F.col("letters"))).alias("masked_md5"))


@query(_LETTERS + "select letter, count(*) as n, count(distinct doc_id) as documents from (select doc_id, unnest(regexp_extract_all(letters, '.')) as letter from s) x group by 1")
def alignment_composition(f: Fixture) -> DataFrame:
    # One row per document and letter, not per character.
    counts = f.sequences.select("doc_id", F.explode(F.array(*[F.struct(F.lit(a).alias("letter"), (F.length("letters") - F.length(F.replace("letters", F.lit(a), F.lit("")))).alias("n")) for a in sq.ALLELES + "N"])).alias("c"))
    return counts.select("doc_id", "c.*").where("n > 0").groupBy("letter").agg(F.sum("n").cast("bigint").alias("n"), F.countDistinct("doc_id").alias("documents"))


@query(_LETTERS + "select doc_id, length(letters) - length(replace(letters, 'N', '')) as missing, length(letters) - length(replace(letters, '-', '')) as deletions from s")
def missing_deletion_counts(f: Fixture) -> DataFrame:
    return f.sequences.select("doc_id", sq.letters_of(F.col("letters"), "N").alias("missing"), sq.letters_of(F.col("letters"), "-").alias("deletions"))


_MASKED = (
    _LETTERS
    + """, f as (select doc_id, case when regexp_matches(letters, '^-*$') then repeat('N', length(letters)) else
repeat('N', length(letters) - length(ltrim(letters, '-'))) || trim(letters, '-') || repeat('N', length(letters) - length(rtrim(letters, '-'))) end as letters from s),
m as (select doc_id, regexp_replace(letters, '[RYSWKMBDHV.]', 'N', 'g') as letters from f)
"""
)


def _flank_masked(f: Fixture) -> DataFrame:
    return f.sequences.select("doc_id", sq.flanks_masked(F.col("letters")).alias("letters"))


@query(_MASKED + "select letter, count(*) as n, count(distinct doc_id) as documents from (select doc_id, unnest(regexp_extract_all(letters, '.')) as letter from f) x group by 1")
def alignment_composition_masked(f: Fixture) -> DataFrame:
    """Letters after the flank mask, before the ambiguity mask."""
    letters = [F.struct(F.lit(a).alias("letter"), sq.letters_of(F.col("letters"), a).alias("n")) for a in "N" + sq.ALLELES]
    counts = _flank_masked(f).select("doc_id", F.explode(F.array(*letters)).alias("c"))
    return counts.select("doc_id", "c.*").where("n > 0").groupBy("letter").agg(F.sum("n").cast("bigint").alias("n"), F.countDistinct("doc_id").alias("documents"))


@query(_MASKED + "select doc_id, length(letters) - length(replace(letters, 'N', '')) as missing, length(letters) - length(replace(letters, '-', '')) as deletions from m")
def missing_deletion_counts_masked(f: Fixture) -> DataFrame:
    """Per sample, after both masks."""
    masked = _flank_masked(f).select("doc_id", sq.ambiguous_masked(F.col("letters")).alias("letters"))
    return masked.select("doc_id", sq.letters_of(F.col("letters"), "N").alias("missing"), sq.letters_of(F.col("letters"), "-").alias("deletions"))


@query(
    _MASKED
    + """select position, count(*) filter (where letter = 'N') as missing, count(*) filter (where letter = '-') as deletions
from (select unnest(range(1, length(letters) + 1)) as position, unnest(regexp_extract_all(letters, '.')) as letter from m) x where letter in ('N', '-') group by 1"""
)
def site_missing_deletion_counts(f: Fixture) -> DataFrame:
    """Per site that has any, after both masks; counts are summed within each task before they are dealt."""
    codes = _flank_masked(f).select(F.posexplode(sq.encode(sq.ambiguous_masked(F.col("letters")))).alias("at", "code")).where(F.col("code").isin(-1, sq.DELETION))
    return codes.groupBy((F.col("at") + 1).cast("bigint").alias("position")).agg(F.count_if(F.col("code") == -1).alias("missing"), F.count_if(F.col("code") == sq.DELETION).alias("deletions"))


@query("select cast(ts as date) as day, event_type, count(*) as events, count(distinct user_id) as users, round(sum(value), 4) as total from events group by 1, 2")
def event_days(f: Fixture) -> DataFrame:
    return f.read("events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"))
