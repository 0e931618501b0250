"""Report queries: summaries of the whole graph, of nodes, sites, sample groups and recombinants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import flags as fl
from strandlake.functions import sequences as sq
from strandlake.operators import graph, matching, reports
from strandlake.operators import mutations as mu
from strandlake.plans.catalogue import _CLOSED, _COUNTS, _FULL, _MASKED, _PARSIMONY, _WITH, query
from strandlake.plans.fixture import Fixture

_GROUPS = """g as (select o_custkey % 8 as c, o_custkey as p, md5(string_agg('S' || o_orderkey, '' order by 'S' || o_orderkey)) as group_id, count(*) as samples, count(distinct cast(o_orderdate as date)) as dates,
  count(distinct o_orderstatus) as lineages, min(cast(o_orderdate as date)) as first_date, max(cast(o_orderdate as date)) as last_date from orders group by 1, 2)"""


@query(
    _FULL
    + _COUNTS
    + _PARSIMONY
    + """, descendants as (select muts.id, coalesce(samples, 0) as n from muts left join below on below.tl = muts.tl and below.node = muts.node),
chain(id, parent, n) as (select id, parent, 0 from muts union all select chain.id, muts.parent, n + 1 from chain join muts on muts.id = chain.parent),
per_node as (select nodes.id, flags, count(m.id) as c from nodes left join muts m on m.node = nodes.id group by 1, 2), per_site as (select position, count(id) as c from sites left join muts using (position) group by 1),
dated as (select date, count(*) as c from (select min(cast(o_orderdate as date)) as date from orders join customer on c_custkey = o_custkey group by o_custkey) x group by 1), grouped as (select count(*) as c, count(distinct cast(o_orderdate as date)) as dates from orders group by o_custkey % 8, o_custkey)
select unnest(['samples', 'nodes', 'exact_matches', 'mc_nodes', 'pr_nodes', 're_nodes', 'imr_nodes', 'mutations', 'recurrent', 'reversions', 'immediate_reversions', 'private_mutations', 'transitions', 'transversions', 'insertions', 'deletions', 'max_mutations_parents',
 'nodes_with_zero_muts', 'sites_with_zero_muts', 'max_mutations_per_site', 'mean_mutations_per_site', 'median_mutations_per_site', 'max_mutations_per_node', 'max_mutations_per_non_sample_node', 'latest_sample', 'max_samples_per_day', 'mean_samples_per_day', 'sample_groups']) as property,
unnest([(select count(*) from nodes where flags & 1 > 0), (select count(*) from nodes), (select count(*) from orders where o_custkey % 8 = 0), 0, 0, (select count(*) from nodes where flags & 8388608 > 0), 0, (select count(*) from muts), (select count(*) from muts where parent >= 0), (select count(*) from ps where is_reversion), (select count(*) from ps where is_immediate),
 (select count(*) from descendants where n = 1), (select count(*) from muts where inherited || derived in ('AG', 'GA', 'CT', 'TC')), (select count(*) from muts where inherited || derived not in ('AG', 'GA', 'CT', 'TC') and inherited <> '-' and derived <> '-'), (select count(*) from muts where inherited = '-'), (select count(*) from muts where derived = '-'), (select max(n) from chain),
 (select count(*) from per_node where c = 0), (select count(*) from per_site where c = 0), (select max(c) from per_site), (select round(avg(c), 6) from per_site), (select median(c) from per_site), (select max(c) from per_node), (select max(c) from per_node where flags & 1 = 0),
 (select date_diff('day', date '1970-01-01', max(date)) from dated), (select max(c) from dated), (select round(avg(c), 6) from dated), (select count(*) from grouped where c >= 3 and dates >= 2)]::double[]) as value"""
)
def arg_properties(f: Fixture) -> DataFrame:
    """One row per property; dates are days since 1970. The counts of each source table come from one pass over it."""
    flags, m = F.col("flags"), f.mutations
    nodes = f.nodes.agg(
        F.count_if(fl.has(flags, fl.SAMPLE)).alias("samples"), F.count("*").alias("nodes"), F.count_if(flags == fl.MUTATION_OVERLAP).alias("mc_nodes"), F.count_if(flags == fl.REVERSION_PUSH).alias("pr_nodes"),
        F.count_if(fl.has(flags, fl.RECOMBINANT)).alias("re_nodes"), F.count_if(flags == fl.REVERSION_MARKER).alias("imr_nodes"),
    )
    full = mu.inheritance(mu.parsimony(m, f.edges).drop("node_parent"), f.sample_counts).join(mu.num_parents(m), "mutation_id")
    pair = F.concat("inherited_state", "derived_state")
    ts, gap = pair.isin("AG", "GA", "CT", "TC"), (F.col("inherited_state") == "-") | (F.col("derived_state") == "-")
    counts = full.agg(
        F.count("*").alias("mutations"), F.count_if(F.col("parent") >= 0).alias("recurrent"), F.count_if("is_reversion").alias("reversions"), F.count_if("is_immediate_reversion").alias("immediate_reversions"), F.count_if(F.col("num_descendants") == 1).alias("private_mutations"),
        F.count_if(ts).alias("transitions"), F.count_if(~ts & ~gap).alias("transversions"), F.count_if(F.col("inherited_state") == "-").alias("insertions"), F.count_if(F.col("derived_state") == "-").alias("deletions"), F.max("num_parents").alias("max_mutations_parents"),
    )
    zero = F.coalesce("c", F.lit(0))
    per_node = f.nodes.join(m.groupBy(F.col("node").alias("node_id")).agg(F.count("*").alias("c")), "node_id", "left").select("flags", zero.alias("c"))
    per_node = per_node.agg(F.count_if(F.col("c") == 0).alias("nodes_with_zero_muts"), F.max("c").alias("max_mutations_per_node"), F.max(F.when(~fl.has(flags, fl.SAMPLE), F.col("c"))).alias("max_mutations_per_non_sample_node"))
    per_site = f.sites.join(m.groupBy("position").agg(F.count("*").alias("c")), "position", "left").select(zero.alias("c"))
    per_site = per_site.agg(F.count_if(F.col("c") == 0).alias("sites_with_zero_muts"), F.max("c").alias("max_mutations_per_site"), F.round(F.avg("c"), 6).alias("mean_mutations_per_site"), F.percentile("c", F.lit(0.5)).alias("median_mutations_per_site"))
    days = f.samples.where("date is not null").groupBy("date").agg(F.count("*").alias("c")).agg(F.unix_date(F.max("date")).alias("latest_sample"), F.max("c").alias("max_samples_per_day"), F.round(F.avg("c"), 6).alias("mean_samples_per_day"))
    groups = f.matches.groupBy("hmm_cost", "parent").agg(F.count("*").alias("c"), F.countDistinct("match_date").alias("dates")).agg(F.count_if((F.col("c") >= 3) & (F.col("dates") >= 2)).alias("sample_groups"))
    exact = f.matches.agg(F.count_if(F.col("hmm_cost") == 0).alias("exact_matches"))
    return reports.properties([nodes, exact, counts, per_node, per_site, days, groups])


@query("select cast(o_orderdate as date) as date, o_orderstatus as scorpio, count(*) as total, count(*) filter (where o_custkey % 8 = 0) as exact, count(*) filter (where o_custkey % 8 > 5) as rejected, count(*) filter (where o_custkey % 8 between 1 and 5) as inserted from orders group by 1, 2")
def samples_summary(f: Fixture) -> DataFrame:
    return matching.daily_stats(f.matches).select("date", "scorpio", "total", "exact", "rejected", (F.col("total") - F.col("rejected") - F.col("exact")).alias("inserted"))


@query(f"with {_GROUPS} select group_id, p as parent, samples, dates, lineages, first_date, last_date, (c > 0 and last_date > (select max(cast(o_orderdate as date)) from orders) - 365) as is_retro from g where samples >= 3 and dates >= 2")
def sample_groups_summary(f: Fixture) -> DataFrame:
    return reports.sample_groups_summary(f.matches, min_size=3, min_dates=2, retro_days=365)


@query(f"with {_GROUPS} select group_id, p as parent, samples, dates, lineages from g where samples >= 3 and dates >= 2 and c > 0 and last_date > (select max(cast(o_orderdate as date)) from orders) - 365")
def retro_groups_summary(f: Fixture) -> DataFrame:
    return reports.sample_groups_summary(f.matches, min_size=3, min_dates=2, retro_days=365).where("is_retro").select("group_id", "parent", "samples", "dates", "lineages")


@query(
    _FULL
    + _COUNTS
    + """, most as (select node, max(samples) as m from below group by node), per as (select node, count(*) as c, count(*) filter (where derived = '-') as d from muts group by 1),
up as (select c as node, count(*) as n from edges group by 1), down as (select p as node, count(*) as n, count(distinct c) as kids from edges group by 1),
kid as (select p as node, sum(coalesce(per.c, 0)) as cm from (select distinct p, c from edges) e left join per on per.node = e.c group by 1)
select nodes.id as node_id, 'S' || nodes.id as sample_id, coalesce(up.n, 0) as parents, coalesce(down.n, 0) as children, coalesce(m, 0) as descendants, coalesce(per.c, 0) as mutations, coalesce(d, 0) as deletions, cast(coalesce(cm, 0) as bigint) as child_mutations,
coalesce(ex.n, 0) as exact_matches from nodes left join most on most.node = id left join per on per.node = id left join up on up.node = id left join down on down.node = id left join kid on kid.node = id left join (select o_custkey as node, count(*) as n from orders where o_custkey % 8 = 0 group by 1) ex on ex.node = id"""
)
def node_summary(f: Fixture) -> DataFrame:
    return reports.node_summary(f.nodes, f.edges, f.mutations, f.sample_counts, f.matches)


@query(
    _FULL
    + _PARSIMONY
    + """, kids as (select distinct p, c from edges), back as (select p, c, count(*) as same, count(*) filter (where u.inherited = v.derived and u.derived = v.inherited) as reversions
  from kids join muts u on u.node = p join muts v on v.node = c and v.position = u.position group by 1, 2)
select kids.p as parent, kids.c as child, coalesce(n, 0) as new_muts, coalesce(same, 0) as same_site_muts, coalesce(reversions, 0) as reversions, a.time - b.time as branch_length
from kids join nodes a on a.id = kids.p join nodes b on b.id = kids.c left join (select node, count(*) as n from muts group by 1) m on m.node = kids.c left join back on back.p = kids.p and back.c = kids.c"""
)
def children_summary(f: Fixture) -> DataFrame:
    return reports.children_summary(f.nodes, f.edges, f.mutations)


@query(
    _FULL
    + """, self as (select tl, node, a, depth from reach union all select tl, id, id, 0 from nodes cross join trees)
select muts.tl as tree_left, self.node, depth, muts.node as at_node, position, inherited || position || derived as label from self join muts on muts.tl = self.tl and muts.node = a where self.node in (select c from edges join nodes on id = c where flags & 8388608 > 0)"""
)
def mutation_paths(f: Fixture) -> DataFrame:
    """The mutations on every recombinant's path to the root, in every tree."""
    asked = f.nodes.where(fl.has(F.col("flags"), fl.RECOMBINANT)).select(F.col("node_id").alias("node"))
    return graph.with_tree(reports.mutation_paths(asked, f.mutations, f.closure), f.edges).select("tree_left", "node", "depth", "at_node", "position", "label")


@query(
    _FULL
    + _COUNTS
    + """, most as (select node, max(samples) as m from below group by node), two as (select x.c as child, x.p as lp, y.p as rp, x.r as bp from edges x join edges y on x.c = y.c and x.r = y.l),
self as (select tl, node, a from reach union all select tl, id, id from nodes cross join trees),
lpath as (select child, a from two join self on node = lp join trees using (tl) where tr = bp), rpath as (select child, a from two join self on node = rp and tl = bp),
top as (select child, arg_min(a, time) as mrca from lpath join rpath using (child, a) join nodes on nodes.id = a group by 1),
old as (select p as child, arg_max(c, time) as oldest from edges join nodes on id = c group by 1), dates as (select id, cast(date '2023-01-01' - cast(time as integer) as date) as date from nodes)
select two.child as recombinant, bp as interval_right, lp as parent_left, rp as parent_right, mrca as parent_mrca, oldest as oldest_child, coalesce(m, 0) as num_descendant_samples, d.date as recombinant_date, dl.date as parent_left_date, dr.date as parent_right_date, dm.date as parent_mrca_date
from two join nodes on id = two.child and flags & 8388608 > 0 left join top on top.child = two.child left join old on old.child = two.child left join most on most.node = two.child join dates d on d.id = two.child join dates dl on dl.id = lp join dates dr on dr.id = rp left join dates dm on dm.id = mrca"""
)
def recombinants_summary(f: Fixture) -> DataFrame:
    return reports.recombinants_summary(f.nodes, f.edges, f.closure, f.sample_counts, "2023-01-01")


@query(_FULL + "select position, c as num_mutations from (select position, count(*) as c from muts group by 1) x where c >= 0.9 * (select max(c) from (select count(*) as c from muts group by position) y)")
def most_mutated_sites(f: Fixture) -> DataFrame:
    return reports.over_fraction_of_most(f.mutations.groupBy("position").agg(F.count("*").alias("num_mutations")), "num_mutations", 0.9)


@query(
    _FULL
    + _COUNTS
    + """, d as (select muts.*, coalesce(samples, 0) as n from muts left join below on below.tl = muts.tl and below.node = muts.node), lost as (select parent as id, sum(n) as lost from d where parent >= 0 group by 1)
select inherited || '>' || derived as change, count(*) as n from d left join lost using (id) where d.n - coalesce(lost, 0) >= 3 group by 1"""
)
def mutation_spectrum_inherited(f: Fixture) -> DataFrame:
    kept = mu.inheritance(f.mutations, f.sample_counts).where("num_inheritors >= 3")
    return kept.groupBy(F.concat("inherited_state", F.lit(">"), "derived_state").alias("change")).agg(F.count("*").alias("n"))


@query(
    _FULL
    + _COUNTS
    + """, d as (select muts.*, coalesce(samples, 0) as n from muts left join below on below.tl = muts.tl and below.node = muts.node), lost as (select parent as id, sum(n) as lost from d where parent >= 0 group by 1)
select position, id as mutation_id, node, inherited || position || derived as label, n as num_descendants, cast(n - coalesce(lost, 0) as bigint) as num_inheritors, row_number() over (partition by position order by n desc, id) as place from d left join lost using (id)"""
)
def site_mutation_data(f: Fixture) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("position").orderBy(F.desc("num_descendants"), "mutation_id")).cast("bigint")
    label = F.concat("inherited_state", F.col("position").cast("string"), "derived_state")
    return mu.inheritance(f.mutations, f.sample_counts).select("position", "mutation_id", "node", label.alias("label"), F.col("num_descendants").cast("bigint").alias("num_descendants"), F.col("num_inheritors").cast("bigint").alias("num_inheritors"), place.alias("place"))


#: The genome's own coordinates, scaled to the fixture's: its length over the genome's.
_REGION_SQL = f"""genes(s, e, gene) as (values {", ".join(f"({s}, {e}, '{g}')" for s, e, g in reports.GENES)}),
regions as (select s, e, gene as name, 'gene' as kind from genes union all select 21602, 22472, 'NTD', 'problematic' union all select s, e, gene, 'problematic' from genes where gene = 'ORF8'
  union all select 1, (select min(s) from genes), '5p', 'flank' union all select (select max(e) from genes), 29904, '3p', 'flank')"""


@query(_FULL + f", {_REGION_SQL} select name, kind, count(*) as mutations, count(distinct position) as sites from muts join regions on s <= position * 29903 // (select L from k) and position * 29903 // (select L from k) < e group by 1, 2")
def region_mutations(f: Fixture) -> DataFrame:
    """Mutations in genes, problematic regions and flanks; positions are stretched to the genome's length."""
    return reports.in_regions(f.mutations.withColumn("at", F.expr(f"position * {reports.GENOME} div {f.length}")), "at").groupBy("name", "kind").agg(F.count("*").alias("mutations"), F.countDistinct("position").alias("sites"))


@query(_FULL + """, per as (select node, count(*) as c, count(*) filter (where parent >= 0) as again from muts group by 1), full_ as (select p, c from edges where l = 0 and r = (select L from k)), kids as (select p, count(distinct c) as kids from full_ group by 1)
select p as root, kids as samples, cast(coalesce(sum(per.c), 0) as bigint) as mutations, cast(coalesce(sum(per.again), 0) as bigint) as recurrent, round(coalesce(sum(per.c), 0) / kids, 6) as mutations_per_sample, coalesce(max(own.c), 0) as root_mutations
from kids join full_ using (p) left join per on per.node = full_.c left join per own on own.node = kids.p group by 1, 2""")
def group_metrics(f: Fixture) -> DataFrame:
    """A node and its full-span children as a group tree: size, mutations, recurrent ones, those above the root."""
    return reports.group_metrics(f.edges, f.mutations, f.length)


@query(_CLOSED + ", paths as (select node, max(depth) as deepest, count(distinct a) as ancestors from reach group by 1) select node, deepest, ancestors from paths")
def path_depths(f: Fixture) -> DataFrame:
    """Over all trees: the longest path to the root, and how many different ancestors a node has."""
    return f.closure.groupBy("node").agg(F.max("depth").alias("deepest"), F.countDistinct("ancestor").alias("ancestors"))


@query(_WITH + "select flags, count(*) as nodes, max(time) as oldest from nodes where flags & 8388608 = 8388608 group by 1")
def recombinant_flags(f: Fixture) -> DataFrame:
    return f.nodes.where(fl.has(F.col("flags"), fl.RECOMBINANT)).groupBy("flags").agg(F.count("*").alias("nodes"), F.max("time").alias("oldest"))


@query(f"with {_GROUPS} select group_id, 'S' || o_orderkey as sample_id, cast(o_orderdate as date) as match_date from g join orders on o_custkey = p where samples >= 3 and dates >= 2")
def group_members(f: Fixture) -> DataFrame:
    return matching.group_members(f.matches, min_size=3, min_dates=2)


@query(
    _MASKED
    + """, counted as (select 'S' || doc_id as sample_id, cast(length(letters) - length(replace(letters, 'N', '')) as bigint) as missing from m), asked as (select distinct 'S' || doc_id as sample_id from labels where toxic = 1)
select sample_id, missing, sample_id in (select sample_id from asked) as included from counted where missing <= 500 or sample_id in (select sample_id from asked)"""
)
def samples_kept(f: Fixture) -> DataFrame:
    """Sequences of at most 500 missing sites after both masks; labelled ones (toxic) stay whatever they miss."""
    name = lambda c: F.concat(F.lit("S"), F.col(c).cast("string")).alias("sample_id")
    masked = f.sequences.select(name("doc_id"), sq.letters_of(sq.ambiguous_masked(sq.flanks_masked(F.col("letters"))), "N").alias("missing"))
    return matching.samples_kept(masked, 500, f.read("labels").where("toxic = 1").select(name("doc_id")))
