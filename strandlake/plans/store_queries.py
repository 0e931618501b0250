"""Queries over the stores of alignments, metadata and matches, and the validation of a graph against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators import matching, store
from strandlake.operators.match_store import MatchStore
from strandlake.operators.ordering import numbered
from strandlake.plans.catalogue import _FULL, _LETTERS, _STATES, _WITH, query
from strandlake.plans.fixture import Fixture
from strandlake.plans.lineage import fresh_path
from strandlake.sources import chunks

#: Selections that the queries below are asked for.
POSITIONS, DATE, SPLIT_DATE = [1, 2, 17, 300], "1995-01-05", "1997-06-30"
_D = "d as (select o_custkey as c, min(cast(o_orderdate as date)) as date from orders group by 1)"
_META = f"with {_D} select 'S' || c_custkey as sample_id, %s from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey left join d on d.c = c_custkey"
_STORE = "select 'S' || o_orderkey as sample_id, cast(o_orderdate as date) as match_date, cast(o_custkey % 8 as double) as hmm_cost, o_custkey as parent from orders"


def _alignments(f: Fixture) -> DataFrame:
    return f.sequences.select(F.concat(F.lit("S"), F.col("doc_id").cast("string")).alias("sample_id"), "letters")


@query(
    _LETTERS
    + f"""select cast(position as bigint) as position, 'S' || doc_id as sample_id, cast(instr('ACGT-RYSWKMBDHV.', substr(letters, position, 1)) - 1 as integer) as genotype
from s cross join (values {", ".join(f"({p})" for p in POSITIONS)}) t(position) where position <= length(letters)"""
)
def variants_slice(f: Fixture) -> DataFrame:
    """All alignments are stored by site; the positions' cells are read back."""
    path = fresh_path(f.spark, "alignments")
    chunks.create(f.spark, path, _alignments(f), cell=256)
    return chunks.variants(f.spark, path, POSITIONS)


@query(_META % "date, n_name as country, r_name as region, c_mktsegment as segment" + f" where date = date '{DATE}'")
def samples_for_date(f: Fixture) -> DataFrame:
    return store.samples_for_date(f.samples, DATE).select("sample_id", "date", "country", "region", "segment")


@query(_META % "c_mktsegment as segment, n_name as nation")
def metadata_projection(f: Fixture) -> DataFrame:
    return store.projected(f.samples, ["segment", "country"], {"country": "nation"})


@query(
    f"""with m as ({_META % "n_name as country, r_name as region, c_mktsegment as segment, date"})
select 'country' as field, 'string' as type, count(country) as present, count(distinct country) as distinct_values from m union all select 'region', 'string', count(region), count(distinct region) from m
union all select 'segment', 'string', count(segment), count(distinct segment) from m union all select 'date', 'date', count(date), count(distinct date) from m"""
)
def metadata_fields(f: Fixture) -> DataFrame:
    return store.field_statistics(f.samples.drop("node_id"))


@query(_LETTERS + "select count(*) as num_samples, cast(max(length(letters)) as bigint) as num_variants, cast(sum(length(letters)) as bigint) as total_letters from s")
def store_sizes(f: Fixture) -> DataFrame:
    return store.sizes(_alignments(f))


@query(
    f"""with {_D}, {_LETTERS.strip().removeprefix("with ")} select 'S' || doc_id as sample_id, length(letters) as letters, n_name as country, date
from s join customer on c_custkey = doc_id join nation on c_nationkey = n_nationkey left join d on d.c = c_custkey"""
)
def metadata_joined(f: Fixture) -> DataFrame:
    known = _alignments(f).join(f.samples, "sample_id", "left_semi")
    return store.add_metadata(known, f.samples).select("sample_id", F.length("letters").cast("bigint").alias("letters"), "country", "date")


@query(_STORE)
def match_samples(f: Fixture) -> DataFrame:
    return f.matches.select("sample_id", "match_date", "hmm_cost", "parent")


@query("select count(*) as matches, max(cast(o_orderdate as date)) as last_date from orders")
def match_last_date(f: Fixture) -> DataFrame:
    return store.last_date(f.matches)


@query(f"select count(*) as newer from orders where cast(o_orderdate as date) > date '{SPLIT_DATE}'")
def match_count_newer(f: Fixture) -> DataFrame:
    return store.newer(f.matches, SPLIT_DATE).agg(F.count("*").alias("newer"))


@query(f"select * from ({_STORE}) x where match_date <= date '{SPLIT_DATE}'")
def match_without_newer(f: Fixture) -> DataFrame:
    """Two halves are added to a match store, the second one once more as a repeated batch, and newer matches are deleted."""
    kept = MatchStore(f.spark, fresh_path(f.spark, "matches"))
    rows = f.matches.select("sample_id", "match_date", "hmm_cost", "parent")
    odd = F.pmod(F.xxhash64("sample_id"), F.lit(2)) == 1
    kept.add(rows.where(~odd))
    for _ in range(2):
        kept.add(rows.where(odd), stream="halves", batch=0)
    kept.delete_newer(SPLIT_DATE)
    return kept.read()


@query(f"select * from ({_STORE}) x where match_date = date '{SPLIT_DATE}' and hmm_cost <= 5")
def match_on_date(f: Fixture) -> DataFrame:
    return store.matched_on(f.matches, SPLIT_DATE, 5.0).select("sample_id", "match_date", "hmm_cost", "parent")


@query(
    f"""select sample_id, match_date from (select *, row_number() over (partition by match_date order by md5('42' || match_date || sample_id), sample_id) as place from ({_STORE}) x) y where place <= 3"""
)
def daily_samples(f: Fixture) -> DataFrame:
    return matching.sampled_per_day(f.matches, 3, 42).select("sample_id", "match_date")


@query(
    _WITH
    + """, last as (select max(cast(o_orderdate as date)) as m from orders)
select (select max(id) from nodes) + row_number() over (order by cast(o_orderdate as date), 'S' || o_orderkey) as node_id, 'S' || o_orderkey as sample_id, cast(m - cast(o_orderdate as date) as double) as time, o_custkey as parent
from orders cross join last where o_custkey % 8 = 0"""
)
def exact_match_nodes(f: Fixture) -> DataFrame:
    return matching.exact_match_nodes(f.matches, f.nodes)


@query(_WITH + "select id as node_id, 'S' || id as sample_id, flags, time from nodes")
def minimised_metadata(f: Fixture) -> DataFrame:
    full = f.nodes.select("node_id", F.col("sample_id").alias("strain"), "flags", "time", F.lit("debug").alias("notes"))
    return matching.minimised(full, {"strain": "sample_id"})


# --- matches and their mutations --------------------------------------------------------------------------------------------------

_PATHS = """, found as (select l_orderkey as match, l_partkey + 1 as position, 1 + l_suppkey % ((select n from k) - 1) as node, substr('ACGT-', cast(min(l_linenumber) % 5 + 1 as integer), 1) as derived
  from lineitem group by 1, 2, 3)
"""


def _match_mutations(f: Fixture) -> DataFrame:
    """match, position, node (the parent copied from there), derived_state."""
    rows = f.read("lineitem").groupBy(F.col("l_orderkey").alias("match"), (F.col("l_partkey") + 1).alias("position"), (1 + F.col("l_suppkey") % (f.size - 1)).alias("node"))
    return rows.agg(F.min("l_linenumber").alias("k")).select("match", "position", "node", F.substr(F.lit("ACGT-"), (F.col("k") % 5 + 1).cast("int"), F.lit(1)).alias("derived_state"))


@query(
    _FULL
    + _PATHS
    + """, placed2 as (select found.*, tl from found join trees on tl <= position and position < tr),
self as (select tl, node, a, depth from reach union all select tl, id, id, 0 from nodes cross join trees),
near as (select p.match, p.position, p.node, arg_min(m.id, depth) as id from placed2 p join muts m on m.position = p.position join self on self.tl = p.tl and self.node = p.node and self.a = m.node group by 1, 2, 3)
select found.match, found.position, found.node, found.derived as derived_state, coalesce(muts.inherited = found.derived, false) as is_reversion, coalesce(muts.inherited = found.derived and muts.node = found.node, false) as is_immediate_reversion
from found left join near using (match, position, node) left join muts on muts.id = near.id"""
)
def match_mutations(f: Fixture) -> DataFrame:
    return matching.characterised(_match_mutations(f), f.mutations, f.closure)


@query("select 'S' || o_orderkey as sample_id, cast(3 * (segments - 1) + mutations as bigint) as cost from orders join (select l_orderkey, count(distinct l_suppkey % 3) as segments, count(*) as mutations from lineitem group by 1) x on l_orderkey = o_orderkey")
def match_costs(f: Fixture) -> DataFrame:
    rows = f.read("lineitem").select(F.concat(F.lit("S"), F.col("l_orderkey").cast("string")).alias("sample_id"), (F.col("l_suppkey") % 3).alias("parent"))
    return matching.costs(rows.distinct(), rows, 3).join(f.matches.select("sample_id"), "sample_id", "left_semi")


@query(
    _WITH
    + """, seg as (select c, l, r, p from edges where c in (select c from edges group by c having count(*) > 1))
select c as child, cast(k.L - seg.r as bigint) as left, cast(k.L - seg.l as bigint) as right, p as parent, row_number() over (partition by c order by k.L - seg.r) as segment from seg cross join k"""
)
def match_paths_mirrored(f: Fixture) -> DataFrame:
    several = f.edges.groupBy("child").count().where("count > 1").select("child")
    return matching.mirrored_paths(f.edges.join(several, "child", "left_semi").select("child", "left", "right", "parent"), f.length)


@query(
    _FULL
    + """, two as (select x.c as child, x.r as bp, x.p as lp, y.p as rp from edges x join edges y on x.c = y.c and x.r = y.l),
self as (select tl, node, a from reach union all select tl, id, id from nodes cross join trees),
lpath as (select child, a from two join self on node = lp join trees using (tl) where tr = bp), rpath as (select child, a from two join self on node = rp and tl = bp),
top as (select child, arg_min(a, time) as mrca, min(time) as t from lpath join rpath using (child, a) join nodes on nodes.id = a group by 1),
below as (select child, 'left' as side, a as node from lpath union all select child, 'right', a from rpath)
select b.child, side, b.node, count(m.id) as mutations, count(distinct m.position) as sites from below b join top using (child) join nodes on nodes.id = b.node and time < t left join muts m on m.node = b.node group by 1, 2, 3"""
)
def mutations_to_mrca(f: Fixture) -> DataFrame:
    return matching.mutations_to_mrca(f.edges, f.closure, f.nodes, f.mutations)


@query(
    _FULL
    + _STATES
    + """, twos as (select x.c as child, x.p as lp, y.p as rp, x.r as bp from edges x join edges y on x.c = y.c and x.r = y.l),
pos as (select distinct child, position from twos join near on near.node in (child, lp, rp)),
st as (select pos.child, twos.bp, pos.position, coalesce(c.state, ancestral) as child_state, coalesce(l.state, ancestral) as left_state, coalesce(r.state, ancestral) as right_state
  from pos join twos using (child) join sites using (position) left join near c on c.node = child and c.position = pos.position left join near l on l.node = lp and l.position = pos.position left join near r on r.node = rp and r.position = pos.position)
select child, bp as breakpoint, position, child_state, left_state, right_state, case when position < bp then 'left' else 'right' end as copied from st where child_state <> left_state or child_state <> right_state or left_state <> right_state"""
)
def copying_table(f: Fixture) -> DataFrame:
    return matching.copying_table(f.edges, f.mutations, f.closure, f.sites)


# --- validation -------------------------------------------------------------------------------------------------------------------


def _calls(f: Fixture) -> DataFrame:
    """The raw states as letters of a store that differs from the graph here and there: other letters, deletions, ambiguous letters."""
    k = F.col("node") * 7 + F.col("position")
    other = F.translate("derived_state", "ACGT-", "CGTAA")
    letter = F.when(k % 11 == 0, other).when(k % 13 == 0, "-").when(k % 17 == 0, "N").otherwise(F.col("derived_state"))
    return f.raw.select("node", "position", letter.alias("letter"))


@query(
    _FULL
    + """, calls as (select derived, case when (node * 7 + position) % 11 = 0 then translate(derived, 'ACGT-', 'CGTAA') when (node * 7 + position) % 13 = 0 then '-' when (node * 7 + position) % 17 = 0 then 'N' else derived end as letter from raw)
select count(*) as compared, count(*) filter (letter <> 'N' and letter <> derived) as mismatches, count(*) filter (letter not in ('N', '-') and letter <> derived) as mismatches_without_deletions from calls"""
)
def validate_genotypes(f: Fixture) -> DataFrame:
    """The raw states at the branches of nodes are what the graph must carry there, whichever mutations were dropped as idle; the store has other letters at some."""
    states = matching.differing_states(f.nodes.select(F.col("node_id").alias("node")), f.mutations, f.closure, f.sites)
    calls = _calls(f)
    bad = store.genotype_mismatches(calls, states, f.sites).agg(F.count("*").alias("mismatches"))
    plain = store.genotype_mismatches(calls, states, f.sites, deletions_as_missing=True).agg(F.count("*").alias("mismatches_without_deletions"))
    return calls.agg(F.count("*").alias("compared")).join(F.broadcast(bad)).join(F.broadcast(plain))  # one row each


@query(
    f"""with m as ({_META % "n_name as country, c_mktsegment as segment"}), g as (select 'S' || c_custkey as sample_id, n_name as country, case when c_custkey % 7 = 0 then upper(c_mktsegment) || '?' else c_mktsegment end as segment from customer join nation on c_nationkey = n_nationkey)
select g.sample_id, 'segment' as field, g.segment as in_graph, m.segment as in_store from g join m using (sample_id) where g.segment <> m.segment"""
)
def validate_metadata(f: Fixture) -> DataFrame:
    """The graph's copy of the metadata differs on purpose for every seventh sample."""
    graph_side = f.samples.select("sample_id", "country", F.when(F.col("node_id") % 7 == 0, F.concat(F.upper("segment"), F.lit("?"))).otherwise(F.col("segment")).alias("segment"))
    return store.metadata_mismatches(graph_side, f.samples, ["country", "segment"])


@query(_WITH + "select cast(row_number() over (order by position) - 1 as bigint) as site_id, position, ancestral as ancestral_state from sites")
def site_ids(f: Fixture) -> DataFrame:
    return numbered(f.sites, "site_id", F.expr("position div 4096"), ["position"]).select("site_id", "position", "ancestral_state")
