"""Summaries of a graph for reports, one row per group, node, child or recombinant."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions import flags as fl
from strandlake.operators import graph
from strandlake.operators.matching import _two_parents, sample_groups

#: Length of the genome, its genes as [start, end), and a region of frequent deletions.
GENOME = 29903
GENES = (
    (266, 21556, "ORF1ab"), (21563, 25385, "S"), (25393, 26221, "ORF3a"), (26245, 26473, "E"), (26523, 27192, "M"), (27202, 27388, "ORF6"),
    (27394, 27760, "ORF7a"), (27756, 27888, "ORF7b"), (27894, 28260, "ORF8"), (28274, 29534, "N"), (29558, 29675, "ORF10"),
)
NTD = (21602, 22472)


def regions() -> list[tuple[int, int, str, str]]:
    """start, end, name, kind: genes, problematic regions (the NTD domain and ORF8), and the flanks before the first and after the last gene."""
    problematic = [(*NTD, "NTD"), *(g for g in GENES if g[2] == "ORF8")]
    flanks = [(1, min(g[0] for g in GENES), "5p"), (max(g[1] for g in GENES), GENOME + 1, "3p")]
    return [(*r, kind) for kind, rows in (("gene", GENES), ("problematic", problematic), ("flank", flanks)) for r in rows]


def in_regions(rows: DataFrame, position: str) -> DataFrame:
    """rows once for each region that covers the position, with name and kind. The regions are a fixed table of some rows."""
    table = rows.sparkSession.createDataFrame(regions(), "start bigint, end bigint, name string, kind string")
    return rows.join(F.broadcast(table), (F.col("start") <= F.col(position)) & (F.col(position) < F.col("end"))).drop("start", "end")


def properties(parts: list[DataFrame]) -> DataFrame:
    """parts: tables of one row each. property, value (double): a row for every column."""
    one = reduce(lambda a, b: a.join(F.broadcast(b)), parts)
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("property"), F.col(c).cast("double").alias("value")) for c in one.columns])))


def over_fraction_of_most(counts: DataFrame, column: str, fraction: float) -> DataFrame:
    """Rows whose count is at least a fraction of the largest one."""
    most = counts.agg(F.max(column).alias("most"))  # one row
    return counts.join(F.broadcast(most)).where(F.col(column) >= F.lit(fraction) * F.col("most")).drop("most")


def sample_groups_summary(matches: DataFrame, min_size: int, min_dates: int, retro_days: int) -> DataFrame:
    """group_id, parent, samples, dates, lineages, first_date, last_date, is_retro (inexact, and its last date within retro_days of the newest match)."""
    named = sample_groups(matches, min_size, min_dates)
    newest = matches.agg(F.max("match_date").alias("newest"))  # one row
    per = matches.groupBy("hmm_cost", "parent").agg(F.countDistinct("scorpio").alias("lineages"), F.min("match_date").alias("first_date"), F.max("match_date").alias("last_date"))
    # Samples without a parent are a group as well.
    per = per.withColumnsRenamed({"hmm_cost": "own_cost", "parent": "own_parent"})
    met = named.join(per, named["hmm_cost"].eqNullSafe(F.col("own_cost")) & named["parent"].eqNullSafe(F.col("own_parent"))).join(F.broadcast(newest))
    retro = (F.col("hmm_cost") > 0) & (F.col("last_date") > F.date_sub("newest", retro_days))
    return met.select("group_id", "parent", "samples", "dates", "lineages", "first_date", "last_date", retro.alias("is_retro"))


def _zero(name: str) -> Column:
    return F.coalesce(name, F.lit(0)).cast("bigint").alias(name)


def node_summary(nodes: DataFrame, edges: DataFrame, mutations: DataFrame, counts: DataFrame, matches: DataFrame) -> DataFrame:
    """Per node: edges above and below it, samples under it, its mutations and deletions, those of its children, exact matches."""
    most = graph.max_descendant_samples(counts).withColumnRenamed("max_descendant_samples", "descendants")
    own = mutations.groupBy(F.col("node").alias("node_id")).agg(F.count("*").alias("mutations"), F.count_if(F.col("derived_state") == "-").alias("deletions"))
    up = edges.groupBy(F.col("child").alias("node_id")).agg(F.count("*").alias("parents"))
    down = edges.groupBy(F.col("parent").alias("node_id")).agg(F.count("*").alias("children"))
    kids = edges.select(F.col("parent"), F.col("child").alias("node_id")).distinct().join(own, "node_id").groupBy(F.col("parent").alias("node_id")).agg(F.sum("mutations").alias("child_mutations"))
    exact = matches.where("hmm_cost = 0").groupBy(F.col("parent").alias("node_id")).agg(F.count("*").alias("exact_matches"))
    full = reduce(lambda a, b: a.join(b, "node_id", "left"), [up, down, most, own, kids, exact], nodes.select("node_id", "sample_id"))
    return full.select("node_id", "sample_id", *map(_zero, ("parents", "children", "descendants", "mutations", "deletions", "child_mutations", "exact_matches")))


def children_summary(nodes: DataFrame, edges: DataFrame, mutations: DataFrame) -> DataFrame:
    """Per parent and child: the child's mutations, those at sites where the parent has one too, those that undo it, the branch's length."""
    kids = edges.select("parent", "child").distinct()
    state = lambda s: mutations.select(F.col("node").alias(s), "position", F.col("inherited_state").alias(f"{s}_from"), F.col("derived_state").alias(f"{s}_to"))
    both = kids.join(state("parent"), "parent").join(state("child"), ["child", "position"])
    undone = (F.col("parent_from") == F.col("child_to")) & (F.col("parent_to") == F.col("child_from"))
    same = both.groupBy("parent", "child").agg(F.count("*").alias("same_site_muts"), F.count_if(undone).alias("reversions"))
    own = mutations.groupBy(F.col("node").alias("child")).agg(F.count("*").alias("new_muts"))
    time = nodes.select("node_id", "time")
    full = kids.join(time.toDF("parent", "old"), "parent").join(time.toDF("child", "young"), "child").join(own, "child", "left").join(same, ["parent", "child"], "left")
    return full.select("parent", "child", *map(_zero, ("new_muts", "same_site_muts", "reversions")), (F.col("old") - F.col("young")).alias("branch_length"))


def mutation_paths(asked: DataFrame, mutations: DataFrame, reach: DataFrame) -> DataFrame:
    """asked: node. node, depth, at_node, position, label of every mutation at or above it, where its path covers the position."""
    nodes = asked.distinct()
    label = F.concat("inherited_state", F.col("position").cast("string"), "derived_state").alias("label")
    own = nodes.join(mutations, "node").select("node", F.lit(0).alias("depth"), F.col("node").alias("at_node"), "position", label)
    above = reach.join(nodes, "node").join(mutations.withColumnRenamed("node", "at_node"), F.col("ancestor") == F.col("at_node")).where("left <= position and position < right")
    return own.unionByName(above.select("node", "depth", "at_node", "position", label))


def recombinants_summary(nodes: DataFrame, edges: DataFrame, reach: DataFrame, counts: DataFrame, time_zero: str) -> DataFrame:
    """Per breakpoint of a recombinant: its parents, their youngest common ancestor (left path in the tree before the breakpoint, right path in the one after), its oldest child, samples below, and dates."""
    marked = nodes.where(fl.has(F.col("flags"), fl.RECOMBINANT)).select(F.col("node_id").alias("child"))
    two = _two_parents(edges).join(marked, "child")
    time = nodes.select(F.col("node_id").alias("node"), "time")

    def path(side: str, at: Column) -> DataFrame:
        asked = two.select("child", "breakpoint", F.col(f"{side}_parent").alias("node"), at.alias("at"))
        return asked.select("child", "breakpoint", "node").unionByName(asked.join(reach, "node").where("left <= at and at < right").select("child", "breakpoint", F.col("ancestor").alias("node")))

    met = path("left", F.col("breakpoint") - 1).join(path("right", F.col("breakpoint")), ["child", "breakpoint", "node"]).join(time, "node")
    top = met.groupBy("child", "breakpoint").agg(F.min_by("node", "time").alias("parent_mrca"))
    kids = edges.select(F.col("parent").alias("child"), F.col("child").alias("node")).join(time, "node").groupBy("child").agg(F.max_by("node", "time").alias("oldest_child"))
    most = graph.max_descendant_samples(counts).toDF("child", "num_descendant_samples")
    full = two.join(top, ["child", "breakpoint"], "left").join(kids, "child", "left").join(most, "child", "left")
    full = full.select(F.col("child").alias("recombinant"), F.col("breakpoint").alias("interval_right"), F.col("left_parent").alias("parent_left"), F.col("right_parent").alias("parent_right"), "parent_mrca", "oldest_child", F.coalesce("num_descendant_samples", F.lit(0)).cast("bigint").alias("num_descendant_samples"))
    date = nodes.select("node_id", F.date_sub(F.lit(time_zero).cast("date"), F.col("time").cast("int")).alias("date"))
    for role in ("recombinant", "parent_left", "parent_right", "parent_mrca"):
        full = full.join(date.toDF(role, f"{role}_date"), role, "left")
    return full


def group_metrics(edges: DataFrame, mutations: DataFrame, length: int) -> DataFrame:
    """Per node with full-span children, as the root of a group tree: children, their mutations, recurrent ones, per child, and the root's own."""
    full = edges.where((F.col("left") == 0) & (F.col("right") == length)).select(F.col("parent").alias("root"), F.col("child").alias("node"))
    per = mutations.groupBy("node").agg(F.count("*").alias("c"), F.count_if(F.col("parent") >= 0).alias("r"))
    summed = full.join(per, "node", "left").groupBy("root").agg(F.count("*").alias("samples"), F.coalesce(F.sum("c"), F.lit(0)).alias("mutations"), F.coalesce(F.sum("r"), F.lit(0)).alias("recurrent"))
    own = per.select(F.col("node").alias("root"), F.col("c").alias("root_mutations"))
    return summed.join(own, "root", "left").select("root", "samples", "mutations", "recurrent", F.round(F.col("mutations") / F.col("samples"), 6).alias("mutations_per_sample"), _zero("root_mutations"))
