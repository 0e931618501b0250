"""Haplotypes of nodes, recombination breakpoints, and the store of matches."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import flags as fl
from strandlake.operators.ordering import numbered


def differing_states(asked: DataFrame, mutations: DataFrame, reach: DataFrame, sites: DataFrame) -> DataFrame:
    """asked: node. node, position, state where the node's state differs from the site's: the nearest mutation at or above it decides.

    Only these rows are kept, so a node costs as many rows as it has differences, not as many as there are sites.
    """
    nodes = asked.distinct()
    own = mutations.join(nodes, "node").select("node", "position", F.lit(0).alias("depth"), "mutation_id", "derived_state")
    above = reach.join(nodes, "node").join(mutations.select(F.col("node").alias("ancestor"), "position", "mutation_id", "derived_state"), "ancestor").where("left <= position and position < right")
    # Of several on one branch the youngest counts: ids run from the oldest on.
    nearest = own.unionByName(above.select(*own.columns)).groupBy("node", "position").agg(F.min_by("derived_state", F.struct("depth", -F.col("mutation_id"))).alias("state"))
    return nearest.join(sites, "position").where("state <> ancestral_state").select("node", "position", "state")


def breakpoint_intervals(edges: DataFrame, mutations: DataFrame, reach: DataFrame, sites: DataFrame) -> DataFrame:
    """Per breakpoint of a recombinant: its parents, at how many sites they differ, and where the interval of the switch begins."""
    right = edges.select("child", F.col("left").alias("breakpoint"), F.col("parent").alias("right_parent"))
    two = edges.select("child", F.col("right").alias("breakpoint"), F.col("parent").alias("left_parent")).join(right, ["child", "breakpoint"])
    asked = two.select(F.explode(F.array("left_parent", "right_parent")).alias("node"))
    states = differing_states(asked, mutations, reach, sites)
    side = lambda name, other: two.join(states.select(F.col("node").alias(name), "position", F.col("state").alias("state")), name).select("child", "breakpoint", "position", F.lit(other).alias("side"), "state")
    both = side("left_parent", 0).unionByName(side("right_parent", 1)).groupBy("child", "breakpoint", "position").agg(F.count("*").alias("sides"), F.countDistinct("state").alias("states"))
    differ = both.where("sides = 1 or states = 2")
    summed = differ.groupBy("child", "breakpoint").agg(F.count("*").alias("differing"), F.max(F.when(F.col("position") < F.col("breakpoint"), F.col("position") + 1)).alias("interval_left"))
    return two.join(summed, ["child", "breakpoint"], "left").select("child", "left_parent", "right_parent", "breakpoint", F.coalesce("differing", F.lit(0)).alias("differing"), F.coalesce("interval_left", F.lit(0)).alias("interval_left"))


def unused(matches: DataFrame, nodes: DataFrame) -> DataFrame:
    """Matches of samples that the graph does not hold yet."""
    held = nodes.where(fl.has(F.col("flags"), fl.SAMPLE)).select("sample_id")
    return matches.join(held, "sample_id", "left_anti")


def retro_window(matches: DataFrame, days: int, cost: float) -> DataFrame:
    """Matches before the last date and after its window's first day, of a cost above 0 and at most `cost`."""
    last = F.broadcast(matches.agg(F.max("match_date").alias("last")))
    recent = matches.join(last).where((F.col("match_date") > F.date_sub("last", days)) & (F.col("match_date") < F.col("last")))
    return recent.where((F.col("hmm_cost") > 0) & (F.col("hmm_cost") <= cost)).drop("last")


def sample_groups(matches: DataFrame, min_size: int, min_dates: int) -> DataFrame:
    """Groups of samples with the same match: md5 of the concatenated sorted ids, parent, samples, distinct dates, cost.

    Samples pass in order, so of a group only the running md5, a count and its dates are held.
    """
    ordered = matches.select((F.col("hmm_cost") + F.lit(0.0)).alias("hmm_cost"), "parent", "sample_id", "match_date")
    ordered = ordered.repartition("hmm_cost", "parent").sortWithinPartitions("hmm_cost", "parent", "sample_id")
    kind = matches.schema["parent"].dataType.simpleString()

    def stream(batches):
        key, md5, samples, dates, kept, of = None, None, 0, set(), [], None

        def end():
            if key is not None and samples >= min_size and len(dates) >= min_dates:
                kept.append((md5.hexdigest(), key[1], samples, len(dates), None if key[0] == "None" else float(key[0])))

        def out():
            columns = list(zip(*kept, strict=True))
            kept.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), of, pa.int64(), pa.int64(), pa.float64()], strict=True)], ["group_id", "parent", "samples", "dates", "hmm_cost"])

        for b in batches:
            of = b.schema.field("parent").type
            for cost, parent, sample, date in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != (str(cost), parent):
                    end()
                    key, md5, samples, dates = (str(cost), parent), hashlib.md5(), 0, set()
                samples += 1
                if sample is not None:
                    md5.update(sample.encode())
                if date is not None:
                    dates.add(date)
            if kept:
                yield out()
        end()
        if kept:
            yield out()

    return ordered.mapInArrow(stream, f"group_id string, parent {kind}, samples bigint, dates bigint, hmm_cost double")


def daily_stats(matches: DataFrame, threshold: float = 5.0) -> DataFrame:
    cost = F.col("hmm_cost")
    return matches.groupBy(F.col("match_date").alias("date"), "scorpio").agg(
        F.count("*").alias("total"), F.count_if(cost == 0).alias("exact"), F.count_if(cost > threshold).alias("rejected"), F.sum(cost).alias("sum_cost"), F.round(F.avg(cost), 2).alias("mean_cost"), F.percentile(cost, F.lit(0.5)).alias("median_cost")
    )


def sampled_per_day(matches: DataFrame, count: int, seed: int) -> DataFrame:
    """At most `count` matches of each day, without replacement, in the order of a seeded hash: the same on every run."""
    order = Window.partitionBy("match_date").orderBy(F.md5(F.concat(F.lit(str(seed)), F.col("match_date").cast("string"), "sample_id")), "sample_id")
    return matches.withColumn("place", F.row_number().over(order)).where(F.col("place") <= count).drop("place")


def exact_match_nodes(matches: DataFrame, nodes: DataFrame, until: str | None = None) -> DataFrame:
    """Nodes to add for matches of cost 0 up to a date (default: all): the next free node_id by date and sample, time in days before that date, parent."""
    exact = matches.where("hmm_cost = 0")
    if until is not None:
        exact = exact.where(F.col("match_date") <= F.lit(until).cast("date"))
    zero = F.lit(until).cast("date") if until is not None else F.lit(matches.agg(F.max("match_date")).first()[0])
    free = nodes.agg(F.max("node_id")).first()[0] + 1  # one number
    placed = numbered(exact, "node_id", F.unix_date("match_date"), ["match_date", "sample_id"])
    return placed.select((F.col("node_id") + free).alias("node_id"), "sample_id", F.date_diff(zero, F.col("match_date")).cast("double").alias("time"), "parent")


def minimised(nodes: DataFrame, fields: dict[str, str]) -> DataFrame:
    """node_id, flags, time and of the metadata only the named fields under their new names; missing values are empty."""
    return nodes.select("node_id", *[F.coalesce(F.col(old).cast("string"), F.lit("")).alias(new) for old, new in fields.items()], "flags", "time")


def characterised(found: DataFrame, mutations: DataFrame, reach: DataFrame) -> DataFrame:
    """found: match, position, node (the parent that the match copies there), derived_state. Adds is_reversion and is_immediate_reversion.

    The closest mutation at or above the parent decides: its inherited state is the match's derived one (a reversion), and it sits on
    the parent itself (an immediate one). Of several on one branch the youngest counts.
    """
    last = mutations.groupBy("position", "node").agg(F.max_by(F.struct("node", "inherited_state"), "mutation_id").alias("value"))
    asked = found.select("position", "node").distinct()
    own = asked.select("position", "node", F.col("node").alias("ancestor"), F.lit(0).alias("depth"))
    up = own.unionByName(asked.join(reach, "node").where("left <= position and position < right").select("position", "node", "ancestor", "depth"))
    near = up.join(last.select("position", F.col("node").alias("ancestor"), "value"), ["position", "ancestor"]).groupBy("position", "node").agg(F.min_by("value", "depth").alias("closest"))
    back = F.coalesce(F.col("closest.inherited_state") == F.col("derived_state"), F.lit(False))
    met = found.join(near, ["position", "node"], "left").withColumn("is_reversion", back)
    return met.select("match", "position", "node", "derived_state", "is_reversion", (F.col("is_reversion") & F.coalesce(F.col("closest.node") == F.col("node"), F.lit(False))).alias("is_immediate_reversion"))


def costs(segments: DataFrame, mutations: DataFrame, mismatches: int) -> DataFrame:
    """segments, mutations: sample_id, a row each. sample_id, cost: mismatches for each switch of parents and one for each mutation."""
    switched = segments.groupBy("sample_id").agg((F.count("*") - 1).alias("switches"))
    changed = mutations.groupBy("sample_id").agg(F.count("*").alias("mutations"))
    return switched.join(changed, "sample_id", "left").select("sample_id", (F.col("switches") * mismatches + F.coalesce("mutations", F.lit(0))).alias("cost"))


def mirrored_paths(paths: DataFrame, length: int) -> DataFrame:
    """paths: child, left, right, parent. Coordinates from the other end, and the segments' numbers from the left in them."""
    turned = paths.select("child", (F.lit(length) - F.col("right")).alias("left"), (F.lit(length) - F.col("left")).alias("right"), "parent")
    return turned.withColumn("segment", F.row_number().over(Window.partitionBy("child").orderBy("left")).cast("bigint"))


def _two_parents(edges: DataFrame) -> DataFrame:
    right = edges.select("child", F.col("left").alias("breakpoint"), F.col("parent").alias("right_parent"))
    return edges.select("child", F.col("right").alias("breakpoint"), F.col("parent").alias("left_parent")).join(right, ["child", "breakpoint"])


def mutations_to_mrca(edges: DataFrame, reach: DataFrame, nodes: DataFrame, mutations: DataFrame) -> DataFrame:
    """Per breakpoint of a recombinant and node on either path from its parents up to, not including, their youngest common ancestor: child, side, node, mutations, sites.

    The left path runs in the tree that ends at the breakpoint, the right one in the tree that begins there.
    """
    two = _two_parents(edges)

    def path(side: str, at: Column) -> DataFrame:
        asked = two.select("child", "breakpoint", F.col(f"{side}_parent").alias("node"), at.alias("at"))
        above = asked.join(reach, "node").where("left <= at and at < right").select("child", "breakpoint", F.col("ancestor").alias("node"))
        return asked.select("child", "breakpoint", "node").unionByName(above)

    time = nodes.select(F.col("node_id").alias("node"), "time")
    left, right = path("left", F.col("breakpoint") - 1).join(time, "node"), path("right", F.col("breakpoint")).join(time, "node")
    top = left.join(right.select("child", "breakpoint", "node"), ["child", "breakpoint", "node"]).groupBy("child", "breakpoint").agg(F.min("time").alias("top"))
    below = left.withColumn("side", F.lit("left")).unionByName(right.withColumn("side", F.lit("right"))).join(top, ["child", "breakpoint"]).where("time < top")
    counts = mutations.groupBy("node").agg(F.count("*").alias("mutations"), F.countDistinct("position").alias("sites"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return below.join(counts, "node", "left").select("child", "side", "node", zero("mutations"), zero("sites"))


def copying_table(edges: DataFrame, mutations: DataFrame, reach: DataFrame, sites: DataFrame) -> DataFrame:
    """Per breakpoint of a recombinant and site at which it and its two parents are not all alike: the three states, and which side it copies there."""
    two = _two_parents(edges)
    asked = two.select(F.explode(F.array("child", "left_parent", "right_parent")).alias("node"))
    states = differing_states(asked, mutations, reach, sites)
    roles = two.select("child", "breakpoint", F.explode(F.array(*[F.struct(F.lit(role).alias("role"), F.col(c).alias("node")) for role, c in (("child", "child"), ("left", "left_parent"), ("right", "right_parent"))])).alias("r"))
    met = roles.select("child", "breakpoint", "r.role", "r.node").join(states, "node")
    state = lambda role: F.max(F.when(F.col("role") == role, F.col("state"))).alias(role)
    wide = met.groupBy("child", "breakpoint", "position").agg(state("child").alias("c"), state("left").alias("l"), state("right").alias("r")).join(sites, "position")
    full = wide.select("child", "breakpoint", "position", *[F.coalesce(c, "ancestral_state").alias(name) for c, name in (("c", "child_state"), ("l", "left_state"), ("r", "right_state"))])
    return full.where("child_state <> left_state or child_state <> right_state or left_state <> right_state").withColumn("copied", F.when(F.col("position") < F.col("breakpoint"), "left").otherwise("right"))


def segment_at(points: DataFrame, segments: DataFrame, by: list[str]) -> DataFrame:
    """points: by, position. segments: by, left, right, parent; those of one key don't overlap. points with the parent of the segment that covers each (null: none).

    An as-of join: points and starts of segments are sorted together, and the last start before a point is carried to it.
    """
    starts = segments.select(*by, F.col("left").alias("position"), F.struct("right", "parent").alias("start"), F.lit(0).alias("kind"))
    both = points.withColumn("start", F.lit(None).cast(starts.schema["start"].dataType)).withColumn("kind", F.lit(1)).unionByName(starts, allowMissingColumns=True)
    carried = F.last("start", ignorenulls=True).over(Window.partitionBy(*by).orderBy("position", "kind"))
    met = both.withColumn("start", carried).where("kind = 1")
    return met.select(*points.columns, F.when(F.col("position") < F.col("start.right"), F.col("start.parent")).alias("parent"))


def translated_paths(paths: DataFrame, coordinates: DataFrame, mirror: bool = False) -> DataFrame:
    """paths: by columns of any name, left, right (numbers of sites), parent. The same in positions: a piecewise map.

    coordinates: index, position of every site, and of the index after the last site the sequence's length. The first site's segment begins at
    position 0. mirror: the paths and coordinates run from the other end, and positions are turned back. An index outside the map is an error.
    """
    known = coordinates.select("index", "position")
    at = lambda name: known.select(F.col("index").alias(name), F.when(F.col(name) == 0, 0).otherwise(F.col("position")).cast("bigint").alias(f"{name}_at"))
    met = paths.join(at("left"), "left", "left").join(at("right"), "right", "left")
    inside = lambda c: F.coalesce(c, F.raise_error(F.lit("a path beyond the coordinates")).cast("bigint"))
    left, right = inside(F.col("left_at")), inside(F.col("right_at"))
    if mirror:
        length = F.broadcast(known.agg(F.max("position").alias("length")))  # one row
        met, left, right = met.join(length), F.col("length") - right, F.col("length") - left
    return met.select(*[left.alias("left") if c == "left" else right.alias("right") if c == "right" else F.col(c) for c in paths.columns])


def samples_kept(samples: DataFrame, most: int, include: DataFrame | None = None) -> DataFrame:
    """samples: sample_id, missing (sites) and more. Those with at most so many missing sites, and those of `include` (sample_id) whatever they
    miss; included tells the latter. A null count is too many."""
    asked = samples.join(include.select("sample_id").distinct().withColumn("included", F.lit(True)), "sample_id", "left") if include is not None else samples.withColumn("included", F.lit(False))
    return asked.withColumn("included", F.coalesce("included", F.lit(False))).where(F.col("included") | (F.col("missing") <= most))


def group_members(matches: DataFrame, min_size: int, min_dates: int) -> DataFrame:
    """group_id, sample_id, match_date: the samples of the groups that sample_groups() finds; a sample of null id is left out."""
    groups = sample_groups(matches, min_size, min_dates).select("group_id", F.col("hmm_cost").alias("own_cost"), F.col("parent").alias("own_parent"))
    same = (F.col("hmm_cost") + F.lit(0.0)).eqNullSafe(F.col("own_cost")) & F.col("parent").eqNullSafe(F.col("own_parent"))
    return matches.where("sample_id is not null").join(groups, same).select("group_id", "sample_id", "match_date")


def recombinant_samples(nodes: DataFrame, tops: DataFrame, members: DataFrame) -> DataFrame:
    """node_id, sample_id: the samples that a recombinant node was made for. tops: group, node_id (the node below a group's path); members: group, sample_id."""
    marked = nodes.where(fl.has(F.col("flags"), fl.RECOMBINANT)).select("node_id")
    return tops.join(marked, "node_id", "left_semi").join(members, "group").select("node_id", "sample_id")
