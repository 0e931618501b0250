"""Mutations of a graph: inherited states and parents, inheritance counts, reversions.

Mutations are (position, node, derived_state); where a branch has several at one position, time orders them (the oldest first).
reach is what graph.closure() gives: ancestors of a node along intervals of positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators.ordering import numbered
from strandlake.plans.lineage import cut, drop

#: Positions whose mutations are numbered together; 64-bit words of the marks by which an ancestor's positions are told.
NUMBERED, WORDS = 64, 8


def _bit() -> Column:
    """The bit of a position, whatever its type."""
    return F.pmod(F.xxhash64(F.col("position").cast("bigint")), F.lit(64 * WORDS)).cast("int")


def _marks(others: DataFrame) -> DataFrame:
    """others: position, node. ancestor, marks: the bits of the positions of each node, in words of fixed number."""
    # Dealt by node first, so that a row of marks is made once for a node and not in every task.
    dealt = others.select(F.col("node").alias("ancestor"), _bit().alias("bit")).repartition("ancestor")
    word = lambda w: F.bit_or(F.when(F.expr(f"bit div 64 = {w}"), F.expr("shiftleft(1L, bit % 64)")).otherwise(F.lit(0).cast("bigint")))
    return dealt.groupBy("ancestor").agg(F.array(*[word(w) for w in range(WORDS)]).alias("marks"))


def _nearest(rows: DataFrame, reach: DataFrame, others: DataFrame) -> DataFrame:
    """rows: position, node. Of others (position, node, value) at the same position, the value on the nearest proper ancestor, and that ancestor (above).

    Each row fetches its ancestors, and those meet the others by position and node: mutations of one position never meet each other.
    """
    met = _fetched(rows, reach, others).join(others.select("position", F.col("node").alias("ancestor"), "value"), ["position", "ancestor"])
    best = met.groupBy("position", "node").agg(F.min_by(F.struct("value", "ancestor"), "depth").alias("best"))
    return best.select("position", "node", F.col("best.value").alias("value"), F.col("best.ancestor").alias("above"))


def _fetched(rows: DataFrame, reach: DataFrame, others: DataFrame) -> DataFrame:
    """position, node, ancestor, depth: ancestors of rows whose marks have the row's position. So most without one of others there never travel."""
    marked = reach.select("node", "ancestor", "left", "right", "depth").join(_marks(others), "ancestor")
    asked = rows.select("position", "node").withColumn("bit", _bit())
    return asked.join(marked, "node").where("left <= position and position < right and getbit(marks[bit div 64], bit % 64) = 1").select("position", "node", "ancestor", "depth")


def _parents(named: DataFrame, near: DataFrame) -> DataFrame:
    """position, node, value: the last of named on the nearest proper ancestor that has one. near: position, node, above, the nearest of all mutations.

    Those above that name nothing hand on their own, by pointer doubling.
    """
    above = near.select("position", F.col("above").alias("node")).distinct()
    last = cut(named.join(above, ["position", "node"], "left_semi").groupBy("position", "node").agg(F.max("mutation_id").alias("value")), "last")
    idle = near.select("position", "node", "above").join(above, ["position", "node"], "left_semi").join(last, ["position", "node"], "left_anti")
    jump = cut(idle, "jump")
    far = lambda: jump.select("position", F.col("node").alias("above"), F.col("above").alias("far"))
    while not jump.join(far(), ["position", "above"], "left_semi").isEmpty():
        new = cut(jump.join(far(), ["position", "above"], "left").select("position", "node", F.coalesce("far", "above").alias("above")), "jump")
        drop(jump)
        jump = new
    met = near.select("position", "node", "above").join(far(), ["position", "above"], "left").select("position", "node", F.coalesce("far", "above").alias("above"))
    return met.join(last.withColumnRenamed("node", "above"), ["position", "above"]).select("position", "node", "value")


def resolved(raw: DataFrame, sites: DataFrame, reach: DataFrame) -> DataFrame:
    """raw: position, node, derived_state and, if nodes have several at a position, time. Returns mutation_id, position, node, parent, states (and time).

    The inherited state is that of the mutation before on the same branch, else of the youngest on the nearest ancestor that has one,
    else the site's. Mutations that change nothing are dropped; parent is the nearest one that is left (-1: none). Ids run by position,
    then node, then from the oldest on.
    """
    timed = "time" in raw.columns
    along = Window.partitionBy("position", "node").orderBy(*([F.desc("time")] if timed else ["derived_state"]))
    more = ["time"] if timed else []
    raw = cut(raw.select("position", "node", "derived_state", *more), "raw")
    placed = raw.withColumns({"own": F.lag("derived_state").over(along) if timed else F.lit(None).cast("string")})
    youngest = lambda value: F.min_by(value, "time") if timed else F.any_value(value)
    last = raw.groupBy("position", "node").agg(youngest("derived_state").alias("value"))
    near = cut(_nearest(raw, reach, last), "near")
    stated = placed.join(near.select("position", "node", "value"), ["position", "node"], "left").join(sites.select("position", "ancestral_state"), "position")
    stated = stated.withColumn("inherited_state", F.coalesce("own", "value", "ancestral_state")).drop("own", "value", "ancestral_state").where("inherited_state <> derived_state")
    named = cut(numbered(stated, "mutation_id", F.expr(f"position div {NUMBERED}"), ["position", "node", *([F.desc("time")] if timed else [])]), "named")
    drop(raw)
    before = F.lag("mutation_id").over(Window.partitionBy("position", "node").orderBy("mutation_id")) if timed else F.lit(None).cast("bigint")
    parent = named.withColumn("before", before).join(_parents(named, near), ["position", "node"], "left")
    return parent.select("mutation_id", "position", "node", F.coalesce("before", "value", F.lit(-1)).cast("bigint").alias("parent"), "inherited_state", "derived_state", *more)


def with_parent(mutations: DataFrame) -> DataFrame:
    """Adds the parent mutation's node and states (null without one)."""
    up = mutations.select(F.col("mutation_id").alias("parent"), F.col("node").alias("parent_mutation_node"), F.col("inherited_state").alias("parent_inherited_state"), F.col("derived_state").alias("parent_derived_state"))
    return mutations.join(up, "parent", "left")


def parsimony(mutations: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds node_parent, the parent's columns (-1 and N without one), is_reversion and is_immediate_reversion."""
    over = mutations.select("mutation_id", "node", "position").join(edges.select(F.col("child").alias("node"), F.col("parent").alias("node_parent"), "left", "right"), "node")
    over = over.where("left <= position and position < right").select("mutation_id", "node_parent")
    full = with_parent(mutations.join(over, "mutation_id", "left"))
    filled = {"node_parent": -1, "parent_mutation_node": -1, "parent_inherited_state": "N", "parent_derived_state": "N"}
    full = full.withColumns({c: F.coalesce(c, F.lit(v).cast("bigint") if v == -1 else F.lit(v)) for c, v in filled.items()})
    reversion = F.col("parent_inherited_state") == F.col("derived_state")
    return full.withColumn("is_reversion", reversion).withColumn("is_immediate_reversion", reversion & (F.col("parent_mutation_node") == F.col("node_parent")))


def inheritance(mutations: DataFrame, counts: DataFrame) -> DataFrame:
    """counts: node, left, right, samples. Adds num_descendants (samples at or below) and num_inheritors (without those of child mutations)."""
    found = mutations.select("mutation_id", "node", "position").join(counts, "node").where("left <= position and position < right").select("mutation_id", "samples")
    below = mutations.join(found, "mutation_id", "left").withColumn("num_descendants", F.coalesce("samples", F.lit(0))).drop("samples")
    lost = below.where("parent >= 0").groupBy(F.col("parent").alias("mutation_id")).agg(F.sum("num_descendants").alias("lost"))
    return below.join(lost, "mutation_id", "left").withColumn("num_inheritors", F.col("num_descendants") - F.coalesce("lost", F.lit(0))).drop("lost")


def num_parents(mutations: DataFrame) -> DataFrame:
    """mutation_id, num_parents: the length of the chain of parents, by pointer doubling; rounds grow with the logarithm of the longest chain."""
    state = cut(mutations.select("mutation_id", F.expr("nullif(parent, -1)").alias("up"), F.expr("cast(parent >= 0 as bigint)").alias("n")), "chains")
    while not state.where("up is not null").isEmpty():
        above = state.select(F.col("mutation_id").alias("up"), F.col("up").alias("next"), F.col("n").alias("more"))
        grown = state.where("up is not null").join(above, "up").select("mutation_id", F.col("next").alias("up"), (F.col("n") + F.col("more")).alias("n"))
        new = cut(state.where("up is null").unionByName(grown), "chains")
        drop(state)
        state = new
    return state.select("mutation_id", F.col("n").alias("num_parents"))


def root_path_counts(mutations: DataFrame, reach: DataFrame) -> DataFrame:
    """node_id, num_mutations_on_path: mutations at or above each node, over all positions.

    An ancestor's mutations within an interval are the difference of two of its running counts, so mutations are never copied to
    the nodes below them.
    """
    ends = reach.select(F.col("ancestor").alias("node"), F.explode(F.array("left", "right")).alias("position")).distinct()
    here = mutations.groupBy("node", "position").agg(F.count("*").alias("n"))
    events = here.select("node", "position", "n", F.lit(1).alias("kind")).unionByName(ends.select("node", "position", F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("kind")))
    running = F.sum("n").over(Window.partitionBy("node").orderBy("position", "kind"))
    upto = events.withColumn("upto", running).where("kind = 0").select(F.col("node").alias("ancestor"), "position", "upto")
    inside = reach.join(upto.toDF("ancestor", "left", "low"), ["ancestor", "left"]).join(upto.toDF("ancestor", "right", "high"), ["ancestor", "right"])
    above = inside.groupBy(F.col("node").alias("node_id")).agg(F.sum(F.col("high") - F.col("low")).alias("n"))
    own = here.groupBy(F.col("node").alias("node_id")).agg(F.sum("n").alias("n"))
    return own.unionByName(above).groupBy("node_id").agg(F.sum("n").alias("num_mutations_on_path")).where("num_mutations_on_path > 0")


def sibling_shared(mutations: DataFrame, edges: DataFrame, length: int) -> DataFrame:
    """position, inherited_state, derived_state, node_parent, n: mutations that several full-span children of a node share."""
    full = edges.where((F.col("left") == 0) & (F.col("right") == length)).select(F.col("child").alias("node"), F.col("parent").alias("node_parent"))
    return mutations.join(full, "node").groupBy("node_parent", "position", "inherited_state", "derived_state").agg(F.count("*").alias("n")).where("n > 1")


def runs(rows: DataFrame, by: list[str], at: str) -> DataFrame:
    """Runs of consecutive values of `at` within `by`: start, end (inclusive), length."""
    order = Window.partitionBy(*by).orderBy(at)
    island = rows.select(*by, at).distinct().withColumn("island", F.col(at) - F.row_number().over(order))
    return island.groupBy(*by, "island").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("length")).drop("island")


def covered(events: DataFrame) -> DataFrame:
    """events: start, end. position, overlaps: events over each covered position."""
    return events.select(F.explode(F.sequence("start", "end")).alias("position")).groupBy("position").agg(F.count("*").alias("overlaps"))
