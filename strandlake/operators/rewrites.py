"""Parsimony rewrites of a graph as table operations: each returns new tables and leaves what nodes carry unchanged.

nodes: node_id, flags, time. edges: left, right, parent, child. mutations: mutation_id, position, node, parent, inherited_state,
derived_state. New nodes get the next free ids, in the order of the node they are made for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import flags as fl
from strandlake.operators.graph import squashed
from strandlake.operators.ordering import numbered
from strandlake.plans.lineage import cut, drop

#: Node ids that are numbered together.
NUMBERED = 4096


def _full(edges: DataFrame, length: int) -> DataFrame:
    return edges.where((F.col("left") == 0) & (F.col("right") == length))


def _numbered(rows: DataFrame, nodes: DataFrame, by: str) -> DataFrame:
    """rows with new_node: the next free node ids in the order of `by`. The largest id is one number."""
    free = nodes.agg(F.max("node_id")).first()[0] + 1
    return numbered(rows, "new_node", F.expr(f"`{by}` div {NUMBERED}"), [by]).withColumn("new_node", F.col("new_node") + free)


def _followed(mutations: DataFrame, replaced: DataFrame) -> DataFrame:
    """mutations whose parent was taken away (replaced: gone, target) get the target as parent; targets that are gone themselves are followed.

    Rounds grow with the logarithm of the longest chain of replaced mutations.
    """
    jump = cut(replaced.select("gone", "target"), "replaced")
    while not (far := jump.join(jump.select(F.col("gone").alias("target")), "target", "left_semi")).isEmpty():
        further = far.join(jump.select(F.col("gone").alias("target"), F.col("target").alias("next")), "target").select("gone", F.col("next").alias("target"))
        new = cut(jump.join(jump.select(F.col("gone").alias("target")), "target", "left_anti").select("gone", "target").unionByName(further), "replaced")
        drop(jump)
        jump = new
    met = mutations.join(jump.select(F.col("gone").alias("parent"), "target"), "parent", "left")
    return met.withColumn("parent", F.coalesce("target", "parent")).select(*mutations.columns)


def unary_recombinant_pushed(nodes: DataFrame, edges: DataFrame, mutations: DataFrame, length: int) -> DataFrame:
    """mutations in which those on the only full-span child of a recombinant sit on the recombinant itself."""
    marked = nodes.where(fl.has(F.col("flags"), fl.RECOMBINANT)).select(F.col("node_id").alias("parent_node"))
    alone = _full(edges, length).join(marked, F.col("parent") == F.col("parent_node")).groupBy("parent").agg(F.count("*").alias("n"), F.min("child").alias("node")).where("n = 1")
    moved = mutations.join(alone.select("node", F.col("parent").alias("target")), "node", "left").withColumn("node", F.coalesce("target", "node"))
    return moved.select(*mutations.columns)


def branches_split(nodes: DataFrame, edges: DataFrame, mutations: DataFrame, moved: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """moved: mutation_id. Above each node of these mutations a new one, halfway to its nearest parent in time, takes them over.

    A node without parent is an error of the caller: it gets no new node, and its mutations stay.
    """
    chosen = mutations.join(moved.select("mutation_id").distinct(), "mutation_id", "left_semi").select("mutation_id", F.col("node").alias("child"))
    time = nodes.select("node_id", "time")
    up = edges.join(chosen.select("child").distinct(), "child").join(time.toDF("parent", "above"), "parent").groupBy("child").agg(F.min("above").alias("above"))
    made = cut(_numbered(up.join(time.toDF("child", "below"), "child"), nodes, "child").select("child", "new_node", (F.col("below") + (F.col("above") - F.col("below")) / 2).alias("time")), "split")
    of = edges.join(made.select("child", "new_node"), "child", "left")
    lower = of.where("new_node is not null").select("left", "right", F.col("new_node").alias("parent"), "child")
    upper = of.select("left", "right", "parent", F.coalesce("new_node", "child").alias("child"))
    again = mutations.join(chosen.join(made.select("child", "new_node"), "child").select("mutation_id", "new_node"), "mutation_id", "left")
    again = again.withColumn("node", F.coalesce("new_node", "node")).select(*mutations.columns)
    more = made.select(F.col("new_node").alias("node_id"), F.lit(0).alias("flags"), "time")
    return nodes.select("node_id", "flags", "time").unionByName(more), squashed(upper.unionByName(lower)), again


def _independent(groups: DataFrame) -> DataFrame:
    """groups: child, parent; two are neighbours if one's parent is the other's child. Every other one of each chain, from its lowest on.

    Places in a chain come by pointer doubling: rounds grow with the logarithm of the longest chain.
    """
    below = groups.select(F.col("parent").alias("child"), F.lit(1).alias("hit")).distinct()
    state = cut(groups.join(below, "child", "left").select("child", "parent", F.when(F.col("hit").isNotNull(), F.col("child")).alias("down"), F.when(F.col("hit").isNotNull(), 1).otherwise(0).alias("place")), "chains")
    while not state.where("down is not null").isEmpty():
        lower = state.select(F.col("parent").alias("down"), F.col("down").alias("next"), F.col("place").alias("more"))
        moved = state.where("down is not null").join(lower, "down").select("child", "parent", F.col("next").alias("down"), (F.col("place") + F.col("more")).alias("place"))
        new = cut(state.where("down is null").unionByName(moved), "chains")
        drop(state)
        state = new
    return state.where("place % 2 = 0").select("child", "parent")


def reversions_pushed(nodes: DataFrame, edges: DataFrame, mutations: DataFrame, length: int, attached: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round of pushing up reversions below nodes whose edge, and whose parent's edge, cover everything (of `attached` (node), or all).

    Of a parent's children the one with most reversions of the parent's mutations is taken (ties: the smaller id). Both then hang from a
    new node halfway up to the grandparent, which takes the parent's other mutations; the child's reversions go, and mutations that had one
    as parent get that of the reverted mutation. Groups that share an edge exclude each other: of each chain of such groups every other
    one is taken, from the lowest on.
    """
    full = _full(edges, length).select("parent", "child")
    both = full.join(full.select(F.col("child").alias("parent"), F.col("parent").alias("grand")), "parent")
    if attached is not None:
        both = both.join(attached.select(F.col("node").alias("child")), "child", "left_semi")
    lower = mutations.select(F.col("node").alias("child"), "position", F.col("derived_state").alias("back"), F.col("mutation_id").alias("reversion"))
    upper = mutations.select(F.col("node").alias("parent"), "position", F.col("inherited_state").alias("back"), F.col("parent").alias("before"))
    found = both.join(lower, "child").join(upper, ["parent", "position", "back"]).select("child", "parent", "grand", "position", "reversion", "before")
    best = found.groupBy("parent", "child", "grand").agg(F.count("*").alias("n")).groupBy("parent", "grand").agg(F.min_by("child", F.struct(-F.col("n"), "child")).alias("child"))
    best = cut(best.select("child", "parent", "grand"), "groups")
    time = nodes.select("node_id", "time")
    taken = _independent(best.select("child", "parent")).join(best.select("child", "parent", "grand"), ["child", "parent"])
    taken = taken.join(time.toDF("parent", "low"), "parent").join(time.toDF("grand", "high"), "grand")
    made = cut(_numbered(taken, nodes, "parent").select("child", "parent", "grand", "new_node", (F.col("low") + (F.col("high") - F.col("low")) / 2).alias("time")), "pushed")
    gone = made.select(F.explode(F.array("child", "parent")).alias("child"))
    span = (F.lit(0).cast("bigint").alias("left"), F.lit(length).cast("bigint").alias("right"))
    hung = made.select(*span, F.explode(F.array(F.struct(F.col("new_node").alias("parent"), F.col("parent").alias("child")), F.struct(F.col("new_node").alias("parent"), "child"), F.struct(F.col("grand").alias("parent"), F.col("new_node").alias("child")))).alias("e"))
    kept_edges = edges.join(gone, "child", "left_anti").select("left", "right", "parent", "child").unionByName(hung.select("left", "right", "e.parent", "e.child"))
    undone = cut(found.join(made.select("child", "parent"), ["child", "parent"], "left_semi"), "undone")
    stay = undone.select(F.col("parent").alias("node"), "position", F.lit(1).alias("stays")).distinct()
    left = mutations.join(undone.select(F.col("reversion").alias("mutation_id")), "mutation_id", "left_anti").join(stay, ["node", "position"], "left")
    moved = left.join(made.select(F.col("parent").alias("node"), "new_node"), "node", "left").withColumn("node", F.when(F.col("stays").isNull(), F.coalesce("new_node", "node")).otherwise(F.col("node")))
    more = made.select(F.col("new_node").alias("node_id"), F.lit(fl.REVERSION_PUSH).alias("flags"), "time")
    left = _followed(moved.select(*mutations.columns), undone.select(F.col("reversion").alias("gone"), F.col("before").alias("target")))
    return nodes.select("node_id", "flags", "time").unionByName(more), kept_edges, left


def mutations_coalesced(nodes: DataFrame, edges: DataFrame, mutations: DataFrame, length: int, chosen: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round of joining siblings that share mutations under a new node that carries the shared ones once.

    Each node of `chosen` (node; default: all) of a full-span edge proposes its largest overlap with a full-span sibling. Siblings that
    have all of a proposed overlap form its group; a node joins the largest overlap it can (ties: the smallest mutations); groups of
    one are left alone. Siblings with the same shared mutations stand for each other, so their number is never squared. Mutations whose
    parent was joined get the joined one as parent.
    """
    full = _full(edges, length).select("parent", F.col("child").alias("node"))
    named = F.struct("position", "inherited_state", "derived_state", F.col("parent").alias("above"))
    own = mutations.select("node", named.alias("m"), "mutation_id").join(full.withColumnRenamed("parent", "up"), "node")
    shared = own.groupBy("up", "m").agg(F.count("*").alias("n")).where("n > 1").select("up", "m")
    sets = cut(own.join(shared, ["up", "m"]).groupBy("up", "node").agg(F.array_sort(F.collect_list("m")).alias("set")), "sets")
    kinds = cut(sets.groupBy("up", "set").agg(F.count("*").alias("members")).withColumn("kind", F.xxhash64("up", "set")), "kinds")
    # Kinds of sets that share a mutation; a kind of several members overlaps wholly with itself.
    each = kinds.select("up", "kind", F.explode("set").alias("m"))
    pairs = each.join(each.withColumnRenamed("kind", "other"), ["up", "m"]).where("kind <> other").groupBy("up", "kind", "other").agg(F.array_sort(F.collect_list("m")).alias("overlap"))
    pairs = pairs.select("kind", "overlap").unionByName(kinds.where("members > 1").select("kind", F.col("set").alias("overlap")))
    best = pairs.groupBy("kind").agg(F.min(F.struct((-F.size("overlap")).alias("size"), "overlap")).alias("b")).select("kind", "b.overlap")
    asked = kinds.join(best, "kind")
    if chosen is not None:
        asked = asked.join(sets.join(chosen.select("node"), "node", "left_semi").select(F.xxhash64("up", "set").alias("kind")).distinct(), "kind", "left_semi")
    proposed = asked.select("up", "overlap", F.explode("overlap").alias("m")).distinct()
    meets = each.join(proposed, ["up", "m"]).groupBy("up", "kind", "overlap").agg(F.count("*").alias("n")).where("n = size(overlap)")
    joins = meets.groupBy("up", "kind").agg(F.min(F.struct((-F.size("overlap")).alias("size"), "overlap")).alias("b")).select("up", "kind", "b.overlap")
    placed = sets.withColumn("kind", F.xxhash64("up", "set")).join(joins, ["up", "kind"]).select("up", "node", "overlap")
    groups = placed.groupBy("up", "overlap").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1")
    time = nodes.select("node_id", "time")
    members = placed.join(groups.select("up", "overlap", "least"), ["up", "overlap"])
    high = members.join(time.toDF("node", "t"), "node").groupBy("up", "overlap", "least").agg(F.max("t").alias("low")).join(time.toDF("up", "high"), "up")
    made = cut(_numbered(high, nodes, "least").select("up", "overlap", "least", "new_node", (F.col("low") + (F.col("high") - F.col("low")) / 2).alias("time")), "made")
    under = cut(members.join(made.select("least", "new_node"), "least").select("up", "node", "overlap", "new_node"), "under")
    span = (F.lit(0).cast("bigint").alias("left"), F.lit(length).cast("bigint").alias("right"))
    hung = made.select(*span, F.col("up").alias("parent"), F.col("new_node").alias("child")).unionByName(under.select(*span, F.col("new_node").alias("parent"), F.col("node").alias("child")))
    kept = edges.join(under.select(F.col("node").alias("child")), "child", "left_anti").select("left", "right", "parent", "child").unionByName(hung)
    free = mutations.agg(F.max("mutation_id")).first()[0]
    fresh = made.select("new_node", F.explode("overlap").alias("m"), F.col("new_node").alias("node")).select("*", "m.position", "m.derived_state")
    fresh = numbered(fresh, "fresh", F.expr(f"node div {NUMBERED}"), ["node", "position", "derived_state"])
    fresh = cut(fresh.select("new_node", "m", (F.col("fresh") + ((free if free is not None else -1) + 1)).alias("fresh")), "fresh")
    lost = cut(own.join(under.select("node", "new_node", F.explode("overlap").alias("m")), ["node", "m"]).join(fresh, ["new_node", "m"]).select("mutation_id", "fresh"), "lost")
    made_ones = fresh.select(F.col("fresh").alias("mutation_id"), F.col("new_node").alias("node"), "m.position", F.col("m.above").alias("parent"), "m.inherited_state", "m.derived_state")
    left = mutations.join(lost, "mutation_id", "left_anti").select(*mutations.columns).unionByName(made_ones.select(*mutations.columns))
    left = _followed(left, lost.select(F.col("mutation_id").alias("gone"), F.col("fresh").alias("target")))
    more = made.select(F.col("new_node").alias("node_id"), F.lit(fl.MUTATION_OVERLAP).alias("flags"), "time")
    return nodes.select("node_id", "flags", "time").unionByName(more), kept, left


def markers_deleted(nodes: DataFrame, edges: DataFrame, mutations: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """nodes and edges without full-span reversion markers that have no mutations and only full-span children; these hang from the marker's parent.

    Markers below markers go together: each child finds its nearest node that stays. Other ids keep their numbers.
    """
    marked = nodes.where(F.col("flags") == fl.REVERSION_MARKER).select(F.col("node_id").alias("node"))
    partial = edges.where((F.col("left") != 0) | (F.col("right") != length))
    gone = marked.join(_full(edges, length).select(F.col("child").alias("node")), "node", "left_semi").join(partial.select(F.col("parent").alias("node")), "node", "left_anti").join(mutations.select("node"), "node", "left_anti")
    gone = cut(gone.join(edges.select(F.col("parent").alias("node")), "node", "left_semi"), "markers")
    jump = cut(gone.join(edges.select(F.col("child").alias("node"), F.col("parent").alias("up")), "node"), "jump")
    while not (far := jump.join(gone.select(F.col("node").alias("up")), "up", "left_semi")).isEmpty():
        further = far.join(jump.select(F.col("node").alias("up"), F.col("up").alias("next")), "up").select("node", F.col("next").alias("up"))
        jump = cut(jump.join(gone.select(F.col("node").alias("up")), "up", "left_anti").select("node", "up").unionByName(further), "jump")
    kept = edges.join(gone.select(F.col("node").alias("child")), "child", "left_anti").join(jump.select(F.col("node").alias("parent"), F.col("up").alias("target")), "parent", "left")
    return nodes.join(gone.select(F.col("node").alias("node_id")), "node_id", "left_anti").select(*nodes.columns), kept.select("left", "right", F.coalesce("target", "parent").alias("parent"), "child")


def branches_trimmed(edges: DataFrame, mutations: DataFrame, samples: DataFrame, length: int) -> DataFrame:
    """edges of a tree without inner nodes above which there is no mutation: their children hang from the nearest one that stays. samples: node.

    Roots, samples and nodes with mutations stay. Rounds grow with the logarithm of the longest run of such nodes.
    """
    full = _full(edges, length).select("parent", "child")
    keep = mutations.select("node").distinct().unionByName(samples.select("node")).distinct()
    roots = full.select(F.col("parent").alias("node")).distinct().join(full.select(F.col("child").alias("node")), "node", "left_anti")
    keep = cut(keep.unionByName(roots).distinct(), "keep")
    jump = cut(full.select(F.col("child").alias("node"), F.col("parent").alias("up")), "jump")
    while not (far := jump.join(keep.select(F.col("node").alias("up")), "up", "left_anti")).isEmpty():
        further = far.join(jump.select(F.col("node").alias("up"), F.col("up").alias("next")), "up").select("node", F.col("next").alias("up"))
        jump = cut(jump.join(keep.select(F.col("node").alias("up")), "up", "left_semi").select("node", "up").unionByName(further), "jump")
    return jump.join(keep, "node", "left_semi").select(F.lit(0).cast("bigint").alias("left"), F.lit(length).cast("bigint").alias("right"), F.col("up").alias("parent"), F.col("node").alias("child"))


def _summary(nodes: DataFrame, edges: DataFrame, mutations: DataFrame) -> dict:
    """nodes, edges, mutations and the shortest time along an edge."""
    time = nodes.select("node_id", "time")
    met = edges.select("parent", "child").join(time.toDF("parent", "high"), "parent").join(time.toDF("child", "low"), "child")
    e = met.agg(F.count("*").alias("n"), F.min(F.col("high") - F.col("low")).alias("least")).first()
    return {"nodes": nodes.count(), "edges": e.n, "mutations": mutations.count(), "min_edge_time": e.least}


def parsimony_fixpoint(nodes: DataFrame, edges: DataFrame, mutations: DataFrame, length: int, coalesce: bool = True, push: bool = True, most: int = 1000) -> tuple[DataFrame, DataFrame, DataFrame, list[dict]]:
    """Siblings' mutations are joined until no round finds any more, then immediate reversions are pushed up until no round does.

    Returns nodes, edges, mutations and a report: op (noop first, then coalesce_mutations or reversion_push), round, and the counts after
    it. Each round takes mutations away, so it ends; more than `most` rounds are an error. Only the tables of the last round are kept.
    """
    state = (nodes.select("node_id", "flags", "time"), edges.select("left", "right", "parent", "child"), mutations)
    report = [{"round": 0, "op": "noop", **_summary(*state)}]
    for op, wanted, step in (("coalesce_mutations", coalesce, mutations_coalesced), ("reversion_push", push, reversions_pushed)):
        while wanted:
            new = tuple(cut(t, op) for t in step(*state, length))
            found = _summary(*new)
            if found["mutations"] == report[-1]["mutations"]:
                break
            if len(report) > most:
                raise ValueError(f"more than {most} rounds")
            for t in state:
                drop(t)
            state = new
            report.append({"round": len(report), "op": op, **found})
    return *state, report
