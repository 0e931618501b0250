"""Trees of an ancestral recombination graph: intervals, closure, descendants, common ancestors.

The graph is nodes(node_id, flags, time, sample_id) and edges(left, right, parent, child), intervals half open. A marginal tree is
the set of edges that cover an interval between neighbouring breakpoints. Paths and counts are kept as intervals of positions, so
that what several neighbouring trees share is stored once; per_tree() writes it out for every tree where that is asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import flags as fl
from strandlake.plans.lineage import cut, drop

#: Least positions of a cell by which intervals and trees, and positions of one by which intervals and single positions, find each other; parts of a cell.
TREE_CELL, POINT_CELL, SALTS = 4096, 64, 16
#: So many trees at most meet all rows at once, as a table of fixed size.
FEW_TREES = 64


def trees(edges: DataFrame) -> DataFrame:
    """tree_left, tree_right of each marginal tree. One row per TREE_CELL positions goes through one window."""
    at = edges.select(F.explode(F.array("left", "right")).alias("tree_left")).distinct().withColumn("cell", F.expr(f"tree_left div {TREE_CELL}"))
    inside = at.withColumn("next", F.lead("tree_left").over(Window.partitionBy("cell").orderBy("tree_left")))
    firsts = at.groupBy("cell").agg(F.min("tree_left").alias("first"))
    after = firsts.select("cell", F.lead("first").over(Window.orderBy("cell")).alias("first"))
    return inside.join(after, "cell").select("tree_left", F.coalesce("next", "first").alias("tree_right")).where("tree_right is not null")


def per_tree(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """rows (left, right and more) once for every tree of edges in their interval: tree_left in place of left and right.

    Many trees are dealt by cells, of which there are no more than trees, so that rows are not copied for cells in which no tree begins.
    """
    more = [c for c in rows.columns if c not in ("left", "right")]
    starts = cut(trees(edges).select("tree_left"), "starts")
    there = starts.agg(F.count("*").alias("n"), F.min("tree_left").alias("first"), F.max("tree_left").alias("last")).first()
    spans = rows.where("left < right")
    if there.n <= FEW_TREES:
        return spans.join(F.broadcast(starts), (F.col("left") <= F.col("tree_left")) & (F.col("tree_left") < F.col("right"))).select("tree_left", *more)
    width = max(TREE_CELL, (there.last - there.first) // there.n + 1)
    dealt = starts.select("tree_left", F.expr(f"(tree_left - {there.first}) div {width}").alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    low, high = F.greatest("left", F.lit(there.first)), F.least(F.col("right") - 1, F.lit(there.last))
    spans = spans.withColumns({"low": low, "high": high}).where("low <= high")
    spans = spans.withColumn("cell", F.explode(F.expr(f"sequence((low - {there.first}) div {width}, (high - {there.first}) div {width})")))
    spans = spans.withColumn("salt", F.pmod(F.xxhash64(*more), F.lit(SALTS)).cast("int"))
    # The hint: rows that were exploded look small to the planner, which would send them all to the driver.
    return spans.join(dealt.hint("merge"), ["cell", "salt"]).where("left <= tree_left and tree_left < right").select("tree_left", *more)


def tree_edges(edges: DataFrame) -> DataFrame:
    """tree_left, parent, child: the edges of every tree."""
    return per_tree(edges.select("left", "right", "parent", "child"), edges)


def with_tree(rows: DataFrame, edges: DataFrame, position: str = "position") -> DataFrame:
    """Adds tree_left, the start of the tree that covers a position (rows outside all trees go)."""
    cells = trees(edges).withColumn("cell", F.explode(F.expr(f"sequence(tree_left div {POINT_CELL}, (tree_right - 1) div {POINT_CELL})")))
    met = rows.withColumn("cell", F.expr(f"`{position}` div {POINT_CELL}")).join(cells, "cell")
    return met.where((F.col("tree_left") <= F.col(position)) & (F.col(position) < F.col("tree_right"))).drop("cell", "tree_right")


def _beyond(low: DataFrame, up: DataFrame, *more) -> DataFrame:
    """low (node, ancestor, left, right) continued by up (node, ancestor, left, right) from its ancestor on, where the intervals overlap."""
    far = up.select(F.col("node").alias("via"), F.col("ancestor").alias("far"), F.col("left").alias("l"), F.col("right").alias("r"), *[c for c in up.columns if c == "steps"])
    met = low.join(far, F.col("ancestor") == F.col("via")).withColumns({"left": F.greatest("left", "l"), "right": F.least("right", "r")}).where("left < right")
    return met.select("node", F.col("far").alias("ancestor"), "left", "right", *more)


def closure(edges: DataFrame) -> DataFrame:
    """node, ancestor, left, right, depth for every proper ancestor, by pointer doubling: rounds grow with the logarithm of the depth."""
    reach = cut(edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), "left", "right", F.lit(1).alias("depth")), "reach")
    step = 1
    while True:
        low = reach.where(F.col("depth") == step)
        more = cut(_beyond(low, reach.withColumnRenamed("depth", "steps"), (F.col("depth") + F.col("steps")).alias("depth")), "reach")
        grown = reach.unionByName(more)
        if more.where(F.col("depth") == 2 * step).isEmpty():
            return grown
        reach, step = grown, 2 * step


def _pieces(deltas: DataFrame) -> DataFrame:
    """deltas: node, at, d. node, left, right, samples: the running sum of d along a node's positions, where it is above 0."""
    summed = deltas.groupBy("node", "at").agg(F.sum("d").alias("d")).where("d <> 0")
    along = Window.partitionBy("node").orderBy("at")
    return summed.select("node", F.col("at").alias("left"), F.lead("at").over(along).alias("right"), F.sum("d").over(along).alias("samples")).where("right is not null and samples > 0")


def sample_counts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, left, right, samples: samples at or below each node along the positions.

    Sums over descendants of less than 2, 4, 8 ... steps: each round adds to a node the sums of those that lie just as many steps
    below. Only one table of jumps and one of sums is kept, both about as large as the edges.
    """
    span = edges.agg(F.min("left").alias("l"), F.max("right").alias("r")).first()
    sample = nodes.where(fl.has(F.col("flags"), fl.SAMPLE)).select(F.col("node_id").alias("node"))
    sums = sample.select("node", F.lit(span.l).cast("bigint").alias("left"), F.lit(span.r).cast("bigint").alias("right"), F.lit(1).cast("bigint").alias("samples")).where("left < right")
    jump = edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), "left", "right")
    ends = F.explode(F.array(F.struct(F.col("left").alias("at"), F.col("samples").alias("d")), F.struct(F.col("right").alias("at"), (-F.col("samples")).alias("d")))).alias("e")
    while not jump.isEmpty():
        up = jump.select("node", "ancestor", F.col("left").alias("l"), F.col("right").alias("r"))
        moved = sums.join(up, "node").withColumns({"left": F.greatest("left", "l"), "right": F.least("right", "r")}).where("left < right")
        both = sums.select("node", "left", "right", "samples").unionByName(moved.select(F.col("ancestor").alias("node"), "left", "right", "samples"))
        new = cut(_pieces(both.select("node", ends).select("node", "e.at", "e.d")), "sums")
        drop(sums)
        far = cut(_beyond(jump, jump), "jump")
        drop(jump)
        sums, jump = new, far
    return sums


def max_descendant_samples(counts: DataFrame) -> DataFrame:
    """counts: what sample_counts() gives. node_id, max_descendant_samples: the most samples at or below a node in any tree."""
    return counts.groupBy(F.col("node").alias("node_id")).agg(F.max("samples").alias("max_descendant_samples"))


def mrca(pairs: DataFrame, reach: DataFrame, nodes: DataFrame) -> DataFrame:
    """pairs: tree_left, a, b. Adds mrca: the youngest common ancestor (a node is its own ancestor); null if there is none."""
    asked = pairs.distinct()
    over = "left <= tree_left and tree_left < right"
    own = lambda side: asked.select("tree_left", "a", "b", F.col(side).alias("ancestor")).unionByName(
        asked.join(reach.select(F.col("node").alias(side), "ancestor", "left", "right"), side).where(over).select("tree_left", "a", "b", "ancestor")
    )
    both = own("a").join(own("b"), ["tree_left", "a", "b", "ancestor"]).join(nodes.select(F.col("node_id").alias("ancestor"), "time"), "ancestor")
    best = both.groupBy("tree_left", "a", "b").agg(F.min_by("ancestor", "time").alias("mrca"))
    return pairs.join(best, ["tree_left", "a", "b"], "left")


def closest_recombinant(edges: DataFrame, reach: DataFrame, nodes: DataFrame) -> DataFrame:
    """tree_left, node, recombinant, distance: the nearest recombinant at or above a node."""
    marked = nodes.where(fl.has(F.col("flags"), fl.RECOMBINANT)).select(F.col("node_id").alias("ancestor"))
    here = edges.select(F.col("child").alias("node"), F.col("child").alias("ancestor"), "left", "right", F.lit(0).alias("depth"))
    found = per_tree(reach.unionByName(here).join(marked, "ancestor").select("left", "right", "node", "ancestor", "depth"), edges)
    return found.groupBy("tree_left", "node").agg(F.min_by("ancestor", "depth").alias("recombinant"), F.min("depth").alias("distance"))


def full_span_siblings(edges: DataFrame, nodes: DataFrame, length: int) -> DataFrame:
    """node, sibling: children (the node itself included) of a node's parent, where all these edges cover everything."""
    full = edges.where((F.col("left") == 0) & (F.col("right") == length)).select("parent", "child")
    asked = full.join(nodes.select(F.col("node_id").alias("child")), "child").select("parent", F.col("child").alias("node"))
    return asked.join(full, "parent").select("node", F.col("child").alias("sibling"))


def squashed(edges: DataFrame) -> DataFrame:
    """Edges with neighbouring intervals of the same parent and child merged."""
    by = Window.partitionBy("parent", "child").orderBy("left")
    starts = F.when(F.lag("right").over(by) == F.col("left"), 0).otherwise(1)
    island = edges.withColumn("starts", starts).withColumn("island", F.sum("starts").over(by))
    return island.groupBy("parent", "child", "island").agg(F.min("left").alias("left"), F.max("right").alias("right")).select("left", "right", "parent", "child")


def mirrored(edges: DataFrame, length: int) -> DataFrame:
    return edges.select((F.lit(length) - F.col("right")).alias("left"), (F.lit(length) - F.col("left")).alias("right"), "parent", "child")


def without_root_edge(edges: DataFrame) -> DataFrame:
    """Edges without the one above the only child of the root, if the root has just that one: the vestigial root edge."""
    roots = edges.select(F.col("parent").alias("root")).distinct().join(edges.select(F.col("child").alias("root")).distinct(), "root", "left_anti")
    above = edges.join(roots, F.col("parent") == F.col("root")).groupBy(F.col("root").alias("parent")).agg(F.countDistinct("child").alias("kids")).where("kids = 1").select("parent")
    return edges.join(above, "parent", "left_anti").select("left", "right", "parent", "child")


def with_root_edge(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges and nodes with a new root, one unit of time above the old one: the next free node id, no flags, an edge over everything."""
    span = edges.agg(F.min("left").alias("left"), F.max("right").alias("right"))
    root = edges.select(F.col("parent").alias("node_id")).distinct().join(edges.select(F.col("child").alias("node_id")).distinct(), "node_id", "left_anti")
    top = nodes.join(root, "node_id").agg(F.max_by("node_id", "time").alias("child"), F.max("time").alias("time"))
    free = nodes.agg((F.max("node_id") + 1).alias("parent"))  # each of these three is one row
    one = span.join(F.broadcast(top)).join(F.broadcast(free))
    more = one.select(F.col("parent").alias("node_id"), (F.col("time") + 1).alias("time"))
    return edges.unionByName(one.select("left", "right", "parent", "child")), nodes.unionByName(more.withColumn("flags", F.lit(0)), allowMissingColumns=True)
