"""What every graph must fulfil, counted by observed metrics in the same pass that writes its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from strandlake.functions import flags as fl
from strandlake.plans.lineage import cut


class BrokenGraph(ValueError):
    """A graph that breaks invariants: violations names them with their counts."""

    def __init__(self, violations: dict[str, int]):
        self.violations = violations
        super().__init__(", ".join(f"{k}: {v}" for k, v in sorted(violations.items())))


def written(nodes: DataFrame, edges: DataFrame, mutations: DataFrame, length: int) -> tuple[DataFrame, DataFrame, DataFrame, dict[str, int]]:
    """nodes, edges and mutations, written once to the shared folder, and the violations of each invariant (all of them, also those of 0).

    node_ids: a null or repeated id. sample_ids: a sample without an id, or with that of another. edge_nodes: an end that is no node.
    edge_times: a parent that is not older. edge_bounds: not 0 <= left < right <= length. edge_cover: edges of a child that leave a gap, overlap, or
    don't reach from 0 to the length (counted at each place). edge_kinds: a child of several edges that is no recombinant, or a recombinant of one.
    mutation_nodes, mutation_states: no node; derived and inherited state alike. mutation_repeats: several of a node at a position.
    mutation_parents: a parent that is no mutation of this position, or whose derived state is not the inherited one.
    """
    seen = {}

    def observed(rows: DataFrame, name: str, **counts) -> DataFrame:
        seen[name] = Observation(name)
        return rows.observe(seen[name], *[F.count_if(c).alias(k) for k, c in counts.items()])

    true_if = lambda c: F.coalesce(c, F.lit(True))
    sample = fl.has(F.col("flags"), fl.SAMPLE)
    once = F.count("*").over(Window.partitionBy("node_id"))
    named = F.count("*").over(Window.partitionBy(F.when(sample, F.col("sample_id")), sample)) if "sample_id" in nodes.columns else F.lit(1)
    own_name = F.col("sample_id").isNull() if "sample_id" in nodes.columns else F.lit(False)
    n = nodes.withColumn("__once", once).withColumn("__named", named)
    n = observed(n, "nodes", node_ids=F.col("node_id").isNull() | (F.col("__once") > 1), sample_ids=sample & (own_name | (F.col("__named") > 1)))
    out_nodes = cut(n.select(*nodes.columns), "nodes")
    time = nodes.dropDuplicates(["node_id"]).select("node_id", "time", fl.has(F.col("flags"), fl.RECOMBINANT).alias("recombinant"))
    by, order = Window.partitionBy("child"), Window.partitionBy("child").orderBy("left", "right")
    e = edges.join(time.select(F.col("node_id").alias("parent"), F.col("time").alias("__high")), "parent", "left").join(time.toDF("child", "__low", "__recombinant"), "child", "left")
    e = e.withColumns({"__before": F.lag("right").over(order), "__next": F.lead("left").over(order), "__n": F.count("*").over(by)})
    starts = F.when(F.col("__before").isNull(), F.col("left") != 0).otherwise(F.col("__before") != F.col("left"))
    ends = F.col("__next").isNull() & (F.col("right") != length)
    e = observed(
        e, "edges", edge_nodes=F.col("__high").isNull() | F.col("__low").isNull(), edge_times=F.col("__high") <= F.col("__low"),
        edge_bounds=~((F.col("left") >= 0) & (F.col("left") < F.col("right")) & (F.col("right") <= length)), edge_cover=starts | ends,
        edge_kinds=F.col("__before").isNull() & true_if((F.col("__n") > 1) != F.col("__recombinant")),
    )
    out_edges = cut(e.select(*edges.columns), "edges")
    up = mutations.select(F.col("mutation_id").alias("parent"), F.col("position").alias("__at"), F.col("derived_state").alias("__from"))
    m = mutations.join(up, "parent", "left").join(time.select(F.col("node_id").alias("node"), F.lit(True).alias("__node")), "node", "left")
    m = m.withColumn("__n", F.row_number().over(Window.partitionBy("position", "node").orderBy("mutation_id")))
    wrong = true_if((F.col("__at") != F.col("position")) | (F.col("__from") != F.col("inherited_state")))
    m = observed(m, "mutations", mutation_nodes=F.col("__node").isNull(), mutation_states=true_if(F.col("derived_state") == F.col("inherited_state")), mutation_repeats=F.col("__n") > 1, mutation_parents=(F.col("parent") != -1) & wrong)
    out_mutations = cut(m.select(*mutations.columns), "mutations")
    counts = {k: int(v) for o in seen.values() for k, v in o.get.items()}
    return out_nodes, out_edges, out_mutations, counts


def checked(nodes: DataFrame, edges: DataFrame, mutations: DataFrame, length: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The written tables of a graph that breaks none of the invariants; else BrokenGraph names those that it breaks."""
    *tables, counts = written(nodes, edges, mutations, length)
    if broken := {k: v for k, v in counts.items() if v}:
        raise BrokenGraph(broken)
    return tuple(tables)
