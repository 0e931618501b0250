"""Broken graphs, each named by the invariant that it breaks; sets as bitmaps; groups without a parent."""

import datetime

import pytest
from pyspark.sql import functions as F

from strandlake.functions import flags as fl
from strandlake.operators import graph, invariants, mutations, reports, sets
from tests.test_graph import BALANCED, sites_of, tree


@pytest.fixture(scope="module")
def whole(spark):
    nodes, edges = tree(spark, BALANCED, {0, 1, 2, 3})
    extra = spark.createDataFrame([(0, 4, 4, 7), (4, 10, 5, 7)], "left bigint, right bigint, parent bigint, child bigint")
    nodes = nodes.unionByName(spark.createDataFrame([(7, fl.RECOMBINANT, 0.5, "S7")], "node_id bigint, flags int, time double, sample_id string"))
    muts = mutations.resolved(spark.createDataFrame([(1, 4, "T"), (1, 0, "G"), (2, 5, "C"), (3, 7, "C")], "position bigint, node bigint, derived_state string"), sites_of(spark), graph.closure(edges))
    return nodes, edges.unionByName(extra), muts


def test_a_whole_graph_passes(whole):
    nodes, edges, muts = invariants.checked(*whole, 10)
    assert nodes.count() == 8 and edges.count() == 8 and muts.count() == 4


BROKEN = {
    "node_ids": lambda n, e, m: (n.unionByName(n.where("node_id = 6")), e, m),
    "sample_ids": lambda n, e, m: (n.withColumn("sample_id", F.when(F.col("node_id") == 1, "S0").otherwise(F.col("sample_id"))), e, m),
    "edge_nodes": lambda n, e, m: (n, e.withColumn("parent", F.when(F.col("parent") == 6, 66).otherwise(F.col("parent"))), m),
    "edge_times": lambda n, e, m: (n.withColumn("time", F.when(F.col("node_id") == 4, 0.0).otherwise(F.col("time"))), e, m),
    "edge_cover": lambda n, e, m: (n, e.withColumn("left", F.when(F.col("child") == 2, 1).otherwise(F.col("left"))), m),
    "edge_kinds": lambda n, e, m: (n.withColumn("flags", F.when(F.col("node_id") == 5, fl.RECOMBINANT).otherwise(F.col("flags"))), e, m),
    "mutation_nodes": lambda n, e, m: (n, e, m.withColumn("node", F.when(F.col("position") == 2, 99).otherwise(F.col("node")))),
    "mutation_states": lambda n, e, m: (n, e, m.withColumn("derived_state", F.when(F.col("position") == 2, F.col("inherited_state")).otherwise(F.col("derived_state")))),
    "mutation_repeats": lambda n, e, m: (n, e, m.unionByName(m.where("position = 2").withColumn("mutation_id", F.lit(77)))),
    "mutation_parents": lambda n, e, m: (n, e, m.withColumn("parent", F.when(F.col("position") == 2, 0).otherwise(F.col("parent")))),
}


@pytest.mark.parametrize("name", BROKEN)
def test_broken_graphs_are_named(whole, name):
    with pytest.raises(invariants.BrokenGraph, match=name) as found:
        invariants.checked(*BROKEN[name](*whole), 10)
    assert set(found.value.violations) == {name}


def test_bounds(whole):
    nodes, edges, muts = whole
    counts = invariants.written(nodes, edges.withColumn("right", F.when(F.col("child") == 2, 11).otherwise(F.col("right"))), muts, 10)[3]
    assert counts["edge_bounds"] == 1 and counts["edge_cover"] == 1 and sum(counts.values()) == 2


def test_sets(spark):
    own = {"a": {0, 1, 5, 32767, 32768, 70000}, "b": {1, 32768, 70000, 70001}, "c": {999_999}}
    rows = [(k, v) for k, s in own.items() for v in s] + [("a", 1), ("a", None)]
    made = sets.bitmaps(spark.createDataFrame(rows, "name string, site bigint"), "name", "site")
    assert {r["name"]: r["size"] for r in sets.counted(made, "name").collect()} == {k: len(v) for k, v in own.items()}
    got = {(r.name_a, r.name_b): (r.in_a, r.in_b, r.in_both, r.in_either, r.only_a, r.only_b) for r in sets.compared(made, "name").collect()}
    assert got == {("a", "b"): (6, 4, 3, 7, 3, 1)}
    assert sets.united(made.withColumn("all", F.lit(1)), ["all"]).agg(F.sum(F.bitmap_count("bits"))).first()[0] == len(set().union(*own.values()))
    assert sets.compared(made.where("false"), "name").count() == 0


def test_groups_without_a_parent_have_a_summary(spark):
    day = lambda i: datetime.date(2021, 1, 1 + i)
    rows = [(f"S{i}", day(i % 3), 1.0, None, "x") for i in range(6)] + [(f"T{i}", day(i % 2), 0.0, 4, "y") for i in range(4)]
    frame = spark.createDataFrame(rows, "sample_id string, match_date date, hmm_cost double, parent bigint, scorpio string")
    found = reports.sample_groups_summary(frame, 3, 2, 10).collect()
    assert {(r.parent, r.samples, r.dates, r.lineages, r.is_retro) for r in found} == {(None, 6, 3, 1, True), (4, 4, 2, 1, False)}
