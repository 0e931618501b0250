"""Rows written out per tree: what is made grows with the trees, not with the positions."""

import pytest
from pyspark.sql import functions as F

from strandlake.operators import graph

EDGES = "left bigint, right bigint, parent bigint, child bigint"


@pytest.mark.parametrize("few", [graph.FEW_TREES, 0])
def test_a_long_genome_costs_no_cells(spark, monkeypatch, few):
    """Before, an edge was copied for every 4096 positions: more than an array can hold."""
    monkeypatch.setattr(graph, "FEW_TREES", few)
    length, at = 10**14, 10**13
    edges = spark.createDataFrame([(0, length, 0, 1), (0, at, 1, 2), (at, length, 0, 2)], EDGES)
    assert {tuple(r) for r in graph.tree_edges(edges).collect()} == {(0, 0, 1), (at, 0, 1), (0, 1, 2), (at, 0, 2)}


@pytest.mark.parametrize("few", [graph.FEW_TREES, 0])
def test_rows_meet_the_trees_of_their_interval(spark, monkeypatch, few):
    """Many trees, unevenly spread; rows that begin or end between trees, or lie outside of them."""
    monkeypatch.setattr(graph, "FEW_TREES", few)
    monkeypatch.setattr(graph, "TREE_CELL", 8)
    cuts = [3, 4, 5, 7, 8, 20, 21, 400, 5000]
    edges = spark.createDataFrame([(a, b, 0, i + 1) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))], EDGES)
    rows = [(left, right, 100 * left + right) for left in (0, 3, 6, 8, 399, 400, 6000) for right in (2, 3, 5, 8, 21, 401, 5000, 7000)]
    got = sorted(tuple(r) for r in graph.per_tree(spark.createDataFrame(rows, "left bigint, right bigint, name bigint"), edges).collect())
    assert got == sorted((t, name) for left, right, name in rows for t in cuts[:-1] if left <= t < right)


def test_rows_are_never_sent_to_the_driver(spark, monkeypatch):
    """Before, rows that looked small to the planner were the side that went to all executors, after they had been copied for their cells."""
    for few, sent in ((graph.FEW_TREES, "BroadcastNestedLoopJoin BuildRight"), (0, "SortMergeJoin")):
        monkeypatch.setattr(graph, "FEW_TREES", few)
        edges = spark.range(1, 50).select(F.lit(0).cast("bigint").alias("left"), F.lit(10**6).alias("right").cast("bigint"), F.expr("id div 2").alias("parent"), F.col("id").alias("child"))
        plan = graph.tree_edges(edges)._jdf.queryExecution().executedPlan().toString()
        assert sent in plan
