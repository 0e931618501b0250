"""Hand-drawn trees and sequences with known answers."""

import pytest
from pyspark.sql import functions as F

from strandlake.functions import flags as fl
from strandlake.functions import sequences as sq
from strandlake.operators import graph, mutations


def tree(spark, pairs, samples, length=10):
    edges = spark.createDataFrame([(0, length, p, c) for p, c in pairs], "left bigint, right bigint, parent bigint, child bigint")
    count = max(p for p, _ in pairs) + 1
    nodes = spark.createDataFrame([(i, int(i in samples), float(i), f"S{i}") for i in range(count)], "node_id bigint, flags int, time double, sample_id string")
    return nodes, edges


BALANCED = [(4, 0), (4, 1), (5, 2), (5, 3), (6, 4), (6, 5)]
COMB = [(4, 2), (4, 3), (5, 1), (5, 4), (6, 0), (6, 5)]


def sites_of(spark):
    return spark.createDataFrame([(i, "A") for i in range(1, 10)], "position bigint, ancestral_state string")


def test_balanced_counts(spark):
    nodes, edges = tree(spark, BALANCED, {0, 1, 2, 3})
    got = {r.node_id: r.max_descendant_samples for r in graph.max_descendant_samples(graph.sample_counts(edges, nodes)).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 1, 4: 2, 5: 2, 6: 4}


def test_two_trees(spark):
    edges = spark.createDataFrame([(0, 5, 3, 1), (0, 5, 3, 2), (0, 5, 4, 0), (0, 5, 4, 3), (5, 10, 3, 0), (5, 10, 3, 1), (5, 10, 4, 2), (5, 10, 4, 3)], "left bigint, right bigint, parent bigint, child bigint")
    nodes = spark.createDataFrame([(i, int(i < 3), float(i), f"S{i}") for i in range(5)], "node_id bigint, flags int, time double, sample_id string")
    counts = graph.sample_counts(edges, nodes)
    assert {r.node_id: r.max_descendant_samples for r in graph.max_descendant_samples(counts).collect()} == {0: 1, 1: 1, 2: 1, 3: 2, 4: 3}
    assert {tuple(r) for r in graph.trees(edges).collect()} == {(0, 5), (5, 10)}
    paths = {(r.tree_left, r.node, r.ancestor, r.depth) for r in graph.per_tree(graph.closure(edges).select("left", "right", "node", "ancestor", "depth"), edges).collect()}
    assert paths == {(0, 1, 3, 1), (0, 2, 3, 1), (0, 0, 4, 1), (0, 3, 4, 1), (0, 1, 4, 2), (0, 2, 4, 2), (5, 0, 3, 1), (5, 1, 3, 1), (5, 2, 4, 1), (5, 3, 4, 1), (5, 0, 4, 2), (5, 1, 4, 2)}


def test_recurrent_mutations(spark):
    """Several mutations of one branch at one position: a chain from the oldest on."""
    nodes, edges = tree(spark, BALANCED, {0, 1, 2, 3})
    raw = spark.createDataFrame([(i + 1, i, "T", float(i)) for i in range(6)] + [(6, 5, "G", 4.5)], "position bigint, node bigint, derived_state string, time double")
    reach = graph.closure(edges)
    found = mutations.resolved(raw, sites_of(spark), reach)
    rows = mutations.inheritance(found, graph.sample_counts(edges, nodes)).join(mutations.num_parents(found), "mutation_id").orderBy("mutation_id").collect()
    assert [r.num_parents for r in rows] == [0, 0, 0, 0, 0, 0, 1]
    assert [(r.num_descendants, r.num_inheritors) for r in rows] == [(1, 1), (1, 1), (1, 1), (1, 1), (2, 2), (2, 0), (2, 2)]
    assert [(r.inherited_state, r.derived_state, r.parent) for r in rows][-2:] == [("A", "T", -1), ("T", "G", 5)]


def test_idle_mutations_go(spark):
    _, edges = tree(spark, BALANCED, {0, 1, 2, 3})
    raw = spark.createDataFrame([(4, 3, "T"), (4, 5, "T"), (5, 4, "A")], "position bigint, node bigint, derived_state string")
    assert [tuple(r) for r in mutations.resolved(raw, sites_of(spark), graph.closure(edges)).collect()] == [(0, 4, 5, -1, "A", "T")]


def test_root_path_counts(spark):
    _, edges = tree(spark, BALANCED, {0, 1, 2, 3})
    raw = spark.createDataFrame([(3, 4, "T"), (3, 0, "A")], "position bigint, node bigint, derived_state string")
    reach = graph.closure(edges)
    got = mutations.root_path_counts(mutations.resolved(raw, sites_of(spark), reach), reach)
    assert {r.node_id: r.num_mutations_on_path for r in got.collect()} == {0: 2, 1: 1, 4: 1}


def test_mrca_and_siblings(spark):
    nodes, edges = tree(spark, COMB, {0, 1, 2, 3})
    pairs = spark.createDataFrame([(0, 2, 3), (0, 1, 2), (0, 0, 3), (0, 4, 2)], "tree_left bigint, a bigint, b bigint")
    assert {(r.a, r.b): r.mrca for r in graph.mrca(pairs, graph.closure(edges), nodes).collect()} == {(2, 3): 4, (1, 2): 5, (0, 3): 6, (4, 2): 4}
    sibs = graph.full_span_siblings(edges, nodes.where("node_id = 1"), 10)
    assert {r.sibling for r in sibs.collect()} == {1, 4}


def test_root_edges(spark):
    nodes, edges = tree(spark, [(4, 2), (4, 3)], {2, 3})
    more, grown = graph.with_root_edge(edges, nodes)
    assert {(r.parent, r.child) for r in more.collect()} == {(4, 2), (4, 3), (5, 4)}
    assert {(r.node_id, r.time) for r in grown.collect()} == {(i, float(i)) for i in range(6)}
    assert {(r.parent, r.child) for r in graph.without_root_edge(more).collect()} == {(4, 2), (4, 3)}


def test_squash_and_mirror(spark):
    edges = spark.createDataFrame([(0, 5, 3, 1), (5, 10, 3, 1), (0, 10, 3, 2)], "left bigint, right bigint, parent bigint, child bigint")
    assert {tuple(r) for r in graph.squashed(edges).collect()} == {(0, 10, 3, 1), (0, 10, 3, 2)}
    assert {tuple(r) for r in graph.mirrored(edges.where("right = 5"), 10).collect()} == {(5, 10, 3, 1)}


@pytest.mark.parametrize(("letters", "masked"), [("--A-AT-T--", "NNA-AT-TNN"), ("---", "NNN"), ("", ""), ("A", "A"), ("-N-", "NNN")])
def test_mask_flanks(spark, letters, masked):
    row = spark.createDataFrame([(letters,)], "s string").select(sq.decode(sq.mask_flanks(sq.encode(F.col("s")))).alias("m")).first()
    assert row.m == masked


def test_encode(spark):
    row = spark.createDataFrame([("ACGT-N",)], "s string").select(sq.encode(F.col("s")).alias("e")).first()
    assert row.e == [0, 1, 2, 3, 4, -1]
    for bad in ("a", "X", "Z"):
        with pytest.raises(Exception, match="not recognised"):
            spark.createDataFrame([(bad,)], "s string").select(sq.encode(F.col("s"))).collect()


def test_flags(spark):
    row = spark.createDataFrame([(fl.SAMPLE | fl.RECOMBINANT,)], "f int").select(fl.summary(F.col("f")).alias("s"), fl.names(F.col("f")).alias("n")).first()
    assert row.s == "S__R____" and row.n == ["Sample", "Recombinant"]


def test_mismatch_rates():
    for k, rho in ((2, 0.0001904), (3, 2.50582e-06), (4, 3.297146e-08), (1000, 0.0)):
        assert abs(sq.mismatch_rates(k)[1] - rho) < 1e-7
    with pytest.raises(ValueError, match="above 1"):
        sq.mismatch_rates(1)


def test_runs(spark):
    rows = spark.createDataFrame([(1, 3), (1, 4), (1, 6), (2, 4)], "node bigint, position bigint")
    assert {tuple(r) for r in mutations.runs(rows, ["node"], "position").select("node", "start", "end", "length").collect()} == {(1, 3, 4, 2), (1, 6, 6, 1), (2, 4, 4, 1)}
