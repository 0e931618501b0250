"""Rewrites of hand-drawn trees: known shapes, and what the leaves carry stays the same."""

from strandlake.functions import flags as fl
from strandlake.operators import graph, matching, mutations, rewrites
from tests.test_graph import BALANCED, COMB, sites_of, tree


def carried(spark, edges, muts):
    """node, position, state of the leaves 0 to 3."""
    asked = spark.createDataFrame([(i,) for i in range(4)], "node bigint")
    return {tuple(r) for r in matching.differing_states(asked, muts, graph.closure(edges), sites_of(spark)).collect()}


def resolved(spark, edges, rows):
    raw = spark.createDataFrame(rows, "position bigint, node bigint, derived_state string")
    return mutations.resolved(raw, sites_of(spark), graph.closure(edges))


def test_split_branch(spark):
    nodes, edges = tree(spark, BALANCED, {0, 1, 2, 3})
    muts = resolved(spark, edges, [(1, 0, "T"), (2, 0, "T")])
    more, cut, moved = rewrites.branches_split(nodes, edges, muts, muts.where("position = 1").select("mutation_id"))
    assert {(r.child, r.parent) for r in cut.collect()} == {(0, 7), (1, 4), (2, 5), (3, 5), (4, 6), (5, 6), (7, 4)}
    assert {r.position: r.node for r in moved.collect()} == {1: 7, 2: 0}
    assert more.where("node_id = 7").first().time == 2.0 and carried(spark, cut, moved) == carried(spark, edges, muts)


def test_push_reversion(spark):
    nodes, edges = tree(spark, COMB, {0, 1, 2, 3})
    muts = resolved(spark, edges, [(1, 4, "T"), (1, 3, "A"), (2, 4, "T")])
    more, pushed, left = rewrites.reversions_pushed(nodes, edges, muts, 10)
    assert {(r.child, r.parent) for r in pushed.collect()} == {(0, 6), (1, 5), (2, 4), (5, 6), (3, 7), (4, 7), (7, 5)}
    assert {(r.position, r.node) for r in left.collect()} == {(1, 4), (2, 7)}
    assert more.where(f"flags = {fl.REVERSION_PUSH}").count() == 1 and carried(spark, pushed, left) == carried(spark, edges, muts)


def test_coalesce(spark):
    nodes, edges = tree(spark, [(4, i) for i in range(4)], {0, 1, 2, 3})
    muts = resolved(spark, edges, [(1, 0, "T"), (1, 1, "T"), (1, 2, "G"), (1, 3, "G")])
    more, joined, left = rewrites.mutations_coalesced(nodes, edges, muts, 10)
    assert left.count() == 2 and more.count() == 7 and carried(spark, joined, left) == carried(spark, edges, muts)
    # The larger overlap wins: 0 and 2 share two sites, 0 and 1 one.
    muts = resolved(spark, edges, [(1, 0, "T"), (1, 1, "T"), (2, 0, "T"), (2, 2, "T"), (3, 0, "T"), (3, 2, "T")])
    more, joined, left = rewrites.mutations_coalesced(nodes, edges, muts, 10)
    assert left.count() == 4 and more.count() == 6 and carried(spark, joined, left) == carried(spark, edges, muts)


def test_push_unary_recombinant(spark):
    nodes, edges = tree(spark, [(4, 0), (5, 1), (5, 4)], {0, 1})
    marked = nodes.replace({4.0: 4.0}).selectExpr("node_id", f"if(node_id = 4, {fl.RECOMBINANT}, flags) as flags", "time")
    muts = resolved(spark, edges, [(1, 0, "T"), (2, 1, "T")])
    assert {(r.position, r.node) for r in rewrites.unary_recombinant_pushed(marked, edges, muts, 10).collect()} == {(1, 4), (2, 1)}


def test_markers_and_trim(spark):
    nodes, edges = tree(spark, COMB, {0, 1, 2, 3})
    marked = nodes.selectExpr("node_id", f"if(node_id in (4, 5), {fl.REVERSION_MARKER}, flags) as flags", "time")
    muts = resolved(spark, edges, [(1, 0, "T")])
    kept, flat = rewrites.markers_deleted(marked, edges, muts, 10)
    assert {(r.child, r.parent) for r in flat.collect()} == {(i, 6) for i in range(4)} and kept.count() == 5
    samples = spark.createDataFrame([(i,) for i in range(4)], "node bigint")
    trimmed = rewrites.branches_trimmed(edges, resolved(spark, edges, [(1, 5, "T")]), samples, 10)
    assert {(r.child, r.parent) for r in trimmed.collect()} == {(0, 6), (1, 5), (2, 5), (3, 5), (5, 6)}


def parents_by_place(muts):
    """(position, node) of each mutation to that of its parent, whatever the ids."""
    rows = muts.collect()
    at = {r.mutation_id: (r.position, r.node) for r in rows}
    assert all(r.parent == -1 or r.parent in at for r in rows), "a parent that is gone"
    return {(r.position, r.node): at.get(r.parent) for r in rows}


def test_parents_follow_what_is_taken_away(spark):
    """Chains of reversions above each other: parents equal those found anew on the rewritten graph."""
    chain = [(9, 0), (9, 1), (10, 2), (10, 9), (11, 3), (11, 10), (12, 4), (12, 11), (13, 5), (13, 12), (14, 6), (14, 13)]
    nodes, edges = tree(spark, chain, {0, 1, 2, 3, 4, 5, 6})
    states = {1: [(13, "T"), (12, "A"), (11, "T"), (10, "A"), (9, "T"), (0, "G"), (1, "C")], 2: [(13, "G"), (11, "A"), (9, "G"), (0, "A")], 3: [(12, "T"), (9, "A"), (1, "T")]}
    muts = resolved(spark, edges, [(p, u, s) for p, rows in states.items() for u, s in rows])
    for _ in range(3):
        before = {tuple(r) for r in matching.differing_states(nodes.selectExpr("node_id as node").where("node < 7"), muts, graph.closure(edges), sites_of(spark)).collect()}
        nodes, edges, muts = rewrites.reversions_pushed(nodes, edges, muts, 10)
        after = {tuple(r) for r in matching.differing_states(nodes.selectExpr("node_id as node").where("node < 7"), muts, graph.closure(edges), sites_of(spark)).collect()}
        again = mutations.resolved(muts.select("position", "node", "derived_state"), sites_of(spark), graph.closure(edges))
        assert before == after and parents_by_place(muts) == parents_by_place(again)


def test_fixpoint(spark):
    """Rounds end, no mutation is gained, leaves keep their states, parents are right, and another run changes nothing."""
    import random

    rng = random.Random(3)
    pairs = [(p, c) for c, p in ((c, 12 + c // 3) for c in range(12))] + [(16 + (c - 12) // 2, c) for c in range(12, 16)] + [(18, 16), (18, 17)]
    nodes, edges = tree(spark, pairs, set(range(12)))
    raw = sorted({(p, u): (p, u, rng.choice("ACGT")) for p in range(1, 8) for u in range(18) if rng.random() < 0.5}.values())
    muts = resolved(spark, edges, raw)
    asked = spark.createDataFrame([(i,) for i in range(12)], "node bigint")
    carried_by = lambda e, m: {tuple(r) for r in matching.differing_states(asked, m, graph.closure(e), sites_of(spark)).collect()}
    n, e, m, report = rewrites.parsimony_fixpoint(nodes, edges, muts, 10)
    assert [r["op"] for r in report][0] == "noop" and len(report) > 2 and carried_by(e, m) == carried_by(edges, muts)
    assert all(a["mutations"] > b["mutations"] and a["nodes"] < b["nodes"] for a, b in zip(report, report[1:], strict=False))
    assert report[-1]["mutations"] == m.count() and report[-1]["min_edge_time"] > 0
    again = mutations.resolved(m.select("position", "node", "derived_state"), sites_of(spark), graph.closure(e))
    assert parents_by_place(m) == parents_by_place(again)
    # Joining is done before pushing; pushing alone finds no more.
    assert len(rewrites.parsimony_fixpoint(n, e, m, 10, coalesce=False)[3]) == 1
    assert len(rewrites.parsimony_fixpoint(nodes, edges, muts, 10, coalesce=False, push=False)[3]) == 1
