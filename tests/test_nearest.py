"""Nearest mutations above: against a walk up the tree, and how many ancestors travel for it."""

import random

from strandlake.operators import graph, mutations

SCHEMA = "position bigint, node bigint, derived_state string"


def test_chains_of_mutations_that_change_nothing(spark):
    """Long chains at one position, mostly of the state that is there already, on a graph of two trees."""
    rng = random.Random(4)
    up = {t: {c: rng.randrange(max(0, c - 2), c) for c in range(1, 60)} for t in (0, 50)}
    edges = spark.createDataFrame([(t, t + 50, p, c) for t in up for c, p in up[t].items()], "left bigint, right bigint, parent bigint, child bigint")
    raw = {(p, c): rng.choice("AAAT") for p in range(1, 100, 9) for c in rng.sample(range(1, 60), 45)}
    sites = spark.createDataFrame([(p, "A") for p in range(100)], "position bigint, ancestral_state string")
    want, inherited = {}, {}
    above = lambda p, c, rows: next((x for x in iter(lambda: up[p // 50 * 50].get(above.at), None) if not setattr(above, "at", x) and (p, x) in rows), None)
    for p, c in raw:
        above.at = c
        inherited[p, c] = raw.get((p, above(p, c, raw)), "A")
    named = {k: i for i, k in enumerate(sorted(k for k in raw if raw[k] != inherited[k]))}
    for p, c in named:
        above.at = c
        want[named[p, c], p, c] = (named.get((p, above(p, c, named)), -1), inherited[p, c], raw[p, c])
    got = mutations.resolved(spark.createDataFrame([(*k, s) for k, s in raw.items()], SCHEMA), sites, graph.closure(edges)).collect()
    assert {(r.mutation_id, r.position, r.node): (r.parent, r.inherited_state, r.derived_state) for r in got} == want
    assert any(v[0] >= 0 for v in want.values()) and len(want) < len(raw) / 2


def test_ancestors_without_a_mutation_there_do_not_travel(spark):
    """A path of 200 nodes with one mutation each at a position of its own: before, all 19900 pairs went on to meet the mutations."""
    edges = spark.createDataFrame([(0, 1000, c - 1, c) for c in range(1, 201)], "left bigint, right bigint, parent bigint, child bigint")
    rows = spark.createDataFrame([(c, c, "T") for c in range(1, 201)], "position bigint, node bigint, value string")
    assert mutations._fetched(rows, graph.closure(edges), rows).count() < 400
