"""The fixture holds whole tables, and paths over it equal walks edge by edge."""

import os

import pyarrow.parquet as pq

from strandlake.plans import catalogue
from strandlake.plans.fixture import Fixture

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_whole_tables_are_complete(spark):
    f = Fixture(spark, DIR)
    size = len(pq.read_table(f"{DIR}/customer.parquet", columns=["c_custkey"]))
    lines = pq.read_table(f"{DIR}/lineitem.parquet", columns=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]).to_pylist()
    least = {}
    for r in lines:
        at, k = (r["l_partkey"] + 1, 1 + r["l_orderkey"] % (size - 1)), r["l_linenumber"] + r["l_suppkey"]
        least[at] = min(k, least.get(at, k))
    assert {(r.position, r.node): r.derived_state for r in f.raw.collect()} == {at: "ACGT-"[k % 5] for at, k in least.items()}
    edges = [(r.left, r.right, r.parent, r.child) for r in f.edges.collect()]
    starts = sorted({e[0] for e in edges} | {e[1] for e in edges})[:-1]
    want = set()
    for tl in starts:
        up = {c: p for left, right, p, c in edges if left <= tl < right}
        for node in up:
            a, depth = up[node], 1
            while a is not None:
                want.add((tl, node, a, depth))
                a, depth = up.get(a), depth + 1
    got = {(r.tree_left, r.node, r.ancestor, r.depth) for r in catalogue.QUERIES["root_path"](spark, DIR).collect()}
    assert got == want
