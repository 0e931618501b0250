"""Registered queries against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

from strandlake.plans import attach_queries, catalogue, check_queries, parsimony_queries, report_queries, rewrite_queries, store_queries  # noqa: F401

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = ["marginal_trees", "node_data", "node_data_inheritance", "mutation_data", "mrca_pairs", "flags_summary", "breakpoint_intervals", "sample_groups", "daily_stats", "encode_alleles", "mask_flanks", "alignment_composition", "push_reversions_mutations", "coalesce_mutations", "recombinants_summary", "copying_table", "match_mutations", "variants_slice", "sample_groups_summary", "match_segments", "samples_kept", "shared_deletion_sites", "graph_invariants", "validate_genotypes"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order)) for r in values)


@pytest.mark.parametrize("name", QUICK)
def test_equal_to_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DIR)
    want = duck.sql(catalogue.ORACLE_SQL[name])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_each_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)
