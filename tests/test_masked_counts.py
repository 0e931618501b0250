"""Letter counts after the masks: hand-made sequences, and SQL."""

import os

import duckdb
import pytest

from strandlake.plans import catalogue
from strandlake.plans.fixture import Fixture

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_masked_counts(spark):
    f = Fixture(spark, DIR)
    f.sequences = spark.createDataFrame([(1, "--A-RT-"), (2, "---"), (3, ""), (4, "AN-C")], "doc_id bigint, letters string")
    assert {tuple(r) for r in catalogue.alignment_composition_masked(f).collect()} == {("N", 7, 3), ("A", 2, 2), ("-", 2, 2), ("R", 1, 1), ("T", 1, 1), ("C", 1, 1)}
    assert {tuple(r) for r in catalogue.missing_deletion_counts_masked(f).collect()} == {(1, 4, 1), (2, 3, 0), (3, 0, 0), (4, 1, 1)}
    assert {tuple(r) for r in catalogue.site_missing_deletion_counts(f).collect()} == {(1, 2, 0), (2, 3, 0), (3, 1, 1), (4, 0, 1), (5, 1, 0), (7, 1, 0)}


@pytest.mark.parametrize("name", ["alignment_composition_masked", "missing_deletion_counts_masked", "site_missing_deletion_counts"])
def test_masked_equal_to_sql(spark, name):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{DIR}/documents.parquet'")
    got, want = catalogue.QUERIES[name](spark, DIR), c.sql(catalogue.ORACLE_SQL[name])
    assert sorted(tuple(r) for r in got.select(*want.columns).collect()) == sorted(want.fetchall())
