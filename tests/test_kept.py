"""Selections of samples."""

from pyspark.sql import functions as F

from strandlake.functions import flags as fl
from strandlake.operators import matching


def test_samples_kept(spark):
    rows = spark.createDataFrame([("a", 5), ("b", 6), ("c", None), ("d", 900), (None, 1)], "sample_id string, missing bigint")
    asked = spark.createDataFrame([("d",), ("d",), ("c",), ("zz",)], "sample_id string")
    assert sorted((str(r.sample_id), r.included) for r in matching.samples_kept(rows, 5, asked).collect()) == [("None", False), ("a", False), ("c", True), ("d", True)]
    assert sorted(str(r.sample_id) for r in matching.samples_kept(rows, 5).collect()) == ["None", "a"]


def test_group_members_and_recombinants(spark):
    rows = [(f"S{i}", f"2021-01-0{1 + i % 3}", float(i % 2), None if i % 2 else 4) for i in range(8)] + [("lone", "2021-01-01", 3.0, 1), (None, "2021-01-01", 0.0, 4)]
    matches = spark.createDataFrame(rows, "sample_id string, day string, hmm_cost double, parent bigint").withColumn("match_date", F.col("day").cast("date"))
    got = matching.group_members(matches, 3, 2).collect()
    by = {}
    for r in got:
        by.setdefault(r.group_id, set()).add(r.sample_id)
    assert sorted(map(sorted, by.values())) == [["S0", "S2", "S4", "S6"], ["S1", "S3", "S5", "S7"]]
    nodes = spark.createDataFrame([(1, fl.RECOMBINANT), (2, 0)], "node_id bigint, flags int")
    tops = spark.createDataFrame([("g", 1), ("h", 2)], "group string, node_id bigint")
    members = spark.createDataFrame([("g", "x"), ("g", "y"), ("h", "z")], "group string, sample_id string")
    assert {tuple(r) for r in matching.recombinant_samples(nodes, tops, members).collect()} == {(1, "x"), (1, "y")}
