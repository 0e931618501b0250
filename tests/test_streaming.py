"""Streams over small folders of files."""

from pyspark.sql import functions as F

from strandlake.operators.match_store import MatchStore
from strandlake.streaming import daily

SCHEMA = "sample_id string, match_date date, match_time timestamp, hmm_cost double"


def matches(spark, rows):
    return spark.createDataFrame(rows, "sample_id string, day string, hmm_cost double").select("sample_id", F.col("day").cast("date").alias("match_date"), F.col("day").cast("timestamp").alias("match_time"), "hmm_cost")


def test_store_keeps_each_sample_once(spark, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    for rows in ([("a", "2020-01-01", 0.0), ("a", "2020-01-01", 0.0), ("b", "2020-01-02", 7.0)], [("b", "2020-01-02", 7.0), ("c", "2020-01-02", 1.0)]):
        matches(spark, rows).coalesce(1).write.mode("append").parquet(source)
        daily.keep_matches(spark.readStream.schema(SCHEMA).parquet(source), store, str(tmp_path / "state")).awaitTermination()
    assert sorted(r.sample_id for r in MatchStore(spark, store).read().collect()) == ["a", "b", "c"]


def test_daily_counts(spark, tmp_path):
    source = str(tmp_path / "in")
    matches(spark, [("a", "2020-01-01", 0.0), ("b", "2020-01-02", 7.0), ("c", "2020-01-02", 1.0)]).write.parquet(source)
    stream = daily.daily_counts(spark.readStream.schema(SCHEMA).parquet(source))
    stream.writeStream.outputMode("complete").format("memory").queryName("daily").trigger(availableNow=True).start().awaitTermination()
    got = {str(r.day): (r.total, r.exact, r.rejected) for r in spark.table("daily").collect()}
    assert got == {"2020-01-01": (1, 1, 0), "2020-01-02": (2, 0, 1)}
