"""The daily loop as streams: matches arrive as files, are kept once each, and are counted by day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandlake.operators.match_store import MatchStore


def daily_counts(matches: DataFrame, at: str = "match_time", late: str = "30 days") -> DataFrame:
    """A stream of matches (timestamp column at, hmm_cost) as day, total, exact, rejected; rows later than `late` are left out."""
    cost = F.col("hmm_cost")
    days = matches.withWatermark(at, late).groupBy(F.window(at, "1 day").alias("w"))
    return days.agg(F.count("*").alias("total"), F.count_if(cost == 0).alias("exact"), F.count_if(cost > 5).alias("rejected")).select(F.to_date("w.start").alias("day"), "total", "exact", "rejected")


def keep_matches(matches: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Add a stream of matches (sample_id, match_date, ...) to the match store at `store`, each sample of a date once; runs over what is there and stops.

    A batch that fails leaves the store as it was; one that runs again after it was committed adds nothing. Only the periods that a batch
    has rows of are read.
    """

    def add(batch: DataFrame, number: int) -> None:
        MatchStore(batch.sparkSession, store).add(batch, stream=checkpoint, batch=number)

    return matches.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
