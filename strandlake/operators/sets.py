"""Sets of whole numbers (sites, samples) as bitmaps: one binary value per set and bucket of 32768 numbers, built and joined by Spark's bitmap aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bitmaps(members: DataFrame, name: str, element: str) -> DataFrame:
    """members: one row per element (0 or more) of a named set, repeated or not. name, bucket, bits. Null elements are left out."""
    number = F.col(element).cast("bigint") + 1  # buckets begin at 1
    placed = members.where(F.col(element).isNotNull()).select(name, F.bitmap_bucket_number(number).alias("bucket"), F.bitmap_bit_position(number).alias("place"))
    return placed.groupBy(name, "bucket").agg(F.bitmap_construct_agg("place").alias("bits"))


def united(sets: DataFrame, by: list[str]) -> DataFrame:
    """Unions of all sets of the same `by`: by, bucket, bits."""
    return sets.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def counted(sets: DataFrame, name: str) -> DataFrame:
    """name, size."""
    return sets.groupBy(name).agg(F.sum(F.bitmap_count("bits")).alias("size"))


def compared(sets: DataFrame, name: str) -> DataFrame:
    """name_a, name_b (a before b), in_a, in_b, in_both, in_either, only_a, only_b of each pair of sets that share a bucket.

    Each pair costs two bitmaps a bucket, whatever the number of elements. The union is an aggregate of both; the rest follows from counts.
    """
    sizes = counted(sets, name)
    a = sets.select(F.col(name).alias("name_a"), "bucket", F.col("bits").alias("bits_a"))
    b = sets.select(F.col(name).alias("name_b"), "bucket", F.col("bits").alias("bits_b"))
    met = a.join(b, "bucket").where("name_a < name_b").select("name_a", "name_b", "bucket", F.explode(F.array("bits_a", "bits_b")).alias("bits"))
    joint = met.groupBy("name_a", "name_b", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("either"), F.sum(F.bitmap_count("bits")).alias("each"))
    both = joint.groupBy("name_a", "name_b").agg(F.sum(F.col("each") - F.col("either")).alias("in_both"))
    full = both.join(sizes.toDF("name_a", "in_a"), "name_a").join(sizes.toDF("name_b", "in_b"), "name_b")
    return full.select("name_a", "name_b", "in_a", "in_b", "in_both", (F.col("in_a") + F.col("in_b") - F.col("in_both")).alias("in_either"), (F.col("in_a") - F.col("in_both")).alias("only_a"), (F.col("in_b") - F.col("in_both")).alias("only_b"))
