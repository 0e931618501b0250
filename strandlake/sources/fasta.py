"""FASTA as a source and a sink, on Spark's own text reader: records begin with ">" at the start of a line, so large files are read in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_fasta(spark: SparkSession, paths: str | list[str], pad: str = "") -> DataFrame:
    """sample_id (the header up to white space), sequence (upper case, line breaks removed, after pad).

    A ">" within a line is a letter like any other. Records without a header are left out; an empty sequence stays an empty text.
    """
    rows = spark.read.option("lineSep", "\n>").text(paths)
    # Only the first record of a file still has its ">".
    records = rows.select(F.regexp_replace("value", "^\\s*>", "").alias("value"))
    head = F.substring_index("value", "\n", 1)
    sample = F.regexp_extract(head, r"^(\S+)", 1)
    body = F.when(F.instr("value", "\n") > 0, F.expr("substr(value, instr(value, '\n') + 1)")).otherwise("")
    return records.select(sample.alias("sample_id"), F.concat(F.lit(pad), F.upper(F.regexp_replace(body, r"\s", ""))).alias("sequence")).where("sample_id <> ''")


def write_fasta(sequences: DataFrame, path: str, sample_id: Column | str = "sample_id", sequence: Column | str = "sequence") -> None:
    sequences.select(F.concat(F.lit(">"), sample_id, F.lit("\n"), sequence).alias("value")).write.text(path)
