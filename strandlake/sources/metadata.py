"""Sample metadata from tab-separated tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of whole numbers in which "." stands for no value.
COUNTS = ("Genbank_N", "Viridian_N", "Run_count", "Viridian_cons_len", "Viridian_cons_het")


def read_metadata(spark: SparkSession, path: str, key: str = "Run", clean: bool = False) -> DataFrame:
    """All columns as text, the key first and named sample_id; with clean, flags and counts get their types."""
    table = spark.read.csv(path, sep="\t", header=True)
    rest = [c for c in table.columns if c != key]
    out = table.select(F.col(key).alias("sample_id"), *rest)
    return cleaned(out) if clean else out


def cleaned(table: DataFrame) -> DataFrame:
    """Columns that begin with "In": T and F as booleans (anything else raises); COUNTS as int, "." as -1."""

    def column(name: str):
        c = F.col(name)
        if name.startswith("In"):
            return F.when(c == "T", True).when(c == "F", False).otherwise(F.raise_error(F.concat(F.lit(f"{name} is neither T nor F: "), F.coalesce(c, F.lit("null")))).cast("boolean")).alias(name)
        if name in COUNTS:
            return F.when(c == ".", -1).otherwise(c.try_cast("int")).alias(name)
        return c

    return table.select(*map(column, table.columns))
