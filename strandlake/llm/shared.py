"""Tables written to the folder that all executors share, to cut lineage and to read a result more than once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); where that is unset, a temporary one on a single machine, an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def table(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read back; the files hold the only copy that later steps use."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    # A finished table needs its shuffles no longer; without this they stay until the driver collects its garbage.
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def drop(df: DataFrame | None) -> None:
    """Delete the files of a table() that no later step reads."""
    path = getattr(df, "_shared_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


def slices(batch: pa.RecordBatch, column: int, most: int, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about so many bytes of the text column, and at most so many rows; a longer text is a slice of its own."""
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)) // most
    cuts = np.flatnonzero((np.diff(total) > 0) | (np.arange(1, batch.num_rows) % rows == 0)) + 1 if batch.num_rows else []
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        if b > a:
            yield batch.slice(a, b - a)
            pa.default_memory_pool().release_unused()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
