"""The store of matches: Parquet by period, with a manifest that is committed last.

A write puts new files beside the old ones and then adds a manifest, which names the folders of every period. Readers follow the newest
manifest, so a write that fails before the commit leaves the store as it was, and any version can be brought back. Of two writers that
start from the same version one fails. Manifests grow with the number of periods and writes, not with the matches.
"""

from __future__ import annotations

import datetime
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class MatchStore:
    """Matches (sample_id, match_date and more columns) under root, one folder per period ("month" or "day") and write."""

    def __init__(self, spark: SparkSession, root: str, period: str = "month"):
        self.spark, self.root, self.period = spark, root.rstrip("/"), period
        self._format = {"month": "yyyy-MM", "day": "yyyy-MM-dd"}[period]
        self._jvm = spark._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- manifests ---

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """schema, periods (period to folders) and batches (stream to its last batch) of a version, by default the newest."""
        known = self.versions()
        if not known:
            return {"version": 0, "schema": None, "periods": {}, "batches": {}}
        version = known[-1] if version is None else version
        if version not in known:
            raise ValueError(f"no version {version}")
        stream = self._fs.open(self._path(f"{self.root}/manifests/{version:09d}.json"))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _commit(self, old: dict, **changed) -> int:
        new = {**old, **changed, "version": old["version"] + 1}
        target = self._path(f"{self.root}/manifests/{new['version']:09d}.json")
        draft = self._path(f"{self.root}/manifests/{uuid.uuid4().hex}.draft")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps(new, sort_keys=True).encode()))
        stream.close()
        conf = self.spark._jsc.hadoopConfiguration()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(target), none)  # fails if the version is there
        except Exception as e:
            self._fs.delete(draft, False)
            raise RuntimeError(f"version {new['version']} was written by somebody else") from e
        return new["version"]

    # --- reading ---

    def _rows(self, manifest: dict, periods=None) -> DataFrame:
        from pyspark.sql.types import StructType

        if not manifest["schema"]:
            raise ValueError("the store has no matches yet")
        schema = StructType.fromJson(manifest["schema"])
        folders = [f"{self.root}/data/{f}" for p, fs in sorted(manifest["periods"].items()) if periods is None or p in periods for f in fs]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.manifest(version))

    # --- writing ---

    def initialise(self) -> None:
        """An empty store; a store that is there already is an error."""
        if self.versions():
            raise ValueError("the store is there already")
        self._commit(self.manifest())

    def _written(self, rows: DataFrame) -> dict[str, str]:
        """rows in new files: period to folder."""
        name = uuid.uuid4().hex
        place = self._path(f"{self.root}/data/{name}")
        dealt = rows.withColumn("period", F.date_format("match_date", self._format)).repartition("period")
        dealt.write.partitionBy("period").parquet(str(place))
        periods = [s.getPath().getName().split("=", 1)[1] for s in self._fs.listStatus(place) if s.isDirectory()]
        if "__HIVE_DEFAULT_PARTITION__" in periods:
            self._fs.delete(place, True)
            raise ValueError("matches without a date")
        return {p: f"{name}/period={p}" for p in periods}

    def add(self, matches: DataFrame, stream: str | None = None, batch: int | None = None) -> int:
        """Adds matches; a sample that the store has on the same date already, or a repeated row of it, is left out. The version after it.

        stream, batch: a batch of a stream that was added before is left out, so that one which runs again adds nothing.
        """
        old = self.manifest()
        if stream is not None and old["batches"].get(stream, -1) >= batch:
            return old["version"]
        rows = matches.dropDuplicates(["sample_id", "match_date"])
        if old["schema"] and old["periods"]:
            dates = [r.p for r in matches.select(F.date_format("match_date", self._format).alias("p")).distinct().collect()]  # periods of the batch
            there = self._rows(old, set(dates)).select("sample_id", "match_date")
            rows = rows.join(there, ["sample_id", "match_date"], "left_anti").select(*matches.columns)
        folders = self._written(rows)
        periods = {p: [*old["periods"].get(p, []), *([folders[p]] if p in folders else [])] for p in old["periods"].keys() | folders.keys()}
        batches = old["batches"] | ({stream: batch} if stream is not None else {})
        schema = old["schema"] or json.loads(matches.schema.json())
        return self._commit(old, periods=periods, batches=batches, schema=schema)

    def replace_periods(self, matches: DataFrame) -> int:
        """Every period that has rows in matches holds just these from now on; others stay."""
        old = self.manifest()
        folders = self._written(matches.dropDuplicates(["sample_id", "match_date"]))
        return self._commit(old, periods=old["periods"] | {p: [f] for p, f in folders.items()}, schema=old["schema"] or json.loads(matches.schema.json()))

    def delete_newer(self, date: str) -> int:
        """Takes matches after a date out of the store. Only the period of that date is written anew."""
        old = self.manifest()
        edge = datetime.date.fromisoformat(date).strftime({"month": "%Y-%m", "day": "%Y-%m-%d"}[self.period])
        periods = {p: f for p, f in old["periods"].items() if p < edge}
        if edge in old["periods"]:
            left = self._rows(old, {edge}).where(F.col("match_date") <= F.lit(date).cast("date"))
            periods |= {p: [f] for p, f in self._written(left).items()}
        return self._commit(old, periods=periods)

    def rollback(self, version: int) -> int:
        """The store as it was in a version, as a new version."""
        then = self.manifest(version)
        return self._commit(self.manifest(), periods=then["periods"], batches=then["batches"], schema=then["schema"])

    def vacuum(self, keep: int = 1) -> int:
        """Deletes manifests before the last `keep` and folders that no kept one names; how many folders went. No writer may be at work."""
        kept = self.versions()[-keep:]
        named = {f.split("/")[0] for v in kept for fs in self.manifest(v)["periods"].values() for f in fs}
        gone = 0
        place = self._path(f"{self.root}/data")
        for s in self._fs.listStatus(place) if self._fs.exists(place) else []:
            if s.getPath().getName() not in named:
                gone += bool(self._fs.delete(s.getPath(), True))
        for v in self.versions():
            if v not in kept:
                self._fs.delete(self._path(f"{self.root}/manifests/{v:09d}.json"), False)
        return gone
