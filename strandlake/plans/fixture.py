"""A deterministic graph, samples, sequences and matches projected from the star-schema tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import flags as fl
from strandlake.operators import graph, mutations
from strandlake.plans.lineage import cut


@dataclass
class Fixture:
    """Lazily built tables; what several steps of one query share is written once."""

    spark: SparkSession
    sf_dir: str

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def length(self) -> int:
        return self.read("part").count() + 1

    @cached_property
    def size(self) -> int:
        return self.read("customer").count()

    @cached_property
    def nodes(self) -> DataFrame:
        i = F.col("c_custkey")
        recombinant = F.when((i >= 8) & (i % 29 == 7), fl.RECOMBINANT).otherwise(0)
        flags = F.when(i % 3 != 0, fl.SAMPLE).otherwise(0) + recombinant + F.when(i == 1, fl.REFERENCE).otherwise(0)
        return self.read("customer").select(i.alias("node_id"), flags.cast("int").alias("flags"), (F.lit(self.size - 1) - i).cast("double").alias("time"), F.concat(F.lit("S"), i.cast("string")).alias("sample_id"))

    @cached_property
    def edges(self) -> DataFrame:
        length, width = self.length, (self.length - 1) // 8
        i, up = F.col("node_id"), F.floor(F.col("node_id") / 2).cast("bigint")
        broken = (i >= 8) & (i % 29 == 7)
        at = F.lit(width) * (1 + i % 7)
        row = lambda left, right, parent: F.struct(left.cast("bigint").alias("left"), right.cast("bigint").alias("right"), parent.cast("bigint").alias("parent"))
        whole = F.array(row(F.lit(0), F.lit(length), F.when(i == 1, 0).otherwise(up)))
        split = F.array(row(F.lit(0), at, up), row(at, F.lit(length), up - 1))
        return self.nodes.where("node_id >= 1").select(F.explode(F.when(broken, split).otherwise(whole)).alias("e"), i.alias("child")).select("e.*", "child")

    @cached_property
    def sites(self) -> DataFrame:
        return self.read("part").select((F.col("p_partkey") + 1).alias("position"), F.substr(F.lit("ACGT"), F.col("p_size") % 4 + 1, F.lit(1)).alias("ancestral_state"))

    @cached_property
    def tree_edges(self) -> DataFrame:
        return graph.tree_edges(self.edges)

    @cached_property
    def closure(self) -> DataFrame:
        return graph.closure(self.edges)

    @cached_property
    def raw(self) -> DataFrame:
        rows = self.read("lineitem").groupBy((F.col("l_partkey") + 1).alias("position"), (1 + F.col("l_orderkey") % (self.size - 1)).alias("node")).agg(F.min(F.col("l_linenumber") + F.col("l_suppkey")).alias("k"))
        return rows.select("position", "node", F.substr(F.lit("ACGT-"), (F.col("k") % 5 + 1).cast("int"), F.lit(1)).alias("derived_state"))

    @cached_property
    def mutations(self) -> DataFrame:
        return cut(mutations.resolved(self.raw, self.sites, self.closure), "mutations")

    @cached_property
    def sample_counts(self) -> DataFrame:
        return graph.sample_counts(self.edges, self.nodes)

    @cached_property
    def samples(self) -> DataFrame:
        """Metadata of each customer: country, region, segment, first order date as the collection date (null without orders)."""
        dates = self.read("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min(F.to_date("o_orderdate")).alias("date"))
        customer = self.read("customer").join(F.broadcast(self.read("nation").join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))), F.col("c_nationkey") == F.col("n_nationkey"))
        return customer.join(dates, "c_custkey", "left").select(F.col("c_custkey").alias("node_id"), F.concat(F.lit("S"), F.col("c_custkey").cast("string")).alias("sample_id"), F.col("n_name").alias("country"), F.col("r_name").alias("region"), F.col("c_mktsegment").alias("segment"), "date")

    @cached_property
    def sequences(self) -> DataFrame:
        """Whole document texts as sequences: ASCII upper case, letters without an allele code as N."""
        text = F.translate(F.coalesce("text", F.lit("")), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        return self.read("documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.regexp_replace(text, r"(?s)[^ACGTRYSWKMBDHV.\-]", "N").alias("letters"))

    @cached_property
    def matches(self) -> DataFrame:
        return self.read("orders").select(F.concat(F.lit("S"), F.col("o_orderkey").cast("string")).alias("sample_id"), F.to_date("o_orderdate").alias("match_date"), (F.col("o_custkey") % 8).cast("double").alias("hmm_cost"), F.col("o_custkey").alias("parent"), F.col("o_orderstatus").alias("scorpio"))
