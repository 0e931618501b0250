"""Mixing sources to target weights along a time-varying curriculum, in DataFrame functions only.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share `budget` times all words. No target exceeds
`limit` times the words of its source; what is above is reshared by weight until none is. That is one water level: the least level
at which the sum of least(weight * level, limit * size) fills the budget, found by running sums over the table of sources.

Choice: every source takes whole passes over its documents, then the rest of its target in the order of a hash of doc_id. The
running words of that order are sums in two steps (over hash buckets, then within a bucket), so no source is ever in one task.

Position: the weight of a source changes linearly over the training time 0..1; its integral is the source's demand up to then.
Inverting it at a document's running words (a repeat: beyond those of whole passes) gives the time at which it is due; uses are range-sorted by that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.shared import table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Slope of each weight's schedule: 1 + slope * (2 * time - 1) times the mean. Heavy sources early, light ones late.
SLOPES = (-0.5, 0.0, 0.5)
ROWS_A_BUCKET = 20_000


def _key() -> Column:
    return F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))


def _with_order(docs: DataFrame, names: list[str]) -> DataFrame:
    """The columns named of docs as one, __mix_row, so that no name can clash, and what the choice needs."""
    return docs.select(
        F.struct(*[F.col(c) for c in names]).alias("__mix_row"),
        F.col("doc_id"),
        F.col("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint").alias("__mix_size"),
        _key().alias("__mix_source"),
        F.conv(F.substr(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1), F.lit(15)), 16, 10).cast("bigint").alias("__mix_hash"),
    )


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = 1.5, limit: float = 2.0) -> DataFrame:
    """sizes: __mix_source, source, source_size. Returns them with weight index, target. One row per source goes through one window."""
    ordered = Window.orderBy(F.col("source").isNull(), "source")
    at = (F.row_number().over(ordered) - 1) % len(weights)
    weighed = sizes.select("*", at.alias("__mix_kind")).select("*", F.element_at(F.array(*map(F.lit, weights)), F.col("__mix_kind") + 1).cast("double").alias("__mix_weight"))
    cap = F.col("source_size") * F.lit(float(limit))
    all_words = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(budget))
    # In order of the level at which a source is full: what is left for a source and all fuller ones, by weight.
    full = Window.orderBy(cap / F.col("__mix_weight"), "__mix_source")
    below = F.coalesce(F.sum(cap).over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    above = F.sum("__mix_weight").over(full.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levels = weighed.select("*", ((all_words - below) / above).alias("__mix_level"), (cap / F.col("__mix_weight")).alias("__mix_full"))
    level = F.max(F.when(F.col("__mix_level") <= F.col("__mix_full"), F.col("__mix_level"))).over(Window.partitionBy())
    return levels.select("__mix_source", "source_size", "__mix_kind", F.least(cap, F.coalesce(F.col("__mix_weight") * level, cap)).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, slopes=SLOPES, budget: float = 1.5, limit: float = 2.0) -> DataFrame:
    """docs: doc_id, source, text and any more. Returns docs' columns and size, source_size, target, taken, position for every row.

    size: words of the text (null and empty: 0). taken: words that the mix takes, repeats counted, at most limit times size.
    position: training time of the row's first use, 0..1 (null if it is not taken). These replace columns of the same names; any other names may occur. Rows of equal doc_id are chosen together and
    share what is left for them in proportion; so reruns agree whatever the order of rows. An empty table gives an empty result.
    """
    return _placed(docs, weights, slopes, budget, limit).drop("__mix_share", "__mix_slope")


def _due(share: Column, slope: Column) -> Column:
    """Time at which a source's demand, t + slope * (t^2 - t) of the whole at time t, reaches the share."""
    share = F.least(F.lit(1.0), share)
    b = F.lit(1.0) - slope
    return F.greatest(F.lit(0.0), F.when(slope == 0, share).otherwise((-b + F.sqrt(b * b + 4 * slope * share)) / (2 * slope)))


def _placed(docs: DataFrame, weights=WEIGHTS, slopes=SLOPES, budget: float = 1.5, limit: float = 2.0) -> DataFrame:
    """What mix() returns, with the share of the source's target that is due before a row's first use, and its source's slope."""
    names = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken", "position")]
    rows = _with_order(docs, names)
    sized = table(rows.select("source", "__mix_source", "__mix_hash", "__mix_size"), "sizes")
    count = sized.count()
    buckets = max(16, -(-count // ROWS_A_BUCKET))
    bucket = F.pmod(F.col("__mix_hash"), F.lit(buckets))
    cells = table(sized.groupBy("__mix_source", bucket.alias("__mix_bucket")).agg(F.first("source").alias("source"), F.sum("__mix_size").alias("__mix_cell")), "cells")
    targets = source_targets(cells.groupBy("__mix_source").agg(F.first("source").alias("source"), F.sum("__mix_cell").alias("source_size")), weights, budget, limit)
    inside = Window.partitionBy("__mix_source").orderBy("__mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    planned = (
        cells.select("__mix_source", "__mix_bucket", F.coalesce(F.sum("__mix_cell").over(inside), F.lit(0)).alias("__mix_before"))
        .join(targets, "__mix_source")
        .select("*", passes.alias("__mix_passes"))
        .select("*", (F.round("target").cast("bigint") - F.col("__mix_passes") * F.col("source_size")).alias("__mix_rest"))
    )
    slope = F.element_at(F.array(*map(F.lit, slopes)), F.col("__mix_kind") + 1)
    order = Window.partitionBy("__mix_source", "__mix_bucket").orderBy("__mix_hash")
    placed = rows.drop("doc_id", "source").withColumn("__mix_bucket", bucket).join(planned, ["__mix_source", "__mix_bucket"])
    placed = placed.select(
        "*",
        (F.col("__mix_before") + F.sum("__mix_size").over(order)).alias("__mix_until"),
        F.sum("__mix_size").over(order.rangeBetween(Window.currentRow, Window.currentRow)).alias("__mix_tied"),
    )
    left = F.col("__mix_rest") - (F.col("__mix_until") - F.col("__mix_tied"))
    extra = F.when(left >= F.col("__mix_tied"), F.col("__mix_size")).when(left <= 0, 0).otherwise(F.expr("__mix_size * (__mix_rest - __mix_until + __mix_tied) div __mix_tied"))
    placed = placed.select("*", (F.col("__mix_passes") * F.col("__mix_size") + extra).cast("bigint").alias("taken"))
    share = (F.col("__mix_until") - F.col("__mix_tied") / 2) / F.greatest(F.col("target"), F.lit(1.0))
    return placed.select(
        "__mix_row.*", F.col("__mix_size").alias("size"), "source_size", "target", "taken", F.when(F.col("taken") > 0, _due(share, slope)).alias("position"), share.alias("__mix_share"), slope.alias("__mix_slope")
    )


def _uses(placed: DataFrame) -> DataFrame:
    """A row for each use of each row of _placed(): its number copy, the words it takes, the time at which it is due. A row that is not
    taken keeps one, whose copy is null."""
    copies = F.when(F.col("taken") > 0, F.sequence(F.lit(0), F.expr("cast(ceil(taken / size) as int) - 1")))
    begun = F.col("copy") * (F.col("source_size") / F.greatest(F.col("target"), F.lit(1.0)))
    words = F.when(F.col("copy").isNotNull(), F.least("size", F.col("taken") - F.col("copy") * F.col("size"))).otherwise(F.lit(0).cast("bigint"))
    time = F.when(F.col("copy").isNotNull(), _due(F.col("__mix_share") + begun, F.col("__mix_slope")))
    return placed.select("*", F.explode_outer(copies).alias("copy")).select("*", words.alias("words"), time.alias("time"))


def schedule(docs: DataFrame, **settings) -> DataFrame:
    """docs: doc_id, source, text. The curriculum: doc_id, source, size, source_size, target, copy, words, time of each use of each row, range-sorted by
    the time at which it is due. Rows that are not taken come first, once, with null copy and time. An empty table gives an empty result; repeated
    rows have uses of their own; other columns, whatever their names, are ignored."""
    uses = _uses(_placed(docs.select("doc_id", "source", "text"), **settings))
    return uses.select("doc_id", "source", "size", "source_size", "target", "copy", "words", "time").orderBy("time", "doc_id")


def rows_of(uses: DataFrame) -> DataFrame:
    """uses: as of schedule(). Returns doc_id, source, size, source_size, target, taken (its uses' words), position (time of its first use) for
    every row that went into the schedule. Repeated rows are used alike, so they are told apart by their number only. Empty gives empty."""
    folded = uses.groupBy("doc_id", "source", "size", "source_size", "target").agg(F.sum("words").alias("words"), F.min("time").alias("position"), F.expr("cast(count_if(coalesce(copy, 0) = 0) as int)").alias("rows"))
    return folded.select("doc_id", "source", "size", "source_size", "target", F.expr("words div rows").alias("taken"), "position", F.explode(F.array_repeat(F.lit(0), F.col("rows"))).alias("row")).drop("row")


def training_order(docs: DataFrame, **settings) -> DataFrame:
    """docs as the mix takes them: once for each begun pass, range-sorted by the time at which each use is due. Columns as in docs.

    A document that is taken in part (those at the end of a source's target) has its text cut after the words that are taken, n_chars with it.
    Rows without words are not taken. An empty table gives an empty result; repeated rows are taken alike; other columns pass as they are.
    """
    whole = F.struct(*[F.col(c) for c in docs.columns]).alias("kept")
    mixed = _placed(docs.select(whole, "doc_id", "source", "text"), **settings).where("taken > 0")
    ordered = _uses(mixed).select("kept", "doc_id", "text", "size", "words", "time").orderBy("time", "doc_id")
    left = F.col("words")
    # Cut before each word: white space in front of the first word is a part of its own.
    words = F.split("text", r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    ahead = F.when(F.col("text").rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    cut = F.regexp_replace(F.array_join(F.slice(words, F.lit(1), (left + ahead).cast("int")), ""), r"[\x20\x09-\x0D]+$", "")
    text = F.when(left < F.col("size"), cut).otherwise(F.col("text"))
    changed = {"text": text} | ({"n_chars": F.when(left < F.col("size"), F.length(cut)).otherwise(F.col("kept.n_chars"))} if "n_chars" in docs.columns else {})
    return ordered.select(*[changed[c].cast(docs.schema[c].dataType).alias(c) if c in changed else F.col("kept").getField(c).alias(c) for c in docs.columns])
