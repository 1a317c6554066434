"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from instqc.llm.common import attach, carried, n_words, size_class, with_position
from instqc.session import cut_lineage

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)


def targets(sizes: DataFrame, total_share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Target size of each source: (source, source_size, weight, target).

    Sources by code point, null last, weigh 5, 2, 1 and so on and share
    ``total_share`` times the sum of all sizes. A target stops at ``most``
    times its source's size; what is left over is shared again by weight.
    The level at which this comes to rest is found in one pass: sources by
    falling weight per size fill up first, so each source is full exactly if
    it would be full with all those before it full too. ``sizes`` has one row
    per source; the sources are assumed to be few enough for one task.
    """
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sizes.withColumn("_rank", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("_rank") % len(WEIGHTS) + 1).cast("int"))
    weighed = ranked.withColumn("weight", weight.cast("long")).withColumn("_cap", F.col("source_size") * F.lit(most))
    filling = everything.orderBy(F.col("_cap") / F.col("weight"), "_rank")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    onward = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    budget = F.sum("source_size").over(everything) * F.lit(total_share)
    level = (budget - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    # The first source that does not fill up sets the level for itself and all that follow.
    open_level = F.first(F.when(F.col("weight") * F.col("_level") < F.col("_cap"), F.col("_level")), ignorenulls=True).over(
        filling.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        weighed.withColumn("_level", level)
        .withColumn("_open", open_level)
        .withColumn("target", F.coalesce(F.least("_cap", F.col("weight") * F.col("_open")), F.col("_cap")))
        .select("source", "source_size", "weight", "target")
    )


def expected_copies(sized: DataFrame) -> DataFrame:
    """Rows of (doc_id, source, _size) with the size and target of their source and the copies that the mix takes.

    Sizes are numbers of words (null text: 0). In each source documents stand
    in the order of size class, then of the hash of their id; each is expected
    ``target / source_size`` times, these shares are summed in that order, and
    with one offset per source added the document is taken once per integer
    that its stretch of the sum crosses. As neighbours are of like size, the
    words taken come near the target; as no share is above 2, neither are the
    copies. The offset is a hash of the source, so reruns agree. A source of
    size 0 has target 0 and its documents, like all without words, count for
    0 words; they are still taken at the rate of their source. Null ids stand
    in the place of the empty string. Rows alike in every column that matters
    are interchangeable. Adds _source_size, _target and _copies, among others
    that start with "_"; a caller's own columns come as one, ``_row``.
    """
    sized = sized.withColumns({"_key": F.coalesce(F.concat(F.lit("="), "source"), F.lit("")), "_class": size_class(F.col("_size"))})
    sizes = sized.groupBy("source").agg(F.sum("_size").alias("source_size"))
    goals = targets(sizes).select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_key"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("_rate"),
        (F.conv(F.substring(F.md5(F.coalesce("source", F.lit(""))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)).alias("_offset"),
    )
    placed = with_position(sized, ["_key"], ["_class"], ["doc_id", "_size"], sized.count())
    joined = attach(placed, goals, ["_key"], ["_position"])
    up_to = lambda k: F.floor(F.col("_rate") * k + F.col("_offset"))
    return joined.withColumn("_copies", (up_to(F.col("_position") + 1) - up_to(F.col("_position"))).cast("long"))


def mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus: each document as often as it is taken, columns as given, whatever their names."""
    sized = docs.select(carried(docs), "doc_id", "source", n_words(F.col("text")).alias("_size"))
    taken = expected_copies(sized).filter("_copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")


def mixing_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of every document."""
    sized = cut_lineage(docs.select("doc_id", "source", n_words(F.col("text")).alias("_size")))
    return expected_copies(sized).select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"),
    )
