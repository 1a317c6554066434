"""Label inventories, naming and the empty-map check."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from instqc.schemas import UNKNOWN, UNKNOWN_RANK


def inventory(voxels: DataFrame) -> DataFrame:
    """(case_id, label, voxel_count) for every label of every case."""
    return voxels.groupBy("case_id", "label").agg(F.count(F.lit(1)).alias("voxel_count"))


def with_levels(df: DataFrame, levels: DataFrame) -> DataFrame:
    """Adds level_name, rank and grp of ``label``; unmapped labels are "unknown"."""
    named = df.join(F.broadcast(levels), "label", "left")
    return named.withColumn("level_name", F.coalesce("level_name", F.lit(UNKNOWN)))


def labels_by_name(names: DataFrame, levels: DataFrame, name: str = "name") -> DataFrame:
    """Label values of level names, ignoring case and outer blanks."""
    key = F.upper(F.trim(F.col(name)))
    table = levels.select(F.upper(F.trim("level_name")).alias("_key"), "label")
    return names.withColumn("_key", key).join(F.broadcast(table), "_key", "left").drop("_key")


def canonical_position(rank: str = "rank"):
    """Sort column of the head-to-tail order; names outside it come last."""
    return F.coalesce(F.col(rank), F.lit(UNKNOWN_RANK))


def summarise(voxels: DataFrame, levels: DataFrame) -> DataFrame:
    """Inventory with names, and the position by which head_to_tail sorts it."""
    named = with_levels(inventory(voxels), levels)
    recognised = F.col("level_name") != UNKNOWN
    return named.select(
        "case_id", "label", "level_name", "voxel_count",
        recognised.alias("recognised"),
        canonical_position().alias("position"),
    )


def head_to_tail(summary: DataFrame) -> DataFrame:
    """The summary in order, for a sink: recognised labels head to tail, then unknown ones."""
    return summary.orderBy("case_id", F.desc("recognised"), "position", "level_name", "label")


def name_clashes(levels: DataFrame) -> DataFrame:
    """Names of a convention that more than one label value maps to."""
    return (
        levels.groupBy(F.upper(F.trim("level_name")).alias("name"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("first_label"), F.max("label").alias("last_label"))
        .filter("n > 1")
    )


def check_empty(grids: DataFrame, counts: DataFrame, config: dict[str, Any]) -> DataFrame:
    """Empty and near-empty maps, from the inventory (or any table with its columns).

    Driven by ``grids``, since a case without foreground has no voxel row.
    """
    per_case = counts.groupBy("case_id").agg(
        F.sum("voxel_count").alias("foreground"), F.count("label").alias("label_count")
    )
    counted = grids.select("case_id").join(per_case, "case_id", "left").select(
        "case_id",
        F.coalesce("foreground", F.lit(0)).alias("foreground"),
        F.coalesce("label_count", F.lit(0)).alias("label_count"),
    )
    fewest_voxels, fewest_labels = config["min_foreground_voxels"], config["min_label_count"]
    fg, labels = F.col("foreground"), F.col("label_count")
    reasons = [
        F.when(fg == 0, "No foreground voxels found (empty label map)."),
        F.when(
            (fg > 0) & (F.lit(fewest_voxels) > 0) & (fg < fewest_voxels),
            F.format_string(
                "Foreground voxel count %d is below the minimum %d.", fg, F.lit(fewest_voxels)
            ),
        ),
        F.when(
            (F.lit(fewest_labels) > 0) & (labels < fewest_labels),
            F.format_string(
                "Distinct label count %d is below the minimum %d.", labels, F.lit(fewest_labels)
            ),
        ),
    ]
    return counted.withColumn("reasons", F.array_compact(F.array(*reasons))).withColumn(
        "is_empty", F.size("reasons") > 0
    )
