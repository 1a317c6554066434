"""Reference distributions: long features, strata and per-level statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from instqc.functions.quantiles import cumulative, interpolated, order_statistics, value_counts
from instqc.operators.geometry import size_proxy
from instqc.operators.intensity import STATISTICS

SCHEMA_VERSION = "1.2"
ALL = "all"
PERCENTILES = (1, 5, 25, 50, 75, 95, 99)
GEOMETRY = ("physical_volume_mm3", "extent_x_mm", "extent_y_mm", "extent_z_mm", "curve_offset_mm")
INTENSITY = tuple(f"intensity_{name}" for name in STATISTICS)
MORPHOLOGY = ("largest_component_fraction", "component_count", "eigenvalue_ratio")
CELL = ["level_name", "stratum", "feature"]


def feature_long(wide: DataFrame) -> DataFrame:
    """(case_id, label, level_name, feature, value) from a wide label table.

    Takes whichever tracked features ``wide`` has; NULL values and unknown
    labels are left out.
    """
    tracked = [c for c in (*GEOMETRY, *INTENSITY, *MORPHOLOGY) if c in wide.columns]
    known = wide.filter(F.col("rank").isNotNull()).select(
        "case_id", "label", "level_name", *[F.col(c).cast("double").alias(c) for c in tracked]
    )
    return known.unpivot(["case_id", "label", "level_name"], tracked, "feature", "value").filter(
        F.col("value").isNotNull()
    )


def observations(wide: DataFrame) -> DataFrame:
    """Long features with the size proxy of their case."""
    return feature_long(wide).join(size_proxy(wide), "case_id", "left").select(
        "case_id", "level_name", "size_proxy", "feature", "value"
    )


def skipped_labels(wide: DataFrame) -> DataFrame:
    """Unknown label values per case, ascending."""
    return (
        wide.filter(F.col("rank").isNull())
        .groupBy("case_id")
        .agg(F.sort_array(F.collect_set("label")).alias("skipped_labels"))
    )


def with_stratum(
    obs: DataFrame, edges: Sequence[float] | None = None, names: Sequence[str] | None = None
) -> DataFrame:
    """Adds the size stratum: how many edges are at or below the size proxy.

    Without edges everything is in stratum "all". A NULL proxy is an error
    when edges are given.
    """
    if edges is None:
        return obs.withColumn("stratum", F.lit(ALL))
    edges = sorted(edges)
    names = list(names) if names is not None else [f"s{i}" for i in range(len(edges) + 1)]
    if len(names) != len(edges) + 1:
        raise ValueError(f"{len(edges)} edges need {len(edges) + 1} stratum names, got {len(names)}")
    steps = F.array(*[F.lit(float(e)) for e in edges])
    bucket = F.size(F.filter(steps, lambda e: e <= F.col("size_proxy")))
    checked = F.when(
        F.col("size_proxy").isNull(),
        F.raise_error(F.lit("stratification needs a size proxy for every observation")).cast("string"),
    ).otherwise(F.element_at(F.array(*[F.lit(n) for n in names]), bucket + 1))
    return obs.withColumn("stratum", checked)


def aggregate_reference(
    obs: DataFrame, percentiles: Sequence[int] = PERCENTILES
) -> DataFrame:
    """Statistics per (level, stratum, feature) of stratified observations.

    The few groups each hold a share of the whole cohort, so values are
    counted first and ranked bucket by bucket; the sample std of a single
    observation is 0.
    """
    fractions = [p / 100.0 for p in percentiles]
    rows = cumulative(value_counts(obs, CELL, "value"), CELL)
    stats = rows.groupBy(*CELL, "n", "mean", "lo", "hi").agg(
        F.expr("sum(cnt * (value - mean) * (value - mean)) AS _ss"), *order_statistics(fractions)
    )
    pairs = ", ".join(f"{p}, {text}" for p, text in zip(percentiles, interpolated(fractions)))
    return stats.selectExpr(
        *CELL, "n", "mean", "coalesce(sqrt(try_divide(_ss, n - 1)), 0D) AS std",
        "lo AS min", "hi AS max", f"map({pairs}) AS pcts",
    )


def record_counts(obs: DataFrame) -> DataFrame:
    """Records per (level, stratum): distinct (case, level) pairs."""
    return (
        obs.select("case_id", "level_name", "stratum").distinct()
        .groupBy("level_name", "stratum").agg(F.count(F.lit(1)).alias("record_count"))
    )


def reference_meta(obs: DataFrame, percentiles: Sequence[int] = PERCENTILES, **provenance: str) -> DataFrame:
    """One row describing a reference: version, counts, strata and features."""
    row = obs.agg(
        F.count_distinct("case_id").alias("subject_count"),
        F.sort_array(F.collect_set("stratum")).alias("strata"),
        F.sort_array(F.collect_set("feature")).alias("features"),
    )
    return row.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), "subject_count", "strata", "features",
        F.array(*[F.lit(p) for p in percentiles]).alias("percentiles"),
        *[F.lit(v).alias(k) for k, v in provenance.items()],
    )
