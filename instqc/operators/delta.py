"""Comparison of cases with a reference distribution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from instqc.operators.reference import ALL, GEOMETRY, INTENSITY, MORPHOLOGY, PERCENTILES

IQR_TO_SIGMA = 1.349
FAMILIES = {"geometry": GEOMETRY, "intensity": INTENSITY, "morphology": MORPHOLOGY}


def percentile_rank(percentiles) -> str:
    """SQL of the piecewise-linear rank of ``value`` over (_min, 0), the stored
    percentiles, and (_max, 100).

    Clamped to [0, 100]; on a flat stretch the lower rank counts, so the first
    bracketing pair decides.
    """
    grid = [("_min", 0.0)] + [(f"pcts[{p}]", float(p)) for p in sorted(percentiles)] + [("_max", 100.0)]
    steps = " ".join(
        f"WHEN {v0} <= value AND value <= {v1} "
        f"THEN coalesce({r0!r}D + {r1 - r0!r}D * try_divide(value - {v0}, {v1} - {v0}), {r0!r}D)"
        for (v0, r0), (v1, r1) in zip(grid, grid[1:])
    )
    return f"CASE WHEN value <= _min THEN 0D WHEN value >= _max THEN 100D {steps} END"


def feature_deltas(
    features: DataFrame,
    reference: DataFrame,
    family: str = "geometry",
    stratum: str = ALL,
    lower_pct: int = 1,
    upper_pct: int = 99,
    percentiles=PERCENTILES,
) -> DataFrame:
    """z, robust z, percentile rank and out-of-range flag per tracked feature.

    ``features`` is long (case_id, label, level_name, feature, value); the
    reference table has a few hundred rows per stratum whatever the cohort.
    """
    for p in (lower_pct, upper_pct, 25, 50, 75):
        if p not in percentiles:
            raise ValueError(f"percentile {p} is not stored in the reference")
    side = reference.filter(F.col("stratum") == stratum).withColumnsRenamed(
        {"mean": "_mean", "std": "_std", "min": "_min", "max": "_max"}
    ).drop("n")
    joined = features.filter(F.col("feature").isin(*FAMILIES[family])).join(side, ["level_name", "feature"])
    return joined.selectExpr(
        "case_id", "label", "level_name", "stratum", "feature", "value",
        "IF(_std <> 0, try_divide(value - _mean, _std), NULL) AS z",
        f"try_divide(value - pcts[50], (pcts[75] - pcts[25]) / {IQR_TO_SIGMA!r}D) AS robust_z",
        f"{percentile_rank(percentiles)} AS pct_rank",
        f"value < pcts[{lower_pct}] OR value > pcts[{upper_pct}] AS out_of_range",
    )


def label_deltas(
    labels: DataFrame, deltas: DataFrame, reference: DataFrame, stratum: str = ALL
) -> DataFrame:
    """Per label: availability, distribution distance and out-of-range features.

    A label is available when the reference covers its level and stratum.
    """
    covered = reference.filter(F.col("stratum") == stratum).select("level_name").distinct().withColumn(
        "available", F.lit(True)
    )
    rolled = deltas.groupBy("case_id", "label").agg(
        F.sqrt(F.avg(F.col("robust_z") * F.col("robust_z"))).alias("distribution_distance"),
        F.array_sort(F.collect_set(F.when(F.col("out_of_range"), F.col("feature")))).alias("out_of_range_features"),
    )
    return (
        labels.select("case_id", "label", "level_name")
        .join(covered, "level_name", "left")
        .join(rolled, ["case_id", "label"], "left")
        .select(
            "case_id", "label", "level_name", F.lit(stratum).alias("stratum"),
            F.coalesce("available", F.lit(False)).alias("available"),
            "distribution_distance",
            F.coalesce("out_of_range_features", F.array().cast("array<string>")).alias("out_of_range_features"),
        )
    )
