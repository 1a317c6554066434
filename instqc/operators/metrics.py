"""Scores over evaluated cases: outcomes, confusion, correlation, failure modes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from instqc.functions.quantiles import average_rank, cumulative, value_counts
from instqc.schemas import FLAG, severity_label, severity_of

# Failure modes.
FAILURE_MODES = {
    0: "clean control (no failure)",
    1: "label not aligned with the vertebra it names",
    2: "over-/under-segmentation (fused / fragmented)",
    3: "disconnected components / rogue islands",
    4: "semantic mislabelling (wrong identification)",
    5: "not all vertebrae segmented (missing levels)",
    6: "partial vertebra at the image border",
    7: "non-continuous label sequence",
    8: "overlapping segments",
}

# Metric of each mode with direction, baseline and full swing.
MODE_METRICS = {
    1: ("unanchored_foreground_fraction", "increases", 0.0, 1.0),
    2: ("min_dominant_component_fraction", "decreases", 1.0, 1.0),
    3: ("rogue_island_count", "increases", 0.0, None),
    4: ("mislabelled_volume_fraction", "increases", 0.0, 1.0),
    5: ("missing_level_count", "increases", 0.0, None),
    6: ("fov_clipped_label_count", "increases", 0.0, None),
    7: ("out_of_order_label_count", "increases", 0.0, None),
    8: ("overlapping_voxel_count", "increases", 0.0, None),
}


def mode_table(spark) -> DataFrame:
    """The eight failure modes: (mode, mode_name, metric, direction, baseline, scale)."""
    rows = ", ".join(
        f"({m}, '{FAILURE_MODES[m]}', '{name}', '{direction}', CAST({base} AS DOUBLE), CAST({'NULL' if swing is None else swing} AS DOUBLE))"
        for m, (name, direction, base, swing) in MODE_METRICS.items()
    )
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(mode, mode_name, metric, direction, baseline, scale)")


def designated(findings: DataFrame, expected: DataFrame) -> DataFrame:
    """Per case with findings: fired rules, and whether a designated one fired.

    A finding counts as designated when its rule is expected and, where labels
    are expected, it names one of them.
    """
    joined = findings.join(expected.select("case_id", "expected_rule_ids", "expected_labels"), "case_id")
    by_rule = F.array_contains("expected_rule_ids", F.col("rule_id"))
    by_label = (F.size("expected_labels") == 0) | F.arrays_overlap("labels", "expected_labels")
    return joined.groupBy("case_id").agg(
        F.array_sort(F.collect_set("rule_id")).alias("fired_rule_ids"),
        F.bool_or(by_rule).alias("designated_rule_fired"),
        F.bool_or(by_rule & by_label).alias("caught_by_designated_rule"),
    )


def outcomes(verdicts: DataFrame, expected: DataFrame, findings: DataFrame, positive: int = FLAG) -> DataFrame:
    """TP / FP / TN / FN per expected case, with how a failure was caught."""
    df = (
        expected.join(verdicts.select("case_id", "overall"), "case_id", "left")
        .join(designated(findings, expected), "case_id", "left")
    )
    failure = severity_of(F.col("expected_verdict")) >= positive
    flagged = F.coalesce(F.col("overall"), F.lit(0)) >= positive
    outcome = (
        F.when(failure & flagged, "TP").when(~failure & flagged, "FP").when(~failure, "TN").otherwise("FN")
    )
    no = F.lit(False)
    return df.select(
        "case_id", "expected_verdict", severity_label(F.coalesce("overall", F.lit(0))).alias("actual_verdict"),
        outcome.alias("outcome"), failure.alias("expected_failure"), flagged.alias("actual_flagged"),
        F.when(failure, flagged).alias("caught"),
        "failure_mode", "failure_mode_name",
        F.coalesce("fired_rule_ids", F.array().cast("array<string>")).alias("fired_rule_ids"),
        F.coalesce("designated_rule_fired", no).alias("designated_rule_fired"),
        F.coalesce("caught_by_designated_rule", no).alias("caught_by_designated_rule"),
    )


def confusion(outcome_rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts and rates; a rate without cases is NULL."""
    cell = lambda name: F.count_if(F.col("outcome") == name).alias(name.lower())
    rate = lambda top, *bottom: F.try_divide(F.col(top) * F.lit(1.0), sum((F.col(b) for b in bottom), F.lit(0)))
    df = outcome_rows.groupBy(*keys).agg(*[cell(n) for n in ("TP", "FP", "TN", "FN")], F.count(F.lit(1)).alias("n_cases"))
    return df.select(
        "*", rate("fp", "fp", "tn").alias("false_positive_rate"),
        rate("tp", "tp", "fn").alias("sensitivity"), rate("tn", "tn", "fp").alias("specificity"),
    )


def per_mode(
    outcome_rows: DataFrame, requested: Sequence[int] | Mapping[int, str] | None = None
) -> DataFrame:
    """Detection per failure mode over expected failures.

    Requested modes are all reported, also without cases; otherwise the
    observed ones are, a missing mode last.
    """
    seen = outcome_rows.filter("expected_failure").groupBy("failure_mode").agg(
        F.min("failure_mode_name").alias("failure_mode_name"),
        F.count(F.lit(1)).alias("n_cases"),
        F.count_if("caught").alias("n_caught"),
        F.count_if("caught_by_designated_rule").alias("n_caught_by_designated_rule"),
    )
    if requested is not None:
        names = requested if isinstance(requested, Mapping) else {m: None for m in requested}
        rows = ", ".join(
            f"({i}, {m}, {'NULL' if n is None else chr(39) + n.replace(chr(39), chr(39) * 2) + chr(39)})"
            for i, (m, n) in enumerate(names.items())
        )
        wanted = outcome_rows.sparkSession.sql(
            f"SELECT CAST(o AS INT) o, CAST(failure_mode AS INT) failure_mode, CAST(asked AS STRING) asked "
            f"FROM VALUES {rows} AS t(o, failure_mode, asked)"
        )
        seen = wanted.join(seen, "failure_mode", "left").withColumn(
            "failure_mode_name", F.coalesce("asked", "failure_mode_name")
        ).orderBy("o").drop("o", "asked")
        for c in ("n_cases", "n_caught", "n_caught_by_designated_rule"):
            seen = seen.withColumn(c, F.coalesce(c, F.lit(0)))
    else:
        seen = seen.orderBy(F.col("failure_mode").asc_nulls_last())
    return seen.select(
        "failure_mode", "failure_mode_name", "n_cases", "n_caught", "n_caught_by_designated_rule",
        F.try_divide(F.col("n_caught_by_designated_rule") * F.lit(1.0), F.col("n_cases")).alias("sensitivity"),
        F.try_divide(F.col("n_caught") * F.lit(1.0), F.col("n_cases")).alias("caught_rate"),
    )


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Adds the rank of ``value`` inside ``keys``, ties averaged.

    Ranks are computed on counted distinct values, so a binary flag over any
    number of cases costs two rows.
    """
    ranks = cumulative(value_counts(df, keys, value), keys).select(*keys, F.col("value").alias(value), average_rank().alias(name))
    return df.join(ranks, [*keys, value], "left")


def correlation(df: DataFrame, x: str, y: str, method: str = "pearson") -> DataFrame:
    """One row (coefficient, n): NULL below two pairs or without variance."""
    if method not in ("pearson", "spearman"):
        raise ValueError(f"unknown correlation method {method!r}")
    pairs = df.filter(F.col(x).isNotNull()).select(
        F.lit(0).alias("_g"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")
    )
    if method == "spearman":
        pairs = average_ranks(pairs, ["_g"], "_x", "_rx")
        pairs = average_ranks(pairs, ["_g"], "_y", "_ry")
        pairs = pairs.select(F.col("_rx").alias("_x"), F.col("_ry").alias("_y"))
    spread = F.stddev_pop("_x") * F.stddev_pop("_y")
    return pairs.agg(
        F.when(F.count(F.lit(1)) >= 2, F.try_divide(F.covar_pop("_x", "_y"), spread)).alias("coefficient"),
        F.count(F.lit(1)).alias("n"),
    ).withColumn("method", F.lit(method))
