"""Threshold calibration on features computed once.

Every axis is a threshold on a per-case maximum, so a case only matters by
which thresholds it exceeds. Cases are first counted by these positions; the
table of counts is bounded by the grid, not by the cohort, and only it meets
the grid of settings.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_GRID = 512


@dataclass(frozen=True)
class Axis:
    """A swept threshold.

    ``metric`` names the case column holding the largest value of the rule's
    quantity; ``designated`` the same over findings that would count as
    designated. The rule fires when the value is at (``inclusive``) or above
    the threshold.
    """

    name: str
    metric: str
    designated: str
    values: tuple[float, ...]
    inclusive: bool = True


# The default sweep.
DEFAULT_AXES = (
    Axis("reference_delta.max_robust_z", "robust_z", "robust_z_designated", (2.5, 3.0, 3.5, 4.0, 4.5)),
    Axis("reference_delta.max_distribution_distance", "distance", "distance_designated", (2.0, 2.5, 3.0, 3.5, 4.0)),
    Axis("bounds.lumbar.max_volume_mm3", "lumbar_volume", "lumbar_volume_designated",
         (90000.0, 105000.0, 120000.0, 135000.0, 150000.0), False),
)


def grid_of(axes: Sequence[Axis], max_size: int = MAX_GRID) -> list[tuple[int, ...]]:
    """Positions into the axes' values, the last axis varying fastest."""
    size = 1
    for axis in axes:
        if not axis.values:
            raise ValueError(f"axis {axis.name!r} has no values")
        size *= len(axis.values)
    if size > max_size:
        raise ValueError(f"grid of {size} settings exceeds {max_size}")
    return list(itertools.product(*[range(len(a.values)) for a in axes]))


def case_maxima(
    expected: DataFrame, other_findings: DataFrame, deltas: DataFrame, label_deltas: DataFrame, features: DataFrame
) -> DataFrame:
    """The case table the default axes work on.

    ``other_findings`` are the findings that do not depend on swept
    thresholds. Values of labels that an expectation names, under a rule it
    names, also enter the designated columns.
    """
    wanted = expected.select("case_id", "expected_rule_ids", "expected_labels")

    def maxima(df: DataFrame, rule: str, value, name: str) -> DataFrame:
        named = F.array_contains("expected_rule_ids", rule) & (
            (F.size("expected_labels") == 0) | F.array_contains("expected_labels", F.col("label"))
        )
        return df.join(wanted, "case_id").groupBy("case_id").agg(
            F.max(value).alias(name), F.max(F.when(named, value)).alias(f"{name}_designated")
        )

    by_rule = F.array_contains("expected_rule_ids", F.col("rule_id"))
    by_label = (F.size("expected_labels") == 0) | F.arrays_overlap("labels", "expected_labels")
    fixed = other_findings.join(wanted, "case_id").groupBy("case_id").agg(
        (F.max("severity") >= 1).alias("fixed_flag"), F.bool_or(by_rule & by_label).alias("fixed_designated")
    )
    df = expected
    for part in (
        fixed,
        maxima(deltas, "reference_delta", F.abs("robust_z"), "robust_z"),
        maxima(label_deltas, "reference_delta", F.col("distribution_distance"), "distance"),
        maxima(features.filter("grp = 'lumbar'"), "bounds", F.col("physical_volume_mm3"), "lumbar_volume"),
    ):
        df = df.join(part, "case_id", "left")
    for c in ("fixed_flag", "fixed_designated"):
        df = df.withColumn(c, F.coalesce(c, F.lit(False)))
    return df.withColumn("expected_failure", F.col("expected_verdict") != "pass")


def calibrate(
    cases: DataFrame, axes: Sequence[Axis] = DEFAULT_AXES, sensitivity_floor: float = 1.0, max_size: int = MAX_GRID
) -> DataFrame:
    """One row per setting: its thresholds, counts, rates, feasibility and ``best``.

    Feasible: every failure mode with cases is caught by its designated rule
    at least at the floor. Best: lowest false-positive rate (none counts as
    lowest), then highest sensitivity, then first in the grid.
    """
    grid = grid_of(axes, max_size)

    def exceeded(axis: Axis, column: str) -> str:
        test = ">=" if axis.inclusive else ">"
        return " + ".join(f"int(coalesce({column} {test} {float(v)!r}D, false))" for v in axis.values)

    n_axes = range(len(axes))
    cells = cases.selectExpr(
        "expected_failure", "failure_mode", "fixed_flag", "fixed_designated",
        *[f"{exceeded(a, a.metric)} AS _p{i}" for i, a in enumerate(axes)],
        *[f"{exceeded(a, a.designated)} AS _d{i}" for i, a in enumerate(axes)],
    )
    cells = cells.groupBy(*cells.columns).agg(F.count(F.lit(1)).alias("n"))

    # Position of a setting's value among the sorted values of its axis.
    settings = ", ".join(
        "struct({})".format(", ".join(
            [str(g)] + [f"{float(a.values[j])!r}D" for a, j in zip(axes, at)]
            + [str(sorted(a.values).index(a.values[j])) for a, j in zip(axes, at)]
        ))
        for g, at in enumerate(grid)
    )
    names = ["grid_id", *[f"_v{i}" for i in n_axes], *[f"_t{i}" for i in n_axes]]
    tried = cells.selectExpr("*", f"inline(array({settings})) AS ({', '.join(names)})")
    tried = tried.selectExpr(
        "*",
        " OR ".join(["fixed_flag"] + [f"_p{i} > _t{i}" for i in n_axes]) + " AS flagged",
        " OR ".join(["fixed_designated"] + [f"_d{i} > _t{i}" for i in n_axes]) + " AS named",
    )
    modes = tried.filter("expected_failure").groupBy("grid_id", "failure_mode").agg(
        F.expr("sum(IF(named, n, 0)) / sum(n) AS caught")
    ).groupBy("grid_id").agg(F.expr(f"bool_and(caught >= {float(sensitivity_floor)!r}D) AS _ok"))
    tally = {"tp": "expected_failure AND flagged", "fp": "NOT expected_failure AND flagged",
             "tn": "NOT expected_failure AND NOT flagged", "fn": "expected_failure AND NOT flagged"}
    scored = tried.groupBy("grid_id", *[f"_v{i}" for i in n_axes]).agg(
        *[F.expr(f"sum(IF({test}, n, 0)) AS {name}") for name, test in tally.items()]
    ).join(modes, "grid_id", "left")
    scored = scored.selectExpr(
        "grid_id", *[f"_v{i} AS {a.name.replace('.', '_')}" for i, a in enumerate(axes)],
        "tp", "fp", "tn", "fn",
        "try_divide(double(fp), fp + tn) AS false_positive_rate",
        "try_divide(double(tp), tp + fn) AS sensitivity",
        "coalesce(_ok, true) AS feasible",
    )
    # At most MAX_GRID rows are ranked here.
    order = Window.partitionBy("feasible").orderBy(
        F.col("false_positive_rate").asc_nulls_first(), -F.coalesce("sensitivity", F.lit(0.0)), "grid_id"
    )
    return scored.withColumn("best", F.col("feasible") & (F.row_number().over(order) == 1))


def calibration_status(scored: DataFrame) -> DataFrame:
    """One row: status, number of settings, and the winning one (NULL if none)."""
    return scored.agg(
        F.when(F.bool_or("feasible"), "ok").otherwise("no-feasible-setting").alias("status"),
        F.count(F.lit(1)).alias("n_candidates"),
        F.max(F.when(F.col("best"), F.col("grid_id"))).alias("best_grid_id"),
    )
