"""Run summaries, run against run, and severity ladders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from instqc.operators.metrics import mode_table

# Recorded margins per ladder (infinite where absent) and the
# recorded responses of ladders on foreign metrics.
RECORDED_MARGINS = {
    1: float("inf"), 2: float("inf"), 3: 112.0, 4: float("inf"),
    5: float("inf"), 6: 0.3585, 7: float("inf"), 8: 1.038,
}
RECORDED_COUPLINGS = {(6, 1): 2.79, (8, 1): 0.9629}


def run_summary(modes: DataFrame, detection: DataFrame | None = None, cases: DataFrame | None = None) -> DataFrame:
    """Per run and each of the eight modes: how many cases have a value, and its mean, range and total.

    A mode that no case has a value for has a row with NULLs all the same.

    ``modes`` is (run_id, case_id, mode, value); ``detection`` adds
    (run_id, failure_mode, sensitivity, n_cases), ``cases`` the run's mean
    Dice from (run_id, case_id, mean_dice, volume_weighted_dice).
    """
    values = modes.groupBy("run_id", "mode").agg(
        F.count("value").alias("n_with_value"),
        F.avg("value").alias("mean"), F.min("value").alias("minimum"),
        F.max("value").alias("maximum"), F.sum("value").alias("total"),
    )
    # The case set of a run: its size, and a sum of hashes that tells whether two runs cover the same cases.
    runs = modes.select("run_id", "case_id").distinct().groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_cases"), F.sum(F.xxhash64("case_id").cast("decimal(20,0)")).cast("string").alias("case_set")
    )
    every = mode_table(modes.sparkSession)
    df = runs.crossJoin(F.broadcast(every)).join(values, ["run_id", "mode"], "left").withColumn("n_with_value", F.coalesce("n_with_value", F.lit(0)))
    if detection is not None:
        seen = detection.select(
            "run_id", F.col("failure_mode").alias("mode"), F.col("sensitivity").alias("detection_rate"),
            F.col("n_cases").alias("n_detection_cases"),
        )
        df = df.join(seen, ["run_id", "mode"], "left")
    else:
        df = df.withColumn("detection_rate", F.lit(None).cast("double")).withColumn("n_detection_cases", F.lit(0).cast("long"))
    df = df.withColumn("n_detection_cases", F.coalesce("n_detection_cases", F.lit(0)))
    if cases is not None:
        dice = cases.groupBy("run_id").agg(
            F.avg("mean_dice").alias("mean_dice"), F.avg("volume_weighted_dice").alias("volume_weighted_dice")
        )
        df = df.join(dice, "run_id", "left")
    return df


def unshared_cases(a: DataFrame, b: DataFrame) -> DataFrame:
    """Case ids that only one of two runs covers."""
    left, right = a.select("case_id").distinct(), b.select("case_id").distinct()
    return left.exceptAll(right).unionByName(right.exceptAll(left))


def same_cohort(run_a: DataFrame, run_b: DataFrame, cases_a: DataFrame | None = None, cases_b: DataFrame | None = None) -> None:
    """Raise if two run summaries do not cover the same cases; reads one row of each.

    An empty run covers no case, so it only agrees with another empty one.
    With the cases of both runs (case_id) the error names one that only one of
    them has, and the run that has it.
    """
    a, b = (run.select("n_cases", "case_set").first() for run in (run_a, run_b))
    if a == b:
        return
    sizes = [0 if row is None else row["n_cases"] for row in (a, b)]
    message = f"the runs cover different cases ({sizes[0]} and {sizes[1]})"
    if cases_a is not None and cases_b is not None:
        odd = unshared_cases(cases_a, cases_b).orderBy("case_id").first()
        if odd is not None:
            where = "first" if cases_a.filter(F.col("case_id") == odd["case_id"]).take(1) else "second"
            message += f"; only the {where} has {odd['case_id']!r}"
    else:
        message += "; unshared_cases() names those that only one has"
    raise ValueError(message)


def compare_runs(run_a: DataFrame, run_b: DataFrame, cases_a: DataFrame | None = None, cases_b: DataFrame | None = None) -> DataFrame:
    """Per mode: change of the mean from run a to run b, scaled and directed.

    Runs over different cases are an error, see ``same_cohort``.

    Only metrics with a fixed full swing are normalised. The attributed mode
    is the one with the largest non-zero normalised change, the first on ties.
    """
    same_cohort(run_a, run_b, cases_a, cases_b)

    def side(df: DataFrame, s: str) -> DataFrame:
        return df.select("mode", F.col("mean").alias(f"value_{s}"), F.col("detection_rate").alias(f"detection_rate_{s}"))

    names = mode_table(run_a.sparkSession)
    df = names.join(side(run_a, "a"), "mode", "left").join(side(run_b, "b"), "mode", "left")
    delta = F.col("value_b") - F.col("value_a")
    df = df.withColumn("delta", delta)
    normalised = F.try_divide(F.col("delta"), F.col("scale"))
    worse = F.when(F.col("delta") == 0, False).when(
        F.col("direction") == "increases", F.col("delta") > 0).otherwise(F.col("delta") < 0)
    df = df.select(
        "mode", "mode_name", "metric", "direction", "baseline", "value_a", "value_b", "delta",
        F.when(F.col("delta").isNotNull(), F.col("scale")).alias("scale"),
        normalised.alias("normalised_delta"),
        F.when(F.col("delta").isNotNull(), worse).alias("worsened"),
        "detection_rate_a", "detection_rate_b",
        (F.col("detection_rate_b") - F.col("detection_rate_a")).alias("detection_rate_delta"),
    )
    moved = F.col("normalised_delta").isNotNull() & (F.col("normalised_delta") != 0)
    # Eight rows in all.
    order = Window.partitionBy(moved).orderBy(F.desc(F.abs("normalised_delta")), "mode")
    return df.withColumn("attributed", moved & (F.row_number().over(order) == 1))


def attribution(comparison: DataFrame) -> DataFrame:
    """One row: the attributed mode, the modes left out, and why none is attributed."""
    out = comparison.agg(
        F.max(F.when(F.col("attributed"), F.col("mode"))).alias("attributed_mode"),
        F.max(F.when(F.col("attributed"), F.col("mode_name"))).alias("attributed_mode_name"),
        F.max(F.when(F.col("attributed"), F.col("metric"))).alias("attributed_metric_name"),
        F.array_sort(F.collect_list(F.when(
            F.col("delta").isNotNull() & F.col("normalised_delta").isNull(), F.col("mode")))).alias("excluded_modes"),
        F.count("normalised_delta").alias("_scaled"),
    )
    reason = F.when(F.col("attributed_mode").isNotNull(), None).when(
        F.col("_scaled") == 0,
        "no metric with a value in both runs has a full swing to scale its change by; excluded_modes lists them",
    ).otherwise("no scaled metric changed between the runs, so nothing moved")
    return out.withColumn("unattributable_reason", reason).drop("_scaled")


def ladder_spans(ladder: DataFrame) -> DataFrame:
    """(sweep_id, mode, metric, span): range a ladder drives each metric through."""
    return ladder.groupBy("sweep_id", "mode", "metric").agg((F.max("value") - F.min("value")).alias("span"))


def ladder_responses(spans: DataFrame) -> DataFrame:
    """Span of every metric on a ladder, relative to the metric's own ladder.

    Infinite where the metric has no own ladder or does not move on it.
    """
    own = spans.filter("mode = metric").select("sweep_id", "metric", F.col("span").alias("own"))
    joined = spans.join(own, ["sweep_id", "metric"], "left")
    infinite = F.lit(float("inf"))
    return joined.withColumn("response", F.coalesce(F.try_divide("span", "own"), infinite))


def score_ladders(ladder: DataFrame) -> DataFrame:
    """Per (sweep, ladder mode): monotone, strictly changing, margin and ratchets."""
    names = mode_table(ladder.sparkSession).select(F.col("mode"), "direction")
    rung = Window.partitionBy("sweep_id", "mode").orderBy("rung")
    own = ladder.filter("mode = metric").withColumn("_next", F.lead("value").over(rung))
    own = own.join(F.broadcast(names), "mode")
    rising = F.col("direction") == "increases"
    step_ok = F.col("_next").isNull() | F.when(rising, F.col("value") <= F.col("_next")).otherwise(F.col("value") >= F.col("_next"))
    changed = F.col("_next").isNull() | (F.abs(F.col("_next") - F.col("value")) > 1e-9)
    course = own.groupBy("sweep_id", "mode").agg(
        F.count(F.lit(1)).alias("n_rungs"), F.bool_and(step_ok).alias("monotone"),
        (F.bool_and(changed) & (F.count(F.lit(1)) >= 2)).alias("strictly_changed"),
    )
    responses = ladder_responses(ladder_spans(ladder))
    infinite = F.lit(float("inf"))
    foreign = responses.filter("mode <> metric").groupBy("sweep_id", "mode").agg(F.max("response").alias("_most"))
    couplings = F.lit(True)
    for (mode, metric), recorded in RECORDED_COUPLINGS.items():
        here = (F.col("mode") == mode) & (F.col("metric") == metric)
        couplings = couplings & ~(here & (F.col("response") > recorded * 1.05))
    held = responses.groupBy("sweep_id", "mode").agg(F.bool_and(couplings).alias("couplings_held"))
    floor = F.lit(None).cast("double")
    for mode, recorded in RECORDED_MARGINS.items():
        floor = F.when(F.col("mode") == mode, F.lit(recorded) * 0.95).otherwise(floor)
    df = course.join(foreign, ["sweep_id", "mode"], "left").join(held, ["sweep_id", "mode"], "left")
    margin = F.when(F.coalesce("_most", F.lit(0.0)) == 0, infinite).otherwise(1.0 / F.col("_most"))
    df = df.withColumn("margin", margin).withColumn("margin_held", F.col("margin") >= floor)
    coupled = F.col("mode").isin(*sorted({m for m, _ in RECORDED_COUPLINGS}))
    return df.select(
        "sweep_id", "mode", "n_rungs", "monotone", "strictly_changed", "margin",
        F.when(coupled, "coupled").otherwise("strict").alias("status"), "couplings_held", "margin_held",
        (F.col("monotone") & F.col("strictly_changed") & F.col("couplings_held") & F.col("margin_held")).alias("passed"),
    )


def provenance(
    cohort_id: str, cohort_size: int, config_version: str, build_date: str,
    reference_schema_version: str | None = None, package_version: str | None = None,
):
    """Provenance column of a report; all of it is the caller's, nothing is looked up."""
    return F.struct(
        F.lit(cohort_id).alias("cohort_id"), F.lit(cohort_size).cast("long").alias("cohort_size"), F.lit(config_version).alias("config_version"),
        F.lit(build_date).alias("build_date"), F.lit(reference_schema_version).cast("string").alias("reference_schema_version"),
        F.lit(package_version).cast("string").alias("package_version"),
    )


def calibration_block(scored: DataFrame, sensitivity_floor: float) -> DataFrame:
    """One row: status, objective, and the setting that won with its metrics (NULL if none); not the whole sweep."""
    metrics = ("tp", "fp", "tn", "fn", "false_positive_rate", "sensitivity")
    other = {"grid_id", "feasible", "best", *metrics}
    best = F.struct(
        F.struct(*[c for c in scored.columns if c not in other]).alias("assignment"), F.struct(*metrics).alias("metrics"))
    return scored.agg(
        F.when(F.bool_or("feasible"), "ok").otherwise("no-feasible-setting").alias("status"),
        F.struct(F.lit(float(sensitivity_floor)).alias("sensitivity_floor")).alias("objective"),
        F.first(F.when(F.col("best"), best), ignorenulls=True).alias("best"),
    )


def magnitude_block(summary: DataFrame) -> DataFrame:
    """(run_id, per_mode_magnitude): the eight mode rows of each run summary in one, with the run's number of cases."""
    rows = [c for c in summary.columns if c not in ("run_id", "case_set", "n_cases", "mean_dice", "volume_weighted_dice")]
    dice = [c for c in ("mean_dice", "volume_weighted_dice") if c in summary.columns]
    listed = F.array_sort(F.collect_list(F.struct("mode", *[c for c in rows if c != "mode"])))
    return summary.groupBy("run_id", "n_cases", *dice).agg(listed.alias("_modes")).select(
        "run_id", F.struct("n_cases", *dice, F.col("_modes").alias("per_mode")).alias("per_mode_magnitude"))


def evaluation_report(
    confusion: DataFrame, per_mode: DataFrame, cases: DataFrame, correlations: DataFrame, calibration: DataFrame | None = None,
    origin=None, manifest=None, magnitude: DataFrame | None = None,
) -> DataFrame:
    """One nested row per cohort: provenance, metrics, modes, correlations and the case list.

    The case list is the size of the cohort and stays a table: the report names
    its row count, and ``cases`` is written beside it. Optional blocks, absent
    if not given: ``calibration`` (one row, see ``calibration_block``),
    ``provenance`` and ``run_manifest`` (columns of constants), and
    ``per_mode_magnitude`` (one row of ``magnitude_block``).
    """
    modes = per_mode.agg(F.array_sort(F.collect_list(F.struct(*per_mode.columns))).alias("per_mode"))
    pairs = correlations.agg(F.array_sort(F.collect_list(F.struct(*correlations.columns))).alias("correlations"))
    n = cases.agg(F.count(F.lit(1)).alias("n_case_rows"))
    out = confusion.select(F.lit("0.1").alias("schema_version"), F.struct(*confusion.columns).alias("metrics"), F.lit(1).alias("_k"))
    parts = [modes, pairs, n]
    if calibration is not None:
        parts.append(calibration.select(F.struct(*calibration.columns).alias("calibration")))
    if magnitude is not None:
        parts.append(magnitude.select("per_mode_magnitude"))
    for part in parts:
        out = out.join(part.withColumn("_k", F.lit(1)), "_k")
    for name, column in (("provenance", origin), ("run_manifest", manifest)):
        if column is not None:
            out = out.withColumn(name, column)
    return out.drop("_k")


def comparison_report(
    comparison: DataFrame, attributed: DataFrame, run_a: str, run_b: str,
    origin_a=None, origin_b=None, manifest_a=None, manifest_b=None,
) -> DataFrame:
    """One nested row: both runs with their provenance and manifest, the mode deltas and the attribution."""
    rows = comparison.agg(F.array_sort(F.collect_list(F.struct("mode", *[c for c in comparison.columns if c != "mode"]))).alias("per_mode"))
    none = provenance("", 0, "", "")

    def side(run_id: str, origin, manifest):
        block = [F.lit(run_id).alias("run_id"), (F.when(F.lit(False), none) if origin is None else origin).alias("provenance")]
        return F.struct(*block, *([] if manifest is None else [manifest.alias("run_manifest")]))

    return rows.withColumn("_k", F.lit(1)).join(attributed.withColumn("_k", F.lit(1)), "_k").drop("_k").select(
        F.lit("0.1").alias("schema_version"), F.lit(run_a).alias("run_a_id"), F.lit(run_b).alias("run_b_id"),
        side(run_a, origin_a, manifest_a).alias("run_a"), side(run_b, origin_b, manifest_b).alias("run_b"), "per_mode", *attributed.columns
    )
