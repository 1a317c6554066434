"""Evaluating a cohort of candidate maps against ground truth."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from instqc.config import merge_config
from instqc.functions.skew import of_cases
from instqc.operators import metrics, overlap, sequence
from instqc.operators.components import count_of
from instqc.operators.geometry import label_features
from instqc.operators.inventory import canonical_position
from instqc.operators.reference import ALL
from instqc.operators.rules import face_contacts, run_rules
from instqc.operators.verdict import verdicts
from instqc.plans.judge import build_tables
from instqc.schemas import levels as level_table, severity_level
from instqc.session import cut_lineage

FEATURES = ("physical_volume_mm3", "extent_x_mm", "extent_y_mm", "extent_z_mm", "curve_offset_mm")
CENTRE = ("cx_mm", "cy_mm", "cz_mm")


def feature_match(candidate: DataFrame, gt: DataFrame) -> DataFrame:
    """Candidate against ground-truth features per label, unmatched labels kept.

    Signed absolute and relative differences, centroid distance, and the
    divergence: the mean of the available relative differences' size.
    """
    def side(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(
            "case_id", "label", F.col("level_name").alias(f"{prefix}_name"), F.col("rank").alias(f"{prefix}_rank"),
            *[F.col(c).alias(f"{prefix}_{c}") for c in (*FEATURES, *CENTRE)],
        )

    joined = side(candidate, "cand").join(side(gt, "gt"), ["case_id", "label"], "full_outer")
    matched = F.col("cand_name").isNotNull() & F.col("gt_name").isNotNull()
    columns, relative = [], []
    for f in FEATURES:
        diff = F.when(matched, F.col(f"cand_{f}") - F.col(f"gt_{f}"))
        rel = F.try_divide(diff, F.col(f"gt_{f}"))
        columns += [diff.alias(f"abs_{f}"), rel.alias(f"rel_{f}")]
        relative.append(F.abs(rel))
    distance = F.sqrt(sum((F.pow(F.col(f"cand_{c}") - F.col(f"gt_{c}"), 2) for c in CENTRE), F.lit(0.0)))
    sizes = F.array_compact(F.array(*relative))
    score = F.try_divide(F.aggregate(sizes, F.lit(0.0), lambda t, v: t + v), F.size(sizes))
    return joined.select(
        "case_id", "label", F.coalesce("gt_name", "cand_name").alias("level_name"),
        F.coalesce(F.coalesce("gt_rank", "cand_rank"), canonical_position("gt_rank")).alias("position"),
        matched.alias("matched"), *columns,
        F.when(matched, distance).alias("centroid_distance_mm"), F.when(matched, score).alias("divergence_score"),
    )


def case_match(per_label: DataFrame) -> DataFrame:
    """Case means of divergence and centroid distance over matched labels."""
    return per_label.groupBy("case_id").agg(
        F.avg("divergence_score").alias("case_divergence"),
        F.avg("centroid_distance_mm").alias("mean_centroid_distance_mm"),
        F.count_if("matched").alias("n_matched"), F.count_if(~F.col("matched")).alias("n_unmatched"),
    )


def voxel_modes(agreement: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """Modes 1, 4 and 5 per case from joint label counts (NULL label = background).

    Mode 1 is divided by the ground-truth foreground. A case without
    ground-truth foreground has no mode 1 and a mode 4 of zero. ``cases``
    lists the cases that have both maps; those where both are empty get their
    row from it.
    """
    agreement = cut_lineage(agreement)
    gt, cand, n = F.col("gt_label"), F.col("cand_label"), F.col("n")
    count = lambda test: F.coalesce(F.sum(F.when(test, n)), F.lit(0))
    gt_labels = agreement.filter(gt.isNotNull()).select("case_id", gt.alias("cand_label")).distinct().withColumn(
        "_in_gt", F.lit(True)
    )
    joined = agreement.join(gt_labels, ["case_id", "cand_label"], "left")
    base = joined.groupBy("case_id").agg(
        count(gt.isNotNull()).alias("gt_fg"),
        count(gt.isNull() & cand.isNotNull()).alias("unanchored"),
        count(gt.isNotNull() & cand.isNotNull() & (gt != cand) & F.coalesce("_in_gt", F.lit(False))).alias("mislabelled"),
    )
    candidate_labels = agreement.filter(cand.isNotNull()).select("case_id", cand.alias("gt_label")).distinct()
    lost = (
        agreement.filter(gt.isNotNull())
        .groupBy("case_id", "gt_label")
        .agg(F.sum("n").alias("size"), count(cand.isNull()).alias("empty"))
        .join(candidate_labels, ["case_id", "gt_label"], "left_anti")
        .groupBy("case_id").agg(F.count_if(F.col("empty") / F.col("size") > 0.5).alias("lost"))
    )
    if cases is not None:
        base = cases.select("case_id").distinct().join(base, "case_id", "left")
    df = base.join(lost, "case_id", "left")
    ratio = lambda c: F.try_divide(F.col(c) * F.lit(1.0), F.col("gt_fg"))
    return df.select(
        "case_id", ratio("unanchored").alias("m1"), F.coalesce(ratio("mislabelled"), F.lit(0.0)).alias("m4"),
        F.coalesce("lost", F.lit(0)).cast("double").alias("m5"),
    )


def record_modes(
    cases: DataFrame, features: DataFrame, parts: DataFrame, overlaps: DataFrame, island_size_ratio: float = 0.10
) -> DataFrame:
    """Modes 2, 3, 6, 7 and 8 per case, from the features of the judged map.

    Cases without labels have no value for any of them but mode 8.
    """
    rogue = count_of(F.filter(
        "stray_component_sizes", lambda s: s["size"] < F.lit(island_size_ratio) * F.element_at("component_sizes", 1)["size"]
    ))
    from_parts = parts.groupBy("case_id").agg(F.min("fragmentation_index").alias("m2"), F.max(rogue).alias("m3"))
    clipped = face_contacts(features).groupBy("case_id").agg(F.count_if(~F.col("expected")).alias("m6"))
    late = sequence.out_of_order(features).groupBy("case_id").agg(F.count(F.lit(1)).alias("m7"))
    shared = overlaps.groupBy("case_id").agg(F.sum("overlap_voxels").alias("m8"))
    labelled = features.select("case_id").distinct().withColumn("_labelled", F.lit(True))
    df = reduce(
        lambda a, b: a.join(b, "case_id", "left"),
        [from_parts, clipped, late, shared, labelled], cases.select("case_id"),
    )
    known = F.col("_labelled").isNotNull()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    return df.select(
        "case_id", F.col("m2"), F.col("m3").cast("double").alias("m3"),
        F.when(known, zero("m6")).alias("m6"), F.when(known, zero("m7")).alias("m7"), zero("m8").alias("m8"),
    )


# Why a metric has no value.
DETAIL = {
    1: "gt has no foreground voxels",
    2: "record has no usable per_label entries",
    3: "record has no usable per_label entries",
    4: "mode 4 needs both candidate and gt; at least one is missing",
    5: "mode 5 needs both candidate and gt; at least one is missing",
    6: "record has no usable per_label entries",
    7: "record has no relationships block",
    8: "record has no overlaps key",
}
# Fixed value: the same of mode 1 where a case has no candidate or no ground truth.
NO_PAIR = "mode 1 needs both candidate and gt; at least one is missing"


#: Overlap of the whole case that its mode rows carry.
AGGREGATES = ("mean_dice", "volume_weighted_dice", "mean_jaccard", "n_matched", "n_unmatched")


def checked_overlap(overlap_result: DataFrame, counts: DataFrame) -> DataFrame:
    """An overlap table made elsewhere, if it fits the maps; else an error that names it.

    ``counts`` (case_id, label, candidate_voxels, gt_voxels) comes from the
    maps. Labels and both voxel counts must agree; intersections, Dice and
    Jaccard are taken on trust.
    """
    sizes = ["candidate_voxels", "gt_voxels"]
    theirs = overlap_result.select("case_id", "label", *[F.col(c).alias(f"_{c}") for c in sizes])
    joined = counts.select("case_id", "label", *sizes).join(theirs, ["case_id", "label"], "full_outer")
    differ = [~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in sizes]
    wrong = joined.filter(differ[0] | differ[1]).orderBy("case_id", "label").first()
    if wrong is not None:
        raise ValueError(
            f"overlap_result does not fit the maps: case {wrong['case_id']!r}, label {wrong['label']}: "
            f"has {[wrong['_' + c] for c in sizes]} candidate and ground-truth voxels, the maps {[wrong[c] for c in sizes]}")
    return overlap_result


def mode_metrics(by_voxel: DataFrame, by_record: DataFrame, case_overlap: DataFrame | None = None) -> DataFrame:
    """(case_id, mode, metric, direction, baseline, value, detail, *AGGREGATES): eight rows per case.

    ``case_overlap`` (of ``overlap.case_dice``) gives the aggregates; without
    it, and for cases that are not in it, they are NULL and the counts 0.
    """
    wide = by_record.join(by_voxel.withColumn("_both", F.lit(True)), "case_id", "left")
    if case_overlap is not None:
        wide = wide.join(case_overlap.select("case_id", *AGGREGATES), "case_id", "left")
    else:
        wide = wide.select("*", *[F.lit(None).cast("double").alias(c) for c in AGGREGATES])
    totals = [(F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")) if c.startswith("n_") else F.col(c)).alias(c) for c in AGGREGATES]
    detail = {m: F.lit(text) for m, text in DETAIL.items()}
    detail[1] = F.when(F.col("_both"), DETAIL[1]).otherwise(NO_PAIR)
    rows = F.array(*[
        F.struct(F.lit(m).alias("mode"), F.col(f"m{m}").alias("value"),
                 F.when(F.col(f"m{m}").isNull(), detail[m]).alias("detail"))
        for m in range(1, 9)
    ])
    long = wide.select("case_id", *totals, F.inline(rows))
    return long.join(F.broadcast(metrics.mode_table(wide.sparkSession)), "mode").select(
        "case_id", "mode", "mode_name", "metric", "direction", "baseline", "value", "detail", *AGGREGATES
    )


@dataclass
class Evaluation:
    findings: DataFrame
    verdicts: DataFrame
    outcomes: DataFrame
    overlap: DataFrame
    case_overlap: DataFrame
    match: DataFrame
    case_match: DataFrame
    modes: DataFrame
    cases: DataFrame


def evaluate(
    gt: DataFrame, candidate: DataFrame | None, grids: DataFrame, expected: DataFrame,
    config: dict[str, Any] | None = None, reference: DataFrame | None = None, levels: DataFrame | None = None,
    candidate_cases: DataFrame | None = None, stratum: str = ALL, lower_pct: int = 1, upper_pct: int = 99,
    positive_severity: str = "flagged-for-review", overlap_result: DataFrame | None = None,
) -> Evaluation:
    """Evaluate every case of ``expected``.

    Where a case has a candidate map it is judged and compared with the
    ground truth; otherwise the ground truth itself is judged and the
    comparison stays NULL. Case ids must be unique. ``candidate_cases``
    (case_id) lists the cases that have a candidate map, also an empty one,
    which has no voxel rows to know it by; without the list, cases with
    candidate voxels count. Stratum, percentiles and the severity from which
    a verdict counts as positive are passed on to the rules and the outcomes.
    ``overlap_result``, a table as ``overlap.dice`` gives it, is used in place
    of a new one if its labels and voxel counts fit the maps.
    """
    config = merge_config(config)
    spark = gt.sparkSession
    levels = level_table(spark) if levels is None else levels
    repeated = expected.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"duplicate case_id {repeated[0]['case_id']!r}")
    grids = grids.join(expected.select("case_id"), "case_id", "left_semi")
    if candidate is None:
        subject, both = gt, None
    else:
        both = cut_lineage((candidate if candidate_cases is None else candidate_cases).select("case_id").distinct())
        candidate = candidate if candidate_cases is None else of_cases(candidate, both)
        subject = candidate.unionByName(of_cases(gt, both, "left_anti"))
    tables = build_tables(subject, grids, config, reference=reference, levels=levels, stratum=stratum, lower_pct=lower_pct, upper_pct=upper_pct)
    findings = cut_lineage(run_rules(tables, config))
    verdict = verdicts(grids, findings, config)
    outcome = cut_lineage(metrics.outcomes(verdict, expected, findings, severity_level(positive_severity)))
    by_record = record_modes(grids, tables.features, tables.components, tables.overlaps)

    if both is not None:
        compared = of_cases(gt, both)
        joint = cut_lineage(overlap.joint_counts(candidate, compared))
        counts = overlap.label_counts(joint)
        per_label = overlap.dice_of_counts(counts, grids, levels) if overlap_result is None else checked_overlap(overlap_result, counts)
        gt_features = sequence.curve_offsets(label_features(compared, grids, levels))
        cand_features = sequence.curve_offsets(tables.features).join(both, "case_id", "left_semi")
        match = feature_match(cand_features, gt_features)
        by_voxel = voxel_modes(overlap.agreement_counts(joint), grids.join(both, "case_id", "left_semi"))
    else:
        nothing = gt.limit(0)
        per_label = overlap.dice(nothing, nothing, grids, levels)
        flat = sequence.curve_offsets(tables.features).limit(0)
        match = feature_match(flat, flat)
        by_voxel = voxel_modes(overlap.voxel_agreement(nothing, nothing))
    per_label, match = cut_lineage(per_label), cut_lineage(match)
    dice, matched = overlap.case_dice(per_label), case_match(match)
    modes = mode_metrics(by_voxel, by_record, dice)
    cases = outcome.join(dice.select("case_id", "mean_dice", "mean_jaccard", "volume_weighted_dice"), "case_id", "left").join(
        matched.select("case_id", "case_divergence", "mean_centroid_distance_mm"), "case_id", "left"
    )
    return Evaluation(findings, verdict, outcome, per_label, dice, match, matched, modes, cut_lineage(cases))


def regression_check(findings: DataFrame, verdicts: DataFrame, expected: DataFrame) -> DataFrame:
    """Whether each case behaves as its expectation says.

    The verdict matches; a clean case (mode 0) has no findings; any other has a
    finding of an expected rule, and such findings name exactly the expected
    labels.
    """
    hits = findings.join(expected.select("case_id", "expected_rule_ids"), "case_id").filter(
        F.array_contains("expected_rule_ids", F.col("rule_id"))
    )
    named = hits.groupBy("case_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("labels")))).alias("named_labels"),
        F.count(F.lit(1)).alias("n_designated"),
    )
    df = expected.join(verdicts.select("case_id", "verdict", "n_findings"), "case_id", "left").join(named, "case_id", "left")
    fired = F.coalesce("n_designated", F.lit(0)) > 0
    labels = F.coalesce("named_labels", F.array().cast("array<int>")) == F.array_sort(F.array_distinct("expected_labels"))
    verdict_ok = F.coalesce(F.col("verdict") == F.col("expected_verdict"), F.lit(False))
    clean = F.coalesce(F.col("failure_mode") == 0, F.lit(False))
    return df.select(
        "case_id", verdict_ok.alias("verdict_ok"), fired.alias("designated_fired"), labels.alias("labels_ok"),
        (verdict_ok & F.when(clean, F.coalesce("n_findings", F.lit(0)) == 0).otherwise(fired & labels)).alias("passed"),
    )


def compare_values(left: DataFrame, right: DataFrame, rel: float = 1e-9, absolute: float = 1e-12) -> DataFrame:
    """Differences of two long tables (key, path, number, text).

    Numbers agree within max(rel * size, absolute); everything else must be
    equal. Rows on one side only are differences.
    """
    a = left.select("key", "path", F.col("number").alias("number_a"), F.col("text").alias("text_a"), F.lit(True).alias("_a"))
    b = right.select("key", "path", F.col("number").alias("number_b"), F.col("text").alias("text_b"), F.lit(True).alias("_b"))
    joined = a.join(b, ["key", "path"], "full_outer")
    x, y = F.col("number_a"), F.col("number_b")
    near = (x == y) | (F.abs(x - y) <= F.greatest(rel * F.greatest(F.abs(x), F.abs(y)), F.lit(absolute)))
    same = F.when(x.isNotNull() & y.isNotNull(), near).otherwise(
        x.isNull() & y.isNull() & F.col("text_a").eqNullSafe(F.col("text_b"))
    )
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return joined.filter(~(both & same)).select("key", "path", "number_a", "number_b", "text_a", "text_b")
