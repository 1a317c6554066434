"""Explainable rules: each turns feature tables into a table of findings.

Findings carry (case_id, rule_id, severity, reason, labels) and three ordering
columns: k1 (mostly the first label), k2 (position inside the label), k3 (name).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from instqc.config import SIZE_BOUNDS, rule_enabled, rule_params
from instqc.functions.scalar import text_template
from instqc.operators import sequence
from instqc.schemas import END_FACES, FACES, IN_PLANE_FACES, severity_level

COLUMNS = ["case_id", "rule_id", "severity", "reason", "labels", "k1", "k2", "k3"]


@dataclass
class Tables:
    """What the rules read. ``features`` is the label table; the rest is optional."""

    features: DataFrame
    levels: DataFrame
    components: DataFrame | None = None
    overlaps: DataFrame | None = None
    intensity: DataFrame | None = None
    reference: DataFrame | None = None
    deltas: DataFrame | None = None
    label_deltas: DataFrame | None = None
    intensity_deltas: DataFrame | None = None
    intensity_label_deltas: DataFrame | None = None


Rule = Callable[[Tables, dict[str, Any]], "DataFrame | None"]
RULES: dict[str, Rule] = {}


def register_rule(rule_id: str) -> Callable[[Rule], Rule]:
    """Adds a rule: a function (tables, params) -> findings or None."""

    def add(rule: Rule) -> Rule:
        if not rule_id:
            raise ValueError("rule_id must not be empty")
        if rule_id in RULES and RULES[rule_id] is not rule:
            raise ValueError(f"rule {rule_id!r} is already registered")
        RULES[rule_id] = rule
        return rule

    return add


def findings(
    df: DataFrame, rule_id: str, params: dict[str, Any], reason: str, labels: str = "array(label)",
    k1: str = "label", k2: str = "0", k3: str = "''", severity: str | None = None,
) -> DataFrame:
    """One finding per row of ``df``; ``reason`` is a text template over its columns."""
    level = severity_level(severity or params.get("severity", "flagged-for-review"))
    return df.selectExpr(
        "case_id", f"'{rule_id}' AS rule_id", f"{level} AS severity", f"{text_template(reason)} AS reason",
        f"CAST({labels} AS ARRAY<INT>) AS labels", f"int({k1}) AS k1", f"int({k2}) AS k2", f"{k3} AS k3",
    )


def face_contacts(features: DataFrame) -> DataFrame:
    """Labels touching a face of the field of view, and whether that is expected.

    Expected means: no in-plane face, and the superior (inferior) face only by
    the superior (inferior) end level of the case.
    """
    ends = sequence.spans(features).select("case_id", "superior_end_level", "inferior_end_level")
    listed = ", ".join(f"IF(touches_{f}, '{f}', NULL)" for f in FACES)
    in_plane = " OR ".join(f"touches_{f}" for f in IN_PLANE_FACES)
    end_ok = " AND ".join(
        f"(NOT touches_{f} OR coalesce(level_name = {f}_end_level, false))" for f in END_FACES
    )
    return (
        features.filter(" OR ".join(f"touches_{f}" for f in FACES))
        .join(ends, "case_id", "left")
        .selectExpr(
            "case_id", "label", "level_name", f"concat_ws(', ', {listed}) AS faces",
            f"NOT ({in_plane}) AND {end_ok} AS expected",
        )
    )


@register_rule("border")
def border(tables: Tables, params: dict[str, Any]) -> DataFrame:
    touched = face_contacts(tables.features)
    where = " label {label} ({level_name}) touches image face(s): {faces}."
    out = findings(touched.filter("NOT expected"), "border", params, "Partial vertebra clipped by FOV:" + where)
    if params.get("report_expected_ends"):
        ends = findings(
            touched.filter("expected"), "border", params, "Partial vertebra at FOV end (expected):" + where,
            severity=params.get("end_severity", "pass"),
        )
        out = out.unionByName(ends)
    return out


# Bounded features with their parameter stem and reported name.
BOUNDED = (
    ("physical_volume_mm3", "volume_mm3", "volume (mm3)"),
    ("extent_x_mm", "extent_x_mm", "extent_x (mm)"),
    ("extent_y_mm", "extent_y_mm", "extent_y (mm)"),
    ("extent_z_mm", "extent_z_mm", "extent_z (mm)"),
)


def _source(params: dict[str, Any]) -> str:
    source = params.get("source", "reference")
    if source not in ("hand-set", "reference"):
        raise ValueError(f"unknown threshold source {source!r}")
    return source


def _reference_side(tables: Tables, params: dict[str, Any], feature: str) -> DataFrame:
    stratum = params.get("reference_stratum", "all")
    return tables.reference.filter((F.col("stratum") == stratum) & (F.col("feature") == feature))


def bounds_table(tables: Tables, params: dict[str, Any]) -> DataFrame:
    """Size values in long form with their effective limits.

    Limits are the group's hand-set ones, overridden per level and feature by
    the reference percentiles where the reference has them.
    """
    items = []
    for order, (feature, stem, name) in enumerate(BOUNDED):
        lo, hi = (
            "CASE grp " + " ".join(f"WHEN '{g}' THEN {float(params[g][f'{side}_{stem}'])!r}D" for g in SIZE_BOUNDS) + " END"
            for side in ("min", "max")
        )
        items.append(
            f"named_struct('k', {order}, 'f', '{feature}', 'n', '{name}', 'v', double({feature}), 'l', {lo}, 'h', {hi})"
        )
    long = tables.features.filter("grp IS NOT NULL").selectExpr(
        "case_id", "label", "level_name", "grp",
        f"inline(array({', '.join(items)})) AS (k2, feature, name, value, hand_lo, hand_hi)",
    )
    if _source(params) == "reference" and tables.reference is not None:
        lo, hi = params.get("reference_lower_pct", 1), params.get("reference_upper_pct", 99)
        side = tables.reference.filter(F.col("stratum") == params.get("reference_stratum", "all")).select(
            "level_name", "feature", F.col("pcts")[lo].alias("ref_lo"), F.col("pcts")[hi].alias("ref_hi")
        )
        long = long.join(side, ["level_name", "feature"], "left")
    else:
        long = long.withColumn("ref_lo", F.lit(None).cast("double")).withColumn("ref_hi", F.lit(None).cast("double"))
    return long.withColumn("lo", F.coalesce("ref_lo", "hand_lo")).withColumn("hi", F.coalesce("ref_hi", "hand_hi"))


@register_rule("bounds")
def bounds(tables: Tables, params: dict[str, Any]) -> DataFrame:
    lo_pct, hi_pct = params.get("reference_lower_pct", 1), params.get("reference_upper_pct", 99)
    return findings(
        bounds_table(tables, params).filter("value < lo OR value > hi"), "bounds", params,
        "Label {label} ({level_name}): {name} = {value:g} {IF(value < lo, 'is below', 'exceeds')} "
        "{IF(ref_lo IS NULL, '', 'reference ')}{IF(value < lo, 'minimum', 'maximum')} {IF(value < lo, lo, hi):g}"
        f"{{IF(ref_lo IS NULL, concat(' for ', grp, ' group'), concat(' (p', IF(value < lo, {lo_pct}, {hi_pct}), ') for level ', level_name))}}",
        k2="k2",
    )


def absent_beyond_ends(tables: Tables, expected: list[str], border_aware: bool) -> DataFrame:
    """Expected levels missing above the first or below the last present level.

    Border-aware: nothing is expected beyond a truncated end, and beyond an
    intact end only the adjacent level.
    """
    wanted = tables.levels.filter(F.col("level_name").isin(*expected)).select("level_name", "rank")
    spans = sequence.spans(tables.features)
    listed = spans.withColumn("w", F.explode(F.array(*[F.lit(n) for n in sorted(set(expected))])))
    listed = listed.join(F.broadcast(wanted), F.col("w") == F.col("level_name")).drop("w")
    above = F.col("rank") < F.col("superior_rank")
    below = F.col("rank") > F.col("inferior_rank")
    if border_aware:
        above = above & ~F.col("superior_truncated") & (F.col("rank") == F.col("superior_rank") - 1)
        below = below & ~F.col("inferior_truncated") & (F.col("rank") == F.col("inferior_rank") + 1)
    return listed.filter(above | below).select("case_id", "rank", "level_name")


@register_rule("coverage")
def coverage(tables: Tables, params: dict[str, Any]) -> DataFrame:
    whole = dict(labels="array()", k1="0")

    def listing(df: DataFrame) -> DataFrame:
        return df.groupBy("case_id").agg(F.expr(
            "array_join(transform(array_sort(collect_list(struct(rank, level_name))), s -> s.level_name), ', ') AS names"
        ))

    out = findings(
        listing(sequence.missing_levels(tables.features, tables.levels)), "coverage", params,
        "Missing interior level(s): {names} absent within the observed present-level span.", **whole,
    )
    expected = params.get("expected_levels") or []
    if expected:
        absent = absent_beyond_ends(tables, expected, params.get("border_aware", True))
        out = out.unionByName(findings(
            listing(absent), "coverage", params,
            "Incomplete coverage (span): expected level(s) {names} absent beyond the present span.", k2="1", **whole,
        ))
    minimum = params.get("expected_count")
    if minimum is not None:
        present = tables.features.groupBy("case_id").agg(F.count("rank").alias("present_count"))
        out = out.unionByName(findings(
            present.filter(F.col("present_count") < int(minimum)), "coverage", params,
            f"Below expected count: present count {{present_count}} is below expected minimum {int(minimum)}.",
            k2="2", **whole,
        ))
    return out


def fragment_table(tables: Tables, params: dict[str, Any]) -> DataFrame:
    """Component summaries with their effective index floor and count ceiling."""
    df = tables.components.join(
        tables.features.select("case_id", "label", "level_name"), ["case_id", "label"]
    )
    if _source(params) == "reference" and tables.reference is not None:
        lo, hi = params.get("reference_lower_pct", 1), params.get("reference_upper_pct", 99)
        floor = _reference_side(tables, params, "largest_component_fraction").select(
            "level_name", F.col("pcts")[lo].alias("ref_index")
        )
        ceiling = _reference_side(tables, params, "component_count").select(
            "level_name", F.col("pcts")[hi].alias("ref_count")
        )
        return df.join(floor, "level_name", "left").join(ceiling, "level_name", "left")
    nothing = F.lit(None).cast("double")
    return df.withColumn("ref_index", nothing).withColumn("ref_count", nothing)


@register_rule("fragmentation")
def fragmentation(tables: Tables, params: dict[str, Any]) -> DataFrame | None:
    if tables.components is None:
        return None
    df = fragment_table(tables, params)
    lo, hi = params.get("reference_lower_pct", 1), params.get("reference_upper_pct", 99)
    floor = f"coalesce(ref_index, {float(params['fragmentation_index_threshold'])!r}D)"
    counted = "component_count={component_count}, component_sizes={component_sizes:counts}"
    split = findings(
        df.filter(f"fragmentation_index < {floor}"), "fragmentation", params,
        "Fragmentation: Label {label}{IF(ref_index IS NULL, '', concat(' (', level_name, ')'))}: "
        "fragmentation_index={fragmentation_index:g} "
        "{IF(ref_index IS NULL, 'is strictly below threshold', 'is below reference floor')} "
        f"{{{floor}:g}}{{IF(ref_index IS NULL, '', concat(' (p{lo}) for level ', level_name))}}. " + counted,
    )
    excess = findings(
        df.filter("component_count > ref_count"), "fragmentation", params,
        "Rogue island(s): Label {label} ({level_name}): component_count={component_count} exceeds reference maximum "
        f"{{ref_count:g}} (p{hi}) for level {{level_name}}. component_sizes={{component_sizes:counts}}, "
        "fragmentation_index={fragmentation_index}", k2="1",
    )
    smallest = int(params["island_min_voxels"])
    tiny = df.filter("ref_count IS NULL").selectExpr("*", f"filter(stray_component_sizes, s -> s.size < {smallest}) AS tiny")
    islands = findings(
        tiny.filter("size(tiny) > 0"), "fragmentation", params,
        f"Rogue island(s): Label {{label}}: {{aggregate(tiny, 0L, (t, s) -> t + s.n)}} non-dominant component(s) strictly below "
        f"island_min_voxels={smallest}. Tiny island sizes: {{tiny:counts}}. {counted}, "
        "fragmentation_index={fragmentation_index}", k2="1",
    )
    return split.unionByName(excess).unionByName(islands)


@register_rule("intensity")
def intensity(tables: Tables, params: dict[str, Any]) -> DataFrame | None:
    if tables.intensity is None:
        return None
    low, high = float(params["min_plausible_hu"]), float(params["max_plausible_hu"])
    flat = float(params["max_degenerate_std"])
    band = f"the plausible bone band ({low:.2f}, {high:.2f}) HU (threshold "
    tests = [
        ("flag_low", f"median < {low!r}D",
         f"Implausible intensity (too low): label {{label}} median {{median:.2f}} HU is below {band}min_plausible_hu={low:.2f})."),
        ("flag_high", f"median > {high!r}D",
         f"Implausible intensity (too high): label {{label}} median {{median:.2f}} HU is above {band}max_plausible_hu={high:.2f})."),
        ("flag_degenerate", f"std <= {flat!r}D",
         "Implausible intensity (degenerate/uniform): label {label} std {std:.2f} HU is at or below the "
         f"degenerate-uniform threshold max_degenerate_std={flat:.2f} HU."),
    ]
    parts = [
        findings(tables.intensity.filter(test), "intensity", params, reason, k2=str(order))
        for order, (switch, test, reason) in enumerate(tests)
        if params.get(switch, True)
    ]
    return reduce(DataFrame.unionByName, parts) if parts else None


def _delta_rule(rule_id: str, deltas: DataFrame | None, labels: DataFrame | None, params: dict[str, Any]) -> DataFrame | None:
    if deltas is None or labels is None:
        return None
    lo, hi = params.get("lower_pct", 1), params.get("upper_pct", 99)
    far, wide = float(params["max_distribution_distance"]), float(params["max_robust_z"])
    who, named = "label {label} ({level_name})", "label {label} ({level_name}) feature '{feature}'"
    parts = []
    if params.get("flag_distribution_distance", True):
        parts.append(findings(
            labels.filter(F.col("distribution_distance") >= far), rule_id, params,
            f"Reference distribution-distance outlier: {who} distribution distance "
            f"{{distribution_distance:.2f}} exceeds threshold {far:.2f}.",
        ))
    if params.get("flag_out_of_range", True):
        parts.append(findings(
            deltas.filter("out_of_range"), rule_id, params,
            f"Reference out-of-range: {named} value {{value}} falls outside the reference range "
            f"(percentile_rank={{pct_rank}}, band=({lo}, {hi})).", k2="1", k3="feature",
        ))
    if params.get("flag_robust_z", True):
        parts.append(findings(
            deltas.filter(F.abs("robust_z") >= wide), rule_id, params,
            f"Reference robust-z outlier: {named} robust_z={{robust_z:.2f}} exceeds threshold {wide:.2f}.",
            k2="2", k3="feature",
        ))
    return reduce(DataFrame.unionByName, parts) if parts else None


@register_rule("intensity_reference_delta")
def intensity_reference_delta(tables: Tables, params: dict[str, Any]) -> DataFrame | None:
    return _delta_rule("intensity_reference_delta", tables.intensity_deltas, tables.intensity_label_deltas, params)


@register_rule("reference_delta")
def reference_delta(tables: Tables, params: dict[str, Any]) -> DataFrame | None:
    return _delta_rule("reference_delta", tables.deltas, tables.label_deltas, params)


@register_rule("mislabel")
def mislabel(tables: Tables, params: dict[str, Any]) -> DataFrame | None:
    limit = float(params["max_offset_mm"])
    parts = []
    if params.get("flag_offset_outliers", True):
        off = sequence.curve_offsets(tables.features).filter(F.col("curve_offset_mm") >= limit)
        parts.append(findings(
            off, "mislabel", params,
            "Vertebra misaligned from spinal curve: label {label} ({level_name}) centroid lies {curve_offset_mm:.1f} mm "
            f"off the fitted spinal curve (threshold {limit:.1f} mm).", k1="0", k2="label",
        ))
    if params.get("flag_order_inconsistency", True):
        pairs = sequence.progression(tables.features).filter("non_monotonic")
        parts.append(findings(
            pairs, "mislabel", params,
            "Vertebra ordering inconsistent with label: labels {label} ({level_name}) and {next_label} ({next_level}) "
            "are out of expected order along the spine (spline parameter does not advance).",
            labels="array(label, next_label)", k1="1", k3="concat_ws('|', level_name, next_level)",
        ))
    return reduce(DataFrame.unionByName, parts) if parts else None


@register_rule("overlap")
def overlap(tables: Tables, params: dict[str, Any]) -> DataFrame | None:
    if tables.overlaps is None:
        return None
    return findings(
        tables.overlaps.filter(F.col("overlap_voxels") >= int(params.get("min_overlap_voxels", 1))), "overlap", params,
        "Overlapping segments: labels {label_a} ({name_a}) and {label_b} ({name_b}) share {overlap_voxels} voxel(s).",
        labels="array(label_a, label_b)", k1="label_a", k2="label_b",
    )


@register_rule("sequence")
def out_of_sequence(tables: Tables, params: dict[str, Any]) -> DataFrame:
    late = sequence.out_of_order(tables.features).groupBy("case_id").agg(
        F.expr("array_sort(collect_list(struct(label, level_name))) AS late")
    )
    return findings(
        late, "sequence", params,
        "Non-continuous label sequence: {array_join(transform(late, s -> s.level_name), ', ')} out of anatomical order.",
        labels="transform(late, s -> s.label)", k1="late[0].label",
    )


def run_rules(tables: Tables, config: dict[str, Any], rules: dict[str, Rule] | None = None) -> DataFrame:
    """Findings of every enabled rule; switched-off rules are not planned at all."""
    active = RULES if rules is None else rules
    parts = []
    for rule_id in sorted(active):
        if rule_enabled(config, rule_id):
            out = active[rule_id](tables, rule_params(config, rule_id))
            if out is not None:
                parts.append(out.select(*COLUMNS))
    if not parts:
        return tables.features.sparkSession.createDataFrame(
            [], "case_id string, rule_id string, severity int, reason string, "
                "labels array<int>, k1 int, k2 int, k3 string")
    return reduce(DataFrame.unionByName, parts)
