"""Order, spacing and curve features of the label sequence of a case.

Input is one row per (case, label), so a window over a case holds at most the
labels of one map. Unless stated, the order is ascending label value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from instqc.functions.scalar import norm

AXES = ("x", "y", "z")


def by_case():
    return Window.partitionBy("case_id")


def by_label():
    return by_case().orderBy("label")


def by_rank():
    return by_case().orderBy("rank")


def known(features: DataFrame) -> DataFrame:
    return features.filter(F.col("rank").isNotNull())


def _gap(window) -> Column:
    """Distance in mm to the next centroid of the window; NULL on the last row."""
    return norm(*[F.lead(f"c{a}_mm").over(window) - F.col(f"c{a}_mm") for a in AXES])


def consecutive_spacing(features: DataFrame) -> DataFrame:
    """Adds next_label, next_level, gap_mm (NULL on the last label) and spacing_mm
    (the last label repeats the previous gap)."""
    df = features.withColumn("gap_mm", _gap(by_label()))
    return (
        df.withColumn("next_label", F.lead("label").over(by_label()))
        .withColumn("next_level", F.lead("level_name").over(by_label()))
        .withColumn("spacing_mm", F.coalesce("gap_mm", F.lag("gap_mm").over(by_label())))
    )


def canonical_spacing(features: DataFrame) -> DataFrame:
    """Distance to the next present level in head-to-tail order; known levels only."""
    return known(features).select(
        "case_id", "label", "level_name", "rank",
        F.lead("level_name").over(by_rank()).alias("next_level"),
        _gap(by_rank()).alias("neighbour_spacing_mm"),
    )


def out_of_order(features: DataFrame) -> DataFrame:
    """Known labels whose rank lies below an earlier label's rank."""
    earlier = by_label().rowsBetween(Window.unboundedPreceding, -1)
    return (
        known(features)
        .select("case_id", "label", "level_name", "rank", F.max("rank").over(earlier).alias("highest_before"))
        .filter("rank < highest_before")
    )


def spans(features: DataFrame) -> DataFrame:
    """First and last present level per case and whether the map cuts them.

    The end levels are truncated when they touch the superior or inferior face.
    """
    return known(features).groupBy("case_id").agg(
        F.min("rank").alias("superior_rank"),
        F.max("rank").alias("inferior_rank"),
        F.min_by("level_name", "rank").alias("superior_end_level"),
        F.max_by("level_name", "rank").alias("inferior_end_level"),
        F.min_by("touches_superior", "rank").alias("superior_truncated"),
        F.max_by("touches_inferior", "rank").alias("inferior_truncated"),
        F.count(F.lit(1)).alias("present_count"),
    )


def missing_levels(features: DataFrame, levels: DataFrame) -> DataFrame:
    """Levels between the first and last present one that are absent."""
    ends = known(features).groupBy("case_id").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"))
    inside = ends.select("case_id", F.explode(F.sequence("lo", "hi")).alias("rank"))
    absent = inside.join(known(features).select("case_id", "rank"), ["case_id", "rank"], "left_anti")
    names = levels.select("rank", "level_name").filter(F.col("rank").isNotNull())
    return absent.join(F.broadcast(names), "rank").select("case_id", "rank", "level_name")


def _names_by_rank(items: Column) -> Column:
    return F.transform(F.array_sort(items), lambda s: s["level_name"])


def relationships(features: DataFrame, levels: DataFrame) -> DataFrame:
    """Per case: present, missing and out-of-order levels, canonical spacings, continuity."""
    named = F.struct("rank", "level_name")
    present = canonical_spacing(features).groupBy("case_id").agg(
        _names_by_rank(F.collect_list(named)).alias("present_levels"),
        F.transform(
            F.array_sort(F.collect_list(
                F.when(F.col("neighbour_spacing_mm").isNotNull(), F.struct("rank", "neighbour_spacing_mm"))
            )),
            lambda s: s["neighbour_spacing_mm"],
        ).alias("neighbour_spacings_mm"),
    )
    missing = missing_levels(features, levels).groupBy("case_id").agg(
        _names_by_rank(F.collect_list(named)).alias("missing_levels")
    )
    late = out_of_order(features).groupBy("case_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("label", "level_name"))), lambda s: s["level_name"]
        ).alias("out_of_order_labels")
    )
    cases = features.select("case_id").distinct()
    df = cases.join(present, "case_id", "left").join(missing, "case_id", "left").join(late, "case_id", "left")
    for name, kind in (("present_levels", "string"), ("missing_levels", "string"),
                       ("out_of_order_labels", "string"), ("neighbour_spacings_mm", "double")):
        df = df.withColumn(name, F.coalesce(name, F.array().cast(f"array<{kind}>")))
    return df.withColumn("is_continuous", F.size("out_of_order_labels") == 0)


def spacing_consistency(
    features: DataFrame, high: float = 2.0, low: float = 0.3
) -> DataFrame:
    """Per consecutive pair: gap, deviation from the case mean, outlier flag; with
    the case's mean_spacing_mm and cv_spacing (population std over mean)."""
    pairs = consecutive_spacing(features).filter(F.col("gap_mm").isNotNull())
    mean = F.avg("gap_mm").over(by_case())
    spread = F.coalesce(F.try_divide(F.stddev_pop("gap_mm").over(by_case()), F.col("mean_spacing_mm")), F.lit(0.0))
    gap = F.col("gap_mm")
    return (
        pairs.withColumn("mean_spacing_mm", mean)
        .withColumn("cv_spacing", spread)
        .select(
            "case_id", "label", "next_label", "level_name", "next_level", "gap_mm",
            "mean_spacing_mm", "cv_spacing",
            (gap - F.col("mean_spacing_mm")).alias("deviation_mm"),
            ((gap >= high * F.col("mean_spacing_mm")) | (gap <= low * F.col("mean_spacing_mm"))).alias("is_outlier"),
        )
    )


LABEL_WINDOW = "(PARTITION BY case_id ORDER BY label)"


def curve_offsets(features: DataFrame) -> DataFrame:
    """Distance of each interior centroid from the chord of its two neighbours.

    The point itself takes no part in the chord, so a displaced label cannot
    pull the curve towards itself. Ends have no chord and stay NULL.
    """
    w = LABEL_WINDOW
    df = features.selectExpr(
        "*",
        *[f"lag(c{a}_mm) OVER {w} AS _p{a}" for a in AXES],
        *[f"lead(c{a}_mm) OVER {w} - lag(c{a}_mm) OVER {w} AS _d{a}" for a in AXES],
    )
    dot = " + ".join(f"(c{a}_mm - _p{a}) * _d{a}" for a in AXES)
    length = " + ".join(f"_d{a} * _d{a}" for a in AXES)
    df = df.selectExpr(
        "*",
        f"CASE WHEN _dx IS NULL THEN NULL WHEN {length} = 0 THEN 0D "
        f"ELSE greatest(0D, least(1D, try_divide({dot}, {length}))) END AS closest_t",
    )
    df = df.selectExpr("*", *[f"c{a}_mm - _p{a} - closest_t * _d{a} AS d{a}_mm" for a in AXES])
    size = " + ".join(f"d{a}_mm * d{a}_mm" for a in AXES)
    in_voxels = " + ".join(f"pow(d{a}_mm / step_{a}, 2)" for a in AXES)
    return df.selectExpr(
        *features.columns, "closest_t", *[f"d{a}_mm" for a in AXES],
        f"sqrt({size}) AS curve_offset_mm", f"sqrt({in_voxels}) AS curve_offset_voxel",
    )


def curvature(features: DataFrame) -> DataFrame:
    """Tangent angle to z per label, angle to the next tangent, and the case range.

    Tangents are central differences, one-sided at the ends; cases with a
    single label have none.
    """
    w = LABEL_WINDOW
    df = features.selectExpr(
        "case_id", "label", "level_name",
        *[f"coalesce(lead(c{a}_mm) OVER {w}, c{a}_mm) - coalesce(lag(c{a}_mm) OVER {w}, c{a}_mm) AS _t{a}" for a in AXES],
        "count(1) OVER (PARTITION BY case_id) AS _labels",
    ).filter("_labels > 1")
    df = df.selectExpr("*", "sqrt({}) AS _size".format(" + ".join(f"_t{a} * _t{a}" for a in AXES)))
    df = df.selectExpr("*", *[f"IF(_size < 1e-12, 0D, try_divide(_t{a}, _size)) AS _u{a}" for a in AXES])
    angle = "degrees(acos(greatest(-1D, least(1D, {}))))"
    turn = " + ".join(f"_u{a} * lead(_u{a}) OVER {w}" for a in AXES)
    df = df.selectExpr(
        "*",
        f"IF(_size < 1e-12, 0D, {angle.format('_uz')}) AS tangent_angle_deg",
        f"CASE WHEN lead(label) OVER {w} IS NULL THEN NULL WHEN _size < 1e-12 OR lead(_size) OVER {w} < 1e-12 THEN 0D "
        f"ELSE {angle.format(turn)} END AS inter_tangent_angle_deg",
    )
    return df.selectExpr(
        "case_id", "label", "level_name", "tangent_angle_deg", "inter_tangent_angle_deg",
        "max(tangent_angle_deg) OVER (PARTITION BY case_id) - min(tangent_angle_deg) OVER (PARTITION BY case_id) "
        "AS total_curvature_deg",
    )


def progression(features: DataFrame) -> DataFrame:
    """Position u in [0, 1] of every label along the spatial order of the case.

    u is the cumulative chord length through the centroids sorted along the
    stacking axis; it is reversed where labels run against that axis. A pair
    (label, next_label) is non-monotonic when u does not advance.
    """
    w, case = LABEL_WINDOW, "(PARTITION BY case_id)"
    s = "(PARTITION BY case_id ORDER BY stack_position, label)"
    gap = " + ".join(f"pow(lead(c{a}_mm) OVER {s} - c{a}_mm, 2)" for a in AXES)
    df = features.selectExpr(
        "case_id", "label", "level_name", "stack_position", f"sqrt({gap}) AS _step",
        f"row_number() OVER {s} AS _slot", f"row_number() OVER {w} AS _order", f"count(1) OVER {case} AS _n",
    ).filter("_n > 1")
    walked = "(PARTITION BY case_id ORDER BY stack_position, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    df = df.selectExpr("*", f"coalesce(sum(_step) OVER {walked}, 0D) AS _walk", f"sum(_step) OVER {case} AS _total")
    df = df.selectExpr(
        "*", "coalesce(try_divide(_walk, _total), (_slot - 1) / (_n - 1)) AS _u",
        f"covar_samp(double(_order), stack_position) OVER {case} < 0 AS _backwards",
    )
    df = df.selectExpr("*", "IF(_backwards, 1 - _u, _u) AS u")
    return df.selectExpr(
        "case_id", "label", "level_name", "u",
        f"lead(label) OVER {w} AS next_label", f"lead(level_name) OVER {w} AS next_level",
        f"u >= lead(u) OVER {w} AS non_monotonic",
    )


def neighbourhood(features: DataFrame, window_n: int = 3, threshold: float = 2.0) -> DataFrame:
    """Windowed mean, median, std and leave-one-out z of spacing, offset and volume.

    One row per (case, label, feature) with the label's deviation_score (the
    largest z of offset and volume) and outlier flag. A missing value takes no
    part in a window, and its own z is NULL.
    """
    half = window_n // 2
    frame = f"(PARTITION BY case_id ORDER BY label ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)"
    values = {"spacing_mm": "spacing_mm", "offset_mm": "curve_offset_mm", "volume_mm3": "physical_volume_mm3"}
    df = consecutive_spacing(curve_offsets(features)).selectExpr(
        "case_id", "label", "level_name", *values.values(), "count(1) OVER (PARTITION BY case_id) AS _n",
        *[f"collect_list(struct(label, {column} AS v)) OVER {frame} AS _w_{name}" for name, column in values.items()],
    ).filter("_n > 1")
    rows = ", ".join(
        f"named_struct('f', '{name}', 'v', {column}, 'a', transform(filter(_w_{name}, s -> s.v IS NOT NULL), s -> s.v), "
        f"'o', transform(filter(_w_{name}, s -> s.v IS NOT NULL AND s.label <> label), s -> s.v))"
        for name, column in values.items()
    )
    long = df.selectExpr(
        "case_id", "label", "level_name", "transform(_w_volume_mm3, s -> s.label) AS window_labels",
        f"inline(array({rows})) AS (feature, value, _all, _others)",
    )
    mean = "try_divide(aggregate({0}, 0D, (t, v) -> t + v), size({0}))"
    std = "sqrt(try_divide(aggregate({0}, 0D, (t, v) -> t + (v - {1}) * (v - {1})), size({0})))"
    long = long.selectExpr(
        "*", f"{mean.format('_all')} AS mean", f"{mean.format('_others')} AS _om", "array_sort(_all) AS _sorted"
    )
    long = long.selectExpr(
        "case_id", "label", "level_name", "window_labels", "feature", "value", "mean",
        "IF(size(_all) > 0, (try_element_at(_sorted, int(floor((size(_all) + 1) / 2))) "
        "+ try_element_at(_sorted, int(floor((size(_all) + 2) / 2)))) / 2, NULL) AS median",
        f"{std.format('_all', 'mean')} AS std",
        "CASE WHEN value IS NULL THEN NULL WHEN size(_others) = 0 THEN 0D "
        f"ELSE abs(value - _om) / greatest({std.format('_others', '_om')}, 1e-6D) END AS z_score",
    )
    scored = "max(IF(feature IN ('offset_mm', 'volume_mm3'), z_score, NULL)) OVER (PARTITION BY case_id, label)"
    return long.selectExpr("*", f"coalesce({scored}, 0D) AS deviation_score").selectExpr(
        "*", f"deviation_score >= {float(threshold)!r}D AS is_outlier"
    )
