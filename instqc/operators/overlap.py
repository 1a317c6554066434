"""Voxel-level comparisons: label overlap, and candidate against ground truth.

All joins here are on full voxel positions, which are unique or nearly so;
they need no skew handling. Everything above voxel level works on counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from instqc.functions.skew import salted_join
from instqc.operators.inventory import canonical_position, inventory, with_levels
from instqc.schemas import UNKNOWN
from instqc.session import cut_lineage

POSITION = ["case_id", "x", "y", "z"]


def _spread(labels: str) -> list[Column]:
    """Aggregates that tell the labels of a place apart: how many rows, smallest and largest label."""
    return [F.expr(f"{what}({labels}) AS {labels}_{what}") for what in ("count", "min", "max")]


def _known(labels: str) -> Column:
    """Whether ``_spread`` says which labels a place has: one label, or two rows of different ones."""
    return F.expr(f"{labels}_count = 0 OR {labels}_min = {labels}_max OR {labels}_count = 2")


def _between(labels: str) -> Column:
    """The different labels of a place, rising, where they are ``_known``, from the smallest and largest alone."""
    low, high = f"{labels}_min", f"{labels}_max"
    return F.expr(f"CASE WHEN {low} IS NULL THEN CAST(array() AS ARRAY<INT>) WHEN {low} = {high} THEN array({low}) ELSE array({low}, {high}) END")


def label_overlaps(voxels: DataFrame, levels: DataFrame) -> DataFrame:
    """Voxels shared by two labels of a case (label_a < label_b).

    Places are reduced to the number, the smallest and the largest of their
    labels first, which is all there is to know where two labels meet; only
    places with more rows are gathered in sorted sets (a position carries as
    many entries as labels overlap there).
    """
    # Nearly all positions differ: combined before the shuffle they would only fill the memory of a task and be spilled.
    place = voxels.select(*POSITION, "label").repartition(*POSITION).groupBy(*POSITION).agg(*_spread("label"))
    meeting = cut_lineage(place.filter("label_min < label_max"))
    stacked = meeting.filter(_known("label")).select("case_id", _between("label").alias("labels"))
    crowded = meeting.filter(~_known("label")).select(*POSITION)
    if crowded.take(1):
        stacked = stacked.unionByName(
            voxels.join(crowded, POSITION, "left_semi").groupBy(*POSITION)
            .agg(F.array_sort(F.collect_set("label")).alias("labels")).select("case_id", "labels"))
    later = lambda i: F.slice("labels", i + 2, F.size("labels"))
    pairs = F.flatten(F.transform(
        "labels",
        lambda a, i: F.transform(later(i), lambda b: F.struct(a.alias("label_a"), b.alias("label_b"))),
    ))
    counted = (
        stacked.select("case_id", F.explode(pairs).alias("p"))
        .groupBy("case_id", "p.label_a", "p.label_b")
        .agg(F.count(F.lit(1)).alias("overlap_voxels"))
    )
    out = counted
    for side in ("a", "b"):
        names = levels.select(
            F.col("label").alias(f"label_{side}"), F.col("level_name").alias(f"name_{side}")
        )
        out = out.join(F.broadcast(names), f"label_{side}", "left").withColumn(
            f"name_{side}", F.coalesce(f"name_{side}", F.lit(UNKNOWN))
        )
    return out.select("case_id", "label_a", "label_b", "name_a", "name_b", "overlap_voxels")


def overlap_with_base(candidate: DataFrame, base: DataFrame, pairs: DataFrame) -> DataFrame:
    """Candidate voxels of ``target`` lying on ``neighbour`` voxels of a base map.

    ``pairs`` is (case_id, target, neighbour), one row per case.
    """
    moved = salted_join(candidate, pairs, ["case_id"], ["x", "y", "z"]).filter("label = target").select(
        *POSITION, "target", "neighbour"
    )
    under = base.select(*POSITION, F.col("label").alias("neighbour"))
    return (
        moved.join(under, [*POSITION, "neighbour"])
        .groupBy("case_id", "target", "neighbour")
        .agg(F.count(F.lit(1)).alias("overlap_voxels"))
    )


def dice(candidate: DataFrame, gt: DataFrame, grids: DataFrame, levels: DataFrame) -> DataFrame:
    """Dice and Jaccard per label, matched by label value; unmatched labels kept.

    Label counts of both maps and of their intersection come from one pass:
    each (position, label) key is marked by the maps that contain it.
    """
    marked = candidate.select(*POSITION, "label", F.lit(1).alias("_c"), F.lit(0).alias("_g")).unionByName(
        gt.select(*POSITION, "label", F.lit(0).alias("_c"), F.lit(1).alias("_g"))
    )
    per_key = marked.groupBy(*POSITION, "label").agg(F.max("_c").alias("_c"), F.max("_g").alias("_g"))
    counts = per_key.groupBy("case_id", "label").agg(
        F.sum("_c").alias("candidate_voxels"),
        F.sum("_g").alias("gt_voxels"),
        F.sum(F.col("_c") * F.col("_g")).alias("intersection_voxels"),
    )
    return dice_of_counts(counts, grids, levels)


def dice_of_counts(counts: DataFrame, grids: DataFrame, levels: DataFrame) -> DataFrame:
    """Dice and Jaccard from (case_id, label, candidate_voxels, gt_voxels, intersection_voxels)."""
    a, b, i = F.col("candidate_voxels"), F.col("gt_voxels"), F.col("intersection_voxels")
    volume = F.col("sx") * F.col("sy") * F.col("sz")
    named = with_levels(counts.join(grids.select("case_id", "sx", "sy", "sz"), "case_id"), levels)
    return named.select(
        "case_id", "label", "level_name",
        canonical_position().alias("position"),
        ((a > 0) & (b > 0)).alias("matched"),
        F.coalesce(F.try_divide(2.0 * i, a + b), F.lit(0.0)).alias("dice"),
        F.coalesce(F.try_divide(i * F.lit(1.0), a + b - i), F.lit(0.0)).alias("jaccard"),
        "candidate_voxels", "gt_voxels", "intersection_voxels",
        (b * volume).alias("physical_volume_mm3"),
    )


def case_dice(per_label: DataFrame) -> DataFrame:
    """Case means over matched labels and the GT-volume-weighted Dice."""
    hit = F.col("matched")
    weight = F.when(hit, F.col("physical_volume_mm3"))
    return per_label.groupBy("case_id").agg(
        F.avg(F.when(hit, F.col("dice"))).alias("mean_dice"),
        F.avg(F.when(hit, F.col("jaccard"))).alias("mean_jaccard"),
        F.try_divide(F.sum(F.col("dice") * weight), F.sum(weight)).alias("volume_weighted_dice"),
        F.count_if(hit).alias("n_matched"),
        F.count_if(~hit).alias("n_unmatched"),
    )


def voxel_agreement(candidate: DataFrame, gt: DataFrame) -> DataFrame:
    """(case_id, gt_label, cand_label, n): joint label counts, NULL = background."""
    left = gt.select(*POSITION, F.col("label").alias("gt_label"))
    right = candidate.select(*POSITION, F.col("label").alias("cand_label"))
    return (
        left.join(right, POSITION, "full_outer")
        .groupBy("case_id", "gt_label", "cand_label")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def joint_counts(candidate: DataFrame, gt: DataFrame) -> DataFrame:
    """Everything that comparing two maps needs, from one exchange of their voxels.

    The labels of both maps are gathered per position, and positions reduced
    to counts per task. Rows (case_id, per_label, gt_label, cand_label, n):
    with ``per_label`` false the pairs of labels that meet, NULL being
    background; with it true the labels that are in one map or, where both
    columns are equal, in both at the same place.
    """
    marked = candidate.select(*POSITION, "label", F.lit(True).alias("_c")).unionByName(gt.select(*POSITION, "label", F.lit(False).alias("_c")))
    # Most places have one label or two in each map, which numbers of fixed width tell; only others are gathered in sets.
    sides = marked.select(*POSITION, F.when(F.col("_c"), F.col("label")).alias("_cand"), F.when(~F.col("_c"), F.col("label")).alias("_gt"))
    spread = sides.groupBy(*POSITION).agg(*_spread("_cand"), *_spread("_gt"))
    known = _known("_cand") & _known("_gt")
    # Places alike are counted before their labels are paired, so that pairs are made once per case and not per place.
    ends = [f"{c}_{end}" for c in ("_cand", "_gt") for end in ("min", "max")]
    alike = spread.select("case_id", known.alias("_known"), *[F.when(known, F.col(e)).alias(e) for e in ends])
    alike = alike.groupBy("case_id", "_known", *ends).agg(F.count(F.lit(1)).alias("_n"))
    places = alike.select("case_id", "_n", *[_between(c).alias(c) for c in ("_cand", "_gt")])
    pair = lambda kind, g, c: F.struct(F.lit(kind).alias("per_label"), g.alias("gt_label"), c.alias("cand_label"))
    none = F.lit(None).cast("int")
    background = lambda c: F.when(F.size(c) == 0, F.array(none)).otherwise(F.col(c))
    met = F.flatten(F.transform(background("_gt"), lambda g: F.transform(background("_cand"), lambda c: pair(False, g, c))))
    within = lambda c, v: F.when(F.array_contains(c, v), v)
    held = F.transform(F.array_union("_gt", "_cand"), lambda v: pair(True, within("_gt", v), within("_cand", v)))
    key = ["case_id", "per_label", "gt_label", "cand_label"]
    counted = lambda df: df.select("case_id", "_n", F.inline(F.concat(met, held))).groupBy(*key).agg(F.sum("_n").alias("n"))
    first = cut_lineage(counted(places))
    # Background met by background is no place of either map but one that is not known yet.
    unknown = F.expr("NOT per_label AND gt_label IS NULL AND cand_label IS NULL")
    if not first.filter(unknown).take(1):
        return first
    crowded = sides.join(spread.filter(~known).select(*POSITION), POSITION, "left_semi").groupBy(*POSITION).agg(
        F.collect_set("_cand").alias("_cand"), F.collect_set("_gt").alias("_gt")).withColumn("_n", F.lit(1).cast("long"))
    return first.filter(~unknown).unionByName(counted(crowded)).groupBy(*key).agg(F.sum("n").alias("n"))


def label_counts(joint: DataFrame) -> DataFrame:
    """What ``dice_of_counts`` takes, from ``joint_counts``."""
    gt, cand, n = F.col("gt_label"), F.col("cand_label"), F.col("n")
    total = lambda test: F.coalesce(F.sum(F.when(test, n)), F.lit(0))
    return joint.filter("per_label").groupBy("case_id", F.coalesce(gt, cand).alias("label")).agg(
        total(cand.isNotNull()).alias("candidate_voxels"), total(gt.isNotNull()).alias("gt_voxels"),
        total(gt == cand).alias("intersection_voxels"))


def agreement_counts(joint: DataFrame) -> DataFrame:
    """What ``voxel_agreement`` gives, from ``joint_counts``."""
    return joint.filter("NOT per_label").select("case_id", "gt_label", "cand_label", "n")


def label_values(candidate: DataFrame, gt: DataFrame) -> DataFrame:
    """Label values present in either map of a case."""
    return inventory(candidate).select("case_id", "label").union(
        inventory(gt).select("case_id", "label")
    ).distinct()
