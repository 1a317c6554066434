"""Bulk label edits: whole-table changes to label maps.

The edit tables name what to change per case; they have a row or a few per
case, so the voxel side is salted against a case that holds much of the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from instqc.functions.skew import salted_join
from instqc.operators.geometry import AXES, face_map, label_sums
from instqc.operators.overlap import POSITION

VOXEL = ["case_id", "x", "y", "z", "label"]


def remap(voxels: DataFrame, mapping: DataFrame) -> DataFrame:
    """Replace labels by (case_id, label, new_label); new_label 0 removes the voxels."""
    joined = salted_join(voxels, mapping, ["case_id", "label"], list(AXES), how="left")
    return joined.select(
        "case_id", *AXES, F.coalesce("new_label", "label").cast("int").alias("label")
    ).filter("label <> 0")


def shift(voxels: DataFrame, moves: DataFrame, grids: DataFrame) -> DataFrame:
    """Move labels rigidly by (case_id, label, dx, dy, dz), clipped at the grid.

    The old footprint is erased; at its new place the moved label replaces
    what was there.
    """
    plan = moves.join(grids.select("case_id", "nx", "ny", "nz"), "case_id")
    tagged = salted_join(voxels, plan, ["case_id", "label"], list(AXES), how="left")
    moving = F.col("dx").isNotNull()
    inside = F.lit(True)
    places = []
    for a in AXES:
        new = (F.col(a) + F.coalesce(F.col(f"d{a}"), F.lit(0))).cast("int")
        inside = inside & (new >= 0) & (new < F.col(f"n{a}"))
        places.append(new.alias(a))
    placed = tagged.filter(~moving | inside).select("case_id", *places, "label", moving.alias("_moved"))
    # Each voxel is read and dealt to its place once; what has moved there stays.
    taken = F.max("_moved").over(Window.partitionBy(*POSITION))
    return placed.withColumn("_taken", taken).filter(F.col("_moved") == F.col("_taken")).select(*VOXEL)


def displacement(targets: DataFrame, grids: DataFrame, distance_mm: float = 18.0) -> DataFrame:
    """Moves of (case_id, label) diagonally across the two non-stacking axes."""
    df = targets.join(face_map(grids).select("case_id", "stacking_axis", "sx", "sy", "sz"), "case_id")
    per_axis = distance_mm / 2 ** 0.5
    steps = [
        F.when(F.col("stacking_axis") == a, 0)
        .otherwise(F.greatest(F.lit(1), F.rint(per_axis / F.col(f"s{a}"))))
        .cast("int").alias(f"d{a}")
        for a in AXES
    ]
    return df.select("case_id", "label", *steps)


def crop(voxels: DataFrame, targets: DataFrame, grids: DataFrame, face: str, depth: int) -> DataFrame:
    """Moves that push labels ``depth`` voxels past a face of the grid."""
    df = label_sums(voxels).join(face_map(grids), "case_id").join(targets, ["case_id", "label"])
    steps = []
    for a in AXES:
        low = -(F.col(f"{a}_min") + depth)
        high = F.col(f"n{a}") - 1 - F.col(f"{a}_max") + depth
        steps.append(
            F.when(F.col(f"{a}_low_face") == face, low).when(F.col(f"{a}_high_face") == face, high)
            .otherwise(0).cast("int").alias(f"d{a}")
        )
    return df.select("case_id", "label", *steps)


def force_overlap(voxels: DataFrame, pairs: DataFrame, grids: DataFrame, depth: int) -> DataFrame:
    """Moves of ``target`` along the stacking axis until it is ``depth`` voxels
    inside ``neighbour``; ``pairs`` is (case_id, target, neighbour)."""
    boxes = label_sums(voxels).select("case_id", "label", *[f"{a}_{e}" for a in AXES for e in ("min", "max")])

    def side(name: str, prefix: str) -> DataFrame:
        return boxes.select(
            "case_id", F.col("label").alias(name),
            *[F.col(f"{a}_{e}").alias(f"{prefix}_{a}_{e}") for a in AXES for e in ("min", "max")],
        )

    df = pairs.join(side("target", "t"), ["case_id", "target"]).join(side("neighbour", "n"), ["case_id", "neighbour"])
    df = df.join(face_map(grids).select("case_id", "stacking_axis"), "case_id")
    steps = []
    for a in AXES:
        ahead = F.col(f"n_{a}_min") > F.col(f"t_{a}_max")
        up = F.greatest(F.lit(0), F.col(f"n_{a}_min") - F.col(f"t_{a}_max") - 1) + depth
        down = -(F.greatest(F.lit(0), F.col(f"t_{a}_min") - F.col(f"n_{a}_max") - 1) + depth)
        steps.append(
            F.when(F.col("stacking_axis") == a, F.when(ahead, up).otherwise(down))
            .otherwise(0).cast("int").alias(f"d{a}")
        )
    return df.select("case_id", F.col("target").alias("label"), *steps)


def cut(voxels: DataFrame, targets: DataFrame, grids: DataFrame, pieces: int = 2) -> DataFrame:
    """Erase one-voxel slabs that split labels into ``pieces`` along the stacking axis."""
    if pieces < 2:
        raise ValueError("a cut makes at least two pieces")
    boxes = label_sums(voxels).join(face_map(grids), "case_id").join(targets, ["case_id", "label"])
    low, high = F.lit(None).cast("int"), F.lit(None).cast("int")
    for a in AXES:
        low = F.when(F.col("stacking_axis") == a, F.col(f"{a}_min")).otherwise(low)
        high = F.when(F.col("stacking_axis") == a, F.col(f"{a}_max")).otherwise(high)
    span = high - low
    planes = F.array_distinct(F.array(*[
        (low + F.greatest(F.lit(1), F.least(span - 1, F.rint(span * i / pieces)))).cast("int")
        for i in range(1, pieces)
    ]))
    plan = boxes.filter(span >= pieces).select("case_id", "label", "stacking_axis", planes.alias("planes"))
    joined = salted_join(voxels, plan, ["case_id", "label"], list(AXES), how="left")
    position = F.lit(None).cast("int")
    for a in AXES:
        position = F.when(F.col("stacking_axis") == a, F.col(a)).otherwise(position)
    hit = F.coalesce(F.array_contains("planes", position), F.lit(False))
    return joined.filter(~hit).select(*VOXEL)


def add_blocks(voxels: DataFrame, blocks: DataFrame) -> DataFrame:
    """Fill boxes (case_id, label, x0, y0, z0, bx, by, bz) where nothing lies yet."""
    df = blocks
    for a in AXES:
        df = df.withColumn(a, F.explode(F.sequence(F.col(f"{a}0"), F.col(f"{a}0") + F.col(f"b{a}") - 1)))
    added = df.select(*[F.col(c).cast("string" if c == "case_id" else "int").alias(c) for c in VOXEL])
    free = added.join(voxels.select(*POSITION), POSITION, "left_anti")
    return voxels.select(*VOXEL).unionByName(free)


def island_blocks(voxels: DataFrame, targets: DataFrame, grids: DataFrame, side: int = 3) -> DataFrame:
    """Boxes of ``side`` cubed voxels beside labels, one empty row away along y.

    The band below the label is taken if it fits inside the grid with a margin
    of one voxel, else the band above; labels with room for neither get none.
    Occupied bands are refused as a whole.
    """
    boxes = label_sums(voxels).join(grids.select("case_id", "nx", "ny", "nz"), "case_id").join(targets, ["case_id", "label"])
    x0 = F.col("x_min")
    z0 = F.col("z_min") + F.greatest(F.lit(0), F.floor((F.col("z_max") - F.col("z_min") + 1 - side) / 2)).cast("int")
    below, above = F.col("y_min") - 1 - side, F.col("y_max") + 2
    fits = (x0 >= 1) & (x0 + side - 1 <= F.col("nx") - 2) & (z0 >= 1) & (z0 + side - 1 <= F.col("nz") - 2)
    options = F.array_compact(F.array(
        F.when(below >= 1, F.struct(F.lit(0).alias("o"), below.alias("y0"))),
        F.when(above + side - 1 <= F.col("ny") - 2, F.struct(F.lit(1).alias("o"), above.alias("y0"))),
    ))
    placed = boxes.filter(fits).select(
        "case_id", "label", x0.alias("x0"), z0.alias("z0"), F.explode(options).alias("opt")
    ).select("case_id", "label", "x0", "opt.y0", "z0", "opt.o")
    cells = placed
    for a in AXES:
        cells = cells.withColumn(a, F.explode(F.sequence(F.col(f"{a}0"), F.col(f"{a}0") + side - 1)))
    taken = cells.join(voxels.select(*POSITION), POSITION, "left_semi").select("case_id", "label", "o").distinct()
    free = placed.join(taken, ["case_id", "label", "o"], "left_anti")
    chosen = free.groupBy("case_id", "label").agg(F.min(F.struct("o", "x0", "y0", "z0")).alias("b"))
    return chosen.select(
        "case_id", "label", "b.x0", "b.y0", "b.z0", *[F.lit(side).alias(f"b{a}") for a in AXES]
    )
