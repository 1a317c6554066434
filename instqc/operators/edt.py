"""Exact distance transform of labels and the centres derived from it.

Distances are separable, and two axes are done in one plane: one pass per axis along maximal runs of a label in a
line of voxels. Beyond the ends of a run the nearest background voxel of that
line is the adjacent one, so only the run and its two neighbours matter, and a
run is never longer than the grid. Outside the grid is not background.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from instqc.functions.lines import lowered, spread, whole_groups
from instqc.functions.skew import BROADCAST_KEYS, case_join, salted_join
from instqc.operators.inventory import with_levels
from instqc.session import cut_lineage

KEYS = ["case_id", "label"]
AXES = ("x", "y", "z")
RADIUS = 4
ATLAS_AXIS = ("C1", "C2")


CELL = "case_id string, label int, x int, y int, z int, nx int, ny int, nz int"


def _in_planes(df: DataFrame, axis: str, work, schema: str) -> DataFrame:
    """``work`` on whole planes of labels: the voxels of one label at one place of ``axis``.

    A plane is never larger than the grid's. Rows are dealt and sorted, and
    pass as they are, so nothing is collected by group.
    """
    plane = [*KEYS, axis]
    rows = df.repartition(*plane).sortWithinPartitions(*plane)
    return rows.mapInArrow(whole_groups(plane, work), schema)


def _numbers(table: pa.Table) -> dict[str, np.ndarray]:
    return {c: table[c].to_numpy().astype(np.int64) for c in (*AXES, "nx", "ny", "nz")}


def _line(at: dict[str, np.ndarray], axis: str) -> np.ndarray:
    """A number per line along ``axis``."""
    p, q = (at[a] for a in AXES if a != axis)
    return q * (p.max() - p.min() + 1) + p if len(p) else p


def _lower(axes: tuple[str, ...]):
    """Lower ``d2`` to the best squared distance reachable along ``axes``, one after another.

    ``d2`` NULL means no background found so far. The lower envelope of the
    parabolas over a run gives the minimum in linear time.
    """
    def work(table: pa.Table, group: np.ndarray) -> pa.Table:
        at = _numbers(table)
        d2 = table["d2"].cast(pa.float64()).to_numpy()
        d2 = np.where(np.isnan(d2), np.inf, d2)
        for axis in axes:
            d2 = lowered(group, _line(at, axis), at[axis], d2, at[f"n{axis}"])
        known = np.isfinite(d2)
        column = pa.array(np.where(known, d2, 0).astype(np.int64), mask=~known)
        return table.set_column(table.schema.get_field_index("d2"), "d2", column)

    return work


def distance(voxels: DataFrame, grids: DataFrame) -> DataFrame:
    """(case_id, label, x, y, z, edt): distance in voxels to the nearest voxel
    outside the label; NULL when the label fills its whole grid."""
    header = grids.select("case_id", "nx", "ny", "nz")
    df = case_join(voxels.select(*KEYS, *AXES), header, list(AXES)).select(*KEYS, *AXES, "nx", "ny", "nz", F.lit(None).cast("long").alias("d2"))
    df = _in_planes(df, "x", _lower(("z", "y")), f"{CELL}, d2 long")
    df = _in_planes(df, "y", _lower(("x",)), f"{CELL}, d2 long")
    return df.select(*KEYS, *AXES, *[f"n{a}" for a in AXES], F.sqrt("d2").alias("edt"))


def _mean_position(df: DataFrame, prefix: str) -> list[Column]:
    return [F.avg(a).alias(f"{prefix}_{a}") for a in AXES]


def smooth_centre(field: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Mean position of the voxels at least ``threshold`` times the label's peak deep."""
    peak = field.groupBy(*KEYS).agg(F.max("edt").alias("_peak"))
    core = salted_join(field, peak, KEYS, list(AXES)).filter(F.col("edt") >= threshold * F.col("_peak"))
    return core.groupBy(*KEYS).agg(*_mean_position(core, "smooth"))


def gaussian_kernel(sigma: float = 1.0, radius: int = RADIUS) -> list[float]:
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [w / sum(weights) for w in weights]


def _smooth(axes: tuple[str, ...], kernel: np.ndarray, only_top: bool = False):
    """Convolution along ``axes`` as sums over shifted lines; the border is mirrored at the voxel edge.

    ``only_top`` leaves of every plane what may be its largest at nine decimals.
    """
    def work(table: pa.Table, group: np.ndarray) -> pa.Table:
        at = _numbers(table)
        v = np.nan_to_num(table["v"].to_numpy(), nan=0.0)
        row = np.arange(table.num_rows)
        for axis in axes:
            cell, place, v = spread(group, _line(at, axis), at[axis], v, at[f"n{axis}"], kernel)
            at = {c: values[cell] for c, values in at.items()} | {axis: place}
            group, row = group[cell], row[cell]
        if only_top and len(v):
            top = np.full(group.max() + 1, -np.inf)
            np.maximum.at(top, group, v)
            keep = v >= top[group] - 1e-8
            at, row, v = {c: values[keep] for c, values in at.items()}, row[keep], v[keep]
        keys = {c: table[c].take(pa.array(row)) for c in KEYS}
        return pa.table({**keys, **{c: pa.array(values, pa.int32()) for c, values in at.items()}, "v": v})

    return work


def strict_centre(field: DataFrame, sigma: float = 1.0) -> DataFrame:
    """Position of the largest Gaussian-smoothed distance; ties go to the first
    voxel in x, y, z order (values are compared at nine decimals)."""
    kernel = np.array(gaussian_kernel(sigma))
    df = field.select(*KEYS, *AXES, *[f"n{a}" for a in AXES], F.col("edt").alias("v"))
    df = _in_planes(df, "z", _smooth(("x", "y"), kernel), f"{CELL}, v double")
    df = _in_planes(df, "x", _smooth(("z",), kernel, True), f"{CELL}, v double")
    first = F.min_by(F.struct(*AXES), F.struct(-F.round("v", 9), *AXES))
    return df.groupBy(*KEYS).agg(first.alias("_p")).select(
        *KEYS, *[F.col(f"_p.{a}").cast("double").alias(f"strict_{a}") for a in AXES]
    )


def depths_at(centres: DataFrame, field: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    """Depth below the label surface at the rounded centres; 0 outside the label.

    One row per label and centre is looked up in the field: few are broadcast
    after a count, so that the field is not shuffled.
    """
    places = F.array(*[
        F.struct(F.lit(p).alias("_which"), *[F.rint(f"{p}_{a}").cast("int").alias(a) for a in AXES]) for p in prefixes])
    at = cut_lineage(centres.select(*KEYS, F.inline(places)))
    keys = F.broadcast(at) if at.count() <= BROADCAST_KEYS else at
    depth = lambda p: F.coalesce(F.max(F.when(F.col("_which") == p, F.col("edt") - 0.5)), F.lit(0.0))
    hit = field.select(*KEYS, *AXES, "edt").join(keys, [*KEYS, *AXES]).groupBy(*KEYS).agg(
        *[F.greatest(F.lit(0.0), depth(p)).alias(f"depth_{p}") for p in prefixes])
    return at.select(*KEYS).distinct().join(hit, KEYS, "left").fillna(0.0)


def centres(voxels: DataFrame, grids: DataFrame, levels: DataFrame) -> DataFrame:
    """Smooth and strict centres (voxel and mm) and their depths per label.

    The distance field has four consumers and takes two shuffles to make, so
    it is written once.
    """
    field = cut_lineage(distance(voxels, grids))
    both = cut_lineage(smooth_centre(field).join(strict_centre(field), KEYS))
    both = both.join(depths_at(both, field, ("smooth", "strict")), KEYS)
    df = with_levels(both.join(grids.select("case_id", "sx", "sy", "sz"), "case_id"), levels)
    mm = [
        (F.col(f"{prefix}_{a}") * F.col(f"s{a}")).alias(f"{prefix}_{a}_mm")
        for prefix in ("smooth", "strict") for a in AXES
    ]
    return df.select(
        *KEYS, "level_name", F.col("level_name").isin(*ATLAS_AXIS).alias("is_atlas_axis"),
        *[f"{p}_{a}" for p in ("smooth", "strict") for a in AXES], *mm, "depth_smooth", "depth_strict",
    )
