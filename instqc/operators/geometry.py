"""Per-label geometry, centroid and orientation from one aggregation.

Voxel rows are only counted and summed, in voxel units; spacing, faces and
names are applied afterwards to one row per label. The voxel table is thus
shuffled as partial aggregates only and never joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from instqc.functions.skew import salted_join
from instqc.operators.inventory import with_levels
from instqc.schemas import END_FACES, FACES, axis_faces

AXES = ("x", "y", "z")
PAIRS = (("x", "x"), ("y", "y"), ("z", "z"), ("x", "y"), ("x", "z"), ("y", "z"))


def label_sums(voxels: DataFrame) -> DataFrame:
    """Counts, ranges and first and second moments per (case, label)."""
    aggregates = ["count(1) AS voxel_count"]
    for a in AXES:
        aggregates += [f"min({a}) AS {a}_min", f"max({a}) AS {a}_max", f"sum(double({a})) AS s{a}"]
    aggregates += [f"sum(double({a}) * {b}) AS s{a}{b}" for a, b in PAIRS]
    return voxels.groupBy("case_id", "label").agg(*[F.expr(e) for e in aggregates])


def face_map(grids: DataFrame) -> DataFrame:
    """Face names at the low and high end of each axis, and the stacking axis."""
    out = grids
    for i, a in enumerate(AXES, start=1):
        faces = axis_faces(grids.sparkSession).selectExpr(
            f"code AS _c{a}", f"low_face AS {a}_low_face", f"high_face AS {a}_high_face"
        )
        out = out.withColumn(f"_c{a}", F.expr(f"substring(axcodes, {i}, 1)")).join(
            F.broadcast(faces), f"_c{a}", "left"
        )
    ends = ", ".join(f"'{f}'" for f in END_FACES)
    stacking = "CASE " + " ".join(f"WHEN {a}_low_face IN ({ends}) THEN '{a}'" for a in AXES) + " END"
    return out.withColumn("stacking_axis", F.expr(stacking)).drop(*[f"_c{a}" for a in AXES])


def reorient(voxels: DataFrame, grids: DataFrame) -> DataFrame:
    """Voxel coordinates in RAS+ order.

    Axis codes fix, for each target axis, the source axis and its direction.
    """
    header = grids.select("case_id", "nx", "ny", "nz", "axcodes")
    joined = salted_join(voxels, header, ["case_id"], ["x", "y", "z"])

    def target(positive: str, negative: str):
        out = F.lit(None).cast("int")
        for i, a in enumerate(AXES, start=1):
            code = F.substring("axcodes", i, 1)
            out = (
                F.when(code == positive, F.col(a))
                .when(code == negative, F.col(f"n{a}") - 1 - F.col(a))
                .otherwise(out)
            )
        return out.cast("int")

    return joined.select(
        "case_id",
        target("R", "L").alias("x"),
        target("A", "P").alias("y"),
        target("S", "I").alias("z"),
        "label",
    )


def label_features(voxels: DataFrame, grids: DataFrame, levels: DataFrame) -> DataFrame:
    """One row per (case, label): geometry, centroid, orientation and faces.

    Expressions are given as SQL text: there are many, and text is parsed in
    one step where column objects cost a driver round trip per operator.
    """
    header = face_map(grids).selectExpr(
        "case_id", "nx", "ny", "nz", *[f"s{a} AS step_{a}" for a in AXES],
        *[f"{a}_{side}_face" for a in AXES for side in ("low", "high")], "stacking_axis",
    )
    df = with_levels(label_sums(voxels).join(header, "case_id"), levels)
    columns = [
        "case_id", "label", "level_name", "rank", "grp", "voxel_count",
        "voxel_count * step_x * step_y * step_z AS physical_volume_mm3",
    ]
    for a in AXES:
        columns += [
            f"{a}_min", f"{a}_max",
            f"{a}_min * step_{a} AS {a}_min_mm", f"{a}_max * step_{a} AS {a}_max_mm",
            f"({a}_max - {a}_min + 1) * step_{a} AS extent_{a}_mm",
            f"s{a} / voxel_count AS c{a}", f"s{a} / voxel_count * step_{a} AS c{a}_mm", f"step_{a}",
        ]
    for face in FACES:
        touch = " OR ".join(
            f"({a}_low_face = '{face}' AND {a}_min = 0) OR ({a}_high_face = '{face}' AND {a}_max = n{a} - 1)"
            for a in AXES
        )
        columns.append(f"coalesce({touch}, false) AS touches_{face}")
    columns.append(
        "CASE stacking_axis " + " ".join(f"WHEN '{a}' THEN s{a} / voxel_count" for a in AXES) + " END AS stack_position"
    )
    for a, b in PAIRS:
        columns.append(
            f"try_divide(s{a}{b} - s{a} * (s{b} / voxel_count), voxel_count - 1) * step_{a} * step_{b} AS cov_{a}{b}"
        )
    return with_orientation(df.selectExpr(*columns))


def with_orientation(df: DataFrame) -> DataFrame:
    """Adds eigenvalue_ratio and the unit principal axis from the covariances.

    The two leading eigenvalues have a closed form. The rank of the matrix is
    tested first, on the sum of its principal 2x2 minors, because the closed
    form loses small eigenvalues. The axis is the longest cross product of two
    rows of (A - first eigenvalue); where that vanishes (two equal leading
    eigenvalues) it is the coordinate axis with the largest variance. Its
    largest component is made positive.
    """
    keep = df.columns
    xx, yy, zz, xy, xz, yz = (f"cov_{a}{b}" for a, b in PAIRS)
    dx, dy, dz = (f"({c} - _m)" for c in (xx, yy, zz))
    df = df.selectExpr("*", f"{xx} + {yy} + {zz} AS _t", f"({xx} + {yy} + {zz}) / 3 AS _m")
    df = df.selectExpr(
        "*",
        f"sqrt(({dx} * {dx} + {dy} * {dy} + {dz} * {dz} + 2 * ({xy} * {xy} + {xz} * {xz} + {yz} * {yz})) / 6) AS _p",
        f"{dx} * ({dy} * {dz} - {yz} * {yz}) - {xy} * ({xy} * {dz} - {yz} * {xz}) + {xz} * ({xy} * {yz} - {dy} * {xz}) AS _d",
        f"{xx} * {yy} - {xy} * {xy} + {xx} * {zz} - {xz} * {xz} + {yy} * {zz} - {yz} * {yz} AS _minors",
    )
    df = df.selectExpr("*", "acos(greatest(-1D, least(1D, coalesce(try_divide(_d, 2 * _p * _p * _p), 1D)))) / 3 AS _phi")
    df = df.selectExpr("*", "_m + 2 * _p * cos(_phi) AS _l1", "_m + 2 * _p * cos(_phi + 2 * pi() / 3) AS _l3")
    u, v, w = (
        (f"({xx} - _l1)", xy, xz), (xy, f"({yy} - _l1)", yz), (xz, yz, f"({zz} - _l1)"),
    )
    crosses = []
    for k, (p, q) in enumerate(((u, v), (u, w), (v, w))):
        parts = [
            f"{p[1]} * {q[2]} - {p[2]} * {q[1]}", f"{p[2]} * {q[0]} - {p[0]} * {q[2]}", f"{p[0]} * {q[1]} - {p[1]} * {q[0]}",
        ]
        crosses.append("named_struct({})".format(", ".join(f"'{a}', {part}" for a, part in zip(AXES, parts))))
    df = df.selectExpr("*", f"array({', '.join(crosses)}) AS _crosses")
    df = df.selectExpr(
        "*", "array_max(transform(_crosses, c -> struct(sqrt(c.x * c.x + c.y * c.y + c.z * c.z) AS size, c.x, c.y, c.z))) AS _axis",
        f"CASE WHEN {xx} >= {yy} AND {xx} >= {zz} THEN 'x' WHEN {yy} >= {zz} THEN 'y' ELSE 'z' END AS _widest",
        "voxel_count <= 1 OR _t <= 1e-12 AS _point",
    )
    axis = [
        f"CASE WHEN _point THEN 0D WHEN _axis.size <= 1e-12 * _t * _t THEN CAST(_widest = '{a}' AS DOUBLE) "
        f"ELSE _axis.{a} / _axis.size END AS _p{a}"
        for a in AXES
    ]
    df = df.selectExpr("*", *axis)
    df = df.selectExpr(
        "*",
        "CASE WHEN abs(_px) >= abs(_py) AND abs(_px) >= abs(_pz) THEN _px WHEN abs(_py) >= abs(_pz) THEN _py ELSE _pz END AS _lead",
    )
    ratio = (
        "CASE WHEN _point THEN 0D WHEN _minors <= 1e-9 * _t * _t THEN double('Infinity') "
        "ELSE try_divide(_l1, _t - _l1 - _l3) END AS eigenvalue_ratio"
    )
    return df.selectExpr(*keep, ratio, *[f"IF(_lead < 0, -_p{a}, _p{a}) AS axis_{a}" for a in AXES])


def size_proxy(features: DataFrame) -> DataFrame:
    """(case_id, size_proxy): mean volume of the recognised labels."""
    return (
        features.filter(F.col("rank").isNotNull())
        .groupBy("case_id")
        .agg(F.avg("physical_volume_mm3").alias("size_proxy"))
    )
