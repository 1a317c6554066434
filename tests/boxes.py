"""Hand-built label maps: boxes of voxels given by half-open ranges."""

import math

from pyspark.sql import functions as F

from instqc.schemas import EXPECTED, GRIDS


def voxels(spark, rows):
    """rows: (case_id, label, (x0, x1), (y0, y1), (z0, z1))."""
    flat = [(c, l, *x, *y, *z) for c, l, x, y, z in rows]
    df = spark.createDataFrame(flat, "case_id string, label int, x0 int, x1 int, y0 int, y1 int, z0 int, z1 int")
    for a in "xyz":
        df = df.withColumn(a, F.explode(F.sequence(F.col(f"{a}0"), F.col(f"{a}1") - 1)))
    return df.select("case_id", "x", "y", "z", "label")


def grids(spark, rows):
    """rows: (case_id, (nx, ny, nz), (sx, sy, sz), axcodes)."""
    flat = [
        (c, *n, *map(float, s), ax,
         [float(v) for v in (s[0], 0, 0, 0, 0, s[1], 0, 0, 0, 0, s[2], 0, 0, 0, 0, 1)])
        for c, n, s, ax in rows
    ]
    return spark.createDataFrame(flat, GRIDS)


def blocks(case="labelled_blocks"):
    return [
        (case, 1, (2, 6), (2, 6), (2, 6)),
        (case, 2, (2, 6), (10, 14), (2, 6)),
        (case, 3, (10, 14), (2, 6), (10, 14)),
    ]


SIZE = (66, 55, 215)


def spine(case, labels=(20, 21, 22, 23, 24)):
    """Five bodies of 30 x 25 x 25 voxels stacked along z on a gentle curve."""
    rows = []
    for i, label in enumerate(labels):
        x0 = 15 + round(6 * math.sin(math.pi * i / 4))
        rows.append((case, label, (x0, x0 + 30), (15, 40), (15 + 40 * i, 40 + 40 * i)))
    return rows


CORPUS = [
    ("clean_control", "pass", [], [], 0),
    ("mode1_displace", "flagged-for-review", ["mislabel"], [22], 1),
    ("mode2_fragment", "flagged-for-review", ["fragmentation"], [22], 2),
    ("mode3_inject_islands", "flagged-for-review", ["fragmentation"], [22], 3),
    ("mode4_relabel_swap", "flagged-for-review", ["mislabel"], [21, 22], 4),
    ("mode5_remove_level", "flagged-for-review", ["coverage"], [], 5),
    ("mode6_crop_at_border", "flagged-for-review", ["border"], [22], 6),
    ("mode7_sequence_break", "flagged-for-review", ["sequence"], [28], 7),
    ("mode8_force_overlap", "flagged-for-review", ["overlap"], [20, 21], 8),
]


def expected(spark):
    from instqc.operators.metrics import FAILURE_MODES

    return spark.createDataFrame([(*row, FAILURE_MODES[row[4]]) for row in CORPUS], EXPECTED)


def corpus_grids(spark):
    return grids(spark, [(row[0], SIZE, (1.0, 1.0, 1.0), "RAS") for row in CORPUS])


def base(spark):
    return voxels(spark, [r for row in CORPUS for r in spine(row[0])])


def corpus(spark):
    """The nine cases, made from the base by bulk edits."""
    from instqc.operators import edits

    start, shape = base(spark), corpus_grids(spark)
    pick = lambda case: spark.createDataFrame([(case, 22)], "case_id string, label int")
    mapping = spark.createDataFrame(
        [("mode4_relabel_swap", 21, 22), ("mode4_relabel_swap", 22, 21),
         ("mode5_remove_level", 22, 0), ("mode7_sequence_break", 24, 28)],
        "case_id string, label int, new_label int",
    )
    moves = edits.displacement(pick("mode1_displace"), shape, 18.0).unionByName(
        edits.crop(start, pick("mode6_crop_at_border"), shape, "anterior", 5)
    ).unionByName(edits.force_overlap(
        start, spark.createDataFrame([("mode8_force_overlap", 20, 21)], "case_id string, target int, neighbour int"),
        shape, 3))
    out = edits.remap(start, mapping)
    out = edits.cut(out, pick("mode2_fragment"), shape, 2)
    out = edits.add_blocks(out, edits.island_blocks(start, pick("mode3_inject_islands"), shape, 3))
    return edits.shift(out, moves, shape)
