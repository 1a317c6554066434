"""Input and output table contracts, with the value of every fixed list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOXELS = T.StructType([
    T.StructField("case_id", T.StringType()),
    T.StructField("x", T.IntegerType()),
    T.StructField("y", T.IntegerType()),
    T.StructField("z", T.IntegerType()),
    T.StructField("label", T.IntegerType()),
])

SCANS = T.StructType([
    T.StructField("case_id", T.StringType()),
    T.StructField("x", T.IntegerType()),
    T.StructField("y", T.IntegerType()),
    T.StructField("z", T.IntegerType()),
    T.StructField("hu", T.DoubleType()),
])

GRIDS = T.StructType([
    T.StructField("case_id", T.StringType()),
    T.StructField("nx", T.IntegerType()),
    T.StructField("ny", T.IntegerType()),
    T.StructField("nz", T.IntegerType()),
    T.StructField("sx", T.DoubleType()),
    T.StructField("sy", T.DoubleType()),
    T.StructField("sz", T.DoubleType()),
    T.StructField("axcodes", T.StringType()),
    T.StructField("affine", T.ArrayType(T.DoubleType())),
])

EXPECTED = T.StructType([
    T.StructField("case_id", T.StringType()),
    T.StructField("expected_verdict", T.StringType()),
    T.StructField("expected_rule_ids", T.ArrayType(T.StringType())),
    T.StructField("expected_labels", T.ArrayType(T.IntegerType())),
    T.StructField("failure_mode", T.IntegerType()),
    T.StructField("failure_mode_name", T.StringType()),
])

FEATURE_LONG = T.StructType([
    T.StructField("case_id", T.StringType()),
    T.StructField("level_name", T.StringType()),
    T.StructField("size_proxy", T.DoubleType()),
    T.StructField("feature", T.StringType()),
    T.StructField("value", T.DoubleType()),
])

# Label value -> level name.
LEVEL_OF_LABEL = {
    1: "C1", 2: "C2", 3: "C3", 4: "C4", 5: "C5", 6: "C6", 7: "C7",
    8: "T1", 9: "T2", 10: "T3", 11: "T4", 12: "T5", 13: "T6", 14: "T7",
    15: "T8", 16: "T9", 17: "T10", 18: "T11", 19: "T12",
    20: "L1", 21: "L2", 22: "L3", 23: "L4", 24: "L5", 25: "L6",
    26: "S1", 27: "Cocc", 28: "T13",
    29: "S2", 30: "S3", 31: "S4", 32: "S5", 33: "S6",
}

# Head-to-tail order of the levels.
HEAD_TO_TAIL = (
    "C1", "C2", "C3", "C4", "C5", "C6", "C7",
    "T1", "T2", "T3", "T4", "T5", "T6", "T7", "T8", "T9", "T10", "T11", "T12", "T13",
    "L1", "L2", "L3", "L4", "L5", "L6", "S1", "S2", "S3", "S4", "S5", "S6", "Cocc",
)

# Level groups that carry size bounds.
LEVEL_GROUPS = {"C": "cervical", "T": "thoracic", "L": "lumbar"}

# Face at the low and high end of an axis, by axis code.
AXIS_FACES = {
    "R": ("left", "right"),
    "L": ("right", "left"),
    "A": ("posterior", "anterior"),
    "P": ("anterior", "posterior"),
    "S": ("inferior", "superior"),
    "I": ("superior", "inferior"),
}

# Faces in reporting order: the two ends of the stack, then the in-plane ones.
END_FACES = ("superior", "inferior")
IN_PLANE_FACES = ("left", "right", "anterior", "posterior")
FACES = END_FACES + IN_PLANE_FACES

# Verdict severities.
SEVERITY_LABELS = ("pass", "flagged-for-review", "fail")
PASS, FLAG, FAIL = range(3)

UNKNOWN = "unknown"
UNKNOWN_RANK = len(HEAD_TO_TAIL)


def level_group(name: str) -> str | None:
    """Bounds group of a level; sacral and coccygeal levels have none."""
    return LEVEL_GROUPS.get(name[0]) if name[1:].isdigit() else None


def levels(spark: SparkSession, convention: dict[int, str] | None = None) -> DataFrame:
    """The level dimension (label, level_name, rank, grp): one row per label value.

    A convention with a key that is no integer, or with one name (case and
    outer blanks aside) for two label values, is an error.
    """
    names = LEVEL_OF_LABEL if convention is None else convention
    seen: dict[str, int] = {}
    for value, name in names.items():
        if isinstance(value, bool) or not isinstance(value, int):
            raise ValueError(f"label value {value!r} is not an integer")
        other = seen.setdefault(name.strip().upper(), value)
        if other != value:
            raise ValueError(f"level name {name!r} is given to the labels {other} and {value}")
    rank = {name: i for i, name in enumerate(HEAD_TO_TAIL)}
    rows = ", ".join(
        "({}, '{}', {}, {})".format(
            value,
            name.replace("'", "''"),
            rank.get(name, "CAST(NULL AS INT)"),
            f"'{level_group(name)}'" if level_group(name) else "CAST(NULL AS STRING)",
        )
        for value, name in names.items()
    )
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(label, level_name, rank, grp)")


def axis_faces(spark: SparkSession) -> DataFrame:
    """The six-row dimension (code, low_face, high_face)."""
    rows = ", ".join(f"('{c}', '{lo}', '{hi}')" for c, (lo, hi) in AXIS_FACES.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(code, low_face, high_face)")


def severity_level(label: str) -> int:
    """Ordered integer of a severity label; an unknown label is an error."""
    if label not in SEVERITY_LABELS:
        raise ValueError(f"unknown severity {label!r}; known: {list(SEVERITY_LABELS)}")
    return SEVERITY_LABELS.index(label)


def severity_label(severity):
    """Label column of an integer severity column."""
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITY_LABELS]), severity + 1)


def severity_of(label):
    """Integer severity column of a label column; NULL for an unknown label."""
    out = F.when(label == SEVERITY_LABELS[0], PASS)
    for value, text in enumerate(SEVERITY_LABELS[1:], start=1):
        out = out.when(label == text, value)
    return out
