"""Finding cases among file paths, choosing subsets, and reading manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from instqc.functions.skew import BROADCAST_KEYS
from instqc.session import cut_lineage

ROLES = ("gt", "candidate")
SEG_SUFFIX = "_seg.nii.gz"
SCAN_SUFFIX = "_scan.nii.gz"


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path) of the files below ``root``; file contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
        .load(root).select("path")
    )


def glob_regex(pattern: str) -> str:
    """Regular expression of a shell pattern: ``**/`` spans folders, ``*`` and ``?`` do not."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            ch = pattern[i]
            out, i = out + (ch if ch.isalnum() or ch in "/_-" else "\\" + ch), i + 1
    return f"^{out}$"


def discover(
    files: DataFrame, seg_pattern: str, id_regex: str, role: str = "gt", root: str = ""
) -> tuple[DataFrame, DataFrame]:
    """(cases, errors) from relative file paths.

    ``id_regex`` has one capturing group, the case id. Paths it does not match
    and ids found twice are errors, not cases.
    """
    if role not in ROLES:
        raise ValueError(f"role must be one of {ROLES}, got {role!r}")
    below = files.filter(F.col("path").startswith(root)).select(
        "path", F.expr(f"substring(path, {len(root) + 1})").alias("rel")
    )
    segs = below.filter(F.col("rel").rlike(glob_regex(seg_pattern))).select(
        F.nullif(F.regexp_extract("rel", id_regex, 1), F.lit("")).alias("case_id"),
        F.col("path").alias("seg_path"), "rel",
    )
    copies = segs.filter(F.col("case_id").isNotNull()).groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("seg_path").alias("seg_path"), F.min("rel").alias("rel")
    )
    cases = copies.filter("n = 1").select("case_id", "seg_path", "rel", F.lit(role).alias("role"))
    errors = copies.filter("n > 1").select(
        F.col("seg_path").alias("path"), F.concat(F.lit("duplicate case_id "), "case_id").alias("reason")
    ).unionByName(
        segs.filter(F.col("case_id").isNull()).select(
            F.col("seg_path").alias("path"), F.lit("case_id pattern does not match").alias("reason")
        )
    )
    return cases, errors


def select_subset(
    cases: DataFrame, ids: DataFrame | Sequence[str] | None = None, pattern: str | None = None
) -> DataFrame:
    """Cases whose id is listed, or matches a shell pattern."""
    if ids is not None:
        if not isinstance(ids, DataFrame):
            return cases.filter(F.col("case_id").isin(*[str(i) for i in ids]))
        return cases.join(ids.select(F.col(ids.columns[0]).cast("string").alias("case_id")), "case_id", "left_semi")
    if pattern is not None:
        return cases.filter(F.col("case_id").rlike(glob_regex(pattern)))
    return cases


def ids_from_csv(spark: SparkSession, path: str, column: str = "case_id") -> DataFrame:
    """Trimmed, non-blank ids of one column of a CSV file with a header."""
    table = spark.read.option("header", "true").csv(path)
    if column not in table.columns:
        raise ValueError(f"{path} has no column {column!r} (columns: {table.columns})")
    return table.select(F.trim(column).alias("case_id")).filter("case_id <> ''")


def pair_scans(cases: DataFrame, files: DataFrame, template: str, root: str = "") -> DataFrame:
    """Adds scan_path: the file the template names for a case, or NULL.

    ``{case_id}`` (or ``{id}``) in the template stands for the case id.
    """
    parts = template.replace("{id}", "{case_id}").split("{case_id}")
    pieces = [F.lit(root + parts[0])]
    for part in parts[1:]:
        pieces += [F.col("case_id"), F.lit(part)]
    wanted = cases.withColumn("_scan", F.concat(*pieces))
    return wanted.join(
        files.select(F.col("path").alias("_scan"), F.col("path").alias("scan_path")), "_scan", "left"
    ).drop("_scan")


def ingest_listing(
    files: DataFrame, seg_suffix: str = SEG_SUFFIX, scan_suffix: str = SCAN_SUFFIX
) -> DataFrame:
    """(case_id, seg_path, scan_path) of files named <case_id><suffix>, scan optional."""
    name = F.element_at(F.split("path", "/"), -1)
    folder = F.regexp_replace("path", "[^/]*$", "")
    segs = files.filter(F.col("path").endswith(seg_suffix)).select(
        F.expr(f"substring(element_at(split(path, '/'), -1), 1, length(element_at(split(path, '/'), -1)) - {len(seg_suffix)})").alias("case_id"),
        folder.alias("_folder"), F.col("path").alias("seg_path"),
    )
    scans = files.filter(F.col("path").endswith(scan_suffix)).select(F.col("path").alias("scan_path"))
    segs = segs.withColumn("_scan", F.concat("_folder", "case_id", F.lit(scan_suffix)))
    return segs.join(scans, segs["_scan"] == scans["scan_path"], "left").select("case_id", "seg_path", "scan_path")


MANIFEST_CASE = (
    "case_id string, gt string, candidate string, "
    "expected struct<expected_verdict:string, expected_rule_ids:array<string>, "
    "expected_labels:array<int>, failure_mode:int, failure_mode_name:string>"
)


def read_manifest(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row per case of JSON manifests ({"cases": [...]}), one per file or per line."""
    schema = f"manifest_version string, cases array<struct<{MANIFEST_CASE.replace(' string', ':string').replace('expected struct', 'expected:struct')}>>"
    return spark.read.schema(schema).json(path, multiLine=multi_line).select(F.inline("cases"))


def read_manifest_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line of manifests that hold one case a line.

    Such a file is split like any text, so a manifest of any size is read and
    checked in parallel, which one JSON value over many lines cannot be. A line
    that is not a case in JSON keeps its text in ``malformed``; blank lines are
    nothing.
    """
    return spark.read.schema(f"{MANIFEST_CASE}, malformed string").option("columnNameOfCorruptRecord", "malformed").json(path)


def check_manifest(cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid cases, errors): required fields present, ids unique, and lines well formed where they were read by line."""
    broken = F.col("malformed").isNotNull() if "malformed" in cases.columns else F.lit(False)
    missing = (
        F.when(broken, "malformed line")
        .when(F.col("case_id").isNull(), "missing case_id")
        .when(F.col("gt").isNull(), "missing gt")
        .when(F.col("expected").isNull(), "missing expected")
        .when(F.col("expected.expected_verdict").isNull(), "missing expected_verdict")
    )
    marked = cases.withColumn("reason", missing)
    repeated = cut_lineage(cases.filter(F.col("case_id").isNotNull()).groupBy("case_id").agg(
        F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("case_id"))
    # Only lines without another fault are looked up, as malformed ones share the missing id; the few repeated ids are hashed, so that no line is sorted.
    keys = F.broadcast(repeated) if repeated.count() <= BROADCAST_KEYS else repeated.hint("shuffle_hash")
    sound, faulty = marked.filter(F.col("reason").isNull()), marked.filter(F.col("reason").isNotNull())
    copies = sound.join(keys, "case_id", "left_semi").withColumn("reason", F.lit("duplicate case_id")).select(*marked.columns)
    return sound.join(keys, "case_id", "left_anti").select(*cases.columns), faulty.unionByName(copies)


def expected_table(cases: DataFrame) -> DataFrame:
    """The flat expectation table of manifest cases."""
    return cases.select(
        "case_id", "expected.expected_verdict",
        F.coalesce("expected.expected_rule_ids", F.array().cast("array<string>")).alias("expected_rule_ids"),
        F.coalesce("expected.expected_labels", F.array().cast("array<int>")).alias("expected_labels"),
        "expected.failure_mode", "expected.failure_mode_name",
    )
