"""Reading the input tables and checking that scans lie on the label grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from instqc.schemas import GRIDS, SCANS, VOXELS

RTOL, ATOL = 1e-5, 1e-4


def read_voxels(spark: SparkSession, path: str) -> DataFrame:
    """Label maps as sparse voxel rows; background rows are dropped at the scan."""
    return spark.read.schema(VOXELS).parquet(path).filter("label <> 0")


def read_scans(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCANS).parquet(path)


def read_grids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GRIDS).parquet(path)


def write_voxels(voxels: DataFrame, path: str) -> None:
    """Voxel table clustered for reading by case: range-partitioned on case and
    position, which also splits a case that is far larger than the others."""
    voxels.repartitionByRange("case_id", "x", "y").sortWithinPartitions(
        "case_id", "label", "x", "y", "z"
    ).write.mode("overwrite").parquet(path)


def alignment(grids: DataFrame, scan_grids: DataFrame) -> DataFrame:
    """Per case with a scan: same shape, affine equal within tolerance, and why not."""
    shape = [f"n{a}" for a in "xyz"]
    scan = scan_grids.select("case_id", *[F.col(c).alias(f"scan_{c}") for c in shape], F.col("affine").alias("scan_affine"))
    joined = grids.join(scan, "case_id")
    same = F.lit(True)
    for c in shape:
        same = same & (F.col(c) == F.col(f"scan_{c}"))
    close = F.forall(
        F.zip_with("scan_affine", "affine", lambda a, b: F.abs(a - b) <= ATOL + RTOL * F.abs(b)),
        lambda ok: F.coalesce(ok, F.lit(False)),
    )
    reason = F.when(~same, "scan and segmentation have mismatched shapes").when(
        ~close, "scan and segmentation have incompatible affines"
    )
    return joined.select(
        "case_id", same.alias("same_shape"), close.alias("same_affine"), reason.alias("reason")
    )


def aligned(grids: DataFrame, scan_grids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(grids that may be judged, errors): cases without a scan pass."""
    errors = alignment(grids, scan_grids).filter(F.col("reason").isNotNull()).select("case_id", "reason")
    return grids.join(errors, "case_id", "left_anti"), errors
