"""Writing and reading reference tables, documents and reports."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from instqc.operators.reference import SCHEMA_VERSION
from instqc.schemas import FACES, severity_label

AXES = ("x", "y", "z")


def write_reference(stats: DataFrame, meta: DataFrame, path: str) -> None:
    """A reference as two Parquet tables below ``path``."""
    stats.write.mode("overwrite").parquet(f"{path}/stats")
    meta.write.mode("overwrite").parquet(f"{path}/meta")


def read_reference(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(stats, meta); any row of another schema version fails the read."""
    meta = spark.read.parquet(f"{path}/meta")
    version = meta.select("schema_version").first()
    if version is None or version[0] != SCHEMA_VERSION:
        raise ValueError(f"reference at {path} has version {version and version[0]!r}, need {SCHEMA_VERSION!r}")
    return spark.read.parquet(f"{path}/stats"), meta


def reference_document(stats: DataFrame) -> DataFrame:
    """Nested form: one row per level, stratum -> feature -> statistics."""
    cell = F.struct("n", "mean", "std", "min", "max", "pcts")
    by_stratum = stats.groupBy("level_name", "stratum").agg(
        F.map_from_entries(_in_order(F.collect_list(F.struct("feature", cell.alias("stats"))), "feature")).alias("features")
    )
    return by_stratum.groupBy("level_name").agg(
        F.map_from_entries(F.collect_list(F.struct("stratum", "features"))).alias("strata")
    )


def _in_order(items, key: str):
    """Gathered structs sorted by one field (the others may hold maps)."""
    return F.array_sort(items, lambda a, b: F.when(a[key] < b[key], -1).when(a[key] > b[key], 1).otherwise(0))


def _per_label(entry):
    """Map label -> entry, in ascending label order."""
    gathered = _in_order(F.collect_list(F.struct("label", entry.alias("v"))), "label")
    return F.map_from_entries(F.transform(gathered, lambda s: F.struct(s["label"].cast("string"), s["v"])))


def _vector(*names: str):
    return F.array(*[F.col(n).cast("double") for n in names])


def _box(suffix: str):
    return F.struct(*[F.col(f"{a}_{e}{suffix}").alias(f"{a}_{e}") for a in AXES for e in ("min", "max")])


def _by_label(df: DataFrame, name: str, entry) -> DataFrame:
    """(case_id, name): list of entries in ascending label order."""
    return df.groupBy("case_id").agg(
        F.transform(_in_order(F.collect_list(F.struct("label", entry.alias("e"))), "label"), lambda s: s["e"]).alias(name)
    )


def feature_document(
    features: DataFrame, parts: DataFrame, overlaps: DataFrame, relationships: DataFrame,
    offsets: DataFrame | None = None, bends: DataFrame | None = None,
    spacing: DataFrame | None = None, order: DataFrame | None = None,
    neighbours: DataFrame | None = None,
) -> DataFrame:
    """One nested document per case: per_label, relationships, overlaps, stage3.

    ``stage3`` and features_version 0.2 appear for cases with two labels or more.
    """
    geometry = F.struct(
        "voxel_count", "physical_volume_mm3", *[f"extent_{a}_mm" for a in AXES],
        _box("").alias("bbox_voxel"), _box("_mm").alias("bbox_physical"), *[f"touches_{f}" for f in FACES],
    )
    components = F.struct(*[c for c in parts.columns if c not in ("case_id", "label")])
    centroid = F.struct(
        _vector("cx", "cy", "cz").alias("centroid_voxel"), _vector("cx_mm", "cy_mm", "cz_mm").alias("centroid_mm")
    )
    entry = F.struct("label", "level_name", geometry.alias("geometry"), components.alias("components"), centroid.alias("centroid"))
    joined = features.join(parts, ["case_id", "label"])
    doc = joined.groupBy("case_id").agg(
        _per_label(entry).alias("per_label"),
        F.count(F.lit(1)).alias("_labels"),
    )
    pairs = overlaps.groupBy("case_id").agg(F.array_sort(F.collect_list(
        F.struct("label_a", "label_b", "name_a", "name_b", "overlap_voxels"))).alias("overlaps"))
    rel = relationships.select("case_id", F.struct(
        "present_levels", "missing_levels", "neighbour_spacings_mm", "is_continuous", "out_of_order_labels"
    ).alias("relationships"))
    doc = doc.join(rel, "case_id", "left").join(pairs, "case_id", "left")
    orientation = F.struct("label", "level_name", _vector("axis_x", "axis_y", "axis_z").alias("principal_axis"), "eigenvalue_ratio")
    stage = [_by_label(features, "per_label_orientations", orientation)]
    if offsets is not None:
        stage.append(_by_label(offsets, "per_label_offsets", F.struct(
            "label", "level_name", "closest_t", F.col("curve_offset_mm").alias("offset_mm"),
            F.col("curve_offset_voxel").alias("offset_voxel"), "dx_mm", "dy_mm", "dz_mm")))
    if bends is not None:
        stage.append(_by_label(bends, "tangents", F.struct("tangent_angle_deg", "inter_tangent_angle_deg", "total_curvature_deg")))
    if spacing is not None:
        stage.append(_by_label(spacing, "spacing_consistency", F.struct(
            "level_name", "next_level", F.col("gap_mm").alias("spacing_mm"), "deviation_mm", "is_outlier", "mean_spacing_mm", "cv_spacing")))
    if order is not None:
        stage.append(_by_label(order, "monotonic_consistency", F.struct("level_name", "u", "next_level", "non_monotonic")))
    if neighbours is not None:
        per = neighbours.groupBy("case_id", "label").agg(
            F.first("level_name").alias("level_name"), F.first("window_labels").alias("window_labels"),
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", F.struct("mean", "median", "std", "z_score").alias("s"))))).alias("stats"),
            F.first("deviation_score").alias("deviation_score"), F.first("is_outlier").alias("is_outlier"))
        stage.append(_by_label(per, "per_label_neighbourhood", F.struct("label", "level_name", "window_labels", "stats", "deviation_score", "is_outlier")))
    names = []
    for block in stage:
        names.append([c for c in block.columns if c != "case_id"][0])
        doc = doc.join(block, "case_id", "left")
    staged = F.col("_labels") >= 2
    return doc.select(
        "case_id",
        F.when(staged, "0.2").otherwise("0.1").alias("features_version"),
        "per_label", "relationships",
        F.coalesce("overlaps", F.array().cast("array<struct<label_a:int,label_b:int,name_a:string,name_b:string,overlap_voxels:bigint>>")).alias("overlaps"),
        F.when(staged, F.struct(*names)).alias("stage3"),
    )


def image_document(bright: DataFrame) -> DataFrame:
    """Nested image features per case: the 15 statistics of every label."""
    stats = F.struct(*[c for c in bright.columns if c not in ("case_id", "label")])
    entry = F.struct(
        "label", stats.alias("first_order"), F.create_map().cast("map<string,double>").alias("extended"))
    return bright.groupBy("case_id").agg(
        _per_label(entry).alias("per_label")
    ).select(
        "case_id", F.lit("0.1").alias("image_features_version"), F.lit(True).alias("available"),
        F.lit(False).alias("radiomics_available"), F.lit("builtin").alias("backend"), "per_label",
    )


def delta_document(deltas: DataFrame, labels: DataFrame, lower_pct: int = 1, upper_pct: int = 99) -> DataFrame:
    """Nested reference deltas per case."""
    cells = deltas.groupBy("case_id", "label").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(
        "feature", F.struct("value", "z", "robust_z", "pct_rank", "out_of_range").alias("d"))))).alias("features"))
    full = labels.join(cells, ["case_id", "label"], "left")
    entry = F.struct("label", "level_name", "stratum", "available", "features", "distribution_distance", "out_of_range_features")
    return full.groupBy("case_id").agg(
        _per_label(entry).alias("per_label")
    ).select("case_id", F.lit(lower_pct).alias("lower_pct"), F.lit(upper_pct).alias("upper_pct"), "per_label")


def run_manifest(
    segmenter_version: str | None = None, segmenter_sha: str | None = None, weights_hash: str | None = None,
    seed: int | None = None, dataset_id: str | None = None, postproc_toggles: dict[str, Any] | None = None,
):
    """Provenance column; NULL when nothing is given."""
    given = dict(
        segmenter_version=segmenter_version, segmenter_sha=segmenter_sha, weights_hash=weights_hash,
        seed=seed, dataset_id=dataset_id, postproc_toggles=postproc_toggles,
    )
    if all(v is None for v in given.values()):
        return F.lit(None).cast("struct<segmenter_version:string,seed:bigint>")
    fields = []
    for name, value in given.items():
        if name == "postproc_toggles":
            pairs = [F.lit(str(x)) for kv in (value or {}).items() for x in kv]
            column = F.create_map(*pairs).cast("map<string,string>") if value is not None else F.lit(None).cast("map<string,string>")
        else:
            column = F.lit(value).cast("bigint" if name == "seed" else "string")
        fields.append(column.alias(name))
    return F.struct(*fields)


def case_reports(
    verdicts: DataFrame, findings: DataFrame, documents: DataFrame | None = None,
    images: DataFrame | None = None, deltas: DataFrame | None = None, manifest=None,
    config_version: str = "0.1",
) -> DataFrame:
    """(case_id, report): the JSON report of every case."""
    listed = findings.groupBy("case_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct(
            "rule_id", "k1", "k2", "k3", severity_label(F.col("severity")).alias("severity"), "reason",
            F.array_sort("labels").alias("labels")))),
        lambda f: F.struct(f["rule_id"].alias("rule_id"), f["severity"].alias("severity"),
                           f["reason"].alias("reason"), f["labels"].alias("labels")),
    ).alias("findings"))
    df = verdicts.join(listed, "case_id", "left")
    blocks = {}
    for name, doc in (("features", documents), ("image_features", images), ("reference_delta", deltas)):
        if doc is not None:
            block = doc.select("case_id", F.struct(*[c for c in doc.columns if c != "case_id"]).alias(name))
            df = df.join(block, "case_id", "left")
            blocks[name] = name
    if manifest is not None:
        df = df.withColumn("run_manifest", manifest)
        blocks["run_manifest"] = "run_manifest"
    empty = F.array().cast("array<struct<rule_id:string,severity:string,reason:string,labels:array<int>>>")
    report = F.struct(
        F.lit("0.1").alias("schema_version"), "case_id", "verdict", F.lit(config_version).alias("config_version"),
        "reasons", "per_label", F.coalesce("findings", empty).alias("findings"), *blocks.values(),
    )
    return df.select("case_id", F.to_json(report).alias("report"))


def write_reports(reports: DataFrame, path: str) -> None:
    """JSON lines, one report per line."""
    reports.select(F.col("report").alias("value")).write.mode("overwrite").text(path)
