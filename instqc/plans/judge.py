"""Judging a cohort: label maps -> features -> findings -> verdicts."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame

from instqc.config import merge_config, rule_enabled
from instqc.functions.skew import of_cases
from instqc.operators import components, geometry, inventory, sequence
from instqc.operators.delta import feature_deltas, label_deltas
from instqc.operators.intensity import STATISTICS, label_intensity
from instqc.operators.overlap import label_overlaps
from instqc.operators.reference import ALL, feature_long
from instqc.operators.rules import Tables, run_rules
from instqc.operators.verdict import verdicts
from instqc.schemas import levels as level_table
from instqc.session import cut_lineage
from instqc.sources.tables import aligned


@dataclass
class Judged:
    tables: Tables
    findings: DataFrame
    verdicts: DataFrame
    errors: DataFrame | None
    empty: DataFrame


def build_tables(
    voxels: DataFrame,
    grids: DataFrame,
    config: dict[str, Any],
    scans: DataFrame | None = None,
    reference: DataFrame | None = None,
    levels: DataFrame | None = None,
    stratum: str = ALL,
    lower_pct: int = 1,
    upper_pct: int = 99,
    parts: DataFrame | None = None,
    bright: DataFrame | None = None,
) -> Tables:
    """The feature tables that the enabled rules need.

    Label features feed every rule, so they are computed once and written: at
    one row per label they are a tiny fraction of the voxel table. ``parts``
    and ``bright`` are the component and intensity tables of the same maps
    and scans, if they have been made before.
    """
    spark = voxels.sparkSession
    levels = level_table(spark) if levels is None else levels
    features = cut_lineage(geometry.label_features(voxels, grids, levels))
    over = None
    if parts is None and (rule_enabled(config, "fragmentation") or reference is not None):
        parts = components.summary(components.components(voxels), grids, config["min_fragment_voxels"])
        parts = cut_lineage(parts)
    if rule_enabled(config, "overlap"):
        over = label_overlaps(voxels, levels)
    if scans is not None and bright is None:
        bright = cut_lineage(label_intensity(voxels, scans))
    tables = Tables(features, levels, parts, over, bright, reference)
    if reference is not None:
        limits = dict(stratum=stratum, lower_pct=lower_pct, upper_pct=upper_pct)
        tables.deltas = cut_lineage(feature_deltas(
            feature_long(sequence.curve_offsets(features)), reference, "geometry", **limits
        ))
        tables.label_deltas = label_deltas(features, tables.deltas, reference, stratum)
        if bright is not None:
            long = feature_long(intensity_wide(features, bright))
            tables.intensity_deltas = cut_lineage(feature_deltas(long, reference, "intensity", **limits))
            tables.intensity_label_deltas = label_deltas(features, tables.intensity_deltas, reference, stratum)
    return tables


def intensity_wide(features: DataFrame, bright: DataFrame) -> DataFrame:
    """Intensity statistics under their feature names, with the label's level."""
    named = bright.select("case_id", "label", *[bright[s].alias(f"intensity_{s}") for s in STATISTICS])
    return features.select("case_id", "label", "level_name", "rank").join(named, ["case_id", "label"])


def wide_features(
    features: DataFrame, parts: DataFrame | None = None, bright: DataFrame | None = None
) -> DataFrame:
    """All tracked features of a label in one row, for building a reference."""
    wide = sequence.curve_offsets(features)
    keys = ["case_id", "label"]
    if parts is not None:
        wide = wide.join(parts.select(*keys, "largest_component_fraction", "component_count"), keys, "left")
    else:
        wide = wide.drop("eigenvalue_ratio")
    if bright is not None:
        wide = wide.join(bright.select(*keys, *[bright[s].alias(f"intensity_{s}") for s in STATISTICS]), keys, "left")
    return wide


def judge(
    voxels: DataFrame,
    grids: DataFrame,
    config: dict[str, Any] | None = None,
    scans: DataFrame | None = None,
    scan_grids: DataFrame | None = None,
    reference: DataFrame | None = None,
    levels: DataFrame | None = None,
    **limits: Any,
) -> Judged:
    """Verdicts for all cases of ``grids`` at once.

    A case whose scan does not lie on the label grid goes to ``errors`` and
    takes no further part; the other cases are judged all the same. ``limits``
    are passed on to ``build_tables``.
    """
    config = merge_config(config)
    errors = None
    if scan_grids is not None:
        grids, errors = aligned(grids, scan_grids)
        voxels = of_cases(voxels, cut_lineage(errors.select("case_id")), "left_anti")
    tables = build_tables(voxels, grids, config, scans, reference, levels, **limits)
    findings = cut_lineage(run_rules(tables, config))
    empty = inventory.check_empty(grids, tables.features, config)
    return Judged(tables, findings, verdicts(grids, findings, config, empty), errors, empty)
