"""From label maps and scans to a reference that cohorts are judged against."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame

from instqc.config import merge_config
from instqc.operators import components, geometry
from instqc.operators.intensity import label_intensity
from instqc.operators.reference import PERCENTILES, aggregate_reference, observations, record_counts, reference_meta, skipped_labels, with_stratum
from instqc.plans.judge import wide_features
from instqc.schemas import levels as level_table
from instqc.session import cut_lineage
from instqc.sources.artifacts import read_reference, write_reference

SIZE_PROXY = "mean_physical_volume_mm3"


def config_hash(config: dict[str, Any]) -> str:
    """The same for configurations that say the same, whatever the order of their keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


def cohort_features(
    voxels: DataFrame, grids: DataFrame, scans: DataFrame | None = None, config: dict[str, Any] | None = None,
    levels: DataFrame | None = None, with_intensity: bool = True, with_morphology: bool = True,
    parts: DataFrame | None = None, bright: DataFrame | None = None,
) -> DataFrame:
    """One row per case and label with every tracked feature.

    Cases without a scan have no intensities and keep their geometry;
    intensity and component features can be left out, which changes none of
    the others. ``parts`` and ``bright`` are the tables of these features, if
    they have been made before.
    """
    levels = level_table(voxels.sparkSession) if levels is None else levels
    config = merge_config(config)
    parts, bright = parts if with_morphology else None, bright if with_intensity else None
    if with_morphology and parts is None:
        parts = components.summary(components.components(voxels), grids, config["min_fragment_voxels"])
    if with_intensity and scans is not None and bright is None:
        bright = label_intensity(voxels, scans)
    return wide_features(geometry.label_features(voxels, grids, levels), parts, bright)


def build_reference(
    voxels: DataFrame, grids: DataFrame, path: str, *, source: str, build_date: str, scans: DataFrame | None = None,
    config: dict[str, Any] | None = None, levels: DataFrame | None = None, edges: Sequence[float] | None = None,
    names: Sequence[str] | None = None, percentiles: Sequence[int] = PERCENTILES, with_intensity: bool = True, with_morphology: bool = True,
    parts: DataFrame | None = None, bright: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Writes the reference of a cohort below ``path`` and gives its (stats, meta) as ``read_reference`` does.

    Voxels become features, features observations in size strata (``edges``;
    one stratum without), and these statistics per level, stratum and feature.
    Beside them stand the number of records of each level and stratum
    (``records``) and the unknown label values of each case (``skipped``). The
    provenance is the caller's: no clock is read, so equal inputs give equal
    references. ``judge`` takes the stats as its ``reference``.
    """
    config = merge_config(config)
    wide = cut_lineage(cohort_features(voxels, grids, scans, config, levels, with_intensity, with_morphology, parts, bright))
    obs = cut_lineage(with_stratum(observations(wide), edges, names))
    origin = {"source": source, "build_date": build_date, "config_hash": config_hash(config), "size_proxy_name": SIZE_PROXY if edges is not None else ""}
    write_reference(aggregate_reference(obs, percentiles), reference_meta(obs, percentiles, **origin), path)
    record_counts(obs).write.mode("overwrite").parquet(f"{path}/records")
    skipped_labels(wide).write.mode("overwrite").parquet(f"{path}/skipped")
    return read_reference(voxels.sparkSession, path)
