"""Parameters of the checks and rules, as plain nested dictionaries."""

from __future__ import annotations

import copy
from typing import Any

# Hand-set size bounds (mm3 and mm) per level group.
SIZE_BOUNDS = {
    "cervical": {
        "min_volume_mm3": 3000.0, "max_volume_mm3": 35000.0,
        "min_extent_x_mm": 10.0, "max_extent_x_mm": 80.0,
        "min_extent_y_mm": 10.0, "max_extent_y_mm": 80.0,
        "min_extent_z_mm": 5.0, "max_extent_z_mm": 60.0,
    },
    "thoracic": {
        "min_volume_mm3": 5000.0, "max_volume_mm3": 70000.0,
        "min_extent_x_mm": 15.0, "max_extent_x_mm": 100.0,
        "min_extent_y_mm": 15.0, "max_extent_y_mm": 100.0,
        "min_extent_z_mm": 8.0, "max_extent_z_mm": 80.0,
    },
    "lumbar": {
        "min_volume_mm3": 8000.0, "max_volume_mm3": 120000.0,
        "min_extent_x_mm": 20.0, "max_extent_x_mm": 120.0,
        "min_extent_y_mm": 20.0, "max_extent_y_mm": 120.0,
        "min_extent_z_mm": 15.0, "max_extent_z_mm": 100.0,
    },
}

# Default thresholds of the checks and rules.
DEFAULT_CONFIG: dict[str, Any] = {
    "schema_version": "0.1",
    "min_foreground_voxels": 0,
    "min_label_count": 0,
    "min_fragment_voxels": 0,
    "verdict": {"flag_escalation_count": 0},
    "rules": {
        "border": {"params": {
            "severity": "flagged-for-review",
            "report_expected_ends": False,
            "end_severity": "pass",
        }},
        "bounds": {"params": {
            "severity": "flagged-for-review",
            "source": "reference",
            "reference_lower_pct": 1,
            "reference_upper_pct": 99,
            **SIZE_BOUNDS,
        }},
        "coverage": {"params": {
            "severity": "flagged-for-review",
            "expected_levels": [],
            "expected_count": None,
            "border_aware": True,
        }},
        "fragmentation": {"params": {
            "severity": "flagged-for-review",
            "source": "reference",
            "reference_lower_pct": 1,
            "reference_upper_pct": 99,
            "fragmentation_index_threshold": 0.75,
            "island_min_voxels": 50,
        }},
        "intensity": {"params": {
            "severity": "flagged-for-review",
            "flag_low": True,
            "flag_high": True,
            "flag_degenerate": True,
            "min_plausible_hu": 100.0,
            "max_plausible_hu": 2000.0,
            "max_degenerate_std": 1.0,
        }},
        "intensity_reference_delta": {"params": {
            "severity": "flagged-for-review",
            "flag_out_of_range": True,
            "flag_robust_z": True,
            "flag_distribution_distance": True,
            "max_robust_z": 3.5,
            "max_distribution_distance": 3.0,
        }},
        "mislabel": {"params": {
            "severity": "flagged-for-review",
            "max_offset_mm": 15.0,
            "flag_offset_outliers": True,
            "flag_order_inconsistency": True,
        }},
        "overlap": {"params": {
            "severity": "flagged-for-review",
            "min_overlap_voxels": 1,
        }},
        "reference_delta": {"params": {
            "severity": "flagged-for-review",
            "flag_out_of_range": True,
            "flag_robust_z": True,
            "flag_distribution_distance": True,
            "max_robust_z": 3.5,
            "max_distribution_distance": 3.0,
        }},
        "sequence": {"params": {"severity": "flagged-for-review"}},
    },
}


def merge_config(overrides: dict[str, Any] | None = None, base: dict[str, Any] | None = None) -> dict[str, Any]:
    """``base`` (the defaults) with ``overrides`` laid over it, key by key."""
    out = copy.deepcopy(DEFAULT_CONFIG if base is None else base)
    for key, value in (overrides or {}).items():
        if isinstance(value, dict) and isinstance(out.get(key), dict):
            out[key] = merge_config(value, out[key])
        else:
            out[key] = copy.deepcopy(value)
    return out


def rule_enabled(config: dict[str, Any], rule_id: str) -> bool:
    return config["rules"].get(rule_id, {}).get("enabled", True)


def rule_params(config: dict[str, Any], rule_id: str) -> dict[str, Any]:
    return config["rules"].get(rule_id, {}).get("params", {})


def apply_assignment(config: dict[str, Any], assignment: dict[tuple[str, ...], Any]) -> dict[str, Any]:
    """Lay threshold values over a copy of ``config``.

    Keys are paths below ``rules``: (rule_id, param, ...).
    """
    out = copy.deepcopy(config)
    for (rule_id, *path), value in assignment.items():
        node = out["rules"].setdefault(rule_id, {}).setdefault("params", {})
        for key in path[:-1]:
            node = node.setdefault(key, {})
        node[path[-1]] = value
    return out
