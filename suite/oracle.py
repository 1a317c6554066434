"""The same results as plain SQL for DuckDB, built from named sub-queries.

Names ending in @ exist once per voxel source: o_feat is over v_voxels,
o_featC over v_cand and o_featM over v_multi.
"""

from __future__ import annotations

import math
import re
from itertools import product

from suite.views import VIEWS

SOURCES = {"": "v_voxels", "C": "v_cand", "M": "v_multi"}
INF = "CAST('Infinity' AS DOUBLE)"


def _values(rows, names: str) -> str:
    text = lambda v: "NULL" if v is None else (f"'{v}'" if isinstance(v, str) else str(v))
    body = ", ".join("(" + ", ".join(text(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) t({names})"


# Fixed values, written here and not taken from the library, so that a wrong
# constant there shows.
LEVEL_NAMES = (
    "C1", "C2", "C3", "C4", "C5", "C6", "C7", "T1", "T2", "T3", "T4", "T5", "T6", "T7", "T8", "T9", "T10", "T11", "T12",
    "L1", "L2", "L3", "L4", "L5", "L6", "S1", "Cocc", "T13", "S2", "S3", "S4", "S5", "S6",
)
ORDER = (
    "C1", "C2", "C3", "C4", "C5", "C6", "C7", "T1", "T2", "T3", "T4", "T5", "T6", "T7", "T8", "T9", "T10", "T11", "T12", "T13",
    "L1", "L2", "L3", "L4", "L5", "L6", "S1", "S2", "S3", "S4", "S5", "S6", "Cocc",
)
GROUPS = {"C": "cervical", "T": "thoracic", "L": "lumbar"}
FACES = ("superior", "inferior", "left", "right", "anterior", "posterior")
AXIS_FACES = {
    "R": ("left", "right"), "L": ("right", "left"), "A": ("posterior", "anterior"), "P": ("anterior", "posterior"),
    "S": ("inferior", "superior"), "I": ("superior", "inferior"),
}
# Group, then lower and upper bound of volume and of the three extents.
BOUNDS = {
    "cervical": ((3000.0, 35000.0), (10.0, 80.0), (10.0, 80.0), (5.0, 60.0)),
    "thoracic": ((5000.0, 70000.0), (15.0, 100.0), (15.0, 100.0), (8.0, 80.0)),
    "lumbar": ((8000.0, 120000.0), (20.0, 120.0), (20.0, 120.0), (15.0, 100.0)),
}
BOUNDED = (
    ("physical_volume_mm3", "volume (mm3)"), ("extent_x_mm", "extent_x (mm)"), ("extent_y_mm", "extent_y (mm)"), ("extent_z_mm", "extent_z (mm)"),
)
# Mode, its name, metric, direction, baseline and full swing.
MODES = (
    (1, "label not aligned with the vertebra it names", "unanchored_foreground_fraction", "increases", 0.0, 1.0),
    (2, "over-/under-segmentation (fused / fragmented)", "min_dominant_component_fraction", "decreases", 1.0, 1.0),
    (3, "disconnected components / rogue islands", "rogue_island_count", "increases", 0.0, None),
    (4, "semantic mislabelling (wrong identification)", "mislabelled_volume_fraction", "increases", 0.0, 1.0),
    (5, "not all vertebrae segmented (missing levels)", "missing_level_count", "increases", 0.0, None),
    (6, "partial vertebra at the image border", "fov_clipped_label_count", "increases", 0.0, None),
    (7, "non-continuous label sequence", "out_of_order_label_count", "increases", 0.0, None),
    (8, "overlapping segments", "overlapping_voxel_count", "increases", 0.0, None),
)
TRIAL_AXES = ((2.5, 3.0, 3.5, 4.0, 4.5), (2.0, 2.5, 3.0, 3.5, 4.0), (90000.0, 105000.0, 120000.0, 135000.0, 150000.0))


def _group(name: str) -> str | None:
    return GROUPS.get(name[0]) if name[1:].isdigit() else None


def _kernel() -> list[tuple[int, float]]:
    """Gaussian of deviation 1, cut off at 4."""
    weights = [math.exp(-k * k / 2) for k in range(-4, 5)]
    return [(k - 4, w / sum(weights)) for k, w in enumerate(weights)]


_LEVEL_ROWS = [(i + 1, n, ORDER.index(n), _group(n)) for i, n in enumerate(LEVEL_NAMES)]
_BOUND_ROWS = [(g, i, *BOUNDED[i], lo, hi) for g, rows in BOUNDS.items() for i, (lo, hi) in enumerate(rows)]
_AXES = ("x", "y", "z")


def _touch(face: str) -> str:
    parts = [f"({a}_low = '{face}' AND {a}_min = 0) OR ({a}_high = '{face}' AND {a}_max = n{a} - 1)" for a in _AXES]
    return "(" + " OR ".join(parts) + f") AS touches_{face}"


def _grid_rows():
    return [(g, *values) for g, values in enumerate(product(*TRIAL_AXES))]


CTES: dict[str, str] = {
    "o_levels": _values(_LEVEL_ROWS, "label, level_name, rank, grp"),
    "o_axis": _values([(c, lo, hi) for c, (lo, hi) in AXIS_FACES.items()], "code, low, high"),
    "o_bound": _values(_BOUND_ROWS, "grp, k2, feature, name, hand_lo, hand_hi"),
    "o_mode": _values(MODES, "mode, mode_name, metric, direction, baseline, scale"),
    "o_kernel": _values(_kernel(), "k, w"),
    "o_faces": """
        SELECT g.*, ax.low AS x_low, ax.high AS x_high, ay.low AS y_low, ay.high AS y_high, az.low AS z_low, az.high AS z_high,
               CASE WHEN ax.low IN ('superior','inferior') THEN 'x' WHEN ay.low IN ('superior','inferior') THEN 'y' ELSE 'z' END AS stacking_axis
        FROM v_grids g JOIN o_axis ax ON ax.code = substr(axcodes, 1, 1)
        JOIN o_axis ay ON ay.code = substr(axcodes, 2, 1) JOIN o_axis az ON az.code = substr(axcodes, 3, 1)""",
    "o_sums@": """
        SELECT case_id, label, count(*) AS voxel_count, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max,
               min(z) AS z_min, max(z) AS z_max, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz,
               covar_samp(x, x) AS cxx, covar_samp(y, y) AS cyy, covar_samp(z, z) AS czz,
               covar_samp(x, y) AS cxy, covar_samp(x, z) AS cxz, covar_samp(y, z) AS cyz
        FROM SRC GROUP BY case_id, label""",
    "o_feat@": f"""
        SELECT s.*, f.nx, f.ny, f.nz, f.sx, f.sy, f.sz, f.stacking_axis, coalesce(l.level_name, 'unknown') AS level_name, l.rank, l.grp,
               voxel_count * sx * sy * sz AS physical_volume_mm3,
               (x_max - x_min + 1) * sx AS extent_x_mm, (y_max - y_min + 1) * sy AS extent_y_mm, (z_max - z_min + 1) * sz AS extent_z_mm,
               cx * sx AS cx_mm, cy * sy AS cy_mm, cz * sz AS cz_mm,
               CASE stacking_axis WHEN 'x' THEN cx WHEN 'y' THEN cy ELSE cz END AS stack_position,
               {', '.join(_touch(f) for f in FACES)}
        FROM o_sums@ s JOIN o_faces f USING (case_id) LEFT JOIN o_levels l USING (label)""",
    "o_cc@": """
        SELECT * FROM o_ccrec@""",
    "o_node@": """SELECT row_number() OVER (ORDER BY case_id, label, x, y, z) AS id, case_id, label, x, y, z FROM SRC""",
    "o_edge@": """
        WITH e AS (
          SELECT a.id AS a, b.id AS b FROM o_node@ a JOIN o_node@ b ON a.case_id = b.case_id AND a.label = b.label AND a.x + 1 = b.x AND a.y = b.y AND a.z = b.z
          UNION ALL
          SELECT a.id, b.id FROM o_node@ a JOIN o_node@ b ON a.case_id = b.case_id AND a.label = b.label AND a.x = b.x AND a.y + 1 = b.y AND a.z = b.z
          UNION ALL
          SELECT a.id, b.id FROM o_node@ a JOIN o_node@ b ON a.case_id = b.case_id AND a.label = b.label AND a.x = b.x AND a.y = b.y AND a.z + 1 = b.z)
        SELECT a, b FROM e UNION ALL SELECT b, a FROM e""",
    "o_ccrec@(id, comp) USING KEY (id)": """
        SELECT id, id FROM o_node@
        UNION
        (SELECT e.b, min(c.comp) FROM o_ccrec@ c JOIN o_edge@ e ON c.id = e.a
         JOIN recurring.o_ccrec@ r ON r.id = e.b WHERE c.comp < r.comp GROUP BY e.b)""",
    "o_comp@": """
        SELECT n.case_id, n.label, c.comp, count(*) AS size FROM o_ccrec@ c JOIN o_node@ n ON n.id = c.id
        GROUP BY n.case_id, n.label, c.comp""",
    "o_frag@": """
        SELECT case_id, label, count(*) AS component_count, max(size) AS largest, CAST(sum(size) AS BIGINT) AS total,
               CAST(max(size) AS DOUBLE) / CAST(sum(size) AS DOUBLE) AS fragmentation_index,
               list(size ORDER BY size DESC) AS component_sizes, list(size ORDER BY size DESC)[2:] AS stray_sizes,
               list_sort([{'size': u, 'n': len([v FOR v IN list(size) IF v = u])} FOR u IN list_distinct(list(size))], 'DESC') AS counts
        FROM o_comp@ GROUP BY case_id, label""",
    "o_span@": """
        SELECT case_id, min(rank) AS superior_rank, max(rank) AS inferior_rank, arg_min(level_name, rank) AS superior_end_level,
               arg_max(level_name, rank) AS inferior_end_level, arg_min(touches_superior, rank) AS superior_truncated,
               arg_max(touches_inferior, rank) AS inferior_truncated, count(*) AS present_count
        FROM o_feat@ WHERE rank IS NOT NULL GROUP BY case_id""",
    "o_missing@": """
        SELECT s.case_id, l.rank, l.level_name FROM o_span@ s JOIN o_levels l ON l.rank BETWEEN s.superior_rank AND s.inferior_rank
        WHERE NOT EXISTS (SELECT 1 FROM o_feat@ f WHERE f.case_id = s.case_id AND f.rank = l.rank)""",
    "o_late@": """
        SELECT * FROM (
          SELECT case_id, label, level_name, rank, max(rank) OVER (PARTITION BY case_id ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest_before
          FROM o_feat@ WHERE rank IS NOT NULL) q WHERE rank < highest_before""",
    "o_gap@": """
        SELECT *, lead(label) OVER w AS next_label, lead(level_name) OVER w AS next_level,
               sqrt(pow((lead(cx_mm) OVER w) - cx_mm, 2) + pow((lead(cy_mm) OVER w) - cy_mm, 2) + pow((lead(cz_mm) OVER w) - cz_mm, 2)) AS gap_mm
        FROM o_feat@ WINDOW w AS (PARTITION BY case_id ORDER BY label)""",
    "o_chord@": """
        SELECT *, CASE WHEN dx * dx + dy * dy + dz * dz = 0 THEN 0 ELSE
                 greatest(0, least(1, ((cx_mm - px) * dx + (cy_mm - py) * dy + (cz_mm - pz) * dz) / (dx * dx + dy * dy + dz * dz))) END AS closest_t
        FROM (SELECT *, lag(cx_mm) OVER w AS px, lag(cy_mm) OVER w AS py, lag(cz_mm) OVER w AS pz,
                (lead(cx_mm) OVER w) - (lag(cx_mm) OVER w) AS dx, (lead(cy_mm) OVER w) - (lag(cy_mm) OVER w) AS dy,
                (lead(cz_mm) OVER w) - (lag(cz_mm) OVER w) AS dz
              FROM o_feat@ WINDOW w AS (PARTITION BY case_id ORDER BY label)) q""",
    "o_off@": """
        SELECT * EXCLUDE (closest_t), CASE WHEN dx IS NULL THEN NULL ELSE closest_t END AS closest_t,
               cx_mm - px - closest_t * dx AS dx_mm, cy_mm - py - closest_t * dy AS dy_mm, cz_mm - pz - closest_t * dz AS dz_mm,
               sqrt(pow(cx_mm - px - closest_t * dx, 2) + pow(cy_mm - py - closest_t * dy, 2) + pow(cz_mm - pz - closest_t * dz, 2)) AS curve_offset_mm,
               sqrt(pow((cx_mm - px - closest_t * dx) / sx, 2) + pow((cy_mm - py - closest_t * dy) / sy, 2) + pow((cz_mm - pz - closest_t * dz) / sz, 2)) AS curve_offset_voxel
        FROM o_chord@""",
    "o_prog@": """
        SELECT *, lead(label) OVER w AS next_label, lead(level_name) OVER w AS next_level, u >= (lead(u) OVER w) AS non_monotonic FROM (
          SELECT *, CASE WHEN (covar_samp(ord, stack_position) OVER (PARTITION BY case_id)) < 0 THEN 1 - u0 ELSE u0 END AS u FROM (
            SELECT *, coalesce(walk / (sum(step) OVER (PARTITION BY case_id)), (slot - 1.0) / (n - 1)) AS u0 FROM (
              SELECT *, coalesce(sum(step) OVER (PARTITION BY case_id ORDER BY stack_position, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS walk FROM (
                SELECT *, sqrt(pow((lead(cx_mm) OVER s) - cx_mm, 2) + pow((lead(cy_mm) OVER s) - cy_mm, 2) + pow((lead(cz_mm) OVER s) - cz_mm, 2)) AS step,
                       row_number() OVER s AS slot, row_number() OVER (PARTITION BY case_id ORDER BY label) AS ord, count(*) OVER (PARTITION BY case_id) AS n
                FROM o_feat@ WINDOW s AS (PARTITION BY case_id ORDER BY stack_position, label)) q1) q2 WHERE n > 1) q3) q4
        WINDOW w AS (PARTITION BY case_id ORDER BY label)""",
    "o_overlap@": """
        SELECT a.case_id, a.label AS label_a, b.label AS label_b, coalesce(la.level_name, 'unknown') AS name_a,
               coalesce(lb.level_name, 'unknown') AS name_b, count(*) AS overlap_voxels
        FROM SRC a JOIN SRC b ON a.case_id = b.case_id AND a.x = b.x AND a.y = b.y AND a.z = b.z AND a.label < b.label
        LEFT JOIN o_levels la ON la.label = a.label LEFT JOIN o_levels lb ON lb.label = b.label
        GROUP BY a.case_id, a.label, b.label, la.level_name, lb.level_name""",
    "o_face@": f"""
        SELECT f.case_id, f.label, f.level_name, array_to_string([x FOR x IN [{', '.join(f"CASE WHEN touches_{f} THEN '{f}' END" for f in FACES)}] IF x IS NOT NULL], ', ') AS faces,
               (NOT (touches_left OR touches_right OR touches_anterior OR touches_posterior)
                AND (NOT touches_superior OR coalesce(f.level_name = s.superior_end_level, false))
                AND (NOT touches_inferior OR coalesce(f.level_name = s.inferior_end_level, false))) AS expected
        FROM o_feat@ f LEFT JOIN o_span@ s USING (case_id) WHERE {' OR '.join('touches_' + f for f in FACES)}""",
    "f_border@": """
        SELECT case_id, 'border' AS rule_id, 1 AS severity, [label] AS labels,
               'Partial vertebra clipped by FOV: label ' || label || ' (' || level_name || ') touches image face(s): ' || faces || '.' AS reason
        FROM o_face@ WHERE NOT expected""",
    "o_sized@": """
        SELECT f.case_id, f.label, f.level_name, f.grp, b.k2, b.feature, b.name, b.hand_lo, b.hand_hi,
               CASE b.k2 WHEN 0 THEN physical_volume_mm3 WHEN 1 THEN extent_x_mm WHEN 2 THEN extent_y_mm ELSE extent_z_mm END AS value
        FROM o_feat@ f JOIN o_bound b ON b.grp = f.grp""",
    "f_bounds@": """
        SELECT case_id, 'bounds' AS rule_id, 1 AS severity, [label] AS labels,
               'Label ' || label || ' (' || level_name || '): ' || name || ' = ' || printf('%.6g', value)
               || CASE WHEN value < hand_lo THEN ' is below minimum ' || printf('%.6g', CAST(hand_lo AS DOUBLE)) ELSE ' exceeds maximum ' || printf('%.6g', CAST(hand_hi AS DOUBLE)) END
               || ' for ' || grp || ' group' AS reason
        FROM o_sized@ WHERE value < hand_lo OR value > hand_hi""",
    "f_coverage@": """
        SELECT case_id, 'coverage' AS rule_id, 1 AS severity, CAST([] AS INT[]) AS labels,
               'Missing interior level(s): ' || string_agg(level_name, ', ' ORDER BY rank) || ' absent within the observed present-level span.' AS reason
        FROM o_missing@ GROUP BY case_id""",
    "f_sequence@": """
        SELECT case_id, 'sequence' AS rule_id, 1 AS severity, list(label ORDER BY label) AS labels,
               'Non-continuous label sequence: ' || string_agg(level_name, ', ' ORDER BY label) || ' out of anatomical order.' AS reason
        FROM o_late@ GROUP BY case_id""",
    "f_mislabel@": """
        SELECT case_id, 'mislabel' AS rule_id, 1 AS severity, [label] AS labels,
               'Vertebra misaligned from spinal curve: label ' || label || ' (' || level_name || ') centroid lies ' || printf('%.1f', curve_offset_mm) || ' mm off the fitted spinal curve (threshold 15.0 mm).' AS reason
        FROM o_off@ WHERE curve_offset_mm >= 15
        UNION ALL
        SELECT case_id, 'mislabel', 1, [label, next_label],
               'Vertebra ordering inconsistent with label: labels ' || label || ' (' || level_name || ') and ' || next_label || ' (' || next_level || ') are out of expected order along the spine (spline parameter does not advance).'
        FROM o_prog@ WHERE non_monotonic""",
    "f_overlap@": """
        SELECT case_id, 'overlap' AS rule_id, 1 AS severity, [label_a, label_b] AS labels,
               'Overlapping segments: labels ' || label_a || ' (' || name_a || ') and ' || label_b || ' (' || name_b || ') share ' || overlap_voxels || ' voxel(s).' AS reason
        FROM o_overlap@""",
    "f_fragmentation@": """
        SELECT case_id, 'fragmentation' AS rule_id, 1 AS severity, [label] AS labels,
               'Fragmentation: Label ' || label || ': fragmentation_index=' || printf('%.6g', fragmentation_index) || ' is strictly below threshold 0.75. component_count='
               || component_count || ', component_sizes=[' || array_to_string([CASE WHEN s.n = 1 THEN CAST(s.size AS VARCHAR) WHEN s.n = 2 THEN s.size || ', ' || s.size ELSE s.size || ' (' || s.n || ' times)' END FOR s IN counts], ', ') || ']' AS reason
        FROM o_frag@ WHERE fragmentation_index < 0.75
        UNION ALL
        SELECT case_id, 'fragmentation', 1, [label],
               'Rogue island(s): Label ' || label || ': ' || len(tiny) || ' non-dominant component(s) strictly below island_min_voxels=50. Tiny island sizes: [' || array_to_string([CASE WHEN s.n = 1 THEN CAST(s.size AS VARCHAR) WHEN s.n = 2 THEN s.size || ', ' || s.size ELSE s.size || ' (' || s.n || ' times)' END FOR s IN few], ', ')
               || ']. component_count=' || component_count || ', component_sizes=[' || array_to_string([CASE WHEN s.n = 1 THEN CAST(s.size AS VARCHAR) WHEN s.n = 2 THEN s.size || ', ' || s.size ELSE s.size || ' (' || s.n || ' times)' END FOR s IN counts], ', ') || '], fragmentation_index=' || fragmentation_index
        FROM (SELECT *, list_sort([{'size': u, 'n': len([v FOR v IN tiny IF v = u])} FOR u IN list_distinct(tiny)], 'DESC') AS few
              FROM (SELECT *, [s FOR s IN stray_sizes IF s < 50] AS tiny FROM o_frag@) p) q WHERE len(tiny) > 0""",
    "o_findings@": """
        SELECT * FROM f_border@ UNION ALL SELECT * FROM f_bounds@ UNION ALL SELECT * FROM f_coverage@ UNION ALL SELECT * FROM f_fragmentation@
        UNION ALL SELECT * FROM f_mislabel@ UNION ALL SELECT * FROM f_overlap@ UNION ALL SELECT * FROM f_sequence@""",
    "o_verdict@": """
        SELECT g.case_id, coalesce(max(f.severity), 0) AS overall, count(f.rule_id) FILTER (f.severity = 1) AS n_flag, count(f.rule_id) AS n_findings
        FROM v_grids g LEFT JOIN o_findings@ f USING (case_id) GROUP BY g.case_id""",
    "o_sample": """
        SELECT v.case_id, v.label, CASE WHEN isnan(s.hu) OR isinf(s.hu) THEN NULL ELSE s.hu END AS hu
        FROM v_voxels v JOIN v_scan s USING (case_id, x, y, z)""",
    "o_first": """
        SELECT case_id, label, count(hu) AS voxel_count, count(*) - count(hu) AS n_nonfinite_excluded, avg(hu) AS mean, median(hu) AS median,
               stddev_pop(hu) AS std, min(hu) AS lo, max(hu) AS hi, quantile_cont(hu, 0.05) AS p05, quantile_cont(hu, 0.25) AS p25,
               quantile_cont(hu, 0.5) AS p50, quantile_cont(hu, 0.75) AS p75, quantile_cont(hu, 0.95) AS p95
        FROM o_sample GROUP BY case_id, label""",
    "o_entropy": """
        SELECT case_id, label, -sum(p * log2(p)) AS entropy FROM (
          SELECT case_id, label, n / (sum(n) OVER (PARTITION BY case_id, label)) AS p FROM (
            SELECT s.case_id, s.label, CASE WHEN f.hi = f.lo THEN 0 ELSE least(31, floor((hu - lo) / (hi - lo) * 32)) END AS bin, CAST(count(*) AS DOUBLE) AS n
            FROM o_sample s JOIN o_first f USING (case_id, label) WHERE hu IS NOT NULL GROUP BY ALL) q) r GROUP BY case_id, label""",
    "o_intensity": """SELECT f.*, e.entropy FROM o_first f LEFT JOIN o_entropy e USING (case_id, label)""",
    "f_intensity": """
        SELECT case_id, 'intensity' AS rule_id, 1 AS severity, [label] AS labels, 'low' AS kind FROM o_intensity WHERE median < 100
        UNION ALL SELECT case_id, 'intensity', 1, [label], 'high' FROM o_intensity WHERE median > 2000
        UNION ALL SELECT case_id, 'intensity', 1, [label], 'flat' FROM o_intensity WHERE std <= 1""",
    "o_agree": """
        SELECT case_id, g.label AS gt_label, c.label AS cand_label, count(*) AS n
        FROM v_voxels g FULL JOIN v_cand c USING (case_id, x, y, z) GROUP BY case_id, g.label, c.label""",
    "o_dice": """
        SELECT *, CASE WHEN a + b > 0 THEN 2.0 * i / (a + b) ELSE 0 END AS dice, CASE WHEN a + b - i > 0 THEN i / CAST(a + b - i AS DOUBLE) ELSE 0 END AS jaccard,
               a > 0 AND b > 0 AS matched FROM (
          SELECT k.case_id, k.label, coalesce(l.level_name, 'unknown') AS level_name, coalesce(l.rank, 33) AS position,
                 coalesce(c.voxel_count, 0) AS a, coalesce(g.voxel_count, 0) AS b, coalesce(i.n, 0) AS i, coalesce(g.voxel_count, 0) * gr.sx * gr.sy * gr.sz AS volume
          FROM (SELECT case_id, label FROM o_sums UNION SELECT case_id, label FROM o_sumsC) k
          LEFT JOIN o_sumsC c USING (case_id, label) LEFT JOIN o_sums g USING (case_id, label)
          LEFT JOIN (SELECT case_id, gt_label AS label, n FROM o_agree WHERE gt_label = cand_label) i USING (case_id, label)
          JOIN v_grids gr USING (case_id) LEFT JOIN o_levels l USING (label)) q""",
    "o_casedice": """
        SELECT case_id, avg(dice) FILTER (matched) AS mean_dice, avg(jaccard) FILTER (matched) AS mean_jaccard,
               sum(dice * volume) FILTER (matched) / nullif(sum(volume) FILTER (matched), 0) AS volume_weighted_dice,
               count(*) FILTER (matched) AS n_matched, count(*) FILTER (NOT matched) AS n_unmatched FROM o_dice GROUP BY case_id""",
    "o_match": """
        SELECT case_id, label, coalesce(g.level_name, c.level_name) AS level_name, coalesce(g.rank, c.rank, 33) AS position,
               g.level_name IS NOT NULL AND c.level_name IS NOT NULL AS matched,
               c.physical_volume_mm3 - g.physical_volume_mm3 AS abs_physical_volume_mm3, c.extent_x_mm - g.extent_x_mm AS abs_extent_x_mm,
               c.extent_y_mm - g.extent_y_mm AS abs_extent_y_mm, c.extent_z_mm - g.extent_z_mm AS abs_extent_z_mm, c.curve_offset_mm - g.curve_offset_mm AS abs_curve_offset_mm,
               (c.physical_volume_mm3 - g.physical_volume_mm3) / nullif(g.physical_volume_mm3, 0) AS rel_physical_volume_mm3,
               (c.extent_x_mm - g.extent_x_mm) / nullif(g.extent_x_mm, 0) AS rel_extent_x_mm, (c.extent_y_mm - g.extent_y_mm) / nullif(g.extent_y_mm, 0) AS rel_extent_y_mm,
               (c.extent_z_mm - g.extent_z_mm) / nullif(g.extent_z_mm, 0) AS rel_extent_z_mm, (c.curve_offset_mm - g.curve_offset_mm) / nullif(g.curve_offset_mm, 0) AS rel_curve_offset_mm,
               sqrt(pow(c.cx_mm - g.cx_mm, 2) + pow(c.cy_mm - g.cy_mm, 2) + pow(c.cz_mm - g.cz_mm, 2)) AS centroid_distance_mm
        FROM o_offC c FULL JOIN o_off g USING (case_id, label)""",
    "o_score": """
        SELECT *, CASE WHEN matched THEN list_avg([abs(v) FOR v IN [rel_physical_volume_mm3, rel_extent_x_mm, rel_extent_y_mm, rel_extent_z_mm, rel_curve_offset_mm] IF v IS NOT NULL]) END AS divergence_score FROM o_match""",
    "o_vmodes": """
        SELECT case_id, CAST(coalesce(sum(n) FILTER (gt_label IS NULL), 0) AS DOUBLE) / nullif(sum(n) FILTER (gt_label IS NOT NULL), 0) AS m1,
               coalesce(CAST(coalesce(sum(n) FILTER (gt_label IS NOT NULL AND cand_label IS NOT NULL AND gt_label <> cand_label
                 AND (case_id, cand_label) IN (SELECT (case_id, label) FROM o_sums)), 0) AS DOUBLE) / nullif(sum(n) FILTER (gt_label IS NOT NULL), 0), 0) AS m4
        FROM o_agree GROUP BY case_id""",
    "o_lost": """
        SELECT case_id, count(*) AS lost FROM (
          SELECT case_id, gt_label, coalesce(sum(n) FILTER (cand_label IS NULL), 0) / CAST(sum(n) AS DOUBLE) AS empty
          FROM o_agree WHERE gt_label IS NOT NULL AND NOT EXISTS (SELECT 1 FROM o_sumsC s WHERE s.case_id = o_agree.case_id AND s.label = o_agree.gt_label)
          GROUP BY case_id, gt_label) q WHERE empty > 0.5 GROUP BY case_id""",
    "o_rmodes@": """
        SELECT g.case_id, fr.m2, fr.m3, CASE WHEN ft.case_id IS NOT NULL THEN coalesce(fc.m6, 0) END AS m6,
               CASE WHEN ft.case_id IS NOT NULL THEN coalesce(lt.m7, 0) END AS m7, coalesce(ov.m8, 0) AS m8
        FROM v_grids g
        LEFT JOIN (SELECT case_id, min(fragmentation_index) AS m2, max(len([s FOR s IN stray_sizes IF s < 0.1 * largest])) AS m3 FROM o_frag@ GROUP BY case_id) fr USING (case_id)
        LEFT JOIN (SELECT DISTINCT case_id FROM o_feat@) ft USING (case_id)
        LEFT JOIN (SELECT case_id, count(*) FILTER (NOT expected) AS m6 FROM o_face@ GROUP BY case_id) fc USING (case_id)
        LEFT JOIN (SELECT case_id, count(*) AS m7 FROM o_late@ GROUP BY case_id) lt USING (case_id)
        LEFT JOIN (SELECT case_id, sum(overlap_voxels) AS m8 FROM o_overlap@ GROUP BY case_id) ov USING (case_id)""",
    "o_modes": """
        SELECT *, CASE WHEN value IS NOT NULL THEN NULL WHEN mode = 1 AND listed THEN 'gt has no foreground voxels'
                       WHEN mode IN (1, 4, 5) THEN 'mode ' || mode || ' needs both candidate and gt; at least one is missing'
                       WHEN mode = 7 THEN 'record has no relationships block' WHEN mode = 8 THEN 'record has no overlaps key'
                       ELSE 'record has no usable per_label entries' END AS detail
        FROM (
          SELECT r.case_id, m.mode, m.mode_name, m.metric, m.direction, CAST(m.baseline AS DOUBLE) AS baseline, g.cn % 7 <> 3 AS listed,
                 CAST(CASE m.mode WHEN 1 THEN CASE WHEN g.cn % 7 <> 3 THEN v.m1 END WHEN 2 THEN r.m2 WHEN 3 THEN r.m3 WHEN 4 THEN CASE WHEN g.cn % 7 <> 3 THEN coalesce(v.m4, 0) END
                   WHEN 5 THEN CASE WHEN g.cn % 7 <> 3 THEN coalesce(l.lost, 0) END WHEN 6 THEN r.m6 WHEN 7 THEN r.m7 ELSE r.m8 END AS DOUBLE) AS value
          FROM o_rmodesC r CROSS JOIN o_mode m JOIN v_grids g USING (case_id) LEFT JOIN o_vmodes v USING (case_id) LEFT JOIN o_lost l USING (case_id)) q""",
    "o_expected": """
        SELECT case_id, expected_verdict, expected_verdict <> 'pass' AS expected_failure, failure_mode,
               CASE WHEN failure_mode IS NOT NULL THEN 'mode ' || failure_mode END AS failure_mode_name,
               CASE WHEN rule_text IS NULL THEN CAST([] AS VARCHAR[]) ELSE string_split(rule_text, ',') END AS rules,
               CASE WHEN label_text IS NULL THEN CAST([] AS INT[]) ELSE CAST(string_split(label_text, ',') AS INT[]) END AS wanted FROM v_expected""",
    "o_hit@": """
        SELECT f.case_id, bool_or(list_contains(e.rules, f.rule_id)) AS designated_rule_fired,
               bool_or(list_contains(e.rules, f.rule_id) AND (len(e.wanted) = 0 OR list_has_any(f.labels, e.wanted))) AS caught_by_designated_rule,
               array_to_string(list_sort(list_distinct(list(f.rule_id))), ',') AS fired
        FROM o_findings@ f JOIN o_expected e USING (case_id) GROUP BY f.case_id""",
    "o_outcome@": """
        SELECT e.case_id, e.expected_verdict, e.expected_failure, e.failure_mode, e.failure_mode_name, v.overall >= 1 AS actual_flagged,
               CASE WHEN e.expected_failure THEN v.overall >= 1 END AS caught,
               CASE WHEN e.expected_failure AND v.overall >= 1 THEN 'TP' WHEN v.overall >= 1 THEN 'FP' WHEN NOT e.expected_failure THEN 'TN' ELSE 'FN' END AS outcome,
               coalesce(h.fired, '') AS fired_rule_ids, coalesce(h.designated_rule_fired, false) AS designated_rule_fired,
               coalesce(h.caught_by_designated_rule, false) AS caught_by_designated_rule
        FROM o_expected e JOIN o_verdict@ v USING (case_id) LEFT JOIN o_hit@ h USING (case_id)""",
    "o_known": """SELECT w.*, l.level_name, l.rank FROM v_wide w JOIN o_levels l USING (label)""",
    "o_long": " UNION ALL ".join(
        f"SELECT case_id, label, level_name, rank, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM o_known WHERE {f} IS NOT NULL"
        for f in ("physical_volume_mm3", "extent_x_mm", "extent_y_mm", "extent_z_mm", "curve_offset_mm", "intensity_mean",
                  "intensity_median", "largest_component_fraction", "component_count")
    ),
    "o_proxy": """SELECT case_id, avg(physical_volume_mm3) AS size_proxy FROM o_known GROUP BY case_id""",
    "o_strat": """
        SELECT o.*, p.size_proxy, CASE WHEN p.size_proxy >= 3400 THEN 's2' WHEN p.size_proxy >= 3000 THEN 's1' ELSE 's0' END AS stratum
        FROM o_long o JOIN o_proxy p USING (case_id)""",
    "o_ref": """
        SELECT level_name, feature, count(*) AS n, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS std, min(value) AS lo, max(value) AS hi,
               quantile_cont(value, 0.01) AS p1, quantile_cont(value, 0.05) AS p5, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50,
               quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99
        FROM o_long GROUP BY level_name, feature""",
    "o_delta": """
        SELECT d.*, CASE WHEN std <> 0 THEN (value - mean) / std END AS z, CASE WHEN p75 <> p25 THEN (value - p50) / ((p75 - p25) / 1.349) END AS robust_z,
               value < p1 OR value > p99 AS out_of_range,
               CASE WHEN value <= lo THEN 0 WHEN value >= hi THEN 100
                    WHEN value <= p1 THEN coalesce(1 * (value - lo) / nullif(p1 - lo, 0), 0)
                    WHEN value <= p5 THEN 1 + coalesce(4 * (value - p1) / nullif(p5 - p1, 0), 0)
                    WHEN value <= p25 THEN 5 + coalesce(20 * (value - p5) / nullif(p25 - p5, 0), 0)
                    WHEN value <= p50 THEN 25 + coalesce(25 * (value - p25) / nullif(p50 - p25, 0), 0)
                    WHEN value <= p75 THEN 50 + coalesce(25 * (value - p50) / nullif(p75 - p50, 0), 0)
                    WHEN value <= p95 THEN 75 + coalesce(20 * (value - p75) / nullif(p95 - p75, 0), 0)
                    WHEN value <= p99 THEN 95 + coalesce(4 * (value - p95) / nullif(p99 - p95, 0), 0)
                    ELSE 99 + coalesce(1 * (value - p99) / nullif(hi - p99, 0), 0) END AS pct_rank
        FROM o_long d JOIN o_ref r USING (level_name, feature)""",
    "o_geo": """SELECT * FROM o_delta WHERE feature IN ('physical_volume_mm3','extent_x_mm','extent_y_mm','extent_z_mm','curve_offset_mm')""",
    "o_int": """SELECT * FROM o_delta WHERE feature LIKE 'intensity_%'""",
    "o_morph": """SELECT * FROM o_delta WHERE feature IN ('largest_component_fraction','component_count','eigenvalue_ratio')""",
    "o_roll": """
        SELECT case_id, label, sqrt(avg(robust_z * robust_z)) AS distance,
               array_to_string(list_sort(list(feature) FILTER (out_of_range)), ',') AS oor FROM o_geo GROUP BY case_id, label""",
    "o_rollint": """SELECT case_id, label, sqrt(avg(robust_z * robust_z)) AS distance FROM o_int GROUP BY case_id, label""",
    "o_grid": _values(_grid_rows(), "grid_id, t1, t2, t3"),
    "o_calcase": """
        SELECT concat('s', n) AS case_id, n % 3 = 0 AS expected_failure, CASE WHEN n % 3 = 0 THEN n % 2 + 1 END AS failure_mode
        FROM (SELECT DISTINCT l_suppkey AS n FROM lineitem) q""",
    "o_calmax": """
        SELECT c.*, coalesce(z.rz, -1) AS rz, coalesce(d.dist, -1) AS dist, coalesce(w.vol, -1) AS vol FROM o_calcase c
        LEFT JOIN (SELECT case_id, max(abs(robust_z)) AS rz FROM o_geo GROUP BY case_id) z USING (case_id)
        LEFT JOIN (SELECT case_id, max(distance) AS dist FROM o_roll GROUP BY case_id) d USING (case_id)
        LEFT JOIN (SELECT case_id, max(physical_volume_mm3) * 25 AS vol FROM o_known GROUP BY case_id) w USING (case_id)""",
    "o_try": """
        SELECT grid_id, t1, t2, t3, case_id, expected_failure, failure_mode,
               rz >= t1 OR dist >= t2 OR vol > t3 AS flagged,
               coalesce(CASE failure_mode WHEN 1 THEN rz >= t1 OR dist >= t2 WHEN 2 THEN vol > t3 END, false) AS named
        FROM o_calmax CROSS JOIN o_grid""",
    "o_trial": """
        SELECT g.*, coalesce(m.ok, true) AS feasible, CAST(fp AS DOUBLE) / nullif(fp + tn, 0) AS false_positive_rate, CAST(tp AS DOUBLE) / nullif(tp + fn, 0) AS sensitivity FROM (
          SELECT grid_id, t1, t2, t3, count(*) FILTER (expected_failure AND flagged) AS tp, count(*) FILTER (NOT expected_failure AND flagged) AS fp,
                 count(*) FILTER (NOT expected_failure AND NOT flagged) AS tn, count(*) FILTER (expected_failure AND NOT flagged) AS fn
          FROM o_try GROUP BY grid_id, t1, t2, t3) g
        LEFT JOIN (SELECT grid_id, bool_and(caught >= 0.5) AS ok FROM (
          SELECT grid_id, failure_mode, count(*) FILTER (named) / CAST(count(*) AS DOUBLE) AS caught FROM o_try WHERE expected_failure GROUP BY grid_id, failure_mode) q GROUP BY grid_id) m USING (grid_id)""",
    "o_run": """
        SELECT r.run_id, m.mode, m.mode_name, m.metric, m.direction, CAST(m.scale AS DOUBLE) AS scale, r.n_cases, coalesce(v.n_with_value, 0) AS n_with_value, v.mean, v.minimum, v.maximum, v.total
        FROM (SELECT run_id, count(DISTINCT case_id) AS n_cases FROM v_modes GROUP BY run_id) r CROSS JOIN o_mode m
        LEFT JOIN (SELECT run_id, mode, count(value) AS n_with_value, avg(value) AS mean, min(value) AS minimum, max(value) AS maximum, sum(value) AS total
                   FROM v_modes GROUP BY run_id, mode) v ON v.run_id = r.run_id AND v.mode = m.mode""",
    "o_compare": """
        SELECT m.mode, m.mode_name, m.metric, a.mean AS value_a, b.mean AS value_b, b.mean - a.mean AS delta,
               CASE WHEN b.mean - a.mean IS NOT NULL THEN CAST(m.scale AS DOUBLE) END AS scale, (b.mean - a.mean) / CAST(m.scale AS DOUBLE) AS normalised_delta,
               CASE WHEN b.mean - a.mean IS NULL THEN NULL WHEN b.mean = a.mean THEN false WHEN m.direction = 'increases' THEN b.mean > a.mean ELSE b.mean < a.mean END AS worsened
        FROM o_mode m LEFT JOIN (SELECT * FROM o_run WHERE run_id = 'a') a USING (mode) LEFT JOIN (SELECT * FROM o_run WHERE run_id = 'b') b USING (mode)""",
    "o_attr": """
        SELECT *, coalesce(normalised_delta <> 0, false) AND row_number() OVER (PARTITION BY coalesce(normalised_delta <> 0, false) ORDER BY abs(normalised_delta) DESC, mode) = 1 AS attributed FROM o_compare""",
    "o_spans": """SELECT sweep_id, mode, metric, max(value) - min(value) AS span FROM v_ladder GROUP BY sweep_id, mode, metric""",
    "o_response": f"""
        SELECT s.*, o.span AS own, CASE WHEN o.span IS NULL OR o.span = 0 THEN {INF} ELSE s.span / o.span END AS response
        FROM o_spans s LEFT JOIN o_spans o ON o.sweep_id = s.sweep_id AND o.mode = s.metric AND o.metric = s.metric""",
    # Distance transform on the full grid of every label.
    "o_cell": """
        SELECT k.case_id, k.label, x, y, z, v.label IS NOT NULL AS fg FROM o_sums k
        CROSS JOIN (SELECT unnest(range(16)) AS x) gx CROSS JOIN (SELECT unnest(range(16)) AS y) gy CROSS JOIN (SELECT unnest(range(40)) AS z) gz
        LEFT JOIN v_voxels v USING (case_id, label, x, y, z)""",
    "o_dz": """
        SELECT case_id, label, x, y, z, fg, CASE WHEN NOT fg THEN 0 ELSE least(pow(z - below, 2), pow(above - z, 2)) END AS d FROM (
          SELECT *, max(CASE WHEN NOT fg THEN z END) OVER (PARTITION BY case_id, label, x, y ORDER BY z) AS below,
                 min(CASE WHEN NOT fg THEN z END) OVER (PARTITION BY case_id, label, x, y ORDER BY z ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS above FROM o_cell) q""",
    "o_dy": """
        SELECT a.case_id, a.label, a.x, a.y, a.z, a.fg, min(b.d + pow(a.y - b.y, 2)) AS d FROM o_dz a JOIN o_dz b USING (case_id, label, x, z) GROUP BY ALL""",
    "o_edt": """
        SELECT a.case_id, a.label, a.x, a.y, a.z, sqrt(min(b.d + pow(a.x - b.x, 2))) AS edt FROM o_dy a JOIN o_dy b USING (case_id, label, y, z) WHERE a.fg GROUP BY ALL""",
    "o_smooth": """
        SELECT case_id, label, avg(x) AS smooth_x, avg(y) AS smooth_y, avg(z) AS smooth_z FROM (
          SELECT *, max(edt) OVER (PARTITION BY case_id, label) AS peak FROM o_edt) q WHERE edt >= 0.5 * peak GROUP BY case_id, label""",
    **{
        f"o_g{a}": f"""
        SELECT case_id, label, {', '.join(b if b != a else f'q AS {a}' for b in _AXES)}, sum(v * w) AS v FROM (
          SELECT s.*, {src_v} AS v, k.w, unnest([s.{a} - k.k, -1 - s.{a} - k.k, {2 * n - 1} - s.{a} - k.k]) AS q
          FROM {src} s CROSS JOIN o_kernel k) t WHERE q >= 0 AND q < {n} GROUP BY ALL"""
        for a, n, src, src_v in (("x", 16, "o_edt", "edt"), ("y", 16, "o_gx", "v"), ("z", 40, "o_gy", "v"))
    },
    "o_strict": """
        SELECT case_id, label, x AS strict_x, y AS strict_y, z AS strict_z FROM (
          SELECT *, row_number() OVER (PARTITION BY case_id, label ORDER BY round(v, 9) DESC, x, y, z) AS rn FROM o_gz) q WHERE rn = 1""",
}


# A reference from the features of the voxels, beside the one from supplier features.
_VOXEL_FEATURES = {
    **{f: f for f in ("physical_volume_mm3", "extent_x_mm", "extent_y_mm", "extent_z_mm", "curve_offset_mm")},
    **{f"intensity_{n}": f"i.{c}" for n, c in (
        ("mean", "mean"), ("median", "median"), ("std", "std"), ("min", "lo"), ("max", "hi"), ("p05", "p05"), ("p25", "p25"), ("p50", "p50"),
        ("p75", "p75"), ("p95", "p95"), ("entropy", "entropy"))},
    "intensity_range": "i.hi - i.lo", "intensity_iqr": "i.p75 - i.p25",
    "largest_component_fraction": "CAST(g.largest AS DOUBLE) / g.total", "component_count": "g.component_count",
}
CTES["o_vlong"] = " UNION ALL ".join(
    f"SELECT f.case_id, f.label, f.level_name, f.rank, '{name}' AS feature, CAST({text} AS DOUBLE) AS value FROM o_off f "
    f"LEFT JOIN o_intensity i USING (case_id, label) LEFT JOIN o_frag g USING (case_id, label) WHERE f.rank IS NOT NULL AND ({text}) IS NOT NULL"
    for name, text in _VOXEL_FEATURES.items())
CTES["o_vproxy"] = "SELECT case_id, avg(physical_volume_mm3) AS size_proxy FROM o_feat WHERE rank IS NOT NULL GROUP BY case_id"
CTES["o_vstrat"] = """
    SELECT o.*, p.size_proxy, CASE WHEN p.size_proxy >= 900 THEN 's2' WHEN p.size_proxy >= 500 THEN 's1' ELSE 's0' END AS stratum
    FROM o_vlong o JOIN o_vproxy p USING (case_id)"""
for _name in ("ref", "delta", "geo", "int", "roll", "rollint"):
    CTES[f"o_v{_name}"] = re.sub(r"\bo_(long|ref|delta|geo|int)\b", r"o_v\1", CTES[f"o_{_name}"])


def _expand() -> dict[str, tuple[str, str]]:
    """name -> (header, text), with the per-source names spelled out."""
    out: dict[str, tuple[str, str]] = {}
    for name, text in VIEWS.items():
        out[name] = (name, text.replace("{", "").replace("}", ""))
    for head, text in CTES.items():
        for suffix, source in SOURCES.items() if "@" in head else {"": ""}.items():
            full = head.replace("@", suffix)
            body = re.sub(r"(\w+)@", rf"\1{suffix}", text)
            body = re.sub(r"\bSRC\b", source, body)
            name = re.match(r"\w+", full).group(0)
            out[name] = (full, body)
    return out


ALL = _expand()


def oracle(body: str, doubles: str = "") -> str:
    """A full statement: the sub-queries ``body`` needs, then ``body`` itself.

    Columns named in ``doubles`` are rounded like the engine's side.
    """
    needed: dict[str, None] = {}

    def visit(text: str, path: tuple[str, ...]) -> None:
        for name in dict.fromkeys(re.findall(r"\b[ovf]_\w+", text)):
            if name in ALL and name not in path and name not in needed:
                visit(ALL[name][1], (*path, name))
                needed[name] = None

    visit(body, ())
    names = doubles.split()
    if names:
        body = "SELECT * REPLACE ({}) FROM ({}) body".format(
            ", ".join(f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}" for c in names), body
        )
    if not needed:
        return body
    parts = []
    for name in needed:
        head, text = ALL[name]
        how = "" if "USING KEY" in head else "MATERIALIZED "
        parts.append(f"{head} AS {how}({text})")
    return "WITH RECURSIVE " + ",\n".join(parts) + f"\nSELECT * FROM ({body}) result"
