"""Queries over sources, projections, joins, aggregations and windows of features."""

from __future__ import annotations

from pyspark.sql import functions as F

from instqc.operators import components, edits, edt, geometry, inventory, overlap, reference, rules, sequence
from instqc.operators.intensity import STATISTICS, label_intensity
from instqc.operators.metrics import average_ranks
from instqc.schemas import FACES, levels
from instqc.session import cut_lineage, scratch_path
from instqc.sources import datasets, tables
from suite.registry import query

SEG, ID = "**/*_seg.nii.gz", r"sub-([0-9]+)_seg"
FEATURE_DOUBLES = "physical_volume_mm3 extent_x_mm extent_y_mm extent_z_mm"


def features(i):
    return geometry.label_features(i.voxels, i.grids, levels(i.spark))


# --- sources -----------------------------------------------------------------

@query("src1", "SELECT case_id, count(*) AS n, CAST(sum(x + y + z) AS BIGINT) AS s, count(DISTINCT label) AS labels FROM v_voxels GROUP BY case_id")
def src1(i):
    path = scratch_path(i.spark, "voxels")
    tables.write_voxels(i.voxels, path)
    return tables.read_voxels(i.spark, path).groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("x") + F.col("y") + F.col("z")).alias("s"),
        F.count_distinct("label").alias("labels"))


ALIGN = """
    SELECT case_id, g.nx = s.nx AND g.ny = s.ny AND g.nz = s.nz AS same_shape,
           abs(s.sx - g.sx) <= 0.0001 + 0.00001 * g.sx AND abs(s.sy - g.sy) <= 0.0001 + 0.00001 * g.sy AND abs(s.sz - g.sz) <= 0.0001 + 0.00001 * g.sz AS same_affine
    FROM v_grids g JOIN v_scan_grids s USING (case_id)"""


@query("src2", f"""SELECT *, CASE WHEN NOT same_shape THEN 'scan and segmentation have mismatched shapes'
        WHEN NOT same_affine THEN 'scan and segmentation have incompatible affines' END AS reason FROM ({ALIGN}) a""")
def src2(i):
    return tables.alignment(i.grids, i.scan_grids)


SEGS = r"""
    SELECT path, CASE WHEN regexp_matches(path, 'sub-([0-9]+)_seg') THEN regexp_extract(path, 'sub-([0-9]+)_seg', 1) END AS case_id
    FROM v_files WHERE path LIKE '%\_seg.nii.gz' ESCAPE '\'"""
CASES = f"SELECT case_id, min(path) AS seg_path FROM ({SEGS}) s WHERE case_id IS NOT NULL GROUP BY case_id HAVING count(*) = 1"


@query("src3", f"""
    SELECT case_id, seg_path AS path, 'case' AS kind FROM ({CASES}) c
    UNION ALL SELECT NULL, min(path), 'duplicate case_id ' || case_id FROM ({SEGS}) s WHERE case_id IS NOT NULL GROUP BY case_id HAVING count(*) > 1
    UNION ALL SELECT NULL, path, 'case_id pattern does not match' FROM ({SEGS}) s WHERE case_id IS NULL""")
def src3(i):
    cases, errors = datasets.discover(i.frame("v_files"), SEG, ID)
    return cases.select("case_id", F.col("seg_path").alias("path"), F.lit("case").alias("kind")).unionByName(
        errors.select(F.lit(None).cast("string").alias("case_id"), "path", F.col("reason").alias("kind")))


@query("src4", f"""
    SELECT case_id, 'ids' AS how FROM ({CASES}) c WHERE case_id IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_mktsegment = 'BUILDING')
    UNION ALL SELECT case_id, 'pattern' FROM ({CASES}) c WHERE case_id LIKE '1%7'
    UNION ALL SELECT case_id, 'folder' FROM ({SEGS}) c WHERE path LIKE 'cohort/extra/%'""")
def src4(i):
    files = i.frame("v_files")
    cases, _ = datasets.discover(files, SEG, ID)
    ids = i.frame("customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    below, _ = datasets.discover(files, "*_seg.nii.gz", ID, root="cohort/extra/")
    pick = lambda df, how: df.select("case_id", F.lit(how).alias("how"))
    return pick(datasets.select_subset(cases, ids=ids), "ids").unionByName(
        pick(datasets.select_subset(cases, pattern="1*7"), "pattern")).unionByName(pick(below, "folder"))


@query("src5", f"""SELECT c.case_id, c.seg_path, f.path AS scan_path FROM ({CASES}) c
    LEFT JOIN v_files f ON f.path = 'cohort/scans/sub-' || c.case_id || '.nii.gz'""")
def src5(i):
    files = i.frame("v_files")
    cases, _ = datasets.discover(files, SEG, ID)
    return datasets.pair_scans(cases, files, "cohort/scans/sub-{id}.nii.gz").select("case_id", "seg_path", "scan_path")


@query("src6", r"""
    SELECT regexp_extract(s.path, '([^/]*)_seg\.nii\.gz$', 1) AS case_id, s.path AS seg_path, f.path AS scan_path FROM v_files s
    LEFT JOIN v_files f ON f.path = replace(s.path, '_seg.nii.gz', '_scan.nii.gz') WHERE s.path LIKE '%\_seg.nii.gz' ESCAPE '\'""")
def src6(i):
    return datasets.ingest_listing(i.frame("v_files"))


@query("src7", """
    WITH m AS (
      SELECT o_orderkey, concat('m', CASE WHEN o_orderkey % 40 = 3 THEN o_orderkey - 1 ELSE o_orderkey END) AS case_id,
             CASE WHEN o_orderkey % 17 <> 0 THEN 'gt' END AS gt, CASE WHEN o_orderkey % 23 <> 0 THEN 'pass' END AS verdict FROM orders),
    d AS (SELECT case_id FROM m GROUP BY case_id HAVING count(*) > 1)
    SELECT case_id, coalesce(CASE WHEN gt IS NULL THEN 'missing gt' WHEN verdict IS NULL THEN 'missing expected_verdict' END,
           CASE WHEN case_id IN (SELECT case_id FROM d) THEN 'duplicate case_id' END) AS reason, verdict AS expected_verdict FROM m""")
def src7(i):
    key = F.col("o_orderkey")
    listed = i.frame("orders").select(F.struct(
        F.concat(F.lit("m"), F.when(key % 40 == 3, key - 1).otherwise(key)).alias("case_id"),
        F.when(key % 17 != 0, "gt").alias("gt"),
        F.struct(F.when(key % 23 != 0, "pass").alias("expected_verdict")).alias("expected"),
    ).alias("c"))
    path = scratch_path(i.spark, "manifest")
    listed.select(F.array("c").alias("cases")).write.json(path)
    cases = datasets.read_manifest(i.spark, path, multi_line=False)
    good, bad = datasets.check_manifest(cases)
    pick = lambda df, reason: df.select("case_id", reason.alias("reason"), F.col("expected.expected_verdict").alias("expected_verdict"))
    return pick(good, F.lit(None).cast("string")).unionByName(pick(bad, F.col("reason")))


@query("src7_lines", """
    WITH m AS (
      SELECT concat('m', CASE WHEN o_orderkey % 40 = 3 THEN o_orderkey - 1 ELSE o_orderkey END) AS case_id, o_orderkey % 29 = 0 AS broken,
             CASE WHEN o_orderkey % 17 <> 0 THEN 'gt' END AS gt, CASE WHEN o_orderkey % 23 <> 0 THEN 'pass' END AS verdict FROM orders),
    d AS (SELECT case_id FROM m WHERE NOT broken GROUP BY case_id HAVING count(*) > 1)
    SELECT CASE WHEN NOT broken THEN case_id END AS case_id, CASE WHEN broken THEN 'malformed line' WHEN gt IS NULL THEN 'missing gt' WHEN verdict IS NULL THEN 'missing expected_verdict'
           WHEN case_id IN (SELECT case_id FROM d) THEN 'duplicate case_id' END AS reason, CASE WHEN NOT broken THEN verdict END AS expected_verdict FROM m""")
def src7_lines(i):
    key = F.col("o_orderkey")
    case = F.to_json(F.struct(
        F.concat(F.lit("m"), F.when(key % 40 == 3, key - 1).otherwise(key)).alias("case_id"), F.when(key % 17 != 0, "gt").alias("gt"),
        F.struct(F.when(key % 23 != 0, "pass").alias("expected_verdict")).alias("expected")))
    path = scratch_path(i.spark, "manifest")
    i.frame("orders").select(F.when(key % 29 == 0, F.concat(F.lit("{case "), key)).otherwise(case).alias("value")).write.text(path)
    good, bad = datasets.check_manifest(cut_lineage(datasets.read_manifest_lines(i.spark, path)))
    pick = lambda df, reason: df.select("case_id", reason.alias("reason"), F.col("expected.expected_verdict").alias("expected_verdict"))
    return pick(good, F.lit(None).cast("string")).unionByName(pick(bad, F.col("reason")))


# --- projections ---------------------------------------------------------------

@query("prj1", "SELECT s.case_id, s.label, coalesce(l.level_name, 'unknown') AS level_name, voxel_count FROM o_sums s LEFT JOIN o_levels l USING (label)")
def prj1(i):
    return inventory.with_levels(inventory.inventory(i.voxels), levels(i.spark)).select("case_id", "label", "level_name", "voxel_count")


@query("prj2", """
    WITH q AS (SELECT concat(' ', CASE o_orderkey % 3 WHEN 0 THEN 'c' WHEN 1 THEN 't' ELSE 'L' END, o_orderkey % 14, ' ') AS name FROM orders)
    SELECT name, l.label, count(*) AS n FROM q LEFT JOIN o_levels l ON upper(trim(name)) = upper(l.level_name) GROUP BY name, l.label""")
def prj2(i):
    key = F.col("o_orderkey")
    names = i.frame("orders").select(F.concat(
        F.lit(" "), F.when(key % 3 == 0, "c").when(key % 3 == 1, "t").otherwise("L"), key % 14, F.lit(" ")).alias("name"))
    return inventory.labels_by_name(names, levels(i.spark)).groupBy("name", "label").agg(F.count(F.lit(1)).alias("n"))


SUMMARY = """SELECT s.case_id, s.label, coalesce(l.level_name, 'unknown') AS level_name, voxel_count,
        l.level_name IS NOT NULL AS recognised, coalesce(l.rank, 33) AS position FROM o_sums s LEFT JOIN o_levels l USING (label)"""


@query("prj3", SUMMARY)
def prj3(i):
    return inventory.summarise(i.voxels, levels(i.spark))


@query("prj4", """SELECT upper(trim(concat('lv ', p_size, ' '))) AS name, count(*) AS n, CAST(min(p_partkey) AS BIGINT) AS first_label, CAST(max(p_partkey) AS BIGINT) AS last_label
    FROM part GROUP BY p_size HAVING count(*) > 1""")
def prj4(i):
    custom = i.frame("part").select(F.col("p_partkey").alias("label"), F.concat(
        F.when(F.col("p_partkey") % 2 == 0, "lv ").otherwise("LV "), "p_size", F.lit(" ")).alias("level_name"))
    return inventory.name_clashes(custom)


@query("prj5", """
    SELECT v.case_id, CASE axcodes WHEN 'LPS' THEN 15 - x WHEN 'PIR' THEN z ELSE x END AS x,
           CASE axcodes WHEN 'LPS' THEN 15 - y WHEN 'PIR' THEN 15 - x ELSE y END AS y,
           CASE axcodes WHEN 'RAI' THEN 39 - z WHEN 'PIR' THEN 15 - y ELSE z END AS z, label FROM v_voxels v JOIN v_grids USING (case_id)""")
def prj5(i):
    return geometry.reorient(i.voxels, i.grids)


@query("prj6", "SELECT case_id, x_low, x_high, y_low, y_high, z_low, z_high, stacking_axis FROM o_faces")
def prj6(i):
    faces = [F.col(f"{a}_{s}_face").alias(f"{a}_{s}") for a in "xyz" for s in ("low", "high")]
    return geometry.face_map(i.grids).select("case_id", *faces, "stacking_axis")


@query("prj7", "SELECT s.case_id, coalesce(l.grp, 'none') AS grp, CAST(sum(voxel_count) AS BIGINT) AS voxels FROM o_sums s LEFT JOIN o_levels l USING (label) GROUP BY s.case_id, coalesce(l.grp, 'none')")
def prj7(i):
    named = inventory.with_levels(inventory.inventory(i.voxels), levels(i.spark))
    return named.groupBy("case_id", F.coalesce("grp", F.lit("none")).alias("grp")).agg(F.sum("voxel_count").alias("voxels"))


@query("prj8", "SELECT case_id, label, level_name, feature, value FROM o_long", "value")
def prj8(i):
    return reference.feature_long(i.wide)


@query("prj9", "SELECT case_id, CAST(label AS VARCHAR) AS skipped_labels FROM o_feat WHERE rank IS NULL")
def prj9(i):
    return reference.skipped_labels(features(i))


def reference_of(i):
    return reference.aggregate_reference(reference.with_stratum(reference.observations(i.wide)))


def wide_tables(i, ref=None):
    """Tables for rules over the supplier cohort."""
    wide = i.wide
    return rules.Tables(wide, levels(i.spark), reference=ref)


@query("prj11", """
    SELECT w.case_id, w.label, b.feature, CASE b.k2 WHEN 0 THEN physical_volume_mm3 WHEN 1 THEN extent_x_mm WHEN 2 THEN extent_y_mm ELSE extent_z_mm END AS value,
           coalesce(r.p1, CAST(b.hand_lo AS DOUBLE)) AS lo, coalesce(r.p99, CAST(b.hand_hi AS DOUBLE)) AS hi
    FROM o_known w JOIN o_bound b ON b.grp = 'lumbar' LEFT JOIN o_ref r ON r.level_name = w.level_name AND r.feature = b.feature AND r.level_name <> 'L3'""", "value lo hi")
def prj11(i):
    from instqc.config import DEFAULT_CONFIG, rule_params

    part = reference_of(i).filter("level_name <> 'L3'")
    table = rules.bounds_table(wide_tables(i, part), rule_params(DEFAULT_CONFIG, "bounds"))
    return table.select("case_id", "label", "feature", "value", "lo", "hi")


@query("prj12", "SELECT case_id, CASE expected_verdict WHEN 'pass' THEN 0 ELSE 1 END AS severity, expected_verdict AS label FROM v_expected")
def prj12(i):
    from instqc.schemas import severity_label, severity_of

    level = severity_of(F.col("expected_verdict"))
    return i.expected.select("case_id", level.alias("severity"), severity_label(level).alias("label"))


@query("prj13", "SELECT case_id, label, value FROM o_sized WHERE k2 = 0 AND (value < 2000 OR value > 9500) AND grp = 'lumbar'", "value")
def prj13(i):
    from instqc.config import DEFAULT_CONFIG, apply_assignment, rule_params

    config = apply_assignment(DEFAULT_CONFIG, {
        ("bounds", "lumbar", "min_volume_mm3"): 2000.0, ("bounds", "lumbar", "max_volume_mm3"): 9500.0})
    table = rules.bounds_table(rules.Tables(features(i), levels(i.spark)), rule_params(config, "bounds"))
    return table.filter("k2 = 0 AND grp = 'lumbar' AND (value < lo OR value > hi)").select("case_id", "label", "value")


# --- joins ------------------------------------------------------------------------

@query("jn1", "SELECT * FROM o_overlapM")
def jn1(i):
    return overlap.label_overlaps(i.multi, levels(i.spark))


@query("jn2", """SELECT c.case_id, 23 AS target, 22 AS neighbour, count(*) AS overlap_voxels FROM v_cand c
    JOIN v_voxels b USING (case_id, x, y, z) WHERE c.label = 23 AND b.label = 22 GROUP BY c.case_id""")
def jn2(i):
    pairs = i.grids.select("case_id", F.lit(23).alias("target"), F.lit(22).alias("neighbour"))
    return overlap.overlap_with_base(i.candidate, i.voxels, pairs)


@query("jn3", """SELECT case_id, label, level_name, position, matched, CAST(dice AS DOUBLE) AS dice, jaccard, CAST(a AS BIGINT) AS candidate_voxels, CAST(b AS BIGINT) AS gt_voxels,
    CAST(i AS BIGINT) AS intersection_voxels, volume AS physical_volume_mm3 FROM o_dice""", "dice jaccard physical_volume_mm3")
def jn3(i):
    return overlap.dice(i.candidate, i.voxels, i.grids, levels(i.spark))


def both_features(i):
    lv = levels(i.spark)
    return (sequence.curve_offsets(geometry.label_features(i.candidate, i.grids, lv)),
            sequence.curve_offsets(geometry.label_features(i.voxels, i.grids, lv)))


MATCHED = " ".join(f"{k}_{f}" for k in ("abs", "rel") for f in ("physical_volume_mm3", "extent_x_mm", "extent_y_mm", "extent_z_mm", "curve_offset_mm"))


@query("jn4", "SELECT * FROM o_score", MATCHED + " centroid_distance_mm divergence_score")
def jn4(i):
    from instqc.plans.evaluate import feature_match

    return feature_match(*both_features(i))


@query("jn6", "SELECT * FROM o_missing")
def jn6(i):
    return sequence.missing_levels(features(i), levels(i.spark))


@query("jn7", "SELECT * FROM o_span")
def jn7(i):
    return sequence.spans(features(i))


# --- aggregations -------------------------------------------------------------------

@query("agg1", "SELECT case_id, label, voxel_count FROM o_sums")
def agg1(i):
    return inventory.inventory(i.voxels)


@query("agg2", """
    WITH c AS (SELECT g.case_id, CAST(coalesce(sum(voxel_count), 0) AS BIGINT) AS foreground, count(s.label) AS label_count FROM v_grids g LEFT JOIN o_sums s USING (case_id) GROUP BY g.case_id)
    SELECT *, concat_ws(',', CASE WHEN foreground = 0 THEN 'No foreground voxels found (empty label map).' WHEN foreground < 4100 THEN 'Foreground voxel count ' || foreground || ' is below the minimum 4100.' END,
           CASE WHEN label_count < 5 THEN 'Distinct label count ' || label_count || ' is below the minimum 5.' END) AS reasons, foreground < 4100 OR label_count < 5 AS is_empty FROM c""")
def agg2(i):
    return inventory.check_empty(i.grids, inventory.inventory(i.voxels), {"min_foreground_voxels": 4100, "min_label_count": 5})


@query("agg3", f"""SELECT case_id, label, level_name, voxel_count, physical_volume_mm3, extent_x_mm, extent_y_mm, extent_z_mm, x_min, x_max, y_min, y_max, z_min, z_max,
    x_min * sx AS x_min_mm, z_max * sz AS z_max_mm, {', '.join('touches_' + f for f in FACES)} FROM o_feat""", FEATURE_DOUBLES + " x_min_mm z_max_mm")
def agg3(i):
    return features(i).select(
        "case_id", "label", "level_name", "voxel_count", "physical_volume_mm3", "extent_x_mm", "extent_y_mm", "extent_z_mm",
        "x_min", "x_max", "y_min", "y_max", "z_min", "z_max", "x_min_mm", "z_max_mm", *[f"touches_{f}" for f in FACES])


@query("agg4", "SELECT case_id, label, cx, cy, cz, cx_mm, cy_mm, cz_mm FROM o_feat", "cx cy cz cx_mm cy_mm cz_mm")
def agg4(i):
    return features(i).select("case_id", "label", "cx", "cy", "cz", "cx_mm", "cy_mm", "cz_mm")


INTENSITY_SQL = """SELECT case_id, label, voxel_count, n_nonfinite_excluded, mean, median, std, lo AS min, hi AS max, p05, p25, p50, p75, p95, hi - lo AS range, p75 - p25 AS iqr, entropy FROM o_intensity"""
STATS = " ".join(STATISTICS)


@query("agg5", INTENSITY_SQL, STATS)
def agg5(i):
    return label_intensity(i.voxels, i.scan)


@query("agg6", "SELECT case_id, label, entropy FROM o_intensity", "entropy")
def agg6(i):
    return label_intensity(i.voxels, i.scan).select("case_id", "label", "entropy")


EIGEN = """
    WITH m AS (SELECT case_id, label, voxel_count, cxx*sx*sx AS a, cyy*sy*sy AS b, czz*sz*sz AS c, cxy*sx*sy AS d, cxz*sx*sz AS e, cyz*sy*sz AS f FROM o_feat),
    p AS (SELECT *, (a+b+c)/3 AS q FROM m),
    r AS (SELECT *, sqrt(((a-q)*(a-q)+(b-q)*(b-q)+(c-q)*(c-q)+2*(d*d+e*e+f*f))/6) AS s FROM p),
    t AS (SELECT *, acos(greatest(-1, least(1, ((a-q)*((b-q)*(c-q)-f*f) - d*(d*(c-q)-f*e) + e*(d*f-(b-q)*e)) / (2*s*s*s))))/3 AS phi FROM r),
    l AS (SELECT *, q+2*s*cos(phi) AS l1, 3*q-(q+2*s*cos(phi))-(q+2*s*cos(phi+2*pi()/3)) AS l2 FROM t),
    x AS (SELECT *, [d*f-e*(b-l1), e*d-(a-l1)*f, (a-l1)*(b-l1)-d*d] AS u1, [d*(c-l1)-e*f, e*e-(a-l1)*(c-l1), (a-l1)*f-d*e] AS u2, [(b-l1)*(c-l1)-f*f, f*e-d*(c-l1), d*f-(b-l1)*e] AS u3 FROM l),
    n AS (SELECT *, list_sum([v*v FOR v IN u1]) AS n1, list_sum([v*v FOR v IN u2]) AS n2, list_sum([v*v FOR v IN u3]) AS n3 FROM x),
    k AS (SELECT *, CASE WHEN n1>=n2 AND n1>=n3 THEN u1 WHEN n2>=n3 THEN u2 ELSE u3 END AS u FROM n),
    g AS (SELECT *, [v/sqrt(list_sum([w*w FOR w IN u])) FOR v IN u] AS h FROM k),
    z AS (SELECT *, CASE WHEN abs(h[1])>=abs(h[2]) AND abs(h[1])>=abs(h[3]) THEN sign(h[1]) WHEN abs(h[2])>=abs(h[3]) THEN sign(h[2]) ELSE sign(h[3]) END AS g FROM g)
    SELECT case_id, label, l1/l2 AS eigenvalue_ratio, h[1]*g AS axis_x, h[2]*g AS axis_y, h[3]*g AS axis_z FROM z"""


@query("agg7", EIGEN, "eigenvalue_ratio axis_x axis_y axis_z")
def agg7(i):
    return features(i).select("case_id", "label", "eigenvalue_ratio", "axis_x", "axis_y", "axis_z")


def parts(i, source=None):
    return components.summary(components.components(i.voxels if source is None else source), i.grids, 10)


def count_text(sizes, what="size"):
    return F.array_join(F.transform(sizes, lambda s: F.concat(s[what].cast("string"), F.lit("x"), s["n"].cast("string"))), ",")


COUNTS = "array_to_string([s.size || 'x' || s.n FOR s IN {}], ',')"
COUNTED = "list_sort([{{'size': u, 'n': len([v FOR v IN {0} IF v = u])}} FOR u IN list_distinct({0})], 'DESC')"


@query("agg8", f"""
    SELECT case_id, label, component_count, {COUNTS.format("counts")} AS component_sizes, fragmentation_index AS largest_component_fraction,
           {COUNTS.format("[s FOR s IN counts IF s.size < 10]")} AS small_fragments, component_count - 1 AS stray_component_count,
           {COUNTS.format("stray")} AS stray_component_sizes, (total - largest) * sx * sy * sz AS stray_volume_mm3, 1 - fragmentation_index AS stray_volume_fraction,
           counts[1].size * (sx * sy * sz) AS largest_volume_mm3, CAST(list_sum([s.n FOR s IN counts]) AS BIGINT) AS n_volumes
    FROM (SELECT f.*, {COUNTED.format("stray_sizes")} AS stray FROM o_frag f) q JOIN v_grids USING (case_id)""",
       "largest_component_fraction stray_volume_mm3 stray_volume_fraction largest_volume_mm3")
def agg8(i):
    volumes = F.col("component_volumes_mm3")
    return parts(i).select(
        "case_id", "label", "component_count", "largest_component_fraction", "stray_component_count", "stray_volume_mm3", "stray_volume_fraction",
        *[count_text(c).alias(c) for c in ("component_sizes", "small_fragments", "stray_component_sizes")],
        F.element_at(volumes, 1)["volume_mm3"].alias("largest_volume_mm3"), components.count_of(volumes).alias("n_volumes"))


@query("agg9", "SELECT case_id, label, fragmentation_index FROM o_frag", "fragmentation_index")
def agg9(i):
    return parts(i).select("case_id", "label", "fragmentation_index")


@query("agg10", "SELECT case_id, avg(physical_volume_mm3) AS size_proxy FROM o_feat WHERE rank IS NOT NULL GROUP BY case_id", "size_proxy")
def agg10(i):
    return geometry.size_proxy(features(i))


EDGES = (3400.0, 3000.0)


@query("agg11", "SELECT DISTINCT case_id, size_proxy, stratum FROM o_strat", "size_proxy")
def agg11(i):
    obs = reference.with_stratum(reference.observations(i.wide), EDGES)
    return obs.select("case_id", "size_proxy", "stratum").distinct()


PCTS = ", ".join(f"quantile_cont(value, {p / 100.0}) AS p{p}" for p in reference.PERCENTILES)
PCT_NAMES = " ".join(f"p{p}" for p in reference.PERCENTILES)


def flat_reference(stats):
    return stats.select(
        "level_name", "stratum", "feature", "n", "mean", "std", "min", "max",
        *[F.col("pcts")[p].alias(f"p{p}") for p in reference.PERCENTILES])


@query("agg12", f"""SELECT level_name, stratum, feature, count(*) AS n, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS std, min(value) AS min, max(value) AS max, {PCTS}
    FROM o_strat GROUP BY level_name, stratum, feature""", "mean std min max " + PCT_NAMES)
def agg12(i):
    return flat_reference(reference.aggregate_reference(reference.with_stratum(reference.observations(i.wide), EDGES)))


@query("agg23", """
    SELECT f.case_id, coalesce(p.present, '') AS present_levels, coalesce(m.missing, '') AS missing_levels, coalesce(o.late, '') AS out_of_order_labels, o.late IS NULL AS is_continuous
    FROM (SELECT DISTINCT case_id FROM o_feat) f
    LEFT JOIN (SELECT case_id, string_agg(level_name, ',' ORDER BY rank) AS present FROM o_feat WHERE rank IS NOT NULL GROUP BY case_id) p USING (case_id)
    LEFT JOIN (SELECT case_id, string_agg(level_name, ',' ORDER BY rank) AS missing FROM o_missing GROUP BY case_id) m USING (case_id)
    LEFT JOIN (SELECT case_id, string_agg(level_name, ',' ORDER BY label) AS late FROM o_late GROUP BY case_id) o USING (case_id)""")
def agg23(i):
    return sequence.relationships(cut_lineage(features(i)), levels(i.spark)).drop("neighbour_spacings_mm")


@query("agg24", """
    WITH g AS (SELECT *, avg(gap_mm) OVER (PARTITION BY case_id) AS mean_spacing_mm, (stddev_pop(gap_mm) OVER (PARTITION BY case_id)) / (avg(gap_mm) OVER (PARTITION BY case_id)) AS cv_spacing FROM o_gap WHERE gap_mm IS NOT NULL)
    SELECT case_id, label, next_label, level_name, next_level, gap_mm, mean_spacing_mm, cv_spacing, gap_mm - mean_spacing_mm AS deviation_mm, gap_mm >= 2 * mean_spacing_mm OR gap_mm <= 0.3 * mean_spacing_mm AS is_outlier FROM g""",
       "gap_mm mean_spacing_mm cv_spacing deviation_mm")
def agg24(i):
    return sequence.spacing_consistency(features(i))


@query("agg25", """SELECT count(DISTINCT case_id) AS subject_count, array_to_string(list_sort(list(DISTINCT stratum)), ',') AS strata, array_to_string(list_sort(list(DISTINCT feature)), ',') AS features FROM o_strat""")
def agg25(i):
    obs = reference.with_stratum(reference.observations(i.wide), EDGES)
    return reference.reference_meta(obs).select("subject_count", "strata", "features")


# --- windows ---------------------------------------------------------------------------

@query("win1", "SELECT case_id, label, gap_mm, coalesce(gap_mm, lag(gap_mm) OVER (PARTITION BY case_id ORDER BY label)) AS spacing_mm FROM o_gap", "gap_mm spacing_mm")
def win1(i):
    return sequence.consecutive_spacing(features(i)).select("case_id", "label", "gap_mm", "spacing_mm")


@query("win2", """SELECT case_id, label, level_name, rank, lead(level_name) OVER w AS next_level,
    sqrt(pow((lead(cx_mm) OVER w) - cx_mm, 2) + pow((lead(cy_mm) OVER w) - cy_mm, 2) + pow((lead(cz_mm) OVER w) - cz_mm, 2)) AS neighbour_spacing_mm
    FROM o_feat WHERE rank IS NOT NULL WINDOW w AS (PARTITION BY case_id ORDER BY rank)""", "neighbour_spacing_mm")
def win2(i):
    return sequence.canonical_spacing(features(i))


@query("win3", "SELECT * FROM o_late")
def win3(i):
    return sequence.out_of_order(features(i))


NEAR = """
    WITH s AS (SELECT o.case_id, o.label, o.level_name, o.curve_offset_mm, o.physical_volume_mm3, coalesce(g.gap_mm, lag(g.gap_mm) OVER (PARTITION BY case_id ORDER BY label)) AS spacing_mm,
                 row_number() OVER (PARTITION BY case_id ORDER BY label) AS pos, count(*) OVER (PARTITION BY case_id) AS n FROM o_off o JOIN o_gap g USING (case_id, label)),
    u AS (SELECT case_id, label, pos, 'spacing_mm' AS feature, spacing_mm AS value FROM s WHERE n > 1 UNION ALL SELECT case_id, label, pos, 'offset_mm', curve_offset_mm FROM s WHERE n > 1
          UNION ALL SELECT case_id, label, pos, 'volume_mm3', physical_volume_mm3 FROM s WHERE n > 1),
    w AS (SELECT a.case_id, a.label, a.feature, a.value, avg(b.value) AS mean, median(b.value) AS median, stddev_pop(b.value) AS std,
            avg(b.value) FILTER (b.pos <> a.pos) AS om, list(b.value) FILTER (b.pos <> a.pos AND b.value IS NOT NULL) AS others
          FROM u a JOIN u b ON a.case_id = b.case_id AND a.feature = b.feature AND abs(a.pos - b.pos) <= 1 GROUP BY a.case_id, a.label, a.feature, a.value),
    z AS (SELECT *, CASE WHEN value IS NULL THEN NULL WHEN others IS NULL OR len(others) = 0 THEN 0 ELSE abs(value - om) / greatest(sqrt(list_avg([(v - om) * (v - om) FOR v IN others])), 0.000001) END AS z_score FROM w)"""


def near(i):
    return sequence.neighbourhood(features(i))


@query("win4", NEAR + " SELECT case_id, label, feature, value, mean, median, std FROM z", "value mean median std")
def win4(i):
    return near(i).select("case_id", "label", "feature", "value", "mean", "median", "std")


@query("win5", NEAR + """ SELECT case_id, label, feature, z_score, d AS deviation_score, d >= 2 AS is_outlier FROM (
    SELECT *, coalesce(max(CASE WHEN feature <> 'spacing_mm' THEN z_score END) OVER (PARTITION BY case_id, label), 0) AS d FROM z) q""", "z_score deviation_score")
def win5(i):
    return near(i).select("case_id", "label", "feature", "z_score", "deviation_score", "is_outlier")


@query("win6", "SELECT case_id, label, closest_t, dx_mm, dy_mm, dz_mm, curve_offset_mm, curve_offset_voxel FROM o_off",
       "closest_t dx_mm dy_mm dz_mm curve_offset_mm curve_offset_voxel")
def win6(i):
    return sequence.curve_offsets(features(i)).select(
        "case_id", "label", "closest_t", "dx_mm", "dy_mm", "dz_mm", "curve_offset_mm", "curve_offset_voxel")


@query("win7", """
    WITH t AS (SELECT *, coalesce(lead(cx_mm) OVER w, cx_mm) - coalesce(lag(cx_mm) OVER w, cx_mm) AS tx, coalesce(lead(cy_mm) OVER w, cy_mm) - coalesce(lag(cy_mm) OVER w, cy_mm) AS ty,
                 coalesce(lead(cz_mm) OVER w, cz_mm) - coalesce(lag(cz_mm) OVER w, cz_mm) AS tz, count(*) OVER (PARTITION BY case_id) AS n FROM o_feat WINDOW w AS (PARTITION BY case_id ORDER BY label)),
    s AS (SELECT *, sqrt(tx*tx + ty*ty + tz*tz) AS len FROM t WHERE n > 1),
    a AS (SELECT *, degrees(acos(greatest(-1, least(1, tz / len)))) AS tangent_angle_deg, tx / len AS ux, ty / len AS uy, tz / len AS uz FROM s)
    SELECT case_id, label, level_name, tangent_angle_deg, degrees(acos(greatest(-1, least(1, ux * (lead(ux) OVER w) + uy * (lead(uy) OVER w) + uz * (lead(uz) OVER w))))) * CASE WHEN lead(label) OVER w IS NULL THEN NULL ELSE 1 END AS inter_tangent_angle_deg,
           (max(tangent_angle_deg) OVER (PARTITION BY case_id)) - (min(tangent_angle_deg) OVER (PARTITION BY case_id)) AS total_curvature_deg FROM a WINDOW w AS (PARTITION BY case_id ORDER BY label)""",
       "tangent_angle_deg inter_tangent_angle_deg total_curvature_deg")
def win7(i):
    return sequence.curvature(features(i))


@query("win8", "SELECT case_id, label, level_name, u, next_label, next_level, non_monotonic FROM o_prog", "u")
def win8(i):
    return sequence.progression(features(i))


@query("win9", """SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS average_rank FROM lineitem""", "average_rank l_quantity")
def win9(i):
    lines = i.frame("lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_quantity")
    return average_ranks(lines, ["l_returnflag"], "l_quantity", "average_rank").drop("l_returnflag")


@query("win10", "SELECT case_id, label, size, row_number() OVER (PARTITION BY case_id, label ORDER BY size DESC) AS size_rank FROM o_comp")
def win10(i):
    ranked = components.ranked_components(cut_lineage(components.components(i.voxels)))
    return ranked.select("case_id", "label", "size", "size_rank")


@query("win12", "SELECT case_id, label, feature, value, pct_rank FROM o_geo", "value pct_rank")
def win12(i):
    return geometry_deltas(i).select("case_id", "label", "feature", "value", "pct_rank")


def geometry_deltas(i, family="geometry"):
    from instqc.operators.delta import feature_deltas

    return cut_lineage(feature_deltas(reference.feature_long(i.wide), reference_of(i), family))


# --- components and distance transform --------------------------------------------------

RUNS = """SELECT case_id, label, x, y, min(z) AS z0, max(z) AS z1 FROM (
    SELECT *, z - row_number() OVER (PARTITION BY case_id, label, x, y ORDER BY z) AS k FROM v_voxels) q GROUP BY case_id, label, x, y, k"""


@query("cc1", RUNS)
def cc1(i):
    return components.label_runs(i.voxels)


@query("cc2", f"""WITH r AS MATERIALIZED ({RUNS})
    SELECT a.case_id, a.label, a.x AS xa, a.y AS ya, a.z0 AS za, b.x AS xb, b.y AS yb, b.z0 AS zb FROM r a JOIN r b ON a.case_id = b.case_id AND a.label = b.label AND a.x + 1 = b.x AND a.y = b.y AND a.z0 <= b.z1 AND b.z0 <= a.z1
    UNION ALL SELECT a.case_id, a.label, a.x, a.y, a.z0, b.x, b.y, b.z0 FROM r a JOIN r b ON a.case_id = b.case_id AND a.label = b.label AND a.x = b.x AND a.y + 1 = b.y AND a.z0 <= b.z1 AND b.z0 <= a.z1""")
def cc2(i):
    return components.run_edges(cut_lineage(components.label_runs(i.voxels)))


FIRST = 2 ** components.BITS


@query("cc3", f"""SELECT case_id, label, min(CAST(x AS BIGINT) * {FIRST ** 2} + CAST(y AS BIGINT) * {FIRST} + z) AS component, count(*) AS size
    FROM o_ccrec c JOIN o_node n USING (id) GROUP BY case_id, label, c.comp""")
def cc3(i):
    return components.components(i.voxels)


@query("edt1", "SELECT case_id, label, x, y, z, edt FROM o_edt", "edt")
def edt1(i):
    return edt.distance(i.voxels, i.grids).select("case_id", "label", "x", "y", "z", "edt")


@query("edt2", "SELECT * FROM o_smooth", "smooth_x smooth_y smooth_z")
def edt2(i):
    return edt.smooth_centre(cut_lineage(edt.distance(i.voxels, i.grids)))


@query("edt3", "SELECT * FROM o_strict", "strict_x strict_y strict_z")
def edt3(i):
    return edt.strict_centre(edt.distance(i.voxels, i.grids))


@query("edt4", """
    SELECT s.case_id, s.label, coalesce(l.level_name, 'unknown') AS level_name, coalesce(l.level_name IN ('C1', 'C2'), false) AS is_atlas_axis, smooth_x, smooth_y, smooth_z, strict_x, strict_y, strict_z,
           smooth_x * sx AS smooth_x_mm, smooth_y * sy AS smooth_y_mm, smooth_z * sz AS smooth_z_mm, strict_x * sx AS strict_x_mm, strict_y * sy AS strict_y_mm, strict_z * sz AS strict_z_mm, greatest(0, coalesce(e1.edt, 0) - 0.5) AS depth_smooth, greatest(0, coalesce(e2.edt, 0) - 0.5) AS depth_strict
    FROM o_smooth s JOIN o_strict t USING (case_id, label) JOIN v_grids USING (case_id) LEFT JOIN o_levels l USING (label)
    LEFT JOIN o_edt e1 ON e1.case_id = s.case_id AND e1.label = s.label AND e1.x = round_even(smooth_x, 0) AND e1.y = round_even(smooth_y, 0) AND e1.z = round_even(smooth_z, 0)
    LEFT JOIN o_edt e2 ON e2.case_id = s.case_id AND e2.label = s.label AND e2.x = strict_x AND e2.y = strict_y AND e2.z = strict_z""",
       "smooth_x smooth_y smooth_z strict_x strict_y strict_z smooth_x_mm smooth_y_mm smooth_z_mm strict_x_mm strict_y_mm strict_z_mm depth_smooth depth_strict")
def edt4(i):
    return edt.centres(i.voxels, i.grids, levels(i.spark))


# --- label edits ---------------------------------------------------------------------------

def per_case(i, *columns):
    return i.grids.select("case_id", *columns)


@query("lbl1", """SELECT case_id, x, y, z, CASE label WHEN 21 THEN 22 WHEN 22 THEN 21 WHEN 24 THEN 28 ELSE label END AS label FROM v_voxels WHERE label <> 23""")
def lbl1(i):
    table = F.create_map(*[F.lit(v) for v in (21, 22, 22, 21, 24, 28, 23, 0)])
    mapping = per_case(i, F.explode(table).alias("label", "new_label"))
    return edits.remap(i.voxels, mapping)


@query("lbl2", """
    WITH m AS (SELECT case_id, x + 2 AS x, y + 3 AS y, z + 4 AS z, label FROM v_voxels WHERE label = 22 AND x + 2 < 16 AND y + 3 < 16 AND z + 4 < 40)
    SELECT case_id, x, y, z, label FROM v_voxels v WHERE label <> 22 AND NOT EXISTS (SELECT 1 FROM m WHERE m.case_id = v.case_id AND m.x = v.x AND m.y = v.y AND m.z = v.z)
    UNION ALL SELECT * FROM m""")
def lbl2(i):
    moves = per_case(i, F.lit(22).alias("label"), F.lit(2).alias("dx"), F.lit(3).alias("dy"), F.lit(4).alias("dz"))
    return edits.shift(i.voxels, moves, i.grids)


@query("lbl3", """
    WITH b AS (SELECT case_id, label, stacking_axis, CASE stacking_axis WHEN 'y' THEN y_min ELSE z_min END AS lo, CASE stacking_axis WHEN 'y' THEN y_max ELSE z_max END AS hi FROM o_feat WHERE label = 22),
    p AS (SELECT *, lo + greatest(1, least(hi - lo - 1, round_even((hi - lo) / 3.0, 0))) AS p1, lo + greatest(1, least(hi - lo - 1, round_even((hi - lo) * 2 / 3.0, 0))) AS p2 FROM b)
    SELECT v.case_id, x, y, z, v.label FROM v_voxels v LEFT JOIN p ON p.case_id = v.case_id AND p.label = v.label
    WHERE NOT coalesce(CASE stacking_axis WHEN 'y' THEN y ELSE z END IN (p1, p2), false)""")
def lbl3(i):
    return edits.cut(i.voxels, per_case(i, F.lit(22).alias("label")), i.grids, 3)


@query("lbl4", """
    WITH cells AS (SELECT case_id, x, y, z, 24 AS label FROM v_grids CROSS JOIN (SELECT unnest(range(0, 3)) AS x) a CROSS JOIN (SELECT unnest(range(12, 15)) AS y) b CROSS JOIN (SELECT unnest(range(4, 7)) AS z) c)
    SELECT case_id, x, y, z, label FROM v_voxels
    UNION ALL SELECT case_id, x, y, z, label FROM cells c WHERE NOT EXISTS (SELECT 1 FROM v_voxels v WHERE v.case_id = c.case_id AND v.x = c.x AND v.y = c.y AND v.z = c.z)""")
def lbl4(i):
    box = dict(x0=0, y0=12, z0=4, bx=3, by=3, bz=3)
    return edits.add_blocks(i.voxels, per_case(i, F.lit(24).alias("label"), *[F.lit(v).alias(k) for k, v in box.items()]))
