"""Queries over reference deltas, rules, verdicts, evaluation, reports and the stream."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from instqc.config import DEFAULT_CONFIG, merge_config, rule_params
from instqc.operators import components, metrics, overlap, reference, rules, sequence, verdict
from instqc.operators.delta import label_deltas
from instqc.operators.intensity import label_intensity
from instqc.operators.inventory import inventory
from instqc.plans import compare, evaluate
from instqc.plans.calibrate import DEFAULT_AXES, calibrate, case_maxima
from instqc.plans.judge import build_tables, judge
from instqc.plans.reference import build_reference
from instqc.schemas import levels
from instqc.session import cut_lineage, scratch_path
from instqc.sources import artifacts
from instqc.streaming.gate import start_gate
from suite.queries_features import (
    PCT_NAMES, PCTS, SUMMARY, features, flat_reference, geometry_deltas, parts, reference_of,
)
from suite.registry import query

LISTED = "array_to_string(labels, ',') AS labels"


def finding_rows(df: DataFrame, reason: bool = True) -> DataFrame:
    return df.select("case_id", "rule_id", "severity", F.array_sort("labels").alias("labels"), *(["reason"] if reason else []))


def rule_sql(rule: str, suffix: str = "") -> str:
    return f"SELECT case_id, rule_id, severity, {LISTED}, reason FROM f_{rule}{suffix}"


def one_rule(name: str, tables: rules.Tables) -> DataFrame:
    return finding_rows(rules.RULES[name](tables, rule_params(DEFAULT_CONFIG, name)))


def tables_of(i, source=None):
    return build_tables(cut_lineage(i.voxels if source is None else source), i.grids, merge_config())


# --- reference deltas -----------------------------------------------------------

DELTA = "SELECT case_id, label, level_name, feature, value, z, robust_z, pct_rank, out_of_range FROM o_{}"
DELTA_DOUBLES = "value z robust_z pct_rank"


@query("dlt1", DELTA.format("geo"), DELTA_DOUBLES)
def dlt1(i):
    return geometry_deltas(i).drop("stratum")


@query("dlt2", DELTA.format("int"), DELTA_DOUBLES)
def dlt2(i):
    return geometry_deltas(i, "intensity").drop("stratum")


@query("dlt3", DELTA.format("morph"), DELTA_DOUBLES)
def dlt3(i):
    return geometry_deltas(i, "morphology").drop("stratum")


def rolled(i, deltas=None):
    ref = cut_lineage(reference_of(i))
    return label_deltas(i.wide, geometry_deltas(i) if deltas is None else deltas, ref)


@query("dlt4", "SELECT w.case_id, w.label, w.level_name, true AS available, r.distance AS distribution_distance, coalesce(r.oor, '') AS out_of_range_features FROM o_known w LEFT JOIN o_roll r USING (case_id, label)", "distribution_distance")
def dlt4(i):
    return rolled(i).drop("stratum")


@query("jn5", "SELECT w.case_id, w.label, w.level_name <> 'L3' AS available FROM o_known w")
def jn5(i):
    ref = cut_lineage(reference_of(i).filter("level_name <> 'L3'"))
    from instqc.operators.delta import feature_deltas

    deltas = feature_deltas(reference.feature_long(i.wide), ref)
    return label_deltas(i.wide, deltas, ref).select("case_id", "label", "available")


@query("agg13", "SELECT case_id, label, distance FROM o_rollint", "distance")
def agg13(i):
    deltas = geometry_deltas(i, "intensity")
    return deltas.groupBy("case_id", "label").agg(F.sqrt(F.avg(F.col("robust_z") * F.col("robust_z"))).alias("distance"))


@query("snk1", f"SELECT level_name, 'all' AS stratum, feature, count(*) AS n, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS std, min(value) AS min, max(value) AS max, {PCTS} FROM o_long GROUP BY level_name, feature", "mean std min max " + PCT_NAMES)
def snk1(i):
    path = scratch_path(i.spark, "reference")
    obs = reference.with_stratum(reference.observations(i.wide))
    artifacts.write_reference(reference.aggregate_reference(obs), reference.reference_meta(obs, source="suite"), path)
    stats, _ = artifacts.read_reference(i.spark, path)
    return flat_reference(stats)


@query("src8", "SELECT '1.2' AS schema_version, count(DISTINCT case_id) AS subject_count, (SELECT count(*) FROM o_ref) AS cells FROM o_long")
def src8(i):
    path = scratch_path(i.spark, "reference")
    obs = reference.with_stratum(reference.observations(i.wide))
    artifacts.write_reference(reference.aggregate_reference(obs), reference.reference_meta(obs), path)
    stats, meta = artifacts.read_reference(i.spark, path)
    nested = artifacts.reference_document(stats).select(F.explode("strata").alias("s", "features")).agg(
        F.sum(F.size("features")).alias("cells"))
    return meta.select("schema_version", "subject_count", F.lit(1).alias("k")).join(
        nested.withColumn("k", F.lit(1)), "k").drop("k")


# --- rules ------------------------------------------------------------------------

@query("rul1", rule_sql("border"))
def rul1(i):
    return one_rule("border", rules.Tables(cut_lineage(features(i)), levels(i.spark)))


@query("rul2", rule_sql("bounds"))
def rul2(i):
    return one_rule("bounds", rules.Tables(features(i), levels(i.spark)))


@query("rul3", """
    SELECT case_id, rule_id, severity, '' AS labels, reason FROM f_coverage
    UNION ALL
    SELECT s.case_id, 'coverage', 1, '', 'Incomplete coverage (span): expected level(s) ' || string_agg(l.level_name, ', ' ORDER BY l.rank) || ' absent beyond the present span.'
    FROM o_span s JOIN o_levels l ON l.level_name IN ('T12', 'T13', 'L6', 'S1')
    WHERE (l.rank = superior_rank - 1 AND NOT superior_truncated) OR (l.rank = inferior_rank + 1 AND NOT inferior_truncated) GROUP BY s.case_id
    UNION ALL
    SELECT case_id, 'coverage', 1, '', 'Below expected count: present count ' || count(rank) || ' is below expected minimum 5.' FROM o_feat GROUP BY case_id HAVING count(rank) < 5""")
def rul3(i):
    params = {**rule_params(DEFAULT_CONFIG, "coverage"), "expected_levels": ["S1", "T12", "L6", "T13"], "expected_count": 5}
    return finding_rows(rules.coverage(rules.Tables(cut_lineage(features(i)), levels(i.spark)), params))


@query("rul4", rule_sql("fragmentation"))
def rul4(i):
    return one_rule("fragmentation", rules.Tables(cut_lineage(features(i)), levels(i.spark), components=parts(i)))


@query("rul5", f"SELECT case_id, rule_id, severity, {LISTED}, kind FROM f_intensity")
def rul5(i):
    found = rules.intensity(
        rules.Tables(None, levels(i.spark), intensity=label_intensity(i.voxels, i.scan)), rule_params(DEFAULT_CONFIG, "intensity"))
    kind = F.element_at(F.array(F.lit("low"), F.lit("high"), F.lit("flat")), F.col("k2") + 1)
    return finding_rows(found.withColumn("reason", kind)).withColumnRenamed("reason", "kind")


def delta_rule_sql(rule: str, rows: str, roll: str) -> str:
    return f"""
        SELECT case_id, '{rule}' AS rule_id, 1 AS severity, CAST(label AS VARCHAR) AS labels, 0 AS k2, '' AS k3 FROM {roll} WHERE distance >= 3
        UNION ALL SELECT case_id, '{rule}', 1, CAST(label AS VARCHAR), 1, feature FROM {rows} WHERE out_of_range
        UNION ALL SELECT case_id, '{rule}', 1, CAST(label AS VARCHAR), 2, feature FROM {rows} WHERE abs(robust_z) >= 3.5"""


def delta_rule(i, name, family):
    ref = cut_lineage(reference_of(i))
    deltas = geometry_deltas(i, family)
    by_label = label_deltas(i.wide, deltas, ref)
    tables = rules.Tables(i.wide, levels(i.spark), deltas=deltas, label_deltas=by_label,
                          intensity_deltas=deltas, intensity_label_deltas=by_label)
    found = rules.RULES[name](tables, rule_params(DEFAULT_CONFIG, name))
    return found.select("case_id", "rule_id", "severity", "labels", "k2", "k3")


@query("rul6", delta_rule_sql("intensity_reference_delta", "o_int", "o_rollint"))
def rul6(i):
    return delta_rule(i, "intensity_reference_delta", "intensity")


def voxel_reference(i, edges=None, **made):
    """A reference made from voxels and scans, written and read again."""
    i.written("v_voxels")
    return build_reference(
        i.voxels, i.grids, scratch_path(i.spark, "reference"), source="suite", build_date="2026-01-01", scans=i.scan, edges=edges, **made)


#: Percentiles of percentiles end in a five often; the offset keeps both sides from rounding it apart.
NUDGE = 1e-8
SHIFTED = ", ".join(f"p{p} + {NUDGE} AS p{p}" for p in reference.PERCENTILES)


@query("agg12_voxels", f"""SELECT * REPLACE ({SHIFTED}, mean + {NUDGE} AS mean, std + {NUDGE} AS std, min + {NUDGE} AS min, max + {NUDGE} AS max) FROM (
    SELECT level_name, stratum, feature, count(*) AS n, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS std, min(value) AS min, max(value) AS max, {PCTS},
    (SELECT count(DISTINCT case_id) FROM o_vstrat) AS subject_count, 'suite' AS source FROM o_vstrat GROUP BY level_name, stratum, feature) q""", "mean std min max " + PCT_NAMES)
def agg12_voxels(i):
    stats, meta = voxel_reference(i, (500.0, 900.0))
    row = meta.select("subject_count", "source", F.lit(1).alias("k"))
    # The ratio of eigenvalues is compared by other queries.
    flat = flat_reference(stats.filter("feature <> 'eigenvalue_ratio'"))
    shifted = {c: F.col(c) + NUDGE for c in ("mean", "std", "min", "max", *PCT_NAMES.split())}
    return flat.withColumns(shifted).withColumn("k", F.lit(1)).join(row, "k").drop("k")


def judged_by_voxels(i):
    i.written("v_cases", "v_voxels", "v_scan")
    # The cohort is its own reference, so both take the same component and intensity tables.
    made = {"parts": cut_lineage(components.summary(components.components(i.voxels), i.grids, merge_config()["min_fragment_voxels"])), "bright": cut_lineage(label_intensity(i.voxels, i.scan))}
    stats, _ = voxel_reference(i, **made)
    return judge(i.voxels, i.grids, scans=i.scan, reference=stats, **made)


@query("rul9_voxels", delta_rule_sql("reference_delta", "o_vgeo", "o_vroll") + " UNION ALL " + delta_rule_sql("intensity_reference_delta", "o_vint", "o_vrollint"))
def rul9_voxels(i):
    found = judged_by_voxels(i).findings
    return found.filter(F.col("rule_id").isin("reference_delta", "intensity_reference_delta")).select("case_id", "rule_id", "severity", "labels", "k2", "k3")


@query("snk4_voxels", """
    SELECT f.case_id, f.label, i.median, i.entropy, r.distance AS distribution_distance, coalesce(r.oor, '') AS out_of_range_features
    FROM o_feat f LEFT JOIN o_intensity i USING (case_id, label) LEFT JOIN o_vroll r USING (case_id, label) WHERE f.rank IS NOT NULL""",
       "median entropy distribution_distance")
def snk4_voxels(i):
    result = judged_by_voxels(i)
    reports = artifacts.case_reports(
        result.verdicts, result.findings, images=artifacts.image_document(result.tables.intensity),
        deltas=artifacts.delta_document(result.tables.deltas, result.tables.label_deltas))
    path = scratch_path(i.spark, "reports")
    artifacts.write_reports(reports, path)
    schema = ("case_id string, image_features struct<per_label:map<string,struct<first_order:struct<median:double,entropy:double>>>>, "
              "reference_delta struct<per_label:map<string,struct<label:int,level_name:string,distribution_distance:double,out_of_range_features:array<string>>>>")
    rows = i.spark.read.schema(schema).json(path).select("case_id", "image_features", F.explode("reference_delta.per_label").alias("key", "d"))
    first = F.element_at("image_features.per_label", F.col("key"))["first_order"]
    return rows.filter("d.level_name <> 'unknown'").select(
        "case_id", "d.label", first["median"].alias("median"), first["entropy"].alias("entropy"), "d.distribution_distance",
        F.coalesce(F.array_sort("d.out_of_range_features"), F.array().cast("array<string>")).alias("out_of_range_features"))


@query("rul7", rule_sql("mislabel"))
def rul7(i):
    return one_rule("mislabel", rules.Tables(cut_lineage(features(i)), levels(i.spark)))


@query("rul8", rule_sql("overlap", "M"))
def rul8(i):
    lv = levels(i.spark)
    return one_rule("overlap", rules.Tables(None, lv, overlaps=overlap.label_overlaps(i.multi, lv)))


@query("rul9", delta_rule_sql("reference_delta", "o_geo", "o_roll"))
def rul9(i):
    return delta_rule(i, "reference_delta", "geometry")


@query("rul10", rule_sql("sequence"))
def rul10(i):
    return one_rule("sequence", rules.Tables(features(i), levels(i.spark)))


@query("rul11", f"SELECT case_id, rule_id, severity, {LISTED}, reason FROM o_findings")
def rul11(i):
    return finding_rows(rules.run_rules(tables_of(i), merge_config()))


@query("rul12", "SELECT DISTINCT rule_id, reason FROM o_findingsM")
def rul12(i):
    return rules.run_rules(tables_of(i, i.multi), merge_config()).select("rule_id", "reason").distinct()


@query("uxt1", "SELECT case_id, 'compactness' AS rule_id, 1 AS severity, CAST(label AS VARCHAR) AS labels, 'Sparse label: label ' || label || ' fills less than 0.42 of its box.' AS reason FROM o_feat WHERE voxel_count / CAST((x_max - x_min + 1) * (y_max - y_min + 1) * (z_max - z_min + 1) AS DOUBLE) < 0.42")
def uxt1(i):
    def compactness(tables, params):
        box = reduce(lambda a, b: a * b, [F.col(f"{a}_max") - F.col(f"{a}_min") + 1 for a in "xyz"])
        sparse = tables.features.filter(F.col("voxel_count") / box < params["least"])
        return rules.findings(sparse, "compactness", params,
                              f"Sparse label: label {{label}} fills less than {params['least']} of its box.")

    config = merge_config({"rules": {"compactness": {"params": {"least": 0.42}}}})
    return finding_rows(rules.run_rules(rules.Tables(features(i), levels(i.spark)), config, {"compactness": compactness}))


# --- verdicts -----------------------------------------------------------------------

@query("agg14", f"""
    WITH r AS (SELECT case_id, CASE WHEN len(labels) > 0 THEN unnest(labels) END AS label, reason FROM o_findingsM WHERE len(labels) > 0
               UNION ALL SELECT case_id, NULL, reason FROM o_findingsM WHERE len(labels) = 0)
    SELECT case_id, label, count(*) AS n, string_agg(reason, '|' ORDER BY reason) AS reasons FROM r GROUP BY case_id, label""")
def agg14(i):
    found = rules.run_rules(tables_of(i, i.multi), merge_config())
    grouped = verdict.reasons_by_label(found)
    texts = F.array_sort(F.transform("reasons", lambda r: r["message"]))
    return grouped.select("case_id", "label", F.size("reasons").cast("long").alias("n"), F.array_join(texts, "|").alias("reasons"))


ESCALATED = """SELECT v.case_id, CASE WHEN g.n IS NULL THEN 2 WHEN n_flag >= 12 THEN 2 ELSE overall END AS overall,
        CASE WHEN g.n IS NULL OR n_flag >= 12 THEN 'fail' WHEN overall = 1 THEN 'flagged-for-review' ELSE 'pass' END AS verdict, n_flag, n_findings
    FROM o_verdict v LEFT JOIN (SELECT case_id, count(*) AS n FROM o_sums GROUP BY case_id) g USING (case_id)"""


@query("agg15", ESCALATED)
def agg15(i):
    result = judge(cut_lineage(i.voxels), i.grids, {"verdict": {"flag_escalation_count": 12}})
    return result.verdicts.select("case_id", "overall", "verdict", "n_flag", "n_findings")


@query("snk10", f"""
    WITH a AS (SELECT case_id FROM v_grids g JOIN v_scan_grids s USING (case_id) WHERE g.nx = s.nx AND abs(s.sx - g.sx) <= 0.0001 + 0.00001 * g.sx)
    SELECT e.case_id, CASE WHEN a.case_id IS NULL THEN 'error' ELSE e.verdict END AS result FROM ({ESCALATED}) e LEFT JOIN a USING (case_id)""")
def snk10(i):
    result = judge(cut_lineage(i.voxels), i.grids, {"verdict": {"flag_escalation_count": 12}}, scan_grids=i.scan_grids)
    return result.verdicts.select("case_id", F.col("verdict").alias("result")).unionByName(
        result.errors.select("case_id", F.lit("error").alias("result")))


# --- evaluation -----------------------------------------------------------------------

def evaluated(i):
    i.written("v_cases", "v_voxels", "v_cand")
    cases = i.grids.select("case_id")
    return evaluate.evaluate(i.voxels, i.candidate, i.grids, i.expected, candidate_cases=cases)


# The subject of a case is its candidate map; cases without one have no voxels here.
OUTCOME = "o_outcomeC"
OUTCOME_COLUMNS = "case_id, expected_verdict, outcome, expected_failure, actual_flagged, caught, failure_mode, failure_mode_name, fired_rule_ids, designated_rule_fired, caught_by_designated_rule"


@query("agg16", "SELECT * FROM o_casedice", "mean_dice mean_jaccard volume_weighted_dice")
def agg16(i):
    return overlap.case_dice(overlap.dice(i.candidate, i.voxels, i.grids, levels(i.spark)))


@query("agg17", "SELECT case_id, avg(divergence_score) AS case_divergence, avg(centroid_distance_mm) AS mean_centroid_distance_mm, count(*) FILTER (matched) AS n_matched, count(*) FILTER (NOT matched) AS n_unmatched FROM o_score GROUP BY case_id", "case_divergence mean_centroid_distance_mm")
def agg17(i):
    from suite.queries_features import both_features

    return evaluate.case_match(evaluate.feature_match(*both_features(i)))


def outcomes_of(i):
    tables = tables_of(i, i.candidate)
    found = cut_lineage(rules.run_rules(tables, merge_config()))
    verdicts = verdict.verdicts(i.grids, found, merge_config())
    return metrics.outcomes(verdicts, i.expected, found), found, verdicts


@query("evl1", f"SELECT {OUTCOME_COLUMNS} FROM {OUTCOME}")
def evl1(i):
    return outcomes_of(i)[0].drop("actual_verdict")


@query("jn8", f"SELECT case_id, designated_rule_fired, caught_by_designated_rule FROM {OUTCOME}")
def jn8(i):
    return outcomes_of(i)[0].select("case_id", "designated_rule_fired", "caught_by_designated_rule")


@query("set3", f"SELECT o.case_id, array_to_string(list_sort(list_intersect(string_split(fired_rule_ids, ','), e.rules)), ',') AS shared FROM {OUTCOME} o JOIN o_expected e USING (case_id)")
def set3(i):
    fired = outcomes_of(i)[0].select("case_id", "fired_rule_ids")
    return fired.join(i.expected, "case_id").select(
        "case_id", F.array_sort(F.array_intersect("fired_rule_ids", "expected_rule_ids")).alias("shared"))


@query("agg18", f"""SELECT *, CAST(fp AS DOUBLE) / nullif(fp + tn, 0) AS false_positive_rate, CAST(tp AS DOUBLE) / nullif(tp + fn, 0) AS sensitivity, CAST(tn AS DOUBLE) / nullif(tn + fp, 0) AS specificity FROM (
    SELECT count(*) FILTER (outcome = 'TP') AS tp, count(*) FILTER (outcome = 'FP') AS fp, count(*) FILTER (outcome = 'TN') AS tn, count(*) FILTER (outcome = 'FN') AS fn, count(*) AS n_cases FROM {OUTCOME}) q""",
       "false_positive_rate sensitivity specificity")
def agg18(i):
    return metrics.confusion(outcomes_of(i)[0])


@query("agg19", f"""
    SELECT m.mode AS failure_mode, CASE WHEN m.mode = 8 THEN 'overlap' ELSE o.failure_mode_name END AS failure_mode_name, coalesce(n, 0) AS n_cases, coalesce(c, 0) AS n_caught, coalesce(d, 0) AS n_caught_by_designated_rule,
           CAST(d AS DOUBLE) / n AS sensitivity, CAST(c AS DOUBLE) / n AS caught_rate
    FROM o_mode m LEFT JOIN (SELECT failure_mode, min(failure_mode_name) AS failure_mode_name, count(*) AS n, count(*) FILTER (caught) AS c, count(*) FILTER (caught_by_designated_rule) AS d FROM {OUTCOME} WHERE expected_failure GROUP BY failure_mode) o ON o.failure_mode = m.mode""",
       "sensitivity caught_rate")
def agg19(i):
    asked = {m: None for m in range(1, 8)} | {8: "overlap"}
    return metrics.per_mode(outcomes_of(i)[0], asked)


@query("agg20", """
    WITH b AS (SELECT CAST(l_linenumber AS DOUBLE) AS x, CAST(l_quantity > 30 AS INT) AS y FROM lineitem),
    r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM b)
    SELECT 'pearson' AS method, corr(x, y) AS coefficient, count(*) AS n FROM b UNION ALL SELECT 'spearman', corr(rx, ry), count(*) FROM r
    UNION ALL SELECT 'pearson', NULL, count(*) FROM b""", "coefficient")
def agg20(i):
    pairs = i.frame("lineitem").select(
        F.col("l_linenumber").alias("x"), (F.col("l_quantity") > 30).cast("int").alias("y"), F.lit(1).alias("same"))
    return reduce(DataFrame.unionByName, [
        metrics.correlation(pairs, "x", "y"), metrics.correlation(pairs, "x", "y", "spearman"), metrics.correlation(pairs, "x", "same")])


def voxel_modes(i):
    return evaluate.voxel_modes(overlap.voxel_agreement(i.candidate, i.voxels))


def record_modes(i):
    tables = tables_of(i, i.candidate)
    return evaluate.record_modes(i.grids, tables.features, tables.components, tables.overlaps)


for name, column, rows in (("evl4", "m1", "o_vmodes"), ("evl7", "m4", "o_vmodes")):
    query(name, f"SELECT case_id, {column} AS value FROM {rows}", "value")(
        lambda i, column=column: voxel_modes(i).select("case_id", F.col(column).alias("value")))


@query("evl8", "SELECT v.case_id, coalesce(l.lost, 0) AS value FROM o_vmodes v LEFT JOIN o_lost l USING (case_id)", "value")
def evl8(i):
    return voxel_modes(i).select("case_id", F.col("m5").alias("value"))


for name, column in (("evl5", "m2"), ("evl6", "m3"), ("evl9", "m6"), ("evl10", "m7"), ("evl11", "m8")):
    query(name, f"SELECT case_id, {column} AS value FROM o_rmodesC", "value")(
        lambda i, column=column: record_modes(i).select("case_id", F.col(column).alias("value")))


@query("evl12", """SELECT m.case_id, mode, mode_name, metric, direction, baseline, value, detail, mean_dice, volume_weighted_dice, mean_jaccard,
        coalesce(n_matched, 0) AS n_matched, coalesce(n_unmatched, 0) AS n_unmatched
    FROM o_modes m LEFT JOIN (SELECT d.* FROM o_casedice d JOIN v_grids USING (case_id) WHERE cn % 7 <> 3) d USING (case_id)""",
       "baseline value mean_dice volume_weighted_dice mean_jaccard")
def evl12(i):
    i.written("v_cases", "v_voxels", "v_cand")
    # Every seventh case has no candidate; of the others some have an empty one, or two empty maps.
    listed = i.frame("v_grids").filter("cn % 7 <> 3").select("case_id")
    both = lambda voxels: voxels.join(listed, "case_id", "left_semi")
    joint = cut_lineage(overlap.joint_counts(both(i.candidate), both(i.voxels)))
    counts = overlap.label_counts(joint)
    # A table of overlaps made before is taken if it fits.
    given = evaluate.checked_overlap(overlap.dice(both(i.candidate), both(i.voxels), i.grids, levels(i.spark)), counts)
    by_voxel = evaluate.voxel_modes(overlap.agreement_counts(joint), listed)
    return evaluate.mode_metrics(by_voxel, record_modes(i), overlap.case_dice(given))


@query("evl2", f"""SELECT o.case_id, o.outcome, o.caught_by_designated_rule, d.mean_dice, d.mean_jaccard, d.volume_weighted_dice, s.case_divergence, s.mean_centroid_distance_mm
    FROM {OUTCOME} o LEFT JOIN o_casedice d USING (case_id)
    LEFT JOIN (SELECT case_id, avg(divergence_score) AS case_divergence, avg(centroid_distance_mm) AS mean_centroid_distance_mm FROM o_score GROUP BY case_id) s USING (case_id)""",
       "mean_dice mean_jaccard volume_weighted_dice case_divergence mean_centroid_distance_mm")
def evl2(i):
    return evaluated(i).cases.select(
        "case_id", "outcome", "caught_by_designated_rule", "mean_dice", "mean_jaccard", "volume_weighted_dice",
        "case_divergence", "mean_centroid_distance_mm")


@query("evl3", f"""SELECT outcome, count(*) AS n, count(*) FILTER (caught_by_designated_rule) AS caught, avg(d.mean_dice) AS mean_dice FROM {OUTCOME} o LEFT JOIN o_casedice d USING (case_id) GROUP BY outcome""", "mean_dice")
def evl3(i):
    return evaluated(i).cases.groupBy("outcome").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("caught_by_designated_rule").alias("caught"), F.avg("mean_dice").alias("mean_dice"))


@query("evl15", """
    WITH h AS (SELECT f.case_id, list_sort(list_distinct(flatten(list(f.labels)))) AS named FROM o_findingsC f JOIN o_expected e USING (case_id) WHERE list_contains(e.rules, f.rule_id) GROUP BY f.case_id)
    SELECT e.case_id, CASE v.overall WHEN 0 THEN 'pass' ELSE 'flagged-for-review' END = e.expected_verdict AS verdict_ok, h.case_id IS NOT NULL AS designated_fired,
           coalesce(h.named, CAST([] AS INT[])) = e.wanted AS labels_ok,
           CASE v.overall WHEN 0 THEN 'pass' ELSE 'flagged-for-review' END = e.expected_verdict AND h.case_id IS NOT NULL AND coalesce(h.named, CAST([] AS INT[])) = e.wanted AS passed
    FROM o_expected e JOIN o_verdictC v USING (case_id) LEFT JOIN h USING (case_id)""")
def evl15(i):
    _, found, verdicts = outcomes_of(i)
    return evaluate.regression_check(found, verdicts, i.expected)


@query("evl16", """
    WITH a AS (SELECT case_id || '/' || label AS key, 'voxels' AS path, CAST(voxel_count AS DOUBLE) AS v FROM o_sums), b AS (SELECT case_id || '/' || label AS key, 'voxels' AS path, CAST(voxel_count AS DOUBLE) AS v FROM o_sumsC)
    SELECT key, path, a.v AS number_a, b.v AS number_b FROM a FULL JOIN b USING (key, path) WHERE a.v IS NULL OR b.v IS NULL OR a.v <> b.v""", "number_a number_b")
def evl16(i):
    def long(df):
        return inventory(df).select(
            F.concat_ws("/", "case_id", F.col("label").cast("string")).alias("key"), F.lit("voxels").alias("path"),
            F.col("voxel_count").cast("double").alias("number"), F.lit(None).cast("string").alias("text"))

    return evaluate.compare_values(long(i.voxels), long(i.candidate)).select("key", "path", "number_a", "number_b")


# --- calibration, runs, ladders ----------------------------------------------------------

def calibration_cases(i):
    wide = i.wide
    number = F.substring("case_id", 2, 20).cast("long")
    failing = number % 3 == 0
    mode = F.when(failing, number % 2 + 1).cast("int")
    expected = wide.select("case_id").distinct().select(
        "case_id", F.when(failing, "flagged-for-review").otherwise("pass").alias("expected_verdict"),
        F.when(mode == 1, F.array(F.lit("reference_delta"))).when(mode == 2, F.array(F.lit("bounds"))).otherwise(F.array().cast("array<string>")).alias("expected_rule_ids"),
        F.array().cast("array<int>").alias("expected_labels"), mode.alias("failure_mode"))
    none = i.spark.createDataFrame([], "case_id string, rule_id string, severity int, labels array<int>")
    volumes = wide.withColumn("physical_volume_mm3", F.col("physical_volume_mm3") * 25)
    deltas = geometry_deltas(i)
    return case_maxima(expected, none, deltas, rolled(i, deltas), volumes)


NAMES = [a.name.replace(".", "_") for a in DEFAULT_AXES]
TRIAL = f"grid_id, CAST(t1 AS DOUBLE) AS {NAMES[0]}, CAST(t2 AS DOUBLE) AS {NAMES[1]}, CAST(t3 AS DOUBLE) AS {NAMES[2]}, tp, fp, tn, fn, false_positive_rate, sensitivity"


@query("jn10", f"SELECT {TRIAL} FROM o_trial", "false_positive_rate sensitivity " + " ".join(NAMES))
def jn10(i):
    return calibrate(calibration_cases(i), sensitivity_floor=0.5).drop("feasible", "best")


@query("evl13", f"""SELECT {TRIAL}, feasible, feasible AND row_number() OVER (PARTITION BY feasible ORDER BY false_positive_rate ASC NULLS FIRST, -coalesce(sensitivity, 0), grid_id) = 1 AS best FROM o_trial""",
       "false_positive_rate sensitivity " + " ".join(NAMES))
def evl13(i):
    return calibrate(calibration_cases(i), sensitivity_floor=0.5)


def both_runs(i, detection=None):
    summary = compare.run_summary(i.frame("v_modes"), detection)
    return summary.filter("run_id = 'a'"), summary.filter("run_id = 'b'")


@query("agg21", "SELECT run_id, mode, metric, n_cases, n_with_value, mean, minimum, maximum, total FROM o_run", "mean minimum maximum total")
def agg21(i):
    return compare.run_summary(i.frame("v_modes")).select(
        "run_id", "mode", "metric", "n_cases", "n_with_value", "mean", "minimum", "maximum", "total")


COMPARE_DOUBLES = "value_a value_b delta scale normalised_delta"


@query("evl14", "SELECT * FROM o_compare", COMPARE_DOUBLES)
def evl14(i):
    return compare.compare_runs(*both_runs(i)).select("mode", "mode_name", "metric", "value_a", "value_b", "delta", "scale", "normalised_delta", "worsened")


@query("agg22", """SELECT max(mode) FILTER (attributed) AS attributed_mode, max(mode_name) FILTER (attributed) AS attributed_mode_name, max(metric) FILTER (attributed) AS attributed_metric_name,
    array_to_string(list_sort(list(mode) FILTER (delta IS NOT NULL AND normalised_delta IS NULL)), ',') AS excluded_modes, CAST(NULL AS VARCHAR) AS unattributable_reason FROM o_attr""")
def agg22(i):
    return compare.attribution(compare.compare_runs(*both_runs(i)))


@query("srt3", "SELECT mode, mode_name, normalised_delta FROM o_attr WHERE attributed", "normalised_delta")
def srt3(i):
    return compare.compare_runs(*both_runs(i)).filter("attributed").select("mode", "mode_name", "normalised_delta")


@query("jn9", "SELECT c.mode, c.delta, c.worsened, CAST(0 AS BIGINT) AS unshared FROM o_compare c", "delta")
def jn9(i):
    modes = i.frame("v_modes")
    odd = compare.unshared_cases(modes.filter("run_id = 'a'"), modes.filter("run_id = 'b'")).agg(F.count(F.lit(1)).alias("unshared"))
    sides = [modes.filter(F.col("run_id") == r) for r in ("a", "b")]
    rows = compare.compare_runs(*both_runs(i), *sides).select("mode", "delta", "worsened", F.lit(1).alias("k"))
    return rows.join(odd.withColumn("k", F.lit(1)), "k").drop("k")


@query("set2", """SELECT case_id FROM (SELECT DISTINCT case_id FROM o_sums) WHERE case_id NOT IN (SELECT case_id FROM v_grids WHERE cn % 2 = 1)
    UNION ALL SELECT case_id FROM v_grids WHERE cn % 2 = 1 AND case_id NOT IN (SELECT case_id FROM o_sums)""")
def set2(i):
    return compare.unshared_cases(i.voxels, i.frame("v_grids").filter("cn % 2 = 1"))


@query("set1", "SELECT case_id, label FROM o_sums UNION SELECT case_id, label FROM o_sumsC")
def set1(i):
    return overlap.label_values(i.candidate, i.voxels)


@query("srt1", f"SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY position, label) AS place FROM ({SUMMARY}) s")
def srt1(i):
    from pyspark.sql import Window

    from instqc.operators.inventory import summarise

    order = Window.partitionBy("case_id").orderBy("position", "label")
    return summarise(i.voxels, levels(i.spark)).withColumn("place", F.row_number().over(order))


@query("srt2", """SELECT case_id, label, row_number() OVER (PARTITION BY case_id, label ORDER BY size DESC) AS size_rank, size, size * (sx * sy * sz) AS volume_mm3
    FROM o_comp JOIN v_grids USING (case_id)""", "volume_mm3")
def srt2(i):
    return components.component_rows(components.components(i.voxels), i.grids).drop("component")


@query("win11", """
    WITH own AS (SELECT *, lead(value) OVER (PARTITION BY sweep_id, mode ORDER BY rung) AS nxt FROM v_ladder WHERE mode = metric),
    c AS (SELECT sweep_id, mode, count(*) AS n_rungs, bool_and(nxt IS NULL OR CASE WHEN mode = 2 THEN value >= nxt ELSE value <= nxt END) AS monotone,
            bool_and(nxt IS NULL OR abs(nxt - value) > 0.000000001) AND count(*) >= 2 AS strictly_changed FROM own GROUP BY sweep_id, mode),
    f AS (SELECT sweep_id, mode, max(response) AS most FROM o_response WHERE mode <> metric GROUP BY sweep_id, mode),
    h AS (SELECT sweep_id, mode, bool_and(NOT ((mode = 6 AND metric = 1 AND response > 2.79 * 1.05) OR (mode = 8 AND metric = 1 AND response > 0.9629 * 1.05))) AS couplings_held FROM o_response GROUP BY sweep_id, mode),
    m AS (SELECT *, CASE WHEN coalesce(most, 0) = 0 THEN CAST('Infinity' AS DOUBLE) WHEN isinf(most) THEN 0 ELSE 1 / most END AS margin FROM c LEFT JOIN f USING (sweep_id, mode) LEFT JOIN h USING (sweep_id, mode))
    SELECT sweep_id, mode, n_rungs, monotone, strictly_changed, margin, CASE WHEN mode IN (6, 8) THEN 'coupled' ELSE 'strict' END AS status, couplings_held, held AS margin_held, monotone AND strictly_changed AND couplings_held AND held AS passed
    FROM (SELECT *, CASE mode WHEN 3 THEN margin >= 112 * 0.95 WHEN 6 THEN margin >= 0.3585 * 0.95 WHEN 8 THEN margin >= 1.038 * 0.95 ELSE isinf(margin) END AS held FROM m) q""", "margin")
def win11(i):
    return compare.score_ladders(i.frame("v_ladder"))


# --- documents and reports -----------------------------------------------------------------

def documents(i, tables):
    f = tables.features
    return artifacts.feature_document(
        f, tables.components, tables.overlaps, sequence.relationships(f, tables.levels),
        sequence.curve_offsets(f), sequence.curvature(f), sequence.spacing_consistency(f), sequence.progression(f), sequence.neighbourhood(f))


def read_back(i, df, name):
    path = scratch_path(i.spark, name)
    df.write.json(path)
    return i.spark.read.schema(df.schema).json(path)


@query("snk2", """
    SELECT f.case_id, f.label, f.level_name, f.voxel_count, f.physical_volume_mm3, f.cx_mm, g.fragmentation_index, g.component_count, coalesce(p.present, '') AS present_levels, coalesce(o.n, 0) AS n_overlaps,
           CASE WHEN count(*) OVER (PARTITION BY f.case_id) >= 2 THEN '0.2' ELSE '0.1' END AS features_version
    FROM o_featM f JOIN o_fragM g USING (case_id, label)
    LEFT JOIN (SELECT case_id, string_agg(level_name, ',' ORDER BY rank) AS present FROM o_featM WHERE rank IS NOT NULL GROUP BY case_id) p USING (case_id)
    LEFT JOIN (SELECT case_id, count(*) AS n FROM o_overlapM GROUP BY case_id) o USING (case_id)""", "physical_volume_mm3 cx_mm fragmentation_index")
def snk2(i):
    doc = read_back(i, documents(i, tables_of(i, i.multi)), "features")
    return doc.select("case_id", "features_version", "relationships", "overlaps", F.explode("per_label").alias("k", "e")).select(
        "case_id", "e.label", "e.level_name", "e.geometry.voxel_count", "e.geometry.physical_volume_mm3",
        F.element_at("e.centroid.centroid_mm", 1).alias("cx_mm"), "e.components.fragmentation_index", "e.components.component_count",
        F.col("relationships.present_levels").alias("present_levels"), F.size("overlaps").cast("long").alias("n_overlaps"), "features_version")


@query("snk3", """SELECT case_id, label, voxel_count, n_nonfinite_excluded, mean, median, std, lo AS min, hi AS max, p05, p25, p50, p75, p95, hi - lo AS range, p75 - p25 AS iqr, entropy
    FROM o_intensity""", "mean median std min max p05 p25 p50 p75 p95 range iqr entropy")
def snk3(i):
    doc = read_back(i, artifacts.image_document(label_intensity(i.voxels, i.scan)), "image")
    return doc.select("case_id", F.explode("per_label").alias("k", "e")).select(
        "case_id", "e.label", "e.first_order.*")


@query("snk4", """
    SELECT v.case_id, CASE WHEN s.n IS NULL THEN 'fail' WHEN v.overall = 1 THEN 'flagged-for-review' ELSE 'pass' END AS verdict, v.n_findings,
           coalesce(f.reasons, '') AS reasons, coalesce(s.n, 0) AS n_labels, 7 AS seed
    FROM o_verdict v LEFT JOIN (SELECT case_id, count(*) AS n FROM o_sums GROUP BY case_id) s USING (case_id)
    LEFT JOIN (SELECT case_id, string_agg(reason, '|' ORDER BY reason) AS reasons FROM o_findings GROUP BY case_id) f USING (case_id)""")
def snk4(i):
    i.written("v_cases", "v_voxels")
    result = judge(i.voxels, i.grids)
    reports = artifacts.case_reports(
        result.verdicts, result.findings, documents(i, result.tables), manifest=artifacts.run_manifest(segmenter_version="1", seed=7))
    path = scratch_path(i.spark, "reports")
    artifacts.write_reports(reports, path)
    schema = ("case_id string, verdict string, findings array<struct<rule_id:string,reason:string>>, "
              "features struct<per_label:map<string,struct<label:int>>>, run_manifest struct<seed:bigint>")
    text = F.array_join(F.array_sort(F.transform("findings", lambda f: f["reason"])), "|")
    return i.spark.read.schema(schema).json(path).select(
        "case_id", "verdict", F.size("findings").cast("long").alias("n_findings"), text.alias("reasons"),
        F.coalesce(F.size("features.per_label"), F.lit(0)).cast("long").alias("n_labels"), F.col("run_manifest.seed").alias("seed"))


@query("snk8", "SELECT case_id, '2.1' AS segmenter_version, 'abc' AS segmenter_sha, 7 AS seed, 'suite' AS dataset_id, 'true' AS smooth, false AS absent FROM v_grids")
def snk8(i):
    given = artifacts.run_manifest("2.1", "abc", None, 7, "suite", {"smooth": "true"})
    return i.grids.select("case_id", given.alias("m"), artifacts.run_manifest().isNotNull().alias("absent")).select(
        "case_id", "m.segmenter_version", "m.segmenter_sha", "m.seed", "m.dataset_id",
        F.col("m.postproc_toggles")["smooth"].alias("smooth"), "absent")


@query("snk5", f"""
    WITH w AS (SELECT * FROM o_trial WHERE feasible QUALIFY row_number() OVER (ORDER BY false_positive_rate ASC NULLS FIRST, -coalesce(sensitivity, 0), grid_id) = 1),
    r AS (SELECT count(*) FILTER (outcome = 'TP') AS tp, count(*) FILTER (outcome = 'FP') AS fp, count(*) AS n_case_rows, (SELECT count(DISTINCT failure_mode) FROM {OUTCOME} WHERE expected_failure) AS modes,
        'pearson' AS method, CASE WHEN var_pop(CAST(actual_flagged AS INT)) FILTER (d.mean_dice IS NOT NULL) > 0 THEN corr(d.mean_dice, CAST(actual_flagged AS INT)) END AS coefficient FROM {OUTCOME} o LEFT JOIN o_casedice d USING (case_id))
    SELECT r.*, 'suite' AS cohort_id, r.n_case_rows AS cohort_size, CAST(7 AS BIGINT) AS seed, CASE WHEN w.grid_id IS NULL THEN 'no-feasible-setting' ELSE 'ok' END AS status, CAST(0.5 AS DOUBLE) AS floor,
        w.t1 AS best_t1, w.t2 AS best_t2, w.t3 AS best_t3, w.tp AS best_tp, w.sensitivity AS best_sensitivity, m.n_cases AS run_cases, m.mode, m.metric, m.n_with_value, m.mean
    FROM r LEFT JOIN w ON true JOIN o_run m ON m.run_id = 'a'""", "coefficient floor best_t1 best_t2 best_t3 best_sensitivity mean")
def snk5(i):
    run = evaluated(i)
    outcome = cut_lineage(run.outcomes)
    flagged = run.cases.withColumn("flag", F.col("actual_flagged").cast("int"))
    pairs = metrics.correlation(flagged, "mean_dice", "flag")
    scored = calibrate(calibration_cases(i), sensitivity_floor=0.5)
    report = compare.evaluation_report(
        metrics.confusion(outcome), metrics.per_mode(outcome), run.cases, pairs, compare.calibration_block(scored, 0.5),
        origin=compare.provenance("suite", run.cases.count(), "0.1", "2026-01-01"), manifest=artifacts.run_manifest(seed=7, dataset_id="suite"),
        magnitude=compare.magnitude_block(compare.run_summary(i.frame("v_modes").filter("run_id = 'a'"))))
    doc = read_back(i, report, "evaluation")
    best = F.col("calibration.best")
    return doc.select(
        "metrics.tp", "metrics.fp", "n_case_rows", F.size("per_mode").cast("long").alias("modes"),
        F.element_at("correlations.method", 1).alias("method"), F.element_at("correlations.coefficient", 1).alias("coefficient"),
        "provenance.cohort_id", "provenance.cohort_size", "run_manifest.seed", "calibration.status",
        F.col("calibration.objective.sensitivity_floor").alias("floor"),
        *[best["assignment"][a.name.replace(".", "_")].alias(f"best_t{k}") for k, a in enumerate(DEFAULT_AXES, 1)],
        best["metrics"]["tp"].alias("best_tp"), best["metrics"]["sensitivity"].alias("best_sensitivity"),
        F.col("per_mode_magnitude.n_cases").alias("run_cases"), F.inline("per_mode_magnitude.per_mode"),
    ).select("tp", "fp", "n_case_rows", "modes", "method", "coefficient", "cohort_id", "cohort_size", "seed", "status", "floor", "best_t1", "best_t2", "best_t3",
             "best_tp", "best_sensitivity", "run_cases", "mode", "metric", "n_with_value", "mean")


@query("snk6", """SELECT 'a' AS run_a_id, 'b' AS run_b_id, 'first' AS cohort_a, 'second' AS cohort_b, (SELECT max(n_cases) FROM o_run WHERE run_id = 'a') AS size_a, CAST(1 AS BIGINT) AS seed_a,
    'v2' AS segmenter_b, mode, delta, normalised_delta, worsened, (SELECT max(mode) FROM o_attr WHERE attributed) AS attributed_mode FROM o_compare""", "delta normalised_delta")
def snk6(i):
    a, b = both_runs(i)
    a, b = read_back(i, a, "run_a"), read_back(i, b, "run_b")
    rows = cut_lineage(compare.compare_runs(a, b))
    size = lambda run: run.first()["n_cases"]
    report = compare.comparison_report(
        rows, compare.attribution(rows), "a", "b",
        compare.provenance("first", size(a), "0.1", "2026-01-01"), compare.provenance("second", size(b), "0.1", "2026-01-02"),
        artifacts.run_manifest(seed=1), artifacts.run_manifest(segmenter_version="v2"))
    doc = read_back(i, report, "comparison")
    return doc.select(
        "run_a_id", "run_b_id", F.col("run_a.provenance.cohort_id").alias("cohort_a"), F.col("run_b.provenance.cohort_id").alias("cohort_b"),
        F.col("run_a.provenance.cohort_size").alias("size_a"), F.col("run_a.run_manifest.seed").alias("seed_a"),
        F.col("run_b.run_manifest.segmenter_version").alias("segmenter_b"), "attributed_mode", F.inline("per_mode"),
    ).select("run_a_id", "run_b_id", "cohort_a", "cohort_b", "size_a", "seed_a", "segmenter_b", "mode", "delta", "normalised_delta", "worsened", "attributed_mode")


# --- stream -------------------------------------------------------------------------------

#: Rows for which each delivery of the stream is one file more.
DELIVERY = 4_000_000


@query("stm1", """SELECT g.case_id, CASE WHEN k.case_id IS NULL THEN 2 ELSE v.overall END AS overall,
        CASE WHEN k.case_id IS NULL THEN 'fail' WHEN v.overall = 1 THEN 'flagged-for-review' ELSE 'pass' END AS verdict, v.n_flag, v.n_findings
    FROM v_grids g JOIN o_verdict v USING (case_id) LEFT JOIN (SELECT DISTINCT case_id FROM o_sums) k USING (case_id)""")
def stm1(i):
    i.written("v_cases", "v_voxels")
    incoming, manifest, out, marks = (scratch_path(i.spark, n) for n in ("incoming", "manifest", "gate", "marks"))
    # Dealt by position, so that every case lies in several files and comes in several batches.
    # Deliveries are five, and each is more files where there is more to write.
    files = 1 + i.voxels.count() // DELIVERY
    i.voxels.repartition(4 * files, "x", "y", "z").write.parquet(incoming)
    # Some rows stand in further files.
    i.voxels.filter("x % 5 = 0").repartition(files, "case_id").write.mode("append").parquet(incoming)
    counted = i.voxels.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_voxels"))
    i.grids.select("case_id").join(counted, "case_id", "left").fillna(0, ["n_voxels"]).write.parquet(manifest)
    stream = start_gate(i.spark, incoming, manifest, i.grids, out, marks, files_per_batch=2 * files, once=True)
    stream.awaitTermination()
    return i.spark.read.parquet(f"{out}/verdicts").drop("batch_id")
