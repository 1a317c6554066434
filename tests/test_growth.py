"""What larger tables cost: fixed-width steps, and views read once."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from instqc.config import merge_config
from instqc.llm import lines
from instqc.operators import components, edt, overlap
from instqc.operators.intensity import label_intensity
from instqc.plans.judge import build_tables
from instqc.schemas import VOXELS, levels
from instqc.sources import datasets
from instqc.streaming import gate
from suite.views import Inputs

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    text = io.StringIO()
    with redirect_stdout(text):
        df.explain()
    return text.getvalue()


def test_tiles_take_columns_of_bits(spark):
    voxels = spark.createDataFrame([("a", 0, 0, z, 1) for z in (0, 1, 63, 64, 70, 199, 200, 255, 256)] + [("a", 1, 0, 64, 2)], VOXELS)
    text = plan(components.tile_parts(voxels))
    assert "Window" not in text and "FlatMapGroupsInArrow" in text
    got = {(r["label"], r["component"] & ((1 << components.BITS) - 1), r["size"]) for r in components.components(voxels).collect()}
    assert got == {(1, 0, 2), (1, 63, 2), (1, 70, 1), (1, 199, 2), (1, 255, 2), (2, 64, 1)}


def test_crowded_places(spark):
    """Three labels at a place, and rows that are there twice, beside ordinary places."""
    gt = spark.createDataFrame([("a", 0, 0, 0, l) for l in (1, 2, 3, 3)] + [("a", 1, 0, 0, 1)] * 3 + [("b", 0, 0, 0, 5)], VOXELS)
    cand = spark.createDataFrame([("a", 0, 0, 0, l) for l in (2, 4)] + [("a", 1, 0, 0, 1)], VOXELS)
    joint = overlap.joint_counts(cand, gt)
    want = {(r["case_id"], r["gt_label"], r["cand_label"]): r["n"] for r in overlap.voxel_agreement(cand.distinct(), gt.distinct()).collect()}
    assert {(r["case_id"], r["gt_label"], r["cand_label"]): r["n"] for r in overlap.agreement_counts(joint).collect()} == want
    counts = {(r["case_id"], r["label"]): (r["candidate_voxels"], r["gt_voxels"], r["intersection_voxels"]) for r in overlap.label_counts(joint).collect()}
    assert counts == {("a", 1): (1, 2, 1), ("a", 2): (1, 1, 1), ("a", 3): (0, 1, 0), ("a", 4): (1, 0, 0), ("b", 5): (0, 1, 0)}
    pairs = {(r["label_a"], r["label_b"]): r["overlap_voxels"] for r in overlap.label_overlaps(gt, levels(spark)).collect()}
    assert pairs == {(1, 2): 1, (1, 3): 1, (2, 3): 1}


def test_ordinary_places_need_no_sets(spark):
    """One or two labels at a place are told by numbers of fixed width."""
    voxels = spark.createDataFrame([("a", x, 0, 0, l) for x in range(9) for l in (1, 2)], VOXELS)
    assert "collect_set" not in plan(overlap.label_overlaps(voxels, levels(spark)))
    assert "collect_set" not in plan(overlap.joint_counts(voxels, voxels))


def test_places_alike_are_counted_before_they_are_paired(spark, monkeypatch):
    """Labels are paired per kind of place and case: a thousand places alike are one row there."""
    seen = []
    monkeypatch.setattr(overlap, "cut_lineage", lambda df: seen.append(df) or df)
    voxels = spark.createDataFrame([("a", x, 0, 0, 1) for x in range(1000)], VOXELS)
    joint = overlap.joint_counts(voxels, voxels)
    text = plan(seen[0])
    assert "Generate inline" in text and "partial_count(1)" in text[text.index("Generate inline"):]
    assert sorted((r["per_label"], r["gt_label"], r["cand_label"], r["n"]) for r in joint.collect()) == [(False, 1, 1, 1000), (True, 1, 1, 1000)]


def test_written_views_are_read_as_tables(spark):
    i = Inputs(spark, FOLDER).written("v_cases", "v_voxels")
    text = plan(i.candidate) + plan(i.grids)
    assert "lineitem.parquet" not in text
    assert i.voxels.exceptAll(Inputs(spark, FOLDER).voxels).count() == 0


def test_distance_collects_nothing(spark):
    """Planes pass as sorted rows, whatever the size of Arrow batches; no list is built by group."""
    voxels = spark.createDataFrame([("a", x, y, z, 1) for x in range(1, 6) for y in range(1, 6) for z in range(1, 6)] + [("b", 0, 0, 0, 1)], VOXELS)
    grids = spark.createDataFrame([("a", 9, 9, 9), ("b", 1, 1, 1)], "case_id string, nx int, ny int, nz int")
    assert "collect_list" not in plan(edt.distance(voxels, grids))
    for size in ("3", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = {(r["case_id"], r["x"], r["y"], r["z"]): r["edt"] for r in edt.distance(voxels, grids).collect()}
            strict = edt.strict_centre(edt.distance(voxels, grids)).filter("case_id = 'a'").collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got.pop(("b", 0, 0, 0)) is None
        assert got == {("a", x, y, z): float(min(min(c, 6 - c) for c in (x, y, z))) for x in range(1, 6) for y in range(1, 6) for z in range(1, 6)}
        assert [(r["strict_x"], r["strict_y"], r["strict_z"]) for r in strict] == [(3.0, 3.0, 3.0)]


def test_manifest_lines_are_not_sorted(spark, monkeypatch):
    """Lines are looked up by hash, few repeated ids or many, and faulty ones not at all."""
    schema = "case_id string, gt string, expected struct<expected_verdict:string>, malformed string"
    cases = spark.createDataFrame(
        [("a", "g", ("pass",), None), ("b", "g", ("pass",), None), ("b", "g", ("pass",), None), ("c", None, ("pass",), None), (None, "g", ("pass",), None)]
        + [(None, None, None, "{x")] * 3, schema)
    for limit in (10, 0):
        monkeypatch.setattr(datasets, "BROADCAST_KEYS", limit)
        valid, errors = datasets.check_manifest(cases)
        assert "SortMergeJoin" not in plan(valid) + plan(errors)
        assert [r["case_id"] for r in valid.collect()] == ["a"]
        assert sorted((r["case_id"] or "", r["reason"]) for r in errors.collect()) == [
            ("", "malformed line")] * 3 + [("", "missing case_id"), ("b", "duplicate case_id"), ("b", "duplicate case_id"), ("c", "missing gt")]


def test_tables_made_before_are_taken(spark):
    """Components and intensities of the same maps are not made again."""
    voxels = spark.createDataFrame([("a", 0, 0, z, 20) for z in range(3)], VOXELS)
    grids = spark.createDataFrame([("a", 4, 4, 4, 1.0, 1.0, 1.0, "RAS")], "case_id string, nx int, ny int, nz int, sx double, sy double, sz double, axcodes string")
    scans = spark.createDataFrame([("a", 0, 0, z, 5.0) for z in range(3)], "case_id string, x int, y int, z int, hu double")
    parts, bright = components.summary(components.components(voxels), grids), label_intensity(voxels, scans)
    tables = build_tables(voxels, grids, merge_config(), scans=scans, parts=parts, bright=bright)
    assert tables.intensity is bright and tables.components.collect() == parts.collect()


def test_delivered_files_are_dealt_out(spark, tmp_path):
    """One large file is sorted by many tasks, and the ledger rows of a batch are counted once."""
    voxels = spark.createDataFrame([(f"c{x}", x, y, z, 1, "a/b.parquet", None) for x in range(40) for y in range(10) for z in range(10)],
                                   "case_id string, x int, y int, z int, label int, path string, expected long").coalesce(1)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2k")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1k")
    try:
        news = gate._stage(voxels, str(tmp_path), 0)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")
    assert len(list((tmp_path / "staged/batch=0").glob("*.parquet"))) > 1
    assert "staged" not in plan(news)
    assert {(r["case_id"], r["name"], r["n"], r["expected"]) for r in news.collect()} == {(f"c{x}", "b.parquet", 100, None) for x in range(40)}


def test_labels_of_a_tile_in_several_goes(spark, monkeypatch):
    """Labels that do not fit in one go together, and more words than the low one."""
    voxels = spark.createDataFrame([("a", x, y, z, l) for l in (-3, 0, 7) for x in (4, 5) for y in (0, 6, 7) for z in (60, 63, 64, 130)], VOXELS)
    want = {(l, s): 2 for l in (-3, 0, 7) for s in (2, 4)} | {(l, s): n for l in (-3, 0, 7) for s, n in ((2, 2), (4, 3), (8, 1))}
    got = {}
    monkeypatch.setattr(components, "COLUMNS", 4)
    for r in components.components(voxels).collect():
        got[r["label"], r["size"]] = got.get((r["label"], r["size"]), 0) + 1
    assert got == want


def test_letters_of_a_line_are_counted_once(spark):
    """Index and probe share the exchange of distinct lines, and keys come from one expression and not from one per segment."""
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").selectExpr("text AS line", "doc_id AS id")
    text = plan(lines.candidate_pairs(rows, 2))
    assert text.count("replace(") <= 2 * len(lines.LETTERS) and text.count("xxhash64(") <= 4
    distinct = rows.distinct()
    assert lines.candidate_pairs(rows, 2).exceptAll(lines.candidate_pairs(distinct, 2)).count() == 0


def test_positions_are_not_combined_before_their_shuffle(spark, monkeypatch):
    """Positions are nearly unique, so that counting them on the map side would hold, sort and spill a scan's whole share."""
    seen = []
    monkeypatch.setattr(overlap, "cut_lineage", lambda df: seen.append(df) or df)
    voxels = spark.createDataFrame([("a", 1, 1, 1, 20), ("a", 1, 1, 1, 21), ("a", 1, 1, 2, 20), ("b", 1, 1, 1, 20), ("b", 1, 1, 1, 20)], VOXELS)
    levels = spark.createDataFrame([(20, "C1"), (21, "C2")], "label int, level_name string")
    assert [tuple(r) for r in overlap.label_overlaps(voxels, levels).collect()] == [("a", 20, 21, "C1", "C2", 1)]
    text = plan(seen[0])
    assert text.count("Exchange") == 1 and text.index("partial_count") < text.index("Exchange")
