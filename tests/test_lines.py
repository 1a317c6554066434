"""Line helpers and the plans built on them, against plain versions."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from instqc.functions.lines import lower_envelope, run_distances, smoothed
from instqc.operators import components, edt, intensity, overlap
from instqc.plans import compare, evaluate
from instqc.plans.judge import judge
from instqc.plans.reference import build_reference
from instqc.schemas import levels
from instqc.sources import datasets
from tests import boxes


def test_lower_envelope():
    rng = np.random.default_rng(1)
    heights = np.where(rng.random((300, 23)) < 0.4, np.inf, rng.integers(0, 200, (300, 23)).astype(float))
    heights[0], heights[1] = np.inf, 0.0
    places = np.arange(23)
    want = (heights[:, :, None] + (places[:, None] - places[None, :]) ** 2).min(axis=1)
    assert np.array_equal(lower_envelope(heights), want)


def test_run_distances(monkeypatch):
    """Runs end at gaps and at the grid; matrices of any size give the same."""
    rng = np.random.default_rng(2)
    lines, sizes, want = [], [], []
    for _ in range(60):
        n = int(rng.integers(1, 20))
        held = np.flatnonzero(rng.random(n) < 0.7)
        known = [None if rng.random() < 0.4 else int(rng.integers(0, 50)) for _ in held]
        best = []
        for q in held:
            a, b = q, q
            while a - 1 in held:
                a -= 1
            while b + 1 in held:
                b += 1
            options = [d + (q - p) ** 2 for p, d in zip(held, known) if a <= p <= b and d is not None]
            options += [(q - a + 1) ** 2] * int(a > 0) + [(b + 1 - q) ** 2] * int(b < n - 1)
            best.append(min(options, default=None))
        lines.append((held.tolist(), known))
        sizes.append(n)
        want.append([None if x is None else int(x) for x in best])
    args = pa.array([p for p, _ in lines], pa.list_(pa.int32())), pa.array([d for _, d in lines], pa.list_(pa.int64())), pa.array(sizes, pa.int32())
    for cells in (1, 100, 1 << 20):
        monkeypatch.setattr("instqc.functions.lines.CELLS", cells)
        assert run_distances(*args).to_pylist() == want


def test_smoothed():
    kernel = np.array(edt.gaussian_kernel())
    places, values, sizes = [[0, 3], [5], [], [1, 2]], [[1.0, None], [2.0], [], [0.5, 4.0]], [7, 6, 4, 30]
    got = smoothed(pa.array(places, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64())), pa.array(sizes, pa.int32()), kernel).to_pylist()
    for cells, p, v, n in zip(got, places, values, sizes):
        dense = np.zeros(n)
        dense[p] = [x or 0.0 for x in v]
        full = np.convolve(np.pad(dense, 4, "symmetric"), kernel, "valid")
        assert {c["p"]: pytest.approx(c["v"]) for c in cells} == {q: full[q] for q in (c["p"] for c in cells)}
        assert {c["p"] for c in cells} >= set(np.flatnonzero(full > 1e-15).tolist())


def test_scan_rows_far_from_labels_stay_out(spark):
    """Rows outside the tiles of the labels go before the join, and the scan is not shuffled for that."""
    voxels = boxes.voxels(spark, [("a", 20, (2, 6), (2, 6), (2, 6))])
    scans = spark.range(16 * 16 * 40).selectExpr("'a' AS case_id", "int(id % 16) AS x", "int(id / 16 % 16) AS y", "int(id / 256) AS z", "double(id) AS hu")
    near = intensity.near_labels(voxels, scans)
    assert near.count() == 8**3 and near.columns == scans.columns
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert intensity.sampled(voxels, scans).count() == 4**3


def test_joint_counts(spark):
    """One pass gives what the separate joins give, also where labels overlap."""
    rng = np.random.default_rng(3)
    make = lambda n: spark.createDataFrame(
        [(f"c{int(rng.integers(2))}", *map(int, rng.integers(0, 4, 3)), int(rng.integers(20, 24))) for _ in range(n)],
        "case_id string, x int, y int, z int, label int").distinct()
    cand, gt = make(90).cache(), make(70).cache()
    grids = boxes.grids(spark, [(c, (4, 4, 4), (1, 1, 1), "RAS") for c in ("c0", "c1")])
    joint = overlap.joint_counts(cand, gt).cache()
    rows = lambda df: sorted(map(str, df.collect()))
    order = lambda df: df.select("case_id", "gt_label", "cand_label", "n")
    assert rows(order(overlap.agreement_counts(joint))) == rows(order(overlap.voxel_agreement(cand, gt)))
    known = levels(spark)
    both = overlap.dice(cand, gt, grids, known)
    assert rows(overlap.dice_of_counts(overlap.label_counts(joint), grids, known)) == rows(both)
    assert evaluate.checked_overlap(both, overlap.label_counts(joint)) is both
    with pytest.raises(ValueError, match="overlap_result.*'c0'.*label 20"):
        evaluate.checked_overlap(both.filter("case_id <> 'c0' OR label <> 20"), overlap.label_counts(joint))


@pytest.mark.parametrize("block", [4, 16, 2048])
def test_components_over_blocks(spark, block):
    """A snake through many tiles and a checkerboard of labels, whatever share is merged by blocks."""
    cells = [("a", x, y, 3, 20) for y in range(0, 20, 2) for x in range(20)]
    cells += [("a", 19 if y % 4 == 1 else 0, y, 3, 20) for y in range(1, 19, 2)]
    cells += [("a", x, y, z, 21) for x in range(0, 20, 3) for y in range(0, 20, 3) for z in range(30)]
    voxels = spark.createDataFrame(cells, "case_id string, x int, y int, z int, label int")
    parts = components.tile_parts(voxels, (4, 4, 8))
    stars = components.contract_blocks(components.part_edges(parts, (4, 4, 8)), (4, 4, 8), block)
    want = components.contract(components.part_edges(parts, (4, 4, 8)))
    assert sorted(map(tuple, stars.collect())) == sorted(map(tuple, want.select(*stars.columns).collect()))
    sizes = sorted((r.label, r.size) for r in components.components(voxels, (4, 4, 8)).collect())
    assert sizes == [(20, 209)] + [(21, 30)] * 49


def test_coordinates_beyond_the_ids(spark):
    far = spark.createDataFrame([("a", 1 << 21, 0, 0, 20)], "case_id string, x int, y int, z int, label int")
    with pytest.raises(Exception, match="coordinate x"):
        components.components(far).collect()


def test_empty_run_against_a_full_one(spark):
    modes = spark.createDataFrame([("a", "x", 1, 0.5), ("b", "y", 1, 0.1)], "run_id string, case_id string, mode int, value double")
    side = lambda r: modes.filter(F.col("run_id") == r)
    full, none = compare.run_summary(side("a")), compare.run_summary(side("z"))
    with pytest.raises(ValueError, match=r"1 and 0.*only the first has 'x'"):
        compare.compare_runs(full, none, side("a"), side("z"))
    with pytest.raises(ValueError, match="0 and 1"):
        compare.compare_runs(none, full)
    with pytest.raises(ValueError, match="has 'x'"):
        compare.compare_runs(full, compare.run_summary(side("b")), side("a"), side("b"))
    assert compare.compare_runs(none, none).count() == 8


def test_manifest_by_lines(spark, tmp_path):
    """Read in many splits: faults are found whichever split they lie in."""
    lines = ['{"case_id": "c%d", "gt": "g", "expected": {"expected_verdict": "pass"}}' % (i % 490) for i in range(500)]
    lines[7], lines[8] = "{broken", '{"case_id": "m", "expected": {"expected_verdict": "pass"}}'
    (tmp_path / "m.json").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        cases = datasets.read_manifest_lines(spark, str(tmp_path / "m.json")).cache()
        assert cases.rdd.getNumPartitions() > 4
        good, bad = datasets.check_manifest(cases)
        reasons = [r.reason for r in bad.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    # Of the ten ids that come twice two lost one row to the faults above.
    assert sorted(set(reasons)) == ["duplicate case_id", "malformed line", "missing gt"] and reasons.count("duplicate case_id") == 16
    assert good.count() + len(reasons) == 500


def test_reference_from_voxels(spark, tmp_path):
    """A cohort's own reference is written, read and used; a case off the others is found by it."""
    cases = [(f"c{i}", 20, (2, 8), (2, 8), (2, 8 + i % 2)) for i in range(8)] + [(f"c{i}", 21, (2, 8), (2, 8), (12, 18)) for i in range(8)]
    grids = boxes.grids(spark, [(f"c{i}", boxes.SIZE, (1, 1, 1), "RAS") for i in range(9)])
    voxels = boxes.voxels(spark, cases + [("c3", 99, (9, 10), (9, 10), (9, 10))])
    stats, meta = build_reference(voxels, grids, str(tmp_path / "r"), source="test", build_date="2026-01-01", edges=(200.0,))
    row = meta.first()
    assert (row["source"], row["subject_count"], row["strata"]) == ("test", 8, ["s1"]) and len(row["config_hash"]) == 64
    volume = stats.filter("level_name = 'L1' AND feature = 'physical_volume_mm3'").first()
    assert (volume["n"], volume["min"], volume["max"]) == (8, 216.0, 252.0)
    assert spark.read.parquet(str(tmp_path / "r" / "skipped")).collect() == [("c3", [99])]
    plain, _ = build_reference(voxels, grids, str(tmp_path / "p"), source="test", build_date="2026-01-01")
    odd = boxes.voxels(spark, [("c8", 20, (2, 14), (2, 14), (2, 14))])
    found = judge(odd, grids.filter("case_id = 'c8'"), reference=plain).findings
    assert "reference_delta" in {r.rule_id for r in found.collect()}
    again, _ = build_reference(voxels, grids, str(tmp_path / "q"), source="test", build_date="2026-01-01", with_morphology=False)
    assert {r.feature for r in again.select("feature").distinct().collect()} == {"physical_volume_mm3", "extent_x_mm", "extent_y_mm", "extent_z_mm"} | (
        {"curve_offset_mm"} & {r.feature for r in plain.select("feature").distinct().collect()})
