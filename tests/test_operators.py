"""Operators against hand-computed numbers and brute force."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from instqc.functions.quantiles import average_rank, cumulative, interpolated, order_statistics, value_counts
from instqc.functions.scalar import general_format
from instqc.functions.skew import hub_join, salted_join
from instqc.operators import components, edits, edt, geometry, inventory, overlap, reference
from instqc.operators.intensity import label_intensity
from instqc.schemas import levels
from instqc.sources.tables import aligned
from tests import boxes


def random_voxels(spark, seed=3, case="r", size=(9, 8, 12), share=0.55, labels=(1, 2)):
    rng = random.Random(seed)
    rows = [
        (case, x, y, z, rng.choice(labels))
        for x in range(size[0]) for y in range(size[1]) for z in range(size[2]) if rng.random() < share
    ]
    return rows, spark.createDataFrame(rows, "case_id string, x int, y int, z int, label int")


def flood(rows):
    """Component sizes per label by breadth-first search."""
    at = {(x, y, z): l for _, x, y, z, l in rows}
    seen, sizes = set(), defaultdict(list)
    for start, label in at.items():
        if start in seen:
            continue
        queue, n = [start], 0
        seen.add(start)
        while queue:
            x, y, z = queue.pop()
            n += 1
            for d in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)):
                p = (x + d[0], y + d[1], z + d[2])
                if p not in seen and at.get(p) == label:
                    seen.add(p)
                    queue.append(p)
        sizes[label].append(n)
    return {l: sorted(s, reverse=True) for l, s in sizes.items()}


def test_geometry_of_blocks(spark):
    grids = boxes.grids(spark, [("labelled_blocks", (16, 16, 16), (1, 1, 1), "RAS"), ("aniso", (16, 16, 16), (1, 1, 3), "RAS")])
    voxels = boxes.voxels(spark, boxes.blocks() + [
        ("aniso", 1, (2, 6), (2, 6), (2, 5)), ("aniso", 2, (9, 13), (9, 13), (8, 11))])
    got = {(r["case_id"], r["label"]): r for r in geometry.label_features(voxels, grids, levels(spark)).collect()}
    for label in (1, 2, 3):
        r = got["labelled_blocks", label]
        assert (r["voxel_count"], r["physical_volume_mm3"], r["extent_x_mm"], r["extent_z_mm"]) == (64, 64.0, 4.0, 4.0)
    assert got["labelled_blocks", 1]["level_name"] == "C1"
    r = got["aniso", 2]
    assert (r["voxel_count"], r["physical_volume_mm3"], r["extent_z_mm"], r["cz_mm"]) == (48, 144.0, 9.0, 27.0)
    assert not any(r[f"touches_{f}"] for f in ("left", "right", "superior", "inferior"))


@pytest.mark.parametrize("axcodes, low, high", [("RAS", "left", "superior"), ("LPI", "right", "inferior"), ("PIR", "anterior", "right")])
def test_face_contact(spark, axcodes, low, high):
    grids = boxes.grids(spark, [("a", (8, 8, 8), (1, 1, 1), axcodes)])
    voxels = boxes.voxels(spark, [("a", 20, (0, 3), (2, 4), (5, 8))])
    row = geometry.label_features(voxels, grids, levels(spark)).first()
    touched = {f for f in ("left", "right", "anterior", "posterior", "superior", "inferior") if row[f"touches_{f}"]}
    assert touched == {low, high}


def test_orientation_matches_numpy(spark):
    rng = np.random.default_rng(1)
    rows = []
    for label in range(1, 6):
        points = np.unique(np.rint(rng.normal(40, [9, 5, 2], (300, 3)) @ np.linalg.qr(rng.normal(size=(3, 3)))[0] * 1.0 + 150).astype(int), axis=0)
        rows += [("a", *map(int, p), label) for p in points]
    rows += [("a", 5, 5, z, 9) for z in range(10)] + [("a", 1, 1, 1, 10)]
    voxels = spark.createDataFrame(rows, "case_id string, x int, y int, z int, label int")
    grids = boxes.grids(spark, [("a", (300, 300, 300), (1.0, 0.5, 2.0), "RAS")])
    for r in geometry.label_features(voxels, grids, levels(spark)).collect():
        axis = np.array([r["axis_x"], r["axis_y"], r["axis_z"]])
        if r["label"] == 9:
            assert math.isinf(r["eigenvalue_ratio"]) and axis.tolist() == [0, 0, 1]
        elif r["label"] == 10:
            assert r["eigenvalue_ratio"] == 0 and axis.tolist() == [0, 0, 0]
        else:
            cloud = np.array([p[1:4] for p in rows if p[4] == r["label"]]) * [1.0, 0.5, 2.0]
            value, vector = np.linalg.eigh(np.cov(cloud, rowvar=False))
            assert r["eigenvalue_ratio"] == pytest.approx(value[2] / value[1], rel=1e-6)
            assert abs(axis @ vector[:, 2]) == pytest.approx(1, abs=1e-6)
            assert axis[np.argmax(np.abs(axis))] > 0


@pytest.mark.parametrize("tile", [(32, 32, 256), (4, 4, 5), (2, 3, 4)])
def test_components_match_flood_fill(spark, tile):
    rows, voxels = random_voxels(spark)
    got = defaultdict(list)
    for r in components.components(voxels, tile).collect():
        got[r["label"]].append(r["size"])
    assert {l: sorted(s, reverse=True) for l, s in got.items()} == flood(rows)


def test_component_ids_do_not_depend_on_tiles(spark):
    _, voxels = random_voxels(spark, seed=8)
    assert {tuple(r) for r in components.components(voxels).collect()} == {
        tuple(r) for r in components.components(voxels, (3, 4, 5)).collect()}


def test_long_chain_and_hub(spark):
    n = 300
    chain = [("a", 1, i, i + 1) for i in range(n)] + [("a", 2, 0, i) for i in range(1, n)]
    edges = spark.createDataFrame(chain, "case_id string, label int, a long, b long")
    stars = components.contract(edges).collect()
    assert len(stars) == n + n - 1 and {r["b"] for r in stars} == {0}


def test_hub_join_splits_the_hot_node(spark):
    edges = spark.createDataFrame([("h", i) for i in range(90)] + [("c", i) for i in range(5)], "k string, v int")
    nodes = edges.groupBy("k").agg(F.count("*").alias("d"), F.min("v").alias("m"))
    assert hub_join(edges, nodes, ["k"], "d", 20).count() == 95


def test_diagonal_is_not_connected(spark):
    voxels = spark.createDataFrame([("a", 1, 1, 1, 5), ("a", 2, 2, 1, 5)], "case_id string, x int, y int, z int, label int")
    assert components.components(voxels).count() == 2


def test_component_summary(spark):
    voxels = boxes.voxels(spark, [("a", 1, (0, 3), (0, 3), (0, 3)), ("a", 1, (6, 7), (6, 7), (6, 7))])
    grids = boxes.grids(spark, [("a", (9, 9, 9), (1, 1, 2), "RAS")])
    r = components.summary(components.components(voxels), grids, 5).first()
    assert r["component_sizes"] == [(27, 1), (1, 1)] and r["small_fragments"] == [(1, 1)] and r["stray_component_sizes"] == [(1, 1)]
    assert r["component_volumes_mm3"] == [(54.0, 1), (2.0, 1)] and r["stray_volume_mm3"] == 2.0
    assert r["largest_component_fraction"] == 27 / 28


def test_distance_matches_brute_force(spark):
    size = (7, 6, 8)
    rows, voxels = random_voxels(spark, 5, size=size, share=0.9, labels=(1,))
    grids = boxes.grids(spark, [("r", size, (1, 1, 1), "RAS")])
    inside = {(x, y, z) for _, x, y, z, _ in rows}
    outside = [(x, y, z) for x in range(7) for y in range(6) for z in range(8) if (x, y, z) not in inside]
    for r in edt.distance(voxels, grids).collect():
        best = min(math.dist((r["x"], r["y"], r["z"]), o) for o in outside)
        assert r["edt"] == pytest.approx(best)


def test_centres_of_a_cube(spark):
    voxels = boxes.voxels(spark, [("a", 1, (3, 10), (3, 10), (3, 10))])
    grids = boxes.grids(spark, [("a", (16, 16, 16), (1, 1, 2), "RAS")])
    r = edt.centres(voxels, grids, levels(spark)).first()
    assert (r["smooth_x"], r["strict_x"], r["strict_z_mm"]) == (6.0, 6.0, 12.0)
    assert r["depth_smooth"] == 3.5 and r["is_atlas_axis"]


@pytest.mark.parametrize("limit", [1_000_000, 20])
def test_exact_quantiles_of_a_hot_group(spark, limit):
    rng = np.random.default_rng(2)
    groups = {"hot": np.round(rng.normal(size=3000), 2), "b": rng.normal(size=37), "one": np.array([4.0])}
    data = [(k, float(v)) for k, vs in groups.items() for v in vs]
    df = spark.createDataFrame(data, "g string, v double")
    at = [0.01, 0.25, 0.5, 0.95]
    rows = cumulative(value_counts(df, ["g"], "v"), ["g"], limit)
    got = rows.groupBy("g", "n", "mean").agg(*order_statistics(at)).selectExpr(
        "g", "mean", *[f"{text} AS q{i}" for i, text in enumerate(interpolated(at))]).collect()
    assert {r["g"] for r in got} == set(groups)
    for r in got:
        assert [r[f"q{i}"] for i in range(4)] == pytest.approx(np.percentile(groups[r["g"]], [100 * q for q in at]).tolist())
        assert r["mean"] == pytest.approx(groups[r["g"]].mean())
    ranks = {(r["g"], r["value"]): r["rank"] for r in rows.withColumn("rank", average_rank()).collect()}
    hot = np.sort(groups["hot"])
    value = hot[1500]
    assert ranks["hot", value] == pytest.approx((np.flatnonzero(hot == value) + 1).mean())


def test_salted_join_keeps_all_rows_of_a_hot_key(spark):
    big = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    small = big.select("k").distinct().withColumn("v", F.col("k") * 2)
    got = salted_join(big, small, ["k"], ["id"])
    assert got.count() == 3000 and got.filter("v <> 2 * k").count() == 0
    assert salted_join(big, small.limit(0), ["k"], ["id"], how="left").count() == 3000


def test_intensity(spark):
    rng = np.random.default_rng(4)
    voxels = boxes.voxels(spark, [("a", 1, (0, 6), (0, 6), (0, 6)), ("a", 2, (8, 10), (0, 2), (0, 2)), ("a", 3, (12, 13), (0, 1), (0, 1))])
    values = {(r["x"], r["y"], r["z"]): float(rng.normal(300, 80)) for r in voxels.collect()}
    values.update({k: 50.0 for k in values if k[0] in (8, 9)} | {(0, 0, 0): float("nan"), (0, 0, 1): float("inf"), (12, 0, 0): float("nan")})
    scans = spark.createDataFrame([("a", *k, v) for k, v in values.items()], "case_id string, x int, y int, z int, hu double")
    got = {r["label"]: r for r in label_intensity(voxels, scans).collect()}
    sample = np.array([v for k, v in values.items() if k[0] < 6 and np.isfinite(v)])
    r = got[1]
    assert (r["voxel_count"], r["n_nonfinite_excluded"]) == (214, 2)
    assert [r["mean"], r["std"], r["median"], r["p05"], r["p95"]] == pytest.approx(
        [sample.mean(), sample.std(), np.median(sample), *np.percentile(sample, [5, 95])])
    share = np.histogram(sample, 32)[0] / len(sample)
    assert r["entropy"] == pytest.approx(-(share[share > 0] * np.log2(share[share > 0])).sum())
    assert (got[2]["std"], got[2]["entropy"], got[2]["iqr"]) == (0.0, 0.0, 0.0)
    assert got[3]["voxel_count"] == 0 and got[3]["mean"] is None and got[3]["n_nonfinite_excluded"] == 1


def test_overlaps_of_three_labels(spark):
    voxels = boxes.voxels(spark, [("a", 1, (0, 4), (0, 4), (0, 4)), ("a", 2, (2, 6), (0, 4), (0, 4)), ("a", 40, (3, 4), (0, 4), (0, 1))])
    got = [(r["label_a"], r["label_b"], r["name_b"], r["overlap_voxels"]) for r in overlap.label_overlaps(voxels, levels(spark)).orderBy("label_a", "label_b").collect()]
    assert got == [(1, 2, "C2", 32), (1, 40, "unknown", 4), (2, 40, "unknown", 4)]


def test_empty_maps(spark):
    grids = boxes.grids(spark, [("a", (4, 4, 4), (1, 1, 1), "RAS"), ("b", (4, 4, 4), (1, 1, 1), "RAS")])
    voxels = boxes.voxels(spark, [("b", 1, (0, 2), (0, 2), (0, 2))])
    limits = {"min_foreground_voxels": 10, "min_label_count": 2}
    got = {r["case_id"]: r["reasons"] for r in inventory.check_empty(grids, inventory.inventory(voxels), limits).collect()}
    assert got == {
        "a": ["No foreground voxels found (empty label map).", "Distinct label count 0 is below the minimum 2."],
        "b": ["Foreground voxel count 8 is below the minimum 10.", "Distinct label count 1 is below the minimum 2."],
    }


def test_alignment(spark):
    grids = boxes.grids(spark, [(c, (4, 4, 4), (1, 1, 1), "RAS") for c in "abc"])
    scans = boxes.grids(spark, [("a", (4, 4, 4), (1.00001, 1, 1), "RAS"), ("b", (4, 4, 5), (1, 1, 1), "RAS")])
    good, errors = aligned(grids, scans)
    assert {r["case_id"] for r in good.collect()} == {"a", "c"}
    assert [(r["case_id"], r["reason"]) for r in errors.collect()] == [("b", "scan and segmentation have mismatched shapes")]


def test_edits_do_not_lose_voxels(spark):
    voxels = boxes.voxels(spark, boxes.blocks("a"))
    grids = boxes.grids(spark, [("a", (16, 16, 16), (1, 1, 1), "RAS")])
    moves = spark.createDataFrame([("a", 1, 0, 8, 0)], "case_id string, label int, dx int, dy int, dz int")
    got = {r["label"]: r["voxel_count"] for r in inventory.inventory(edits.shift(voxels, moves, grids)).collect()}
    assert got == {1: 64, 3: 64}  # label 2 lies exactly where label 1 lands
    pick = spark.createDataFrame([("a", 2)], "case_id string, label int")
    cut = edits.cut(voxels, pick, grids, 2)
    assert {r["label"]: r["voxel_count"] for r in inventory.inventory(cut).collect()} == {1: 64, 2: 48, 3: 64}


def test_strata_and_single_observation(spark):
    obs = spark.createDataFrame(
        [("a", "L1", 1.0, "f", 5.0), ("b", "L1", 2.0, "f", 7.0), ("c", "L1", 3.0, "f", 9.0)],
        "case_id string, level_name string, size_proxy double, feature string, value double")
    got = {r["stratum"]: r for r in reference.aggregate_reference(reference.with_stratum(obs, [2.0], ["small", "large"])).collect()}
    assert got["small"]["n"] == 1 and got["small"]["std"] == 0.0
    assert got["large"]["n"] == 2 and got["large"]["std"] == pytest.approx(math.sqrt(2)) and got["large"]["pcts"][25] == 7.5
    with pytest.raises(Exception, match="size proxy"):
        reference.with_stratum(obs.withColumn("size_proxy", F.lit(None).cast("double")), [2.0]).collect()


@pytest.mark.parametrize("value", [0.0, 64.0, 9562.5, 0.9985620706, 123456.7, 1234567.0, 0.0001234567, 0.00001234, -12.5, 999999.6, 1e12])
def test_general_format(spark, value):
    row = spark.createDataFrame([(value,)], "v double").selectExpr(f"{general_format('v')} AS t").first()
    assert row["t"] == f"{value:.6g}"


def test_relabelling_and_shift_invariance(spark):
    rows, voxels = random_voxels(spark, 11)
    moved = voxels.select("case_id", (F.col("x") + 40).alias("x"), "y", "z", (F.col("label") + 5).alias("label"))
    sizes = lambda df, by: sorted((r["label"] - by, r["size"]) for r in components.components(df, (5, 5, 5)).collect())
    assert sizes(voxels, 0) == sizes(moved, 5)


def test_salted_rows_are_not_broadcast(spark, tmp_path):
    """One row per key in a small file is 64 rows per key after salting, which Spark must not think small."""
    spark.range(100_000).selectExpr("id AS k", "id % 2 = 0 AS v").write.parquet(f"{tmp_path}/keys")
    small = spark.read.parquet(f"{tmp_path}/keys")
    big = spark.range(0, 6_000_000, 3).selectExpr("id AS k", "id AS n")
    for how in ("inner", "left"):
        joined = salted_join(big, small, ["k"], ["n"], how)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
        assert joined.columns == ["k", "n", "v"] and joined.filter("v = (k % 2 = 0)").count() == 33_334
