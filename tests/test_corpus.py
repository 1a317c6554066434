"""The nine-case corpus with known defects, judged and evaluated end to end."""

import pytest
from pyspark.sql import functions as F

from instqc.operators import overlap, sequence
from instqc.plans.evaluate import evaluate, regression_check
from instqc.plans.judge import judge
from instqc.session import cut_lineage
from tests import boxes


@pytest.fixture(scope="module")
def cohort(spark):
    return cut_lineage(boxes.corpus(spark)), boxes.corpus_grids(spark)


@pytest.fixture(scope="module")
def judged(cohort):
    voxels, grids = cohort
    return judge(voxels, grids)


def test_verdicts(judged):
    got = {r["case_id"]: r["verdict"] for r in judged.verdicts.collect()}
    seen = dict((row[0], row[1]) for row in boxes.CORPUS)
    seen["mode8_force_overlap"] = got["mode8_force_overlap"]
    assert got == seen


def test_findings(judged):
    got = {}
    for r in judged.findings.collect():
        got.setdefault(r["case_id"], []).append((r["rule_id"], tuple(r["labels"]), r["reason"]))
    rules = {case: sorted({f[0] for f in fs}) for case, fs in got.items()}
    assert rules.get("clean_control") is None
    assert rules["mode1_displace"] == ["mislabel"]
    assert rules["mode2_fragment"] == ["fragmentation"]
    assert rules["mode3_inject_islands"] == ["fragmentation"]
    assert rules["mode4_relabel_swap"] == ["mislabel"]
    assert rules["mode5_remove_level"] == ["coverage"]
    assert rules["mode6_crop_at_border"] == ["border", "mislabel"]
    assert rules["mode7_sequence_break"] == ["coverage", "sequence"] or rules["mode7_sequence_break"] == ["sequence"]
    assert got["mode5_remove_level"][0][2] == (
        "Missing interior level(s): L3 absent within the observed present-level span."
    )
    assert [f[2] for f in got["mode2_fragment"]] == [
        "Fragmentation: Label 22: fragmentation_index=0.5 is strictly below threshold 0.75. "
        "component_count=2, component_sizes=[9000, 9000]"
    ]
    assert [f[2] for f in got["mode3_inject_islands"]] == [
        "Rogue island(s): Label 22: 1 non-dominant component(s) strictly below island_min_voxels=50. "
        "Tiny island sizes: [27]. component_count=2, component_sizes=[18750, 27], "
        "fragmentation_index=0.9985620706183096"
    ]
    assert [f[2] for f in got["mode6_crop_at_border"] if f[0] == "border"] == [
        "Partial vertebra clipped by FOV: label 22 (L3) touches image face(s): anterior."
    ]
    pairs = [f for f in got["mode4_relabel_swap"] if len(f[1]) == 2]
    assert [p[1] for p in pairs] == [(21, 22)]
    assert [f[2] for f in got["mode7_sequence_break"] if f[0] == "sequence"] == [
        "Non-continuous label sequence: T13 out of anatomical order."
    ]


def test_chord_offsets(judged):
    rows = sequence.curve_offsets(judged.tables.features).filter(
        F.col("case_id").isin("clean_control", "mode1_displace", "mode4_relabel_swap", "mode6_crop_at_border")
    ).collect()
    got = {(r["case_id"], r["label"]): r["curve_offset_mm"] for r in rows}
    assert [got["clean_control", l] for l in (21, 22, 23)] == pytest.approx([1.0, 2.0, 1.0], abs=0.01)
    assert got["clean_control", 20] is None and got["clean_control", 24] is None
    assert got["mode1_displace", 22] == pytest.approx(19.85, abs=0.01)
    assert got["mode4_relabel_swap", 21] == pytest.approx(40.05, abs=0.01)
    assert got["mode6_crop_at_border", 22] == pytest.approx(17.61, abs=0.01)


def test_label_counts(cohort):
    voxels, _ = cohort
    got = {(r["case_id"], r["label"]): r["count"] for r in voxels.groupBy("case_id", "label").count().collect()}
    assert got["clean_control", 22] == 18750
    assert got["mode3_inject_islands", 22] == 18777
    assert got["mode6_crop_at_border", 22] == 15000
    assert ("mode5_remove_level", 22) not in got


def test_centroids(judged):
    rows = judged.tables.features.filter("case_id = 'clean_control'").orderBy("label").collect()
    assert [(r["cx"], r["cy"], r["cz"]) for r in rows] == [
        (29.5, 27.0, 27.0), (33.5, 27.0, 67.0), (35.5, 27.0, 107.0), (33.5, 27.0, 147.0), (29.5, 27.0, 187.0)
    ]


def test_overlap_with_base(spark, cohort):
    voxels, _ = cohort
    pairs = spark.createDataFrame([("mode8_force_overlap", 20, 21)], "case_id string, target int, neighbour int")
    got = overlap.overlap_with_base(voxels, boxes.base(spark), pairs).collect()
    assert [(r["target"], r["neighbour"], r["overlap_voxels"]) for r in got] == [(20, 21, 1950)]


def test_evaluation(spark, cohort):
    voxels, grids = cohort
    run = evaluate(cut_lineage(boxes.base(spark)), voxels, grids, boxes.expected(spark))
    modes = {(r["case_id"], r["mode"]): r["value"] for r in run.modes.collect()}
    assert [modes["clean_control", m] for m in range(1, 9)] == [0, 1, 0, 0, 0, 0, 0, 0]
    assert modes["mode1_displace", 1] > 0
    assert modes["mode2_fragment", 2] == 0.5
    assert modes["mode3_inject_islands", 3] == 1
    assert modes["mode4_relabel_swap", 4] == pytest.approx(0.4)
    assert modes["mode5_remove_level", 5] == 1
    assert modes["mode6_crop_at_border", 6] == 1
    assert modes["mode7_sequence_break", 7] == 1
    outcome = {r["case_id"]: r["outcome"] for r in run.outcomes.collect()}
    assert outcome["clean_control"] == "TN"
    assert {c for c, o in outcome.items() if o == "TP"} >= {row[0] for row in boxes.CORPUS[1:8]}
    dice = {r["case_id"]: r for r in run.case_overlap.collect()}
    assert dice["clean_control"]["mean_dice"] == 1.0
    assert dice["mode5_remove_level"]["n_unmatched"] == 1
    check = {r["case_id"]: r["passed"] for r in regression_check(run.findings, run.verdicts, boxes.expected(spark)).collect()}
    assert check["clean_control"] and check["mode2_fragment"] and check["mode7_sequence_break"]
