"""Rules, verdicts, comparison of runs, calibration, sources and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from instqc.config import merge_config
from instqc.operators import metrics, rules, sequence
from instqc.operators.verdict import verdicts
from instqc.plans import compare, evaluate
from instqc.plans.calibrate import Axis, calibrate, calibration_status, grid_of
from instqc.plans.evaluate import compare_values
from instqc.schemas import levels
from instqc.sources import datasets
from instqc.streaming.gate import MANIFEST, start_gate
from tests import boxes

FINDING = "case_id string, rule_id string, severity int, reason string, labels array<int>, k1 int, k2 int, k3 string"


def label_rows(spark, rows):
    """rows: (case, label, superior, inferior) -> a minimal feature table."""
    df = spark.createDataFrame(rows, "case_id string, label int, touches_superior boolean, touches_inferior boolean")
    return df.join(levels(spark), "label", "left").fillna("unknown", ["level_name"])


@pytest.mark.parametrize("cut_above, aware, expected, names", [
    (False, True, ["T12", "T13", "L1"], "T13"),  # beyond an intact end only the adjacent level
    (True, True, ["T12", "T13", "L1"], None),    # nothing is expected beyond a cut end
    (True, False, ["T12", "T11", "L1"], "T11, T12"),
])
def test_coverage_beyond_the_ends(spark, cut_above, aware, expected, names):
    features = label_rows(spark, [("a", 20, cut_above, False), ("a", 21, False, True)])
    params = {"severity": "flagged-for-review", "expected_levels": expected, "border_aware": aware}
    got = [r["reason"] for r in rules.coverage(rules.Tables(features, levels(spark)), params).collect()]
    want = [f"Incomplete coverage (span): expected level(s) {names} absent beyond the present span."] if names else []
    assert got == want


def test_verdict_and_escalation(spark):
    found = spark.createDataFrame([
        ("a", "border", 1, "one", [3], 3, 0, ""), ("a", "bounds", 1, "two", [3, 4], 3, 0, ""),
        ("b", "coverage", 1, "three", [], 0, 0, ""), ("c", "border", 0, "fine", [1], 1, 0, "")], FINDING)
    cases = spark.createDataFrame([(c,) for c in "abcd"], "case_id string")
    base = spark.createDataFrame([("d", ["empty"]), ("a", [])], "case_id string, reasons array<string>")
    got = {r["case_id"]: r for r in verdicts(cases, found, {"verdict": {"flag_escalation_count": 2}}, base).collect()}
    assert {c: got[c]["verdict"] for c in "abcd"} == {"a": "fail", "b": "flagged-for-review", "c": "pass", "d": "fail"}
    assert got["a"]["reasons"][0]["message"] == (
        "2 review-level findings meet the escalation threshold (2); verdict escalated to fail.")
    assert [m["message"] for m in got["a"]["per_label"][3]] == ["one", "two"]
    assert [m["message"] for m in got["d"]["reasons"]] == ["empty"] and got["d"]["n_flag"] == 0


def test_disabled_rules_are_left_out(spark):
    features = label_rows(spark, [("a", 24, False, False), ("a", 28, False, False)])
    off = {"rules": {r: {"enabled": False} for r in rules.RULES if r != "sequence"}}
    got = rules.run_rules(rules.Tables(features, levels(spark)), merge_config(off)).collect()
    assert [(r["rule_id"], r["labels"]) for r in got] == [("sequence", [28])]


def test_missing_levels_and_t13(spark):
    features = label_rows(spark, [("a", 19, False, False), ("a", 22, False, False), ("b", 50, False, False)])
    got = [r["level_name"] for r in sequence.missing_levels(features, levels(spark)).orderBy("rank").collect()]
    assert got == ["T13", "L1", "L2"]


def test_severity_names():
    from instqc.schemas import severity_level

    with pytest.raises(ValueError):
        severity_level("warning")
    assert severity_level("fail") == 2


def test_rates_without_cases_are_null(spark):
    rows = spark.createDataFrame([("TP", True, True, True, 1, "m"), ("TP", True, True, False, 1, "m")],
                                 "outcome string, expected_failure boolean, caught boolean, caught_by_designated_rule boolean, failure_mode int, failure_mode_name string")
    r = metrics.confusion(rows).first()
    assert (r["sensitivity"], r["false_positive_rate"], r["specificity"]) == (1.0, None, None)
    modes = metrics.per_mode(rows, [2, 1]).collect()
    assert [(m["failure_mode"], m["n_cases"], m["sensitivity"]) for m in modes] == [(2, 0, None), (1, 2, 0.5)]


def test_correlation_sentinels(spark):
    pairs = spark.createDataFrame([(1.0, 0), (2.0, 1), (None, 1), (4.0, 1)], "x double, y int")
    assert metrics.correlation(pairs, "x", "y").first()["coefficient"] == pytest.approx(0.7559289)
    assert metrics.correlation(pairs, "x", "y", "spearman").first()["coefficient"] == pytest.approx(0.8660254)
    assert metrics.correlation(pairs.limit(1), "x", "y").first()["coefficient"] is None
    assert metrics.correlation(pairs.withColumn("y", F.lit(1)), "x", "y").first()["coefficient"] is None


def test_run_comparison(spark):
    rows = [("a", "c1", m, v) for m, v in ((1, 0.0), (2, 1.0), (3, 0.0), (4, None))]
    rows += [("b", "c1", m, v) for m, v in ((1, 0.25), (2, 0.5), (3, 9.0), (4, 0.5))]
    runs = compare.run_summary(spark.createDataFrame(rows, "run_id string, case_id string, mode int, value double"))
    table = compare.compare_runs(runs.filter("run_id = 'a'"), runs.filter("run_id = 'b'"))
    got = {r["mode"]: r for r in table.collect()}
    assert got[2]["normalised_delta"] == -0.5 and got[2]["worsened"] and got[2]["attributed"]
    assert got[3]["delta"] == 9.0 and got[3]["normalised_delta"] is None and got[4]["delta"] is None
    r = compare.attribution(table).first()
    assert (r["attributed_mode"], r["excluded_modes"], r["unattributable_reason"]) == (2, [3], None)
    same = compare.attribution(compare.compare_runs(runs.filter("run_id = 'a'"), runs.filter("run_id = 'a'"))).first()
    assert "nothing moved" in same["unattributable_reason"]


def test_ladder(spark):
    rows = [("s", m, rung, float(rung), f, (-1.0 if f == 2 else 1.0) * rung * (10 if f == m else 0))
            for m in (1, 2, 3) for rung in range(3) for f in (1, 2, 3)]
    got = {r["mode"]: r for r in compare.score_ladders(
        spark.createDataFrame(rows, "sweep_id string, mode int, rung int, severity double, metric int, value double")).collect()}
    assert all(got[m]["passed"] and got[m]["margin"] == float("inf") for m in (1, 2, 3))


def test_calibration_picks_the_first_best(spark):
    cases = spark.createDataFrame(
        [(True, 1, False, False, 4.0, 4.0), (False, None, False, False, 3.0, None), (False, None, False, False, 1.0, None)],
        "expected_failure boolean, failure_mode int, fixed_flag boolean, fixed_designated boolean, m double, d double")
    axis = Axis("t", "m", "d", (2.0, 3.5, 4.0, 5.0))
    scored = calibrate(cases, [axis])
    got = {r["grid_id"]: r for r in scored.collect()}
    assert [got[g]["feasible"] for g in range(4)] == [True, True, True, False]
    assert [got[g]["false_positive_rate"] for g in range(4)] == [0.5, 0.0, 0.0, 0.0]
    assert [got[g]["best"] for g in range(4)] == [False, True, False, False]
    assert calibration_status(scored).first()["best_grid_id"] == 1
    with pytest.raises(ValueError):
        grid_of([Axis("t", "m", "d", tuple(range(600)))])


def test_compare_values(spark):
    schema = "key string, path string, number double, text string"
    a = spark.createDataFrame([("k", "x", 1.0, None), ("k", "y", 2.0, None), ("k", "t", None, "u"), ("k", "gone", 1.0, None)], schema)
    b = spark.createDataFrame([("k", "x", 1.0 + 1e-12, None), ("k", "y", 2.1, None), ("k", "t", None, "u")], schema)
    assert {r["path"] for r in compare_values(a, b).collect()} == {"y", "gone"}


def test_manifest(spark, tmp_path):
    good = {"case_id": "a", "gt": "a.nii", "expected": {"expected_verdict": "pass"}}
    cases = [good, {"case_id": "b", "expected": {"expected_verdict": "pass"}}, {"case_id": "c", "gt": "x", "expected": {}},
             {**good, "case_id": "d"}, {**good, "case_id": "d"}]
    path = tmp_path / "manifest.json"
    path.write_text(json.dumps({"manifest_version": "0.1", "cases": cases}, indent=1))
    valid, errors = datasets.check_manifest(datasets.read_manifest(spark, str(path)))
    assert [r["case_id"] for r in valid.collect()] == ["a"]
    assert sorted((r["case_id"], r["reason"]) for r in errors.collect()) == [
        ("b", "missing gt"), ("c", "missing expected_verdict"), ("d", "duplicate case_id"), ("d", "duplicate case_id")]
    assert datasets.expected_table(valid).first()["expected_rule_ids"] == []


def test_subset_from_csv(spark, tmp_path):
    (tmp_path / "ids.csv").write_text("case_id,x\n a ,1\n,2\nc,3\n")
    cases = spark.createDataFrame([("a",), ("b",), ("c",)], "case_id string")
    ids = datasets.ids_from_csv(spark, str(tmp_path / "ids.csv"))
    assert {r["case_id"] for r in datasets.select_subset(cases, ids=ids).collect()} == {"a", "c"}
    with pytest.raises(ValueError):
        datasets.ids_from_csv(spark, str(tmp_path / "ids.csv"), "nope")


def test_gate_waits_for_all_files_of_a_case(spark, tmp_path):
    """A case over several files and batches is judged once and whole; an empty map gets its verdict."""
    grids = boxes.grids(spark, [(c, boxes.SIZE, (1, 1, 1), "RAS") for c in ("a", "b", "e")])
    incoming, manifest, out, marks = (str(tmp_path / n) for n in ("in", "manifest", "out", "marks"))
    parts = [boxes.voxels(spark, [("a", 20, (2, 8), (2, 8), (2, 8))]), boxes.voxels(spark, [("a", 22, (2, 8), (2, 8), (20, 28))])]
    total = sum(p.count() for p in parts)
    spark.createDataFrame([("a", total), ("e", 0)], MANIFEST).coalesce(1).write.parquet(manifest)
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(incoming)
    start = lambda: start_gate(spark, incoming, manifest, grids, out, marks, files_per_batch=1, once=True).awaitTermination()
    start()
    late = boxes.voxels(spark, [("b", 20, (2, 8), (2, 8), (2, 8))])
    late.coalesce(1).write.mode("append").parquet(incoming)
    start()
    seen = lambda: {r["case_id"]: r["verdict"] for r in spark.read.parquet(f"{out}/verdicts").collect()}
    assert seen() == {"a": "flagged-for-review", "e": "fail"}
    spark.createDataFrame([("b", late.count())], MANIFEST).coalesce(1).write.mode("append").parquet(manifest)
    start()
    assert seen() == {"a": "flagged-for-review", "e": "fail", "b": "flagged-for-review"}
    assert spark.read.parquet(f"{out}/verdicts").count() == 3
    rules_of_a = {r["rule_id"] for r in spark.read.parquet(f"{out}/findings").filter("case_id = 'a'").collect()}
    assert rules_of_a == {"bounds", "coverage"}


def test_gate_repeated_late_and_surplus_files(spark, tmp_path):
    """Repeats count once, a file delivered again replaces itself, surplus and late rows become dead letters."""
    grids = boxes.grids(spark, [(c, boxes.SIZE, (1, 1, 1), "RAS") for c in ("a", "b", "c", "d")])
    manifest, out, marks = (str(tmp_path / n) for n in ("manifest", "out", "marks"))
    drop = tmp_path / "in"
    box = lambda case, z: boxes.voxels(spark, [(case, 20, (2, 4), (2, 4), (z, z + 4))])

    def deliver(folder, name, *parts):
        """One file of a given name."""
        (drop / folder).mkdir(parents=True, exist_ok=True)
        df = parts[0]
        for part in parts[1:]:
            df = df.union(part)
        df.toPandas().astype({c: "int32" for c in ("x", "y", "z", "label")}).to_parquet(drop / folder / name, index=False)

    def expect(**sizes):
        spark.createDataFrame([(c, n) for c, n in sizes.items()], MANIFEST).coalesce(1).write.mode("append").parquet(manifest)

    def run():
        start_gate(spark, f"{drop}/*", manifest, grids, out, marks, files_per_batch=100, once=True).awaitTermination()
        verdict = sorted(r["case_id"] for r in spark.read.parquet(f"{out}/verdicts").collect())
        dead = sorted((r["case_id"], r["reason"], r["unique_rows"]) for r in spark.read.parquet(f"{out}/dead_letters").collect())
        return verdict, dead

    # a: 16 rows, of which a second file repeats some; b: half of its rows, twice; c: more than expected; x: no grid.
    deliver("one", "a1", box("a", 2))
    deliver("one", "a2", box("a", 2).limit(3))
    deliver("one", "b1", box("b", 2))
    deliver("two", "b1", box("b", 2))
    deliver("one", "c1", box("c", 2), box("c", 10))
    deliver("one", "x1", box("x", 2))
    expect(a=16, b=32, c=16, d=16, x=16)
    wrong = ("c", "more rows than its manifest says", 32)
    lost = ("x", "no grid", 16)
    assert run() == (["a"], [wrong, lost])
    # b's other half comes with a repeat of the first, a file of c is delivered again and right, d comes short.
    deliver("three", "b2", box("b", 2), box("b", 10))
    deliver("three", "c1", box("c", 2))
    deliver("three", "d1", box("d", 2).limit(15))
    deliver("three", "a1", box("a", 2))
    late = ("a", "arrived after its verdict", None)
    assert run() == (["a", "b", "c"], [late, wrong, lost])
    waiting = spark.read.parquet(max((tmp_path / "out" / "ledger").iterdir(), key=lambda p: int(p.name.split("=")[1])).as_posix())
    assert {r["case_id"] for r in waiting.collect()} == {"d"}
    # The manifest of d is corrected.
    expect(d=15)
    assert run() == (["a", "b", "c", "d"], [late, wrong, lost])
    assert {r["verdict"] for r in spark.read.parquet(f"{out}/verdicts").collect()} <= {"pass", "flagged-for-review", "fail"}


def test_runs_over_different_cases_are_not_compared(spark):
    modes = spark.createDataFrame([("a", "x", 1, 0.5), ("a", "y", 1, 0.1), ("b", "x", 1, 0.2), ("c", "y", 1, 0.2), ("c", "x", 2, 0.2)], "run_id string, case_id string, mode int, value double")
    summary = compare.run_summary(modes)
    assert summary.filter("run_id = 'b'").count() == 8
    assert [tuple(r) for r in summary.filter("run_id = 'a' AND mode = 3").select("n_cases", "n_with_value", "mean").collect()] == [(2, 0, None)]
    side = lambda r: summary.filter(F.col("run_id") == r)
    assert compare.compare_runs(side("a"), side("c")).count() == 8
    with pytest.raises(ValueError, match="different cases"):
        compare.compare_runs(side("a"), side("b"))


def test_empty_candidate_is_a_candidate(spark):
    grids = boxes.grids(spark, [(c, boxes.SIZE, (1, 1, 1), "RAS") for c in ("a", "b", "c")])
    gt = boxes.voxels(spark, [("a", 20, (2, 8), (2, 8), (2, 8)), ("a", 21, (2, 8), (2, 8), (10, 16)), ("c", 20, (2, 8), (2, 8), (2, 8))])
    expected = spark.createDataFrame([(c, "pass", [], [], None, None) for c in ("a", "b", "c")],
        "case_id string, expected_verdict string, expected_rule_ids array<string>, expected_labels array<int>, failure_mode int, failure_mode_name string")
    listed = spark.createDataFrame([("a",), ("b",)], "case_id string")
    run = evaluate.evaluate(gt, gt.limit(0), grids, expected, candidate_cases=listed)
    rows = {(r.case_id, r["mode"]): (r.value, r.detail) for r in run.modes.collect()}
    assert [rows["a", m][0] for m in (1, 4, 5)] == [0.0, 0.0, 2.0]
    assert rows["b", 1] == (None, "gt has no foreground voxels") and [rows["b", m][0] for m in (4, 5)] == [0.0, 0.0]
    assert rows["c", 1] == (None, "mode 1 needs both candidate and gt; at least one is missing")
    assert rows["c", 4][0] is None and rows["c", 2][0] == 1.0


def test_conventions_with_faults(spark):
    with pytest.raises(ValueError, match="labels 1 and 2"):
        levels(spark, {1: "C1", 2: " c1"})
    with pytest.raises(ValueError, match="not an integer"):
        levels(spark, {"1": "C1"})
