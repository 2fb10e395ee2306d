import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.operators import golden as G
from assaykit.operators import metrics as M
from assaykit.operators import reports as R
from assaykit.plans.reports import EMPTY


def test_exact_percentiles_against_sorting(spark):
    rng = np.random.default_rng(3)
    groups = {
        "one": [4.5], "two": [1.0, 2.0], "ties": [7.0] * 500 + [8.0] * 500, "small": list(rng.normal(size=11)), "many": list(rng.normal(size=30_000)),
        "skew": list(np.exp(rng.normal(size=20_000) * 9)), "whole": [float(x) for x in rng.integers(0, 40, 9_999)], None: [3.0, -1.0, 2.0, 2.0],
    }
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("small", None), ("small", float("nan")), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    ps = [0.0, 0.1, 0.5, 0.95, 0.999, 1.0]
    for accuracy in (50, 10_000):  # wide brackets and narrow ones
        got = {(r.g, r.p): (r.n, r.value) for r in R.exact_percentiles(df, "v", ps, "g", accuracy=accuracy).collect()}
        assert len(got) == len(groups) * len(ps)
        for g, values in groups.items():
            for p in ps:
                assert got[g, p][0] == len(values) and got[g, p][1] == pytest.approx(np.quantile(values, p), rel=1e-9, abs=1e-9), (g, p)
    near = {(r.g, r.p): r.value for r in R.exact_percentiles(df, "v", ps, "g", nearest=True).collect()}
    for g, values in groups.items():
        for p in ps:
            assert near[g, p] == sorted(values)[round(p * (len(values) - 1))]
    assert [r.value for r in R.exact_percentiles(df, "v", [0.5]).collect()] == [pytest.approx(np.median([v for x in groups.values() for v in x]))]
    assert R.exact_percentiles(df.where("g = 'empty'"), "v", [0.5], "g").count() == 0
    with pytest.raises(ValueError):
        R.exact_percentiles(df, "v", [50], "g")


OUT = "item_id long, item_set string, group_id string, status string, outcome string, first_attempt_pass boolean, repair_count long, cost_usd double, latency_ms long, text_verification string, exclude_native boolean, width int, height int, evaluated boolean"
CHECKS = "item_id long, name string, passed boolean, value double, note boolean"


def test_pipeline_report_by_hand(spark):
    rows = [
        (1, "final", "a", "passed", "native", True, 0, 0.1, 100, "ocr", False, 1024, 768, True),
        (2, "final", "a", "approved", "overlay", False, 2, 0.3, 300, "construction", False, 1025, 10, True),
        (3, "final", "b", "passed", "native", None, 1, None, 500, None, True, None, 10, True),
        (4, "final", "b", "failed", None, None, 0, 0.2, 900, "construction", False, 10, 10, False),
        (5, "nat", "b", "passed", "native", True, 0, 9.0, 9, "construction", False, 2000, 10, True),
    ]
    checks = [
        (1, "ocr_cer", True, 0.0, None), (1, "ocr_cer", False, 0.5, None), (1, "hue_drift", True, 0.1, True), (2, "hue_drift", True, None, True), (2, "vlm_label_subtext_preserved", True, None, True),
        (3, "ocr_cer", None, 0.0, None), (3, "hue_drift", True, 0.2, False), (4, "hue_drift", True, 0.2, True), (4, "ocr_cer", True, 0.0, None), (5, "hue_drift", True, 0.2, True), (9, "hue_drift", True, 0.2, True),
    ]
    outputs, told = spark.createDataFrame(rows, OUT), spark.createDataFrame(checks, CHECKS)
    r = R.pipeline_report(outputs, told).first().asDict()
    assert r == {
        "briefs": 4, "shipped": 3, "first_attempt_rate": 0.25, "after_repair_rate": 0.75, "exact_read": 1, "exact_built": 1, "exact_rate": 0.666667, "native_n": 2, "native_rate": 0.5, "mean_repairs": 0.75,
        "total_cost": 0.6, "cost_per_shipped": 0.2, "images_checked": 4, "resolution_rate": 0.5, "evaluated_n": 3, "label_note_rate": 0.333333, "drift_n": 2, "drift_rate": 0.5, "p50_ms": 300.0, "p95_ms": 480.0,
    }
    assert {x.group_id: (x.n, x.drift_rate) for x in R.drift_by_group(outputs, told).collect()} == {"a": (1, 1.0), "b": (1, 0.0)}
    assert {x.status: x.n for x in R.status_counts(outputs).collect()} == {"passed": 2, "approved": 1, "failed": 1}
    empty = R.pipeline_report(outputs.where("false"), told.where("false")).first()
    assert (empty.briefs, empty.shipped, empty.exact_rate, empty.p50_ms) == (0, 0, None, None)


def test_points_round_half_up(spark):
    df = spark.createDataFrame([(0.2, 0.45), (0.5, 0.5), (0.5, 0.625), (0.625, 0.5), (None, 0.1), (0.0, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(R.points(F.col("a"), F.col("b"))).collect()] == ["+25 pp", "±0 pp", "+13 pp", "−12 pp", None, "+100 pp"]


def test_tags(spark):
    schema = "item_id long, split string, label_source string, labels map<string,boolean>, dimensions map<string,boolean>"
    rows = [
        (1, "heldout", "human", {"text": True, "product": False}, {"text": True}), (2, "calibration", "human", {}, {"text": False}), (3, None, "assumed", {"text": False}, {"text": True}),
        (4, "heldout", "human", {"text": True}, {"text": None}),
    ]
    runs = spark.createDataFrame([(1, True, 2, "overlay", "needs_review"), (2, None, 0, "native", "passed")], "item_id long, first_attempt_pass boolean, repair_count long, outcome string, status string")
    got = {r.item_id: r.tags for r in R.derive_tags(spark.createDataFrame(rows, schema), runs).collect()}
    assert got == {
        1: ["held-out split", "human-labelled", "disagrees with human", "first-attempt pass", "repaired", "text fallback", "held for review"],
        2: ["calibration split", "human-labelled"], 3: ["calibration split"], 4: ["held-out split", "human-labelled", "disagrees with human"],
    }


FLAGS = "text boolean, product boolean, context boolean, composition boolean"


def test_golden_import_twice(spark):
    outputs = [
        ("a", "nat", 1, 7, 0, 0, "passed", "native", "pass", "ev"), ("b", "final", 1, 7, 1, 0, "passed", "native", "pass", "ev"), ("c", "nat", 2, 8, 0, 0, "held", None, None, "old"), ("c", "final", 2, 8, 0, 0, "held", None, None, "old"),
        ("d", "nat", 3, 9, 0, 0, "approved", "native", "pass", "ev"), ("e", "final", 4, 9, 0, 1, "approved", "overlay", "fail", "ev"), ("b", "final", 1, 7, 1, 0, "passed", "native", "pass", "ev"), (None, "final", 5, 9, 0, 1, "approved", None, None, None),
        ("f", "final", 6, 9, 0, 0, "passed", "native", "pass", "ev"), ("g", "final", 7, 9, 0, 0, "passed", "native", "pass", "ev"),
    ]
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    files = G.Files(
        make(outputs, "image_sha string, item_set string, run_id long, brief_id long, attempt int, slot int, status string, outcome string, verdict string, evaluator_version string"),
        make([("a", "1", True, False, None, None), ("z", "1", True, True, True, True)], f"image_sha string, rubric_version string, {FLAGS}"),
        make([("p", "b", "typo", False, True, True, None)], f"image_sha string, source_sha string, mutation string, {FLAGS}"),
        make([("a", "ev", "pass", True, True, True, True, None), ("c", "ev", "fail", True, False, True, True, None), ("z", "ev", "pass", True, True, True, True, None)], f"image_sha string, version string, verdict string, technical boolean, {FLAGS}"),
        make([("a", "ocr", True), ("a", "blank", None), ("a", "ocr", True)], "image_sha string, name string, passed boolean"),
    )
    known = {name: make([], schema) for name, schema in EMPTY.items()}
    known["runs"] = make([(6, 9, "passed", "native", 1, None)], EMPTY["runs"])
    known["candidates"] = make([(77, 70, "g", None, 0, 0)], EMPTY["candidates"])
    before = G.Tables(**known)
    assert {r.run_id: r.link for r in G.linked_runs(files.outputs.where("image_sha IS NOT NULL"), before).collect()} == {1: "create", 2: "create", 4: "create", 6: "id", 7: "image"}
    once = G.golden_import(files, before)
    twice = G.golden_import(files, once)
    for name in EMPTY:
        assert sorted(map(str, getattr(once, name).collect())) == sorted(map(str, getattr(twice, name).collect())), name
    ids = {(r.run_id, r.image_sha): r for r in once.candidates.collect()}
    assert set(ids) == {(1, "a"), (1, "b"), (2, "c"), (4, "e"), (70, "g")}
    assert ids[1, "b"].parent_id == ids[1, "a"].candidate_id and ids[1, "a"].parent_id is None and ids[4, "e"].parent_id is None
    runs = {r.run_id: (r.approved_id, r.best_id) for r in once.runs.collect()}
    assert runs == {1: (ids[1, "b"].candidate_id, None), 2: (None, ids[2, "c"].candidate_id), 4: (None, ids[4, "e"].candidate_id), 6: (1, None)}
    log = {}
    for r in once.events.orderBy("run_id", "seq").collect():
        log.setdefault(r.run_id, []).append((r.seq, r.type, r.status))
    assert [x[1] for x in log[1]] == ["run.status", "candidate.created", "evaluation.done", "candidate.created", "run.finished"] and log[1][-1] == (5, "run.finished", "passed")
    assert [x[1:] for x in log[2]] == [("run.status", "queued"), ("candidate.created", None), ("run.finished", "needs_review")]  # another version's report tells no checks
    found = sorted((r.image_sha, r.candidate_id is None, r.n_checks) for r in once.evaluations.collect())
    assert found == [("a", False, 2), ("a", True, 2), ("c", True, 0)]
    assert sorted((r.image_sha, r.labeller) for r in once.labels.collect()) == [("a", "human"), ("p", "planted")]
    assert {r.image_sha: r.origin for r in once.images.collect()} == dict.fromkeys("abcdefg", "golden") | {"p": "planted"}
    assert {r.name: r.n for r in twice.counts().collect()} == {"images": 8, "runs": 4, "candidates": 5, "labels": 2, "planted": 1, "evaluations": 3, "events": 11}


def test_golden_import_reads_its_files_once(spark, sf_dir):
    from assaykit.plans.reports import golden_files, golden_import

    plan = golden_import(spark, sf_dir)._jdf.queryExecution().optimizedPlan().treeString()
    assert "l_orderkey" not in plan and "doc_id" not in plan
    files = golden_files(spark, sf_dir)
    once = G.settled(files)
    nothing = G.Tables(**{name: spark.createDataFrame([], schema) for name, schema in EMPTY.items()})
    a, b = (sorted(map(str, G.golden_import(f, nothing).evaluations.collect())) for f in (files, once))
    assert a == b and once.checks.count() < files.checks.count()


def test_threshold_sweep_counts_rows_once(spark):
    from assaykit.operators import metrics as M

    rng = np.random.default_rng(8)
    rows = [(float(s), bool(x), "calibration" if c else "heldout") for s, x, c in zip(rng.integers(0, 20, 400), rng.random(400) < 0.5, rng.random(400) < 0.6)] + [(None, True, "heldout")]
    grid = [3.0, 10.0, 5.5, 10.0, 19.0]
    got = {r.split: r for r in M.threshold_sweep(spark.createDataFrame(rows, "score double, label boolean, split string"), grid).collect()}

    def figures(split, t):
        of = [(s < t, x) for s, x, c in rows if c == split and s is not None]
        return [sum(a is f and b is x for a, b in of) for f, x in ((True, False), (True, True), (False, False), (False, True))]

    f1 = lambda t: (lambda tp, fp, fn, tn: 2 * tp / (2 * tp + fp + fn))(*figures("calibration", t))
    best = max(sorted(set(grid)), key=f1)
    for split, r in got.items():
        assert r.threshold == best and [r.tp, r.fp, r.fn, r.tn] == figures(split, best)


def test_a_layer_with_all_checks_takes_the_dimensions_verdict(spark):
    t, f = True, False
    checks = spark.createDataFrame(
        [
            (1, "context", "snow", "vlm", f), (1, "context", "tree", "vlm", t),  # snow should be there only: the dimension passes
            (1, "text", "ocr", "deterministic", t), (1, "text", "judge", "vlm", None), (1, "technical", "blank", "deterministic", t), (1, "product", "shape", "vlm", t),
            (2, "text", "ocr", "deterministic", t),
        ],
        "item_id int, dimension string, check_name string, method string, passed boolean",
    )
    dims = spark.createDataFrame([(1, "context", t), (1, "text", f), (1, "technical", None), (1, "composition", t), (2, "text", f)], "item_id int, dimension string, passed boolean")
    got = {(r.item_id, r.dimension, r.layer): (r.verdict, r.n) for r in M.layer_verdicts(checks, dims).collect()}
    assert got == {
        (1, "context", "vlm"): (t, 2), (1, "context", "combined"): (t, 2),
        (1, "text", "deterministic"): (t, 1), (1, "text", "vlm"): (None, 1), (1, "text", "combined"): (f, 2),
        (1, "technical", "deterministic"): (None, 1), (1, "technical", "combined"): (None, 1),
        (1, "composition", "combined"): (t, 0),  # no layer has a check; product isn't assessed
        (2, "text", "deterministic"): (f, 1), (2, "text", "combined"): (f, 1),
    }
