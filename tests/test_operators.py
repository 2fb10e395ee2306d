"""Selection, budgets, paging, writes, enrichment and the event log on small cases."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from assaykit.functions import enrich as N
from assaykit.operators import checks as C
from assaykit.operators import curation as K
from assaykit.operators import ledger as L
from assaykit.operators import runs as R
from assaykit.operators import writes as W
from assaykit.sources import files as S
from assaykit.streaming import events as E

CAND = "run_id int, candidate_id int, attempt int, slot int, composite double, passed boolean, technical_pass boolean, text_pass boolean, product_pass boolean, context_pass boolean, composition_pass boolean"


def test_select_best_and_base(spark):
    t, f = True, False
    rows = [(1, 1, 0, 0, 0.9, t, t, t, t, t, None), (1, 2, 0, 1, 0.95, t, t, t, t, t, None), (1, 3, 1, 0, 0.95, t, t, t, t, t, None), (1, 4, 1, 1, 1.0, f, t, f, t, t, None), (2, 5, 0, 0, 0.9, None, t, t, t, None, None)]
    assert [(r.run_id, r.candidate_id) for r in R.select_best(spark.createDataFrame(rows, CAND)).collect()] == [(1, 2)]
    rows = [(1, 1, 0, 0, 0.99, f, t, t, f, f, None), (1, 2, 0, 1, 0.9, f, t, t, f, t, None), (1, 3, 1, 0, 1.0, f, f, None, None, None, None), (1, 4, 1, 1, 0.5, f, t, f, t, t, None), (2, 5, 0, 0, 0.7, f, t, f, t, t, None), (2, 6, 0, 1, 0.8, f, t, f, t, t, None)]
    assert sorted((r.run_id, r.candidate_id) for r in R.choose_base(spark.createDataFrame(rows, CAND)).collect()) == [(1, 4), (2, 6)]


def test_pages(spark):
    at = dt.datetime(2026, 1, 1)
    runs = spark.createDataFrame([(i, at if i < 4 else at + dt.timedelta(hours=i)) for i in range(1, 6)], "run_id bigint, created_at timestamp")
    seen, cursor = [], None
    while True:
        rows = R.page(runs, 2, cursor).collect()
        seen.append([r.run_id for r in rows[:2]])
        if len(rows) <= 2:
            break
        cursor = R.make_cursor(str(rows[1].created_at), rows[1].run_id)
    assert seen == [[5, 4], [3, 2], [1]]
    with pytest.raises(ValueError, match="cursor"):
        R.page(runs, 2, "nonsense")


def test_percentiles_round_half_to_even(spark):
    df = spark.createDataFrame([(i,) for i in (10, 20, 30, 40)], "x int")
    assert R.nearest_rank(df, "x", 0.5).first().value == 30  # place 1.5 goes to 2
    assert R.nearest_rank(df.where("x < 25"), "x", 0.5).first().value == 10  # place 0.5 goes to 0


def calls(spark, rows):
    at = dt.datetime(2026, 1, 1)
    return spark.createDataFrame([(i, "r", at + dt.timedelta(seconds=s), c, st) for i, (s, c, st) in enumerate(rows)], "call_id bigint, run_id string, created_at timestamp, est_cost_usd double, status string")


def test_budget_walk(spark):
    df = calls(spark, [(0, 0.034, "ok"), (1, 0.034, "ok"), (2, 0.067, "ok"), (3, 0.067, "ok"), (4, 0.067, "ok"), (5, 0.034, "ok"), (200, 0.0, "ok")])
    rows = L.budget_walk(df, 0.25, 5, 150_000).orderBy("call_id").collect()
    assert [r.blocked_by for r in rows] == [None, None, None, None, "budget", None, "deadline"]
    assert [r.warned for r in rows] == [False, False, False, True, False, False, False] and rows[3].spent == 0.202
    assert L.budget_walk(df, 10.0, 1, 150_000).orderBy("call_id").collect()[1].blocked_by == "calls"


def test_checks_are_worked_out_in_one_pass(spark, sf_dir):
    from assaykit.sources import bridge

    df = bridge.table(spark, sf_dir, "v_checks")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    plain = spark.sql(bridge.VIEWS["v_checks"], v_candidates=bridge.table(spark, sf_dir, "v_candidates"))
    assert df.columns == plain.columns and df.dtypes == plain.dtypes
    assert df.exceptAll(plain).count() == 0 and plain.exceptAll(df).count() == 0


def test_checks_of_an_empty_text(spark):
    from assaykit.plans import operations  # noqa: F401  registers them

    df = spark.createDataFrame([(1, ""), (2, None), (3, "ab1\n")], "item_id bigint, body string")
    rows = C.run_checks(df, "item_id", ["length", "digits", "lines"]).collect()
    got = {(r.item_id, r.check_name): (r.passed, str(r.value)) for r in rows}
    assert got == {
        (1, "length"): (False, "0.0"), (1, "digits"): (True, "nan"), (1, "lines"): (False, "0.0"),
        (2, "length"): (None, "None"), (2, "digits"): (None, "None"), (2, "lines"): (None, "None"),
        (3, "length"): (False, "4.0"), (3, "digits"): (False, "0.75"), (3, "lines"): (True, "1.0"),
    }


def test_budget_warning_at_just_the_share(spark):
    df = spark.createDataFrame([(1, n, dt.datetime(2026, 1, 1, 0, n), 0.6) for n in (1, 2)], "run_id bigint, call_id bigint, created_at timestamp, est_cost_usd double")
    assert [r.warned for r in L.budget_walk(df, 1.5, 40, 10**9).orderBy("call_id").collect()] == [False, True]


def test_rate_limit_holds_slots_for_admitted_calls_only(spark):
    df = calls(spark, [(s, 0.0, "ok") for s in (0, 10, 20, 30, 61, 62)])
    rows = L.rate_limit(df, "run_id", 2, 60).orderBy("call_id").collect()
    assert [(r.admitted, r.retry_after) for r in rows] == [(True, None), (True, None), (False, 40), (False, 30), (True, None), (False, 8)]


def test_breaker(spark):
    df = calls(spark, [(0, 0.0, "error"), (1, 0.0, "blocked"), (2, 0.0, "error"), (3, 0.0, "ok"), (33, 0.0, "error"), (34, 0.0, "ok"), (64, 0.0, "ok"), (65, 0.0, "error")])
    rows = L.breaker_states(df, "run_id", 2, 30).orderBy("call_id").collect()
    assert [r.state for r in rows] == ["closed", "closed", "closed", "open", "half_open", "open", "half_open", "closed"]


def test_longest_prefix_price(spark):
    c = spark.createDataFrame([(1, "image-flash", "image", 2.0), (2, "image-lite-x", "image", 1.0), (3, "text", "tokens", 2e6), (4, "other", "image", 5.0), (5, "text", "image", 1.0)], "call_id int, model string, unit_type string, units double")
    p = spark.createDataFrame([("image", "image", 0.067), ("image-lite", "image", 0.034), ("te", "tokens", 0.5)], "prefix string, unit_type string, price double")
    assert {r.call_id: r.cost for r in L.price_calls(c, p).collect()} == {1: 0.134, 2: 0.034, 3: 1.0, 4: 0.0, 5: 0.0}


def test_writes(spark):
    t = spark.createDataFrame([(1, None, "a"), (2, "x", "b")], "id int, k string, v string")
    c = spark.createDataFrame([(1, None, "new"), (3, None, "c")], "id int, k string, v string")
    assert sorted(r.v for r in W.upsert(t, c, ["id", "k"]).collect()) == ["b", "c", "new"]
    runs = spark.createDataFrame([(1, "held", 7), (2, "passed", 8), (3, "held", None), (4, "approved", 9), (5, "passed", 9)], "run_id int, status string, shown_id int")
    d = spark.createDataFrame([(1, 1, "approve", "looks right"), (2, 2, "reject", None), (3, 3, "approve", "looks right"), (4, 4, "reject", "no"), (5, 1, "approve", " x "), (6, 9, "approve", None), (7, 5, "approve", None)], "decision_id int, run_id int, action string, reason string")
    got = {r.decision_id: (r.accepted, r.error, r.new_status, r.is_override, r.labels) for r in W.apply_decisions(runs, d).collect()}
    assert got[1] == (True, None, "approved", True, "all") and got[2] == (True, None, "rejected", True, "overall") and got[7] == (True, None, "approved", False, None)
    assert [got[i][1] for i in (3, 4, 5, 6)] == ["no_candidate", "not_decidable", "reason_required", "not_found"]
    snap = spark.createDataFrame([("a", 1), ("b", 2)], "key string, output int")
    assert W.replay(snap.select("key"), snap).count() == 2
    with pytest.raises(KeyError, match="c"):
        W.replay(spark.createDataFrame([("a",), ("c",)], "key string"), snap)
    with pytest.raises(ValueError, match="share ids"):
        K.keep_generated(snap.withColumnRenamed("key", "item_id"), snap.withColumnRenamed("key", "item_id"), spark.createDataFrame([("b",)], "item_id string"))


def test_seasons(spark):
    countries = spark.createDataFrame([("AU", "temperate", "S", []), ("US", "temperate", "N", []), ("SG", "tropical", "N", [11, 12, 1]), ("AE", "arid", "N", [])], "country string, climate string, hemisphere string, wet array<int>")
    terms = spark.createDataFrame([("december", 1, "month", [12]), ("summer", 1, "named_season", [6, 7, 8]), ("july", 1, "month", [7])], "key string, priority int, kind string, months array<int>")
    cases = [("AU", "December", "summer"), ("US", "December", "winter"), ("SG", "early December", "wet"), ("SG", "July", "dry"), ("AE", "July", "hot"), ("AE", "late december", "mild"), ("AU", "Summer", "summer"), ("US", "this summer", "summer"), ("AU", "someday", "unspecified"), ("XX", "July", "unspecified")]
    briefs = spark.createDataFrame([(i, c, p) for i, (c, p, _) in enumerate(cases)], "brief_id int, country string, phrase string")
    assert {r.brief_id: r.season for r in N.effective_season(briefs, countries, terms).collect()} == {i: s for i, (_, _, s) in enumerate(cases)}
    assert N.effective_season(briefs, countries, terms).where("brief_id = 6").first().months == "12,1,2"


def test_boxes(spark):
    b = spark.createDataFrame([(1, 1, 0.1, 0.1, 0.3, 0.3), (1, 2, 0.8, 0.8, 0.9, 0.9), (2, 3, 0.0, 0.0, 1.0, 1.0)], "image_id int, box_id int, x0 double, y0 double, x1 double, y1 double")
    z = spark.createDataFrame([(1, 9, 0.15, 0.05, 0.6, 0.4), (1, 8, 0.915, 0.8, 1.0, 0.9), (3, 7, 0.0, 0.0, 1.0, 1.0)], "image_id int, zone_id int, x0 double, y0 double, x1 double, y1 double")
    got = {(r.box_id, r.zone_id): (r.centre_in, r.half_in, r.near, r.crowding) for r in N.box_relations(b, z).collect()}
    assert got == {(1, 9): (True, True, True, True), (2, 8): (False, False, True, False)}
    row = spark.createDataFrame([([100, 200, 300, 400],)], "b array<int>").select(N.box_from_thousandths(F.col("b")).alias("x")).select("x.*").first()
    assert tuple(row) == (0.2, 0.1, 0.4, 0.3)


def events(spark, rows):
    return spark.createDataFrame(rows, "run_id bigint, seq bigint, type string, payload string")


LOG = [(1, 1, "run.created", ""), (1, 2, "plan.done", ""), (1, 3, "candidate.created", ""), (1, 4, "repair.planned", ""), (1, 5, "candidate.created", ""), (1, 6, "repair.planned", ""), (1, 7, "run.finished", ""), (2, 1, "run.created", ""), (2, 2, "plan.done", "")]


def test_folding_doesnt_mind_order_or_copies(spark):
    plain = sorted(map(tuple, E.fold_runs(events(spark, LOG)).collect()))
    mixed = sorted(map(tuple, E.fold_runs(events(spark, LOG[::-1] + LOG[2:5])).collect()))
    assert plain == mixed and plain[0] == (1, 7, "run.finished", 7, 2, 0, 2, 1, "finished") and plain[1][-1] == "active"
    assert [r.seq for r in E.replay_after(events(spark, LOG), 1, 5).collect()] == [6, 7]
    with pytest.raises(ValueError):
        E.replay_after(events(spark, LOG), 1, -1)
    early = E.fold_runs(events(spark, LOG[:3]))
    moved = {r.run_id: (r.last_seq, r.status) for r in E.merge_snapshot(early, events(spark, LOG)).collect()}
    assert moved == {1: (7, "finished"), 2: (2, "active")}
    late = E.fold_runs(events(spark, LOG))
    again = {r.run_id: (r.last_seq, r.status) for r in E.merge_snapshot(late, events(spark, LOG[:2])).collect()}
    assert again == moved
    states = {(r.run_id, r.step): r.state for r in E.timeline(events(spark, LOG)).collect()}
    assert states[1, "repair"] == "done" and states[1, "evaluate"] == "skipped" and states[2, "plan"] == "running" and states[2, "generate"] == "pending"


def test_parsing_drops_what_it_doesnt_know(spark):
    lines = ['{"run_id": 1, "seq": "1", "type": "run.created"}', '{"run_id": 1, "seq": "x", "type": "run.created"}', '{"run_id": 1, "seq": 2, "type": "other"}', "no json", None]
    raw = spark.createDataFrame([(x,) for x in lines], "value string")
    assert E.parse_events(raw).count() == 1
    assert tuple(E.dropped_events(raw).first()) == (5, 4)


def test_label_files(spark, tmp_path):
    path = tmp_path / "l.csv"
    path.write_text("﻿image_sha,set,brief_id,technical,text,product,context,composition,notes,rubric_version\na,nat,B1,Pass,0,Y,,maybe,n,\na,nat,B1,fail,1,,,,later,2\n,nat,B1,ok,ok,ok,ok,ok,,\n", encoding="utf-8")
    rows = S.read_labels(spark, str(path)).collect()
    assert len(rows) == 1 and (rows[0].technical, rows[0].text, rows[0].product, rows[0].rubric_version, rows[0].notes) == (False, True, None, "2", "later")
    assert S.read_manifest(spark, str(tmp_path / "none.jsonl")).count() == 0
    bad = tmp_path / "m.jsonl"
    bad.write_text('{"id": "1", "country": "NO"}\n\n{"id": "2"}\n')
    assert [(r.id, r.country, r.aspect_ratio) for r in S.read_manifest(spark, str(bad)).orderBy("id").collect()] == [("1", "NO", "1:1"), ("2", None, "1:1")]


def test_reports_keep_their_baseline(spark, tmp_path):
    for value in (1, 2):
        S.write_report(spark.createDataFrame([(value,)], "x int"), str(tmp_path), f"r{value}")
    read = lambda n: spark.read.text(f"{tmp_path}/{n}").first()[0]
    assert read("latest") == '{"x":2}' and read("baseline") == '{"x":1}' and read("r1") == '{"x":1}'
    S.write_report(spark.createDataFrame([(3,)], "x int"), str(tmp_path), "r3", reset=True)
    assert read("baseline") == '{"x":3}'


def test_table_versions_dont_depend_on_order(spark):
    df = spark.range(500).selectExpr("id", "CASE WHEN id % 7 = 0 THEN NULL ELSE cast(id AS string) END AS s")
    a, b = (K.dataset_version({"t": x}).first().version for x in (df, df.orderBy(F.desc("id")).repartition(7)))
    assert a == b != K.dataset_version({"t": df.limit(499)}).first().version


def test_triage_takes_the_first_route(spark):
    t, f, n = True, False, None
    names = "technical_pass text_pass product_pass context_pass composition_pass composition_judged repairs text_repairs affordable stray in_zone overlay"
    base = dict(zip(names.split(), (t, t, t, t, t, t, 0, 0, t, f, f, f)))
    cases = [
        ({}, "passed", "approve"),
        ({"technical_pass": n}, "technical", "regenerate"),
        ({"technical_pass": f, "repairs": 2}, "exhausted", "needs_review"),
        ({"product_pass": f, "context_pass": f}, "product", "repair_product"),
        ({"context_pass": f, "composition_pass": f}, "context", "repair_context"),
        ({"context_pass": f, "affordable": f}, "exhausted", "needs_review"),
        ({"composition_pass": f, "product_pass": n}, "composition", "repair_composition"),
        ({"composition_pass": n}, "unverified", "needs_review"),
        ({"composition_pass": n, "composition_judged": f}, "passed", "approve"),
        ({"context_pass": n, "repairs": 2}, "unverified", "needs_review"),
        ({"text_pass": f, "stray": t}, "text_outside_zone", "clean_plate"),
        ({"text_pass": f, "in_zone": t, "repairs": 2}, "exhausted", "needs_review"),
        ({"text_pass": f, "overlay": t}, "overlay_only", "overlay"),
        ({"text_pass": f}, "text_in_zone", "repair_text"),
        ({"text_pass": f, "text_repairs": 1}, "text_exhausted", "overlay"),
        ({"text_pass": n}, "text_exhausted", "overlay"),
    ]
    schema = "evaluation_id int, " + ", ".join(f"{c} {'int' if 'repairs' in c else 'boolean'}" for c in names.split())
    df = spark.createDataFrame([(i, *(base | c).values()) for i, (c, _, _) in enumerate(cases)], schema)
    got = {r.evaluation_id: (r.route, r.action) for r in C.triage(df).collect()}
    assert got == {i: (route, action) for i, (_, route, action) in enumerate(cases)}


def test_lineage_keeps_every_candidate(spark):
    chain = [(1, i, i - 1 if i else None, i, 0) for i in range(15)] + [(1, 100, 0, 3, 1), (1, 101, 999, 0, 1), (2, 200, 201, 0, 0), (2, 201, 200, 0, 1)]
    df = spark.createDataFrame(chain, "run_id int, candidate_id int, parent_id int, attempt int, slot int")
    got = {r.candidate_id: r.label for r in R.lineage(df).collect()}
    assert all(got[i] == "A" + "′" * i for i in range(15)) and got[100] == "A′′" and got[101] == "B" and len(got) == 19
    assert got[200] == "A" and got[201] == "A′"  # a ring starts at its smallest id


def test_lineage_of_any_depth(spark):
    rows = [(1, i, i - 1 if i else None, i, 0) for i in range(1000)]  # a chain
    rows += [(2, 2000 + i, 2000 + (i + 1) % 7, i, 0) for i in range(7)] + [(2, 2100 + i, 2000 if not i else 2099 + i, 9, i) for i in range(40)]  # a ring and a chain that hangs on it
    rows += [(3, 3000, 3000, 0, 0)]  # its own parent
    rows += [(4, 4000, None, 0, 0), (4, 4001, None, 0, 1), (4, 4002, None, 1, 0), (4, 4003, None, 1, 1), (4, 4004, 4001, 2, 0), (4, 4005, None, 2, 1)]
    df = spark.createDataFrame(rows, "run_id int, candidate_id int, parent_id int, attempt int, slot int")
    repairs = spark.createDataFrame([(4000, 4002), (4001, 4004), (4002, None)], "from_id int, result_id int")
    fallbacks = spark.createDataFrame([(4002, 4003), (None, 4005)], "source_id int, result_id int")
    got = {r.candidate_id: (r.label, r.depth) for r in R.lineage(df, repairs, fallbacks).collect()}
    assert len(got) == len(rows) and all(got[i] == ("A" + "′" * i, i) for i in range(1000))
    assert got[2000][0] == "A" and [got[2000 + i][1] for i in range(7)] == [0, 6, 5, 4, 3, 2, 1]
    assert [got[2100 + i][1] for i in range(40)] == list(range(1, 41)) and got[3000] == ("A", 0)
    assert [got[4000 + i][0] for i in range(6)] == ["A", "B", "A′", "A′′", "B′", "C"]
    assert R.lineage(df.limit(0)).collect() == []


def plain_breaker(rows, failures, reset):
    bad, opened, out = 0, None, {}
    for at, call, status in sorted(rows):
        state = "closed" if opened is None else "half_open" if at - opened >= reset else "open"
        out[call] = state
        if state != "open" and status != "blocked":
            bad, opened = (0, None) if status == "ok" else (bad + 1, at if state == "half_open" or bad + 1 >= failures else opened)
    return out


def test_breaker_and_streaks_across_slots(spark):
    rng = random.Random(5)
    for reset in (30, 3_600, 400_000):
        rows, at = {"a": [], "b": []}, 0
        for call in range(600):
            at += rng.choice((0, 1, 20, 3_000, 40_000))
            rows[rng.choice("aab")].append((at, call, rng.choices(("ok", "error", "blocked"), (5, 4, 1))[0]))
        start = dt.datetime(2026, 1, 1)
        df = spark.createDataFrame([(c, k, start + dt.timedelta(seconds=s), st) for k in rows for s, c, st in rows[k]], "call_id bigint, model string, created_at timestamp, status string")
        got = {r.call_id: r.state for r in L.breaker_states(df, "model", 2, reset).collect()}
        assert got == plain_breaker(rows["a"], 2, reset) | plain_breaker(rows["b"], 2, reset)
        streaks = {}
        for k in rows:
            n = 0
            for _, c, st in sorted(rows[k]):
                n = 0 if st == "ok" else n + (st == "error")
                if st == "error":
                    streaks[c] = n
        assert {r.call_id: r.streak for r in L.failure_streaks(df).collect()} == streaks


class Kept(dict):
    """The state calls that the fold makes, over a dict."""

    containsKey, updateValue = dict.__contains__, dict.__setitem__

    def removeKey(self, key):
        del self[key]

    def exists(self):
        return "v" in self

    def get(self):
        return self["v"]

    def update(self, value):
        self["v"] = value


def test_stream_fold_keeps_only_what_is_out_of_order():
    import pandas as pd

    rng = random.Random(2)
    kinds = ["run.created", "candidate.created", "repair.planned", "candidate.evaluated"]
    for _ in range(40):
        log = [(i, "run.finished" if i == 20 else rng.choice(kinds)) for i in range(rng.choice((0, 1, 3)), 21)]
        sent = log + rng.choices(log, k=15)
        rng.shuffle(sent)
        folder = E.RunFolder()
        folder.beyond, folder.totals = Kept(), Kept()
        for at in range(0, len(sent), 4):
            got = next(folder.handleInputRows((7,), iter([pd.DataFrame(sent[at : at + 4], columns=["seq", "type"])]), None)).iloc[0]
        names = [k for _, k in log]
        assert tuple(got) == (7, 20, len(log), names.count("candidate.created"), names.count("repair.planned"), "finished")
        assert len(folder.beyond) == sum(not (log[0][0] <= 1 and 1 <= i <= 20) for i, _ in log)
