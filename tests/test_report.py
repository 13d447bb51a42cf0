import hashlib
import json

import pytest
from pyspark.sql import functions as F

from gaugeworks.plans import report as rp
from gaugeworks.sources import records as rc
from gaugeworks.sources import reports as src

from .test_records_and_ledger import GOOD


def record(**more):
    return GOOD | {"diff": "diff --git a/a b/a\n", "score": {"valid": True, "progress": 1.0, "credible_progress": 1.0, "cheats": []}, "config": {"model_id": "m1"}, "tool_calls": {"read_file": 4, "edit_file": 1}} | more


BAD_SCORE = {"valid": True, "progress": 1.0, "credible_progress": 0.0, "cheats": ["pin_changed"]}


@pytest.fixture(scope="module")
def runs(spark):
    docs = [record()] * 6 + [record(score=BAD_SCORE, outcome="solved_with_cheats")] * 3 + [record(diff=" \n", score={"valid": False}, outcome="no_verdict")] * 2 + [record(config={"model_id": "m2"}, max_iterations=5, cost_known=False)] * 9
    docs += [record(score={}, outcome="harness_error", tool_calls={})] + [record(task_id="smoke", hallucinated_tools=["fly"])]
    df = spark.createDataFrame([(f"{i}.json", json.dumps(d)) for i, d in enumerate(docs)], "name string, value string")
    records, bad = rc.load(df)
    assert bad.count() == 0
    tasks = spark.createDataFrame([("002-databases", False), ("smoke", True)], "id string, is_smoke_test boolean")
    return rp.runs(records, tasks)


def test_views(runs):
    rates = {r.model_id: (r.k, r.n) for r in rp.flag_rates(runs).collect()}
    assert rates == {"m1": (3, 9), "m2": (0, 9)}
    d = rp.denominators(runs).first()
    assert (d.k_narrow, d.n_narrow, d.k_broad, d.n_broad, d.n_unpatched) == (3, 18, 3, 18, 2)
    m = rp.measured(runs).first()
    assert (m.runs, m.tasks, m.models) == (22, 2, 2) and m.cost == pytest.approx(13 * 0.5)
    e = {r.max_iterations: (r.n, r.mean_reads, r.never_wrote) for r in rp.effort(runs).collect()}
    assert e[5] == (9, 4.0, 0) and e[50][0] == 13 and e[50][2] == 1
    f = {r.name: r.k for r in rp.failures(runs).collect()}
    assert f == {"unattributed": 2, "invented_tool": 1, "harness_error": 1, "broke_suite": 0}
    c = {(r.task_id): (r.n, r.n_scored, r.k_scored, r.n_unscoreable) for r in rp.cells(runs).collect()}
    assert c == {"002-databases": (21, 18, 3, 3), "smoke": (1, 1, 0, 0)}
    assert {r["class"]: r.n for r in rp.outcome_classes(runs).groupBy("class").agg(F.sum("n").alias("n")).collect()} == {"solved cleanly": 16, "green but flagged": 3, "no verdict or broke the suite": 3}
    assert rp.model_differences(runs).count() == 1
    assert rp.costs(runs, ["model_id"]).first().upper_median == 0.5
    assert rp.ladder(runs).count() == 0


def test_config_digest(spark):
    text = '{"b": 1, "a": [1, "é"]}'
    want = hashlib.sha256(json.dumps(json.loads(text), sort_keys=True).encode()).hexdigest()[:12]
    assert [r.d for r in spark.createDataFrame([(text,), (None,)], "t string").select(rp.config_digest("t").alias("d")).collect()] == [want, None]


def test_calibration(spark):
    label = lambda v, at="2026-01-01T00:00:00": {"agent_relative": v, "at": at}
    pairs = [{"id": f"p{i}", "agent_position": "ab"[i % 2], "human": label("equivalent" if i % 4 else "agent_wrong"), "judge": {"j": {"verdict": "agent_wider" if i % 4 else "agent_wrong"}}} for i in range(12)]
    pairs[0]["relabel"] = label("agent_wrong", "2026-01-07T23:00:00")
    pairs[1]["relabel"] = label("equivalent", "2026-01-09T00:00:00")
    docs = spark.createDataFrame([("l", json.dumps({"version": 2, "pairs": pairs}))], "name string, value string")
    p = src.label_pairs(docs)
    got = {(r.rater, r.classes): r for r in rp.calibration(rp.labels_long(p)).collect()}
    assert got["j", 2].kappa == pytest.approx(1.0) and got["j", 2].standing == "quotable" and got["j", 7].observed == pytest.approx(3 / 12) and got["relabel", 7].n == 2
    assert [(r.id, r.days) for r in rp.too_early(p).collect()] == [("p0", 6)]
    opens = rp.retest_opens(p).first()
    assert str(opens.opens).startswith("2026-01-08") and opens.pending == 10
    b = rp.position_bias(p).first()
    assert (b.k1, b.n1, b.k2, b.n2) == (3, 6, 0, 6)


def test_pending_cells(spark):
    matrix = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    usable = spark.createDataFrame([("a", True), ("b", False)], "name string, usable boolean")
    assert {r.name: r.state for r in rp.pending_cells(matrix, usable).collect()} == {"a": "complete", "b": "unusable", "c": "pending"}


def test_fingerprints_are_of_what_changes_a_run(spark):
    import json

    from gaugeworks.functions import fingerprints as fp

    base = {"model_id": "m", "tool_signature": [["b", "x"], ["a", "y"]], "system_prompt": "p é", "max_iterations": 5, "max_cost_usd": 1, "max_wall_seconds": 9.5, "test_command": "t", "image_id": "i", "max_tokens": 1, "max_file_lines": 2, "max_search_hits": 3}
    same = [base, dict(reversed(base.items())), base | {"tool_signature": [["a", "y"], ["b", "x"]]}, base | {"max_cost_usd": 1.0000000001, "provider_route": "", "announce_budget": False, "label": "by hand"}]
    other = [base | {k: v} for k, v in (("system_prompt", "q"), ("max_iterations", 6), ("max_cost_usd", 1.1), ("provider_route", "r"), ("announce_budget", True), ("tool_signature", [["a", "y"]]))]
    lacking = [{k: v for k, v in base.items() if k != gone} for gone in base]
    texts = [json.dumps(c) for c in [*same, *other, base | {"model_id": "n"}, *lacking]] + ["[]", "{", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, c string").select("i", fp.fingerprint(F.col("c")).alias("a"), fp.fingerprint_less_model(F.col("c")).alias("b")).orderBy("i")
    rows = df.collect()
    assert len({r.a for r in rows[:4]}) == 1 == len({r.b for r in rows[:4]}) and len({r.a for r in rows[:11]}) == 8
    assert rows[10].b == rows[0].b and len({r.b for r in rows[:11]}) == 7
    assert all(r.a is None and r.b is None for r in rows[11:])


def _pairs(spark, human, relabelled=0, judges=("j",)):
    pairs = [(i, (h, n) if h else None, (h, n) if i < relabelled else None, {j: {"verdict": "equivalent"} for j in judges}) for i, (h, n) in enumerate(human)]
    s = "struct<agent_relative:string, neutral:string>"
    return spark.createDataFrame(pairs, f"id int, human {s}, relabel {s}, judge map<string, struct<verdict:string>>")


def test_calibration_is_published_when_complete(spark):
    read = [("equivalent", "x"), ("agent_wrong", "x"), ("equivalent", "skip"), ("agent_wrong", None)]
    p = _pairs(spark, read, 1)
    two, none = p.where("id < 1"), p.where("id < 0")
    got = rp.calibration_progress(p, ["j"], two).first()
    assert (got.pairs, got.labelled, got.skipped, got.usable, got.judged, got.sampled, got.retested, got.complete) == (4, 4, 1, 3, {"j": 3}, 1, 1, True)
    for pairs, judges, sampled in ((p, ["j", "k"], two), (p, ["j"], none), (p, ["j"], p.where("id < 2")), (_pairs(spark, [*read, (None, None)], 1), ["j"], two), (none, ["j"], none)):
        assert not rp.calibration_progress(pairs, judges, sampled).first().complete
    cut = rp.calibration(rp.labels_long(p)).withColumns({"kappa_low": F.lit(0.0), "kappa_high": F.lit(1.0)})
    assert rp.headline(cut, rp.calibration_progress(p, ["j"], two)).count() == cut.where("classes = 2").count() > 0
    assert rp.headline(cut, rp.calibration_progress(p, ["j"], none)).count() == 0


def test_intervals_stand_beside_kappas(spark):
    rows = [(i, r, v) for i in range(40) for r, v in (("human", "equivalent" if i % 2 else "agent_wrong"), ("good", "agent_wider" if i % 2 else "agent_wrong"), ("one", "equivalent"), ("mute", "unclear"))]
    rows += [(i, "same", "equivalent") for i in range(1, 40, 2)]  # meets one class only: no kappa in any draw
    got = {(r.rater, r.classes): r for r in rp.calibration_intervals(spark.createDataFrame(rows, "id int, rater string, verdict string"), n_boot=200).collect()}
    assert (got["good", 2].kappa, got["good", 2].kappa_low, got["good", 2].kappa_high) == (1.0, 1.0, 1.0)
    assert got["good", 7].kappa_low < got["good", 7].kappa < got["good", 7].kappa_high
    assert got["one", 2].kappa == 0.0 and got["same", 2].kappa_low is None and got["mute", 2].n == 0 and got["mute", 2].kappa_low is None


def test_an_empty_arm_is_an_error_if_asked(spark):
    p = spark.createDataFrame([("a", ("equivalent",)), ("a", ("agent_wrong",)), ("b", ("unclear",))], "agent_position string, human struct<agent_relative:string>")
    assert rp.position_bias(p).first().difference is None
    with pytest.raises(Exception, match="0 successes of 0"):
        rp.position_bias(p, strict=True).collect()
    with pytest.raises(Exception, match="a position is a or b, not c"):
        rp.position_bias(p.withColumn("agent_position", F.lit("c")), strict=True).collect()


def test_families_and_allowances(spark, runs):
    assert [r.within_family for r in rp.model_differences(runs, {"m1": "m2"}).collect()] == [True]
    assert [r.within_family for r in rp.model_differences(runs, {}).collect()] == [False] and rp.measured(runs, {"m1": "f"}).first().families == 2
    calls = spark.createDataFrame([("a", 100), ("a", None), ("b", 7), ("b", 7), ("b", 5)], "judge string, max_tokens int")
    assert {r.judge: (r.limits, r.recorded) for r in rp.allowances(calls, 50).collect()} == {"a": ([50, 100], False), "b": ([5, 7], True)}
