import json
import random

import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import text as tx
from gaugeworks.operators import ledger as lg
from gaugeworks.operators import scoring as sc
from gaugeworks.sources import records as rc
from gaugeworks.sources import reports as rp
from gaugeworks.streaming.ledger import fold_stream, keyed_state, kept_entries

GOOD = {
    "schema_version": 3, "config_version": "abc123def456", "task_id": "002-databases", "model": "m", "outcome": "solved", "verdict_status": "ok", "diff": "", "failed_ids": [],
    "before_failed_ids": ["tests/test_db.py::test_1"], "iterations": 10, "cost_usd": 0.5, "cost_known": True, "max_iterations": 50, "max_cost_usd": 1.0,
}
BAD = {
    "corrupt.json": ("{", "JSON"), "list.json": ("[]", "object"), "v2.json": (GOOD | {"schema_version": 2}, "schema v2"), "v4.json": (GOOD | {"schema_version": 4}, "schema v4"),
    "unversioned.json": ({k: v for k, v in GOOD.items() if k != "schema_version"}, "schema v?"), "noconf.json": (GOOD | {"config_version": ""}, "config_version"),
    "unknown.json": (GOOD | {"extra": 1}, "unknown fields extra"), "text.json": (GOOD | {"failed_ids": "a,b"}, "failed_ids"), "twice.json": (GOOD | {"failed_ids": ["a", "a"]}, "duplicate"),
    "cost.json": (GOOD | {"cost_usd": "0.5"}, "cost_usd"), "bool.json": (GOOD | {"iterations": True}, "iterations"), "negative.json": (GOOD | {"iterations": -1}, "negative"),
    "outcome.json": (GOOD | {"outcome": "won"}, "outcome"), "exit.json": (GOOD | {"verdict_exit_code": "2"}, "verdict_exit_code"), "calls.json": (GOOD | {"tool_calls": {"a": 1.5}}, "tool_calls"),
    "score.json": (GOOD | {"score": []}, "score"), "trajectory.json": (GOOD | {"trajectory": {}}, "trajectory"), "model.json": (GOOD | {"model": "  "}, "model is empty"), "known.json": (GOOD | {"cost_known": 1}, "cost_known"),
}
FINE = {
    "a.json": GOOD, "b.json": GOOD | {"verdict_exit_code": None, "tool_calls": {"read": 3, "edit": 0}, "score": {}, "trajectory": [{"type": "x"}], "cost_usd": 1}, "c.json": GOOD | {"harness_error": "died", "before_errors": {"t": "E"}, "tool_calls": {}},
}


@pytest.fixture(scope="module")
def directory(tmp_path_factory):
    d = tmp_path_factory.mktemp("runs")
    for name, doc in (FINE | {k: v for k, (v, _) in BAD.items()} | {f"absent-{k}.json": {x: y for x, y in GOOD.items() if x != k} for k in rc.REQUIRED}).items():
        (d / name).write_text(doc if isinstance(doc, str) else json.dumps(doc))
    (d / ".hidden.json").write_text("{")
    (d / "notes.txt").write_text("x")
    return str(d)


def test_records_and_rejections_share_all_files(spark, directory):
    docs = rc.documents(spark, directory)
    records, rejections = rc.load(docs)
    assert {r.name for r in records.collect()} == set(FINE)
    bad = {r.name: r for r in rejections.collect()}
    assert set(bad) == set(BAD) | {f"absent-{k}.json" for k in rc.REQUIRED}
    for name, (_, reason) in BAD.items():
        assert reason in bad[name].reason, (name, bad[name].reason)
    for k in rc.REQUIRED:
        assert k in bad[f"absent-{k}.json"].missing
    a = {r.name: r for r in records.collect()}
    assert a["a.json"].before_failed_ids == GOOD["before_failed_ids"] and a["a.json"].tests_passed is None and a["b.json"].tool_calls == {"read": 3, "edit": 0} and a["b.json"].cost_usd == 1.0
    usable = {r.name: r.usable for r in rc.holds_measurement(docs).collect()}
    assert usable["a.json"] and not usable["c.json"] and not usable["v2.json"]
    assert {r.schema: r.n for r in rc.rejected_by_version(rejections).collect()}["2"] == 1


def test_saved_records_load_again(spark, directory, tmp_path):
    records, _ = rc.load(rc.documents(spark, directory))
    plain = records.where("name = 'a.json'").drop("name", "score", "config", "trajectory")
    rc.save(plain, str(tmp_path / "out"))
    again = spark.read.text(str(tmp_path / "out")).select(F.lit("x").alias("name"), "value")
    assert rc.load(again)[0].count() == 1
    with pytest.raises(Exception, match="can't be saved"):
        rc.save(plain.withColumn("config_version", F.lit("")), str(tmp_path / "bad"))


REPORT = {"exitcode": 1, "summary": {"total": 2}, "tests": [{"nodeid": "t::a", "outcome": "passed"}, {"nodeid": "t::b", "outcome": "failed", "call": {"longrepr": "x\nE   AttributeError: nope\n"}}]}


def test_reports(spark):
    cases = {
        "good": (REPORT, None), "no exit": ({k: v for k, v in REPORT.items() if k != "exitcode"}, "no exitcode"), "text exit": (REPORT | {"exitcode": "1"}, "not an integer"), "exit 2": (REPORT | {"exitcode": 2}, "exit 2"),
        "no tests": ({"exitcode": 1}, "outcomes"), "unknown": (REPORT | {"tests": [{"nodeid": "a", "outcome": "odd"}]}, "odd"), "twice": (REPORT | {"tests": [REPORT["tests"][0]] * 2}, "duplicate"),
        "total": (REPORT | {"summary": {"total": 3}}, "total"), "nameless": (REPORT | {"tests": [{"outcome": "failed"}], "summary": {}}, "no nodeid"), "corrupt": ("{", "JSON"),
    }
    docs = spark.createDataFrame([(k, v if isinstance(v, str) else json.dumps(v)) for k, (v, _) in cases.items()], "name string, value string")
    got = {r.name: r for r in rp.test_reports(docs).collect()}
    for k, (_, reason) in cases.items():
        assert (got[k].reason is None) if reason is None else reason in got[k].reason, (k, got[k].reason)
    good = got["good"]
    assert (good.passed, good.failed, good.failed_ids, good.errors, good.suppressed) == (1, 1, ["t::b"], {"t::b": "AttributeError: nope"}, 0)


def test_other_sources(spark, tmp_path):
    cov = spark.createDataFrame([("c", json.dumps({"files": {"./src/a.py": {"executed_lines": [1, 3]}}}))], "name string, value string")
    assert [(r.path, r.line) for r in rp.executed_lines(cov).orderBy("line").collect()] == [("src/a.py", 1), ("src/a.py", 3)]
    labels = lambda v: spark.createDataFrame([("l", json.dumps({"version": v, "pairs": [{"id": "p", "human": {"agent_relative": "equivalent"}}]}))], "name string, value string")
    assert rp.label_pairs(labels(2)).first().human.agent_relative == "equivalent"
    with pytest.raises(Exception, match="labels version 1"):
        rp.label_pairs(labels(1)).collect()
    sheet = spark.createDataFrame([("| `0a1b2c` | equivalent | a | b |",), ("| token | verdict | why |",), ("text",)], "value string")
    assert [tuple(r) for r in rp.sheet_rows(sheet).collect()] == [("0a1b2c", "equivalent", "a | b")]
    for k in range(3):
        (tmp_path / f"m{k}.json").write_text(json.dumps({"started": f"2026-01-0{k + 1}T08:00:00+00:00", "finished": "2026-01-09T00:00:00+00:00", "matrix": {"cells": 8}, "jobs": 1, "ledger": {"settled": 0.5}, "outcome": {"completed": ["a"]}} | ({"git_dirty": True} if k else {})))
    (tmp_path / "broken.json").write_text("{")
    m = rp.manifests(rc.documents(spark, str(tmp_path)))
    assert m.where("not broken and cells = 8 and started < finished and completed = 1").count() == 3 and m.where("broken").count() == 1 and m.where("git_dirty").count() == 2
    (tmp_path / "task.yaml").write_text("id: t1\npackage: lib\nfrom_version: 1.0\nto_version: '2.0'\ntest_command: pytest\nroot_causes: [a, b]\n")
    t = rp.read_tasks(spark, [str(tmp_path / "task.yaml")]).first()
    assert (t.id, t.from_version, t.is_smoke_test) == ("t1", "1.0", False)
    (tmp_path / "bad.yaml").write_text("id: t2\n")
    with pytest.raises(ValueError, match="lacks"):
        rp.read_tasks(spark, [str(tmp_path / "bad.yaml")])


def operations(seed, n):
    rng = random.Random(seed)
    return [(rng.choice("xy"), i, rng.choice([*lg.OPERATIONS, "odd"]), f"k{rng.randrange(5)}", rng.choice([None, -1.0, 0.0, 1.5, 4.0, 9.0])) for i in range(n)]


OPS = "ledger string, seq int, op string, key string, amount double"


def test_ledger_keeps_its_sums(spark):
    for seed in range(30):
        book = lg.Ledger(20.0)
        for _, _, op, key, amount in operations(seed, 200):
            total = sum(book.settled.values())
            granted, _ = book.apply(op, key, amount)
            assert book.spent == pytest.approx(sum(book.settled.values())) and book.held == pytest.approx(sum(book.reserved.values()))
            if op == "retire":
                assert sum(book.settled.values()) == pytest.approx(total)
            if op == "reserve" and granted:
                assert book.spent + book.held <= 20.0 + 1e-9


def test_ledger_rules():
    book = lg.Ledger(10.0)
    assert book.apply("reserve", "a", 6.0)[0] and book.apply("reserve", "b", 6.0) == (False, "over budget")
    assert book.apply("settle", "a", 12.0)[0] and book.spent == 12.0 and book.apply("reserve", "a", 1.0) == (False, "already settled")
    book.apply("retire", "a", None)
    book.apply("settle", "a", 1.0)
    book.apply("retire", "a", None)
    assert book.settled == {"a#retired-1": 12.0, "a#retired-2": 1.0}


def test_a_ledger_over_many_batches_and_odd_rows(spark):
    rows = [*operations(5, 400), (None, 1, "settle", "k", 2.0), (None, 2, "reserve", None, 1.0), ("z", None, "settle", "a", 1.0), ("z", 0, "reserve", "a", 1.0), ("z", 0, None, "b", 1.0)]
    want = {}
    for r in sorted(rows, key=lambda r: (str(r[0]), *((x is not None, x) for x in r[1:]))):
        book = want.setdefault(r[0], ([], lg.Ledger(20.0)))
        book[0].append((r[1], *book[1].apply(r[2], r[3], r[4])))
    df = spark.createDataFrame(rows, OPS)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = lg.fold(df, "ledger", 20.0).collect()
        kept = lg.entries(df, "ledger", 20.0).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for ledger, (own, book) in want.items():
        assert [(r.seq, r.granted, r.reason) for r in got if r.ledger == ledger] == own
        assert {r.key: r.settled for r in kept if r.ledger == ledger and r.settled is not None} == book.settled
        assert {r.key: r.reserved for r in kept if r.ledger == ledger and r.reserved is not None} == book.reserved
        assert [r.open for r in got if r.ledger == ledger][-1] == len(book.reserved)
    assert lg.fold(df.limit(0), "ledger", 20.0).collect() == [] and lg.entries(df.limit(0), "ledger", 20.0).collect() == []
    with pytest.raises(ValueError):
        lg.fold(df, "ledger", -1.0)


def test_stream_batch_and_snapshot_agree(spark, tmp_path):
    rows = operations(3, 120)
    df = spark.createDataFrame(rows, OPS)
    want = sorted(map(tuple, lg.fold(df, "ledger", 20.0).collect()))
    src, checkpoint = tmp_path / "in", str(tmp_path / "checkpoint")
    for a in range(0, 120, 40):
        spark.createDataFrame(rows[a : a + 40], OPS).coalesce(1).write.mode("append").json(str(src))
    stream = spark.readStream.schema(OPS).option("maxFilesPerTrigger", 1).json(str(src))
    with keyed_state(spark):
        q = fold_stream(stream, "ledger", 20.0).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination(300)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert [x[:4] for x in got] == [x[:4] for x in want] and [x[7] for x in got] == [x[7] for x in want]
    assert [x[4] for x in got] == pytest.approx([x[4] for x in want])
    held = lambda e: sorted((r.ledger, r.key, r.settled, r.reserved) for r in e.collect())
    entries = lg.entries(df, "ledger", 20.0)
    assert held(kept_entries(spark, checkpoint)) == held(entries)
    assert held(kept_entries(spark, checkpoint, 0)) == held(lg.entries(df.where("seq < 40"), "ledger", 20.0))
    last = {x[0]: x for x in want}
    for r in lg.snapshot(entries, 20.0).collect():
        assert (r.settled, r.reserved, r.remaining) == pytest.approx(last[r.ledger][4:7]) and r.open == last[r.ledger][7] and r.committed == pytest.approx(20.0 - r.remaining)


def state(ok, failed, errors=None, suppressed=0, reason=None, exit_code=None):
    return (ok, failed, errors or {}, suppressed, reason, exit_code)


def test_scores(spark):
    ten = [f"t::{i}" for i in range(10)]
    e = {t: "AttributeError" for t in ten[:8]}
    before = state(True, ten, e, 1)
    rows = [
        ("half", before, state(True, ten[:5] + ["t::new"], {}, 3), "", ["a.py"]), ("blind", state(False, [], reason="dead"), before, "", []), ("idle", state(True, []), before, "", []), ("stopped", before, before, "killed", []),
        ("broke", before, state(False, [], exit_code=2), "", ["a.py"]), ("lost", before, state(False, [], exit_code=2), "", []), ("all", before, state(True, []), "", ["b", "a"]), ("cluster", before, state(True, ten[8:]), "", []),
    ]
    s = "struct<ok:boolean, failed_ids:array<string>, errors:map<string,string>, suppressed:bigint, reason:string, exit_code:bigint>"
    runs = spark.createDataFrame(rows, f"key string, before {s}, after {s}, interrupted string, changed_files array<string>")
    found = spark.createDataFrame([("all", "cheat", "k"), ("all", "warning", "w")], "key string, severity string, kind string")
    got = {r.key: r for r in sc.score(runs, found).collect()}
    h = got["half"]
    assert (h.fixed, h.still_failing, h.newly_broken, h.newly_suppressed, h.progress, h.clusters_total, h.clusters_fixed) == (5, 5, 1, 2, 0.5, 2, 1)
    assert {k: got[k].unscoreable_cause for k in got if not got[k].valid} == {"blind": "harness", "idle": "task", "stopped": "harness", "broke": "agent", "lost": "harness"}
    assert got["all"].progress == 1.0 and got["all"].credible_progress == 0.0 and got["all"].kinds == ["k", "w"] and got["all"].files_changed == ["a", "b"]
    assert got["cluster"].clusters_fixed == 1 and got["cluster"].cluster_progress == 0.5 and got["cluster"].is_clean and got["blind"].progress is None


def test_outcomes_by_priority(spark):
    none = F.lit(None).cast("string")
    no = F.lit(False)
    make = lambda error=none, valid=F.lit(True), cause=none, left=F.lit(1), cheats=F.lit(0), gave=no, cost=no, time=no, its=no: sc.final_outcome(error, valid, cause, left, cheats, gave, cost, time, its)
    yes = F.lit(True)
    cols = [make(error=F.lit("x")), make(valid=no, cause=F.lit("agent")), make(valid=no), make(left=F.lit(0)), make(left=F.lit(0), cheats=F.lit(1)), make(gave=yes, cost=yes), make(cost=yes, time=yes), make(time=yes, its=yes), make(its=yes), make()]
    assert list(spark.range(1).select(*cols).first()) == ["harness_error", "broke_suite", "no_verdict", "solved", "solved_with_cheats", "gave_up", "cost_limit", "time_limit", "iteration_limit", "stopped_without_solving"]


def test_text(spark):
    t = "a\r\nb\x0bc d\n"
    row = spark.createDataFrame([(t, "x    y ", 'say\n```json\n{"k": 1}\n```', "E  early\nE   late\nend", "one two", "two three")], "a string, b string, c string, d string, e string, f string").select(
        tx.lines(F.col("a")).alias("lines"), tx.normalise(F.col("b")).alias("n"), F.try_variant_get(tx.json_object(F.col("c")), "$.k", "int").alias("k"), tx.last_error(F.col("d")).alias("err"),
        tx.token_overlap(F.col("e"), F.col("f")).alias("o"), F.size(tx.secret_hits(F.lit("x\nAKIA" + "Q" * 16))).alias("hits"), tx.secret_hits(F.lit("x\nAKIA" + "Q" * 16))[0]["line"].alias("line"),
        tx.links(F.lit('[a](b.md "t") <img src="c.png"> ```[x](y)```')).alias("links"), F.length(tx.shortened(F.lit("x" * 100), 40, "..")).alias("short"),
    ).first()
    assert tuple(row) == (["a", "b", "c", "d"], "x y", 1, "late", 0.5, 1, 2, ["b.md", "c.png"], 42)
