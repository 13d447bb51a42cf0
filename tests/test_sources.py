import json
import random
import re

import pytest
from pyspark.sql import functions as F

from gaugeworks.functions.text import SECRET_RULES
from gaugeworks.operators import detectors as dt
from gaugeworks.sources import files as fl
from gaugeworks.sources import sheets as sh
from gaugeworks.sources import tasks as tk
from gaugeworks.sources import versioned as vs
from gaugeworks.sources.reports import token

# files in ranges


def whole_file(data, rules):
    out = {}
    for rule, pattern in rules.items():
        for m in re.finditer(pattern.encode(), data):
            line = data.count(b"\n", 0, m.start()) + 1
            out[rule, line] = out.get((rule, line), 0) + 1
    return out


def made_file(rng):
    bits = [b"AKIA" + b"Q7" * 8, b"sk-" + b"a-_9" * 9, b"AKIA", b"-----BEGIN RSA PRIVATE KEY-----", b"-----BEGIN ", b" ", b"\n", b"\n\n", b"\xff\xc3", b"xoxb-" + b"9a" * 12, b"word", b".", b"ghp_" + b"Z" * 36]
    return b"".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))


@pytest.mark.parametrize("piece", [1, 40, 1 << 20])
def test_ranges_hold_each_byte_once_and_findings_equal_a_whole_scan(spark, tmp_path, piece):
    rng = random.Random(piece)
    files = {f"d{k % 3}/f{k}.bin": made_file(rng) for k in range(12)} | {"empty": b"", "run": b"a" * 300, "key": b"x AKIA" + b"B" * 16}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    (tmp_path / ".hidden").write_bytes(b"sk-" + b"a" * 40)
    reader = fl.RangeReader({"path": str(tmp_path), "piece": piece})
    got = {name: [] for name in files}
    for part in reader.partitions():
        for batch in reader.read(part):
            got[part.name].append((batch.column(1)[0].as_py(), batch.column(2)[0].as_py()))
    for name, data in files.items():
        assert "".join(t for _, t in sorted(got[name])) == data.decode("ascii", "replace")
        assert [at for at, _ in sorted(got[name])] == [sum(len(t) for _, t in sorted(got[name])[:k]) for k in range(len(got[name]))]
    if piece == 1:
        return
    rules = {k: v for k, v in SECRET_RULES.items() if k not in fl.WHOLE_TEXT_RULES}
    found = {}
    for r in fl.secret_findings(fl.read_ranges(spark, str(tmp_path), piece)).collect():
        found.setdefault(r.name, {})[r.rule, r.line] = r.n
    assert found == {name: want for name, data in files.items() if (want := whole_file(data, rules))}


def test_written_files_are_whole_and_of_one_row_each(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.txt", "x\ny"), ("c", None)], "path string, value string")
    assert fl.write_files(rows, str(tmp_path / "out")) == 2 == fl.write_files(rows, str(tmp_path / "out"))
    assert fl.listed(str(tmp_path / "out")) == [("a/b.txt", 3), ("c", 0)]
    with pytest.raises(ValueError):
        fl.write_files(rows.union(rows), str(tmp_path / "twice"))
    assert not (tmp_path / "twice").exists()


# versions


def test_a_failed_write_leaves_the_version_before(spark, tmp_path):
    path = str(tmp_path / "t")
    assert vs.newest(path)["version"] == 0
    assert vs.publish(spark.range(10).repartition(3), path, 0) == 1
    broken = spark.range(30).repartition(4).select(F.when(F.col("id") == 29, F.raise_error(F.lit("no")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="no"):
        vs.publish(broken, path, 1)
    assert sorted(r.id for r in vs.read(spark, path).collect()) == list(range(10)) and vs.newest(path)["rows"] == 10
    assert {f"data/{f.name}" for f in (tmp_path / "t" / "data").iterdir()} >= set(vs.newest(path)["files"]) and len(vs.newest(path)["files"]) == 3
    assert vs.publish(spark.range(3), path, 1) == 2 and vs.read(spark, path).count() == 3


def test_writers_that_read_another_version_or_layout_are_refused(spark, tmp_path):
    path = str(tmp_path / "t")
    vs.publish(spark.range(2), path, 0)
    for expect, layout in ((0, 1), (2, 1), (1, 9)):
        with pytest.raises(Exception, match="version|layout"):
            vs.publish(spark.range(5), path, expect, layout)
    with pytest.raises(Exception, match="layout"):
        vs.read(spark, path, 9).count()
    first = vs.VersionedWriter(path, spark.range(1).schema, 1, 1)
    vs.publish(spark.range(7), path, 1)
    with pytest.raises(vs.VersionConflict):  # another one was there first
        first.commit([])
    assert vs.read(spark, path).count() == 7
    assert vs.publish(spark.range(0), path, 2) == 3 and vs.read(spark, path).count() == 0


# sheets


def sheet(*rows):
    return ["# a sheet", "| pair | verdict | why |", "|---|---|---|", *(f"| `{t}` | {v} | {w} |" for t, v, w in rows), None, ""]


def test_a_sheet_is_taken_whole_or_not_at_all(spark, tmp_path):
    path, kind = str(tmp_path / "labels"), "id string, neutral string, rationale string, at string, source string, extra int"
    vs.publish(spark.createDataFrame([("p1", None, None, None, None, 1), ("p2", "equivalent", "as it was", "t0", "hand", 2), ("p3", None, None, None, None, 3), ("p4", None, None, None, None, 4)], kind), path, 0, sh.LAYOUT)
    t = {r.id: r.t for r in spark.createDataFrame([(f"p{k}",) for k in range(1, 5)], "id string").select("id", token(F.col("id")).alias("t")).collect()}
    good = (t["p1"], "Agent_wrong", "the reason | is long enough"), (t["p2"], "equivalent", ""), (t["p3"], "skip", ""), (t["p4"], "", "")
    take = lambda rows: sh.import_sheet(spark.createDataFrame([(x,) for x in sheet(*rows)], "value string"), path, "t1")
    bad = (("000000", "equivalent", "x" * 30), (t["p2"], "unclear", "x" * 30), (t["p4"], "perhaps", "x" * 30), (t["p4"], "equivalent", "short"))
    for row in bad:
        out = take([*good, row])
        assert not out.published and out.version == 1 and vs.newest(path)["version"] == 1
        states = sorted((r.state, tuple(r.problems)) for r in out.report.collect())
        assert ("held", ()) in states and sum(s == "problem" for s, _ in states) >= 1 and not any(s == "applied" for s, _ in states)
    out = take([*good, good[0]])
    assert out.published and sorted(r.state for r in out.report.collect()) == ["applied", "applied", "applied", "unchanged"]
    got = {r.id: (r.neutral, r.rationale, r.at, r.source, r.extra) for r in vs.read(spark, path, sh.LAYOUT).collect()}
    assert got == {"p1": ("agent_wrong", "the reason | is long enough", "t1", "sheet", 1), "p2": ("equivalent", "as it was", "t0", "hand", 2), "p3": ("skip", "not worth labelling", "t1", "sheet", 3), "p4": (None, None, None, None, 4)}
    again = take(good)
    assert not again.published and again.version == 2 and {r.state for r in again.report.collect()} == {"unchanged"}
    quarrel = take([(t["p4"], "equivalent", "x" * 30), (t["p4"], "unclear", "x" * 30)])
    assert not quarrel.published and {tuple(r.problems) for r in quarrel.report.collect()} == {("said otherwise in this sheet",)}


# task folders


GOOD = "id: {0}\nrepo: r\nbase_sha: '00'\ntest_command: run\npackage: lib\nfrom_version: 1\nto_version: 2\n"


def task_folders(tmp_path):
    for name, files in {
        "whole": {"task.yaml": GOOD + "contamination: {{risk: low, reason: known}}\nroot_causes: [a, b, c]\nenv: {{A: 1}}\nunreachable: [docs/]\n", "reference.diff": "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1 +1 @@\n-a = 1\n+b = 2\n", "coverage.json": json.dumps({"files": {"x.py": {"executed_lines": [1, 2]}}}),
                  "broken-report.json": json.dumps({"exitcode": 1, "tests": [{"nodeid": "t::1", "outcome": "failed"}, {"nodeid": "t::2", "outcome": "passed"}]})},
        "empty": {"task.yaml": GOOD + "unreachable: [lib/]\n", "reference.patch": "", "broken-report.json": "{"}, "bare": {"task.yaml": GOOD},
        "risky": {"task.yaml": GOOD + "contamination: {{risk: some}}\nroot_causes: [a]\n"}, "other": {"task.yaml": GOOD.replace("{0}", "wrong")}, "lacking": {"task.yaml": "id: lacking\n"}, "broken": {"task.yaml": "a: [", "notes": "x"}, "no-task": {"notes": "x"},
    }.items():
        (tmp_path / name).mkdir()
        for file, text in files.items():
            (tmp_path / name / file).write_text(text.format(name) if file == "task.yaml" else text)
    return str(tmp_path)


def test_task_folders_are_read_with_their_problems(spark, tmp_path):
    tasks = tk.read_task_folders(spark, task_folders(tmp_path))
    got = {r.id: r for r in tasks.collect()}
    assert set(got) == {"whole", "empty", "bare", "risky", "other", "lacking", "broken"}
    assert {k: r.problems for k, r in got.items() if r.problems} == {
        "risky": ["unknown risk some", "risk without a reason", "1 root causes without a low_power_reason"], "other": ["says it is wrong"],
        "lacking": ["missing repo, base_sha, test_command, package, from_version, to_version"], "broken": ["not a definition"],
    }
    assert got["whole"].env == {"A": "1"} and got["whole"].from_version == "1" and got["whole"].unreachable == ["docs/"] and got["whole"].python == "3.11"
    assert (got["empty"].reference_diff, got["bare"].reference_diff) == ("", None)
    fine = tasks.where(F.col("id").isin("whole", "empty", "bare"))
    assert {r.task for r in tk.referenced(tk.usable(fine)).collect()} == {"whole", "empty"} and {r.task for r in tk.covered(fine).collect()} == {"whole"}
    assert sorted(map(tuple, tk.reference_lines(fine).collect())) == [("whole", "x.py", "+", "b = 2"), ("whole", "x.py", "-", "a = 1")]
    assert sorted(map(tuple, tk.executed(fine).collect())) == [("whole", "x.py", 1), ("whole", "x.py", 2)] and sorted(map(tuple, tk.unreached(fine).collect())) == [("empty", "lib/")]
    states = {r.task: (r.status, r.reason, r.failed_ids) for r in tk.before_states(fine).collect()}
    assert states == {"whole": ("ok", None, ["t::1"]), "empty": ("no_verdict", "not valid JSON", None), "bare": ("no_verdict", "the state before is unknown", None)}
    with pytest.raises(Exception, match="other: says it is wrong"):
        tk.usable(tasks.where("id in ('other', 'whole')")).count()


def test_filters_on_id_leave_folders_unread(spark, tmp_path):
    path = task_folders(tmp_path)
    (tmp_path / "broken" / "task.yaml").write_bytes(b"\xff\xfe")  # reading it would be an error
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    try:
        tasks = tk.read_task_folders(spark, path)
        one = tasks.where("id = 'whole' and package = 'lib'")
        assert one.rdd.getNumPartitions() == 1 and [r.id for r in one.collect()] == ["whole"]
        assert sorted(r.id for r in tasks.where("id in ('whole', 'bare', 'none')").collect()) == ["bare", "whole"] and tasks.where("id = 'none'").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    with pytest.raises(Exception, match="utf-8"):
        tk.read_task_folders(spark, path).where("id = 'broken'").collect()


# detectors


def overlap(gone, kept):
    a, b = set(re.findall(r"\w+", gone)), set(re.findall(r"\w+", kept))
    return len(a & b) / len(a) if a else 0


def test_reworded_lines_equal_comparing_all_pairs(spark):
    rng = random.Random(4)
    line = lambda: " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 7)))
    gone = [(f"k{k % 3}", 1, k % 4, k, line()) for k in range(150)]
    come = [(f"k{k % 3}", 1, k % 4, 1000 + k, line()) for k in range(120)]
    cols = "key string, file_ix int, hunk_ix int, ix int, text string"
    got = {tuple(r) for r in dt.reworded(spark.createDataFrame(gone, cols), spark.createDataFrame(come, cols)).collect()}
    assert got == {g[:2] + g[3:4] for g in gone if any(c[:3] == g[:3] and overlap(g[4], c[4]) >= 0.6 for c in come)}


def test_a_hunk_of_very_many_lines_is_no_square(spark):
    """100,000 removed and 100,000 added lines; every tenth was reworded."""
    n = 100_000
    base = spark.range(n).select(F.lit("k").alias("key"), F.lit(1).alias("file_ix"), F.lit(1).alias("hunk_ix"), F.col("id").cast("int").alias("ix"))
    name = F.format_string("    assert value_%d == result_%d", "ix", "ix")
    come = base.withColumn("text", F.when(F.col("ix") % 10 == 0, F.concat(name, F.lit(" or later"))).otherwise(F.format_string("    assert other_%d == thing_%d", "ix", "ix")))
    assert dt.reworded(base.withColumn("text", name), come).count() == n // 10


def test_live_regions_equal_the_exploded_lines(spark):
    rng = random.Random(6)
    ran = [("t", f"./f{k % 4}.py", rng.randint(1, 60)) for k in range(60)]
    rows, want = [], set()
    for k in range(80):
        path, at, n = f"f{rng.randint(0, 5)}.py", rng.randint(1, 60), rng.randint(0, 6)
        lines = [f"-x{i} = 1" for i in range(n)] + ["+y = 2"]
        rows.append((k, "t", f"diff --git a/{path} b/{path}\n--- a/{path}\n+++ b/{path}\n@@ -{at},{n} +{at},1 @@\n" + "\n".join(lines) + "\n"))
        own = {x for _, p, x in ran if p == f"./{path}"}
        if not own & set(range(at, at + n)):
            want.add(k)
    ran.append(("t", "f0.py", 10**9))
    df, cols = spark.createDataFrame(rows, "k int, task string, diff string"), "task string, path string, line bigint"
    p = dt.prepare(df, "k", "diff", spark.createDataFrame([], "task string, path string, kind string, norm string"), "task")
    assert {r.key for r in dt.unverified_edits(p, spark.createDataFrame(ran, cols)).where("kind = 'unverified_edit'").collect()} == want
    runs = {r.plain: [tuple(x) for x in r.runs] for r in dt.line_runs(spark.createDataFrame([("t", "a", x) for x in (3, 1, 2, 2, 9, 7, 8)], cols)).collect()}
    assert runs == {"a": [(1, 3), (7, 9)]}
    some = dt.unverified_edits(p, spark.createDataFrame([], cols), spark.createDataFrame([("t", "f1")], "task string, prefix string"), spark.createDataFrame([], "task string")).collect()
    assert {r.path for r in some} == {"f1.py"}


def test_files_that_do_not_name_the_package_are_not_walked(spark):
    head = "diff --git a/{0} b/{0}\n--- a/{0}\n+++ b/{0}\n@@ -1,0 +1,{1} @@\n"
    made = lambda name, *lines: head.format(name, len(lines)) + "".join(f"+{x}\n" for x in lines)
    rows = [(1, made("a.py", "import My_Lib as m", "q = m.core", "q._x = 1")), (2, made("b.py", "q._x = 1")), (3, made("c.py", "my_lib._x = 1")), (4, made("d.py", "import my_lib"))]
    p = dt.prepare(spark.createDataFrame(rows, "k int, diff string"), "k", "diff")
    found = dt.runtime_patching(p, "my-lib")
    assert sorted((r.key, r.kind) for r in found.collect()) == [(1, "library_patched"), (2, "private_attribute_assigned"), (3, "library_patched")]
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
