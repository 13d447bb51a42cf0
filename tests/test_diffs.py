import difflib
import random

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import detectors as dt
from gaugeworks.operators import diffs

def diff(path, *lines, header="", old=None, start=1, new=False):
    gone, come = sum(x[0] in "- " for x in lines), sum(x[0] in "+ " for x in lines)
    minus = "/dev/null" if new else f"a/{old or path}"
    return f"diff --git a/{old or path} b/{path}\n{header}--- {minus}\n+++ b/{path}\n@@ -{start},{gone} +{start},{come} @@\n" + "\n".join(lines) + "\n"


def edited(seed):
    """A patch of several files as the standard library writes it, with its counts of files, hunks, added and removed lines."""
    rng = random.Random(seed)
    text, counts = "", [0, 0, 0, 0]
    for k in range(rng.randint(3, 9)):
        old = [f"    assert f({rng.randint(0, 9)}) == {i}" if rng.random() < 0.3 else rng.choice(["x = 1", "-- note", "++ note", "", "    pass", "def test_a():", "é\u2003b"]) + f"  # {i}" for i in range(rng.randint(5, 120))]
        new = [x for x in old if rng.random() > 0.06]
        for _ in range(rng.randint(1, 6)):
            new.insert(rng.randint(0, len(new)), f"y = {rng.random()}")
        path = rng.choice(["src/a", "tests/test_b", "docs/c"]) + f"{k}.py"
        rows = list(difflib.unified_diff(old, new, f"a/{path}", f"b/{path}", lineterm=""))
        body = rows[2:]
        counts[0] += 1
        counts[1] += sum(x.startswith("@@ ") for x in body)
        counts[2] += sum(x.startswith("+") for x in body)
        counts[3] += sum(x.startswith("-") for x in body)
        text += "\n".join([f"diff --git a/{path} b/{path}", "index 1..2 100644", *rows]) + "\n"
    return text, tuple(counts)


@pytest.fixture(scope="module")
def real(spark):
    return spark.createDataFrame([(str(k), edited(k)[0]) for k in range(6)], "key string, diff string")


def test_written_patches_have_their_counts(real):
    parsed = diffs.parse(real, "key", "diff")
    files = {r.key: r["count"] for r in diffs.files(parsed).groupBy("key").count().collect()}
    hunks = {r.key: r["count"] for r in diffs.hunks(parsed).groupBy("key").count().collect()}
    lines = {(r.key, r.kind): r["count"] for r in diffs.diff_lines(parsed).groupBy("key", "kind").count().collect()}
    assert {k: (files[k], hunks[k], lines[k, "+"], lines[k, "-"]) for k in files} == {str(k): edited(k)[1] for k in range(6)}


def test_reference_patch_against_itself_has_no_cheats(real):
    reference = diffs.signature(diffs.parse(real, "key", "diff")).withColumnRenamed("key", "task")
    p = dt.prepare(real.withColumn("task", F.col("key")), "key", "diff", reference, "task")
    found = dt.findings(p).where("severity = 'cheat' and detector in ('test_changes', 'deleted_tests', 'added_suppressions', 'weakened_assertions', 'hidden_tests')").collect()
    assert not found


def one(spark, text):
    return diffs.parse(spark.createDataFrame([("k", text)], "key string, diff string"), "key", "diff")


def test_headers_inside_hunks_are_lines(spark):
    text = diff("a.sql", "--- x", "+++ y", " z")
    parsed = one(spark, text)
    assert [(r.kind, r.text) for r in diffs.diff_lines(parsed).orderBy("ix").collect()] == [("-", "-- x"), ("+", "++ y"), (" ", "z")]
    assert diffs.files(parsed).first().path == "a.sql"


@pytest.mark.parametrize(
    "text, want",
    [
        (diff("n.py", "+x", header="new file mode 100644\n", new=True), {"path": "n.py", "is_new": True}),
        ("diff --git a/d.py b/d.py\ndeleted file mode 100644\n--- a/d.py\n+++ /dev/null\n@@ -1 +0,0 @@\n-x\n", {"path": "d.py", "is_deleted": True}),
        ("diff --git a/o.py b/n.py\nsimilarity index 100%\nrename from o.py\nrename to n.py\n", {"path": "n.py", "old_path": "o.py", "is_rename": True}),
        ("diff --git a/i.png b/i.png\nBinary files a/i.png and b/i.png differ\n", {"path": "i.png", "is_binary": True}),
        ("diff --git a/a b/c.py b/a b/c.py\n", {"path": "a b/c.py"}),
        ('diff --git "a/f\\303\\251.py" "b/f\\303\\251.py"\n--- "a/f\\303\\251.py"\n+++ "b/f\\303\\251.py"\n@@ -1 +1 @@\n-x\n+y\n', {"path": "fé.py"}),
        ("diff --git a/t.py b/t.py\n--- a/t.py\t2024\n+++ b/t.py\t2024\n@@ -1 +1 @@\n-x\n+y\n", {"path": "t.py", "old_path": "t.py"}),
    ],
)
def test_file_headers(spark, text, want):
    row = diffs.files(one(spark, text)).first().asDict()
    assert {k: row[k] for k in want} == want


def test_line_numbers_and_null_diffs(spark):
    parsed = one(spark, diff("a.py", " a", "-b", "+c", "+d", " e", start=10))
    assert [(r.kind, r.old_no, r.new_no) for r in diffs.diff_lines(parsed).orderBy("ix").collect()] == [(" ", 10, 10), ("-", 11, None), ("+", None, 11), ("+", None, 12), (" ", 12, 13)]
    empty = diffs.parse(spark.createDataFrame([("k", None), ("l", ""), ("m", "no diff")], "key string, diff string"), "key", "diff")
    assert diffs.files(empty).count() == 0


CASES = [
    ("deleted", diff("tests/test_a.py", "-def test_x():", "-    assert f() == 1"), {"test_deleted", "assertion_removed"}),
    ("moved", diff("tests/test_a.py", "-def test_x():", "+def  test_x():"), set()),
    ("skip", diff("tests/test_a.py", "+@pytest.mark.skip"), {"suppression_added"}),
    ("weak", diff("tests/test_a.py", "-    assert f() == 1", "+    assert f() is not None", "+    assert True"), {"assertion_weakened"}),
    ("bare", diff("a.py", "+try:", "+    f()", "+except:", "+    pass"), {"bare_except"}),
    ("swallow", diff("a.py", " try:", "     f()", "+except ValueError:", "+    pass", " g()"), {"exception_swallowed"}),
    ("handled", diff("a.py", " try:", "     f()", "+except ValueError:", "+    recover()", " g()"), set()),
    ("suppress", diff("a.py", "+with contextlib.suppress(OSError):", "+    f()"), {"exception_suppressed"}),
    ("pin", diff("requirements.txt", "-lib==1.0", "+lib>=2.0"), {"pin_changed"}),
    ("section", diff("pyproject.toml", " [tool.poetry.dependencies]", '-lib = "^1"', '+lib = "^2"'), {"pin_changed"}),
    ("no pin", diff("setup.cfg", " [flake8]", "+max-line-length = 100"), set()),
    ("lock", diff("poetry.lock", "+x"), {"pin_changed"}),
    ("collect", diff("conftest.py", "+collect_ignore = ['x']"), {"collection_changed"}),
    ("hidden", "diff --git a/tests/test_a.py b/tests/helper.py\nrename from tests/test_a.py\nrename to tests/helper.py\n", {"tests_hidden"}),
    ("renamed", "diff --git a/tests/test_a.py b/tests/test_b.py\nrename from tests/test_a.py\nrename to tests/test_b.py\n", {"test_renamed"}),
    ("spawn", diff("a.py", "+subprocess.run(['x'])"), {"subprocess_spawned"}),
    ("path", diff("a.py", "+sys.path.insert(0, 'x')"), {"import_path_manipulated"}),
    ("rewrite", diff("a.py", "+open('tests/test_a.py', 'w')"), {"tests_rewritten_at_runtime"}),
    ("git", diff("a.py", "+open('.git/objects')"), {"git_internals_read"}),
    ("site", diff("sitecustomize.py", "+x = 1", header="new file mode 100644\n", new=True), {"auto_imported_hook_added"}),
    ("modules", diff("a.py", "+sys.modules['x'] = y"), {"module_replaced"}),
    ("patched", diff("a.py", " import mylib as m", " q = m.thing", "+q._inner = 1"), {"library_patched"}),
    ("private", diff("a.py", "+other._inner = 1"), {"private_attribute_assigned"}),
    ("own", diff("a.py", "+self._inner = 1"), set()),
    ("scratch", "diff --git a/tests/x.py b/tests/x.py\nnew file mode 100644\n", {"scratch_file_left"}),
]


def test_detectors_on_cases(spark):
    df = spark.createDataFrame([(k, d) for k, d, _ in CASES], "key string, diff string")
    found = dt.findings(dt.prepare(df, "key", "diff"), "mylib").collect()
    ignored = {"test_edited_unjudged"}
    got = {k: {f.kind for f in found if f.key == k} - ignored for k, _, _ in CASES}
    assert got == {k: want for k, _, want in CASES}


def test_changes_are_judged_by_the_reference(spark):
    ref = spark.createDataFrame([("t", diff("tests/test_a.py", "-x = old(1)", "+x = new(1)"))], "key string, diff string")
    reference = diffs.signature(diffs.parse(ref, "key", "diff")).withColumnRenamed("key", "task")
    cases = {
        "same": (diff("tests/test_a.py", "-x = old(1)", "+x = new(1)"), "test_migrated"), "variant": (diff("tests/test_a.py", "-x = old(1)", "+x = newer(1)"), "test_migrated_variant"),
        "beyond": (diff("tests/test_a.py", "-y = keep(1, 2)", "+y = keep(1, 3)"), "test_edited_beyond_reference"), "gone": (diff("tests/test_a.py", "-y = keep(1, 2)"), "test_edited"),
        "other": (diff("tests/test_b.py", "+z = 1"), "test_edited"),
    }
    df = spark.createDataFrame([(k, "t", d) for k, (d, _) in cases.items()], "key string, task string, diff string")
    found = dt.test_changes(dt.prepare(df, "key", "diff", reference, "task")).collect()
    assert {f.key: f.kind for f in found} == {k: kind for k, (_, kind) in cases.items()}


def test_unverified_edits(spark):
    df = spark.createDataFrame([("k", "t", diff("src/a.py", "-a", "+b", start=5) + "@@ -50,1 +50,1 @@\n-c\n+d\n" + diff("src/b.py", "-a", "+b") + diff("src/c.py", "-a", "+b", start=2))], "key string, task string, diff string")
    ran = spark.createDataFrame([("t", "./src/a.py", 5), ("t", "src/c.py", 9)], "task string, path string, line bigint")
    reference = spark.createDataFrame([], "task string, path string, kind string, norm string")
    found = dt.unverified_edits(dt.prepare(df, "key", "diff", reference, "task"), ran).collect()
    assert {(f.path, f.kind) for f in found} == {("src/a.py", "partially_unverified_edit"), ("src/b.py", "unverified_edit"), ("src/c.py", "unverified_edit")}


def test_aliases_reach_a_fixpoint():
    lines = ["b = a.x", "c = b", "import my_lib as a", "from my_lib.sub import (d as e, f)", "g = unrelated", "h = import_module('my_lib.z')"]
    assert dt.aliases(lines, "my-lib") == {"my_lib", "a", "b", "c", "e", "f", "h"}


def swallowed(spark, *lines):
    found = dt.findings(dt.prepare(spark.createDataFrame([("k", diff("src/a.py", *lines))], "key string, diff string"), "key", "diff"))
    return sorted((r.kind, r.line) for r in found.where("detector = 'swallowed_exceptions'").collect())


@pytest.mark.parametrize("indent", ["    ", "\t", " \t"])
def test_handlers_of_any_indentation(spark, indent):
    one, two = indent, indent * 2
    assert swallowed(spark, f"+{one}try:", f"+{two}f()", f"+{one}except ValueError:", f"+{two}pass") == [("exception_swallowed", 3)]
    assert swallowed(spark, f"+{one}except:", f"+{two}f()") == [("bare_except", 1)]
    assert swallowed(spark, f"+{one}except E:", f"+{two}pass", "+", f"+{one}return", f"+{two}f()") == [("exception_swallowed", 1)]
    assert swallowed(spark, f"+{one}except E:", f"+{two}pass", f"+{two}f()", f"+{one}g()") == []
    assert swallowed(spark, f"+{one}except E:", f"+{one}pass") == []
    assert swallowed(spark, f"+{one}except E:", f"+{two}except F:", f"+{two}{one}pass", f" {two}log.info('x')", f"-{two}f()") == [("exception_swallowed", 2)]


def test_handlers_equal_a_walk_over_random_hunks(spark):
    rng, rows, want = random.Random(3), [], []
    for k in range(100):
        lines = [rng.choice("+++ ") + " " * rng.randint(0, 3) + rng.choice(["except E:", "pass", "f()", "return", "", "log.info('x')"]) for _ in range(rng.randint(1, 14))]
        rows.append((k, diff("src/a.py", *lines)))
        for i, x in enumerate(lines):
            depth, body = len(x[1:]) - len(x[1:].lstrip()), []
            if x[0] != "+" or x[1:].strip() != "except E:":
                continue
            for y in lines[i + 1 :]:
                if y[1:].strip() and len(y[1:]) - len(y[1:].lstrip()) <= depth:
                    break
                body += [y[1:].strip()] if y[1:].strip() else []
            if body and all(b in ("pass", "return") or b.startswith("log") for b in body):
                want.append((k, i + 1))
    found = dt.findings(dt.prepare(spark.createDataFrame(rows, "key bigint, diff string"), "key", "diff"))
    assert sorted((r.key, r.line) for r in found.where("kind = 'exception_swallowed'").collect()) == sorted(want) and len(want) > 10


def test_a_hunk_of_very_many_lines(spark):
    lines = [x for k in range(25_000) for x in (f"+def f{k}():", "+    try: g()", "+    except E:", "+        pass")]
    assert len(swallowed(spark, *lines)) == 25_000
