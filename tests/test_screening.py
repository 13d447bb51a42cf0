from gaugeworks.plans import screening as sn

URL = "https://github.com/acme/tool/pull/{}"
PATCH = "--- a/setup.py\n+++ b/setup.py\n@@ -1 +1 @@\n-    'oldlib>=1.0',\n+    'oldlib>=2.0',"
SWAP = "-    'oldlib>=1.0',\n+    'newlib>=2.0',"
CI = "strategy:\n  matrix:\n    python-version:\n      - '3.5'\n      - \"3.6\"\nservices:\n  postgres:\n    image: x\n"


def screened(spark, pulls, files, base):
    p = spark.createDataFrame(pulls, "url string, title string, merged_at string")
    f = spark.createDataFrame(files, "url string, ix int, filename string, additions int, deletions int, patch string, extra int")
    b = spark.createDataFrame(base, "url string, path string, body string")
    return {r.url: r for r in sn.screen(p, f, b).collect()}


def test_screen(spark):
    u = [URL.format(i) for i in range(6)]
    pulls = [(u[0], "Support oldlib 2", "2023-05-06T07:00:00Z"), (u[1], "[WIP] Frob", None), (u[2], None, "2023-01-01T00:00:00Z"), (u[3], "x", "2023-01-01T00:00:00Z"), ("nowhere", "some title", "2023-01-01T00:00:00Z"), (u[5], "Matrix", "2020-01-01T00:00:00Z")]
    files = [
        (u[0], 0, "src/tool/a.py", 8, 4, "+x", 1), (u[0], 1, "setup.py", 1, 1, PATCH, 1), (u[0], 2, "tests/test_a.py", 3, 0, None, 1), (u[0], 3, "docs/a.rst", 50, 0, None, 1),
        (u[1], 0, "tests/test_a.py", 3, None, None, 1), (u[2], 0, "setup.py", 1, 1, SWAP, 1), (u[3], 0, "tool.py", 100, 0, None, 1), (u[3], 1, "requirements-dev.txt", 1, 1, PATCH, 1), ("nowhere", 0, None, None, None, None, None), (u[5], 0, "a.py", 20, 1, None, 1),
    ]
    base = [
        (u[0], ".github/workflows/ci.yml", CI), (u[0], "README.md", "redis"), (u[0], "tox.ini", None), (u[3], ".travis.yml", "matrix:\n  oldlib-version:\n    - 1.0\n    - 2.0\n    - 3.0\n    - 4.0\npython-versions: 3.6, 3.9\n"),
        (u[3], "toxXini", "services:"), (u[5], "tox.ini", "[tox]\nenvlist = py36-matrix1, py36-matrix2\noldlib_version = 1"), ("unknown", "tox.ini", "kafka"),
    ]
    got = screened(spark, pulls, files, base)
    assert set(got) == {p[0] for p in pulls}
    a = got[u[0]]
    assert (a.owner, a.repo, a.number, a.merged, a.package, a.viable, a.blockers) == ("acme", "tool", "0", "2023-05-06", "oldlib", True, [])
    assert (a.source_files, a.source_lines, a.test_files, a.test_lines) == (2, 14, 1, 3) and a.notes == ["old_python", "needs_service"]
    assert a.python_versions == ["3.5", "3.6"] and a.services == ["postgres", "services:"] and a.replaced == a.gained == []
    assert got[u[1]].blockers == ["not_merged", "no_source_changed"] and got[u[1]].package == "wip"
    assert got[u[2]].blockers == ["package_replaced"] and got[u[2]].notes == ["few_source_lines"] and (got[u[2]].replaced, got[u[2]].gained) == (["oldlib"], ["newlib"])
    assert got[u[3]].blockers == ["both_versions_tested"] and got[u[3]].evidence == [".travis.yml: oldlib-version: -> 1.0, 2.0, 3.0"] and got[u[3]].notes == []
    assert got["nowhere"].blockers == ["not_a_pull_request", "no_source_changed"]
    assert got[u[5]].evidence == ["tox.ini: envlist = py36-matrix1, py36-matrix2"] and not got[u[5]].viable


def test_screen_of_nothing(spark):
    assert screened(spark, [], [], []) == {}
    alone = screened(spark, [(URL.format(1), "", "2023-01-01")], [], [])[URL.format(1)]
    assert (alone.package, alone.blockers, alone.notes, alone.source_lines) == ("", ["no_source_changed"], [], 0)
