"""Queries of rules on documents, reports, paths and diffs that are written from the given tables: what a row's values come to
together decides which rules it breaks, and SQL works the same out from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import detectors as dt
from ..sources import records as rc
from ..sources import reports as rp
from .catalogue import query, table
from .run_queries import _values

_BY = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def _json(pairs: dict[str, Column]) -> Column:
    """An object's text from its fields' texts; a field whose text is null is left out."""
    fields = [F.concat(F.lit(f'"{k}":'), v.cast("string")) for k, v in pairs.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


# Records


@query("""WITH l AS (SELECT l_orderkey AS k, count(*) AS n, sum(l_linenumber) - 4 * count(*) AS ahead, max(l_quantity) AS q, count(*) FILTER (l_returnflag = 'R') AS r, count(DISTINCT l_partkey % 30) FILTER (l_returnflag = 'R') AS dr,
count(DISTINCT l_partkey % 30) AS d FROM lineitem GROUP BY 1),
o AS (SELECT *, coalesce(n, 0) AS m, coalesce(r, 0) AS fails FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN l ON o_orderkey = k),
s AS (SELECT *, list_filter([CASE WHEN year(o_orderdate) = 1995 THEN 'schema v2' END, CASE WHEN c_nationkey = 7 AND m = 0 THEN 'missing required model, before_failed_ids' WHEN c_nationkey = 7 THEN 'missing required model' WHEN m = 0 THEN 'missing required before_failed_ids' END,
CASE WHEN c_acctbal > 9000 THEN 'no config_version' END, CASE WHEN month(o_orderdate) = 2 THEN 'unknown fields note' END, CASE WHEN c_acctbal > 9000 THEN 'config_version is empty' END, CASE WHEN o_orderstatus = 'P' THEN 'unknown outcome' END,
CASE WHEN dr < r THEN 'failed_ids has duplicate ids' END, CASE WHEN d < n THEN 'before_failed_ids has duplicate ids' END, CASE WHEN q::INT % 2 = 1 THEN 'max_iterations is not an integer' END, CASE WHEN ahead < 0 THEN 'tests_passed is negative' END,
CASE WHEN c_acctbal < 0 THEN 'cost_usd is negative' END], lambda x: x IS NOT NULL) AS broken FROM o)
SELECT o_orderkey::VARCHAR AS name, array_to_string(broken, '; ') AS reasons, len(broken) = 0 AND o_totalprice >= 20000 AS usable, CASE WHEN len(broken) = 0 THEN m END AS iterations, CASE WHEN len(broken) = 0 THEN fails END AS failing,
CASE WHEN len(broken) = 0 THEN c_acctbal END AS cost_usd FROM s""")
def record_states(spark: SparkSession, sf: str) -> DataFrame:
    """Each order as a record: its lines are test ids (repeated ones too), its customer's balance the cost (below zero too), its year the version.
    All rules that a record breaks, in their order, and the fields of those that break none."""
    id_ = _quoted((F.col("l_partkey") % 30).cast("string"))
    listed = lambda c: F.concat(F.lit("["), F.concat_ws(",", F.collect_list(c)), F.lit("]"))
    by = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("n"), (F.sum("l_linenumber") - 4 * F.count("*")).alias("ahead"), F.max("l_quantity").alias("q"), listed(id_).alias("ids"), listed(F.when(F.col("l_returnflag") == "R", id_)).alias("failing")
    )
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(by, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    word = lambda text: F.lit(f'"{text}"')
    outcome = F.when(F.col("o_orderstatus") == "F", word("solved")).when(F.col("o_orderstatus") == "O", word("gave_up")).otherwise(word("pending"))
    half = F.when(F.col("q").cast("int") % 2 == 1, (F.col("q") / 2).cast("string")).otherwise(F.coalesce((F.col("q") / 2).cast("int"), F.lit(0)).cast("string"))
    made = {
        "schema_version": F.when(F.year("o_orderdate") == 1995, 2).otherwise(3), "config_version": _quoted(F.when(F.col("c_acctbal") > 9000, "").otherwise(F.col("c_mktsegment"))), "task_id": _quoted(F.col("o_orderpriority")),
        "model": F.when(F.col("c_nationkey") != 7, word("m")), "outcome": outcome, "diff": word(""), "failed_ids": F.coalesce("failing", F.lit("[]")), "before_failed_ids": F.col("ids"), "verdict_status": word("ok"),
        "iterations": F.coalesce("n", F.lit(0)), "cost_usd": F.col("c_acctbal"), "cost_known": F.lit("true"), "max_iterations": half, "max_cost_usd": F.lit("1.5"), "tests_passed": F.col("ahead"),
        "note": F.when(F.month("o_orderdate") == 2, word("x")), "harness_error": F.when(F.col("o_totalprice") < 20000, word("lost")),
    }
    docs = o.select(F.col("o_orderkey").cast("string").alias("name"), _json(made).alias("value"))
    good, bad = rc.load(docs)
    none = lambda t: F.lit(None).cast(t)
    fine = good.select("name", F.lit("").alias("reasons"), "iterations", F.size("failed_ids").cast("long").alias("failing"), "cost_usd")
    other = bad.select("name", F.array_join("reasons", "; ").alias("reasons"), none("long").alias("iterations"), none("long").alias("failing"), none("double").alias("cost_usd"))
    return fine.unionByName(other).join(rc.holds_measurement(docs), "name")


# Test reports


@query("""WITH t AS (SELECT l_orderkey AS k, CASE WHEN l_tax >= 0.08 THEN '' ELSE 't::' || (l_partkey % 40) END AS id, CASE WHEN l_quantity >= 50 THEN 'lost' WHEN l_returnflag = 'A' THEN 'passed' WHEN l_returnflag = 'N' THEN 'xfailed' WHEN l_linestatus = 'F' THEN 'error' ELSE 'failed' END AS outcome,
CASE WHEN l_suppkey % 3 = 0 THEN 'c' || l_partkey WHEN l_suppkey % 3 = 1 THEN 's' || l_partkey ELSE 't' || l_partkey END AS message FROM lineitem),
b AS (SELECT k, count(*) AS n, count(DISTINCT id) AS d, count(*) FILTER (outcome = 'passed') AS passed, count(*) FILTER (outcome = 'xfailed') AS suppressed, bool_or(outcome = 'lost') AS lost, bool_or(id = '' AND outcome IN ('failed', 'error')) AS unnamed,
string_agg(id || ' ' || message, ', ' ORDER BY id) FILTER (outcome IN ('failed', 'error')) AS shown FROM t GROUP BY 1),
s AS (SELECT o_orderkey, o_orderstatus, b.*, CASE WHEN o_totalprice < 20000 THEN 'no exitcode' WHEN o_totalprice > 480000 THEN 'exitcode is not an integer' WHEN o_orderstatus = 'P' THEN 'the suite could not run: exit 2' WHEN n IS NULL THEN 'no outcomes by test'
WHEN lost THEN 'unknown outcomes lost' WHEN d < n THEN 'duplicate nodeids' WHEN o_orderstatus = 'O' AND n > 5 THEN 'the total is not the number of tests' WHEN unnamed THEN 'a failing test has no nodeid' END AS reason FROM orders LEFT JOIN b ON o_orderkey = k)
SELECT o_orderkey::VARCHAR AS name, CASE WHEN reason IS NULL THEN 'ok' ELSE 'no_verdict' END AS status, reason, CASE WHEN reason IN ('no exitcode', 'exitcode is not an integer') THEN NULL WHEN o_orderstatus = 'P' THEN 2 ELSE 1 END::BIGINT AS exit_code,
CASE WHEN reason IS NULL THEN passed END AS passed, CASE WHEN reason IS NULL THEN suppressed END AS suppressed, CASE WHEN reason IS NULL THEN coalesce(shown, '') END AS shown FROM s""")
def report_states(spark: SparkSession, sf: str) -> DataFrame:
    """Each order as a test report, its lines as tests: what is wrong with it, else its counts and failing tests with their messages, which stand in the
    call, the setup or the teardown."""
    q = lambda c: F.to_json(F.struct(c.alias("longrepr")))
    part, s = F.col("l_partkey").cast("string"), F.col("l_suppkey") % 3
    outcome = F.when(F.col("l_quantity") >= 50, "lost").when(F.col("l_returnflag") == "A", "passed").when(F.col("l_returnflag") == "N", "xfailed").when(F.col("l_linestatus") == "F", "error").otherwise("failed")
    test = {
        "nodeid": _quoted(F.when(F.col("l_tax") >= 0.08, "").otherwise(F.concat(F.lit("t::"), (F.col("l_partkey") % 40).cast("string")))), "outcome": _quoted(outcome),
        "call": F.when(s == 0, q(F.concat(F.lit("f()\nE   first\nE   c"), part, F.lit("\nend")))).when(s == 1, q(F.lit(""))),
        "setup": F.when(s < 2, q(F.concat(F.lit("\nE s"), part))), "teardown": q(F.concat(F.lit("any\nt"), part)),
    }
    by = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(_json(test))), ",").alias("tests"), F.count("*").alias("n"))
    o = table(spark, sf, "orders").join(by, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    code, status = F.when(F.col("o_orderstatus") == "P", "2").otherwise("1"), F.col("o_orderstatus")
    made = {
        "exitcode": F.when(F.col("o_totalprice") > 480000, _quoted(code)).when(F.col("o_totalprice") >= 20000, code), "tests": F.concat(F.lit("["), "tests", F.lit("]")),
        "summary": F.when(status == "O", F.concat(F.lit('{"total":'), F.least("n", F.lit(5)).cast("string"), F.lit("}"))),
    }
    seen = rp.test_reports(o.select(F.col("o_orderkey").cast("string").alias("name"), _json(made).alias("value")))
    shown = F.array_join(F.transform(F.array_sort("failed_ids"), lambda i: F.concat(i, F.lit(" "), F.element_at("errors", i))), ", ")
    return seen.select("name", "status", "reason", "exit_code", "passed", "suppressed", shown.alias("shown"))


# Paths that are never published

_STEMS = ("credentials", "service-account-{}", ".env", "{}", "notes.{}")
_FOLDERS = ("src", ".venv", "runs", "__pycache__", "runs.old", "Runs")


@query(f"""WITH f(i, folder) AS (VALUES {_values(enumerate(_FOLDERS))}), s(i, stem) AS (VALUES {_values(enumerate(_STEMS))}),
p AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'tasks' ELSE p_brand END || '/' || lower(p_type) || '/' || folder || '/' || replace(stem, '{{}}', split_part(p_name, ' ', 1)) || CASE p_size % 6 WHEN 0 THEN '.json' WHEN 1 THEN '.PEM' WHEN 2 THEN '.key' WHEN 3 THEN '.example' WHEN 4 THEN '' ELSE '.keys' END AS path
FROM part JOIN f ON (p_partkey // 5) % 6 = f.i JOIN s ON (p_partkey // 31) % 5 = s.i)
SELECT p_partkey, path, regexp_matches(path, '(?i)/(\\.env|\\.env\\.[^/]*|credentials\\.json|service-account[^/]*\\.json|[^/]+\\.(pem|key))$') AND path NOT LIKE '%/.env.example' OR regexp_matches(path, '(^|/)(\\.venv|__pycache__)(/|$)') OR regexp_matches(path, '^tasks/[^/]+/runs/') AS private FROM p""")
def path_states(spark: SparkSession, sf: str) -> DataFrame:
    """A path for each part, from its brand, type, name and size, and whether its file is never published."""
    k = F.col("p_partkey")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    folder, stem = pick(_FOLDERS, F.floor(k / 5) % 6), F.replace(pick(_STEMS, F.floor(k / 31) % 5), F.lit("{}"), F.split("p_name", " ")[0])
    path = F.concat(F.when(k % 4 == 0, "tasks").otherwise(F.col("p_brand")), F.lit("/"), F.lower("p_type"), F.lit("/"), folder, F.lit("/"), stem, pick((".json", ".PEM", ".key", ".example", "", ".keys"), F.col("p_size") % 6))
    return table(spark, sf, "part").select("p_partkey", path.alias("path")).withColumn("private", tx.private_path(F.col("path")))


# Diffs, one an order: its lines are the lines of one hunk

#: What lines of a file can say, and whether that is a statement or the head of a block.
_WORDS = {
    "tests/test_a.py": (("assert f() == 1", 1), ("assert g(x) == h(x)", 1), ("assert g(x) is not None", 1), ("assert y is not None", 1), ("def test_one():", 1), ("def test_two():", 1), ("@pytest.mark.skip", 0), ("# by hand", 0), ("y = f() + 1", 1), ("value of y", 0)),
    "conftest.py": (("collect_ignore = ['a']", 1), ("addopts = '--ignore=b'", 1), ("open('x.txt', 'w')", 1), ("import os", 1), ("open('tests/test_x.py', 'w')", 1), ("os.system('ls')", 1)),
    "src/a.py": (("try:", 1), ("except ValueError:", 1), ("except:", 1), ("pass", 1), ("log.info('x')", 1), ("g()", 1), ("with suppress(OSError):", 1), ("", 0), ("return", 1)),
    "lib/b.py": (
        ("import numpy as np", 1), ("arr = np.array", 1), ("arr.size = 3", 1), ("np._core = 3", 1), ("thing._x = 1", 1), ("sys.modules['a'] = b", 1), ("sys.path.insert(0, 'x')", 1), ("subprocess.run('b')", 1), ("open('.git/objects/a')", 1),
        ("if x and arr:", 1), ("thing.x = 1", 1),
    ),
    "pyproject.toml": (("[tool.dependencies]", 1), ("[other]", 1), ("package = '1.0'", 1), ("name>=2", 1), ("# name==2", 0), ("testpaths = ['t']", 1), ("", 0)),
}
_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
_FILES = dict(zip(_PRIORITIES, _WORDS))

_LINES_SQL = f"""WITH V(path, i, t, code) AS (VALUES {_values([(p, i, *w) for p, ws in _WORDS.items() for i, w in enumerate(ws)])}), P(priority, path) AS (VALUES {_values(_FILES.items())}), C AS (SELECT path, count(*) AS c FROM V GROUP BY 1),
L0 AS (SELECT l_orderkey AS k, P.path, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(_BY)}) AS ix, CASE l_returnflag WHEN 'A' THEN '+' WHEN 'R' THEN '-' ELSE ' ' END AS kind, t AS s, CASE WHEN l_linestatus = 'F' AND t <> '' THEN 4 ELSE 0 END AS ind, code = 1 AS code
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN P ON o_orderpriority = priority JOIN C ON C.path = P.path JOIN V ON V.path = P.path AND i = l_partkey % c),
L AS (SELECT *, count(*) FILTER (kind <> '+') OVER w AS old_no, count(*) FILTER (kind <> '-') OVER w AS new_no, path LIKE '%test%' AS is_test, list_distinct(regexp_extract_all(s, '\\w+')) AS ws FROM L0 WINDOW w AS (PARTITION BY k ORDER BY ix)),
A AS (SELECT * FROM L WHERE kind = '+'), G AS (SELECT * FROM L WHERE kind = '-'),
stray AS (SELECT g.k, g.s, len(g.ws) > 0 AND NOT EXISTS (SELECT 1 FROM A WHERE A.k = g.k AND len(list_intersect(g.ws, A.ws)) >= 0.6 * len(g.ws)) AS lost FROM G g WHERE is_test AND code),
X AS (SELECT k, coalesce(min(s) FILTER (lost), min(s)) AS eg FROM stray GROUP BY 1),
E AS (SELECT *, max(ind) OVER (PARTITION BY k) AS deepest FROM L WHERE kind <> '-' AND s <> ''),
H AS (SELECT h.k, h.ix, h.new_no, h.s, coalesce((SELECT min(e.ix) FROM E e WHERE e.k = h.k AND e.ix > h.ix AND e.ind <= h.ind), 999) AS stop FROM E h WHERE kind = '+' AND s LIKE 'except %:'),
D AS (SELECT *, max(CASE WHEN s LIKE '[%]' THEN ix END) OVER (PARTITION BY k ORDER BY ix) AS head FROM L WHERE path = 'pyproject.toml'),
pins AS (SELECT d.k, arg_min(CASE WHEN d.kind = '-' THEN d.old_no ELSE d.new_no END, d.ix) AS line, arg_min(d.s, d.ix) AS s FROM D d LEFT JOIN D h ON h.k = d.k AND h.ix = d.head WHERE d.kind <> ' ' AND (d.s LIKE 'name>=%' OR (h.s LIKE '%dependencies%' AND d.s LIKE '% = %')) GROUP BY 1),
hooks AS (SELECT DISTINCT k, unnest(list_filter(['collect_ignore', 'addopts', '--ignore', 'testpaths'], lambda x: contains(s, x))) AS hook FROM A WHERE path IN ('conftest.py', 'pyproject.toml')),
asserts AS (SELECT k, count(*) FILTER (kind = '-') AS gone, count(*) FILTER (kind = '+') AS come, bool_or(kind = '-' AND (s LIKE '%==%')) AS compared, arg_min(new_no, ix) FILTER (kind = '+' AND regexp_matches(s, '^assert \\w+ is not None')) AS line, arg_min(s, ix) FILTER (kind = '+' AND regexp_matches(s, '^assert \\w+ is not None')) AS s FROM L WHERE is_test AND kind <> ' ' AND s LIKE 'assert %' GROUP BY 1),
T AS (SELECT k, bool_or(s LIKE 'import numpy%') AS np, bool_or(s LIKE 'arr = np%') AS arr, bool_or(kind <> '+' AND (s LIKE 'os.system%' OR s LIKE 'subprocess%')) AS spawned, bool_or(kind <> '+' AND s LIKE 'sys.path%') AS moved FROM L GROUP BY 1),
R AS (SELECT k, 'test_edited_unjudged' AS kind, 'warning' AS severity, NULL::BIGINT AS line, '+' || count(*) FILTER (kind = '+') || '/-' || count(*) FILTER (kind = '-') || ' lines' || coalesce(', e.g. ' || any_value(eg), '') AS detail, 0 AS place FROM L LEFT JOIN X USING (k) WHERE is_test GROUP BY 1
UNION ALL SELECT k, 'test_deleted', 'cheat', old_no, 'removed test ' || s[5:12], 1 FROM G g WHERE is_test AND s LIKE 'def test%' AND NOT EXISTS (SELECT 1 FROM A WHERE A.k = g.k AND A.s = g.s)
UNION ALL SELECT k, 'suppression_added', 'cheat', new_no, s, 3 FROM A WHERE is_test AND s LIKE '@pytest.mark.skip%'
UNION ALL SELECT k, 'assertion_removed', 'cheat', 1, (gone - come) || ' fewer assertions', 4 FROM asserts WHERE gone > come
UNION ALL SELECT k, 'assertion_weakened', 'cheat', line, s, 4 FROM asserts WHERE gone > 0 AND gone <= come AND compared AND line IS NOT NULL
UNION ALL SELECT k, 'bare_except', 'cheat', new_no, 'bare except', 5 FROM A WHERE s = 'except:'
UNION ALL SELECT k, 'exception_suppressed', 'cheat', new_no, s, 5 FROM A WHERE s LIKE 'with suppress%'
UNION ALL SELECT k, 'exception_swallowed', 'cheat', new_no, s, 5 FROM H WHERE EXISTS (SELECT 1 FROM E WHERE E.k = H.k AND E.ix > H.ix AND E.ix < stop) AND NOT EXISTS (SELECT 1 FROM E WHERE E.k = H.k AND E.ix > H.ix AND E.ix < stop AND E.s NOT IN ('pass', 'return', 'log.info(''x'')'))
UNION ALL SELECT k, 'pin_changed', 'cheat', line, 'dependency changed: ' || s, 6 FROM pins
UNION ALL SELECT k, 'collection_changed', 'cheat', NULL, string_agg(hook, ', ' ORDER BY hook), 7 FROM hooks GROUP BY 1
UNION ALL SELECT k, CASE WHEN s LIKE '%.git/%' THEN 'git_internals_read' WHEN s LIKE '%test_x%' THEN 'tests_rewritten_at_runtime' WHEN s LIKE 'sys.path%' THEN 'import_path_manipulated' WHEN s LIKE 'open%' THEN 'import_time_side_effect' ELSE 'subprocess_spawned' END,
CASE WHEN (spawned AND (s LIKE 'os.%' OR s LIKE 'subp%')) OR (moved AND s LIKE 'sys.path%') THEN 'warning' ELSE 'cheat' END, new_no, s, 8 FROM A JOIN T USING (k) WHERE s LIKE 'open(%' OR s LIKE 'sys.path%' OR s LIKE 'os.system%' OR s LIKE 'subprocess%'
UNION ALL SELECT k, 'module_replaced', 'cheat', new_no, s, 9 FROM A WHERE s LIKE 'sys.modules%'
UNION ALL SELECT k, CASE WHEN s LIKE 'thing%' OR NOT np THEN 'private_attribute_assigned' ELSE 'library_patched' END, CASE WHEN s LIKE 'np%' AND np THEN 'cheat' ELSE 'warning' END, new_no, s, 9 FROM A JOIN T USING (k) WHERE s LIKE 'thing._x%' OR s LIKE 'np._core%' OR (s LIKE 'arr.size%' AND np AND arr))"""


def _order_diffs(spark: SparkSession, sf: str) -> DataFrame:
    """(o_orderkey, diff): the priority names the file, a line's part says what it says, its flag its side and its status how deep it stands."""
    path = F.element_at(F.create_map(*(F.lit(x) for pair in _FILES.items() for x in pair)), F.col("o_orderpriority"))
    words = F.element_at(F.create_map(*(c for p, ws in _WORDS.items() for c in (F.lit(p), F.array(*(F.lit(w) for w, _ in ws))))), F.col("path"))
    said = F.element_at(words, (F.col("l_partkey") % F.size(words) + 1).cast("int"))
    sign = F.when(F.col("l_returnflag") == "A", "+").when(F.col("l_returnflag") == "R", "-").otherwise(" ")
    both = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select("o_orderkey", path.alias("path")), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("said", said)
    line = F.concat(sign, F.when((F.col("l_linestatus") == "F") & (F.col("said") != ""), "    ").otherwise(""), "said")
    by = both.groupBy("o_orderkey", "path").agg(F.array_sort(F.collect_list(F.struct(*_BY, line.alias("line"))))["line"].alias("ls"))
    side = lambda other: F.size(F.filter("ls", lambda x: ~x.startswith(other))).cast("string")
    name = F.col("path")
    head = F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name, F.lit("\n--- a/"), name, F.lit("\n+++ b/"), name, F.lit("\n@@ -1,"), side("+"), F.lit(" +1,"), side("-"), F.lit(" @@\n"))
    return by.select("o_orderkey", F.concat(head, F.array_join("ls", "\n"), F.lit("\n")).alias("diff"))


@query(_LINES_SQL + " SELECT k AS key, kind, severity, line, detail FROM R")
def order_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Every finding in the orders' diffs, with its line and detail."""
    return dt.findings(dt.prepare(_order_diffs(spark, sf), "o_orderkey", "diff"), "numpy").select("key", "kind", "severity", "line", "detail")


@query(_LINES_SQL + " SELECT kind, count(*) AS n, count(DISTINCT k) AS runs, arg_min(detail, (k, place, coalesce(line, -1))) AS example FROM R GROUP BY 1")
def order_finding_counts(spark: SparkSession, sf: str) -> DataFrame:
    """By kind the findings in the orders' diffs, the runs that have one, and the first one's detail."""
    from .report import finding_counts

    return finding_counts(dt.findings(dt.prepare(_order_diffs(spark, sf), "o_orderkey", "diff"), "numpy"))


# Renames

_OLD, _NEW = ("tests/test_{}.py", "src/{}_test.py", "conftest.py", "src/{}.py"), ("tests/test_{}.py", "tests/{}.py", "src/{}.py", "old/test_{}.txt", "testing/{}_test.py")


@query(f"""WITH a(i, o) AS (VALUES {_values(enumerate(_OLD))}), b(i, n) AS (VALUES {_values(enumerate(_NEW))}),
m AS (SELECT o_orderkey AS key, replace(o, '{{}}', lower(c_mktsegment)) AS old_path, replace(n, '{{}}', o_orderstatus) AS path FROM orders JOIN customer ON o_custkey = c_custkey JOIN a ON c_nationkey % 4 = a.i JOIN b ON o_orderkey % 5 = b.i),
f AS (SELECT *, regexp_matches(old_path, '(^|/)(test_[^/]+|[^/]+_test)\\.py$') AS collected, regexp_matches(path, '(^|/)(test_[^/]+|[^/]+_test)\\.py$') AS still, regexp_matches(old_path, '^tests/|conftest') AS test FROM m)
SELECT key, old_path, path, CASE WHEN collected AND NOT still THEN 'tests_hidden' ELSE 'test_renamed' END AS kind, CASE WHEN collected AND NOT still THEN 'cheat' ELSE 'warning' END AS severity FROM f WHERE collected OR test""")
def rename_findings(spark: SparkSession, sf: str) -> DataFrame:
    """A renamed file for each order, and whether the runner no longer finds its tests."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    pick = lambda values, i, word: F.replace(F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int")), F.lit("{}"), word)
    m = o.select("o_orderkey", pick(_OLD, F.col("c_nationkey") % 4, F.lower("c_mktsegment")).alias("a"), pick(_NEW, F.col("o_orderkey") % 5, F.col("o_orderstatus")).alias("b"))
    diff = F.format_string("diff --git a/%s b/%s\nsimilarity index 100%%\nrename from %s\nrename to %s\n", "a", "b", "a", "b")
    found = dt.hidden_tests(dt.prepare(m.select("o_orderkey", diff.alias("diff")), "o_orderkey", "diff"))
    return found.select("key", F.regexp_replace("detail", "^renamed from ", "").alias("old_path"), "path", "kind", "severity")
