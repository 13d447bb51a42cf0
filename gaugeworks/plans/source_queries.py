"""Queries of task folders, sheets, versioned tables and files in ranges. Their files are written from the given tables and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detectors as dt
from ..shared import new_path
from ..sources import files as fl
from ..sources import sheets as sh
from ..sources import tasks as tk
from ..sources import versioned as vs
from ..sources.reports import token
from .catalogue import query, table

# Files in ranges

_BUCKET = 50
_KEY = "CASE WHEN doc_id % 3 = 0 THEN ' key AKIA' || upper(substr(sha256({0}), 1, 16)) || '.' ELSE '' END"
_TOKEN = "CASE WHEN doc_id % 5 = 0 THEN chr(10) || 'sk-' || sha256({0}) ELSE '' END"
_RULES = "(VALUES ('AWS access key', '\\b(?:AKIA|ASIA)[A-Z0-9]{16}\\b'), ('provider token', '\\bsk-(?:(?:proj|svcacct|ant-api\\d+|or-v1)-)?[A-Za-z0-9_-]{24,}'))"


@query(rf"""WITH d AS (SELECT doc_id // {_BUCKET} AS f, string_agg({_TOKEN.format("doc_id::VARCHAR")} || coalesce(text, '') || {_KEY.format("doc_id::VARCHAR")}, chr(10) ORDER BY doc_id) AS body FROM documents GROUP BY 1
), l AS (SELECT f, generate_subscripts(string_split(body, chr(10)), 1) AS line, unnest(string_split(body, chr(10))) AS t FROM d)
SELECT f || '.txt' AS name, rule, line::BIGINT AS line, len(regexp_extract_all(t, pattern))::BIGINT AS n FROM l, {_RULES} r(rule, pattern) WHERE regexp_matches(t, pattern)""")
def publication_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files of fifty, with keys and tokens among their words, scanned in ranges of 10,000 bytes."""
    key = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" key AKIA"), F.upper(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 16)), F.lit("."))).otherwise("")
    lead = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("\nsk-"), F.sha2(F.col("doc_id").cast("string"), 256))).otherwise("")
    body = F.concat(lead, F.coalesce("text", F.lit("")), key)
    by = table(spark, sf, "documents").groupBy(F.floor(F.col("doc_id") / _BUCKET).alias("f")).agg(F.array_sort(F.collect_list(F.struct("doc_id", body.alias("body")))).alias("parts"))
    path = new_path(spark, "published")
    fl.write_files(by.select(F.concat(F.col("f").cast("string"), F.lit(".txt")).alias("path"), F.array_join("parts.body", "\n").alias("value")), path)
    return fl.secret_findings(fl.read_ranges(spark, path, piece=10_000))


# Sheets and versions

_SHEET_SQL = """WITH p AS (SELECT doc_id, toxic, CASE WHEN quality = 1 AND doc_id % 2 = 0 THEN 'equivalent' END AS recorded, count(*) OVER (PARTITION BY substr(sha256(doc_id::VARCHAR), 1, 6)) AS pairs FROM labels),
s AS (SELECT doc_id, pairs, recorded, 1 AS sheet, CASE WHEN recorded IS NOT NULL THEN recorded WHEN toxic = 1 THEN 'agent_wrong' ELSE 'unclear' END AS verdict, 30 AS reason FROM p WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, pairs, recorded, 2, CASE doc_id % 4 WHEN 0 THEN 'equivalent' WHEN 1 THEN 'nonsense' WHEN 2 THEN 'agent_wrong' ELSE 'skip' END, CASE doc_id % 4 WHEN 2 THEN 5 WHEN 3 THEN 0 ELSE 30 END FROM p WHERE doc_id % 3 = 1),
c AS (SELECT *, CASE WHEN pairs > 1 THEN 'several pairs' WHEN verdict = 'nonsense' THEN 'not a verdict' WHEN recorded <> verdict THEN 'labelled otherwise' WHEN recorded IS NULL AND verdict <> 'skip' AND reason < 20 THEN 'reason too short' END AS problem FROM s),
v AS (SELECT *, bool_or(problem IS NOT NULL) OVER (PARTITION BY sheet) AS stopped FROM c),
r AS (SELECT *, CASE WHEN problem IS NOT NULL THEN 'problem' WHEN recorded IS NOT NULL THEN 'unchanged' WHEN stopped THEN 'held' ELSE 'applied' END AS state FROM v)"""


@query(_SHEET_SQL + """ SELECT sheet, state, problem, count(*) AS n FROM r GROUP BY ALL
UNION ALL SELECT 0, 'recorded', coalesce(r.verdict, p.recorded), count(*) FROM p LEFT JOIN r ON r.doc_id = p.doc_id AND r.state = 'applied' GROUP BY ALL""")
def sheet_import(spark: SparkSession, sf: str) -> DataFrame:
    """Two sheets taken into a versioned table of labels: the first is sound and applied, the second has problems and is held. Sheet 0: what is recorded then."""
    l = table(spark, sf, "labels").withColumn("id", F.col("doc_id").cast("string"))  # noqa: E741
    recorded = F.when((F.col("quality") == 1) & (F.col("doc_id") % 2 == 0), "equivalent")
    path, none = new_path(spark, "labels"), F.lit(None).cast("string")
    vs.publish(l.select("id", recorded.alias("neutral"), none.alias("rationale"), none.alias("at"), none.alias("source")), path, 0, sh.LAYOUT)
    line = lambda verdict, why: F.concat(F.lit("| `"), token(F.col("id")), F.lit("` | "), verdict, F.lit(" | "), why, F.lit(" |")).alias("value")
    fine, k = F.coalesce(recorded, F.when(F.col("toxic") == 1, "agent_wrong").otherwise("unclear")), F.col("doc_id") % 4
    reason = F.rpad(F.concat(F.lit("because of "), "id"), 30, ".")
    first = l.where("doc_id % 3 = 0").select(line(fine, reason))
    verdict = F.when(k == 0, "equivalent").when(k == 1, "nonsense").when(k == 2, "agent_wrong").otherwise("skip")
    second = l.where("doc_id % 3 = 1").select(line(verdict, F.when(k == 2, "short").when(k == 3, "").otherwise(reason)))
    seen = [sh.import_sheet(s, path, "2026-01-02T03:04:05").report.withColumn("sheet", F.lit(i)) for i, s in ((1, first), (2, second))]
    counted = seen[0].unionByName(seen[1]).groupBy("sheet", "state", F.try_element_at("problems", F.lit(1)).alias("problem")).agg(F.count("*").alias("n"))
    now = vs.read(spark, path, sh.LAYOUT).groupBy("neutral").agg(F.count("*").alias("n"))
    return counted.unionByName(now.select(F.lit(0).alias("sheet"), F.lit("recorded").alias("state"), F.col("neutral").alias("problem"), "n"))


# Task folders

#: The lines that the reference patch of task %1$s changes in its test file.
_PATCH = ("-def test_old_%1$s():", "-    assert old_%1$s() == %1$s", "+@pytest.mark.skip", "+def test_new_%1$s():", "+    assert new_%1$s() == %1$s")


def _diff(path: str, lines: Column, start: Column | None = None) -> Column:
    start = F.lit(1) if start is None else start
    side = lambda other: F.size(F.filter(lines, lambda x: ~x.startswith(other)))
    head = F.format_string(f"diff --git a/{path} b/{path}\n--- a/{path}\n+++ b/{path}\n@@ -%d,%d +%d,%d @@\n", start, side("+"), start, side("-"))
    return F.concat(head, F.array_join(lines, "\n"), F.lit("\n"))


def _task_folders(spark: SparkSession, sf: str) -> str:
    """A folder for each nation: every fifth has no reference patch, the next one an empty one; one in three has a coverage report, one in three
    names paths that are never reached; one in four has no report of the state before, and one in four one of a suite that couldn't run."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("t"), "n_name")
    by = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("t")).agg(
        F.array_sort(F.collect_list(F.struct(F.concat(F.lit("t::"), F.col("c_custkey").cast("string")).alias("nodeid"), F.when(F.col("c_acctbal") < 0, "failed").otherwise("passed").alias("outcome")))).alias("tests")
    )
    t = F.col("t").cast("string")
    definition = F.format_string(
        "id: t%s\nrepo: r\nbase_sha: '0%s'\ntest_command: run\npackage: lib\nfrom_version: '1'\nto_version: '2'\ncontamination: {risk: low, reason: made}\nroot_causes: [a, b, c]\nunreachable: [%s]\n", t, t, F.when(F.col("t") % 3 == 1, "lib/").otherwise("")
    )
    patch = F.when(F.col("t") % 5 == 1, "").when(F.col("t") % 5 > 1, _diff("tests/test_a.py", F.array(*(F.format_string(x, t) for x in _PATCH))))
    covered = F.when(F.col("t") % 3 == 0, F.to_json(F.struct(F.create_map(F.lit("./lib/core.py"), F.struct(F.concat(F.sequence(F.lit(1), F.lit(10)), F.sequence(F.lit(21), F.lit(30))).alias("executed_lines"))).alias("files"))))
    report = F.when(F.col("t") % 4 > 0, F.to_json(F.struct(F.when(F.col("t") % 4 == 1, 2).otherwise(1).alias("exitcode"), F.coalesce("tests", F.array()).alias("tests"))))
    files = F.array(*(F.struct(F.lit(name).alias("name"), v.alias("value")) for name, v in (("task.yaml", definition), ("reference.patch", patch), ("coverage.json", covered), ("broken-report.json", report))))
    each = n.join(by, "t", "left").select(t.alias("t"), F.explode(files).alias("f")).where("f.value is not null")
    path = new_path(spark, "tasks")
    fl.write_files(each.select(F.concat(F.lit("t"), "t", F.lit("/"), "f.name").alias("path"), F.col("f.value").alias("value")), path)
    return path


@query("""WITH t AS (SELECT n_nationkey AS t, count(c_custkey) FILTER (c_acctbal < 0) AS failed FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1)
SELECT 't' || t AS task, CASE WHEN t % 4 > 1 THEN 'ok' ELSE 'no_verdict' END AS status, CASE t % 4 WHEN 0 THEN 'the state before is unknown' WHEN 1 THEN 'the suite could not run: exit 2' END AS reason, CASE WHEN t % 4 > 1 THEN failed END AS failed FROM t""")
def task_states(spark: SparkSession, sf: str) -> DataFrame:
    """The recorded state before of each task folder."""
    tasks = tk.usable(tk.read_task_folders(spark, _task_folders(spark, sf)))
    return tk.before_states(tasks).select("task", "status", "reason", "failed")


_TASK_SQL = """WITH c AS (SELECT c_custkey AS k, c_nationkey AS t, c_mktsegment AS s, c_nationkey % 5 = 0 AS unknown, c_nationkey % 5 > 1 AS allowed, c_custkey % 40 + 1 AS a FROM customer),
f AS (SELECT t, CASE WHEN s = 'MACHINERY' THEN 'scratch_file_left' WHEN unknown THEN 'test_edited_unjudged' WHEN NOT allowed OR s = 'FURNITURE' THEN 'test_edited' WHEN s = 'HOUSEHOLD' THEN 'test_edited_beyond_reference' WHEN s = 'BUILDING' THEN 'test_migrated_variant' ELSE 'test_migrated' END AS kind FROM c
UNION ALL SELECT t, CASE WHEN allowed THEN 'test_deleted_by_reference' ELSE 'test_deleted' END FROM c WHERE s <> 'MACHINERY'
UNION ALL SELECT t, CASE WHEN allowed THEN 'suppression_by_reference' ELSE 'suppression_added' END FROM c WHERE s <> 'MACHINERY'
UNION ALL SELECT t, 'assertion_removed' FROM c WHERE s = 'FURNITURE'
UNION ALL SELECT t, 'unverified_edit' FROM c WHERE t % 3 = 1 OR t % 3 = 0 AND NOT (a <= 10 OR a + 2 >= 21 AND a <= 30))"""


@query(_TASK_SQL + """ SELECT 't' || t AS task, kind, CASE WHEN kind IN ('test_edited', 'test_deleted', 'suppression_added', 'assertion_removed') THEN 'cheat' ELSE 'warning' END AS severity, count(*) AS n FROM f GROUP BY ALL""")
def reference_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's diff judged beside the folder of its nation's task: what the reference patch changes is sanctioned, and what the tests run is known
    for some tasks. The segment decides what a diff does beyond the patch's lines: nothing, one more assertion, one less, one reworded, or an empty file."""
    tasks = tk.usable(tk.read_task_folders(spark, _task_folders(spark, sf)))
    k, t, s = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string"), F.col("c_mktsegment")
    none = F.array().cast("array<string>")
    more = (
        F.when(s == "BUILDING", F.array(F.format_string("+    assert extra_%s() == %s", k, t))).when(s == "FURNITURE", F.array(F.format_string("-    assert more_%s() == 'x%s'", k, k)))
        .when(s == "HOUSEHOLD", F.array(F.format_string("-    assert kept_%s(alpha, beta) == gamma", k), F.format_string("+    assert kept_%s(alpha, beta, delta) == gamma", k))).otherwise(none)
    )
    made = F.when(s == "MACHINERY", "diff --git a/tests/test_n.py b/tests/test_n.py\nnew file mode 100644\n").otherwise(_diff("tests/test_a.py", F.concat(F.array(*(F.format_string(x, t) for x in _PATCH)), more)))
    core = _diff("lib/core.py", F.array(F.lit(" x = 1"), F.concat(F.lit("-y = "), k), F.concat(F.lit("+y = 0"), k), F.lit(" z = 3")), F.col("c_custkey") % 40 + 1)
    runs = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("t"), t).alias("task"), F.concat(made, core).alias("diff"))
    p = dt.prepare(runs, "c_custkey", "diff", tk.reference_lines(tasks), "task", tk.referenced(tasks))
    found = dt.findings(p, executed=tk.executed(tasks), prefixes=tk.unreached(tasks), covered=tk.covered(tasks))
    return found.join(runs.select(F.col("c_custkey").alias("key"), "task"), "key").groupBy("task", "kind", "severity").agg(F.count("*").alias("n"))
