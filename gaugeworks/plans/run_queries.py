"""Queries of run records, scores, detectors and calibration, on rows that are derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fingerprints as fp
from ..functions import labels as lb
from ..functions import text as tx
from ..operators import detectors as dt
from ..operators import judging as jd
from ..operators import sampling as sm
from ..operators import scoring as sc
from ..operators import sequences as sq
from ..sources import records as rc
from ..sources import reports as src
from . import rates
from . import report as rv
from . import screening as sn
from .catalogue import _DHI, _DLO, _HI, _LO, _D, _agreement_sql, query, rounded, table

# Orders as runs

_RUNS = """R AS (SELECT o_orderkey AS k, o_orderpriority AS task_id, c_mktsegment AS model_id, c_mktsegment || '-' || (o_orderkey % 3) AS config_version, (o_orderkey % 3 + 1) * 10 AS max_iterations,
o_orderkey % 11 <> 0 AND o_orderstatus <> 'P' AS scored, o_orderkey % 11 <> 0 AND o_orderkey % 5 = 0 AS flagged, o_orderkey % 4 <> 0 AS patched, o_orderkey % 11 <> 0 AND o_orderkey % 4 <> 0 AS detectable,
CASE WHEN o_orderkey % 5 = 0 THEN 0.0 ELSE least(1.0, o_totalprice / 250000) END AS credible, o_totalprice / 1000 AS cost, o_orderkey % 6 <> 0 AS cost_known, o_orderkey % 10 AS outcome, o_orderpriority = '5-LOW' AS smoke
FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _runs(spark, sf) -> DataFrame:
    k = F.col("o_orderkey")
    both = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    progress = F.least(F.lit(1.0), F.col("o_totalprice") / 250000)
    cheats = F.when(k % 5 == 0, F.array(F.lit("pin_changed"))).otherwise(F.array().cast("array<string>"))
    score = F.struct((F.col("o_orderstatus") != "P").alias("valid"), progress.alias("progress"), F.when(k % 5 == 0, 0.0).otherwise(progress).alias("credible_progress"), cheats.alias("cheats"))
    config = F.struct(F.col("c_mktsegment").alias("model_id"), F.when(k % 2 == 0, F.lit("")).alias("provider_route"))
    records = both.select(
        "o_orderkey", F.col("o_orderpriority").alias("task_id"), F.concat("c_mktsegment", F.lit("-"), (k % 3).cast("string")).alias("config_version"), F.lit("m").alias("model"), _picked(rc.OUTCOMES, k).alias("outcome"),
        F.when(k % 4 == 0, " \n").otherwise("diff").alias("diff"), (F.col("o_totalprice") / 1000).alias("cost_usd"), (k % 6 != 0).alias("cost_known"), ((k % 3 + 1) * 10).alias("max_iterations"),
        F.when(k % 13 == 0, F.array(F.lit("fly"))).otherwise(F.array().cast("array<string>")).alias("hallucinated_tools"),
        F.when(k % 11 != 0, F.parse_json(F.to_json(score))).alias("score"), F.parse_json(F.to_json(config)).alias("config"),
    )
    tasks = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("id")).distinct().withColumn("is_smoke_test", F.col("id") == "5-LOW")
    return rv.runs(records, tasks)


@query(f"""WITH {_RUNS} SELECT task_id, config_version, count(*) AS n, count(*) FILTER (scored) AS n_scored, count(*) FILTER (scored AND flagged) AS k_scored, count(*) FILTER (detectable) AS n_patched,
count(*) FILTER (detectable AND flagged) AS k_patched, round(sum(cost) FILTER (cost_known), 4) AS cost, count(*) FILTER (NOT scored) AS n_unscoreable, count(*) FILTER (outcome = 8) AS n_broke,
count(*) FILTER (scored AND credible >= 1) AS n_solved, count(*) FILTER (NOT cost_known) AS n_cost_unknown FROM R GROUP BY 1, 2""")
def run_cells(spark, sf):
    return rv.cells(_runs(spark, sf)).drop("narrow_low", "narrow_high", "broad_low", "broad_high").withColumn("cost", F.round("cost", 4))


_FLAGS = "SELECT model_id, count(*) FILTER (flagged) AS k, count(*) AS n FROM R WHERE detectable AND NOT smoke GROUP BY 1"


@query(f"WITH {_RUNS}, t AS ({_FLAGS}) SELECT model_id, k, n, 0::BIGINT AS n_unknown, round(k/n,6) AS rate, round({_LO},6) AS low, round({_HI},6) AS high FROM t")
def run_flag_rates(spark, sf):
    return rounded(rv.flag_rates(_runs(spark, sf)), "rate", "low", "high")


@query(f"""WITH {_RUNS}, t AS ({_FLAGS}), p AS (SELECT a.model_id AS first, b.model_id AS second, a.k AS k1, a.n AS n1, b.k AS k2, b.n AS n2 FROM t a JOIN t b ON a.model_id < b.model_id)
SELECT first, second, k1, n1, k2, n2, round({_D},6) AS difference, round({_DLO},6) AS low, round({_DHI},6) AS high, ({_DLO}) > 0 OR ({_DHI}) < 0 AS established FROM p""")
def run_model_differences(spark, sf):
    return rounded(rv.model_differences(_runs(spark, sf)), "difference", "low", "high")


@query(f"""WITH {_RUNS} SELECT count(*) FILTER (scored AND patched) AS n_narrow, count(*) FILTER (scored AND patched AND flagged) AS k_narrow, count(*) FILTER (detectable) AS n_broad,
count(*) FILTER (detectable AND flagged) AS k_broad, count(*) FILTER (NOT patched) AS n_unpatched FROM R WHERE NOT smoke""")
def run_denominators(spark, sf):
    return rv.denominators(_runs(spark, sf)).drop("narrow", "broad")


@query(f"""WITH {_RUNS} SELECT count(*) AS runs, count(DISTINCT (task_id, config_version)) AS cells, count(DISTINCT task_id) AS tasks, count(DISTINCT model_id) AS models, round(sum(cost) FILTER (cost_known), 3) AS cost FROM R""")
def run_measured(spark, sf):
    return rv.measured(_runs(spark, sf)).withColumn("cost", F.round("cost", 3))


@query(f"""WITH {_RUNS} SELECT max_iterations, CASE WHEN outcome = 0 THEN 'solved cleanly' WHEN outcome = 1 THEN 'green but flagged' WHEN outcome < 4 THEN 'stopped short' WHEN outcome < 7 THEN 'hit a cap'
ELSE 'no verdict or broke the suite' END AS class, count(*) AS n FROM R GROUP BY 1, 2""")
def run_outcome_classes(spark, sf):
    return rv.outcome_classes(_runs(spark, sf))


@query(f"""WITH {_RUNS}, c AS (SELECT count(*) AS n, count(*) FILTER (outcome = 7) AS a, count(*) FILTER (k % 13 = 0) AS b, count(*) FILTER (outcome = 9) AS c, count(*) FILTER (outcome = 8) AS d FROM R),
t AS (SELECT 'unattributed' AS name, a AS k, n FROM c UNION ALL SELECT 'invented_tool', b, n FROM c UNION ALL SELECT 'harness_error', c, n FROM c UNION ALL SELECT 'broke_suite', d, n FROM c)
SELECT name, k, n, round(k/n,6) AS rate, round({_LO},6) AS low, round({_HI},6) AS high FROM t""")
def run_failures(spark, sf):
    return rounded(rv.failures(_runs(spark, sf)), "rate", "low", "high")


@query(f"""WITH {_RUNS} SELECT model_id, round(list_sort(list(cost))[count(*) // 2 + 1], 6) AS upper_median, count(*) AS n, round(avg(cost), 6) AS mean, round(max(cost), 6) AS greatest FROM R WHERE cost_known GROUP BY 1""")
def run_costs(spark, sf):
    return rounded(rv.costs(_runs(spark, sf), ["model_id"]), "upper_median", "mean", "greatest")


@query(f"""WITH {_RUNS}, t AS (SELECT task_id, model_id, max_iterations, count(*) FILTER (credible >= 1) AS k, count(*) AS n FROM R WHERE scored GROUP BY 1, 2, 3)
SELECT *, count(*) OVER (PARTITION BY task_id, model_id) AS points FROM t QUALIFY count(*) OVER (PARTITION BY task_id, model_id) >= 2""")
def run_ladder(spark, sf):
    return rv.ladder(_runs(spark, sf))


@query(f"""WITH {_RUNS} SELECT task_id, CASE WHEN NOT scored THEN 'unscoreable' WHEN credible >= 1 THEN 'solved' WHEN credible > 0 THEN 'partial' ELSE 'none' END AS class, flagged AS has_cheat, count(*) AS n FROM R GROUP BY 1, 2, 3""")
def run_strata(spark, sf):
    r = _runs(spark, sf)
    return r.groupBy(rv.stratum(r).alias("s")).agg(F.count("*").alias("n")).select("s.task_id", "s.class", "s.has_cheat", "n")


@query(f"""WITH {_RUNS}, c AS (SELECT model_id, list_sort(list(DISTINCT max_iterations)) AS caps FROM R WHERE model_id <> 'BUILDING' OR k % 3 <> 0 GROUP BY 1)
SELECT model_id, array_to_string(caps, ',') AS caps, (SELECT count(DISTINCT caps) FROM c) > 1 AS unmatched FROM c""")
def run_caps(spark, sf):
    own = rv.caps(_runs(spark, sf).where("model_id <> 'BUILDING' or o_orderkey % 3 <> 0"), "model_id")
    return own.withColumn("caps", F.array_join(F.transform("caps", lambda c: c.cast("string")), ","))


@query("""SELECT CASE o_orderkey % 3 WHEN 0 THEN 'b-' WHEN 1 THEN '' ELSE '' END || CASE WHEN o_orderkey % 2 = 0 THEN 'i30-' ELSE '' END || 'r' || lpad((o_orderkey % 12)::VARCHAR, 2, '0') AS name,
CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'openrouter' WHEN 2 THEN 'openrouter:x' ELSE 'openrouter' END AS route, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 7 END, o_orderkey % 5)::BIGINT AS code, count(*) AS n FROM orders GROUP BY 1, 2, 3""")
def run_names(spark, sf):
    k = F.col("o_orderkey")
    name = rv.cell_name(F.when(k % 3 == 0, "b").when(k % 3 == 1, ""), F.when(k % 2 == 0, 30), k % 12)
    route = rv.provider_route(k % 4 != 0, F.when(k % 4 == 1, "").when(k % 4 == 2, "x"))
    code = tx.exit_code(F.when(k % 3 == 0, k % 7), F.concat(F.lit("the suite could not run: exit code "), (k % 5).cast("string")))
    return table(spark, sf, "orders").groupBy(name.alias("name"), route.alias("route"), code.alias("code")).agg(F.count("*").alias("n"))


@query("""SELECT key, CASE WHEN harness THEN 'harness_error' WHEN NOT valid THEN CASE WHEN agent THEN 'broke_suite' ELSE 'no_verdict' END WHEN failing = 0 AND NOT cheat THEN 'solved' WHEN failing = 0 THEN 'solved_with_cheats'
WHEN key % 7 = 0 THEN 'gave_up' WHEN key % 4 = 0 THEN 'cost_limit' WHEN key % 11 = 0 THEN 'time_limit' WHEN key % 6 = 0 THEN 'iteration_limit' ELSE 'stopped_without_solving' END AS outcome
FROM (SELECT o_orderkey AS key, o_orderkey % 17 = 0 AS harness, o_orderstatus <> 'P' AS valid, o_orderkey % 2 = 0 AS agent, o_orderkey % 3 AS failing, o_orderkey % 5 = 0 AS cheat FROM orders)""")
def final_outcomes(spark, sf):
    k = F.col("o_orderkey")
    label = sc.final_outcome(
        F.when(k % 17 == 0, "x"), F.col("o_orderstatus") != "P", F.when(k % 2 == 0, "agent").otherwise("harness"), k % 3, (k % 5 == 0).cast("int"), k % 7 == 0, k % 4 == 0, k % 11 == 0, k % 6 == 0
    )
    return table(spark, sf, "orders").select(k.alias("key"), label.alias("outcome"))


@query("""WITH u AS (SELECT user_id AS key, coalesce(list(DISTINCT event_id % 40) FILTER (event_type = 'error'), []) AS b, coalesce(list(DISTINCT event_id % 40) FILTER (event_type = 'purchase'), []) AS a FROM events GROUP BY 1),
g AS (SELECT *, CASE WHEN key % 10 = 1 THEN 'harness' WHEN len(b) = 0 THEN 'task' WHEN key % 10 = 3 THEN 'harness' WHEN key % 10 = 2 THEN CASE WHEN key % 7 IN (2, 5) AND key % 3 > 0 THEN 'agent' ELSE 'harness' END END AS cause FROM u),
c AS (SELECT key, count(*) AS total, count(*) FILTER (gone) AS fixed FROM (SELECT key, id % 6, bool_and(NOT list_contains(a, id)) AS gone FROM (SELECT key, a, unnest(b) AS id FROM g) GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT g.*, total, c.fixed AS cfixed, len(list_filter(b, lambda x: NOT list_contains(a, x))) AS fx, len(list_intersect(a, b)) AS still, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS fresh FROM g LEFT JOIN c USING (key))
SELECT key, CASE WHEN cause IS NULL THEN 'scored' ELSE 'unscoreable' END AS status, cause AS unscoreable_cause, CASE WHEN cause IS NULL THEN fx END AS fixed, CASE WHEN cause IS NULL THEN still END AS still_failing,
CASE WHEN cause IS NULL THEN fresh END AS newly_broken, CASE WHEN cause IS NULL THEN round_even(fx / len(b), 3) END AS progress, CASE WHEN cause IS NULL THEN total END AS clusters_total, CASE WHEN cause IS NULL THEN cfixed END AS clusters_fixed,
CASE WHEN cause IS NULL THEN round_even(cfixed / total, 3) END AS cluster_progress, CASE WHEN key % 4 = 0 THEN 1 ELSE 0 END AS n_cheats, CASE WHEN cause IS NULL AND key % 4 <> 0 THEN round_even(fx / len(b), 3) ELSE 0 END AS credible_progress FROM s""")
def score_runs(spark, sf):
    kind, u = F.col("event_type"), F.col("user_id")
    ids = lambda of: F.array_sort(F.collect_set(F.when(kind == of, (F.col("event_id") % 40).cast("string"))))
    by = table(spark, sf, "events").groupBy("user_id").agg(ids("error").alias("b"), ids("purchase").alias("a"))
    errors = lambda c: F.map_from_arrays(c, F.transform(c, lambda x: F.concat(F.lit("E "), (x.cast("int") % 6).cast("string"))))
    state = lambda c, ok: F.struct(ok.alias("ok"), F.col(c).alias("failed_ids"), errors(F.col(c)).alias("errors"), F.lit(0).alias("suppressed"), F.lit("lost").alias("reason"), (u % 7).alias("exit_code"))
    files = F.array_repeat(F.lit("f"), (u % 3).cast("int"))
    runs = by.select(u.alias("key"), state("b", u % 10 != 1).alias("before"), state("a", u % 10 != 2).alias("after"), F.when(u % 10 == 3, "timeout").alias("interrupted"), files.alias("changed_files"))
    found = runs.where("key % 4 = 0").select("key", F.lit("cheat").alias("severity"), F.lit("pin_changed").alias("kind"))
    return sc.score(runs, found).select("key", "status", "unscoreable_cause", "fixed", "still_failing", "newly_broken", "progress", "clusters_total", "clusters_fixed", "cluster_progress", "n_cheats", "credible_progress")


# Records and reports with one thing wrong

_RECORD = (
    '{"schema_version":3,"config_version":"c","task_id":"t","model":"m","outcome":"solved","verdict_status":"ok","diff":"","failed_ids":[],"before_failed_ids":["a"],"iterations":1,'
    '"cost_usd":1.5,"cost_known":true,"max_iterations":50,"max_cost_usd":1.0,"tests_passed":4,"wall_seconds":2.0}'
)
_BROKEN = (
    ("", "", "loaded"), ('"schema_version":3', '"schema_version":2', "schema v2"), ('"model":"m",', "", "missing required model"), ('"config_version":"c"', '"config_version":""', "no config_version"),
    ('"diff":""', '"diff":"","extra":1', "unknown fields extra"), ('"task_id":"t"', '"task_id":7', "task_id is not a string"), ('"model":"m"', '"model":" "', "model is empty"), ('"solved"', '"won"', "unknown outcome"),
    ('"ok"', '"maybe"', "unknown verdict_status"), ('"diff":""', '"diff":3', "diff is not a string"), ('"failed_ids":[],', '"failed_ids":[1],', "failed_ids is not a list of strings"),
    ('["a"]', '["a","a"]', "before_failed_ids has duplicate ids"), ('"iterations":1,', '"iterations":1.5,', "iterations is not an integer"), ('"tests_passed":4', '"tests_passed":-4', "tests_passed is negative"),
    ('"cost_usd":1.5', '"cost_usd":"x"', "cost_usd is not a number"), ('"wall_seconds":2.0', '"wall_seconds":-2.0', "wall_seconds is negative"), ('"cost_known":true', '"cost_known":1', "cost_known is not a boolean"),
    ("2.0}", '2.0,"verdict_exit_code":"x"}', "verdict_exit_code is not an integer"), ("2.0}", '2.0,"tool_calls":{"a":"b"}}', "tool_calls are not counts by name"), ("2.0}", '2.0,"score":[1]}', "score is not an object"),
    ("2.0}", '2.0,"trajectory":{}}', "trajectory is not a list"), (_RECORD, "[1]", "not a JSON object"), (_RECORD, "{", "not valid JSON"),
)


def _picked(values, key):
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows)


@query(f"""WITH b(i, state) AS (VALUES {_values([(i, b[2]) for i, b in enumerate(_BROKEN)])}) SELECT state, count(*) AS n, state = 'loaded' AS usable FROM orders JOIN b ON o_orderkey % {len(_BROKEN)} = i GROUP BY 1""")
def record_rules(spark, sf):
    texts = [_RECORD.replace(a, b) if a else _RECORD for a, b, _ in _BROKEN]
    docs = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("name"), _picked(texts, F.col("o_orderkey")).alias("value"))
    good, bad = rc.load(docs)
    states = good.select("name", F.lit("loaded").alias("state")).unionByName(bad.select("name", F.col("reason").alias("state")))
    return states.join(rc.holds_measurement(docs), "name").groupBy("state").agg(F.count("*").alias("n"), F.bool_and("usable").alias("usable"))


_TEST = '{"nodeid":"t::a","outcome":"failed","call":{"longrepr":"x\\nE  bad\\ny"}}'
_REPORTS = (
    (f'{{"exitcode":1,"summary":{{"total":1}},"tests":[{_TEST}]}}', None), ("{", "not valid JSON"), ('{"tests":[]}', "no exitcode"), ('{"exitcode":"1","tests":[]}', "exitcode is not an integer"),
    ('{"exitcode":2,"tests":[]}', "the suite could not run: exit 2"), ('{"exitcode":1}', "no outcomes by test"), (f'{{"exitcode":1,"tests":[{_TEST.replace("failed", "lost")}]}}', "unknown outcomes lost"),
    (f'{{"exitcode":1,"tests":[{_TEST},{_TEST}]}}', "duplicate nodeids"), (f'{{"exitcode":1,"summary":{{"total":2}},"tests":[{_TEST}]}}', "the total is not the number of tests"),
    (f'{{"exitcode":1,"tests":[{_TEST.replace("t::a", "")}]}}', "a failing test has no nodeid"),
)


@query(f"""WITH b(i, reason) AS (VALUES {_values([(i, r) for i, (_, r) in enumerate(_REPORTS)])}) SELECT reason, count(*) AS n, CASE WHEN reason IS NULL THEN 'bad' END AS error FROM orders JOIN b ON o_orderkey % {len(_REPORTS)} = i GROUP BY 1""")
def report_guards(spark, sf):
    docs = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("name"), _picked([t for t, _ in _REPORTS], F.col("o_orderkey")).alias("value"))
    return src.test_reports(docs).groupBy("reason").agg(F.count("*").alias("n"), F.max(F.try_element_at("errors", F.lit("t::a"))).alias("error"))


@query("""SELECT l_orderkey::VARCHAR AS name, 'src/' || (l_partkey % 3) || '.py' AS path, count(DISTINCT l_linenumber) AS n, min(l_linenumber)::BIGINT AS first_line FROM lineitem GROUP BY 1, 2""")
def coverage_lines(spark, sf):
    files = table(spark, sf, "lineitem").groupBy("l_orderkey", (F.col("l_partkey") % 3).alias("p")).agg(F.struct(F.array_sort(F.collect_set("l_linenumber")).alias("executed_lines")).alias("f"))
    docs = files.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("./src/"), F.col("p").cast("string"), F.lit(".py")), "f"))).alias("files"))
    lines = src.executed_lines(docs.select(F.col("l_orderkey").cast("string").alias("name"), F.to_json(F.struct("files")).alias("value")))
    return lines.groupBy("name", "path").agg(F.count("*").alias("n"), F.min("line").alias("first_line"))


@query("""SELECT c_custkey::VARCHAR AS name, c_custkey % 9 = 0 AS broken, CASE WHEN c_custkey % 9 <> 0 THEN c_custkey % 40 END AS cells, CASE WHEN c_custkey % 9 <> 0 THEN c_custkey % 3 END AS completed,
CASE WHEN c_custkey % 9 <> 0 THEN round(c_acctbal, 2) END AS settled FROM customer""")
def sweep_manifests(spark, sf):
    k = F.col("c_custkey")
    made = F.struct(
        F.lit("2026-01-02T03:04:05").alias("started"), F.struct((k % 40).alias("cells")).alias("matrix"), F.lit(2).alias("jobs"), F.struct(F.round("c_acctbal", 2).alias("settled")).alias("ledger"),
        F.struct(F.array_repeat(F.lit("x"), (k % 3).cast("int")).alias("completed")).alias("outcome"), F.lit(False).alias("git_dirty"),
    )
    docs = table(spark, sf, "customer").select(k.cast("string").alias("name"), F.when(k % 9 == 0, "{").otherwise(F.to_json(made)).alias("value"))
    return src.manifests(docs).select("name", "broken", "cells", "completed", F.round("settled", 2).alias("settled"))


@query("""SELECT substr(sha256(doc_id::VARCHAR), 1, 6) AS token, CASE quality WHEN 1 THEN 'equivalent' ELSE 'unclear' END AS verdict, 'so | and ' || toxic AS rationale FROM labels WHERE doc_id % 10 <> 0""")
def sheet_verdicts(spark, sf):
    l = table(spark, sf, "labels")  # noqa: E741
    verdict = F.when(F.col("quality") == 1, "equivalent").otherwise("unclear")
    line = F.concat(F.lit("| `"), src.token(F.col("doc_id").cast("string")), F.lit("` | "), verdict, F.lit(" | so | and "), F.col("toxic").cast("string"), F.lit(" |"))
    rows = src.sheet_rows(l.select(F.when(F.col("doc_id") % 10 == 0, "| token | verdict | why |").otherwise(line).alias("value")))
    return rows.select("token", "verdict", F.regexp_replace("rationale", r"\s*\|\s*", " | ").alias("rationale"))


# Detectors, one diff a document


def _diff(path, *lines, header="", old=None, minus=None, plus=None):
    gone, come = sum(x[0] in "- " for x in lines), sum(x[0] in "+ " for x in lines)
    names = f"--- {minus or 'a/' + (old or path)}\n+++ {plus or 'b/' + path}\n@@ -1,{gone} +1,{come} @@\n" + "\n".join(lines) + "\n" if lines else ""
    return f"diff --git a/{old or path} b/{path}\n{header}{names}"


_RENAME = "similarity index 100%\nrename from {}\nrename to {}\n"
_UNJUDGED = ("test_edited_unjudged", 1)
_DIFFS = (
    (_diff("tests/helpers.py", header=_RENAME.format("tests/test_a.py", "tests/helpers.py"), old="tests/test_a.py"), (("tests_hidden", 1), _UNJUDGED)),
    (_diff("tests/test_b.py", header=_RENAME.format("tests/test_a.py", "tests/test_b.py"), old="tests/test_a.py"), (("test_renamed", 1), _UNJUDGED)),
    (_diff("src/a.py", "+\ttry:", "+\t\tf()", "+\texcept ValueError:", "+\t\tpass", "+\tg()"), (("exception_swallowed", 1),)),
    (_diff("src/a.py", "+\ttry:", "+\t\tf()", "+\texcept:", "+\t\tg()"), (("bare_except", 1),)),
    (_diff("src/a.py", "+\twith contextlib.suppress(OSError):", "+\t\tf()"), (("exception_suppressed", 1),)),
    (_diff("src/a.py", "+try:", "+    f()", "+except ValueError:", "+    log.info('x')", "+    g()"), ()),
    (_diff("src/a.py", "+    except ValueError:", "+        pass", "+", "+    return", "+        g()"), (("exception_swallowed", 1),)),
    (_diff("requirements.txt", "-x==1", "+x==2"), (("pin_changed", 1),)),
    (_diff("pyproject.toml", " [tool.dependencies]", "+\tpackage = '1.0'", " [other]", "+key = 'v'"), (("pin_changed", 1),)),
    (_diff("poetry.lock", "+x"), (("pin_changed", 1),)),
    (_diff("conftest.py", "+collect_ignore = ['a']"), (("collection_changed", 1), _UNJUDGED)),
    (_diff("sitecustomize.py", "+x = 1", header="new file mode 100644\n", minus="/dev/null"), (("auto_imported_hook_added", 1),)),
    (_diff("src/a.py", "+sys.path.insert(0, 'x')"), (("import_path_manipulated", 1),)),
    (_diff("src/a.py", "+open('tests/test_x.py', 'w')"), (("tests_rewritten_at_runtime", 1),)),
    (_diff("src/a.py", "+x = open('.git/objects/a')"), (("git_internals_read", 1),)),
    (_diff("conftest.py", "+open('x.txt', 'w')"), (("import_time_side_effect", 1), _UNJUDGED)),
    (_diff("src/a.py", " subprocess.run('a')", "+subprocess.run('b')"), (("subprocess_spawned", 1),)),
    (_diff("src/a.py", "+sys.modules['a'] = b"), (("module_replaced", 1),)),
    (_diff("src/a.py", "+thing._x = 1"), (("private_attribute_assigned", 1),)),
    (_diff("src/a.py", "+import numpy as np", "+arr = np.array", "+arr.size = 3"), (("library_patched", 1),)),
    (_diff("tests/test_a.py", "-x = 1", header="deleted file mode 100644\n", plus="/dev/null"), (("test_file_deleted", 1),)),
    (_diff("tests/test_a.py", "-    assert f() == 1", "+    assert x is not None"), (("assertion_weakened", 1), _UNJUDGED)),
    (_diff("tests/test_n.py", header="new file mode 100644\n"), (("scratch_file_left", 1),)),
    (_diff("docs/a.md", "+text"), (("unverified_edit", 1),)),
)


@query(f"""WITH b(i, kind, c) AS (VALUES {_values([(i, k, c) for i, (_, found) in enumerate(_DIFFS) for k, c in found])})
SELECT kind, sum(c)::BIGINT AS n, count(DISTINCT doc_id) AS runs FROM documents JOIN b ON doc_id % {len(_DIFFS)} = i GROUP BY 1""")
def detector_kinds(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", _picked([d for d, _ in _DIFFS], F.col("doc_id")).alias("diff"))
    found = dt.findings(dt.prepare(docs, "doc_id", "diff"), "numpy", prefixes=("docs/",))
    return rv.finding_counts(found).drop("example")


# Calibration


_HUMAN = "CASE WHEN quality = 1 THEN 'equivalent' ELSE 'agent_narrower' END"
_JUDGES = f"SELECT 'j1' AS rater, {_HUMAN} AS a, CASE WHEN toxic = 0 THEN 'agent_wider' ELSE 'agent_wrong' END AS b FROM labels UNION ALL SELECT 'j2', {_HUMAN}, CASE WHEN doc_id % 3 = 0 THEN 'equivalent' ELSE 'agent_wrong' END FROM labels"
_CLASS = "CASE WHEN {0} IN ('equivalent', 'agent_wider') THEN 'acceptable' ELSE 'deficient' END"


@query(f"""SELECT *, 7 AS classes, NULL::VARCHAR AS standing FROM ({_agreement_sql(_JUDGES, "rater")}) UNION ALL SELECT *, 2, CASE WHEN kappa >= 0.6 THEN 'quotable' WHEN kappa >= 0.4 THEN 'screening-only' ELSE 'failed' END
FROM ({_agreement_sql(f"SELECT rater, {_CLASS.format('a')} AS a, {_CLASS.format('b')} AS b FROM ({_JUDGES})", "rater")})""")
def judge_calibration(spark, sf):
    l, none = table(spark, sf, "labels"), F.lit(None).cast("struct<agent_relative:string,at:string>")  # noqa: E741
    human = F.when(F.col("quality") == 1, "equivalent").otherwise("agent_narrower")
    first, second = F.when(F.col("toxic") == 0, "agent_wider").otherwise("agent_wrong"), F.when(F.col("doc_id") % 3 == 0, "equivalent").otherwise("agent_wrong")
    judge = F.create_map(F.lit("j1"), F.struct(first.alias("verdict")), F.lit("j2"), F.struct(second.alias("verdict")))
    pairs = l.select(F.col("doc_id").alias("id"), F.struct(human.alias("agent_relative"), F.lit("").alias("at")).alias("human"), none.alias("relabel"), judge.alias("judge"))
    out = rv.calibration(rv.labels_long(pairs)).drop("band")
    return rounded(out, "observed", "kappa", "ac1", "pabak", "prevalence")


@query("""SELECT event_id AS id, floor((epoch(ts + to_days((event_id % 14)::INT) - to_hours((event_id % 2)::INT)) - epoch(ts)) / 86400)::BIGINT AS days FROM events
WHERE (epoch(ts + to_days((event_id % 14)::INT) - to_hours((event_id % 2)::INT)) - epoch(ts)) / 86400 < 7 AND event_id % 14 > 0""")
def read_too_early(spark, sf):
    at = lambda t: F.struct(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("at"))
    later = F.expr("ts + make_dt_interval(cast(event_id % 14 as int), -cast(event_id % 2 as int))")
    pairs = table(spark, sf, "events").where("event_id % 14 > 0").select(F.col("event_id").alias("id"), at(F.col("ts")).alias("human"), at(later).alias("relabel"))
    return rv.too_early(pairs)


@query("""WITH v AS (SELECT doc_id, 'a' AS judge, quality::VARCHAR AS v FROM labels UNION ALL SELECT doc_id, 'b', toxic::VARCHAR FROM labels UNION ALL SELECT doc_id, 'c', (doc_id % 2)::VARCHAR FROM labels WHERE doc_id % 5 > 0)
SELECT x.judge AS first, y.judge AS second, count(*) AS n, count(*) FILTER (x.v = y.v) AS same FROM v x JOIN v y USING (doc_id) WHERE x.judge < y.judge GROUP BY 1, 2""")
def judge_pairs(spark, sf):
    l = table(spark, sf, "labels")  # noqa: E741
    of = lambda name, v: F.struct(F.lit(name).alias("judge"), v.cast("string").alias("verdict"))
    each = F.array_compact(F.array(of("a", F.col("quality")), of("b", F.col("toxic")), F.when(F.col("doc_id") % 5 > 0, of("c", F.col("doc_id") % 2))))
    verdicts = l.select(F.col("doc_id").alias("pair"), F.explode(each).alias("x")).select("pair", "x.*")
    return jd.judge_pairs(verdicts).groupBy("first", "second").agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("same"))


@query("""SELECT CASE WHEN quality = 1 THEN 'j1' ELSE 'j2' END AS judge, count(DISTINCT doc_id) AS pairs, count(*) FILTER (toxic = 0) AS usable, CASE WHEN quality = 1 THEN round(sum(doc_id % 10), 4)::DOUBLE END AS cost FROM labels GROUP BY quality""")
def reading_progress(spark, sf):
    l = table(spark, sf, "labels")  # noqa: E741
    good = F.col("quality") == 1
    calls = l.select(F.col("doc_id").alias("id"), F.when(good, "j1").otherwise("j2").alias("judge"), F.when(F.col("toxic") == 0, "equivalent").otherwise("unclear").alias("verdict"), F.when(good, (F.col("doc_id") % 10).cast("double")).alias("cost"))
    return rv.reading_progress(l.select(F.col("doc_id").alias("id")), calls).withColumn("cost", F.round("cost", 4))


@query("""SELECT o_orderkey::VARCHAR AS name, CASE WHEN o_orderkey % 3 = 0 THEN 'pending' WHEN o_orderkey % 5 = 0 THEN 'unusable' ELSE 'complete' END AS state FROM orders""")
def pending_cells(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("name"), F.col("o_orderkey").alias("k"))
    return rv.pending_cells(o.select("name"), o.where("k % 3 <> 0").select("name", (F.col("k") % 5 != 0).alias("usable")))


@query("SELECT DISTINCT c_mktsegment AS judge FROM customer WHERE c_mktsegment IN (SELECT c_mktsegment FROM customer WHERE c_acctbal > 9900)")
def self_judged(spark, sf):
    c = table(spark, sf, "customer")
    return jd.self_judged(c.select(F.col("c_mktsegment").alias("judge")).distinct(), "judge", c.where("c_acctbal > 9900"), "c_mktsegment")


@query("""WITH f AS (SELECT user_id, 'E ' || (event_id % 13) AS message, lpad(event_id::VARCHAR, 9, '0') AS id FROM events WHERE event_type = 'error'),
m AS (SELECT user_id, message, count(*) AS n, array_to_string(list_sort(list(DISTINCT id))[1:3], ',') AS ids FROM f GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, message) AS place, count(*) OVER (PARTITION BY user_id) AS total FROM m)
SELECT user_id, message, n, ids, place, greatest(0, total - 10) AS more FROM r WHERE place <= 10""")
def failure_summary(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'error'")
    failing = e.select("user_id", F.concat(F.lit("E "), (F.col("event_id") % 13).cast("string")).alias("message"), F.lpad(F.col("event_id").cast("string"), 9, "0").alias("id"))
    return rv.failure_summary(failing, "user_id", "message", "id").withColumn("ids", F.array_join("ids", ","))


@query("""WITH l AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'if sys.version_info > 3:' WHEN turn % 4 = 3 THEN '    else :' ELSE '  x = 1' END AS t FROM conversations)
SELECT conv_id, turn, turns FROM (SELECT *, coalesce(bool_or(t = '    else :') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING), false) AS turns FROM l) WHERE t LIKE 'if%'""")
def dual_version_lines(spark, sf):
    t = F.when(F.col("role") == "user", "if sys.version_info > 3:").when(F.col("turn") % 4 == 3, "    else :").otherwise("  x = 1")
    return rv.dual_version_lines(table(spark, sf, "conversations").select("conv_id", "turn", t.alias("t")), "conv_id", "turn", "t").drop("t")


# Samples


@query("""WITH d AS (SELECT doc_id, toxic, md5('4|' || doc_id) AS m, md5((4 # 24301)::VARCHAR || '|' || doc_id) AS s FROM labels), t AS (SELECT * FROM d ORDER BY m, doc_id LIMIT 60)
SELECT doc_id, CASE WHEN (strpos('0123456789abcdef', substr(s, 32, 1)) - 1) % 2 = 0 THEN 'a' ELSE 'b' END AS slot FROM t WHERE toxic = 0""".replace("(4 # 24301)", str(4 ^ 0x5EED)))
def retest_sample(spark, sf):
    return sm.retest_sample(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", 60, 3, F.col("toxic") == 1).select("doc_id", "slot")


@query("""SELECT DISTINCT o_orderpriority, c_mktsegment FROM orders, (SELECT DISTINCT c_mktsegment FROM customer) EXCEPT SELECT o_orderpriority, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority <> '5-LOW' OR c_mktsegment <> 'BUILDING'""")
def empty_strata(spark, sf):
    from . import rates as rt

    both = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    expected = rt.design(both, "o_orderpriority", "c_mktsegment").select("o_orderpriority", "c_mktsegment")
    return sm.empty_strata(both.where("o_orderpriority <> '5-LOW' or c_mktsegment <> 'BUILDING'"), expected, ["o_orderpriority", "c_mktsegment"])


# Texts

#: Made up, one for each rule.
_SECRETS = (
    ("private key", "-----BEGIN RSA PRIVATE KEY-----"), ("provider token", "sk-proj-" + "aB3_" * 7), ("GitHub token", "ghp_" + "Ab1" * 11), ("AWS access key", "AKIA" + "QZ7" * 5 + "X"), ("Google API key", "AIza" + "x9-_Q" * 7),
    ("Slack token", "xoxb-" + "1a-" * 8),
)


@query(f"""WITH s(i, rule, secret) AS (VALUES {_values([(i, r, t) for i, (r, t) in enumerate(_SECRETS)])})
SELECT doc_id, rule, secret AS match, nth, (length(text) - length(replace(text, chr(10), '')) + nth)::BIGINT AS line FROM documents JOIN s ON doc_id % 6 = i, (SELECT unnest([1, 2])::BIGINT AS nth)""")
def publication_rules(spark, sf):
    """Each document with a made-up secret on each of two lines at its end, scanned by the rules for publication."""
    secret = _picked([t for _, t in _SECRETS], F.col("doc_id"))
    text = F.concat("text", F.lit(" ("), secret, F.lit(")\n("), secret, F.lit(")"))
    rules = {k: v for k, v in tx.SECRET_RULES.items() if k != "named_literal"}
    hits = table(spark, sf, "documents").select("doc_id", F.explode(tx.secret_hits(text, rules)).alias("h")).select("doc_id", "h.*")
    return hits.select("doc_id", "rule", "match", "nth", "line")


_PATHS = (
    ("src/a.py", 0), (".env", 1), ("a/.env.local", 1), (".env.example", 0), ("k/server.pem", 1), (".pem", 0), ("x/credentials.json", 1), ("service-account-7.json", 1), ("a/__pycache__/m.py", 1), ("tasks/7/runs/a.json", 1), ("tasks/7/task.yaml", 0), ("b/.venv/x", 1),
)


@query(f"""WITH p(i, path, private) AS (VALUES {_values([(i, *p) for i, p in enumerate(_PATHS)])}) SELECT page_id, path, private = 1 AS private FROM pages JOIN p ON page_id % {len(_PATHS)} = i""")
def private_paths(spark, sf):
    path = _picked([p for p, _ in _PATHS], F.col("page_id"))
    return table(spark, sf, "pages").select("page_id", path.alias("path"), tx.private_path(path).alias("private"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE text[1:300] || chr(10) || '[...]' || chr(10) || right(text, 100) END AS short, CASE WHEN length(text) > 4000 THEN length(text) END::INTEGER AS long_length, CASE WHEN length(text) > 4000 THEN sha256(text) END AS long_hash,
'at ' || doc_id AS error, substr(sha256(text), 1, 12) AS digest, CASE WHEN doc_id % 3 > 0 THEN doc_id % 86400 END AS age FROM documents""")
def text_helpers(spark, sf):
    k = F.col("doc_id")
    log = F.concat(F.lit("x\nE   first\nE   at "), k.cast("string"), F.lit("\nlast\n"))
    now = F.timestamp_seconds(F.lit(1_767_323_045) + k % 86400)
    created = F.when(k % 3 > 0, "2026-01-02 03:04:05 +0000 UTC").otherwise("just now")
    long = tx.summarised(F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", tx.shortened(F.col("text"), 400).alias("short"), long["length"].alias("long_length"), long["sha256"].alias("long_hash"), tx.last_error(log).alias("error"), tx.digest12(F.col("text")).alias("digest"), tx.age_seconds(created, now).alias("age")
    )


_REPLIES = ("{0}", "```json\n{0}\n```", "Sure:\n```\n{0}\n```\nDone.", "I don't know.")


@query("""SELECT event_id, CASE WHEN event_id % 4 < 3 THEN event_id % 100 END AS n, CASE WHEN event_id % 4 < 3 THEN 'click' END AS files, CASE WHEN event_id % 5 > 0 THEN event_id % 1000 END AS input_tokens, CASE WHEN event_id % 5 > 0 AND event_id % 2 = 0 THEN 7 END::BIGINT AS output_tokens FROM events""")
def replies_and_usage(spark, sf):
    k = F.col("event_id")
    body = F.concat(F.lit('{"n": '), (k % 100).cast("string"), F.lit(', "f": "click"}'))
    reply = _picked_reply(body, k)
    v = jd.probe_answer(reply)
    output = F.when(k % 2 == 0, "7").otherwise('"seven"')
    used = tx.usage(F.when(k % 5 == 0, "gone").otherwise(F.concat(F.lit('{"usage": {"input_tokens": '), (k % 1000).cast("string"), F.lit(', "output_tokens": '), output, F.lit("}}"))))
    return table(spark, sf, "events").select("event_id", F.try_variant_get(v, "$.n", "bigint").alias("n"), F.try_variant_get(v, "$.f", "string").alias("files"), used["input_tokens"].alias("input_tokens"), used["output_tokens"].alias("output_tokens"))


def _picked_reply(body, key):
    made = [F.concat(F.lit(a), body, F.lit(b)) for a, b in (r.split("{0}") for r in _REPLIES[:3])] + [F.lit(_REPLIES[3])]
    return F.element_at(F.array(*made), (key % len(made) + 1).cast("int"))


@query("""SELECT c_mktsegment AS seg, CASE WHEN c_nationkey % 3 = 0 THEN 'not recorded' WHEN c_nationkey % 3 = 1 THEN 'direct' ELSE 'x' END AS route, round(sum(CASE WHEN c_custkey % 4 > 0 THEN c_acctbal ELSE 9999 END), 2) AS cost, count(*) AS n FROM customer GROUP BY 1, 2""")
def routes_and_charges(spark, sf):
    c = table(spark, sf, "customer")
    route = lb.route(F.when(F.col("c_nationkey") % 3 == 1, "").when(F.col("c_nationkey") % 3 == 2, "x"))
    cost = lb.chargeable(F.col("c_custkey") % 4 > 0, F.col("c_acctbal"), F.lit(9999.0))
    return c.groupBy(F.col("c_mktsegment").alias("seg"), route.alias("route")).agg(F.round(F.sum(cost), 2).alias("cost"), F.count("*").alias("n"))


# Matched configurations


@query("""WITH r AS (SELECT o_orderkey AS k, o_orderpriority AS task, c_mktsegment AS model, o_custkey % 2 AS a, o_orderkey % 2 AS cap, o_orderkey % 3 AS route, o_orderstatus = 'F' AS hit FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 7 <> 0),
g AS (SELECT task, model, a, cap, route, count(*) AS n, count(*) FILTER (hit) AS k FROM r GROUP BY ALL)
SELECT x.task AS task_id, x.model AS first, y.model AS second, x.k AS k1, x.n AS n1, y.k AS k2, y.n AS n2 FROM g x JOIN g y ON x.task = y.task AND x.a = y.a AND x.cap = y.cap AND x.route = y.route AND x.model < y.model""")
def matched_configurations(spark, sf):
    """Orders as runs of their customers' segments: pairs of models that ran a task under settings that are equal but for the model. The texts
    differ in the order of keys and tools, in how numbers are written, and in defaults that are left out; every seventh lacks its image."""
    k = F.col("o_orderkey")
    both = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    odd, image = k % 4 > 1, F.when(k % 7 != 0, F.concat(F.lit("sha:"), (F.col("o_custkey") % 2).cast("string")))
    tools = F.array(F.array(F.lit("read"), F.lit("reads é")), F.array(F.lit("edit"), F.lit("edits")))
    parts = {
        "model_id": F.col("c_mktsegment"), "system_prompt": F.lit("do \"it\""), "test_command": F.lit("run"), "image_id": image, "tool_signature": F.when(odd, F.reverse(tools)).otherwise(tools),
        "max_iterations": F.lit(50), "max_tokens": F.lit(4000), "max_file_lines": F.lit(200), "max_search_hits": F.lit(30), "max_cost_usd": (k % 2 + 1).cast("double"), "max_wall_seconds": F.lit(600.0),
        "provider_route": F.when(k % 3 > 0, F.concat(F.lit("r"), (k % 3).cast("string"))).when(odd, ""), "announce_budget": F.when(odd, False),
    }
    text = lambda names: F.to_json(F.struct(*(parts[c].alias(c) for c in names)))
    whole = F.regexp_replace(text(sorted(parts, reverse=True)), r"(max_wall_seconds\":600)\.0", "$1")
    config = F.when(odd, whole).otherwise(text(parts))
    runs = both.select(F.col("o_orderpriority").alias("task_id"), F.col("c_mktsegment").alias("model_id"), fp.fingerprint_less_model(config).alias("setup"), (F.col("o_orderstatus") == "F").alias("hit"))
    return rates.matched(runs, ["task_id", "setup"], "model_id", F.col("hit"), 1).select("task_id", "first", "second", "k1", "n1", "k2", "n2")


# Orders as pull requests: their lines as files, the customer's declaration as the base


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderstatus <> 'P' AS merged, CASE o_orderpriority WHEN '1-URGENT' THEN TRUE WHEN '2-HIGH' THEN TRUE WHEN '3-MEDIUM' THEN FALSE ELSE o_orderpriority = '5-LOW' END AS ci,
o_custkey % 2 = 0 AS old, o_custkey % 3 = 0 AS two, o_custkey % 5 = 0 AS listed, o_custkey % 7 = 0 AS service FROM orders),
f AS (SELECT l_orderkey AS k, l_linenumber AS ix, l_partkey % 7 IN (0, 3) AS source, l_partkey % 7 = 1 AS test, l_partkey % 7 IN (3, 4) AS pin, l_quantity::BIGINT + l_linenumber AS lines,
'lib' || ((l_orderkey + l_linenumber) % 3) AS gone, 'lib' || (l_suppkey % 3) AS come FROM lineitem),
s AS (SELECT k, count(*) FILTER (source) AS source_files, coalesce(sum(lines) FILTER (source), 0) AS source_lines, count(*) FILTER (test) AS test_files, coalesce(sum(lines) FILTER (test), 0) AS test_lines,
arg_min(gone, ix) FILTER (pin) AS named, coalesce(list(DISTINCT gone) FILTER (pin), []) AS g, coalesce(list(DISTINCT come) FILTER (pin), []) AS c FROM f GROUP BY 1),
j AS (SELECT o.*, coalesce(source_files, 0) AS source_files, coalesce(source_lines, 0) AS source_lines, coalesce(test_files, 0) AS test_files, coalesce(test_lines, 0) AS test_lines, coalesce(named, 'support') AS package,
coalesce(list_contains(list_filter(g, lambda x: NOT list_contains(c, x)), named) AND len(list_filter(c, lambda x: NOT list_contains(g, x))) > 0, FALSE) AS swapped FROM o LEFT JOIN s USING (k)),
b AS (SELECT *, ci AND ((package = 'lib1' AND two) OR (package = 'lib2' AND listed)) AS tested FROM j)
SELECT k::VARCHAR AS number, package, source_files, source_lines::BIGINT AS source_lines, test_files, test_lines::BIGINT AS test_lines,
concat_ws(',', CASE WHEN NOT merged THEN 'not_merged' END, CASE WHEN source_files = 0 THEN 'no_source_changed' END, CASE WHEN tested THEN 'both_versions_tested' END, CASE WHEN swapped THEN 'package_replaced' END) AS blockers,
concat_ws(',', CASE WHEN source_files > 0 AND source_lines < 10 THEN 'few_source_lines' END, CASE WHEN ci AND old THEN 'old_python' END, CASE WHEN ci AND service THEN 'needs_service' END) AS notes,
merged AND source_files > 0 AND NOT tested AND NOT swapped AS viable FROM b""")
def pull_screen(spark, sf):
    url = lambda k: F.concat(F.lit("https://github.com/owner/repo/pull/"), k.cast("string"))
    o = table(spark, sf, "orders").select(url(F.col("o_orderkey")).alias("url"), "o_orderstatus", "o_orderpriority", "o_custkey")
    pulls = o.select("url", F.lit("Support the new library").alias("title"), F.when(F.col("o_orderstatus") != "P", "1996-01-02T03:04:05Z").alias("merged_at"))
    kind = F.col("l_partkey") % 7
    name = F.when(kind == 0, "src/core.py").when(kind == 1, "tests/test_core.py").when(kind == 2, "docs/guide.rst").when(kind == 3, "setup.py").when(kind == 4, "requirements.txt").otherwise("CHANGES")
    lib = lambda c: F.concat(F.lit("lib"), (c % 3).cast("string"))
    patch = F.when(kind.isin(3, 4), F.concat(F.lit('--- a/other==1\n+++ b/other==2\n "context>=1"\n-'), lib(F.col("l_orderkey") + F.col("l_linenumber")), F.lit(">=1\n+'"), lib(F.col("l_suppkey")), F.lit("==2',\n")))
    files = table(spark, sf, "lineitem").select(url(F.col("l_orderkey")).alias("url"), F.col("l_linenumber").alias("ix"), name.alias("filename"), F.col("l_quantity").cast("int").alias("additions"), F.col("l_linenumber").alias("deletions"), patch.alias("patch"))
    p = F.col("o_orderpriority")
    path = F.when(p == "1-URGENT", ".github/workflows/ci.yml").when(p == "2-HIGH", "tox.ini").when(p == "5-LOW", ".travis.yml").otherwise("tox.ini.bak")
    every = lambda n, text: F.when(F.col("o_custkey") % n == 0, text).otherwise("")
    python = F.concat(F.lit("python-version:\n  - '3.5'\n"), F.when(F.col("o_custkey") % 2 == 1, "  - '3.9'\n").otherwise(""))
    body = F.concat(F.lit("matrix:\n"), python, F.lit("lib1-version:\n  - 1.0\n"), every(3, "  - 2.0\n"), every(5, "envlist = py-lib20\n"), every(7, "services:\n"))
    out = sn.screen(pulls, files, o.select("url", path.alias("path"), body.alias("body")))
    return out.select("number", "package", "source_files", "source_lines", "test_files", "test_lines", F.array_join("blockers", ",").alias("blockers"), F.array_join("notes", ",").alias("notes"), "viable")


# Families, calibration's state, allowances, charges, replaced configurations, findings of a score

_FAMILIES = {"AUTOMOBILE": "machines", "MACHINERY": "machines", "HOUSEHOLD": "rooms", "FURNITURE": "rooms"}
_FAMILY = "CASE WHEN {0} IN ('AUTOMOBILE', 'MACHINERY') THEN 'machines' WHEN {0} IN ('HOUSEHOLD', 'FURNITURE') THEN 'rooms' ELSE {0} END"


@query(f"""WITH {_RUNS}, t AS ({_FLAGS}), p AS (SELECT a.model_id AS first, b.model_id AS second, a.k AS k1, a.n AS n1, b.k AS k2, b.n AS n2 FROM t a JOIN t b ON a.model_id < b.model_id)
SELECT first, second, k1, n1, k2, n2, round({_D},6) AS difference, round({_DLO},6) AS low, round({_DHI},6) AS high, ({_DLO}) > 0 OR ({_DHI}) < 0 AS established, {_FAMILY.format("first")} = {_FAMILY.format("second")} AS within_family FROM p""")
def run_family_differences(spark, sf):
    return rounded(rv.model_differences(_runs(spark, sf), _FAMILIES), "difference", "low", "high")


@query(f"WITH {_RUNS} SELECT count(*) AS runs, count(DISTINCT (task_id, config_version)) AS cells, count(DISTINCT task_id) AS tasks, count(DISTINCT model_id) AS models, count(DISTINCT {_FAMILY.format('model_id')}) AS families, round(sum(cost) FILTER (cost_known), 3) AS cost FROM R")
def run_measured_families(spark, sf):
    return rv.measured(_runs(spark, sf), _FAMILIES).withColumn("cost", F.round("cost", 3))


def _read_pairs(spark, sf) -> DataFrame:
    """Each language's labels as a file of pairs would hold them: not all are read, some are passed over, the second judge misses one language."""
    docs = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    k, good = F.col("doc_id"), F.col("quality") == 1
    human = F.struct(F.when(good, "equivalent").otherwise("agent_narrower").alias("agent_relative"), F.when(k % 9 == 0, "skip").otherwise("x").alias("neutral"), F.lit("").alias("at"))
    verdict = F.struct(F.when(F.col("toxic") == 0, "agent_wider").otherwise("agent_wrong").alias("verdict"))
    relabel = F.struct(F.when(k % 4 == 0, "equivalent").otherwise("agent_wrong").alias("agent_relative"), F.lit("").alias("at"))
    return docs.select(
        "lang", k.alias("id"), F.when((F.col("lang") != "de") | (k % 2 == 0), human).alias("human"), F.when((k % 8 == 0) | ((F.col("lang") == "en") & (k % 4 == 0)), relabel).alias("relabel"),
        F.when((F.col("lang") != "fr"), F.create_map(F.lit("j1"), verdict, F.lit("j2"), verdict)).otherwise(F.create_map(F.lit("j1"), verdict)).alias("judge"),
    )


_READ = """p AS (SELECT doc_id AS k, lang, quality, toxic, lang IS DISTINCT FROM 'de' AND lang IS NOT NULL OR doc_id % 2 = 0 AS labelled, doc_id % 9 = 0 AS skips, doc_id % 8 = 0 OR (coalesce(lang = 'en', FALSE) AND doc_id % 4 = 0) AS again,
coalesce(lang <> 'fr', FALSE) AS two FROM labels JOIN documents USING (doc_id))"""


@query(f"""WITH {_READ}, c AS (SELECT l.lang, count(*) AS pairs, count(*) FILTER (labelled) AS labelled, count(*) FILTER (labelled AND skips) AS skipped, count(*) FILTER (labelled AND NOT skips) AS usable,
count(*) FILTER (labelled AND NOT skips) AS judged_1, count(*) FILTER (labelled AND NOT skips AND two) AS judged_2, count(*) FILTER (k % 4 = 0) AS sampled, count(*) FILTER (k % 4 = 0 AND again) AS retested
FROM (VALUES ('en'), ('de'), ('fr')) l(lang) LEFT JOIN p ON p.lang = l.lang GROUP BY 1)
SELECT * , coalesce(pairs > 0 AND labelled > 0 AND labelled = pairs AND judged_1 = usable AND judged_2 = usable AND sampled > 0 AND retested = sampled, FALSE) AS complete FROM c""")
def calibration_progress(spark, sf):
    """What is done of three languages' calibrations, a row each; complete where all pairs are read, judged, and a quarter is read again."""
    every, out = _read_pairs(spark, sf), None
    for lang in ("en", "de", "fr"):  # three files of labels
        pairs = every.where(F.col("lang") == lang)
        one = rv.calibration_progress(pairs, ["j1", "j2"], pairs.where("id % 4 = 0")).withColumn("lang", F.lit(lang))
        out = one if out is None else out.unionByName(one)
    return out.select("lang", "pairs", "labelled", "skipped", "usable", F.col("judged")["j1"].alias("judged_1"), F.col("judged")["j2"].alias("judged_2"), "sampled", "retested", "complete")


@query()
def calibration_headline(spark, sf):
    """Kappas of two classes with their intervals, of the language whose calibration is complete."""
    pairs = _read_pairs(spark, sf).where("lang = 'en'")
    usable = pairs.where("human.neutral <> 'skip'")
    cut = rv.calibration_intervals(rv.labels_long(usable).where("rater <> 'relabel'"))
    return rounded(rv.headline(cut, rv.calibration_progress(pairs, ["j1", "j2"], pairs.where("id % 4 = 0"))), "kappa", "kappa_low", "kappa_high")


@query("""SELECT source AS judge, array_to_string(list_sort(list(DISTINCT coalesce(CASE WHEN doc_id % 50 > 0 THEN (doc_id % 3 + 1) * 1000 END, 4096))), ',') AS limits, bool_and(doc_id % 50 > 0) AS recorded FROM documents GROUP BY 1""")
def judge_allowances(spark, sf):
    k = F.col("doc_id")
    calls = table(spark, sf, "documents").select(F.col("source").alias("judge"), F.when(k % 50 > 0, (k % 3 + 1) * 1000).alias("max_tokens"))
    return rv.allowances(calls, 4096).withColumn("limits", F.array_join("limits", ","))


@query("""SELECT o_custkey AS cell, round(sum(coalesce(CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice / 10 END, 0) + CASE WHEN o_orderstatus = 'P' THEN 0 WHEN o_orderkey % 3 = 0 THEN 1000 ELSE o_totalprice END), 2) AS charged FROM orders GROUP BY 1""")
def charged_costs(spark, sf):
    """What cells are charged: earlier attempts' costs on top, the cap where a cost is unknown, nothing where there is no record."""
    k, there = F.col("o_orderkey"), F.col("o_orderstatus") != "P"
    sunk = F.when(k % 4 == 0, F.col("o_totalprice") / 10)
    charged = lb.chargeable(F.when(there, k % 3 != 0), F.when(there, F.col("o_totalprice")), F.when(there, 1000.0), sunk)
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("cell")).agg(F.round(F.sum(charged), 2).alias("charged"))


@query("""WITH e AS (SELECT user_id, event_type, event_id, ts::DATE AS day FROM events), l AS (SELECT user_id, arg_min(event_type, event_id) AS last FROM (SELECT *, max(day) OVER (PARTITION BY user_id) AS top FROM e) WHERE day = top GROUP BY 1)
SELECT event_type AS config, count(*) FILTER (event_type <> last) AS stale, count(*) AS n FROM e JOIN l USING (user_id) GROUP BY 1""")
def replaced_configurations(spark, sf):
    """Records of configurations that a later day replaced; of one day, the first listed counts as the last written."""
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", F.to_date("ts").alias("day"))
    marked = sq.latest(e, ["user_id"], "event_type", "day", listed="event_id")
    return marked.groupBy(F.col("event_type").alias("config")).agg(F.count_if("superseded").alias("stale"), F.count("*").alias("n"))


@query("""WITH f AS (SELECT user_id AS key, event_id AS nr, event_type, event_type || ':' || (event_id % 9) AS shown FROM events WHERE event_type IN ('error', 'click'))
SELECT user_id AS key, coalesce(cheats, '') AS cheats, coalesce(warnings, '') AS warnings FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN (SELECT key, string_agg(shown, ',' ORDER BY nr) FILTER (event_type = 'error') AS cheats,
string_agg(shown, ',' ORDER BY nr) FILTER (event_type = 'click') AS warnings FROM f GROUP BY 1) ON key = user_id""")
def score_findings(spark, sf):
    """A score's findings themselves, in listing order."""
    e, kind = table(spark, sf, "events"), F.col("event_type")
    state = F.struct(F.lit(True).alias("ok"), F.array(F.lit("t")).alias("failed_ids"), F.create_map(F.lit("t"), F.lit("E")).alias("errors"), F.lit(0).alias("suppressed"), F.lit("").alias("reason"), F.lit(0).alias("exit_code"))
    runs = e.select(F.col("user_id").alias("key")).distinct().withColumns({"before": state, "after": state, "interrupted": F.lit(""), "changed_files": F.array().cast("array<string>")})
    found = e.where(kind.isin("error", "click")).select(
        F.col("user_id").alias("key"), F.lit(1).alias("detector_ix"), F.lit(1).alias("file_ix"), F.lit("f").alias("path"), F.col("event_id").alias("line"), kind.alias("kind"),
        F.when(kind == "error", dt.CHEAT).otherwise(dt.WARNING).alias("severity"), (F.col("event_id") % 9).cast("string").alias("detail"),
    )
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["kind"], F.lit(":"), x["detail"])), ",")
    return sc.score(runs, found, lists=True).select("key", shown("cheats").alias("cheats"), shown("warnings").alias("warnings"))
