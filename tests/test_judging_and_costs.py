import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import text as tx
from gaugeworks.operators import audits as au
from gaugeworks.operators import costs as co
from gaugeworks.operators import judging as jd
from gaugeworks.operators import resampling as rs


def test_mirror_is_an_involution():
    assert all(jd.MIRROR[jd.MIRROR[v]] == v for v in jd.MIRROR)


@pytest.mark.parametrize("neutral, at, want", [("a_narrower", "a", "agent_narrower"), ("a_narrower", "b", "agent_wider"), ("b_wrong", "b", "agent_wrong"), ("b_wrong", "a", "reference_wrong"), ("different", "b", "agent_different"), ("odd", "a", None)])
def test_relative_verdicts(spark, neutral, at, want):
    assert spark.range(1).select(jd.relative(F.lit(neutral), F.lit(at)).alias("v")).first().v == want


def test_replies(spark):
    rows = ['```json\n{"verdict": " A_Narrower ", "confidence": "HIGH"}\n```', 'I say {"verdict": "a_wrong", "reasoning": "x"} so', '{"verdict": "maybe"}', "no object", "[1]"]
    got = [r.p and r.p.verdict for r in spark.createDataFrame([(x,) for x in rows], "x string").select(jd.parsed_reply(F.col("x")).alias("p")).collect()]
    assert got == ["a_narrower", "a_wrong", None, None, None]


def test_results_of_pairs(spark):
    calls = [("p", "agent_wrong", 0, 1.0), ("p", "agent_wrong", 0, 1.0), ("p", "equivalent", 1, None), ("p", None, 1, 1.0), ("q", None, 0, 1.0), ("r", "unclear", 0, 0.5), ("r", "unclear", 1, 0.5), ("t", "agent_wrong", 0, 0.0), ("t", "equivalent", 0, 0.0)]
    got = {r.pair: r for r in jd.judge_results(spark.createDataFrame(calls, "pair string, v string, o int, c double"), "pair", "v", "o", "c").collect()}
    p = got["p"]
    assert (p.verdict, p.n_calls, p.n_parsed, p.position_bias, p.cost_known, p.stable) == ("agent_wrong", 4, 3, True, False, False) and p.agreement == pytest.approx(2 / 3)
    assert (got["q"].verdict, got["q"].usable) == ("unparseable", False) and got["r"].stable and not got["r"].usable and got["t"].verdict == "equivalent"


def test_costs(spark):
    prices = spark.createDataFrame([("a", 1.0, 2.0, True), ("b", 3.0, 9.0, False)], "model string, input double, output double, supports_caching boolean")
    usage = [("a", 1000, 10, 100, 200), ("b", 1000, 10, 100, 200), ("c", 1000, 10, None, None), ("a", None, None, None, None)]
    df = spark.createDataFrame(usage, "model string, input_tokens bigint, output_tokens bigint, cache_read bigint, cache_write bigint")
    got = sorted((r.model, r.input_tokens or 0, r.priced, round(r.cost * 1e6, 6)) for r in co.estimated_cost(df, prices).collect())
    assert got == [("a", 0, True, 0.0), ("a", 1000, True, 700 + 250 + 10 + 20), ("b", 1000, True, 3090.0), ("c", 1000, False, 3090.0)]
    with pytest.raises(Exception, match="incomplete"):
        co.estimated_cost(df.limit(1).withColumn("output_tokens", F.lit(None).cast("bigint")), prices).collect()
    fam = co.families(spark.createDataFrame([("m1",), ("m2",), ("m3",)], "model string"), "model", spark.createDataFrame([("m1", "f"), ("m2", "")], "id string, family string"))
    assert {r.model: r.family for r in fam.collect()} == {"m1": "f", "m2": "m2", "m3": "m3"}


def test_audits(spark):
    old = spark.createDataFrame([(1, "a", True), (2, "b", None), (3, "c", False)], "id int, t string, f boolean")
    new = spark.createDataFrame([(1, "a", False), (2, "b", False), (4, "d", True)], "id int, t string, f boolean")
    frames = [au.frame(x, "id", "t", "f") for x in (old, new)]
    assert {r.record: r.what for r in au.differences(*frames).collect()} == {1: ["flagged"], 3: ["gone"], 4: ["new"]}
    assert au.differences(frames[0], frames[0]).count() == 0
    named = spark.createDataFrame([("t", "x/core.py"), ("t", "nope.py")], "k string, p string")
    ref = spark.createDataFrame([("t", "a/core.py"), ("t", "b/core.py"), ("t", "z.py")], "k string, p string")
    assert [tuple(r) for r in au.recalled(named, ref, "k", "p").collect()] == [("t", "b/core.py")]
    lines = spark.createDataFrame([("k", "-", "lib==1"), ("k", "+", "Lib>=2"), ("k", "-", "old==1"), ("k", "+", '"new>=1",')], "k string, s string, t string")
    r = au.pin_changes(lines, "k", "s", "t").first()
    assert (r.removed, r.added) == (["old"], ["new"])


def test_paths_and_messages(spark):
    paths = {".env": True, ".env.example": False, "a/.env.local": True, "k.pem": True, ".key": False, "x/credentials.json": True, "service-account-1.json": True, "a/__pycache__/b": True, "tasks/1/runs": True, "tasks/1/a": False, "src/a.py": False}
    got = {r.p: r.v for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", tx.private_path(F.col("p")).alias("v")).collect()}
    assert got == paths
    row = spark.range(1).select(tx.rate_limited(F.lit("HTTP 429")).alias("a"), tx.rate_limited(F.lit("fine")).alias("b"), tx.summarised(F.lit("x" * 5000))["length"].alias("c"), tx.summarised(F.lit("x")).alias("d"), tx.age_seconds(F.lit("2026-01-02 03:04:05 +0000 UTC"), F.lit("2026-01-02 03:05:05").cast("timestamp")).alias("e"), tx.age_seconds(F.lit("soon"), F.current_timestamp()).alias("f")).first()
    assert tuple(row) == (True, False, 5000, None, 60, None)


def test_seeded_bootstrap_repeats_published_intervals(spark):
    rows = [("a", i, float(x)) for i, x in enumerate([0, 0, 0.44, 0.56, 0.56])] + [("b", i, float(x)) for i, x in enumerate([0, 0.56, 0.56])]
    got = {r.g: (round(100 * r.low), round(100 * r.high)) for r in rs.seeded_mean(spark.createDataFrame(rows, "g string, o int, x double"), ["g"], "x", "o").collect()}
    assert got == {"a": (9, 54), "b": (0, 56)}
