import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import intervals as iv
from gaugeworks.functions import labels as lb
from gaugeworks.operators import agreement as ag
from gaugeworks.operators import resampling as rs
from gaugeworks.operators import sampling as sm
from gaugeworks.operators import sequences as sq


def wilson(k, n, z=iv.QUANTILES[0.95]):
    p = k / n
    centre, spread = (p + z * z / (2 * n)) / (1 + z * z / n), z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return (0.0 if k == 0 else max(0.0, centre - spread)), (1.0 if k == n else min(1.0, centre + spread))


def test_wilson_range_symmetry_and_published_values(spark):
    counts = [(k, n) for n in range(1, 40) for k in range(n + 1)] + [(23, 62), (10, 53), (28, 74), (3, 122), (17, 122), (0, 122), (18, 122)]
    i = iv.wilson(F.col("k"), F.col("n"))
    got = {(r.k, r.n): (r.low, r.high) for r in spark.createDataFrame(counts, "k bigint, n bigint").select("k", "n", i["low"].alias("low"), i["high"].alias("high")).collect()}
    for (k, n), (low, high) in got.items():
        assert 0 <= low <= k / n <= high <= 1
        assert (low, high) == pytest.approx(wilson(k, n), abs=1e-12)
        if n < 40:
            assert low == pytest.approx(1 - got[n - k, n][1], abs=1e-12)
    published = {(23, 62): (26, 50), (3, 10): (11, 60), (2, 2): (34, 100), (10, 53): (11, 31), (28, 74): (28, 49), (3, 122): (1, 7), (17, 122): (9, 21), (0, 122): (0, 3), (18, 122): (10, 22)}
    assert {key: tuple(round(100 * x) for x in got[key]) for key in published} == published


def test_impossible_counts_are_null_or_errors(spark):
    df = spark.createDataFrame([(0, 0), (3, 2), (-1, 4), (None, 4)], "k bigint, n bigint")
    assert [r.i for r in df.select(iv.wilson(F.col("k"), F.col("n")).alias("i")).collect()] == [None] * 4
    with pytest.raises(Exception, match="successes"):
        df.limit(1).select(iv.wilson(F.col("k"), F.col("n"), strict=True)).collect()
    with pytest.raises(ValueError):
        iv.wilson(F.col("k"), F.col("n"), 0.5)


def test_newcombe_published_values_and_antisymmetry(spark):
    rows = [(3, 10, 23, 62), (19, 21, 24, 26), (0, 5, 5, 5), (1, 9, 4, 7)]
    a, b = iv.newcombe(*map(F.col, ("a", "b", "c", "d"))), iv.newcombe(*map(F.col, ("c", "d", "a", "b")))
    got = spark.createDataFrame(rows, "a bigint, b bigint, c bigint, d bigint").select(a.alias("x"), b.alias("y")).collect()
    assert [round(100 * v) for v in (got[0].x.point, got[0].x.low, got[0].x.high)] == [-7, -30, 25]
    assert [round(100 * v) for v in (got[1].x.point, got[1].x.low, got[1].x.high)] == [-2, -22, 16]
    for r in got:
        assert (r.x.low, r.x.high) == pytest.approx((-r.y.high, -r.y.low)) and -1 <= r.x.low <= r.x.high <= 1


CLASSES = ["equivalent", "agent_narrower", "agent_wider", "agent_different", "agent_wrong"]


def brute_agreement(pairs):
    pairs = [(a, b) for a, b in pairs if a not in (None, "unclear", "unparseable", "") and b not in (None, "unclear", "unparseable", "")]
    n = len(pairs)
    po = sum(a == b for a, b in pairs) / n
    labels = {x for p in pairs for x in p}
    pa, pb = ({x: sum(p[s] == x for p in pairs) / n for x in labels} for s in (0, 1))
    pe, k = sum(pa[x] * pb[x] for x in labels), len(labels)
    chance = sum((pa[x] + pb[x]) / 2 * (1 - (pa[x] + pb[x]) / 2) for x in labels) / (k - 1) if k > 1 else 0
    return n, po, 0.0 if pe >= 1 else (po - pe) / (1 - pe), (po - chance) / (1 - chance) if k > 1 else 0.0, (k * po - 1) / (k - 1) if k > 1 else 0.0


def test_agreement_equals_brute_force(spark):
    rng = random.Random(1)
    groups = {"mixed": [(rng.choice(CLASSES), rng.choice(CLASSES[:3] + ["unclear"])) for _ in range(80)], "same": [(x, x) for x in CLASSES * 3], "one": [("equivalent", "equivalent")] * 9, "skew": [("equivalent", "equivalent")] * 19 + [("equivalent", "agent_wrong")]}
    df = spark.createDataFrame([(g, a, b) for g, ps in groups.items() for a, b in ps], "g string, a string, b string")
    for r in ag.agreement(df, "a", "b", ["g"]).collect():
        assert (r.n, r.observed, r.kappa, r.ac1, r.pabak) == pytest.approx(brute_agreement(groups[r.g])), r.g
        assert r.n_excluded == len(groups[r.g]) - r.n
    none = ag.agreement(spark.createDataFrame([("unclear", "x")], "a string, b string"), "a", "b").first()
    assert (none.n, none.n_excluded, none.kappa) == (0, 1, None)


def test_labels(spark):
    row = spark.range(1).select(lb.collapse(F.lit("agent_wider")).alias("a"), lb.collapse(F.lit("unclear")).alias("b"), lb.standing(F.lit(0.6)).alias("c"), lb.standing(F.lit(0.39)).alias("d"), lb.kappa_band(F.lit(0.8)).alias("e"), lb.kappa_band(F.lit(0.1)).alias("f"), lb.route(F.lit(None).cast("string")).alias("g"), lb.route(F.lit("")).alias("h"), iv.percent(F.lit(0.125)).alias("i")).first()
    assert tuple(row) == ("acceptable", None, "quotable", "failed", "substantial", "slight", "not recorded", "direct", "12%")
    with pytest.raises(Exception, match="no progress"):
        spark.range(1).select(lb.outcome_class(F.lit(True), F.lit(None).cast("double"))).collect()
    with pytest.raises(Exception, match="unknown label"):
        spark.range(1).select(lb.classify(F.lit("x"), {"y": "z"})).collect()


def test_allocation_of_a_published_draw_and_its_bounds():
    available = [1, 3, 10, 14, 3, 1, 5, 15, 2, 18, 5]
    assert list(sm.allocate(dict(enumerate(available)), 48, 2).values()) == [1, 3, 7, 7, 3, 1, 5, 7, 2, 7, 5]
    rng = random.Random(0)
    for _ in range(300):
        sizes = {k: rng.choice([0, 1, 2, 9, 40]) for k in range(rng.randint(1, 8))}
        n, floor = rng.randint(0, 60), rng.randint(0, 4)
        got = sm.allocate(sizes, n, floor)
        assert sum(got.values()) == min(n, sum(sizes.values())) and all(0 <= got[k] <= sizes[k] for k in sizes)


def test_samples(spark):
    df = spark.range(500).select(F.col("id"), F.when(F.col("id") % 10 == 0, "rare").otherwise("common").alias("s"))
    one, two = (sm.stratified_sample(df.repartition(k), ["s"], "id", 40, 3).where("picked").orderBy("id").collect() for k in (1, 5))
    assert one == two and len(one) == 40
    assert sm.stratified_sample(df, ["s"], "id", 40, 4).where("picked").orderBy("id").collect() != one
    audit = sm.audit_sample(df, F.col("s") == "rare", "id", 45, 1).collect()
    assert sum(r.flagged for r in audit) == 50 and sum(not r.flagged for r in audit) == 45 and {r.probability for r in audit} == {1.0, 0.1}
    assert sm.empty_strata(df, spark.createDataFrame([("rare",), ("never",)], "s string"), ["s"]).collect()[0].s == "never"


def test_bootstrap_bounds(spark):
    rng = random.Random(5)
    rows = [("a", rng.choice([0.0, 0.0, 0.3, 1.0]), k % 12) for k in range(120)] + [("b", 2.0, 1)] * 20 + [("c", 1.5, 3)]
    df = spark.createDataFrame(rows, "g string, x double, c int")
    got = {r.g: r for r in rs.bootstrap_mean(df, ["g"], "x").collect()}
    a = [x for g, x, _ in rows if g == "a"]
    mean, sd = sum(a) / len(a), (sum((x - sum(a) / len(a)) ** 2 for x in a) / len(a)) ** 0.5
    assert got["a"].point == pytest.approx(mean) and got["a"].low == pytest.approx(mean - 1.96 * sd / len(a) ** 0.5, abs=0.02) and got["a"].high == pytest.approx(mean + 1.96 * sd / len(a) ** 0.5, abs=0.02)
    assert got["b"].degenerate and got["b"].low == got["b"].high == 2.0 and not got["a"].degenerate and got["c"].n == 1
    again = {r.g: r for r in rs.bootstrap_mean(df.repartition(7), ["g"], "x").collect()}
    assert again == got
    clustered = {r.g: r for r in rs.cluster_bootstrap(df, ["g"], "c", "x").collect()}
    assert clustered["a"].point == pytest.approx(mean) and clustered["a"].n == 12


def test_kappa_interval_holds_its_point(spark):
    rng = random.Random(7)
    rows = [(x, x if rng.random() < 0.7 else rng.choice(CLASSES)) for x in (rng.choice(CLASSES) for _ in range(60))]
    r = rs.kappa_interval(spark.createDataFrame(rows, "a string, b string"), [], "a", "b").first()
    assert r.low < r.point < r.high and r.point == pytest.approx(brute_agreement(rows)[2])


def test_sequences(spark):
    df = spark.createDataFrame([("k", i, v, f) for i, (v, f) in enumerate([(1.0, True), (2.0, True), (3.0, False), (4.0, True), (5.0, True), (6.0, True)])], "k string, i int, v double, f boolean")
    assert [r.v for r in sq.until_spent(df, ["k"], ["i"], "v", 6.0).orderBy("i").collect()] == [1.0, 2.0, 3.0]
    assert sorted((r.run_start, r.run_end, r.length) for r in sq.runs(df, ["k"], ["i"], F.col("f")).collect()) == [(0, 1, 2), (3, 5, 3)]
    assert sq.upper_median_by(df, ["k"], "v").first().upper_median == 4.0 == df.groupBy("k").agg(sq.upper_median(F.col("v")).alias("m")).first().m
    assert sq.describe(df, ["k"], "v").first().median == 3.5
    first = sq.first_step(df, ["k"], ["i"], {"no": ~F.col("f"), "never": F.lit(False)}).first()
    assert (first.first_no, first.first_never) == (3, None)
    late = sq.latest(spark.createDataFrame([("k", "a", 1), ("k", "b", 2), ("k", "c", 2)], "k string, c string, t int"), ["k"], "c", "t").collect()
    assert {r.c: r.superseded for r in late} == {"a": True, "b": False, "c": True}


def test_any_statistic_and_its_failed_draws(spark):
    import numpy as np

    df = spark.createDataFrame([(g, float(x)) for g in "ab" for x in range(40)], "g string, x double")
    top = lambda counts, x: float(x[counts > 0].max())
    got = {r.g: r for r in rs.bootstrap(df, ["g"], ["x"], top, n_boot=400).collect()}
    assert got["a"].point == 39.0 and got["a"].low < 39 == got["a"].high and got["a"].draws == 400
    with pytest.raises(Exception, match="more than half"):
        rs.bootstrap(df, ["g"], ["x"], lambda counts, x: float("nan") if counts[0] > 0 else 1.0, n_boot=400).collect()
    rare = rs.bootstrap(df, ["g"], ["x"], lambda counts, x: float("nan") if counts[0] > 2 else 1.0, n_boot=400).first()
    assert 200 < rare.draws < 400 and rare.degenerate and not np.isnan(rare.low)


def test_mean_draws_do_not_depend_on_partitions_and_cover_the_normal_interval(spark):
    df = spark.createDataFrame([(k % 2, float(k * k % 97)) for k in range(900)], "g bigint, x double")
    a, b = ({r.g: r for r in rs.bootstrap_mean(df.repartition(n), ["g"], "x", n_boot=1000).collect()} for n in (1, 7))
    for g, r in a.items():
        values = [float(k * k % 97) for k in range(900) if k % 2 == g]
        mean = sum(values) / len(values)
        half = 1.96 * (sum((v - mean) ** 2 for v in values) / len(values) ** 2) ** 0.5
        assert r.point == pytest.approx(mean) and (r.low, r.high) == pytest.approx((b[g].low, b[g].high))
        assert r.high - r.low == pytest.approx(2 * half, rel=0.12) and r.n == len(values)


def test_scans_equal_windows_and_spread_a_hot_key(spark):
    """A key holds most rows and lies in several parts; nulls are a key too."""
    import random

    from pyspark.sql import Window as W

    from gaugeworks.operators import scans

    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), k, rng.choice([None, 1, 2, 5]), rng.random() < 0.5) for k in range(3000)]
    df = spark.createDataFrame(rows, "k string, i int, v int, f boolean")
    w = W.partitionBy("k").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        placed = scans.in_order(df, ["k"], ["i"])
        assert placed.where("k = 'hot'").select("_part").distinct().count() > 2
        got = scans.running_sum(df, ["k"], ["i"], F.col("v"), "s").join(scans.last_value(df, ["k"], ["i"], F.col("v"), "l").select("i", "l"), "i")
        want = df.withColumns({"s": F.sum("v").over(w), "l": F.last("v", ignorenulls=True).over(w)})
        assert sorted(map(tuple, got.select("i", "s", "l").collect())) == sorted(map(tuple, want.select("i", "s", "l").collect()))
        assert {(r.k, r.n, r.m) for r in scans.quantiles(df, ["k"], "v", {"m": 0.37}).collect()} == {(r.k, r.n, r.m) for r in df.groupBy("k").agg(F.count("v").alias("n"), F.percentile("v", 0.37).alias("m")).collect()}
        found = sq.describe(df, ["k"], "v")
        assert "percentile" not in found._jdf.queryExecution().executedPlan().toString().lower() and {r.listed for r in found.collect()} == {None}
        few = sq.describe(spark.createDataFrame([("a", v) for v in (3.0, 1.0, 3.0)] + [("b", None)], "k string, v double"), ["k"], "v").collect()
        assert [(r.n, r.median, r.mean, r.listed) for r in few] == [(3, 3.0, 7 / 3, [1.0, 3.0, 3.0])]
        assert [tuple(r) for r in sq.runs(df, ["k"], ["i"], F.lit(True)).where("k = 'hot'").select("length").collect()] == [(sum(r[0] == "hot" for r in rows),)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_clusters_need_a_shared_folder():
    from types import SimpleNamespace

    from gaugeworks.shared import shared_dir

    session = lambda master, named=None: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: named), sparkContext=SimpleNamespace(master=master, applicationId="x"))
    assert shared_dir(session("yarn", "hdfs://a/b/")) == "hdfs://a/b"
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            shared_dir(session(master))
    assert shared_dir(session("local[2]"))


def test_a_key_that_retires_very_often_takes_one_step_each():
    import time

    from gaugeworks.operators.ledger import Ledger

    book, began = Ledger(1e9), time.process_time()
    for _ in range(30_000):
        book.apply("settle", "k", 1.0)
        book.apply("retire", "k", None)
    assert time.process_time() - began < 5 and "k#retired-30000" in book.settled and len(book.settled) == 30_000
    book.apply("retire", "k#retired-7", None)
    book.apply("settle", "k", 1.0)
    book.apply("retire", "k", None)
    assert "k#retired-7" in book.settled and "k#retired-30001" not in book.settled


def _weighted_median(counts, x):
    order = np.argsort(x)
    upto = np.cumsum(counts[order])
    return float(x[order][np.searchsorted(upto, upto[-1] / 2)])


def test_little_bootstraps(spark):
    """Intervals of medians of 60 groups of 4,000 rows hold the true median about as often as stated; small groups are the plain bootstrap."""
    rng = np.random.default_rng(1)
    rows = [(g, i, float(x)) for g in range(60) for i, x in enumerate(rng.exponential(1.0, 4000))]
    df = spark.createDataFrame([*rows, (99, 1, 1.0), (99, 2, 1.0), (99, 3, None), (98, 1, None)], "g int, id int, x double")
    got = {r.g: r for r in rs.little_bootstrap(df.repartition(7), ["g"], ["x"], "id", _weighted_median, subset=400, subsets=5).collect()}
    assert set(got) == {*range(60), 99} and all(got[g].n == 4000 and got[g].subsets == 5 for g in range(60))
    held = sum(got[g].low <= math.log(2) <= got[g].high for g in range(60))
    assert held >= 50  # 95 % of 60 are 57; below 50 has a chance of less than one in a thousand
    assert tuple(got[99])[1:5] == (1.0, 1.0, 1.0, 2)
    again = {r.g: r for r in rs.little_bootstrap(df, ["g"], ["x"], "id", _weighted_median, subset=400, subsets=5).collect()}
    assert again == got  # whatever the partitions
    few = df.where("g < 3 and id < 50")
    mean = lambda c, x: float(c @ x / c.sum())
    plain = {r.g: r for r in rs.bootstrap_mean(few, ["g"], "x").collect()}
    for r in rs.little_bootstrap(few, ["g"], ["x"], "id", mean, n_boot=2000, point=F.avg("x")).collect():
        assert r.subsets == 1 and r.point == pytest.approx(plain[r.g].point) and abs(r.low - plain[r.g].low) < 0.08 and abs(r.high - plain[r.g].high) < 0.08
    whole = rs.little_bootstrap(df.where("g < 2"), [], ["x"], "id", mean, subset=1000).collect()
    assert len(whole) == 1 and whole[0].n == 8000 and whole[0].subsets == 8
    assert rs.little_bootstrap(df.limit(0), [], ["x"], "id", mean).collect() == [] == rs.little_bootstrap(df.limit(0), ["g"], ["x"], "id", mean).collect()
    with pytest.raises(Exception, match="more than half"):
        rs.little_bootstrap(few, ["g"], ["x"], "id", lambda c, x: float("nan") if c.max() > 1 and c.dtype.kind == "i" else 1.0).collect()
