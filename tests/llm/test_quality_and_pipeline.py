import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from gaugeworks.llm import quality as q
from gaugeworks.llm.queries import op7_quality, queries
from gaugeworks.llm.simhash import near_duplicates

from . import brute


def test_features_are_the_same_in_any_order_and_leave_the_buffer_clean():
    seen = np.zeros(q.DIM, dtype=bool)
    for text in ("", "a", "ab", "abc abc abc", "é" * 2_000_000 + "x"):
        first = q.features(text, seen)
        assert not seen.any() and (q.features(text, seen) == first).all()
    assert len(q.features("", seen)) == 0


def test_model_on_separable_rows_and_on_one_class():
    rng = np.random.default_rng(0)
    rows = [np.unique(np.concatenate([rng.integers(1000, 4000, 60), rng.integers(0, 40, 6) + 100 * (k % 2)])) for k in range(300)]
    labels = np.array([k % 2 for k in range(300)])
    model = q.fit(rows, labels)
    scores = np.array([model.score(r) for r in rows])
    assert ((scores > 0.5) == (labels == 1)).mean() > 0.95
    assert q.fit(rows[:3], np.ones(3)).score(rows[0]) > 0.5
    assert q.fit([], np.zeros(0)).score(rows[0]) == pytest.approx(0.5)


def test_ratios_equal_brute_force_and_descent_ends_at_the_optimum():
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 40, rng.integers(0, 12))) + 7 * (k % 2) for k in range(80)]
    y, train = np.array([1.0 if k % 2 else -1.0 for k in range(80)]), np.arange(60)
    ratio = q.count_ratios(rows, y, train, 1.0)
    count = {s: {j: 1.0 + sum(j in rows[k] for k in train if y[k] == s) for j in range(60)} for s in (1.0, -1.0)}
    total = {s: sum(count[s].values()) + q.DIM - 60 for s in count}
    assert ratio[:60] == pytest.approx([np.log(count[1.0][j] / total[1.0]) - np.log(count[-1.0][j] / total[-1.0]) for j in range(60)])
    x = np.zeros((80, 61))
    for k, r in enumerate(rows):
        x[k, r] = ratio[r] / max(1, len(r)) ** 0.5
    x[:, 60] = 1  # the bias
    upper = {1.0: 0.7, -1.0: 1.1}
    w, bias, dual = q.descend(rows, y, train, ratio, np.array([max(1, len(r)) ** 0.5 for r in rows]), upper, 600, np.random.default_rng(1))
    full = np.append(w[:60], bias)
    assert full == pytest.approx((dual * y) @ x, abs=1e-9) and not w[60:].any() and not dual[60:].any()
    bound = np.array([upper[s] for s in y])
    loss = np.maximum(0, 1 - y * (x @ full))[:60]
    # Primal and dual values meet at the optimum alone.
    primal, value = full @ full / 2 + (bound[:60] * loss).sum(), dual.sum() - full @ full / 2
    assert (dual >= 0).all() and (dual <= bound + 1e-12).all() and primal - value < 1e-3 * primal


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = op7_quality(spark, sf).toPandas()
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet").toPandas() for t in ("documents", "labels"))
    assert sorted(got.doc_id) == sorted(docs.doc_id)
    assert (got.held_out == got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    both = got.merge(labels, on="doc_id")
    held = both[both.held_out]
    good, bad = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.97
    assert (held.predicted == held.quality).mean() > 0.95


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (2, "")], "doc_id bigint, text string").withColumn("quality", F.lit("x"))
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 0), (2, None), (1, 7)], "doc_id bigint, quality int")
    model = q.train_quality(docs, labels)
    rows = q.score_quality(docs.withColumn("quality_score", F.lit("old")), model).collect()
    assert len(rows) == 4 and all(0 <= r.quality_score <= 1 for r in rows)
    assert q.score_quality(docs.limit(0), q.train_quality(docs.limit(0), labels.limit(0))).count() == 0


def test_stages_keep_the_columns_and_do_what_they_say(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    source = {r.doc_id: r.text for r in docs.collect()}
    sized = [len(source)]
    now = docs
    for name, stage in cp.STAGES[:-1]:
        before = {r.doc_id: r.text for r in now.collect()}
        after = stage(spark, now, sf_dir)
        rows = after.collect()
        assert after.columns == docs.columns
        left = {r.doc_id for r in rows}
        assert len(left) == len(rows) and left <= set(before)
        if name == "exact dedup":
            want = {d for d, (_, _, kept, _) in brute.exact_groups(before.items()).items() if kept}
            assert left == want
        if name == "near dedup":
            sets = {d: brute.shingles(t, 5) for d, t in before.items()}
            assert left == {d for d, c in brute.components(sets, lambda a, b: brute.jaccard(a, b) >= 0.8).items() if d == c}
        now = spark.createDataFrame([r for r in rows], docs.schema)
        sized.append(len(rows))
    packed = cp.packing(spark, now, sf_dir).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in now.collect()}
    assert sized[-1] > 0.5 * sized[0]


def test_stages_with_nulls_repeats_and_empty_tables(spark, sf_dir):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(1, "a b c", "en", None, 5), (1, "a b c", "en", None, 5), (2, None, None, None, None), (None, "x y", None, "s", 3), (None, None, None, None, None), (3, "abc", "en", "s", 3)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in cp.STAGES:
        stage(spark, docs, sf_dir).collect()
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    kept = cp.exact_dedup(spark, docs, sf_dir).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == [("1", "a b c"), ("2", None), ("None", "x y")]


def test_rows_without_id_are_judged_like_others(spark, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first().text
    prose = " ".join(f"w{i}" for i in range(200))
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame([(1, prose, "en", "s", 1), (None, prose + " end", None, None, 2), (None, "other " + item, None, None, 3), (None, "clean words here", None, None, 4)], schema)
    assert sorted(r.n_chars for r in cp.near_dedup(spark, docs, sf_dir).collect()) == [1, 3, 4]
    assert sorted(r.n_chars for r in cp.decontaminate(spark, docs, sf_dir).collect()) == [1, 2, 4]


def test_rows_that_share_an_id_keep_their_own_texts(spark, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first().text
    prose, other = (" ".join(f"{c}{i}" for i in range(200)) for c in "wv")
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(1, prose, "en", "s", 1), (5, other, "en", "s", 2), (5, prose + " end", "en", "s", 3), (5, "see " + item, "en", "s", 4), (5, other, "en", "s", 5)]
    docs = spark.createDataFrame(rows, schema).withColumn("_row", F.lit("x"))
    assert sorted(r.n_chars for r in cp.near_dedup(spark, docs, sf_dir).collect()) in ([1, 2, 4], [1, 4, 5])
    assert sorted(r.n_chars for r in cp.decontaminate(spark, docs, sf_dir).collect()) == [1, 2, 3, 5]
    held = cp.SEND_UP_TO
    try:
        cp.SEND_UP_TO = 0
        assert sorted(r.n_chars for r in cp.exact_dedup(spark, docs, sf_dir).collect()) in ([1, 2, 3, 4], [1, 3, 4, 5])
    finally:
        cp.SEND_UP_TO = held


def test_rows_are_numbered_by_place_or_written(spark, tmp_path):
    rows = [(i, f"text {i % 7}", "en", "s", 6) for i in range(500)]
    made = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    made.repartition(5).write.parquet(str(tmp_path / "docs"))
    read = spark.read.parquet(str(tmp_path / "docs"))
    again = spark.read.option("maxSplitBytes", "1").parquet(str(tmp_path / "docs"))
    keys = [sorted((r._row, r.doc_id) for r in cp._by_place(d).collect()) for d in (read, again.where("doc_id >= 0"))]
    assert keys[0] == keys[1] and len({k for k, _ in keys[0]}) == 500
    # Rows that don't come from files, or were multiplied after reading, are written with numbers.
    twice = read.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("n"))
    for docs, n in ((made, 500), (read.unionAll(read), 1000), (twice, 1000), (twice.withColumn("_metadata", F.lit(1)), 1000)):
        assert cp._by_place(docs) is None
        assert cp._numbered(docs).select("_row").distinct().count() == n
    assert cp._numbered(read.limit(0)).count() == 0
    assert cp.exact_dedup(spark, twice, "").count() == 7 == cp.exact_dedup(spark, read, "").count()


def test_families_of_near_copies_equal_brute_force(spark):
    """150 families of eight copies each, with none to a sixtieth of the words replaced."""
    import random

    rng, rows = random.Random(17), []
    for family in range(150):
        n = rng.choice([60, 120, 300])
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        for k in range(8):
            ws = list(base)
            for at in rng.sample(range(n), rng.randint(0, max(1, n // 60))):
                ws[at] = f"x{rng.randrange(10**6)}"
            rows.append((family * 10 + k, " ".join(ws)))
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for family in range(150):
        sets = {d: brute.shingles(t, 5) for d, t in rows if d // 10 == family}
        assert {d: got[d] for d in sets} == brute.components(sets, lambda a, b: brute.jaccard(a, b) >= 0.8)


def test_every_operator_has_a_query():
    assert [name.split("_")[0] for name in queries()] == [f"op{n}" for n in range(1, 14)]


def test_repeated_labelled_rows_are_fitted_once(spark, monkeypatch):
    """A labelled id that stands in very many rows brings one of them, the same each time."""
    rows = [(1, f"good text number {k}") for k in range(500)] + [(k, f"text {k}") for k in range(2, 60)] + [(1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(q, "fit", lambda found, y: seen.append([len(found), sorted(y), sorted(f.tobytes() for f in found)]))
    for d in (docs, docs.repartition(5)):
        q.train_quality(d, labels, per_class=10)
    assert seen[0][0] <= 20 and seen[0] == seen[1]


def test_the_driver_holds_four_bytes_an_indicator(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"text number {k} " * (1 + k % 3)) for k in range(40)] + [(k, "".join(map(chr, range(33, 9000)))) for k in range(40, 46)], "doc_id long, text string")
    held = []
    monkeypatch.setattr(q, "fit", lambda found, y: held.extend(found))
    q.train_quality(docs, spark.createDataFrame([(k, k % 2) for k in range(46)], "doc_id long, quality int"))
    assert held and all(f.dtype.itemsize == 4 for f in held) and max(map(len, held)) > (q.DIM // 8) // 4
