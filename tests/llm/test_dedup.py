import random

import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import simhash as sh
from gaugeworks.llm.components import connected_components
from gaugeworks.llm.exact_dedup import exact_duplicates

from . import brute

SCHEMA = "doc_id bigint, text string"


def corpus(seed, n, vocabulary=40):
    """Random texts, some with copies that differ in a word, in case or in white space."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4)))
    pool = [word() for _ in range(vocabulary)]
    texts = []
    while len(texts) < n:
        t = " ".join(rng.choice(pool) for _ in range(rng.randint(0, 60)))
        texts.append(t)
        for _ in range(rng.choice([0, 0, 1, 3])):
            ws = t.split(" ")
            kind = rng.randrange(3)
            if kind == 0:
                ws[rng.randrange(len(ws))] = word()
                texts.append(" ".join(ws))
            else:
                texts.append(t.upper().replace("É", "é") if kind == 1 else t.replace(" ", "\n ", 2))
    rng.shuffle(texts)
    return list(enumerate(texts[:n]))


def test_simhash_components_equal_brute_force(spark):
    rows = corpus(1, 250) + [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "w " * 5000), (1004, "w " * 5000)]
    got = sh.simhash_components(spark.createDataFrame(rows, SCHEMA).withColumns({"f0": F.lit("x"), "node": F.lit(1), "component_id": F.lit(2)})).collect()
    prints = {d: brute.fingerprint(t) for d, t in rows}
    assert {r.doc_id: r.f0 % (1 << 64) for r in got} == prints
    assert {r.doc_id: r.component_id for r in got} == brute.components(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    assert len(got) == len(rows)


def test_simhash_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (None, "q r s t u v")]
    got = sh.simhash_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(str((r.doc_id, r.component_id)) for r in got) == sorted(map(str, [(3, 3), (3, 3), (None, 3), (None, None)]))
    assert sh.simhash_components(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("radius", [0, 3, 10, 70])
def test_close_pairs_are_all_pairs(radius):
    import numpy as np

    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, (6, 2), dtype=np.uint64)
    a = np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 63, (6, 2)).astype(np.uint64)) for _ in range(60)])
    want = {(i, j) for i in range(len(a)) for j in range(i + 1, len(a)) if int(np.bitwise_count(a[i] ^ a[j]).sum()) <= radius}
    found = [(int(i), int(j)) for x, y, _ in sh.close_pairs(a, a, radius, radius, True) for i, j in zip(x, y)]
    assert len(found) == len(set(found)) and set(found) == want


def test_chunks_do_not_change_links(spark):
    rows = [(i, (i % 7) | (1 << (i % 50))) for i in range(300)]
    nodes = spark.createDataFrame(rows, "node bigint, f0 bigint")
    want = brute.components(dict(rows), lambda a, b: (a ^ b).bit_count() <= 3)
    for chunk in (5, 64, 8192):
        links = sh.forest_links(nodes, 3, chunk=chunk)
        found = {r.node: r.component for r in connected_components(links.select("u", "v")).collect()}
        assert {k: found.get(k, k) for k, _ in rows} == want


def test_large_group_leaves_a_forest(spark):
    nodes = spark.range(400).select(F.col("id").alias("node"), F.expr("shiftleft(1L, cast(id % 60 as int))").alias("f0"))
    assert sh.forest_links(nodes, 3).count() <= 2 * 400


def test_near_duplicates_equal_brute_force(spark):
    rows = [(d, t) for d, t in corpus(5, 200) if len(t.split()) > 8 or not t]
    got = {r.doc_id: r.component_id for r in sh.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    sets = {d: brute.shingles(t, 5) for d, t in rows}
    assert got == brute.components(sets, lambda a, b: brute.jaccard(a, b) >= 0.8)


def test_candidates_behind_failed_links_are_checked(spark):
    rng, rows = random.Random(11), []
    for family in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(160)]
        for k in range(14):  # similarities around 0.8 within a family
            ws = list(base)
            for at in rng.sample(range(160), 2):
                ws[at] = f"x{rng.randrange(10**6)}"
            rows.append((family * 100 + k, " ".join(ws)))
    got = {r.doc_id: r.component_id for r in sh.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    sets = {d: brute.shingles(t, 5) for d, t in rows}
    want = brute.components(sets, lambda a, b: brute.jaccard(a, b) >= 0.8)
    assert 20 < len(set(want.values())) < 160
    assert got == want


def test_near_duplicates_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a"), (4, "A"), (4, "A"), (None, "a")]
    got = {r.doc_id: r.component_id for r in sh.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3}
    assert sh.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_a_long_chain_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(120)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5), (2000, 1999), (2000, 1999), (None, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert all(got[i] == 0 for i in range(121)) and all(got[i] == 1000 for i in range(1000, 1100)) and got[2000] == got[1999] == 1999
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_edges_that_one_task_holds_are_settled_before_the_rounds(spark, monkeypatch):
    """Jobs of the driver: a list that fits one task is written twice, however long its chains are."""
    from gaugeworks.llm import components

    rng, made = random.Random(3), []
    edges = [(i, i + 1) for i in range(500)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(300)]
    want = components.Forest()
    for u, v in edges:
        want.join(u, v)
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    monkeypatch.setattr(components, "written", lambda df, name, f=components.written: made.append(name) or f(df, name))
    for kind, of in (("bigint", int), ("string", "{:05d}".format)):
        df = spark.createDataFrame([(of(u), of(v)) for u, v in edges], f"u {kind}, v {kind}")
        for held in (components.HELD, 7):
            made.clear()
            got = {r.node: r.component for r in connected_components(df, held=held).collect()}
            assert got == {of(x): of(want.root(x)) for x in nodes}
            assert held == 7 or len(made) == 2


@pytest.mark.parametrize("how", [{}, {"block": 3}, {"block": 3, "digest": lambda b: F.length(b)}, {"block": 1, "digest": lambda b: F.lit(1)}])
def test_exact_duplicates_equal_brute_force(spark, how):
    rows = corpus(2, 120 if how else 300) + [(900, None), (901, ""), (902, " \n\t"), (903, "x" * 30_000), (904, "x " * 30_000), (905, "x" * 29_999 + "y")]
    if how:
        rows = [(d, (t or "")[:60]) for d, t in rows]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"row": F.lit("x"), "name": F.lit(1), "block": F.lit(2)})
    got = exact_duplicates(df, **how).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == brute.exact_groups(rows)
    assert len(got) == len(rows)


def test_exact_duplicates_keeps_one_of_repeated_rows(spark):
    got = exact_duplicates(spark.createDataFrame([(7, "a b"), (7, "a b"), (7, "ab"), (None, "ab"), (None, "z")], SCHEMA)).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in got) == [("7", "7", 4)] * 3 + [("None", "7", 4), ("None", "None", 1)]
    assert sum(r.kept for r in got) == 2
    assert exact_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
