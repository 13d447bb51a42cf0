import random
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import text as tx
from gaugeworks.plans import catalogue, source_queries  # noqa: F401  the other adds to the catalogue
from gaugeworks.sources import files as fl

from . import oracle


def documents(folder, texts):
    ids = pa.array([k for k, _ in texts], pa.int64())
    pq.write_table(pa.table({"doc_id": ids, "text": pa.array([t for _, t in texts], pa.string())}), folder / "documents.parquet")
    return str(folder)


def test_a_literal_that_is_repeated_has_its_first_line_and_other_rules_no_rows(spark, tmp_path):
    a, b = 'token = "' + "ab" * 20 + '"', 'password\t=\n"' + "09" * 16 + '"'
    texts = [
        (1, f"x\n{a} {a}\n\n{b}\nmy{a}\n{b}"), (2, f"\n\n{a}"), (2, f"{b}\n{a}\n{a}"), (3, "key AKIA" + "Q7" * 8 + "\nsk-" + "a1" * 20 + "\nghp_" + "Z" * 36 + "\n-----BEGIN PRIVATE KEY-----"),
        (4, 'secret\x0b= "' + "cd" * 16 + '"'), (5, None), (6, ""), (7, f"é\r\n{a[:-1]}\n{a} {a}"),
    ]
    folder = documents(tmp_path, texts)
    assert oracle.check(spark, oracle.connect(folder), folder, catalogue.QUERIES["secret_scan"], catalogue.SQL["secret_scan"]) == 11


def rows(reader):
    return sorted(r for part in reader.partitions() for batch in reader.read(part) for r in zip(*(c.to_pylist() for c in batch.columns)))


@pytest.mark.parametrize(("piece", "least"), [(1, 1), (7, 20), (40, 5), (40, 1000), (500, 300)])
def test_shares_hold_the_pieces_of_single_ranges(tmp_path, monkeypatch, piece, least):
    rng = random.Random(piece + least)
    sizes = [0, 1, 3, 400, 5000, *(rng.randint(0, 90) for _ in range(20))]
    for k, n in enumerate(sizes):
        (tmp_path / f"f{k:02d}").write_bytes(bytes(rng.choice(b"ab-_ \n.;\xff") for _ in range(n)))
    (tmp_path / "run").write_bytes(b"x" * 3000 + b".\n")
    monkeypatch.setattr(fl, "STEP", 64)
    single = rows(fl.RangeReader({"path": str(tmp_path), "piece": piece}))
    monkeypatch.setattr(fl, "LEAST", least)
    monkeypatch.setattr(fl, "BATCH", least)
    shared = fl.SharedReader({"path": str(tmp_path), "piece": piece})
    assert rows(shared) == single and sum(len(t) for _, _, t in single) == sum(sizes) + 3002
    assert len(shared.partitions()) <= 2 * fl.TASKS


def test_many_small_pieces_take_few_tasks(spark, tmp_path):
    for k in range(30):
        (tmp_path / f"{k}.txt").write_text("a line.\n" * 200)
    pieces = fl.read_ranges(spark, str(tmp_path), 50)
    assert pieces.rdd.getNumPartitions() <= 4
    assert pieces.agg(F.count("*"), F.sum(F.length("text"))).first()[:] == (30 * 32, 30 * 1600)


def test_what_is_looked_for_first_stands_in_every_match(spark):
    made = [
        *(f"-----BEGIN {k}PRIVATE KEY-----" for k in ("", "RSA ", "OPENSSH ")), *(f"sk-{k}" + "a_-1" * 7 for k in ("", "proj-", "svcacct-", "ant-api03-", "or-v1-")), *(f"gh{k}_" + "Zz9" * 12 for k in "pousr"),
        "github_pat_" + "a_B3" * 11, "AKIA" + "Q7" * 8, "ASIA" + "Z9" * 8, "AIza" + "x" * 35, *(f"xox{k}-" + "9a-" * 8 for k in "baprs"), *(f'{k} = "' + "0f" * 17 + '"' for k in ("token", "secret", "password")),
    ]
    texts = [*(f"x\n{m} {m}\n\n.{m}\nx{m}" for m in made), "\n".join(made), "", "sk-", "risk-free AKIA xox token", None]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", tx.secret_hits(F.col("t")).alias("h")).collect()
    for r in got:
        t = texts[r.k]
        want = t if t is None else [(rule, n, t.count("\n", 0, m.start()) + 1, m[0]) for rule, p in tx.SECRET_RULES.items() for n, m in enumerate(re.finditer(p, t, re.ASCII), 1)]
        assert want == (None if r.h is None else [tuple(x) for x in r.h])
    assert {x.rule for r in got for x in r.h or ()} == set(tx.SECRET_RULES) and set(tx._HELD) == set(tx.SECRET_RULES.values())
