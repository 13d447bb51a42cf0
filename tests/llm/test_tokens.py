import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gaugeworks.llm import packing as pk
from gaugeworks.llm import token_counts as tc
from gaugeworks.llm import token_shards as ts
from gaugeworks.llm.tokens import Encoder, vocabulary

from . import brute

DOCS = "doc_id bigint, text string"
ODD = ["", " ", "  ", "a", " a", "a  b", "a \n b", "\n\n x", "it's we'll  'd", "12a 3", "x" * 3000, "<|endoftext|> a", "İK ²Ⅷ\x1c\x1d \x85y", "😀 é,é.   x", "foo\n bar  baz", "!!! ... ''' 's's"]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(vocabulary())
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def random_text(rng, n):
    bits = ["the", "ing", " ", " ", "  ", "\n", "'ll", "'s", "é", "12", ",", ".", "!!", "\t", "Ü", "longerword", " ", "'", "s", "l"]
    return "".join(rng.choice(bits) for _ in range(n))


def texts(seed, n):
    rng = random.Random(seed)
    return ODD + [random_text(rng, rng.randint(0, 200)) for _ in range(n)]


def test_ids_equal_the_tokenizer(plain):
    for room in (3, 200_000):
        enc = Encoder(vocabulary(), remembered=room)
        for t in texts(1, 400):
            assert np.frombuffer(enc.ids(t), "<u4").tolist() == plain(t), t


def test_added_tokens_equal_the_tokenizer_in_its_default_state(spark, tmp_path):
    from gaugeworks.llm.queries import op5_pack

    whole, end, rng, enc = Tokenizer.from_file(vocabulary()), "<|endoftext|>", random.Random(5), Encoder(vocabulary(), added=True)
    want = lambda text: whole.encode(text, add_special_tokens=False).ids
    put = lambda n: "".join(rng.choice([end, end[:6], end[6:], "", random_text(rng, 9)]) for _ in range(n))
    odd = ["hello " + end + " x", end, end + end, "a  " + end + "  b", end[:-1], "<" + end + ">"] + [put(8) for _ in range(200)]
    assert want(odd[0]) == [31373, 220, 50256, 2124]
    for t in odd:
        assert np.frombuffer(enc.ids(t), "<u4").tolist() == want(t), t
        tree, now = tc.TokenTree(enc, t * 40), t * 40
        for _ in range(10):
            at, gone, new = rng.randint(0, len(now)), rng.choice([0, 1, 7, 300]), rng.choice(["", end, end[:6], end[6:], "x "])
            tree.edit(at, gone, new)
            now = now[:at] + new + now[at + gone :]
            assert (tree.text, tree.n_tokens) == (now, len(want(now)))
    spark.createDataFrame(list(enumerate(odd)), DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in op5_pack(spark, str(tmp_path)).collect()}
    assert got == {k: (len(want(t)) + 1, brute.crc([*want(t), pk.END_ID])) for k, t in enumerate(odd)}


def test_trees_after_edits_equal_full_counts(plain):
    rng, enc = random.Random(2), Encoder(vocabulary())
    for t in texts(3, 60) + [random_text(rng, 6000)]:
        tree, now = tc.TokenTree(enc, t), t
        assert tree.n_tokens == len(plain(t))
        for _ in range(25):
            at, gone, put = rng.randint(0, len(now) + 2), rng.choice([0, 1, 3, 40, 900]), random_text(rng, rng.choice([0, 1, 2, 30, 700]))
            tree.edit(at, gone, put)
            a = min(at, len(now))
            now = now[:a] + put + now[a + gone :]
            assert tree.text == now
            assert (tree.n_tokens, tree.n_chars) == (len(plain(now)), len(now)), (t, at, gone, put)
        again = tc.TokenTree(enc, now, *tree.leaves())
        again.edit(0, 1, "x")
        assert again.n_tokens == len(plain("x" + now[1:]))


def test_edits_encode_only_what_they_touch():
    enc = Encoder(vocabulary())
    tree = tc.TokenTree(enc, "some words here. " * 20_000)
    tree.encoded = 0
    tree.edit(150_000, 5, "other")
    assert 0 < tree.encoded < 1000


def test_count_tokens_with_listed_and_stored_edits(spark, plain):
    rows = list(enumerate(texts(4, 60))) + [(900, None), (None, "null id"), (901, "again"), (901, "again")]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"tokens": F.lit("x"), "chars": F.lit(1)})
    first = tc.count_tokens(docs, with_text=True)
    want = Counter((d, len(plain(t)), len(t or "")) for d, t in rows)
    assert Counter((r.doc_id, r.tokens, r.chars) for r in first.collect()) == want
    edits = F.array(F.struct(F.lit(2).alias("at"), F.lit(3).alias("removed"), F.lit("Zq' ll").alias("inserted")))
    second = tc.count_tokens(first.select("doc_id", "text", "leaf_chars", "leaf_tokens").withColumn("edits", edits), "edits", with_text=True).collect()
    changed = Counter((d, len(plain((t or "")[:2] + "Zq' ll" + (t or "")[5:]))) for d, t in rows)
    assert Counter((r.doc_id, r.tokens) for r in second) == changed
    assert all(r.tokens == len(plain(r.text)) and r.n_edits == 1 for r in second)
    assert tc.count_tokens(docs.limit(0), tc.cleaning_edits).count() == 0


def test_op4_over_the_given_documents(spark, sf_dir, plain):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    source = {r.doc_id: r.text for r in docs.collect()}
    for r in tc.count_tokens(docs, tc.cleaning_edits, with_text=True).collect():
        now = source[r.doc_id]
        for at, gone, put in tc.cleaning_edits(now):
            now = now[:at] + put + now[at + gone :]
        assert (r.text, r.tokens_before, r.tokens) == (now, len(plain(source[r.doc_id])), len(plain(now)))


def check_packing(rows, got, plain, window):
    want = Counter()
    by_text = {}
    for d, t in rows:
        ids = by_text.setdefault(t, [*plain(t), 0])
        want[d, len(ids)] += 1
    pieces = defaultdict(list)
    sequences = defaultdict(list)
    for r in got:
        pieces[r.doc_id, r.doc_tokens].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for (d, total), own in pieces.items():
        covered = Counter()
        for r in own:
            covered[r.start, r.length] += 1
        assert set(covered.values()) == {want[d, total]}
        at = 0
        for start, length in sorted(covered):
            assert start == at
            at += length
        assert at == total
    assert set(pieces) == set(want)
    crcs = {(d, len(by_text[t]), s): by_text[t] for d, t in rows for s in range(0, len(by_text[t]), 1)} if window <= 64 else None
    for r in got:
        if crcs and want[r.doc_id, r.doc_tokens] == 1:
            ids = crcs[r.doc_id, r.doc_tokens, r.start]
            assert r.ids_crc32 == brute.crc(ids[r.start : r.start + r.length])
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= window
    return 1 - sum(r.length for r in got) / (len(sequences) * window)


def test_packing_equals_brute_force(spark, plain):
    rows = list(enumerate(texts(6, 150))) + [(900, None), (None, "null id"), (901, "again and"), (901, "again and")]
    docs = spark.createDataFrame(rows, DOCS).repartition(5).withColumns({"start": F.lit("x"), "part": F.lit(1)})
    check_packing(rows, pk.pack(docs, window=32).collect(), plain, 32)
    assert pk.pack(docs.limit(0)).count() == 0


def test_packing_of_the_given_documents_leaves_little_padding(spark, sf_dir, plain):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert check_packing(rows, pk.pack(docs).collect(), plain, 1024) < 0.03


def test_plan_uses_the_histogram_up():
    rng = np.random.default_rng(0)
    for window, n in ((16, 5), (64, 3000), (1024, 200), (1024, 100_000)):
        h = np.bincount(rng.integers(1, window + 1, n), minlength=window + 1)
        h[window // 3] += n  # one length that half of all have
        used = np.zeros_like(h)
        for count, row in pk.plan(h, window):
            assert count > 0 and sum(row) <= window
            for v in row:
                used[v] += count
        assert (used == h).all()


def test_solver_reaches_an_exact_cover():
    h = np.zeros(17, dtype=np.int64)
    h[[10, 6, 8, 4]] = [50, 50, 20, 0]
    combos = pk.combinations(np.flatnonzero(h), 16)
    x = pk.solve(h, combos, 2000)
    found = {tuple(c): v for c, v in zip(combos.tolist(), x)}
    assert found[10, 6, 0] == pytest.approx(50, abs=0.5) and found[8, 8, 0] == pytest.approx(10, abs=0.5)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation_is_one(n):
    for key in (0, 7, 1 << 63):
        slots = ts.permute(np.arange(n), n, key)
        assert sorted(slots.tolist()) == list(range(n))
    if n > 60:
        assert ts.permute(np.arange(n), n, 1).tolist() != ts.permute(np.arange(n), n, 2).tolist()


@pytest.mark.parametrize("width", [2, 4])
def test_shards_round_trip(spark, plain, tmp_path, width):
    rows = list(enumerate(texts(8, 80))) + [(900, None), (None, "null id"), (901, "again"), (901, "again"), (902, "a very long one " * 20_000)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3).withColumns({"slot": F.lit("x"), "file": F.lit("y"), "sequence": F.lit(1)})
    order = [(r.doc_id, r.text) for r in docs.collect()]
    out = str(tmp_path / "shards")
    index = ts.write_shards(docs, out, length=32, per_shard=50, key=5, id_width=width).collect()
    stream, begins = [], []
    for _, t in order:
        begins.append(len(stream))
        stream += [*plain(t), ts.END_ID]
    n = -(-len(stream) // 32)
    assert sorted(r.slot for r in index) == list(range(n))
    slots = ts.permute(np.arange(n), n, 5)
    read = dict(ts.read_slots(out))
    assert sorted(read) == list(range(n))
    for r in index:
        own = stream[32 * r.sequence : 32 * r.sequence + 32]
        assert r.slot == slots[r.sequence] and (r.shard, r.place) == divmod(r.slot, 50)
        assert read[r.slot].tolist() == own + [ts.END_ID] * (32 - len(own)) and r.n_ids == len(own)
        k = max(k for k, b in enumerate(begins) if b <= 32 * r.sequence)
        assert (r.first_doc, r.first_start) == (order[k][0], 32 * r.sequence - begins[k])
        assert r.crc32 == zlib.crc32(read[r.slot].tobytes())
    assert [s for s, _ in ts.read_slots(out, 40, 70)] == list(range(40, 110))
    assert all((a == read[s]).all() for s, a in ts.read_slots(out, 40, 70))


def test_other_splits_of_the_same_files_give_the_same_shards(spark, sf_dir, tmp_path):
    many = spark.read.parquet(f"{sf_dir}/documents.parquet")
    many.repartition(4).write.option("parquet.block.size", 20_000).parquet(f"{tmp_path}/docs")
    held, made = spark.conf.get("spark.sql.files.maxPartitionBytes"), []
    try:
        for size in ("128m", "40k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            docs = spark.read.parquet(f"{tmp_path}/docs")
            out = str(tmp_path / size)
            rows = ts.write_shards(docs, out, length=128, per_shard=64).orderBy("slot").collect()
            made.append((rows, [a.tolist() for _, a in ts.read_slots(out)], docs.rdd.getNumPartitions()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    assert made[0][:2] == made[1][:2] and made[0][2] < made[1][2]


def test_shards_again_are_the_same_and_empty_tables_have_none(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some words " * 300)], DOCS)
    a, b = (ts.write_shards(docs, str(tmp_path / k), length=16, per_shard=7).orderBy("slot").collect() for k in "ab")
    assert a == b and len(a) > 20
    assert ts.write_shards(docs, str(tmp_path / "a"), length=16, per_shard=7).count() == len(a)
    assert ts.write_shards(docs.limit(0), str(tmp_path / "c")).count() == 0
    assert list(ts.read_slots(str(tmp_path / "c"))) == []


def test_shards_of_rows_that_were_moved_after_reading(spark, tmp_path):
    """Shuffled, sorted, joined, or with two files by turns in one task: each sequence is full, and all ids are there."""
    rows = [(k, "moved text " * (k % 40)) for k in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "in"))
    read = spark.read.parquet(str(tmp_path / "in"))
    size = sum(r.n_ids for r in ts.write_shards(read, str(tmp_path / "straight"), length=64, per_shard=20).collect())
    ways = {"shuffled": read.repartition(3, "doc_id"), "sorted": read.orderBy("doc_id"), "joined": read.join(spark.range(400).withColumnRenamed("id", "doc_id").hint("shuffle_merge"), "doc_id"), "turns": read.repartition(1, "text").sortWithinPartitions("doc_id")}
    ids = {}
    for name, docs in ways.items():
        index = ts.write_shards(docs, str(tmp_path / name), length=64, per_shard=20).collect()
        assert sum(r.n_ids for r in index) == size and sum(r.n_ids < 64 for r in index) <= 1
        assert sorted(r.slot for r in index) == list(range(len(index))) == sorted(r.sequence for r in index)
        ids[name] = np.sort(np.concatenate([x for _, x in ts.read_slots(str(tmp_path / name))]))
    straight = np.sort(np.concatenate([x for _, x in ts.read_slots(str(tmp_path / "straight"))]))
    assert all((x == straight).all() for x in ids.values())


def test_a_record_that_is_not_covered_once_is_an_error():
    for pieces, fails in (([(0, 3), (3, 1)], False), ([(0, 3), (2, 2)], True), ([(0, 3)], True), ([(0, 4), (0, 4)], True)):
        shard = ts._Shard(0, 1, 4, "<u2", 0, 4)
        shard.pieces = [pieces]
        if fails:
            with pytest.raises(RuntimeError):
                shard.check()
        else:
            shard.check()


def test_words_with_marks_are_remembered_when_met_again(plain):
    enc, text = Encoder(vocabulary()), "x sharn, sharn"
    for held in ({"sharn"}, {"sharn", "sharn,"}):
        assert np.frombuffer(enc.ids(text), "<u4").tolist() == plain(text)
        assert set(enc._words) == held
