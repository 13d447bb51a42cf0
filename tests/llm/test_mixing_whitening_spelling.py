import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from gaugeworks.llm import mixing as mx
from gaugeworks.llm import queries as q
from gaugeworks.llm import spelling as sp
from gaugeworks.llm import whitening as wh

DOCS = "doc_id bigint, text string, source string, n int"


# mixing


def targets_by_hand(sizes):
    """By sharing and resharing, as the contract says it."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    goal, left, open_ = dict.fromkeys(names, Fraction(0)), Fraction(3, 2) * sum(sizes.values()), set(names)
    while left and open_:
        share = left / sum(weight[s] for s in open_)
        left = Fraction(0)
        for s in list(open_):
            goal[s] += share * weight[s]
            if goal[s] > 2 * sizes[s]:
                left += goal[s] - 2 * sizes[s]
                goal[s] = Fraction(2 * sizes[s])
                open_.discard(s)
    return goal


def mixed(spark, rows, parts=3, **how):
    return mx.mix_sources(spark.createDataFrame(rows, DOCS).repartition(parts), **how).collect()


def check_mix(rows, got, within=1):
    sizes = Counter()
    for _, text, source, _ in rows:
        sizes[source] += len((text or "").split())
    goal = targets_by_hand(sizes)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == sorted((d is None, d or 0, len((t or "").split())) for d, t, _, _ in rows)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(float(goal[r.source]))
        assert r.copies in (0, 1, 2) and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - float(goal[s])) <= within, s
    return taken


def test_mix_meets_its_targets_and_does_so_again(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(["w"] * rng.choice([1, 2, 3, 7, 30, 200])), f"s{min(rng.randint(0, 9), 7)}", 1) for k in range(3000)]
    rows += [(k, " \t x\x0b y\n", None, 2) for k in range(3000, 3300)] + [(None, "a b c", "s0", 0)] * 5 + [(7, None, "s1", 0), (8, "", "s1", None)]
    got = mixed(spark, rows)
    check_mix(rows, got)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.source or "", r.copies)
    again = mixed(spark, rows[::-1], parts=7)
    assert sorted(map(key, got)) == sorted(map(key, again))
    # Each length gives its share, not only the short ones.
    half = [r for r in got if 0 < r.target < 0.9 * r.source_size]
    for size in (3, 30, 200):
        own = [r for r in half if r.size == size]
        assert 0.3 < sum(r.copies for r in own) / len(own) / (half[0].target / half[0].source_size) < 1.7


def test_mix_of_a_hot_length_is_narrowed_to_the_same_choice(spark):
    rows = [(k, "five words are in here", "a", 0) for k in range(2000)] + [(k, "b c", "b", 0) for k in range(2000, 2400)] + [(-1, "five words are in here", "a", 0)] * 700
    plain, narrowed = mixed(spark, rows, ranked=10_000), mixed(spark, rows, ranked=5)
    assert check_mix(rows, plain, within=5) == check_mix(rows, narrowed, within=5)
    key = lambda r: (r.doc_id, r.copies)
    assert sorted(map(key, plain)) == sorted(map(key, narrowed))


def test_mix_of_odd_tables(spark):
    assert mixed(spark, [], parts=1) == []
    assert [(r.target, r.taken) for r in mixed(spark, [(1, None, "a", 0), (2, " ", None, 0)])] == [(0.0, 0)] * 2
    one = mixed(spark, [(1, "a b", "a", 0), (2, "c", "a", 0)])
    assert sum(r.taken for r in one) in (4, 5) and {r.target for r in one} == {4.5}
    extra = spark.createDataFrame([(1, "a b", "s", 5, 6, 7)], "doc_id long, text string, source string, size int, target int, row int")
    assert [(r.size, r.source_size, r.target) for r in mx.mix_sources(extra).collect()] == [(2, 2, 3.0)]


def test_nearest_sum_equals_brute_force():
    rng = random.Random(11)
    for _ in range(300):
        lengths = rng.sample(range(1, 25), rng.randint(1, 6))
        counts = [rng.randint(0, 4) for _ in lengths]
        budget = rng.randint(0, 60)
        sums = {0}
        for n, c in zip(lengths, counts):
            sums = {s + k * n for s in sums for k in range(c + 1)}
        taken = mx.nearest_sum(lengths, counts, budget, rng.randint(0, 99))
        assert all(0 <= t <= c for t, c in zip(taken, counts))
        assert abs(sum(t * n for t, n in zip(taken, lengths)) - budget) == min(abs(s - budget) for s in sums)


def test_spend_is_exact_where_short_documents_are_there():
    rng = random.Random(12)
    for _ in range(50):
        lengths = sorted({1, *(rng.randint(1, 3000) for _ in range(200))})
        counts = [rng.randint(1, 30) for _ in lengths]
        total = sum(n * c for n, c in zip(lengths, counts))
        budget = rng.randint(0, total)
        taken = mx.spend(lengths, counts, budget, 1)
        assert all(0 <= t <= c for t, c in zip(taken, counts)) and sum(t * n for t, n in zip(taken, lengths)) == budget


# whitening


def det_poly(m):
    """Faddeev-LeVerrier in exact numbers."""
    d, a, c = len(m), np.zeros((len(m), len(m)), dtype=object), [Fraction(1)]
    m, eye = np.array(m, dtype=object), np.array([[Fraction(i == j) for j in range(len(m))] for i in range(len(m))], dtype=object)
    for k in range(1, d + 1):
        a = m.dot(a) + c[-1] * eye
        c.append(-sum(m.dot(a)[i, i] for i in range(d)) / k)
    return [int(v) for v in c]


def test_characteristic_polynomial_is_exact(spark):
    rng = np.random.default_rng(3)
    for d, rank, top in ((1, 1, 9), (2, 2, 10**12), (6, 3, 1000), (9, 9, 10**9), (4, 0, 1)):
        x = rng.integers(-top, top, (rank, d)).astype(object)
        m = (x.T.dot(x) if rank else np.zeros((d, d), dtype=object)).tolist()
        assert wh.characteristic_polynomial(spark, m) == det_poly(m)


def test_roots_are_counted_and_isolated():
    poly = [1]
    roots = [0, 0, 3, 3, 7, 10**9, 10**9 + 1]
    for r in roots:
        poly = [a - r * b for a, b in zip([*poly, 0], [0, *poly])]
    for at in (0, 2, 3, 5, 7, 10**9, 10**10):
        assert wh.roots_above(poly, at, 0) == sum(r > at for r in roots)
    for k, (root, first, last) in {1: (10**9 + 1, 1, 1), 2: (10**9, 2, 2), 3: (7, 3, 3), 4: (3, 4, 5), 5: (3, 4, 5)}.items():
        found, *place = wh.isolate(poly, k, 2 * 10**9 + 20)
        assert abs(found - root) <= Fraction(root, 1 << 100) and place == [first, last]


def test_null_space_of_repeated_and_close_roots(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(-5, 5, (3, 3))
    block = (x.T @ x + 3 * np.eye(3, dtype=int)).tolist()
    twice = np.kron(np.eye(2, dtype=int), np.array(block)).astype(int).tolist()  # each eigenvalue twice
    found = wh.components(spark, twice, 6)
    v = np.array([r.vector for r in found])
    e = np.array([float(Fraction(r.root)) for r in found])
    assert np.abs(v @ v.T - np.eye(6)).max() < 1e-14 and np.abs(np.array(twice) @ v.T - v.T * e).max() < 1e-12 * e.max()
    close = [[10**15, 1, 0], [1, 10**15, 1], [0, 1, 10**15]]
    found = wh.components(spark, close, 3)
    want = np.array([[0.5, 2**-0.5, 0.5], [2**-0.5, 0, -(2**-0.5)], [-0.5, 2**-0.5, -0.5]])
    assert np.abs(np.abs(np.array([r.vector for r in found]) @ want.T) - np.eye(3)).max() < 1e-14


def check_white(got, vectors, ids, d):
    """Against integers and numpy's solver."""
    x = np.array([[int(np.floor(1024 * c)) + 100_000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(axis=0)
    far = ((n * x - s) ** 2).sum(axis=1)
    centred = ((n * x - s) / n).astype(float)
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    by = {}
    for r in got:
        by.setdefault(r.component, {})[r.vec_id] = r
        assert r.n == n and r.identity_error < 1e-6
    for k, rows in by.items():
        w = np.array([rows[i].whitened for i in ids])
        want = centred @ v[:, k - 1] / e[k - 1] ** 0.5
        assert np.abs(w - want * np.sign(w @ want)).max() < 1e-7
        assert np.allclose([rows[i].explained for i in ids], e[k - 1] / e.sum(), rtol=1e-9, atol=0)
        assert [int(rows[i].deviation) for i in ids] == far.tolist()
    return len(by)


def test_whitening_equals_brute_force_and_odd_vectors_go(spark):
    rng = np.random.default_rng(9)
    vectors = (rng.normal(size=(400, 12)) @ rng.normal(size=(12, 12))).astype(np.float32)
    vectors[100:240] = vectors[100]  # a third of all are alike
    rows = [(k, v.tolist(), "x") for k, v in enumerate(vectors)]
    odd = [(900, None, "a"), (901, [], "b"), (902, [None] * 12, "c"), (903, [float("nan")] * 12, ""), (904, [float("inf"), *[0.0] * 11], ""), (905, [1.0] * 5, "")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, whitened string").repartition(5)
    assert check_white(wh.whiten(df).collect(), vectors.astype(float), range(400), 12) == 8


def test_whitening_of_few_dimensions_long_entries_and_odd_tables(spark):
    kind = "vec_id long, embedding array<double>"
    rows = [(k, [float(k), 2.0 * k * k, -1.0]) for k in range(50)]
    assert check_white(wh.whiten(spark.createDataFrame(rows, kind)).collect(), [r[1] for r in rows], range(50), 3) == 2
    big = [(k, [float(k % 7) * 1e12, float(k % 5) * 1e11]) for k in range(60)]
    got = wh.whiten(spark.createDataFrame(big, kind)).collect()
    assert check_white(got, [r[1] for r in big], range(60), 2) == 2 and q.queries()["op12_whitening"]
    far = wh.whiten(spark.createDataFrame([(1, [1e300]), (2, [-1e300]), (None, [0.0])], kind)).collect()
    assert [r.deviation for r in far] == [None] * 3 or all(abs(r.whitened) < 2 for r in far)
    assert wh.whiten(spark.createDataFrame([(1, [2.0, 3.0])] * 3, kind)).collect() == []
    assert wh.whiten(spark.createDataFrame([(1, None)], kind)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_gram_is_exact_for_all_sizes():
    rng = np.random.default_rng(2)
    for top in (5, 1 << 19, 1 << 20, 1 << 45, (1 << 62) - 1):
        x = rng.integers(-top, top, (300, 4), endpoint=True)
        assert (wh.gram(x) == x.astype(object).T.dot(x.astype(object))).all()


# spelling


def apart(a, b):
    """Do they differ by just one edit?"""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants_by_hand(rows):
    n = Counter()
    for doc, text, *_ in rows:
        run = ""
        for ch in [*(text or ""), " "]:
            if ch.isascii() and ch.isalpha() or "À" <= ch <= "ÿ":
                run += ch.lower() if ch.isascii() else ch
            elif run:
                h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
                n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
                run = ""
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    near = {w: [v for v in n if apart(w, v)] for w in n}
    form = {w: min(own, key=lambda v: (-n[v], v)) for w, own in near.items() if own}
    form = {w: v for w, v in form.items() if n[v] >= 10 * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def spelled(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, word string, n int").repartition(3)
    got = [tuple(r) for r in sp.spelling_variants(df, **how).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("together", [sp.TOGETHER, 3])
def test_variants_equal_brute_force(spark, together):
    rng = random.Random(21)
    stems = ["".join(rng.choice("abÀÿx") for _ in range(rng.randint(6, 11))) for _ in range(40)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaab", "baaaaaa"]

    def word():
        w = rng.choice(stems[: rng.choice([3, 10, 44])])
        if rng.random() < 0.5:
            k, new = rng.randrange(len(w) + 1), rng.choice("abÀÿx×")
            w = rng.choice([w[:k] + new + w[k:], w[:k] + new + w[k + 1 :], w[:k] + w[k + 1 :]])
        return w.upper() if rng.random() < 0.1 and w.isascii() else w

    rows = [(k if k % 17 else None, " -1Ā".join(word() for _ in range(200)), "x", 1) for k in range(60)]
    rows += [(3, None, None, None), (4, "", "", 0), (5, "Zzzzzzzz" * 3000 + " " + "Zzzzzzzz" * 3000 + " " + ("zzzzzzzz" * 3000)[1:] + " x " + ("zzzzzzzz" * 3000)[1:], "", 0)]
    want = variants_by_hand(rows)
    assert spelled(spark, rows, together=together) == want
    assert sum(r[4] for r in want) > 1000 and any(r[1] not in (None, r[2]) for r in want) and any(len(r[0]) > 20_000 for r in want)


def test_no_words_no_rows(spark):
    assert spelled(spark, []) == set() == spelled(spark, [(1, "short words only, each once: elephantine", "", 0)])


def test_acceptor_is_minimal_and_its_pairs_are_complete():
    rng = random.Random(8)
    for _ in range(200):
        words = sorted({"".join(rng.choice("abc") for _ in range(rng.choice([4, 5]))) for _ in range(rng.randint(1, 60))})
        machine = sp.Acceptor()
        start = machine.add(words)
        ends = lambda p: frozenset(w[len(p) :] for w in words if w.startswith(p))
        branching = {e for e in {ends(w[:k]) for w in words for k in range(len(w) + 1)} if len({y[:1] for y in e}) > 1 or "" in e}
        assert len(machine.states) == len(branching | {ends("")})  # one state for each right language, but for those inside an edge
        pairs = [tuple(sorted((u, v))) for u, v, _ in machine.one_edit_apart(start)]
        assert len(pairs) == len(set(pairs)) and set(pairs) == {(a, b) for a in words for b in words if a < b and apart(a, b)}


def test_queries_have_their_columns(spark, sf_dir):
    kinds = {name: dict(q.queries()[name](spark, sf_dir).dtypes) for name in ("op11_mixing", "op12_whitening", "op13_spelling")}
    assert kinds["op11_mixing"] == {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"}
    assert kinds["op12_whitening"] == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    assert kinds["op13_spelling"] == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
