import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import decontamination as dc
from gaugeworks.llm import license_scan as ls
from gaugeworks.llm import secret_scan as ss
from gaugeworks.llm import url_filter as uf
from gaugeworks.llm.common import word_hashes

from . import brute

DOCS = "doc_id bigint, text string"


# secrets


ODD_SECRETS = [
    None, "", "token: secret: abcdefgh", 'PASSWORD="hunter22x" api_key = short AKIA' + "Q" * 16, "ſecret=abcdefgh to\u212aen=abcdefgh", "secret=token=abcdef123",
    "a" * 23 + " " + "b" * 24 + " é" + "0123456789abcdef" * 3, "AKIAAKIA" + "0" * 12 + "AKIA", "apikey::=x passwd ' :  ' Zz.9=-/+_", "x" * 50_000 + ' token = "' + "ab12" * 10 + '"',
]


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(3)
    bits = ["token", "Secret", "API_KEY", "apikey", "password", "=", ":", " ", '"', "'", "abc123", "0123456789abcdef01234567", "AKIA", "ABCDEFGH12345678", "é", "\n", ".", "--"]
    rows = list(enumerate(ODD_SECRETS + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(400)]))
    got = ss.digest(ss.scan_secrets(spark.createDataFrame(rows, DOCS).withColumn("spans", F.lit(0)))).collect()
    texts = dict(rows)
    for r in got:
        base = brute.base_spans(texts[r.doc_id])
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), texts[r.doc_id]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for k, _, _ in base) for x in ("assign", "access", "hex"))
        assert [s for s in r.spans.split(",") if s and not s.startswith("named")] == ([x for x in listed.split(",") if x])
    assert len(got) == len(rows)


@pytest.mark.parametrize(
    "text, found",
    [
        ('dbPassword = "s3cr3t-Zq9x"', "s3cr3t-Zq9x"), ('K = "Zx81-qqLm-77Ab"\nauth_token = K\n', "Zx81-qqLm-77Ab"), ("export CLIENT_SECRET=Hq7zLp02xYt\n", "Hq7zLp02xYt"),
        ('{"private_key": "Lk93jd02mXq1"}', "Lk93jd02mXq1"), ('credentials := "aB3" + "9xQz77Lm0p"', "9xQz77Lm0p"), ("passphrase: Vt5kq-81xPz0\n", "Vt5kq-81xPz0"),
    ],
)
def test_named_literals(text, found):
    assert found in [text[a:b] for k, a, b, _, _ in ss.secret_spans(text) if k == "named"]


def test_named_literals_of_long_sums_and_over_line_ends():
    parts = [f"Zx{k:02d}-qqLm-77Ab" for k in range(40)]
    for text in ("auth_token = " + " + ".join(f'"{p}"' for p in parts), "private_key = " + " +\n  ".join(f'"{p}"' for p in parts), "private_key = (" + "\n  + ".join(f'"{p}"' for p in parts) + ")"):
        assert [text[a:b] for k, a, b, _, _ in ss.secret_spans(text) if k == "named"] == parts
    for text in ('{"private_key":\n  "Lk93jd02mXq1"}', 'credentials = \\\n  "Lk93jd02mXq1"', f'{{"{"x" * 90}_private_key": "Lk93jd02mXq1"}}'):
        assert "Lk93jd02mXq1" in [text[a:b] for k, a, b, _, _ in ss.secret_spans(text) if k == "named"]


@pytest.mark.parametrize(
    "text, found",
    [
        ('K = "Zx81-qqLm-77Ab"\nauth_token = (K)\n', ["Zx81-qqLm-77Ab"]), ('token = os.environ.get("T", "Zx81-qqLm-77Ab")', ["Zx81-qqLm-77Ab"]),
        ('api_key = decode(pad("Zx81-qqLm-77Ab"), \'b64\') + "qT9-x0Zp-11Vw"', ["Zx81-qqLm-77Ab", "qT9-x0Zp-11Vw"]), ("auth_token = load(open(path)", []),
        ("private_key: |\n  Lk93jd02mXq1\n\n  Vt5kq81xPz0Q\nother: x\n", ["Lk93jd02mXq1", "Vt5kq81xPz0Q"]), ("  signing_secret: >-\n      Lk93jd02mXq1zz\n  next: Vt5kq81xPz0Q\n", ["Lk93jd02mXq1zz"]),
        ("<db><password> Lk93jd02mXq1 </password></db>", ["Lk93jd02mXq1"]), ('<add key="ApiToken" value="Lk93jd02mXq1"/>', ["Lk93jd02mXq1"]),
        ('db_passphrase = "aB3x" + "9Qz7" + "Lm0p"', ["aB3x", "9Qz7", "Lm0p"]), ('a_secret = ("aB3x"\n  "tail")', []),
    ],
)
def test_named_literals_of_calls_blocks_and_markup(text, found):
    assert [text[a:b] for k, a, b, _, _ in ss.secret_spans(text) if k == "named"] == found


ROUND = 1 << 20


@pytest.mark.parametrize(
    "text, n",
    [
        ("<a>" + " " * ROUND + "<b></b>", 0), ("<a " + " " * ROUND + "<b x", 0), ("a = f(\n" * (ROUND // 7), 0), ("a = f(" * (ROUND // 6), 0), ('t = "x"\n' + 't = t + "Zx81-qqLm-77Ab"\n' * (ROUND // 25) + "auth_token = t\n", ROUND // 25),
        ("<a " + 'name="a" ' * (ROUND // 9), 0), ("a = f('x', " * (ROUND // 11) + ")" * (ROUND // 11), 0), ('token_x = """a' * (ROUND // 14), 0), ("secret = g(" * 9000 + '"Zx81-qqLm-77Ab"' + ")" * 9000, 1), ("a: |\n" * (ROUND // 5), 0),
        ("a = b = " * (ROUND // 8), 0), ('"' * ROUND, 0), ("a = " + "(" * ROUND, 0),
    ],
)
def test_the_lexer_is_linear(text, n):
    began = time.process_time()
    found = [s for s in ss.secret_spans(text) if s[0] == "named"]
    assert time.process_time() - began < 4 and len(found) == n


@pytest.mark.parametrize(
    "text, found",
    [
        ('API_KEY = """Zx81-qqLm-77Ab"""', ["Zx81-qqLm-77Ab"]), ("auth_token = '''\n  Zx81-qqLm-77Ab\n'''", ["Zx81-qqLm-77Ab"]), ('passphrase = """two words of text"""', []),
        ("it's auth_token = f('Zx81-qqLm-77Ab')", ["Zx81-qqLm-77Ab"]), ('auth_token = f(g("Zx81-qqLm-77Ab"), h(")"), "qT9-x0Zp-11Vw") + "Lk93jd02mXq1"', ["Zx81-qqLm-77Ab", "qT9-x0Zp-11Vw", "Lk93jd02mXq1"]),
        ('k = f("Zx81-qqLm-77Ab")\nsession_key = k + "tail"\nauth_token = session_key\n', ["Zx81-qqLm-77Ab"]), ('<add key="ApiToken" x="1" value="Lk93jd02mXq1" value="qT9-x0Zp-11Vw"/>', ["Lk93jd02mXq1"]),
        ("<password>\n Lk93jd02mXq1 \u00a0</password >", ["Lk93jd02mXq1"]), ('a = "Zx81-qqLm-77Ab"\nb = a\na = "other"\nauth_token = b', ["Zx81-qqLm-77Ab"]),
    ],
)
def test_named_literals_of_shared_sums(text, found):
    assert [text[a:b] for k, a, b, _, _ in ss.secret_spans(text) if k == "named"] == found


def test_named_literals_equal_those_that_were_written():
    """Random sources from a grammar, with what each assignment binds kept beside."""
    rng = random.Random(31)
    literal = lambda: "".join(rng.choice("ABCDEFGHJKMNPQRSTVWXYZabcdefghjkmnpqrstvwxyz23456789") for _ in range(rng.randint(16, 40)))
    for _ in range(300):
        text, want, constants = "", set(), {}
        for i in range(rng.randint(1, 12)):
            name = rng.choice(["db_password", "authToken", "title", "CONST", "note"]) + str(i)
            parts, own = [], set()
            for _ in range(rng.randint(1, 5)):
                if constants and rng.random() < 0.3:
                    used = rng.choice(sorted(constants))
                    parts.append(used)
                    own |= constants[used]
                else:
                    v = literal()
                    parts.append(rng.choice('"\'').join(["", v, ""]) if len(v) % 2 else f'"{v}"')
                    own.add(v)
            constants[name] = own
            form = rng.randrange(4)
            joint = rng.choice([" + ", "+", " +\n    "])
            text += [f"{name} = {joint.join(parts)}\n", f"{name}: ({joint.join(parts)})\n", f"export {name}={parts[0]}\n", f"{name} := f({', '.join(p for p in parts if p[0] in chr(34) + chr(39))})\n"][form]
            if form == 2:
                constants[name] = constants.get(parts[0], {parts[0][1:-1]})
            if form == 3:
                constants[name] = {p[1:-1] for p in parts if p[0] in "\"'"}
            if name.startswith(("db_password", "authToken")):
                want |= constants[name]
            constants = {k: v for k, v in constants.items() if v}
        got = {text[a:b] for k, a, b, _, _ in ss.secret_spans(text) if k == "named"}
        assert got == want, text


def test_secrets_odd_rows(spark):
    rows = [(None, 'auth_token = "Zx81-qqLm-77Ab"'), (1, None), (1, None), (2, ""), (3, "token=abcdefgh"), (3, "token=abcdefgh")]
    got = ss.digest(ss.scan_secrets(spark.createDataFrame(rows, DOCS).withColumns({"listed": F.lit(1), "n_hex": F.lit(2)}))).collect()
    assert sorted((str(r.doc_id), r.n_assign, r.n_named) for r in got) == [("1", 0, 0), ("1", 0, 0), ("2", 0, 0), ("3", 1, 1), ("3", 1, 1), ("None", 1, 1)]
    assert ss.digest(ss.scan_secrets(spark.createDataFrame([], DOCS))).count() == 0


@pytest.mark.parametrize("text", ["password: changeme", 'title = "A quiet evening"', "note: the token was lost", "key = 12", "time: 10:30", "Said he: nothing = all", 'token = "${TOKEN}"'])
def test_clean_text_has_no_named_literals(text):
    assert not [s for s in ss.secret_spans(text) if s[0] == "named"]


# licenses


def test_licenses_equal_brute_force(spark):
    rng = random.Random(4)
    filler = ["the", "of", "is", "license", "public", "gnu", "mit", "by", "cc", "general", "apache", "work", "a", "été", "x1"]
    notices = [' '.join(t.words) for t in ls.PHRASES + ls.NOTICES]
    texts = [None, "", "...", "MIT License", "mit\nlicense, CC-BY", "The GNU General Public\tLicense", "M\u212a lesser public li\u212aense", "license gnu " * 30_000 + "mit license"] + [t.text for t in ls.NOTICES]
    for _ in range(150):
        words = [rng.choice(filler) for _ in range(rng.randint(0, 120))]
        if rng.random() < 0.6:
            notice = rng.choice(notices).split()
            for _ in range(rng.choice([0, 1, len(notice) // 6, len(notice) // 4])):
                notice[rng.randrange(len(notice))] = "zzz"
            at = rng.randint(0, len(words))
            words[at:at] = notice
        texts.append(rng.choice([" ", ", ", "\n"]).join(words).upper() if rng.random() < 0.3 else " ".join(words))
    rows = list(enumerate(texts))
    got = ls.scan_licenses(spark.createDataFrame(rows, DOCS).withColumns({"row": F.lit(1), "words": F.lit(2), "label": F.lit(3)})).collect()
    assert len(got) == len(rows)
    for r in got:
        words, places, base = brute.phrase_places(texts[r.doc_id], [(t.label, t.text) for t in ls.PHRASES])
        best, labels = brute.template_labels(words, [(t.label, t.words, t.must, t.never) for t in ls.NOTICES], ls.CONTAINMENT)
        assert (r.n_words, r.n_base) == (len(words), len(places)), texts[r.doc_id]
        assert (r.first_word, r.last_word) == ((min(places), max(places)) if places else (None, None))
        assert (r.base_labels, r.labels) == (sorted(base), sorted(base | labels))
        assert r.score == pytest.approx(1.0 if base else best)


def test_whole_texts_have_their_own_label_alone(spark):
    rows = [(k, t.text) for k, t in enumerate(ls.NOTICES)]
    for r in ls.scan_licenses(spark.createDataFrame(rows, DOCS)).collect():
        assert set(r.labels) - set(r.base_labels) <= {ls.NOTICES[r.doc_id].label} and ls.NOTICES[r.doc_id].label in r.labels, (ls.NOTICES[r.doc_id], r.labels)
        assert r.score == 1.0


def test_licenses_null_ids_repeats_and_empty_table(spark):
    got = ls.scan_licenses(spark.createDataFrame([(None, "mit license"), (1, "mit license"), (1, "mit license")], DOCS)).collect()
    assert sorted((str(r.doc_id), r.n_base) for r in got) == [("1", 1), ("1", 1), ("None", 1)]
    assert ls.scan_licenses(spark.createDataFrame([], DOCS)).count() == 0


# URLs


def test_urls_equal_brute_force(spark):
    rng = random.Random(6)
    hosts = ["example.net", "a.example.net", "net", ".net", "notnet", "EXAMPLE.com", "x.example.com", "spam.org", "my-spam.org", "b.org", "örg.org", "example.net:80", ""]
    paths = ["", "/", "/en/", "/EN/", "/en/a", "/de/x.jpg", "/fr/", "/ads/x", "/a/ads/b", "/search", "/x?y=/en/", "#/en/", "?z", "/a.net/b", "/" + "y" * 3000, "/ü/*"]
    urls = [None, "", "no scheme", "://", "http://", "x://net/y://org/fr/"] + [f"{rng.choice(['http', 'HTTPS', ''])}://{h}{p}" for h in hosts for p in paths]
    rows = list(enumerate(urls))
    method = [brute.glob_regex(g) for g in uf.BLOCK_GLOBS]
    got = uf.filter_urls(spark.createDataFrame(rows, "page_id bigint, url string").withColumns({"host": F.lit(1), "verdict": F.lit(2)})).collect()
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute.url_verdict(urls[r.page_id], uf.HOST_RULES, lambda c: any(m.fullmatch(c) for m in method)), urls[r.page_id]
    assert len(got) == len(rows)
    assert uf.filter_urls(spark.createDataFrame([], "page_id bigint, url string")).count() == 0


def test_automaton_equals_regular_expressions():
    rng = random.Random(8)
    globs = ["", "*", "**", "a*b", "**a", "a**", "*/*", "**/x/**", "ab*cd**ef", "é*"] + ["".join(rng.choice("ab/*") for _ in range(rng.randint(1, 30))) for _ in range(60)]
    globs = [re.sub(r"\*{3,}", "**", g) for g in globs]
    texts = ["", "/", "é", "éa/b"] + ["".join(rng.choice("ab/") for _ in range(rng.randint(1, 14))) for _ in range(300)]
    machine = uf.Automaton(globs)
    assert machine.words > 1
    want = np.array([[bool(brute.glob_regex(g).fullmatch(t)) for g in globs] for t in texts])
    for long in (0, 5, 4096):
        assert (machine.match(texts, block=64, long=long) == want).all()


def test_urls_odd_rows(spark):
    long = "http://x.org/" + "a/" * 1_000_000 + "login"
    rows = [(None, "http://ads.org/"), (1, None), (1, None), (2, "http://b.org/fr/x"), (2, "http://b.org/fr/x"), (3, long), (4, "")]
    got = uf.filter_urls(spark.createDataFrame(rows, "page_id bigint, url string")).collect()
    assert sorted((str(r.page_id), r.verdict) for r in got) == [("1", "allow"), ("1", "allow"), ("2", "allow"), ("2", "allow"), ("3", "block"), ("4", "allow"), ("None", "block")]
    assert max(len(r.path) for r in got) == len(long) - len("http://x.org")


# decontamination


def words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n)]


def planted():
    rng = random.Random(9)
    items = [words(rng, n) for n in (60, 40, 25, 15, 12, 9, 5)] + [[], ["solo"]]
    docs, want = [], set()
    for k in range(240):
        text = words(rng, rng.choice([0, 5, 100, 400]))
        if k % 3 == 0:
            i = rng.randrange(7)
            own = list(items[i])
            for _ in range(len(own) // 12):  # substitutions: at most one word in twelve
                own[rng.randrange(len(own))] = "zz9"
            at = rng.randint(0, len(text))
            text[at:at] = own
            if len(items[i]) >= 12:
                want.add((k, i))
        joined = " ".join(text)
        docs.append((k, joined.upper() if k % 6 == 0 else joined.replace(" ", ", ", 3)))
    return docs, [(i, " ".join(x)) for i, x in enumerate(items)], want


def test_planted_passages_are_found_and_clean_documents_are_not(spark):
    docs, items, want = planted()
    d = spark.createDataFrame(docs + [(900, None), (901, "")], DOCS).withColumns({"item_id": F.lit(1), "seed": F.lit(2)})
    i = spark.createDataFrame(items + [(50, None)], "item_id bigint, text string")
    small, large = (dc.overlaps(d, i, send_up_to=n) for n in (10**6, 0))
    got = small.collect()
    assert {(r.doc_id, r.item_id) for r in got} >= want
    assert all(r.doc_id % 3 == 0 and r.item_id < 7 for r in got)
    key = lambda rows: sorted((r.doc_id, r.item_id, r.doc_word, r.item_word, r.n_words, r.n_agree) for r in rows)
    assert key(got) == key(large.collect())


def test_every_accepted_item_is_hit_whatever_words_are_substituted(spark):
    rng = random.Random(21)
    items = {n: words(rng, n) for n in range(4, 31)}
    docs = []
    for n, item in items.items():
        for _ in range(25):
            own = list(item)
            for at in rng.sample(range(1, n - 1), min(n // 5, n - 2)):
                own[at] = "zz9"
            docs.append((n, " ".join(words(rng, 7) + own + words(rng, 7))))
    d = spark.createDataFrame([(100 * n + k % 25, t) for k, (n, t) in enumerate(docs)], DOCS)
    i = spark.createDataFrame([(n, " ".join(x)) for n, x in items.items()], "item_id bigint, text string")
    hashed = {n: word_hashes([" ".join(x)])[0] for n, x in items.items()}
    want = set()
    for k, (_, text) in enumerate(docs):  # all diagonals of all items
        doc = word_hashes([text])[0]
        for n, own in hashed.items():
            found = [f for s in range(1 - n, len(doc)) if (f := dc.diagonal(doc, own, s, 0.8))]
            if any(f[1] >= min(n, max(10, 0.5 * n)) for f in found):
                want.add((100 * docs[k][0] + k % 25, n))
    assert len(want) >= len(docs)
    for send in (10**6, 0):
        assert {(r.doc_id, r.item_id) for r in dc.overlaps(d, i, send_up_to=send).collect()} == want


def test_passages_of_long_items_and_items_with_inserted_words_are_found(spark):
    rng = random.Random(23)
    items = [words(rng, n) for n in (59, 100, 30, 24, 100)]
    a, b, c, d, e = items
    parts = [a[10:38], b[20:69], c[:10] + ["zz1"] + c[10:20] + ["zz2"] + c[20:], d[:8] + ["zz1"] + d[8:16] + ["zz2"] + d[16:], e[40:52], c[:9] + words(rng, 30) + c[20:29]]
    docs = [(k, " ".join(words(rng, 50) + p + words(rng, 50))) for k, p in enumerate(parts)]
    i = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id bigint, text string")
    for send in (10**6, 0):
        got = dc.overlaps(spark.createDataFrame(docs, DOCS), i, send_up_to=send).collect()
        found = sorted((r.doc_id, r.item_id, r.doc_word, r.item_word, r.n_words, r.n_agree) for r in got)
        assert found == [(0, 0, 50, 10, 28, 28), (1, 1, 50, 20, 49, 49), (2, 2, 50, 0, 30, 30), (3, 3, 50, 0, 24, 24)]


def test_items_of_too_few_words_have_no_overlaps(spark):
    docs = spark.createDataFrame([(1, "one two three four five")], DOCS)
    items = spark.createDataFrame([(k, " ".join("one two three four five".split()[:k])) for k in range(6)], "item_id bigint, text string")
    for send in (10**6, 0):
        assert sorted(r.item_id for r in dc.overlaps(docs, items, send_up_to=send).collect()) == [4, 5]
        assert sorted(r.item_id for r in dc.overlaps(docs, items, least_item=0, send_up_to=send).collect()) == [1, 2, 3, 4, 5]


def test_very_long_texts_are_cut_between_words_and_searched_whole(spark):
    rng = random.Random(41)
    item, long = words(rng, 30), " ".join(words(rng, 20) * 90_000)
    assert len(long) > 4 * 4 * (1 << 20) // 2
    text = long + " " + " ".join(item) + " " + long[:1000]
    n = len(long.split())
    assert len(word_hashes([text])[0]) == len(text.split())
    got = dc.overlaps(spark.createDataFrame([(1, text)], DOCS), spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")).collect()
    assert [(r.doc_word, r.n_words) for r in got] == [(n, 30)]


def test_overlaps_of_empty_tables(spark):
    d, i = spark.createDataFrame([(1, "a b c")], DOCS), spark.createDataFrame([], "item_id bigint, text string")
    assert dc.overlaps(d, i).count() == 0
    assert dc.overlaps(d.limit(0), i).count() == 0
    assert dc.overlaps(d.limit(0), spark.createDataFrame([(1, "a b")], "item_id bigint, text string")).count() == 0


def test_repeated_items_and_string_ids(spark):
    rng = random.Random(12)
    a, b = (" ".join(words(rng, 30)) for _ in "ab")
    items = spark.createDataFrame([("x", a), ("x", b), ("x", a)], "item_id string, text string")
    docs = spark.createDataFrame([(1, "start " + a), (2, b + " end"), (None, b), (1, "start " + a)], DOCS)
    for send in (10**6, 0):
        got = sorted((str(r.doc_id), r.item_id, r.doc_word, r.n_words) for r in dc.overlaps(docs, items, send_up_to=send).collect())
        assert got == sorted([("1", "x", 1, 30)] * 4 + [("2", "x", 0, 30), ("None", "x", 0, 30)])


def test_diagonal_is_the_longest_stretch():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = rng.integers(1, 14)
        same = rng.integers(0, 2, n)
        item = np.arange(n)
        doc = np.where(same, item, -1)
        best = max((j - i + 1 for i in range(n) for j in range(i, n) if same[i] and same[j] and same[i : j + 1].sum() >= 0.8 * (j - i + 1) - 1e-9), default=0)
        got = dc.diagonal(doc, item, 0, 0.8)
        assert (got[1] if got else 0) == best


def test_word_hashes_tell_words_apart():
    rng = random.Random(2)
    texts = ["", "a b  a", "É é", "x" * 100 + " " + "x" * 101, "1a-a1"] + [" ".join(words(rng, 300)) for _ in range(20)]
    pattern = re.compile("[0-9a-z\x80-\U0010ffff]+")
    seen = {}
    for t, h in zip(texts, word_hashes(texts)):
        own = pattern.findall(t.lower())
        assert len(own) == len(h)
        for w, x in zip(own, h.tolist()):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_templates_of_one_word_are_met(spark):
    templates = [ls.Template("cc0", "cc0", True), ls.Template("é", "É-é")]
    rows = [(1, "this is cc0 text"), (2, "É é"), (3, "e"), (4, None)]
    got = {r.doc_id: (r.n_base, r.first_word, r.labels) for r in ls.scan_licenses(spark.createDataFrame(rows, DOCS), templates=templates).collect()}
    assert got == {1: (1, 2, ["cc0"]), 2: (0, None, ["é"]), 3: (0, None, []), 4: (0, None, [])}
