"""Spelling variants by finite-state composition.

Two words are near if one edit leads from one to the other. Such pairs agree before and after the edit; so words are
dealt out by what two of them share when the edit lies in one range of places: for each range the part before and the part
behind it. The words of a task make one minimised acceptor, with an initial state for each shared part. Composing it with a
transducer of exactly one edit and with itself, and walking from each initial state, enumerates the pairs: the walk keeps one state until the edit, and
the states of both words behind it."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

LETTERS = r"[A-Za-zÀ-ÿ]"
LEAST, OFTEN, DROP_ONE_IN, TIMES = 7, 2, 31, 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words that share a part, up to which their pairs are enumerated in one task; beyond it the range of places is halved.
TOGETHER = 5000
#: States an acceptor may have before the next initial state starts a new one.
STATES = 200_000
SEND_UP_TO = 200_000


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of at least LEAST code points that occur OFTEN at least, after the dealt deletions. Null text: no
    words; null id: as an empty one."""
    text = F.translate(F.col(text_col), UPPER, LOWER)
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(text, F.lit(f"{LETTERS}{{{LEAST},}}"), F.lit(0))).alias("run")
    )
    at = F.pmod("h", F.length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    words = runs.withColumn("h", F.crc32(F.concat_ws(":", "doc", "run"))).select(F.when(F.col("h") % DROP_ONE_IN == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= LEAST).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)


class Acceptor:
    """A minimised acceptor: equal states are one. Runs of letters without a branch are one edge.

    A state is (final, ((letters, state), ...)), edges in order of their first letter."""

    def __init__(self):
        self.states: list[tuple] = []
        self.known: dict[tuple, int] = {}
        self.met: dict[tuple[int, int], list[str]] = {}

    def add(self, words: list[str]) -> int:
        """The initial state that accepts just ``words``, sorted and distinct."""
        return self._add(words, 0, len(words), 0)

    def _add(self, words: list[str], a: int, b: int, off: int) -> int:
        final = len(words[a]) == off
        edges, i = [], a + final
        while i < b:
            first, j = words[i][off], i + 1
            while j < b and words[j][off] == first:
                j += 1
            low, high, end = words[i], words[j - 1], off + 1
            while end < len(low) and end < len(high) and low[end] == high[end]:
                end += 1
            edges.append((low[off:end], self._add(words, i, j, end)))
            i = j
        state = (final, tuple(edges))
        at = self.known.get(state)
        if at is None:
            at = self.known[state] = len(self.states)
            self.states.append(state)
        return at

    def common(self, p: int, q: int) -> list[str]:
        """What both states accept."""
        key = (p, q) if p < q else (q, p)
        found = self.met.get(key)
        if found is None:
            (final_p, edges_p), (final_q, edges_q) = self.states[p], self.states[q]
            found = [""] if final_p and final_q else []
            if p == q:
                for letters, child in edges_p:
                    found += [letters + y for y in self.common(child, child)]
            else:
                others = {letters[0]: (letters, child) for letters, child in edges_q}
                for letters, child in edges_p:
                    if letters[0] in others:
                        found += self.along(letters, child, *others[letters[0]])
            self.met[key] = found
        return found

    def along(self, u: str, p: int, v: str, q: int) -> list[str]:
        """What both ``u`` followed by what p accepts and ``v`` followed by what q accepts."""
        if len(u) > len(v):
            u, p, v, q = v, q, u, p
        if not v.startswith(u):
            return []
        if len(u) == len(v):
            return [u + y for y in self.common(p, q)]
        if not u:
            # v goes on along an edge of p.
            return next((self.along(letters, child, v, q) for letters, child in self.states[p][1] if letters[0] == v[0]), [])
        return [u + y for y in self.along("", p, v[len(u) :], q)]

    def one_edit_apart(self, start: int) -> Iterator[tuple[str, str, int]]:
        """(u, v, at): pairs of accepted words that differ by one edit, at the place where they first differ; v is longer or as long, and then follows u."""
        walk = [("", start)]
        while walk:
            path, at = walk.pop()
            final, edges = self.states[at]
            for k, (letters, child) in enumerate(edges):
                walk.append((path + letters, child))
                rest = letters[1:]
                for other, target in edges[k + 1 :]:  # replaced
                    for y in self.along(rest, child, other[1:], target):
                        yield path + letters[0] + y, path + other[0] + y, len(path)
                # Inserted: the longer word goes over the edge's first letter, the shorter one stays and then goes another way, or ends.
                if final and not rest and self.states[child][0]:
                    yield path, path + letters[0], len(path)
                for j, (other, target) in enumerate(edges):
                    if j != k:
                        for y in self.along(rest, child, other, target):
                            yield path + y, path + letters[0] + y, len(path)


def _ranges(words: DataFrame, together: int) -> DataFrame:
    """(key, short, low, high, word, n): for pairs whose shorter word has ``short`` code points and whose edit is at a place from
    ``low`` to before ``high``, the words that can take part; key: a hash of all that these words share.

    Each word starts with two ranges, so pairs share half of a word at least. Where more than ``together`` words
    share a part, their range is halved; words that share all but one place are as many as there are letters at most."""
    short = F.explode(F.when(F.length("word") > LEAST, F.array(F.length("word"), F.length("word") - 1)).otherwise(F.array(F.length("word"))))
    halves = F.expr("array(struct(0 AS low, short div 2 AS high), struct(short div 2 AS low, short + 1 AS high))")
    key = F.xxhash64("short", "low", "high", F.col("word").substr(F.lit(1), F.col("low")), F.expr("right(word, greatest(short - high, 0))"))
    own = words.select("word", "n", short.alias("short")).select("*", F.explode(halves).alias("r")).select("short", "r.low", "r.high", "word", "n").withColumn("key", key)
    while True:
        many = own.groupBy("key").agg(F.count("*").alias("here"), F.max(F.col("high") - F.col("low")).alias("wide")).where((F.col("here") > together) & (F.col("wide") > 1))
        many = written(many.select("key"), "wide-ranges")
        n = many.count()
        if not n:
            return own
        side = many.withColumn("hot", F.lit(True))
        middle = "(low + high) div 2"
        cut = F.explode(F.expr(f"CASE WHEN hot AND high - low > 1 THEN array(struct(low, {middle} AS high), struct({middle} AS low, high)) ELSE array(struct(low, high)) END"))
        own = own.join(F.broadcast(side) if n <= SEND_UP_TO else side, "key", "left").select("short", "word", "n", cut.alias("r")).select("short", "r.low", "r.high", "word", "n").withColumn("key", key)


def near_pairs(words: DataFrame, together: int = TOGETHER) -> DataFrame:
    """(word, near, near_n): both directions of each pair of near words of ``words`` (word, n), once each."""
    # The groups lie one after another in each partition; words that share with no other go before they reach Python.
    whole = Window.partitionBy("key")
    own = _ranges(words, together).withColumn("here", F.count("*").over(whole)).where("here > 1").select("key", "short", "low", "high", "word", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(1_000_000)
        machine = Acceptor()

        def pairs(rows: list[tuple]) -> Iterator[tuple]:
            nonlocal machine
            by: dict[tuple, dict[str, int]] = {}  # one, but where keys clash
            for _, short, low, high, word, n in rows:
                behind = max(short - high, 0)
                part = (short, low, high, word[:low], word[len(word) - behind :])
                by.setdefault(part, {})[word[low : len(word) - behind]] = n
            for (short, low, high, before, after), counts in by.items():
                least = short - len(before) - len(after)
                if len(counts) < 2 or all(len(w) > least for w in counts):
                    continue
                if len(machine.states) > STATES:
                    machine = Acceptor()
                for u, v, at in machine.one_edit_apart(machine.add(sorted(counts))):
                    if len(u) == least and at < high - low:  # else of another range or another length's
                        yield before + u + after, before + v + after, counts[u], counts[v]

        def made(found: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*found)) if found else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["u", "v", "n_u", "n_v"])

        held, found = [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][0] != row[0]:
                    found += pairs(held)
                    held = []
                    if len(found) > 10_000:
                        yield made(found)
                        found = []
                held.append(row)
        if held:
            found += pairs(held)
        yield made(found)

    found = own.mapInArrow(run, "u string, v string, n_u long, n_v long")
    both = F.explode(F.expr("array(struct(u AS word, v AS near, n_v AS near_n), struct(v AS word, u AS near, n_u AS near_n))"))
    return found.select(both.alias("p")).select("p.*")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): from each word that has a form, the last one of its forms. Steps are doubled each round; n grows tenfold a step, so a
    chain of s steps needs n of 10^s, and rounds are few."""
    links = forms.where("form is not null").select("word", F.col("form").alias("root"))
    links = written(links, "links")
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(links.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "links")
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        links = moved.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", together: int = TOGETHER) -> DataFrame:
    """One row per word of the vocabulary: word, form, root, n, n_near, form_n.

    form: of the words one edit away the one that occurs most (ties: the smallest by code point), if TIMES as often as the word; form_n: its
    n. root: where forms lead in the end, the word itself if it has none. n_near: words one edit away. Null texts have no words, null ids count as
    empty ones in the dealt deletions; repeated rows count again; other columns don't matter; empty table: no rows.
    together: words that share a part, up to which one task takes them together."""
    words = written(vocabulary(docs, id_col, text_col), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), "near"))
    found = near_pairs(words, together).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    strong = -F.col("best.n") >= TIMES * F.col("n")
    forms = words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.n")).alias("form_n")
    )
    forms = written(forms, "forms")
    return forms.join(_roots(forms), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
