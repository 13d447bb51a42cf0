"""Secret scans by assignment-aware lexing.

A small lexer reads the assignment syntax of source code and configuration files
(`name = literal`, `name: literal`, `"name": "literal"`, `export NAME=literal`, sums of
literals and names, in parentheses or over line ends, literals in a call's arguments, YAML
blocks, XML elements and attributes) into name-literal pairs. Names that were bound to a literal are
propagated to later assignments, and a literal is scored by how sensitive the names are
that it reaches and by how random it looks, by itself or joined with the rest of its sum."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_and_text, values

#: The patterns of the base kinds and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
#: Runs of hex digits that can be long enough, found without looking at the short ones.
_HEX_LONG = re.compile(rf"[0-9a-f]{{{LEAST_HEX},}}")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "named")

#: How sensitive the parts of a target's name are.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9,
    "credentials": 0.9, "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "auth": 0.7, "bearer": 0.8, "authorization": 0.8, "signature": 0.6, "salt": 0.6, "private": 0.5, "key": 0.5, "cookie": 0.5, "session": 0.4,
}
#: Values that stand where a secret will be put.
PLACEHOLDERS = re.compile(r"(?i)^(?:x+|\*+|\.+|none|null|nil|true|false|undefined|changeme|example\w*|your[\w-]*|todo|test\w*|dummy\w*|placeholder|redacted|[\$<{%].*)$")

#: A name, quoted or not, and the sign that binds it. The sign is no comparison, and no part of a URL.
_TARGET = re.compile(r"""(?:(?<![\w$.-])([A-Za-z_$][\w$]*(?:[.-][A-Za-z_$][\w$]*)*)|["']([\w$. -]+)["'])\x20*(?::=|=>|->|=(?!=)|:(?!//))""")
#: A literal in triple quotes counts where it is one word.
_TERM = re.compile(r"""[\x20\t]*(?:\"{3}\s*+((?:(?!\"{3})\S)++)\s*+\"{3}|'{3}\s*+((?:(?!'{3})\S)++)\s*+'{3}|"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`|([^\s"'`,;(){}\[\]+<>]+))""")
#: What may lie between a sign and a quoted literal besides space: a bracket, or the end of a line.
_OPEN = re.compile(r"""[\x20\t]*(?:\((?:\s*\()*\s*(?=["'`\w$])|\\?\r?\n\s*(?:\(\s*)?(?=["'`]))""")
#: A plus sign of a sum, at the end of a line or indented at the start of one too, and the line's end after it.
_PLUS = re.compile(r"[\x20\t]*(?:\\?\r?\n[\x20\t]+)?\+(?!=)(?:[\x20\t]*\\?\r?\n)?")
#: A quoted literal, and the parentheses around a call's arguments.
_QUOTED = re.compile(r"""["]((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`|([()])""")
#: The sign of a YAML block, and a line of it. An XML element with text, and a tag that names a value in its attributes.
_BLOCK = re.compile(r"[\x20\t]*[|>][0-9+-]*[\x20\t]*\r?\n")
_BLOCK_LINE = re.compile(r"([\x20\t]*)([^\r\n]*)\r?\n?")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*+)(?:\s[^<>]*+)?+>([^<>]*+)</\1\s*+>")
_TAG = re.compile(r"<[^<>]*+")
_ATTRIBUTE = re.compile(r"""\b(key|name|value)\s*+=\s*+["']([^"'<>]*+)["']""")
_BOUND = re.compile(r"[\x20\t]*(?::=|=|:)")
_NAME_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def sensitivity(name: str) -> float:
    """0 to 1, by the words of ``name`` and their adjacent pairs (`dbPassword`, `API_KEY`)."""
    parts = [p.lower() for p in _NAME_PARTS.findall(name)]
    return max((SENSITIVE.get(x, 0.0) for x in [*parts, *(a + b for a, b in zip(parts, parts[1:]))]), default=0.0)


def randomness(value: str) -> float:
    """0 to 1: bits a character over those of random base-64 text of the length, less for short values."""
    return _spread(len(value), Counter(value))


def _spread(n: int, counts: Counter) -> float:
    if n < 6:
        return 0.0
    bits = -sum(c / n * math.log2(c / n) for c in counts.values())
    return min(1.0, bits / math.log2(min(n, 64))) * min(1.0, n / 12)


class Sum:
    """What a name is bound to: literals (value, start, end), the sums of the names among its terms, and calls. Sums share what they have
    in common, so a name that grows by a literal a line costs one step a line. reach: the most sensitive name it reaches, with how
    sensitive it is; whole: the same, times the randomness of all that name's literals joined."""

    __slots__ = ("items", "tally", "reach", "whole")

    def __init__(self):
        self.items: list = []
        self.tally = None
        self.reach = self.whole = (0.0, "")

    def hand_down(self, other: Sum | Call) -> None:
        other.reach = max(other.reach, self.reach, key=_first)
        if isinstance(other, Sum):
            other.whole = max(other.whole, self.whole, key=_first)


class Call:
    """The quoted arguments of a call (value, start, end), and the calls among them. They don't add to a sum."""

    __slots__ = ("items", "n", "reach")

    def __init__(self):
        self.items: list = []
        self.n = 0
        self.reach = (0.0, "")


def _first(pair: tuple[float, str]) -> float:
    return pair[0]


#: Of literals that are joined: how many characters, how many literals, whether there is a blank, and how often each character is there, told apart by its last eight bits.
Tally = tuple[int, int, bool, Counter]


def _joined(tallies: list[str | Tally]) -> str | Tally | None:
    """The tally of several; of one literal it is the literal, until it is joined."""
    if len(tallies) < 2:
        return tallies[0] if tallies else None
    n, parts, blank, counts = 0, 0, False, Counter()
    for t in tallies:
        own = (len(t), 1, " " in t, Counter(ord(c) & 255 for c in t)) if isinstance(t, str) else t
        n, parts, blank = n + own[0], parts + own[1], blank or own[2]
        counts.update(own[3])
    return n, parts, blank, counts


class Calls:
    """The calls of a text by where their parentheses open. Quoted literals don't run over line ends, so one pass tells the brackets of all
    lines; what a quote before it on its line hides is read by itself to the line's end."""

    def __init__(self, text: str):
        self.text = text
        self.at: dict[int, tuple[Call, int] | None] | None = None
        self.all: list[Call] = []

    def closed(self, at: int) -> tuple[Call, int] | None:
        """The call whose parenthesis opens at ``at``, and where it ends; none if it is never closed."""
        if self.at is None:
            self.at = {}
            self._read(0, len(self.text))
        if at not in self.at:
            end = self.text.find("\n", at)
            self._read(at, len(self.text) if end < 0 else end)
        return self.at[at]

    def _read(self, first: int, last: int) -> None:
        open_: list[tuple[int, Call]] = []
        for m in _QUOTED.finditer(self.text, first, last):
            if m.lastindex < 4:
                if open_ and m.group(m.lastindex):
                    open_[-1][1].items.append((m.group(m.lastindex), *m.span(m.lastindex)))
                    open_[-1][1].n += 1
            elif m.group(4) == "(":
                open_.append((m.start(), Call()))
                self.all.append(open_[-1][1])
            elif open_:
                at, call = open_.pop()
                self.at.setdefault(at, (call, m.end()))
                if open_ and call.n:
                    open_[-1][1].items.append(call)
                    open_[-1][1].n += call.n
        for at, _ in open_:
            self.at.setdefault(at, None)


def named_literals(text: str) -> Iterator[tuple[int, int, float, str]]:
    """(start, end, score, name) of the literals that assignments in ``text`` bind to names, constants propagated; name: the one that
    scores the literal highest. Each line, bracket and link between sums is gone over once."""
    known: dict[str, Sum] = {}
    sums, calls = [], Calls(text)
    for first, last in _lines(text):
        for m in _TARGET.finditer(text, first, last):
            terms = _terms(text, m.end(), len(text), calls) or _block(text, first, m.end())
            own, tallies = Sum(), []
            for term in terms:
                if isinstance(term, tuple) and term[3] == "name" and term[0] in known:
                    term = known[term[0]]
                if isinstance(term, tuple):
                    if term[2] > term[1]:
                        own.items.append(term[:3])
                        tallies.append(term[0])
                elif isinstance(term, Sum) or term.n:
                    own.items.append(term)
                    if isinstance(term, Sum) and term.tally is not None:
                        tallies.append(term.tally)
            if not own.items:
                continue
            name = m.group(1) or m.group(2)
            own.tally, s = _joined(tallies), sensitivity(name)
            own.reach = (s, name)
            if s and isinstance(own.tally, tuple) and not own.tally[2]:
                own.whole = (s * _spread(own.tally[0], own.tally[3]), name)
            known[name] = own
            sums.append(own)
    for own in reversed(sums):  # a sum's terms came before it
        for item in own.items:
            if isinstance(item, tuple):
                yield from _scored(item, own.reach, own.whole)
            else:
                own.hand_down(item)
    for call in calls.all:  # a call comes before those among its arguments
        for item in call.items:
            if isinstance(item, tuple):
                yield from _scored(item, call.reach, (0.0, ""))
            else:
                item.reach = max(item.reach, call.reach, key=_first)
    if "<" in text:
        for m in _ELEMENT.finditer(text):
            yield from _scored(_bare(m.group(2), m.start(2)), (sensitivity(m.group(1)), m.group(1)), (0.0, ""))
        for tag in _TAG.finditer(text):
            name = None
            for m in _ATTRIBUTE.finditer(text, *tag.span()):
                if m.group(1) != "value":
                    name = name or m.group(2)
                elif name is not None:
                    yield from _scored((m.group(2), *m.span(2)), (sensitivity(name), name), (0.0, ""))
                    break


def _bare(value: str, at: int) -> tuple[str, int, int]:
    at += len(value) - len(value.lstrip())
    return value.strip(), at, at + len(value.strip())


def _scored(literal: tuple[str, int, int], reach: tuple[float, str], whole: tuple[float, str]) -> Iterator[tuple[int, int, float, str]]:
    value, a, b = literal
    if reach[0] and b > a and " " not in value and not PLACEHOLDERS.match(value):
        alone = reach[0] * randomness(value), reach[1]
        yield a, b, *max(alone, whole, key=_first)


def _terms(text: str, at: int, last: int, calls: Calls) -> list:
    """The terms of a sum that begins at ``at``: (value, start, end, literal or name), or a call."""
    out: list = []
    if o := _OPEN.match(text, at, last):
        at = o.end()
    while m := _TERM.match(text, at, last):
        kind = m.lastindex
        if kind < 6 and _BOUND.match(text, m.end(), last):
            break  # a quoted name on the next line
        if kind == 6 and (_BOUND.match(text, m.end(), last) or m.group(6)[0] in "|>" and _BLOCK.match(text, at, last)):
            break  # what stands here is the next assignment's name, or opens a block
        at = m.end()
        if kind == 6 and text[at : at + 1] == "(":
            found = calls.closed(at)
            at = found[1] if found else at + 1
            if found:
                out.append(found[0])
        else:
            out.append((m.group(kind), *m.span(kind), "literal" if kind < 6 else "name"))
        plus = _PLUS.match(text, at, last)
        if not plus:
            break
        at = plus.end()
    return out


def _block(text: str, line: int, at: int) -> list[tuple]:
    """The lines of a YAML block that a sign ending at ``at`` opens: those that are indented deeper than the sign's line."""
    opened = _BLOCK.match(text, at)
    if not opened:
        return []
    own, out, at = len(_BLOCK_LINE.match(text, line).group(1)), [], opened.end()
    while at < len(text):
        m = _BLOCK_LINE.match(text, at)
        if m.group(2) and len(m.group(1)) <= own:
            break
        if m.group(2):
            value = m.group(2).rstrip()
            out.append((value, m.start(2), m.start(2) + len(value), "literal"))
        at = m.end()
    return out


def _lines(text: str) -> Iterator[tuple[int, int]]:
    """Where the lines lie that hold a sign."""
    at = 0
    for line in text.split("\n"):
        if "=" in line or ":" in line:
            yield at, at + len(line)
        at += len(line) + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base kinds: leftmost matches of each, without overlap within a kind."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [("hex", m.start(), m.end()) for m in _HEX_LONG.finditer(text)]
    return out


def secret_spans(text: str, least: float = 0.45) -> list[tuple[str, int, int, float, str | None]]:
    """(kind, start, end, score, name), by start, then kind: the base spans, and literals
    of the kind `named` whose score (sensitivity times randomness, of the literal or of its whole sum) is ``least`` or more."""
    out = [(k, a, b, 1.0, None) for k, a, b in base_spans(text)]
    if "=" in text or ":" in text or "</" in text:
        best: dict[tuple[int, int], tuple[float, str]] = {}
        for a, b, s, name in named_literals(text):
            if s >= least and s > best.get((a, b), (0.0, ""))[0]:
                best[a, b] = (s, name)
        out += [("named", a, b, s, name) for (a, b), (s, name) in best.items()]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def listed(spans) -> str:
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans)


def scan_secrets(docs: DataFrame, least: float = 0.45, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id and spans, an array of (kind, start, end, score, name) by start, then
    kind; start and end count code points, the end is exclusive.

    Null or empty text: no spans. Null ids and repeated rows pass through; other columns don't matter; empty table: no rows.
    A text is read whole, once for each pattern; the lexer's work grows with the text."""
    docs = id_and_text(docs, id_col, text_col)
    span = T.StructType(
        [T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("name", T.StringType())]
    )
    schema = T.StructType([docs.schema["doc_id"], T.StructField("spans", T.ArrayType(span)), T.StructField("base_sha256", T.StringType()), T.StructField("listed", T.StringType())])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("name", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [secret_spans(t, least) for t in values(batch.column(1))]
            names = ("kind", "start", "end", "score", "name")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([[dict(zip(names, s)) for s in x] for x in found], arrow),
                    pa.array([hashlib.sha256(listed(s for s in x if s[0] != "named").encode()).hexdigest() for x in found], pa.string()),
                    pa.array([listed(x) for x in found], pa.string()),
                ],
                schema.names,
            )

    return docs.mapInArrow(run, schema)


def digest(spans: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans and the list of all spans."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return spans.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), "base_sha256", F.col("listed").alias("spans"))
