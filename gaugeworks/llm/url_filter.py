"""URL filters by a bit-parallel wildcard automaton.

All glob rules are packed side by side into masks of 64-bit words (Shift-And). One
step per byte of the canonical URLs moves every rule of every URL of a batch at
once: shift, and with the byte's mask, keep what a wildcard lets stay."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: (host, path, verdict): a rule holds for the host and all its subdomains.
HOST_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: Globs over host and path of pages that hold no text of use: `*` stays within host or
#: path segment, `**` runs over everything.
BLOCK_GLOBS = (
    "*spam**", "*casino**", "*adserver**", "ads.**", "track.**", "*.doubleclick.**",
    "**/ads/**", "**/adclick/**", "**/wp-login.php", "**/wp-admin/**", "**/cgi-bin/**", "**/login",
    "**/logout", "**/signup", "**/cart", "**/checkout/**", "**/search", "**.jpg", "**.png", "**.gif", "**.zip", "**.exe",
)
#: Bytes of a URL beyond which it is stepped over by itself.
LONG = 4096


def host_globs(host: str, path: str) -> tuple[str, str]:
    """The globs of a host and its subdomains, for paths that start with ``path``."""
    return f"{host}{path}**", f"*.{host}{path}**"


class Automaton:
    """Globs packed into Shift-And masks; every glob has to match from first to last byte."""

    def __init__(self, globs: Sequence[str]):
        self.globs = list(globs)
        steps: list[tuple[int, int]] = []  # (rule, byte) of each position
        loops: dict[int, str] = {}
        starts, ends, empty = [], [], []
        for rule, glob in enumerate(self.globs):
            # Position 0 of a rule is its start state: it lives before any byte is read.
            steps.append((rule, -1))
            starts.append(len(steps) - 1)
            raw, i = glob.encode("utf-8"), 0
            while i < len(raw):
                if raw[i : i + 1] == b"*":
                    wide = raw[i : i + 2] == b"**"
                    at = len(steps) - 1
                    loops[at] = "**" if wide or loops.get(at) == "**" else "*"
                    i += 1 + wide
                else:
                    steps.append((rule, raw[i]))
                    i += 1
            ends.append(len(steps) - 1)
        self.words = max(1, (len(steps) + 63) // 64)
        self.accept = np.zeros((len(self.globs), self.words), dtype=np.uint64)
        self.start = np.zeros(self.words, dtype=np.uint64)
        self.move = np.zeros((256, self.words), dtype=np.uint64)
        self.stay = np.zeros((256, self.words), dtype=np.uint64)
        for at, (_, byte) in enumerate(steps):
            if byte >= 0:
                self.move[byte, at // 64] |= np.uint64(1 << at % 64)
        for at in starts:
            self.start[at // 64] |= np.uint64(1 << at % 64)
        for rule, at in enumerate(ends):
            self.accept[rule, at // 64] |= np.uint64(1 << at % 64)
        for at, kind in loops.items():
            for byte in range(256):
                if kind == "**" or byte != ord("/"):
                    self.stay[byte, at // 64] |= np.uint64(1 << at % 64)

    def match_long(self, raw: bytes) -> np.ndarray:
        """Boolean (globs) for one text: the same steps on one integer of all the words, as a step over one text isn't worth an array."""
        whole = lambda words: int.from_bytes(words.astype("<u8").tobytes(), "little")
        move, stay, state = [whole(m) for m in self.move], [whole(m) for m in self.stay], whole(self.start)
        for byte in raw:
            state = (state << 1) & move[byte] | state & stay[byte]
            if not state:
                break
        return np.array([bool(state & whole(a)) for a in self.accept], dtype=bool)

    def match(self, texts: Sequence[str], block: int = 4096, long: int = LONG) -> np.ndarray:
        """Boolean (texts x globs)."""
        out = np.zeros((len(texts), len(self.globs)), dtype=bool)
        raws = [t.encode("utf-8", "replace") for t in texts]
        order = sorted((k for k in range(len(raws)) if len(raws[k]) <= long), key=lambda k: -len(raws[k]))
        for k, raw in enumerate(raws):
            if len(raw) > long:
                out[k] = self.match_long(raw)
        for s in range(0, len(order), block):
            at = np.array(order[s : s + block])
            size = np.array([len(raws[k]) for k in at])
            data = np.frombuffer(b"".join(raws[k] for k in at) + b"\0", dtype=np.uint8)
            first = np.concatenate([[0], np.cumsum(size)[:-1]])
            state = np.repeat(self.start[None, :], len(at), axis=0)
            for j in range(int(size[0])):
                n = int(np.searchsorted(-size, -j, side="left"))  # texts longer than j come first
                byte, now = data[first[:n] + j], state[:n]
                moved = now << np.uint64(1)
                moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
                state[:n] = (moved & self.move[byte]) | (now & self.stay[byte])
            out[at] = ((state[:, None, :] & self.accept[None]) != 0).any(2)
        return out


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): host after the first ``://`` up to ``/ ? #``, A-Z lower-cased; path on
    to ``? #``. Both empty without ``://`` or for null."""
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    for mark in "?#":
        rest = rest.split(mark, 1)[0]
    host, slash, path = rest.partition("/")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), slash + path


def filter_urls(
    pages: DataFrame, rules=HOST_RULES, block_globs: Sequence[str] = BLOCK_GLOBS, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, globs (those that matched).

    rules: (host, path, verdict); of those that fit, the longest decides (of equals, the first). Else a page is
    blocked if one of ``block_globs`` matches its canonical URL (host and path), and allowed if none does. Null
    or malformed URLs have an empty canonical URL and are allowed; null ids and
    repeated rows pass through; other columns don't matter; empty table: no rows. Long URLs are read whole."""
    rules, block_globs = list(rules), list(block_globs)
    wanted = [g for host, path, _ in rules for g in host_globs(host, path)] + block_globs
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    text = T.StringType()
    fields = [("host", text), ("path", text), ("rule", text), ("verdict", text), ("globs", T.ArrayType(text))]
    schema = T.StructType([src.schema["page_id"], *(T.StructField(n, t) for n, t in fields)])
    ranked = sorted(range(len(rules)), key=lambda k: (-len(rules[k][0] + rules[k][1]), k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton(wanted)
        for batch in batches:
            split = [split_url(u) for u in batch.column(1).to_pylist()]
            hit = machine.match([h + p for h, p in split])
            fits = hit[:, : 2 * len(rules) : 2] | hit[:, 1 : 2 * len(rules) : 2]
            rows = []
            for (host, path), fit, glob in zip(split, fits, hit[:, 2 * len(rules) :]):
                best = next((k for k in ranked if fit[k]), None)
                found = [g for g, x in zip(block_globs, glob) if x]
                rule, verdict = (None, "block" if found else "allow") if best is None else (rules[best][0] + rules[best][1], rules[best][2])
                rows.append((host, path, rule, verdict, found))
            cols = list(zip(*rows)) if rows else [[]] * 5
            types = [pa.string()] * 4 + [pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(cols, types))], schema.names)

    return src.mapInArrow(run, schema)
