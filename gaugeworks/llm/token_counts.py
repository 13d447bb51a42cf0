"""Edit-aware token counts.

Each document has a segment tree over its pre-tokens: leaves are runs of pre-tokens
with their characters and tokens, inner nodes hold sums. An edit is found by
descending along the character sums; only the leaves that it touches are encoded
again, with a few characters of context, and the sums on their paths to the root are updated."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import values
from .tokens import Encoder, encoder, vocabulary

#: Pre-tokens in a new leaf. Characters around an edit that can change how their neighbours are split.
LEAF, CONTEXT = 64, 3

Edit = tuple[int, int, str]


class TokenTree:
    """Sums of characters and tokens over the leaves of one text."""

    def __init__(self, enc: Encoder, text: str, chars: list[int] | None = None, tokens: list[int] | None = None):
        """chars, tokens: the leaves of a stored tree of ``text``; without them all is encoded."""
        self.enc, self.encoded, self.context = enc, 0, CONTEXT + enc.reach
        if chars is None or tokens is None:
            chars, tokens = self._leaves(enc.pre_tokens(text))
        self.texts: list[str] = []
        at = 0
        for n in chars:
            self.texts.append(text[at : at + n])
            at += n
        self._build(chars, tokens)

    def _leaves(self, pieces: list[str]) -> tuple[list[int], list[int]]:
        self.encoded += len(pieces)
        count = self.enc.counts.__getitem__
        runs = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)]
        return [sum(map(len, r)) for r in runs], [sum(map(count, r)) for r in runs]

    def _build(self, chars: list[int], tokens: list[int]) -> None:
        self.size = 1
        while self.size < len(chars):
            self.size *= 2
        pad = [0] * (self.size - len(chars))
        self.chars, self.tokens = ([0] * self.size + x + pad for x in (chars, tokens))
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def text(self) -> str:
        return "".join(self.texts)

    def leaves(self) -> tuple[list[int], list[int]]:
        n = len(self.texts)
        return self.chars[self.size : self.size + n], self.tokens[self.size : self.size + n]

    def _find(self, at: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf that holds character ``at`` (the last one at the end)."""
        i, first = 1, 0
        at = min(at, self.n_chars - 1)
        while i < self.size:
            i *= 2
            if at - first >= self.chars[i]:
                first += self.chars[i]
                i += 1
        return i - self.size, first

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.texts[leaf] = text
        i = leaf + self.size
        self.chars[i], self.tokens[i] = len(text), tokens
        while i > 1:
            i //= 2
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def edit(self, at: int, removed: int, inserted: str) -> None:
        """Replace ``removed`` characters from ``at`` on by ``inserted``; places beyond the end count as the end."""
        at = max(0, min(at, self.n_chars))
        removed = max(0, min(removed, self.n_chars - at))
        if not self.texts or not self.n_chars:
            self.texts = [inserted]
            pieces = self.enc.pre_tokens(inserted)
            self.encoded += len(pieces)
            self._build([len(inserted)], [0])
            return self._split_up(0, pieces)
        a, first = self._find(max(0, at - self.context))
        b, _ = self._find(at + removed)
        old = "".join(self.texts[a : b + 1])
        region = old[: at - first] + inserted + old[at - first + removed :]
        while True:
            # What follows decides whether the region still ends where a pre-token does.
            nxt, after = b + 1, ""
            while nxt < len(self.texts) and len(after) < self.context:
                after += self.texts[nxt]
                nxt += 1
            pieces, end = [], 0
            for p in self.enc.pre_tokens(region + after):
                if end >= len(region):
                    break
                pieces.append(p)
                end += len(p)
            if end == len(region):
                break
            self.encoded += len(pieces)
            b += 1
            region += self.texts[b]
        self.encoded += len(pieces)
        self._set(a, region, sum(map(self.enc.counts.__getitem__, pieces)))
        for leaf in range(a + 1, b + 1):
            self._set(leaf, "", 0)
        if len(pieces) > 16 * LEAF:
            self._split_up(a, pieces)

    def _split_up(self, leaf: int, pieces: list[str]) -> None:
        """A leaf that grew large is cut anew into runs of its ``pieces``; empty leaves go."""
        chars, tokens = self.leaves()
        own, counts = self._leaves(pieces)
        self.encoded -= len(pieces)
        cut, at = [], 0
        for c in own:
            cut.append(self.texts[leaf][at : at + c])
            at += c
        rows = [*zip(self.texts, chars, tokens)]
        rows[leaf : leaf + 1] = [*zip(cut, own, counts)]
        rows = [r for r in rows if r[0]]
        self.texts = [r[0] for r in rows]
        self._build([r[1] for r in rows], [r[2] for r in rows])


#: What the cleaning edits mask: mail addresses, long hexadecimal strings, card-like numbers.
MASKS = ((re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"), "<mail>"), (re.compile(r"\b[0-9a-f]{24,}\b"), "<secret>"), (re.compile(r"\b\d{13,16}\b"), "<number>"))


def cleaning_edits(text: str) -> list[Edit]:
    """Edits that mask personal data, one after another; places are those of the text as it then is."""
    found: list[tuple[int, int, str]] = []
    if "@" in text:
        found += [(m.start(), m.end(), MASKS[0][1]) for m in MASKS[0][0].finditer(text)]
    for pattern, mask in MASKS[1:]:
        found += [(m.start(), m.end(), mask) for m in pattern.finditer(text)]
    out, moved, upto = [], 0, 0
    for a, b, mask in sorted(found):
        if a >= upto:
            out.append((a + moved, b - a, mask))
            moved += len(mask) - (b - a)
            upto = b
    return out


def count_tokens(
    docs: DataFrame, edits: Callable[[str], list[Edit]] | str | None = None, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, added: bool = False
) -> DataFrame:
    """One row per row of ``docs``: doc_id, tokens_before, n_edits, encoded (pre-tokens that the edits made encode),
    tokens, chars, leaf_chars, leaf_tokens (the tree, for later edits), and the edited text on request.

    edits: a function of the text, or the name of a column array<struct<at, removed, inserted>>, applied in order. Columns
    leaf_chars and leaf_tokens of ``docs``, where not null, are taken as the trees of its texts, so that only edits cost.
    added: as of Encoder, the same for a text and its stored tree. Null text: empty, zero tokens. Null edits: none. Null ids and repeated rows pass through."""
    stored = {"leaf_chars", "leaf_tokens"} <= set(docs.columns)
    cols = [F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")]
    cols += [F.col(c) if stored else F.lit(None).cast("array<int>").alias(c) for c in ("leaf_chars", "leaf_tokens")]
    listed = isinstance(edits, str)
    src = docs.select(*cols, *([F.col(edits).alias("edits")] if listed else []))
    ints, arrays = ["tokens_before", "n_edits", "encoded", "tokens", "chars"], ["leaf_chars", "leaf_tokens"]
    schema = T.StructType(
        [src.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ints), *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in arrays), *([T.StructField("text", T.StringType())] if with_text else [])]
    )
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, added)
        for batch in batches:
            rows, texts = [], []
            given = batch.column(4).to_pylist() if listed else [None] * batch.num_rows
            for text, chars, tokens, own in zip(*(values(batch.column(i)) for i in (1, 2, 3)), given):
                tree = TokenTree(enc, text, chars, tokens)
                before, tree.encoded = tree.n_tokens, 0
                todo = [(e["at"], e["removed"], e["inserted"] or "") for e in own or ()] if listed else edits(text) if edits else []
                for e in todo:
                    tree.edit(*e)
                rows.append((before, len(todo), tree.encoded, tree.n_tokens, tree.n_chars, *tree.leaves()))
                if with_text:
                    texts.append(tree.text)
            cols = list(zip(*rows)) if rows else [[]] * 7
            made = [*(pa.array(c, pa.int64()) for c in cols[:5]), *(pa.array(list(c), pa.list_(pa.int32())) for c in cols[5:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made, *([pa.array(texts, pa.string())] if with_text else [])], schema.names)

    return src.mapInArrow(run, schema)
