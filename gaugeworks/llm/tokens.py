"""Token ids of whole texts, with a bounded memory of words.

Byte-level pre-tokens never cross a space that is followed by something else than
white space: that space begins the next one. So a text falls into space-led
words that are encoded one by one, and most of which were met before."""

from __future__ import annotations

import re
from array import array

#: Words in each of the two generations that a worker remembers (some 200 bytes each).
REMEMBERED = 300_000
#: Marks that, alone or together, form one pre-token after a word.
_MARKS = ".,;:!?%$&#*|"
_CUT = re.compile(r"(?= \S)")


def _byte_letters() -> dict[int, int]:
    """Byte value to the letter that stands for it in a byte-level vocabulary: printable
    bytes for themselves, the others for the code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(others)}


class _OddSpacing(Exception):
    """A space is followed by white space: words alone don't show where pre-tokens end."""


class _Remembered(dict):
    """What ``make`` gives for a text, kept for texts of 40 characters at most. What it puts together from
    texts that were new here too is not kept until it is met again: those parts are.

    Two generations: when the young one is full it becomes the old one, and texts that are
    met again move on, so memory is bounded and frequent texts stay."""

    def __init__(self, make, room: int):
        self.make, self.room, self.old = make, room, {}

    def __missing__(self, text: str):
        found = self.old.get(text)
        if found is None:
            held = len(self)
            found = self.make(text)
            if len(self) != held:
                return found
        if len(text) <= 40:
            if len(self) >= self.room:
                self.old = dict(self)
                self.clear()
            self[text] = found
        return found


class Encoder:
    """Ids of texts by a byte-level BPE tokenizer file; ``path`` is that file's place.
    added: strings of the file's added tokens in a text give those tokens' ids, as by the library's
    default; else they are ordinary text. No token is added."""

    def __init__(self, path: str, remembered: int = REMEMBERED, added: bool = False):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self._model = whole.model
        self._model._resize_cache(0)  # words are remembered here, and those it is asked for are new to its own cache too
        tokens = whole.get_added_tokens_decoder() if added else {}
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in tokens.values()):
            raise ValueError("added tokens that take their surroundings are not supported")
        self._added = {t.content: array("I", [i]).tobytes() for i, t in tokens.items()}
        self._at_added = re.compile("(" + "|".join(map(re.escape, sorted(self._added, key=len, reverse=True))) + ")")
        #: Characters of the longest added token.
        self.reach = max(map(len, self._added), default=0)
        self._split = regex.compile(public_tokenizers.PATTERN)
        self._letters = _byte_letters()
        self._space = chr(self._letters[ord(" ")])
        #: Ids of a space and the word after it, and of pre-tokens as they stand.
        self._words = _Remembered(self._word, remembered)
        self._pieces = _Remembered(self.pre_token, max(1, remembered // 4))
        #: Tokens of each pre-token: ``counts[piece]``.
        self.counts = _Remembered(lambda piece: len(self.pre_token(piece)) // 4, remembered)

    def _parts(self, text: str) -> list[str]:
        """``text`` cut around its added tokens: these are at odd places."""
        return self._at_added.split(text) if any(t in text for t in self._added) else [text]

    def pre_tokens(self, text: str) -> list[str]:
        parts = self._parts(text)
        if len(parts) == 1:
            return self._split.findall(text)
        return [p for k, part in enumerate(parts) for p in ([part] if k % 2 else self._split.findall(part))]

    def pre_token(self, piece: str) -> bytes:
        if piece in self._added:
            return self._added[piece]
        return self._of(piece.encode("utf-8", "replace").decode("latin-1").translate(self._letters))

    def _of(self, letters: str) -> bytes:
        return array("I", [t.id for t in self._model.tokenize(letters)]).tobytes()

    def _word(self, word: str) -> bytes:
        if word.isalpha():
            return self._of(self._space + word) if word.isascii() else self.pre_token(" " + word)
        if not word or word[0].isspace():
            raise _OddSpacing
        stem = word.rstrip(_MARKS)
        if stem.isalpha():
            return self._words[stem] + self._pieces[word[len(stem) :]]
        return self.chunk(" " + word)

    def chunk(self, chunk: str) -> bytes:
        return b"".join([self._known(p) for p in self._split.findall(chunk)])

    def _known(self, piece: str) -> bytes:
        word = piece[1:]
        return self._words[word] if piece[0] == " " and word.isalpha() else self._pieces[piece]

    def ids(self, text: str) -> bytes:
        """The ids of ``text`` as unsigned 32-bit numbers, little-endian."""
        parts = self._parts(text)
        return b"".join([self._added[p] if k % 2 else self._plain_ids(p) for k, p in enumerate(parts)]) if len(parts) > 1 else self._plain_ids(text)

    def _plain_ids(self, text: str) -> bytes:
        words = text.split(" ")
        try:
            return self.chunk(words[0]) + b"".join(map(self._words.__getitem__, words[1:]))
        except _OddSpacing:
            return b"".join([self.chunk(c) for c in _CUT.split(text) if c])


_encoders: dict[tuple[str, bool, int], Encoder] = {}


def encoder(path: str, added: bool = False, remembered: int = REMEMBERED) -> Encoder:
    """The worker's own encoder for a file, kept between batches and tasks."""
    own = (path, added, remembered)
    if own not in _encoders:
        _encoders[own] = Encoder(path, remembered, added)
    return _encoders[own]


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
