"""Token ids of whole texts by the tokenizers library, with a bounded per-worker cache of words."""

from __future__ import annotations

import os
import re
from array import array
from codecs import charmap_decode

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: White space next to white space, or at an end: there a single space is no safe place to cut.
_UNSAFE = re.compile(r"\s\s|^\s|\s$")
_OTHER_SPACE = "\n\t\r\v\f\x1c\x1d\x1e\x1f"
#: A word, then ASCII punctuation (no apostrophe: contractions are units) up to its end.
_PUNCTUATED = re.compile(r"(.*[^\W\d_])([!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]+)", re.S)
_TWO_LINES = re.compile(r"(\S+)\n(\S+)")


def _unsafe(text: str) -> bool:
    if not text.isascii():
        return bool(_UNSAFE.search(text))
    return "  " in text or text[:1].isspace() or text[-1:].isspace() or any(c in text and (f"{c} " in text or f" {c}" in text) for c in _OTHER_SPACE)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Words(dict):
    """Word -> ids of ``before`` + word as little-endian unsigned 32-bit bytes; holds at most ``most`` words.

    A word that is not known is cut where units always end: between two lines, and between a
    letter and the punctuation that ends the word.
    """

    def __init__(self, encode, before: str, bare: _Words | None, most: int):
        super().__init__()
        self.encode, self.before, self.most = encode, before, most
        self.bare = self if bare is None else bare

    def __missing__(self, word: str) -> bytes:
        if word.isalpha():
            ids = self.encode(self.before, word)
        elif m := _TWO_LINES.fullmatch(word):
            return self[m[1]] + self.bare["\n"] + self.bare[m[2]]
        elif m := _PUNCTUATED.fullmatch(word):
            ids = self[m[1]] + self.bare[m[2]]
        else:
            ids = self.encode(self.before, word)
        if len(self) < self.most and len(word) < 64:
            self[word] = ids
        return ids


#: Letters whose lower and composed forms are the same to every library, so a word of them needs no normaliser.
_PLAIN = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_PROBES = ("the", "The", "UPPER", "x", "\u00e9tat", "\u00c9TAT", "Gr\u00f6\u00dfe", "unquestionablyzq", "\u00fc\u00df")


def _byte_letters() -> str:
    """The 256 letters that byte-level vocabularies write for bytes: printable ones as they are, the rest from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return "".join(chr(b if b in plain else next(rest)) for b in range(256))


class TextEncoder:
    """Encodes texts to ids (little-endian unsigned 32-bit bytes) exactly as the library does.

    A byte-level or word-level pre-tokenizer always starts a new unit at a single space between
    two characters that are not white space, so the text is cut there and the words' ids are
    kept. Texts with other white space around a cut go to the library whole. A word of plain letters
    is one unit and goes straight to the library's model, where probes show that this gives the
    ids of the whole chain.
    """

    def __init__(self, path: str, cache_words: int = 500_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self.tok.model
        self.byte_letters = _byte_letters()
        self.form = None
        for form in ((" ", False), ("", True), ("", False)):  # (space kept before a word, lower case)
            self.form = form
            if all(self.unit(" ", w) == self.whole(" " + w) and self.unit("", w) == self.whole(w) for w in _PROBES):
                break
            self.form = None
        self.bare = _Words(self.unit, "", None, cache_words // 8)
        self.words = _Words(self.unit, " ", self.bare, cache_words)

    def whole(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def unit(self, before: str, word: str) -> bytes:
        if self.form is None or not (word.isascii() and word.isalpha() or _PLAIN.fullmatch(word)):
            return self.whole(before + word)
        space, lower = self.form
        if before and space:
            word = space + word
        if lower:
            word = word.lower()
        if space or not word.isascii():
            word = charmap_decode(word.encode(), "strict", self.byte_letters)[0]
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def encode(self, text: str) -> bytes:
        if _unsafe(text):
            return self.whole(text)
        first, _, rest = text.partition(" ")
        return self.bare[first] + (b"".join(map(self.words.__getitem__, rest.split(" "))) if rest else b"")


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One encoder a worker process, so its cache outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]
