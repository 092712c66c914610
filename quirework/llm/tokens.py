"""Whole texts to token ids with a public vocabulary file, word by word.

In the vocabularies used here no token spans a space that follows a word, so a text's ids are those of its
space-separated pieces in a row.  Each worker keeps the ids of the pieces it has met (a bounded table), and gives plain
words to the library's model directly, which spares most of the work on natural text.  Texts with white space beside
a space go to the library whole, and so do pieces that are no plain words.
"""

import os
from array import array

import numpy as np

from .common import claim

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces whose ids a worker keeps (about 200 bytes each).
KEPT = 300_000
_ENCODERS = {}
#: Byte-level alphabet: printable bytes stand for themselves, the others follow from code point 256 on.
_PLAIN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
_ALPHABET = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PLAIN)}
_SPACE = chr(_ALPHABET[32])


class WordEncoder:
    """``spaced``: the vocabulary marks the space before a word (byte-level); else white space leaves no trace."""

    def __init__(self, path: str, spaced: bool):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model, self.normalizer = self.tok.model, self.tok.normalizer
        self.spaced, self.known = spaced, {}
        self.ends = {c: self.whole(c) for c in ".,"}

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _letters(self, word: str):
        """A word of letters as the model takes it, or None if the vocabulary's normalizer makes it more than that."""
        if not self.spaced:
            word = word.lower() if word.isascii() else self.normalizer.normalize_str(word)
        if word.isascii():
            return word
        return word.encode().decode("latin-1").translate(_ALPHABET) if word.isalpha() else None

    def _learn(self, pieces: set):
        """Ids of new pieces; a piece with a trailing space is the first of its text.  None: it can't be cut off there."""
        rest = {}
        for p in pieces:
            first = p[-1:] == " "
            word = p[:-1] if first else p
            end = self.ends.get(word[-1:], b"") if len(word) > 1 else b""
            core = word[:-1] if end else word
            form = self._letters(core) if core.isalpha() else None
            if form is not None:
                ids = self.model.tokenize(_SPACE + form if self.spaced and not first else form)
                self.known[p] = array("I", [t.id for t in ids]).tobytes() + end
            elif self.spaced and (not word or word[0].isspace() or word[-1].isspace()):
                self.known[p] = None
            else:
                rest[p] = " " + word if self.spaced and not first else word
        units = list(rest.values())
        for at in range(0, len(units), 5000):
            some = units[at:at + 5000]
            enc = self.tok.encode(some, is_pretokenized=True, add_special_tokens=False)
            flat = np.asarray(enc.ids, "<u4")
            cuts = np.searchsorted(np.asarray(enc.word_ids, np.int64), np.arange(len(some) + 1))
            for k, p in enumerate(list(rest)[at:at + 5000]):
                self.known[p] = flat[cuts[k]:cuts[k + 1]].tobytes()

    def encode(self, texts: list) -> list:
        """Little-endian unsigned 32-bit ids of each text, as bytes (null: empty)."""
        out, find = [], self.known.__getitem__
        for at in range(0, len(texts), 256):
            cut = []
            for text in texts[at:at + 256]:
                parts = text.split(" ") if text else []
                if parts:
                    parts[0] += " "
                cut.append(parts)
            new = set().union(*cut).difference(self.known)
            self._learn(new)
            for text, parts in zip(texts[at:at + 256], cut):
                try:
                    out.append(b"".join(map(find, parts)))
                except TypeError:
                    out.append(self.whole(text))
            if len(self.known) > KEPT:
                for p in new:
                    del self.known[p]
        return out


def encoder(path: str, spaced: bool) -> WordEncoder:
    """The worker's encoder for a vocabulary file."""
    claim("tokens", _ENCODERS)
    if (path, spaced) not in _ENCODERS:
        _ENCODERS[path, spaced] = WordEncoder(path, spaced)
    return _ENCODERS[path, spaced]
