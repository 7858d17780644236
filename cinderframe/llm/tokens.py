"""Encoding whole texts with a public byte-level BPE file, fast enough for a corpus.

The pre-tokenizer of this family cuts a text into pieces that never join across the space before a
word, so a text is cut at its single spaces, each chunk is encoded once by the tokenizers library
and remembered (in a bounded cache), and a text's ids are the concatenation. Texts where white
space follows a space or the end, or that hold a special token's string, go to the library whole:
there a cut could fall inside a piece. For ids, a line feed between two characters that are no white
space is a piece of its own, so a text is cut before it too, and a line's first word is known with it.
"""

from __future__ import annotations

import json
import os
import re
import string
from array import array
from itertools import accumulate, chain

import numpy as np
import regex

from .common import held

TOKENIZER = "byte_bpe_50k.json"
#: Words and pieces that an encoder remembers, twice over.
WORDS_KEPT, PIECES_KEPT = 250_000, 60_000
#: Marks whose run at a word's end is a piece of its own after letters, and where letters of plain Latin scripts end.
MARKS, LATIN_END = string.punctuation.replace("'", ""), "\u0250"
#: The published pre-tokenization pattern of byte-level BPE, a fixed value.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_UNSAFE = re.compile(r" (?=\s|\Z)")
#: A line feed beside other white space or at either end of the text.
_LINES = re.compile(r"\n(?:(?=\s|\Z)|(?<!\S\n))")


def byte_alphabet() -> dict[int, int]:
    """Byte -> code point of byte-level BPE: printable bytes are themselves, the rest follow 255."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


class Recent:
    """Values by key, bounded: at ``most`` new ones the new become the old, and the old are dropped."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def find(self, key):
        """The value, or None; an old one that is asked for counts as new."""
        value = self.new.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.new[key] = value
        return value

    def keep(self, key, value) -> None:
        self.new[key] = value

    def trim(self) -> None:
        """Called between texts, so one text's words may go beyond the bound."""
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}


class ChunkEncoder:
    """ids and character spans of texts; ``dtype`` is the smallest unsigned type that holds an id."""

    def __init__(self, path: str, spans: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        self.spans, self.known, self.pieces = spans, Recent(WORDS_KEPT), Recent(PIECES_KEPT)
        self.model = self.tokenizer.model
        pre = json.loads(self.tokenizer.to_str())
        pre = {**(pre["pre_tokenizer"] or {}), "normalizer": pre["normalizer"]}
        self.byte_level = (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex"), pre["normalizer"]) == ("ByteLevel", False, True, None)
        self.pattern, self.alphabet, self.code = regex.compile(PIECES), byte_alphabet(), "H" if self.dtype.itemsize == 2 else "I"
        self.space, self.cuts_lines = chr(self.alphabet[32]), self.byte_level and not spans

    def _raw(self, texts: list[str]) -> list:
        """Packed ids, or packed spans, of each text by itself."""
        if self.spans:
            found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
            return [np.array(e.offsets, "<u4").reshape(-1, 2).tobytes() for e in found]
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in found]

    def _piece(self, piece: str):
        """A pre-tokenized piece by the library's model: packed ids, or the tokens' lengths."""
        if piece.isascii() and piece.isprintable():
            mapped = piece.replace(" ", self.space)
        else:
            mapped = piece.encode().decode("latin-1").translate(self.alphabet)
        found = self.model.tokenize(mapped)
        value = [len(t.value) for t in found] if self.spans else array(self.code, [t.id for t in found]).tobytes()
        self.pieces.keep(piece, value)
        return value

    def _plain(self, word: str) -> bool:
        """True if a word of Latin letters alone is one piece with the space before it."""
        return word.isalpha() and (word.isascii() or max(word) < LATIN_END)

    def _spaced(self, word: str) -> bytes:
        """As _chunk() for a word with the space before it, or the first of a line, kept among the known words.

        Letters alone are one piece, so they need no pattern; letters and a run of marks are two.
        """
        new = self.known.new
        value = new.get(word)  # a word that the text has more than once
        if value is not None:
            return value
        if self.spans or not self.byte_level:
            value = self._chunk(" " + word)
        elif word.isalpha() and (word.isascii() or max(word) < LATIN_END):
            value = self._letters(word)
        elif word[:1] == "\n" and self.cuts_lines:
            value = self._chunk(word)
        elif self._plain(letters := word.rstrip(MARKS)):
            value, marks = self.known.find(letters), word[len(letters) :]
            if value is None:
                value = new[letters] = self._letters(letters)
            value += self.pieces.find(marks) or self._piece(marks)
        else:
            value = self._chunk(" " + word)
        new[word] = value
        return value

    def _letters(self, word: str) -> bytes:
        mapped = word if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet)
        return array(self.code, [t.id for t in self.model.tokenize(self.space + mapped)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """As _raw() for one chunk: by the library's model, piece by piece, where that is the same."""
        if not self.byte_level or (self.spans and not chunk.isascii()):
            return self._raw([chunk])[0]
        pieces, find = self.pattern.findall(chunk), self.pieces.find
        if not self.spans:
            return b"".join([find(p) or self._piece(p) for p in pieces])
        at = [0, *accumulate(chain.from_iterable([find(p) or self._piece(p) for p in pieces]))]
        return array("I", chain.from_iterable(zip(at, at[1:]))).tobytes()

    def whole(self, text: str) -> bool:
        """True if the text has to be encoded in one piece."""
        return _UNSAFE.search(text) is not None or any(s in text for s in self.special)

    def encode(self, text: str) -> tuple[list[str] | None, list[bytes]]:
        """A text's words between single spaces (None: one piece) and each one's packed ids or spans.

        All but the first are encoded, and span, with the space before them. For ids a line feed also
        begins a word, which holds it.
        """
        if self.whole(text):
            return None, self._raw([text])
        self.known.trim()
        self.pieces.trim()
        if self.cuts_lines and _LINES.search(text) is None:
            text = text.replace("\n", " \n")
        words, new, old = text.split(" "), self.known.new, self.known.old.get
        packed = list(map(new.get, words))
        packed[0] = self._chunk(words[0])
        for at in [i for i, value in enumerate(packed) if value is None]:
            word = words[at]
            value = old(word)
            if value is None:
                value = self._spaced(word)
            else:
                new[word] = value
            packed[at] = value
        return words, packed

    def ids(self, text: str) -> bytes:
        """Packed ids of one text."""
        return b"".join(self.encode(text)[1])

    def offsets(self, text: str) -> np.ndarray:
        """Character spans (n, 2) of one text's tokens."""
        words, packed = self.encode(text)
        spans = np.frombuffer(b"".join(packed), "<u4").reshape(-1, 2).astype(np.int64)
        if words is not None:
            size = np.fromiter(map(len, words), np.int64, len(words)) + 1
            count = np.fromiter(map(len, packed), np.int64, len(packed)) // 8
            begin = np.maximum(np.cumsum(size) - size - 1, 0)
            spans = spans + np.repeat(begin, count)[:, None]
        return spans


def encoder(path: str, spans: bool = False) -> ChunkEncoder:
    """One encoder for each Python worker."""
    return held(("encoder", path, spans), lambda: ChunkEncoder(path, spans))


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
