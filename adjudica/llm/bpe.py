"""Byte-level byte-pair vocabularies: cutting a text into words, and ids by the tokenizers library.

Byte-pair merges never cross a word of the vocabulary's own pattern, so a text's ids are those of
its words one after another. Web text repeats its words; each Python worker therefore keeps the ids
of words it has met, in two bounded tables: pieces between spaces, which need no pattern to find, and
below them the words of pieces that hold more than letters. A full table becomes the older one, which
is asked on a miss, and an empty one takes its place; that changes the time and nothing else.
"""

from __future__ import annotations

import functools
import os
import string
import struct
from collections.abc import Iterator

import regex

# The word pattern and the byte alphabet of byte-level vocabularies.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_alphabet() -> dict[int, str]:
    """Byte (as its Latin-1 character) to the character that stands for it in the vocabulary."""
    hidden = [b for b in range(256) if b not in _SHOWN]
    return {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_ALPHABET = byte_alphabet()
#: Pieces and words in a table; with the older ones about 200 and 30 MB.
MOST_PIECES, MOST_WORDS = 500_000, 75_000


class WordTable:
    """The value of each word of a text, for a value that a subclass gives to one word.

    ``special`` are strings that stand for themselves wherever they occur in a text.
    """

    def __init__(self, special: list[str]):
        self.find = regex.compile(WORD_PATTERN).findall
        self.special = special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.pieces, self.older_pieces = {}, {}
        self.words, self.older_words = {}, {}

    def value(self, word: str):
        raise NotImplementedError

    def special_value(self, text: str):
        raise NotImplementedError

    def total(self, values: list):
        raise NotImplementedError

    def _of_words(self, words: list[str]):
        values = []
        for word in words:
            value = self.words.get(word)
            if value is None:
                if len(self.words) >= MOST_WORDS:
                    self.words, self.older_words = {}, self.words
                value = self.older_words.get(word)
                if value is None:
                    value = self.value(word)
                self.words[word] = value
            values.append(value)
        return self.total(values)

    def _of_piece(self, piece: str):
        """A piece that is in no table: letters behind a space are one word, marks after them another."""
        if piece.isalpha():
            return self.value(" " + piece)
        letters = piece.rstrip(string.punctuation)
        if not letters.isalpha():
            return self._of_words(self.find(" " + piece))
        value = self.pieces.get(letters) or self.older_pieces.get(letters)
        if value is None:
            value = self.value(" " + letters)
        return self.total([value, self._of_words([piece[len(letters) :]])])

    def of_text(self, text: str):
        if self.cut and any(s in text for s in self.special):
            return self.total(
                [
                    self.special_value(part) if k % 2 else self._of_words(self.find(part))
                    for k, part in enumerate(self.cut.split(text))
                    if part
                ]
            )
        # A word holds a space only as its first character. A cut before each space is therefore a
        # cut between words, unless more white space follows that space.
        first, *rest = text.split(" ")
        values = [*map(self.pieces.get, rest)]
        if None in values:
            for k, value in enumerate(values):
                if value is None:
                    piece = rest[k]
                    if not piece or piece[0].isspace():
                        return self._of_words(self.find(text))
                    if len(self.pieces) >= MOST_PIECES:
                        self.pieces, self.older_pieces = {}, self.pieces
                    value = self.older_pieces.get(piece)
                    if value is None:
                        value = self._of_piece(piece)
                    values[k] = self.pieces[piece] = value
        return self.total([self._of_words(self.find(first)), *values])


class IdTable(WordTable):
    """Little-endian unsigned 32-bit ids of a text, each new word encoded by the library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.total = b"".join
        self.largest = max(self.library.get_vocab().values())
        self.packed = [struct.pack("<I", k) for k in range(self.largest + 1)]
        self.to_alphabet = str.maketrans({chr(b): c for b, c in _ALPHABET.items()})
        added = self.library.get_added_tokens_decoder()
        self.added = {token.content: struct.pack("<I", k) for k, token in added.items()}
        super().__init__(sorted(self.added))

    def value(self, word: str) -> bytes:
        if word[0] == " " and word.isascii() and word[1:].isalpha():
            shown = _ALPHABET[32] + word[1:]
        else:
            shown = word.encode().decode("latin-1").translate(self.to_alphabet)
        tokens = self.model.tokenize(shown)
        return b"".join([self.packed[token.id] for token in tokens])

    def special_value(self, text: str) -> bytes:
        return self.added[text]


@functools.lru_cache(maxsize=1)
def id_table(path: str) -> IdTable:
    """The worker's table; it lives as long as the worker."""
    return IdTable(path)


def largest_id(path: str) -> int:
    return id_table(path).largest


def encode_column(texts: list[str | None], path: str) -> Iterator[bytes]:
    """Ids of each text as bytes; null counts as empty."""
    table = id_table(path)
    return (table.of_text(text or "") for text in texts)
