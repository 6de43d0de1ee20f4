"""Token ids of whole texts from a public tokenizer file, word by word.

The tokenizer never looks across white space, so the ids of a text are those of its
words in order. Words repeat, so each worker remembers their ids; a word that is new
goes to the tokenizer's merge model directly when it is made of plain letters (where
normalising and splitting change nothing) and through the whole tokenizer otherwise.
"""

from __future__ import annotations

import os
import re

import numpy as np

REMEMBERED = 700_000
#: Texts are split into pieces of about so many bytes, so a huge text needs no huge lists.
SLICE = 1 << 20
#: Letters that normalising and splitting leave alone, then marks that form one piece of their own.
_PLAIN = re.compile(r"([a-zß-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)")
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _byte_alphabet() -> dict[int, str]:
    """Printable stand-ins for bytes in byte-level vocabularies (printable bytes stand for themselves)."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in own}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(own))
    return table


class WordTokenizer(dict):
    """Maps a word (bytes) to its number; ids of all words lie in one flat array."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.alphabet = _byte_alphabet()
        self._forget()

    def _forget(self) -> None:
        self.clear()
        self.marks: dict[str, list[int]] = {}
        self.flat = np.zeros(1 << 20, np.uint32)
        self.offsets = np.zeros(1 << 18, np.int64)
        self.used = 0

    def _ids(self, text: str) -> list[int]:
        plain = _PLAIN.fullmatch(text)
        if not plain or "<|" in text:
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        letters, marks = plain.groups()
        return (self._piece(letters) if letters else []) + (self._marks(marks) if marks else [])

    def _piece(self, piece: str) -> list[int]:
        if not piece.isascii():
            piece = "".join(map(self.alphabet.__getitem__, piece.encode()))
        return [t.id for t in self.model.tokenize(piece)]

    def _marks(self, marks: str) -> list[int]:
        if marks not in self.marks:
            if len(self.marks) > 10_000:
                self.marks.clear()
            self.marks[marks] = self._piece(marks)
        return self.marks[marks]

    def __missing__(self, word: bytes) -> int:
        ids = self._ids(word.decode("utf-8", "replace"))
        number, end = len(self), self.used + len(ids)
        while end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        if number + 2 > len(self.offsets):
            self.offsets = np.concatenate([self.offsets, np.zeros_like(self.offsets)])
        self.flat[self.used : end] = ids
        self.used = self.offsets[number + 1] = end
        self[word] = number
        return number

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each word has."""
        if len(self) > REMEMBERED:
            self._forget()
        number = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        starts = self.offsets[number]
        lengths = self.offsets[number + 1] - starts
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        places = np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
        return self.flat[places], lengths

    def encode_texts(self, texts: list[str | None]) -> list[np.ndarray]:
        """One uint32 array per text; null and empty texts have no ids."""
        words: list[bytes] = []
        counts: list[int] = []
        out: list[np.ndarray] = []
        size = 0

        def flush() -> None:
            nonlocal size
            ids, lengths = self.encode_words(words)
            token_ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum([0, *counts])]
            out.extend(ids[a:b] for a, b in zip(token_ends[:-1], token_ends[1:], strict=True))
            words.clear()
            counts.clear()
            size = 0

        for text in texts:
            raw = (text or "").encode("utf-8", "replace")
            raw = raw if b"<|" in raw else raw.lower()
            if len(raw) > SLICE:
                flush()
                out.append(self._encode_long(raw))
                continue
            own = raw.split()
            words += own
            counts.append(len(own))
            size += len(raw)
            if size > SLICE:
                flush()
        flush()
        return out

    def _encode_long(self, raw: bytes) -> np.ndarray:
        parts, start = [], 0
        while start < len(raw):
            cut = _SPACE.search(raw, start + SLICE)
            end = cut.start() if cut else len(raw)
            parts.append(self.encode_words(raw[start:end].split())[0])
            start = end
        return np.concatenate(parts)


_loaded: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One per worker process and file."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
