"""Token ids of whole texts by a public tokenizer file, word by word with a memory of words seen.

White space separates the words of the tokenizer, so the ids of a text are those of its words one after the
other. Words that normalising could change beyond lower case go through the library as they are.
"""

from __future__ import annotations

import json
import struct
import unicodedata
from functools import lru_cache

import numpy as np
import regex
from tokenizers import Tokenizer

DEFAULT_FILE, END_ID = "word_bpe_49k.json", 2
# Words and pieces that a task remembers, some 200 bytes each.
WORDS_KEPT, PIECES_KEPT = 500_000, 300_000
_MARKS = frozenset(".,;:!?")
# The byte-level alphabet: printable bytes stand for themselves, the others in turn for the characters from 256 on.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_ALPHABET = dict(zip((b for b in range(256) if b not in _PRINTABLE), range(256, 512)))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_FILE)


@lru_cache(maxsize=1)
def _loaded(path: str):
    """Tokenizer of a file, the pattern of its pieces and its special tokens: read once by a worker, for all its tasks."""
    tokenizer = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        steps = json.load(f)["pre_tokenizer"]["pretokenizers"]
    pieces = regex.compile(next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split"))
    return tokenizer, pieces, [t.content for t in tokenizer.get_added_tokens_decoder().values()]


class WordEncoder(dict):
    """``encode(text)`` gives the ids as little-endian 32-bit numbers, without special tokens added.

    It is the memory of words seen: ids by word, worked out when first asked for.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer, self.pieces, self.special = _loaded(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.parts: dict[str, bytes] = {}

    def encode(self, text: bytes) -> bytes:
        if len(self) > WORDS_KEPT:
            self.clear()
        return b"".join(map(self.__getitem__, text.split()))

    def __missing__(self, word: bytes) -> bytes:
        found = self[word] = self.word(word.decode("utf-8", "replace"))
        return found

    def word(self, word: str) -> bytes:
        if not word.isascii() and ("İ" in word or "Σ" in word or not unicodedata.is_normalized("NFC", word)):
            return self.whole(word)
        # Most words are letters alone, or letters and one mark: each a piece by itself.
        if word.isalpha():
            return self.parts.get(lower := word.lower()) or self.part(lower)
        if word[-1] in _MARKS and word[:-1].isalpha():
            lower, mark = word[:-1].lower(), word[-1]
            return (self.parts.get(lower) or self.part(lower)) + (self.parts.get(mark) or self.part(mark))
        if "<" in word and any(s in word for s in self.special):
            return self.whole(word)
        return b"".join([self.parts.get(p) or self.part(p) for p in self.pieces.findall(word.lower())])

    def part(self, piece: str) -> bytes:
        if len(self.parts) > PIECES_KEPT:
            self.parts.clear()
        # Letters of ASCII stand for their own bytes.
        plain = piece.isascii() and piece.isalpha()
        mapped = piece if plain else piece.encode().decode("latin-1").translate(_ALPHABET)
        ids = [t.id for t in self.tokenize(mapped)]
        found = self.parts[piece] = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
