"""Public tokenizers, applied to pieces of text that repeat.

Byte-pair merges never cross the boundaries of the tokenizer's pre-split, so a
text's ids are the joined ids of pieces cut at such boundaries.  Natural text
repeats its words, so each worker keeps the ids of the pieces it has met (at
most ``LIMIT`` of them; then it forgets the younger half, since common pieces
are met early) and the library encodes new pieces only.  The cuts used here are
boundaries of the pre-split whatever stands around them; everything else stays
within a piece:

``byte``  before a space or newline that follows a non-space; between a run of
          Latin letters and the ASCII mark, space or newline after it; between
          a newline and a Latin letter.
``word``  the same, where the pre-split also drops white space and lowers case.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache
from itertools import islice

LIMIT = 500_000
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARK = r"[ \n!\"#$%&()*+,./:;<=>?@\[\]^_`{|}~-]"
_BYTE = re.compile(rf" ?[{_LETTERS}]+(?={_MARK}|\Z)|\n(?=[{_LETTERS}])|\s*\S+(?:[^\S \n]\s*\S*)*|\s+")
_WORD = re.compile(rf"[{_LETTERS}]+(?={_MARK}|\Z)|[^ \n]+")
_BEYOND_LATIN = re.compile(r"[^\x00-\xff]")


class PieceEncoder:
    """``encode(text)``: the ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, kind: str, limit: int = LIMIT) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True   # their strings are ordinary text
        self.kind, self.limit = kind, limit
        self.known = _Known(self.tokenizer, kind)
        self.vocabulary = self.tokenizer.get_vocab_size()

    def encode(self, text: str) -> bytes:
        if self.kind == "byte":
            pieces = _BYTE.findall(text)
        else:
            # within Latin-1 lowering is code point by code point, as the tokenizer does it
            pieces = _WORD.findall(text if _BEYOND_LATIN.search(text) else text.lower())
        if len(self.known) > self.limit:
            older = list(islice(self.known.items(), self.limit // 2))
            self.known.clear()
            self.known.update(older)
        return b"".join(map(self.known.__getitem__, pieces))


def byte_alphabet() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: visible
    Latin-1 ones for themselves, the rest in order from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in visible]
    return {b: chr(b if b in visible else 256 + rest.index(b)) for b in range(256)}


class _Known(dict):
    """A piece of letters is one word of the pre-split: it goes straight to the
    library's merge model.  Any other piece takes the whole way."""

    def __init__(self, tokenizer, kind: str) -> None:
        super().__init__()
        self._encode, self._merge = tokenizer.encode, tokenizer.model.tokenize
        self._letters = re.compile(rf" ?[{_LETTERS}]+" if kind == "byte" else "[a-zß-öø-ÿ]+").fullmatch
        self._alphabet = byte_alphabet()

    def __missing__(self, piece: str) -> bytes:
        if self._letters(piece):
            ids = [t.id for t in self._merge(piece.encode().decode("latin-1").translate(self._alphabet))]
        else:
            ids = self._encode(piece, add_special_tokens=False).ids
        self[piece] = data = array("I", ids).tobytes()
        return data


@lru_cache(maxsize=4)
def encoder(path: str, kind: str) -> PieceEncoder:
    """One per worker process and tokenizer file."""
    return PieceEncoder(path, kind)
