"""Token ids of whole documents, by a public tokenizer, a part at a time.

No token of word_bpe_49k spans ASCII white space, which its pre-tokenizer drops; so a text's
ids are those of its white-space-separated parts, in order. Parts of printable ASCII and
Latin-1 letters, which normalisation only lower-cases, are split into the pre-tokenizer's
pieces here, and the model is asked once for each piece; "word", "Word" and "word," share one.
All other parts go through the whole tokenizer. Each worker keeps what it has met, within bounds.
"""

from __future__ import annotations

import public_tokenizers
import regex
from tokenizers import Tokenizer

from larkspur.llm.common import LONG, only

MOST_PARTS, MOST_PIECES = 500_000, 350_000
_MARKS = frozenset(c for c in range(0x21, 0x7F) if not chr(c).isalnum())
_SIMPLE = regex.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]+")
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def _byte_names() -> list[str]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself, or 256 and on for the rest."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Pieces(dict):
    """Lower-cased piece (UTF-8) -> its ids as little-endian unsigned 32-bit bytes; two generations."""

    def __init__(self, tokenizer: Tokenizer):
        self.model, self.names, self.old = tokenizer.model, _byte_names(), {}

    def __missing__(self, piece: bytes) -> bytes:
        if len(self) >= MOST_PIECES:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(piece)
        if ids is None:
            name = piece.decode() if piece.isascii() else "".join([self.names[b] for b in piece])
            ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(name)])
        if len(piece) <= LONG:
            self[piece] = ids
        return ids


class PartIds(dict):
    """White-space-free part -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError(f"{path} has ids that do not fit in 16 bits")
        self.pieces = Pieces(self.tokenizer)

    def __missing__(self, part: bytes) -> bytes:
        if len(self) >= MOST_PARTS:
            self.clear()
        if part.isalpha():  # bytes: ASCII letters alone, one piece
            ids = self.pieces[part.lower()]
        elif part[:-1].isalpha() and part[-1] in _MARKS:
            ids = self.pieces[part[:-1].lower()] + self.pieces[part[-1:]]
        else:
            text = part.decode("utf-8", "replace")
            if _SIMPLE.fullmatch(text) and "<|" not in text:
                ids = b"".join([self.pieces[p.encode()] for p in _PIECE.findall(text.lower())])
            else:
                ids = b"".join([i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids])
        if len(part) <= LONG:  # a text without white space is one part: kept, it would grow the cache by its bytes
            self[part] = ids
        return ids

    def of(self, text: bytes | None) -> bytes:
        return b"".join(map(self.__getitem__, text.split())) if text else b""


def part_ids(path: str | None = None) -> PartIds:
    """The worker's own cache for the tokenizer file at path."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    return only(("tokens", path), lambda: PartIds(path))
