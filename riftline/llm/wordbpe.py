"""Ids of the lower-casing word BPE vocabulary, pre-token by pre-token.

The tokenizer normalises (NFC, white space, lower case), splits into pre-tokens and merges each
pre-token on its own, so the ids of a text are the ids of its pre-tokens in order.  Texts in plain
Latin script are split here by an equivalent pattern and every distinct pre-token is merged once per
worker; a text with any other character, or with a special token's string in it, goes to the library
as a whole, so the result is the library's in every case.
"""

from __future__ import annotations

import re
import struct

from tokenizers import Tokenizer

#: Letters, digits and white space among the characters below U+0250, as the split pattern sees them.
_LETTER = "a-zA-Z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f"
_NUMBER = "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
_SPACE = "\\x09-\\x0d\\x20\\x85\\xa0"
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")
#: Beyond U+024F only dashes, quotes and other general punctuation keep their class in every version of Unicode.
_UNUSUAL = re.compile("[^\\x00-\\u024f\\u2010-\\u2027\\u2030-\\u205e\\u20ac]")
#: Distinct pre-tokens remembered by one worker; when full, the table starts again.
REMEMBERED = 250_000


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Merger(dict):
    """Maps a pre-token to the little-endian 32-bit ids of its tokens; missing ones are merged and kept."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.alphabet = byte_alphabet()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def shown(self, piece: str) -> str:
        return "".join(map(self.alphabet.__getitem__, piece.encode("utf-8")))

    def __missing__(self, piece: str) -> bytes:
        tokens = self.model.tokenize(self.shown(piece))
        packed = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        if len(self) >= REMEMBERED:
            self.clear()
        self[piece] = packed
        return packed

    def plain(self, text: str) -> bool:
        return not _UNUSUAL.search(text) and not any(s in text for s in self.specials)

    def pieces(self, text: str) -> list[str]:
        return _SPLIT.findall(text.lower())

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def packed(self, text: str) -> bytes:
        """All ids of a text as little-endian unsigned 32-bit integers."""
        if not self.plain(text):
            ids = self.whole(text)
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(self.__getitem__, self.pieces(text)))


_mergers: dict[str, Merger] = {}


def merger(path: str) -> Merger:
    """The merger of this worker process; built once for each vocabulary file."""
    if path not in _mergers:
        _mergers[path] = Merger(path)
    return _mergers[path]
