"""Byte-level BPE encoding of whole texts with the tokenizers library, one word at a time.

The library's pre-tokenizer never lets a token cross a border that the pattern below cuts at (see
``CUT``), so a text's ids are the ids of its parts in a row.  Parts come again and again, hence a bounded
table of parts already encoded.  A text with a special token's string, or with one of the four control
characters that Python counts as white space and the library does not, is given to the library whole.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array

import numpy as np

from . import common

#: A run of Latin letters up to white space, ASCII punctuation or the end; any other run of non-spaces; each
#: with one space before it; runs of white space as the library's own pattern splits them.
CUT = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+(?=[\s!-/:-@\[-`{-~]|\Z)| ?\S+|\s+(?!\S)|\s+")
ODD = "\x1c\x1d\x1e\x1f"


def _byte_letters() -> dict[int, str]:
    """The published byte alphabet of byte-level BPE: printable bytes stand for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Parts(dict):
    """Part -> bytes of its ids, encoded when first asked for; ``held`` counts about how many bytes the table takes."""

    def __init__(self, tok, code: str):
        self.tok, self.model, self.code = tok, tok.model, code
        self.letters = _byte_letters()
        self.held = 0

    def clear(self) -> None:
        super().clear()
        self.held = 0

    def __missing__(self, part: str) -> bytes:
        word = part[1:] if part[0] == " " else part
        if word.isalpha():  # one pre-token: the model alone is asked
            ids = [t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(self.letters))]
        else:
            ids = self.tok.encode(part, add_special_tokens=False).ids
        raw = array(self.code, ids).tobytes()
        if len(part) <= 64:
            self[part] = raw
            self.held += 200 + 2 * len(part) + len(raw)
        return raw


class ByteBpe:
    """Encodes texts to bytes of little-endian ids, ``width`` bytes each; ``limit`` bounds the bytes of the table of parts."""

    def __init__(self, tokenizer_file: str, limit: int = 96 << 20):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(tokenizer_file)
        self.specials = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.width = 2 if self.tok.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        code = next(c for c in "HIL" if array(c).itemsize == self.width)
        self.limit = limit
        self.parts = _Parts(self.tok, code)
        own = json.loads(self.tok.to_str())
        plain = own["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.cuts = plain and own["normalizer"] is None and not any(t["lstrip"] or t["rstrip"] for t in own["added_tokens"]) and sys.byteorder == "little"

    def _whole(self, text: str) -> bool:
        return not self.cuts or any(s in text for s in self.specials) or any(c in text for c in ODD)

    def raw(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of every text (null: none)."""
        known = self.parts.__getitem__
        out = []
        for t in texts:
            if self.parts.held >= self.limit:
                self.parts.clear()
            if not t:
                out.append(b"")
            elif self._whole(t):
                out.append(self.raw(self.tok.encode(t, add_special_tokens=False).ids))
            else:
                out.append(b"".join(map(known, CUT.findall(t))))
        return out


_encoders: dict[tuple[str, int], ByteBpe] = {}


def encoder(tokenizer: str, limit: int = 96 << 20) -> ByteBpe:
    """One encoder for each worker process.  ``tokenizer``: a path, or the name of a public tokenizer's file."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    key = (tokenizer, limit)
    if key not in _encoders:
        _encoders[key] = ByteBpe(tokenizer if "/" in tokenizer else common.tokenizer_file(tokenizer), limit)
    return _encoders[key]
