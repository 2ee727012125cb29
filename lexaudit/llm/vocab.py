"""A word-end BPE vocabulary file and its text rules: NFC, lower case by code
point, words by letter, digit and symbol runs, bytes as printable characters.

Files are read on the driver from a path that is a parameter; what tasks need
of them goes out as one broadcast of the file's (fixed) size."""

from __future__ import annotations

import json
import re
import unicodedata
from dataclasses import dataclass, field

import regex

WORD_END = "</w>"
# Unicode White_Space; fixed values.
CHUNK = re.compile("[^\t-\r \x85\xa0  -     　]+")
# The split pattern stated in the vocabulary file; fixed value.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def byte_chars() -> list[str]:
    """The printable stand-in of each byte: itself where it prints in Latin-1,
    else the next code point from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


def normalize(chunk: str) -> str:
    """NFC, then lower case code point by code point (no word-final sigma)."""
    if chunk.isascii():
        return chunk.lower()
    chunk = unicodedata.normalize("NFC", chunk)
    return "".join(map(str.lower, chunk)) if "Σ" in chunk else chunk.lower()


@dataclass
class Vocabulary:
    ids: dict[str, int]
    merges: list[tuple[str, str]]
    special: dict[str, int] = field(default_factory=dict)

    @classmethod
    def read(cls, path: str) -> "Vocabulary":
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in data["model"]["merges"]]
        return cls(data["model"]["vocab"], pairs, {t["content"]: t["id"] for t in data["added_tokens"]})


def default_path() -> str:
    """Where the public word-end vocabulary is installed."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")
