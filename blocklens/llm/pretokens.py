"""What a byte-level vocabulary file prescribes before its merges.

Special strings are taken out of the raw text first. The rest is composed (NFC),
lower-cased letter by letter, and cut into pieces by the file's pattern. No piece and
no special string holds white space, so words between white space can be cut alone.

Pieces that hold code points which Python's tables leave unassigned, and which the
library's newer tables may know, are cut by the library's own normaliser and
pre-tokeniser; neither emits identifiers.
"""

from __future__ import annotations

import json
import unicodedata
from functools import cache

import regex

#: White space as Unicode has it; the pattern's own \s.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@cache
def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


@cache
def byte_values() -> dict[str, int]:
    return {c: b for b, c in enumerate(byte_symbols())}


@cache
def library_file(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class PreTokens:
    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            self.spec = spec = json.load(f)
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        cuts = [p["type"] for p in spec["pre_tokenizer"]["pretokenizers"]]
        if spec["model"]["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or cuts != ["Split", "ByteLevel"]:
            raise ValueError("made for byte-level BPE with NFC, lower case and one cutting pattern")
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", SPACE)
        self.cut = regex.compile(pattern, regex.V0).findall
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def known(self, text: str) -> bool:
        return all(unicodedata.category(c) != "Cn" for c in set(text))

    def by_library(self, text: str) -> list[str]:
        """Pieces as the library cuts them, byte-level characters read back as bytes."""
        library = library_file(self.path)
        raw = [bytes(map(byte_values().__getitem__, piece)) for piece, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text))]
        return [r.decode("utf-8", "surrogateescape") for r in raw]

    def pieces(self, text: str) -> list[str]:
        """Pieces of a text without special strings."""
        if text.isascii():
            return self.cut(text.lower())
        if not self.known(text):
            return self.by_library(text)
        return self.cut("".join(c.lower() for c in unicodedata.normalize("NFC", text)))


@cache
def pre_tokens(path: str) -> PreTokens:
    return PreTokens(path)
