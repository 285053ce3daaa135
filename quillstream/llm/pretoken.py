"""Splitting texts into words as a tokenizer file says, faster where all letters are Latin."""

from __future__ import annotations

import re
import unicodedata

import regex

#: Code points below this one are written out as classes of the standard library's expressions.
LATIN = 0x250


class Splitter:
    """Words and control strings of a text after normalisation (NFC, lower case)."""

    def __init__(self, spec: dict) -> None:
        steps = (spec.get("normalizer") or {}).get("normalizers") or [spec.get("normalizer") or {}]
        if [x.get("type") for x in steps if x.get("type") != "Replace"] != ["NFC", "Lowercase"]:
            raise ValueError("a tokenizer file that normalises by NFC and lower case is read")
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.any_words = regex.compile(pattern).findall
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        chars = [chr(c) for c in range(LATIN)]
        kind = {k: re.escape("".join(c for c in chars if unicodedata.category(c)[0] == k)) for k in "LN"}
        blank = re.escape("".join(c for c in chars if regex.match(r"\s", c)))
        # the file's own classes, spelled out
        latin = pattern.replace("[\\p{L}]", f"[{kind['L']}]").replace("[\\p{N}]", f"[{kind['N']}]").replace("[^\\s\\p{L}\\p{N}]", f"[^{blank}{kind['L']}{kind['N']}]")
        self.latin_words = re.compile(latin).findall
        self.beyond = re.compile(f"[^\\x00-{chr(LATIN - 1)}]").search

    def words(self, text: str) -> list[str]:
        if text.isascii():
            return self.latin_words(text.lower())
        text = unicodedata.normalize("NFC", text)
        # Unlike str.lower, the library folds each character alone
        text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        return (self.any_words if self.beyond(text) else self.latin_words)(text)

    def split(self, text: str) -> list[str]:
        """Words, with control strings as they stand."""
        if "<|" not in text:
            return self.words(text)
        out: list[str] = []
        for piece in self.cut.split(text):
            out += [piece] if piece in self.special else self.words(piece)
        return out


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    others = (b for b in range(256) if b not in letters)
    return [c for _, c in sorted((letters | {b: chr(256 + n) for n, b in enumerate(others)}).items())]


class ByteLetters(dict):
    """For str.translate: the letters of each character's UTF-8 bytes."""

    def __init__(self) -> None:
        self.of = byte_letters()

    def __missing__(self, code: int) -> str:
        self[code] = out = "".join(self.of[b] for b in chr(code).encode())
        return out
