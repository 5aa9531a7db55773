"""Pre-tokens of whole texts exactly as a tokenizer library cuts them.

The split pattern is run here, on whole texts.  It may stand in for the
library because each character is proven first: around it, in a probe that
meets every kind of neighbour, pattern and library must cut alike.  A text
with any other character, or one that normalising would change beyond lower
case, is left to the library.
"""

from __future__ import annotations

import json
import re
import unicodedata

import regex

from .vocab import load, resolve


class Pretokeniser:
    def __init__(self, vocab: str, pattern: str, lower: bool) -> None:
        self.tokenizer = load(vocab)
        self.lower = lower
        with open(resolve(vocab), encoding="utf-8") as f:
            described = json.load(f)
        added = described["added_tokens"]
        # anything the code below doesn't do is left to the library
        self.usual = (described["normalizer"] is not None) == lower and not any(
            x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in added)
        self.specials = {x["content"]: x["id"] for x in added}
        self.special = regex.compile("(" + ("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) or r"(?!)") + ")")
        self.pattern = regex.compile(pattern)
        # the pattern with its classes written out for the first 256 characters, for texts that have no others
        first = [chr(c) for c in range(256)]
        written = {name: "".join(re.escape(c) for c in first if regex.match(cls, c))
                   for name, cls in (("L", r"\p{L}"), ("N", r"\p{N}"), ("s", r"\s"))}
        small = pattern.replace(r"[^\s\p{L}\p{N}]", "[^{s}{L}{N}]").replace(r"[\p{L}]", r"\p{L}").replace(r"[\p{N}]", r"\p{N}")
        small = small.replace(r"\p{L}", "[{L}]").replace(r"\p{N}", "[{N}]").replace(r"\S", "[^{s}]").replace(r"\s", "[{s}]")
        self.small = re.compile(re.sub(r"\{([LNs])\}", lambda m: written[m[1]], small))
        self.first = set(first)
        self.known: set[str] = set()
        self.odd: set[str] = {"Σ"} if lower else set()  # its lower case depends on what stands around it
        self.prove({chr(c) for c in range(128)})

    def prove(self, chars: set[str]) -> None:
        library, normal = self.tokenizer.pre_tokenizer.pre_tokenize_str, self.tokenizer.normalizer
        for c in chars - self.known - self.odd:
            probe = f"a{c}a1{c}1!{c}! {c}{c} a{c} 1 {c}"
            plain = normal.normalize_str(probe) if normal else probe
            theirs = [len(piece) for piece, _ in library(plain)]
            ours = [len(p.encode("utf-8")) for p in self.pattern.findall(probe.lower() if self.lower else probe)]
            (self.known if ours == theirs else self.odd).add(c)

    def cut(self, text: str) -> tuple[list[list[str]], list[int]] | None:
        """Pre-tokens of the stretches between special strings, and the ids of
        these strings in order; None if the text is left to the library."""
        pattern = self.small
        if not self.usual:
            return None
        if not text.isascii():
            chars = set(text)
            if not chars <= self.known:
                self.prove(chars)
            if not chars.isdisjoint(self.odd):
                return None
            if not chars <= self.first:
                pattern = self.pattern
                if self.lower and not unicodedata.is_normalized("NFC", text):
                    return None
        if any(s in text for s in self.specials):
            parts = self.special.split(text)
            stretches, ids = parts[::2], [self.specials[s] for s in parts[1::2]]
        else:
            stretches, ids = [text], []
        if self.lower:
            stretches = [s.lower() for s in stretches]
        return [pattern.findall(s) for s in stretches], ids

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids
