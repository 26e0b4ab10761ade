"""Byte-level BPE over whole texts: pre-tokens that are known are looked up, only the rest are merged.

The ids are those of the tokenizers library for the same vocabulary file. Most pre-tokens of a corpus repeat, and many
vocabulary strings are a token by themselves. `whole_tokens` proves for every vocabulary string, by encoding it alone,
whether it is one pre-token that stays one token; those are counted and encoded by lookup from the start. Others are
merged once by rank and remembered in a cache of bounded size.

Texts of common Latin characters are split by a pattern of explicit classes that Python's `re` runs fast, those of any
other script by the vocabulary's own pattern; pre-tokens of both are looked up alike. Only a text with a character that
Unicode has taken in of late, on whose class versions differ, is left to the library whole. Strings of added special
tokens inside a text are handled as the library does by default: each is one token and splits the text.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np

#: Letters, digits and white space among the characters of _FAST; all others there are neither.
_L = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_N = "0-9²³¹¼-¾"
_S = " \t\n\x0b\x0c\r\x85\xa0"
_FAST = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: Characters whose class these patterns do not state.
_OTHER = re.compile("[^\t\n\x0b\x0c\r\x20-\x7e\x85 -ɏ‐-‧‰-⁞₠-₵←-⇿]")
#: Fixed split pattern of this family of vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(maxsize=1)
def _patterns():
    """The split pattern, and a pattern of the letters, digits and spaces that this Python's older Unicode tables do not know."""
    import sys
    import unicodedata

    import regex

    every = "".join(map(chr, [*range(0x80, 0xD800), *range(0xE000, sys.maxunicode + 1)]))
    new = [c for c in regex.findall(r"[\p{L}\p{N}\s]", every) if unicodedata.category(c) == "Cn"]
    return regex.compile(PATTERN), regex.compile(f"[{''.join(map(regex.escape, new))}]") if new else None


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable letter by which this file format writes each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Cache(dict):
    """word -> value, filled on demand; beyond `limit` words it starts again from what was proven."""

    def __init__(self, start: dict, make, limit: int):
        super().__init__(start)
        self.start, self.make, self.limit = start, make, limit

    def __missing__(self, word):
        value = self.make(word)
        if len(word) < 100:
            if len(self) >= self.limit:
                self.clear()
                self.update(self.start)
            self[word] = value
        return value


class WordBpe:
    def __init__(self, path: str, limit: int = 200_000):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, model = byte_letters(), spec["model"]
        if model["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError(f"{path} is not a byte-level BPE without normalizer")
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        # Merging by id is merging by order of the merge list only if the list makes its tokens in order of ids.
        made = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
        if any(b <= a for a, b in zip(made, made[1:])):
            raise ValueError(f"{path}: merges are not in the order of ids")
        self.special = special
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.bpe = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = self.whole_tokens(ranks)
        self.limit = limit

    @functools.cached_property
    def counts(self) -> _Cache:
        return _Cache(dict.fromkeys(self.whole, 1), lambda w: len(self.bpe.encode_ordinary(w)), self.limit)

    @functools.cached_property
    def bytes(self) -> _Cache:
        return _Cache({w: np.uint32(i).astype("<u4").tobytes() for w, i in self.whole.items()}, lambda w: np.array(self.bpe.encode_ordinary(w), "<u4").tobytes(), self.limit)

    def whole_tokens(self, ranks: dict[bytes, int]) -> dict[str, int]:
        found = {}
        for token, i in ranks.items():
            try:
                word = token.decode()
            except UnicodeDecodeError:
                continue
            if self.pre_tokens(word) == [word] and self.bpe.encode_ordinary(word) == [i]:
                found[word] = i
        return found

    @staticmethod
    def pre_tokens(text: str) -> list[str] | None:
        """The parts that are merged by themselves; None if only the library can tell."""
        if not _OTHER.search(text):
            return _FAST.findall(text)
        pattern, unsure = _patterns()
        return None if unsure and unsure.search(text) else pattern.findall(text)

    def _parts(self, text: str):
        return self.split.split(text) if self.split and any(s in text for s in self.special) else (text,)

    def count(self, text: str) -> int:
        n = 0
        for part in self._parts(text):
            if part in self.special:
                n += 1
            elif (words := self.pre_tokens(part)) is None:
                n += len(self.bpe.encode_ordinary(part))
            else:
                n += sum(map(self.counts.__getitem__, words))
        return n

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        out = []
        for part in self._parts(text):
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            elif (words := self.pre_tokens(part)) is None:
                out.append(np.array(self.bpe.encode_ordinary(part), "<u4").tobytes())
            else:
                out.append(b"".join(map(self.bytes.__getitem__, words)))
        return b"".join(out)


@functools.lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    """One for each Python worker."""
    return WordBpe(path)
