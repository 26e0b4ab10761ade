"""Token ids of vocabularies with word ends: every part of a text that is merged by itself once, then by look-up.

For a tokenizer file of the kind checked here (composed, lower-cased text; white space removed; letters, single digits and
signs split apart, ends of parts marked) the ids of a text are those of its parts in order. Texts of common Latin
characters, composed already, are lower-cased and split by a pattern of explicit classes. A part that is not known yet is
merged by rank with its end mark as a byte of its own, which merges first: ids follow the order of the merge list, so
merging by id is merging by that list. Parts are remembered up to a limit.

Other texts, and such as hold a string of an added token, are split at ASCII white space, which nothing in normalization,
splitting or merging reaches across; each distinct word goes to the library once.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import unicodedata

from .bpe import byte_letters
from .common import WORD

_WORD = re.compile(WORD)
#: Characters whose class and lower case the pattern below knows; lower case adds letters up to U+02AF, two more, and a dot.
_OTHER = re.compile("[^\t\n\x0b\x0c\r\x20-\x7e\x85 -ɏ‐-‧‰-⁞₠-₵←-⇿]")
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ʯⱥⱦ", "0-9²³¹¼-¾", " \t\n\x0b\x0c\r\x85\xa0"
_PART = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
#: The split pattern of this family of vocabularies, as their files state it.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Stands for the end mark; occurs in no text that is split by the pattern.
END = "\x01"
#: Longer parts are not remembered.
LONG = 64


class _Known(dict):
    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, part: str) -> bytes:
        made = self.make(part)
        ids = struct.pack(f"<{len(made)}I", *made)
        if len(part) <= LONG:
            if len(self) >= self.limit:
                self.clear()
            self[part] = ids
        return ids


class WordIds:
    def __init__(self, path: str, limit: int = 400_000):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], spec["added_tokens"]
        steps = [s["type"] for s in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        kinds = [(s["type"], s.get("behavior"), s.get("add_prefix_space"), (s.get("pattern") or {}).get("Regex")) for s in splits]
        if steps != ["NFC", "Replace", "Lowercase"] or kinds != [("Split", "Removed", None, SPLIT), ("ByteLevel", None, False, None)] or model["continuing_subword_prefix"] or any(t["lstrip"] or t["rstrip"] or t["single_word"] or _WORD.fullmatch(t["content"]) is None for t in added):
            raise ValueError(f"parts of {path} may depend on each other")
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = [model["vocab"]["".join(m)] for m in merges]
        if any(b <= a for a, b in zip(made, made[1:])):
            raise ValueError(f"{path}: merges are not in the order of ids")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.added = tuple(t["content"] for t in added)
        letters, suffix, ranks = byte_letters(), model["end_of_word_suffix"], {}
        for token, i in model["vocab"].items():
            if token not in self.added:
                ends = token.endswith(suffix)
                ranks[bytes(letters[c] for c in (token.removesuffix(suffix) if ends else token)) + (END.encode() if ends else b"")] = i
        if len(ranks) != len(model["vocab"]) - sum(t in model["vocab"] for t in self.added) or any(ranks[bytes([b]) + END.encode()] >= made[0] for b in range(256)):
            raise ValueError(f"{path}: ends are not marked before merges")
        self.bpe = tiktoken.Encoding("parts", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.parts = _Known(lambda p: self.bpe.encode_ordinary(p + END), limit)
        self.words = _Known(lambda w: self.library.encode(w, add_special_tokens=False).ids, limit)

    def ids(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if _OTHER.search(text) or not unicodedata.is_normalized("NFC", text) or any(s in text for s in self.added):
            return b"".join(map(self.words.__getitem__, _WORD.findall(text)))
        return b"".join(map(self.parts.__getitem__, _PART.findall(text.lower())))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@functools.lru_cache(maxsize=2)
def load(path: str) -> WordIds:
    """One for each Python worker."""
    return WordIds(path)
