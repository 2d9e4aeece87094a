"""Words and word hashes shared by the operators of this subpackage."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import regex
import xxhash

_MARKS = regex.compile(r"[\p{Mn}\p{Cf}]+")
_WORDS = re.compile(r"[^\W_]+")
#: Words a worker keeps hashes of; emptied when full.
CACHE = 500_000


def folded(text: str) -> str:
    """Text in lower case without accents and other marks; the dotless i counts as i."""
    if text.isascii():
        return text.lower()
    return _MARKS.sub("", unicodedata.normalize("NFKD", text)).casefold().replace("ı", "i").replace("ø", "o").replace("ł", "l").replace("đ", "d")


def folded_words(text: str | None) -> list[str]:
    return _WORDS.findall(folded(text)) if text else []


def lower_words(text: str | None) -> list[str]:
    """Runs of letters and digits in lower case; the dotted capital I counts as i."""
    return _WORDS.findall(text.replace("İ", "i").lower()) if text else []


class WordHashes(dict):
    """word -> 64-bit hash, computed once for each word."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def multipliers(n: int, seed: int = 20240601) -> np.ndarray:
    """n odd 64-bit multipliers for multilinear hashing of windows."""
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
