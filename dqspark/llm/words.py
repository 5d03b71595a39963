"""Words of a text, on UTF-8 bytes: runs of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased.

For hashes and counts, each character of a script that is written without spaces is a word of its own.
"""

from __future__ import annotations

import numpy as np

#: Every byte that is no part of a word becomes a space, A-Z becomes a-z.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def split(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


_ODD = np.uint64(0x9E3779B97F4A7C15)
_random = np.random.default_rng(20)
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.cumprod(np.full(4096, 0xD1342543DE82EF95, dtype=np.uint64))
_STEP = _random.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_starts(folded: np.ndarray) -> np.ndarray:
    """Where the words of folded bytes begin. Characters of unspaced scripts (three bytes each: Chinese, kana, Thai, Lao,
    Burmese, Khmer) begin a word, and so does what follows them."""
    inside = folded != 32
    starts = inside & ~np.append(False, inside[:-1])[: len(inside)]
    if (folded >= 0xE0).any():
        second = np.append(folded[1:], 0)
        alone = (folded >= 0xE3) & (folded <= 0xE9)
        alone |= (folded == 0xE0) & (second >= 0xB8) & (second <= 0xBB)
        alone |= (folded == 0xE1) & ((second >= 0x80) & (second <= 0x82) | (second == 0x9E) | (second == 0x9F))
        after = np.append(np.zeros(3, bool), alone)[: len(folded)]
        starts |= alone | after & inside
    return starts


def word_hashes(text: bytes | None) -> np.ndarray:
    """A 64-bit hash of each word of a text, in order."""
    if not text:
        return np.empty(0, np.uint64)
    letters = np.frombuffer(text.translate(FOLD), np.uint8)
    starts = np.flatnonzero(word_starts(letters))
    if not len(starts):
        return np.empty(0, np.uint64)
    inside = letters != 32
    kept = np.flatnonzero(inside)
    first = np.searchsorted(kept, starts)
    lengths = np.diff(first, append=len(kept))
    at = (kept - np.repeat(starts, lengths)) % len(_PLACE)
    return mix(np.add.reduceat(_BYTE[letters[kept]] * _PLACE[at], first) + lengths.astype(np.uint64))


def shingle_hashes(text: bytes | None, size: int = 5) -> np.ndarray:
    """A hash of each run of size words, repeats included. A text of fewer words, but not none, has one shingle."""
    words = word_hashes(text)
    if not len(words):
        return words
    size = min(size, len(words))
    total = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        total += words[k : k + len(total)] * _STEP[k % len(_STEP)]
    return mix(total)
