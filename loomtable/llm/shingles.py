"""Word shingles of whole texts as 64-bit hashes, made with numpy over the bytes of many texts at once."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words of a shingle.
WORDS = 5
#: Bytes of a word up to which words are hashed together; longer ones are hashed one by one.
SHORT = 32


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, and the n + 1 offsets of the texts among them."""
    parts = [t.lower().encode() for t in texts]
    raw = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    offsets = np.cumsum([0, *(len(p) + 1 for p in parts)])
    gap = raw <= 32
    begins = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    sizes = np.flatnonzero(gap & np.concatenate([[False], ~gap[:-1]])) - begins
    h = np.full(len(begins), 0xCBF29CE484222325, np.uint64)
    left = np.flatnonzero(sizes <= SHORT)
    k = 0
    while len(left):
        h[left] = (h[left] ^ raw[begins[left] + k]) * np.uint64(0x100000001B3)
        k += 1
        left = left[sizes[left] > k]
    for i in np.flatnonzero(sizes > SHORT):
        h[i] = xxhash.xxh3_64_intdigest(raw[begins[i] : begins[i] + sizes[i]])
    return mix(h), np.searchsorted(begins, offsets)


def shingle_sets(texts: list[str], words: int = WORDS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct shingles (sorted hashes) and their counts for each text.

    A text of fewer words than a shingle has is one shingle; one without words has none.
    """
    h, at = word_hashes(texts)
    # A shingle is a weighted sum of its words' hashes: order counts, and the sum is mixed.
    n = max(0, len(h) - words + 1)
    run = np.zeros(n, np.uint64)
    factor = [pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(words)]
    for k in range(words):
        run += h[k : n + k] * np.uint64(factor[k])
    run = mix(run)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(run[a : b - words + 1], return_counts=True))
        elif b > a:
            few = sum((int(x) * f for x, f in zip(h[a:b], factor, strict=False)), b - a) % (1 << 64)
            out.append((mix(np.array([few], np.uint64)), np.ones(1, np.int64)))
        else:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    return out
