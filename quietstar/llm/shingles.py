"""Word shingles of whole texts as 64-bit hashes, computed inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers by a word's place in its shingle, and those of the final mix.
_PLACE = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0x94D049BB133111EB, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; fewer words give one shingle of them all, none give none.

    A-Z are lower-cased, words end at space and at code points 9 to 13.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    take = min(width, len(hashes))
    count = len(hashes) - take + 1
    out = np.full(count, take, np.uint64)
    for i in range(take):
        out += hashes[i : i + count] * _PLACE[i % len(_PLACE)]
    out ^= out >> np.uint64(32)
    out *= _MIX
    out ^= out >> np.uint64(29)
    out.sort()
    new = np.ones(count, bool)
    np.not_equal(out[1:], out[:-1], out=new[1:])
    return out[new]


def set_digest(tokens: np.ndarray) -> bytes:
    """128 bits that tell sets apart."""
    return xxhash.xxh3_128_digest(tokens.tobytes())
