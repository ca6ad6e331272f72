"""Words of texts as bytes, their 64-bit hashes and rolling hashes of word runs.

Used inside Arrow tasks. All functions see the whole text. Hashes depend on the
words alone, never on the process, so a task that is run again gives the same rows.
"""

from __future__ import annotations

import numpy as np
import xxhash

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else 32
    for c in range(256)
)
MAX_CACHED_WORDS = 400_000


def spaced_words(text: bytes | None) -> list[bytes]:
    """Maximal runs of anything but ASCII white space; none for null."""
    return text.split() if text else []


def lower_spaced_words(text: bytes | None) -> list[bytes]:
    """As `spaced_words`, with A-Z lower-cased first."""
    return text.translate(_LOWER).split() if text else []


def plain_words(text: bytes | None) -> list[bytes]:
    """Maximal runs of a-z, 0-9 and non-ASCII characters, A-Z lower-cased first."""
    return text.translate(_PLAIN).split() if text else []


class WordHashes(dict):
    """Hash of each word seen lately; the memory is bounded, the values are not affected."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of `length` consecutive words, from the words' hashes.

    Runs of powers of two are built by doubling and put together, so the cost per
    word is logarithmic in the length.
    """
    if len(words) < length:
        return np.empty(0, np.uint64)
    power, powers = 1, words
    built, done = None, 0
    rest = length
    while True:
        if rest & 1:
            tail = powers[done:]
            if built is None:
                built = powers
            else:
                n = len(words) - done - power + 1
                built = mix(built[:n] * np.uint64(0x9E3779B97F4A7C15) + tail[:n])
            done += power
        rest >>= 1
        if not rest:
            return built[: len(words) - length + 1]
        powers = mix(powers[: len(powers) - power] * np.uint64(0xC2B2AE3D27D4EB4F) + powers[power:])
        power *= 2


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[: len(values) - size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values
