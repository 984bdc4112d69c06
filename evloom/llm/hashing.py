"""Vectorised 64-bit hashes of words, used inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2^64
_LIMIT = 1 << 20
_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)
_BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
#: Words are runs of anything but these six bytes.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: Terms are also ended by ASCII punctuation.
PUNCTUATION = SPACES.copy()
PUNCTUATION[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = max(n, _LIMIT + 4096)
        base, inverse = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        base[0] = inverse[0] = 1
        _POWERS, _INVERSES = np.cumprod(base), np.cumprod(inverse)
    return _POWERS, _INVERSES


def _pieces(texts: list[str | None], breaks: np.ndarray) -> Iterator[tuple[list[int], list[bytes]]]:
    """Documents in groups of about a megabyte; a longer text is cut where a word ends."""
    numbers: list[int] = []
    parts: list[bytes] = []
    size = 0
    for number, text in enumerate(texts):
        raw = text.encode("utf-8", "replace") if isinstance(text, str) else b""
        while raw:
            end = len(raw)
            if end > _LIMIT:
                gaps = np.flatnonzero(breaks[np.frombuffer(raw, np.uint8, offset=_LIMIT // 2)])
                end = int(gaps[np.searchsorted(gaps, _LIMIT // 2) - 1]) + _LIMIT // 2 + 1 if len(gaps) else end
            numbers.append(number)
            parts.append(raw[:end])
            size += end
            raw = raw[end:]
            if size >= _LIMIT:
                yield numbers, parts
                numbers, parts, size = [], [], 0
    if parts:
        yield numbers, parts


def word_hashes(texts: list[str | None], breaks: np.ndarray = SPACES,
                prefixes: tuple[int, ...] = ()) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(document number, hash of each word, hashes of its prefixes of so many bytes) for groups of documents.

    Words come in order; A-Z count as a-z. A prefix that is not shorter than its word repeats the word's hash.
    """
    for numbers, parts in _pieces(texts, breaks):
        raw = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
        sizes = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
        edges = np.flatnonzero(np.diff(breaks[raw], prepend=True))
        starts, ends = edges[::2], edges[1::2]
        power, inverse = _powers(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTES[_LOWER[raw]] * power[:len(raw)], out=sums[1:])
        documents = np.repeat(np.array(numbers), np.diff(np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))))

        def span(to: np.ndarray) -> np.ndarray:
            return mix((sums[to] - sums[starts]) * inverse[starts])

        yield documents, span(ends), [span(np.minimum(ends, starts + k)) for k in prefixes]
