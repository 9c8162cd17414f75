"""Sets of word shingles as 64-bit hashes, worked out for many texts at once."""

from __future__ import annotations

import numpy as np

from tracewell.llm.texts import parts_of, portions

#: Words of a shingle.
WORDS = 5
_rng = np.random.default_rng(20_240_501)
_BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Each number's bits spread over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-case words between ASCII white space, text after text, and where each text's begin (and the end)."""
    parts = [t.lower().encode("utf-8", "surrogatepass") + b" " for t in texts]
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    inside = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside))) if len(data) else np.empty(0, bool))
    starts, ends = edge[0::2], edge[1::2]
    bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64)))
    first = np.searchsorted(starts, bounds)
    if not len(starts):
        return np.empty(0, dtype=np.uint64), first
    lengths = ends - starts
    offsets = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(int(lengths.sum())) - np.repeat(offsets, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), _BASE, dtype=np.uint64))
    hashes = np.add.reduceat(_BYTES[data[inside]] * powers[place], offsets)
    return mixed(hashes + lengths.astype(np.uint64)), first


def hashes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """:func:`word_hashes` of texts of any length: a long text is hashed part by part."""
    if len(texts) > 1:
        return word_hashes(texts)
    hashes = np.concatenate([word_hashes([p])[0] for t in texts for p in parts_of(t)])
    return hashes, np.array([0, len(hashes)])


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; a bounded portion of text is worked on at once.

    A text with fewer words than a shingle has one of all its words; one with no word has none.
    """
    place = _PLACES[:words]
    out = []
    for some in portions(texts):
        hashes, first = hashes_of(some)
        rolled = np.zeros(max(0, len(hashes) - words + 1), dtype=np.uint64)
        for j in range(words):
            rolled += hashes[j : j + len(rolled)] * place[j]
        rolled = mixed(rolled)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= words:
                out.append(np.unique(rolled[a : b - words + 1]))
            elif b > a:
                out.append(mixed((hashes[a:b] * place[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
            else:
                out.append(np.empty(0, dtype=np.uint64))
    return out
