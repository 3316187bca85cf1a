"""Hashed word shingles of whole batches of texts, in numpy.

A word is a run of bytes other than space and 0x09-0x0D; A-Z are lower-cased. A shingle is ``width`` consecutive words,
hashed to 64 bits; a text with fewer words has one shingle, its whole word sequence. Different shingles share a hash with
probability 2^-64 per pair, which can move the overlap of a pair of texts by one in a corpus of about 10^11 shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
SLICE_BYTES = 1 << 18  # texts are hashed in slices of about this size, so arrays stay in the cache; a longer text is a slice
LONG_BYTES = 8 * SLICE_BYTES  # a longer text is hashed in pieces

_RNG = np.random.Generator(np.random.PCG64(20240613))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE = _BYTE[_LOWER]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_STEP = np.uint64(0xD1342543DE82EF95)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE_BYTES + 4096), base, dtype=np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= SLICE_BYTES + 4096:  # longer ones are rare and go after use
            _powers[name] = have
    return have[:n]


def word_hashes(data: np.ndarray, starts_of_texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, byte where it starts)`` of each word of ``data`` (uint8); a text boundary also ends a word."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    space = _SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    inner = starts_of_texts[starts_of_texts < n]
    begins[inner] = ~space[inner]
    ends = ~space
    ends[:-1] &= space[1:]
    cut = inner[inner > 0] - 1
    ends[cut] = ~space[cut]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _power("up", _BASE, n), out=total[1:])
    return mix((total[last] - total[first]) * _power("down", _INVERSE, n)[first] + (last - first).astype(np.uint64)), first


def _long_words(data: np.ndarray) -> np.ndarray:
    """Word hashes of one long text, piece by piece; pieces end at a blank."""
    found, at = [], 0
    while at < len(data):
        end = min(at + LONG_BYTES, len(data))
        while end < len(data):
            blank = np.flatnonzero(_SPACE[data[end : end + SLICE_BYTES]])
            if len(blank):
                end += int(blank[0])
                break
            end = min(end + SLICE_BYTES, len(data))
        found.append(word_hashes(data[at:end], np.zeros(1, np.int64))[0])
        at = end
    return np.concatenate(found)


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, number per text)`` for words given text by text; ``counts`` are the words of each text."""
    per_text = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    total = int(per_text.sum())
    if not total:
        return np.zeros(0, np.uint64), per_text
    word_start = np.cumsum(counts) - counts
    own = np.repeat(np.arange(len(counts)), per_text)
    at = np.arange(total) - np.repeat(np.cumsum(per_text) - per_text, per_text) + word_start[own]
    used = np.minimum(counts, width)[own]
    out = np.zeros(total, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            inside = used > k
            np.copyto(out, (out + words[np.minimum(at + k, len(words) - 1)]) * _STEP, where=inside)
            out ^= out >> np.uint64(29)
    return mix(out), per_text


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, start of each text and the end)`` over a string array; nulls are empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, side="right")) - 1
        end = min(max(end, row + 1), len(texts))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> Iterator[tuple[int, np.ndarray]]:
    """``(row, sorted distinct shingle hashes)`` for each text of the array."""
    for first, end, data, bounds in slices(texts):
        with np.errstate(over="ignore"):
            if len(data) > LONG_BYTES:
                words = _long_words(data)
                counts = np.array([len(words)])
            else:
                words, where = word_hashes(data, bounds[:-1])
                counts = np.diff(np.searchsorted(where, bounds))
            hashes, per_text = shingle_hashes(words, counts, width)
        stop = np.cumsum(per_text)
        for k in range(end - first):
            own = hashes[stop[k] - per_text[k] : stop[k]]
            own.sort()
            if len(own) > 1:
                keep = np.empty(len(own), dtype=bool)
                keep[0] = True
                np.not_equal(own[1:], own[:-1], out=keep[1:])
                own = own[keep]
            yield first + k, own
