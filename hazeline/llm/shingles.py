"""Hashed word shingles of many texts at once."""

from __future__ import annotations

import numpy as np

from hazeline.llm.common import mix64

_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n, BASE, np.uint64)])


def _word_hashes(data: np.ndarray, space: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial hash of the bytes of each word."""
    size = np.diff(np.r_[starts, len(data)])
    place = np.arange(starts[0], len(data)) - np.repeat(starts, size)
    weight = _powers(int((ends - starts).max()))
    inside = ~space[starts[0] :]
    terms = np.zeros(len(place), np.uint64)
    terms[inside] = (data[starts[0] :][inside].astype(np.uint64) + np.uint64(1)) * weight[place[inside]]
    return mix64(np.add.reduceat(terms, starts - starts[0]))


def shingle_sets(encoded: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the shingles of each text, ascending, end to end, and their number a text; fewer words than a
    shingle has are one shingle."""
    joined = b"\n" + b"\n".join(encoded) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    sizes = np.array([len(x) + 1 for x in encoded], np.int64)
    row_from = np.cumsum(sizes) - sizes + 1
    space = _SPACES[data]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    n_rows = len(encoded)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n_rows, np.int64)
    places = mix64(np.arange(1, shingle + 1, dtype=np.uint64)) | np.uint64(1)
    word = _word_hashes(data, space, starts, ends)
    row = np.searchsorted(row_from, starts, side="right") - 1
    n_words = np.bincount(row, minlength=n_rows)
    first = np.cumsum(n_words) - n_words
    padded = np.r_[word, np.zeros(shingle - 1, np.uint64)]
    left = np.repeat(first + n_words, n_words) - np.arange(len(word))  # words of the row from here on
    total = np.zeros(len(word), np.uint64)
    for k in range(shingle):
        total += np.where(left > k, padded[k : k + len(word)], np.uint64(0)) * places[k]
    whole = (left >= shingle) | ((n_words[row] < shingle) & (np.arange(len(word)) == first[row]))
    hashes, owner = mix64(total[whole]), row[whole]
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.bincount(owner[new], minlength=n_rows)


def set_ids(hashes: np.ndarray, n: np.ndarray) -> list[bytes]:
    """16 bytes that name each set, whatever the order or repetition of its shingles in the text."""
    sums = np.r_[np.uint64(0), np.cumsum(hashes)]
    mixed = np.r_[np.uint64(0), np.cumsum(mix64(hashes))]
    ends = np.cumsum(n)
    both = np.stack([sums[ends] - sums[ends - n], mixed[ends] - mixed[ends - n] + n.astype(np.uint64)], axis=1)
    return [x.tobytes() for x in both.astype(">u8")]
