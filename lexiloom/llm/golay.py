"""The binary Golay code (23, 12): every 23-bit word lies within three bits of exactly one codeword."""

from __future__ import annotations

import itertools

import numpy as np

GENERATOR = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
LENGTH, DATA = 23, 12


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, LENGTH - DATA - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - (LENGTH - DATA))
    return word


def _tables() -> tuple[list[np.ndarray], np.ndarray]:
    by_byte = [np.array([_remainder((b << 8 * k) & (1 << LENGTH) - 1) for b in range(256)], np.uint32) for k in range(3)]
    errors = np.zeros(1 << (LENGTH - DATA), np.uint32)
    for weight in range(4):
        for bits in itertools.combinations(range(LENGTH), weight):
            e = sum(1 << b for b in bits)
            errors[_remainder(e)] = e
    return by_byte, errors


_BY_BYTE, _ERRORS = _tables()
_FLIPS = np.concatenate([[0], 1 << np.arange(LENGTH)]).astype(np.uint32)


def index(words: np.ndarray) -> np.ndarray:
    """The 12 data bits of the codeword nearest to each word."""
    words = words.astype(np.uint32)
    rest = _BY_BYTE[0][words & 255] ^ _BY_BYTE[1][words >> 8 & 255] ^ _BY_BYTE[2][words >> 16 & 127]
    return (words ^ _ERRORS[rest]) >> (LENGTH - DATA)


def keys(words: np.ndarray) -> np.ndarray:
    """For each word the sorted indices of the codewords near it and near its one-bit neighbours, repeats as -1.

    Words that differ in up to two bits share an index; a word has one or six different ones.
    """
    found = np.sort(index(words[:, None] ^ _FLIPS).astype(np.int64), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return found
