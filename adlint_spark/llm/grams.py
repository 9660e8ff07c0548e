"""numpy side of the n-gram classifiers: hashed byte n-grams and word-shape n-grams of whole texts."""

from __future__ import annotations

import numpy as np

from adlint_spark.llm.common import seeded, span_hashes, word_spans

_SEEDS = seeded(16, 505) | np.uint64(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] = _FOLD[97:123]


def byte_grams(data: np.ndarray, offs: np.ndarray, orders: tuple[int, ...], bits: int, fold: bool) -> np.ndarray:
    """Buckets, a row for each order: the bucket of the n-gram that starts at each byte of the texts.

    Zero bytes end each text, so n-grams don't cross texts. Buckets of the kth order are
    ``[k << bits, (k + 1) << bits)``; ``fold`` counts A-Z as a-z.
    """
    n, texts = len(data), len(offs) - 1
    own = np.arange(n) + 3 * np.repeat(np.arange(texts), np.diff(offs))
    wide = np.zeros(n + 3 * texts + 3, np.uint32)
    wide[own] = _FOLD[data] if fold else data
    gram, out = wide.copy(), np.empty((len(orders), n), np.uint32)
    for k in range(1, 5):
        if k > 1:
            gram[: len(wide) - k + 1] = (gram[: len(wide) - k + 1] << np.uint32(8)) | wide[k - 1 :]
        for row, order in enumerate(orders):
            if order == k:
                mixed = gram[own] * np.uint32(int(_SEEDS[k]) & 0xFFFFFFFF | 1)
                mixed ^= mixed >> np.uint32(15)
                mixed *= np.uint32(0x2C1B3C6D)
                out[row] = (mixed >> np.uint32(32 - bits)) | np.uint32(row << bits)
    return out


def word_shapes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shape, first word of each text): length class, case, the last two bytes' kinds, and whether a word repeats the one before it in its text."""
    starts, ends, first = word_spans(data, offs)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    kind = np.zeros(256, np.uint64)  # others, among them the bytes of letters beyond ASCII: 0
    kind[48:58], kind[65:91], kind[97:123] = 1, 2, 3
    for k, c in enumerate(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
        kind[c] = 4 + k
    kinds = kind[data]
    last = kinds[ends - 1]
    before = np.where(ends - starts > 1, kinds[np.maximum(ends - 2, 0)], np.uint64(63))
    upper = np.concatenate([[0], np.cumsum(kinds == 2)])
    caps = (upper[ends] - upper[starts]).astype(np.uint64)
    length = np.minimum((ends - starts).astype(np.uint64), np.uint64(15))
    same = np.zeros(len(starts), np.uint64)
    whole = span_hashes(data, starts, ends, fold=False)
    same[1:] = whole[1:] == whole[:-1]
    same[first[:-1][np.diff(first) > 0]] = 0  # a text's first word has none before it
    shape = ((((length * np.uint64(64) + last) * np.uint64(64) + before) * np.uint64(4) + np.minimum(caps, np.uint64(3))) * np.uint64(2)) + same
    return shape, first


def distinct_features(data: np.ndarray, offs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(features, offsets): the distinct hashed features of each text: byte 3- and 4-grams with case, word-shape 1- to 3-grams."""
    text = np.repeat(np.arange(len(offs) - 1, dtype=np.uint32), np.diff(offs))
    keys = [(text << np.uint32(bits)) | g for g in byte_grams(data, offs, (3, 4), bits - 1, False)]
    shape, first = word_shapes(data, offs)
    owner = np.repeat(np.arange(len(offs) - 1, dtype=np.uint32), np.diff(first))
    with np.errstate(over="ignore"):
        rolled = np.zeros(len(shape), np.uint64)
        for k in range(3):
            rolled = rolled[: len(shape) - k] * _SEEDS[8] + (shape[k:] + np.uint64(1)) * _SEEDS[9 + k]
            if not len(rolled):
                break
            inside = owner[: len(rolled)] == owner[k : k + len(rolled)]
            bucket = ((rolled * _SEEDS[12]) >> np.uint64(64 - bits)).astype(np.uint32)
            keys.append(((owner[: len(rolled)] << np.uint32(bits)) | bucket)[inside])
    keys = np.sort(np.concatenate(keys))
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    ends = np.searchsorted(keys, np.arange(len(offs), dtype=np.uint64) << np.uint64(bits))
    return keys & np.uint32((1 << bits) - 1), ends
