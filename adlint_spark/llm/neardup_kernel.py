"""numpy side of near-duplicate detection: five-word shingle sets and min-max hash signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from adlint_spark.llm.common import mix64, seeded, span_hashes, text_chunks, word_spans


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of texts: (hashes, offsets), the distinct shingle hashes of each text, ascending.

    A text with fewer than ``width`` words has its whole word sequence as its one shingle, a text without words none.
    """
    factor = seeded(width, 101)
    for _, _, data, offs in text_chunks(column):
        starts, ends, first = word_spans(data, offs)
        w = span_hashes(data, starts, ends)
        with np.errstate(over="ignore"):
            full = np.zeros(max(0, len(w) - width + 1), np.uint64)
            for k in range(width):
                full += w[k : k + len(full)] * factor[k]
            full = mix64(full)
        sets = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= width:
                sets.append(np.unique(full[a : b - width + 1]))
            elif b > a:
                with np.errstate(over="ignore"):
                    sets.append(mix64(np.sum(w[a:b] * factor[: b - a], dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
            else:
                sets.append(np.zeros(0, np.uint64))
        yield (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum([len(s) for s in sets])])


def min_max_bands(hashes: np.ndarray, offs: np.ndarray, permutations: int, rows: int) -> np.ndarray:
    """Band keys, one row for each non-empty set: bands of minima, then bands of maxima.

    Every permutation is evaluated once and gives two signature values. Minima and maxima of the same
    permutation go to different bands.
    """
    factor = seeded(permutations, 202) | np.uint64(1)
    starts = offs[:-1][np.diff(offs) > 0]
    bands = permutations // rows
    out = np.zeros((len(starts), 2 * bands), np.uint64)
    if not len(starts):
        return out
    row = seeded(rows, 303) | np.uint64(1)
    with np.errstate(over="ignore"):
        for p in range(bands * rows):
            x = hashes * factor[p]
            x ^= x >> np.uint64(32)
            out[:, p // rows] += mix64(np.minimum.reduceat(x, starts)) * row[p % rows]
            out[:, bands + p // rows] += mix64(np.maximum.reduceat(x, starts)) * row[p % rows]
        out = mix64(out + seeded(2 * bands, 404))
    return out


def linked_stars(rep: np.ndarray, flat: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(root, member) for each member of the components that links within this group form; root is the least member.

    All pairs of different components are tested on the full sets: each set is marked in a table of the group's
    shingles and counted against the later sets in one pass.
    """
    n = len(rep)
    order = np.argsort(rep, kind="stable")
    offs = np.concatenate([[0], np.cumsum(sizes)])
    rank = np.unique(flat, return_inverse=True)[1]
    sets = [rank[offs[i] : offs[i + 1]] for i in order]
    rep, sizes = rep[order], sizes[order].astype(np.int64)
    label = np.arange(n)
    mark = np.zeros(int(rank.max()) + 1 if len(rank) else 1, bool)
    for x in range(n - 1):
        small, large = np.minimum(sizes[x + 1 :], sizes[x]), np.maximum(sizes[x + 1 :], sizes[x])
        others = np.flatnonzero((label[x + 1 :] != label[x]) & (100 * small >= percent * large) & (small > 0)) + x + 1
        if not len(others):
            continue
        mark[sets[x]] = True
        hit = mark[np.concatenate([sets[y] for y in others])] if len(others) > 1 else mark[sets[others[0]]]
        both = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(sizes[others])[:-1]]), dtype=np.int64)
        mark[sets[x]] = False
        for y in others[100 * both >= percent * (sizes[x] + sizes[others] - both)]:
            if label[y] != label[x]:
                least = min(label[x], label[y])
                label[(label == label[x]) | (label == label[y])] = least
    member = np.flatnonzero(label != np.arange(n))
    return rep[label[member]], rep[member]
