"""numpy side of SentencePiece encoding: a vocabulary as sorted keys, batched Viterbi over words of equal length."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from adlint_spark.llm.common import mix64, power_tables, seeded, span_hashes, text_chunks

SPACE = "▁"
#: Words up to this length advance with those of the same length; longer ones, which are rare, are filled up to the next of
#: a few lengths. What stands after a word's end doesn't change the lattice before it.
SAME_LENGTH = 16
_FIRST, _UNKNOWN = -1, -2
_LENGTH = seeded(64, 606)


@dataclass
class Vocabulary:
    """``ids`` and ``scores`` of the ordinary pieces, in the order of their hash ``keys``; ``bytes_ids`` for byte fallback
    (or the unknown id 256 times). ``merges`` is set for models that merge pairs (BPE)."""

    keys: np.ndarray
    ids: np.ndarray
    scores: np.ndarray
    longest: int
    byte_ids: np.ndarray
    text: list[bytes]
    prefix: bool
    merges: Merges | None = None
    known: Known | None = None
    #: For each start of a key (20 bits) whether a piece has it; most substrings are ruled out here.
    starts: np.ndarray | None = None

    def __post_init__(self):
        self.starts = np.zeros(1 << 20, bool)
        self.starts[self.keys >> np.uint64(44)] = True

    def __getstate__(self):
        return self.__dict__ | {"known": None}


@dataclass
class Known:
    """Words that this task's process has encoded: ascending hashes, and where their ids stand in ``ids``."""

    hashes: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    ids: np.ndarray


#: Beyond so many words a process starts anew.
KNOWN_WORDS = 1 << 17


#: The rank of what never merges.
NEVER = np.iinfo(np.int32).max


@dataclass
class Merges:
    """What decides whether two pieces can stand side by side in a merged sequence.

    ``right`` and ``left`` are each piece's last and first parts while it is put together, from the character to the
    whole piece, filled up with -1; ``right_end`` and ``left_end`` tell by which merge (its rank) the part is used up.
    ``pairs`` are the ascending codes of two parts that merge, ``ranks`` the ranks of these merges.
    """

    usable: np.ndarray
    right: np.ndarray
    right_end: np.ndarray
    left: np.ndarray
    left_end: np.ndarray
    pairs: np.ndarray
    ranks: np.ndarray
    seen: np.ndarray = field(default_factory=lambda: np.full(1 << 20, -1, np.int64))
    fine: np.ndarray = field(default_factory=lambda: np.zeros(1 << 20, bool))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("seen", "fine")}

    def __setstate__(self, state):
        self.__dict__ |= state | {"seen": np.full(1 << 20, -1, np.int64), "fine": np.zeros(1 << 20, bool)}

    def side_by_side(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the text of a and b leaves just these two pieces; answers are remembered by a code of the two."""
        code = a.astype(np.int64) * len(self.usable) + b
        slot = ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        out, new = self.fine[slot], self.seen[slot] != code
        if new.any():
            codes, inverse = np.unique(code[new], return_inverse=True)
            fine = np.concatenate([self._test(*np.divmod(codes[k : k + 4_000], len(self.usable))) for k in range(0, len(codes), 4_000)])
            out[new] = fine[inverse]
            self.seen[slot[new]], self.fine[slot[new]] = code[new], out[new]
        return out

    def _test(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        # a part at the end of a and one at the start of b merge if no merge of their own comes first; of equal ones the left comes first
        r, re, l, le = self.right[a][:, :, None], self.right_end[a][:, :, None], self.left[b][:, None, :], self.left_end[b][:, None, :]
        code = np.where((r >= 0) & (l >= 0), r.astype(np.int64) * len(self.usable) + l, -1)
        at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        rank = np.where(self.pairs[at] == code, self.ranks[at], NEVER)
        return ~((rank < re) & (rank <= le) & (rank < NEVER)).any(axis=(1, 2))


def merge_tree(word: str, rank: dict[str, int]) -> tuple | None:
    """The merges that put ``word`` together from its characters, as nested pairs of (part, left, right); None if it falls into several parts."""
    parts: list[tuple] = [(c, None, None) for c in word]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: (rank.get(parts[i][0] + parts[i + 1][0], 1 << 60), i))
        joined = parts[best][0] + parts[best + 1][0]
        if joined not in rank:
            return None
        parts[best : best + 2] = [(joined, parts[best], parts[best + 1])]
    return parts[0]


def make_merges(pieces: list[str], scores: np.ndarray) -> Merges:
    """From the pieces in the order of their keys: a higher score merges first."""
    index = {p: k for k, p in enumerate(pieces)}
    order = np.empty(len(pieces), np.int64)
    order[np.lexsort((np.arange(len(pieces)), -scores))] = np.arange(len(pieces))
    rank = {p: int(order[k]) for p, k in index.items()}
    chains: list[list[list[tuple[int, int]]]] = [[], []]
    usable = np.zeros(len(pieces), bool)
    for k, p in enumerate(pieces):
        tree = merge_tree(p, rank)
        usable[k] = tree is not None
        for side in (0, 1):  # 0: last parts, 1: first parts
            chain, node, end = [], tree, NEVER
            while node is not None:
                if node[0] in index:
                    chain.append((index[node[0]], end))
                end, node = rank.get(node[0], NEVER), node[2 - side]
            chains[side].append(chain)
    depth = max(len(c) for side in chains for c in side)
    tables = []
    for side in chains:
        part, end = np.full((len(pieces), depth), -1, np.int32), np.zeros((len(pieces), depth), np.int32)
        for k, chain in enumerate(side):
            for j, (x, e) in enumerate(chain):
                part[k, j], end[k, j] = x, e
        tables += [part, end]
    pairs = sorted((index[p[:i]] * len(pieces) + index[p[i:]], rank[p]) for p in pieces for i in range(1, len(p)) if p[:i] in index and p[i:] in index)
    return Merges(usable, *tables, np.array([c for c, _ in pairs] or [-2], np.int64), np.array([r for _, r in pairs] or [NEVER], np.int32))


def piece_key(points: np.ndarray) -> np.ndarray:
    """Keys of all rows of equal length."""
    return substring_keys(prefix_sums(points), points.shape[1])[:, 0]


def prefix_sums(points: np.ndarray) -> np.ndarray:
    power, _ = power_tables(points.shape[1])
    sums = np.zeros((len(points), points.shape[1] + 1), np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(mix64(points.astype(np.uint64) + np.uint64(1)) * power[: points.shape[1]], axis=1, out=sums[:, 1:])
    return sums


def substring_keys(sums: np.ndarray, m: int) -> np.ndarray:
    """Keys of the substrings of m characters, by start."""
    _, inverse = power_tables(sums.shape[1])
    with np.errstate(over="ignore"):
        return mix64((sums[:, m:] - sums[:, :-m]) * inverse[: sums.shape[1] - m] + _LENGTH[m])


def probe(vocabulary: Vocabulary, sums: np.ndarray, m: int) -> np.ndarray:
    """The piece of each substring of m characters, or -1."""
    h = substring_keys(sums, m)
    out = np.full(h.shape, -1, np.int32)
    likely = vocabulary.starts[h >> np.uint64(44)]
    h = h[likely]
    at = np.minimum(np.searchsorted(vocabulary.keys, h), len(vocabulary.keys) - 1)
    found = vocabulary.keys[at] == h
    if vocabulary.merges is not None:
        found &= vocabulary.merges.usable[at]
    out[likely] = np.where(found, at, -1)
    return out


def best_lengths(vocabulary: Vocabulary, points: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(back, pieces): the length of the last piece of the best segmentation up to each end; the pieces found by length and start.

    All words (rows of characters) advance together. A character that is no piece is an unknown piece of its own. For merging
    models a piece can follow the one before only if merging leaves both; for each end one last piece remains.
    """
    n, length = points.shape
    sums = prefix_sums(points)
    pieces = [probe(vocabulary, sums, m) for m in range(1, min(vocabulary.longest, length) + 1)]
    unknown = float(vocabulary.scores.min(initial=0.0)) - 10.0
    best = np.full((n, length + 1), -np.inf)
    best[:, 0] = 0
    back = np.zeros((n, length + 1), np.int32)
    last = np.full((n, length + 1), _FIRST, np.int32)
    any_piece = [(p >= 0).any(axis=0) for p in pieces]
    for j in range(1, length + 1):
        for m in range(1, min(j, len(pieces)) + 1):
            if m > 1 and not any_piece[m - 1][j - m]:
                continue
            p = pieces[m - 1][:, j - m]
            fits = (p >= 0) & (back[:, j - m] > 0) if j > m else p >= 0
            if m == 1:
                fits = fits | (p < 0)
            rows = np.flatnonzero(fits)
            if not len(rows):
                continue
            p, before = p[rows], last[rows, j - m]
            if vocabulary.merges is not None:
                check = np.flatnonzero((p >= 0) & (before >= 0))
                if len(check):
                    good = np.ones(len(rows), bool)
                    good[check] = vocabulary.merges.side_by_side(before[check], p[check])
                    rows, p = rows[good], p[good]
                value = np.full(len(rows), float(m))
            else:
                value = best[rows, j - m] + np.where(p >= 0, vocabulary.scores[p], unknown)
            better = value > best[rows, j]
            rows, p = rows[better], p[better]
            best[rows, j], back[rows, j], last[rows, j] = value[better], m, np.where(p >= 0, p, _UNKNOWN)
    return back, pieces


def encode_equal(vocabulary: Vocabulary, points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, offsets) of words, rows of characters of which the first ``sizes`` count: piece ids, or ``-1 - character`` for
    unknown ones."""
    n, length = points.shape
    back, pieces = best_lengths(vocabulary, points)
    out, used, at, rows = np.zeros((n, length), np.int64), np.zeros(n, np.int64), sizes.copy(), np.arange(n)
    while len(rows):
        m = back[rows, at[rows]]
        start = at[rows] - m
        p = np.stack([x[rows, np.minimum(start, x.shape[1] - 1)] for x in pieces], 1)[np.arange(len(rows)), m - 1]
        out[rows, length - 1 - used[rows]] = np.where(p >= 0, vocabulary.ids[p], -1 - points[rows, start].astype(np.int64))
        used[rows] += 1
        at[rows] = start
        rows = rows[start > 0]
    return out[np.arange(length)[None, :] >= length - used[:, None]], np.concatenate([[0], np.cumsum(used)])


def spread(offs: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, offsets) that copy the runs ``take`` of a list with offsets ``offs`` one after the other."""
    sizes = np.diff(offs)[take]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return np.repeat(offs[take] - ends[:-1], sizes) + np.arange(ends[-1]), ends


def encode_words(vocabulary: Vocabulary, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of words given as UTF-8, a space standing for the space mark; unknown characters fall back to bytes."""
    points = np.frombuffer(data.tobytes().decode("utf-8").replace(" ", SPACE).encode("utf-32-le"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    offs = lead[offs]
    sizes = np.diff(offs)
    parts, owner = [], []
    wide = np.where(sizes <= SAME_LENGTH, sizes, 0)
    for k in np.flatnonzero(sizes > SAME_LENGTH):
        power = 1 << int(sizes[k] - 1).bit_length()
        wide[k] = power * 3 // 4 if sizes[k] <= power * 3 // 4 else power
    points = np.concatenate([points, np.zeros(int(wide.max(initial=0)), np.uint32)])
    for length in np.unique(wide[sizes > 0]):
        group = np.flatnonzero(wide == length)
        step = max(1, (1 << 19) // (int(length) * min(int(length), vocabulary.longest)))
        for k in range(0, len(group), step):
            rows = group[k : k + step]
            column = np.arange(length)
            letters = np.where(column < sizes[rows][:, None], points[offs[rows][:, None] + column], 0).astype(np.uint32)
            tokens, ends = encode_equal(vocabulary, letters, sizes[rows])
            parts.append((tokens, np.diff(ends)))
            owner.append(rows)
    count = np.zeros(len(sizes), np.int64)
    if not parts:
        return np.zeros(0, np.int32), np.concatenate([[0], np.cumsum(count)])
    tokens, order = np.concatenate([t for t, _ in parts]), np.concatenate(owner)
    count[order] = np.concatenate([c for _, c in parts])
    runs = np.concatenate([[0], np.cumsum(count[order])])
    place = np.empty(len(order), np.int64)
    full = np.full(len(sizes), -1)
    place = np.arange(len(order))
    full[order] = place
    pick, ends = spread(runs, full[full >= 0])
    tokens = tokens[pick]
    ends = np.concatenate([[0], np.cumsum(count)])
    odd = np.flatnonzero(tokens < 0)
    if len(odd):
        point = -1 - tokens[odd]
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in point.tolist()]
        if len(set(vocabulary.byte_ids.tolist())) == 1:
            raw = [b"\0"] * len(raw)
        size = np.ones(len(tokens), np.int64)
        size[odd] = [len(b) for b in raw]
        moved = np.concatenate([[0], np.cumsum(size)])
        wide = np.repeat(tokens, size)
        wide[np.concatenate([np.arange(moved[i], moved[i + 1]) for i in odd])] = vocabulary.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        tokens, ends = wide, moved[ends]
    return tokens.astype(np.int32), ends


def encode_texts(vocabulary: Vocabulary, column) -> list[tuple[np.ndarray, np.ndarray]]:
    """``encode_runs``, all at once."""
    return list(encode_runs(vocabulary, column))


def encode_runs(vocabulary: Vocabulary, column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of texts: (ids, offsets). Words, cut before each run of spaces, are encoded once for each run of texts."""
    for at, end, data, offs in text_chunks(column):
        raw = data.tobytes()
        if SPACE.encode() in raw:  # the mark itself is read as a space
            texts = [raw[a:b].replace(SPACE.encode(), b" ") for a, b in zip(offs[:-1], offs[1:], strict=True)]
            data, offs = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        full = np.diff(offs) > 0
        if vocabulary.prefix:
            shift = np.concatenate([[0], np.cumsum(full)])
            wide = np.full(len(data) + shift[-1], 32, np.uint8)
            wide[np.arange(len(data)) + np.repeat(shift[1:], np.diff(offs))] = data
            data, offs = wide, offs + shift
        space = data == 32
        cut = space & ~np.concatenate([[False], space[:-1]])
        cut[offs[:-1][full]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        hashes, first, inverse = np.unique(span_hashes(data, starts, ends, fold=False), return_index=True, return_inverse=True)
        known = learn(vocabulary, data, np.append(starts, len(data)), hashes, first)
        place = np.searchsorted(known.hashes, hashes)[inverse]
        sizes = known.sizes[place]
        runs = np.concatenate([[0], np.cumsum(sizes)])
        take = np.repeat(known.starts[place] - runs[:-1], sizes) + np.arange(runs[-1])
        yield known.ids[take], runs[np.searchsorted(starts, offs)]


def learn(vocabulary: Vocabulary, data: np.ndarray, cuts: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> Known:
    """The known words with those of ``hashes`` (ascending, word number ``first`` of ``cuts``) that weren't yet."""
    old = vocabulary.known
    if old is None or len(old.hashes) > KNOWN_WORDS:
        old = Known(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))
    at = np.searchsorted(old.hashes, hashes)
    new = np.ones(len(hashes), bool) if not len(old.hashes) else old.hashes[np.minimum(at, len(old.hashes) - 1)] != hashes
    if new.any():
        pick, offs = spread(cuts, first[new])
        ids, ends = encode_words(vocabulary, data[pick], offs)
        joined = np.concatenate([old.hashes, hashes[new]])
        turn = np.argsort(joined, kind="stable")
        old = Known(joined[turn], np.concatenate([old.starts, ends[:-1] + len(old.ids)])[turn], np.concatenate([old.sizes, np.diff(ends)])[turn], np.concatenate([old.ids, ids]))
    vocabulary.known = old
    return old


def decode_ids(vocabulary: Vocabulary, ids: np.ndarray, offs: np.ndarray, run: int = 1 << 18) -> list[str]:
    """The texts of lists of ids. Bytes that don't make UTF-8 become U+FFFD; the leading space of a prefix is dropped.

    Lists are decoded in runs of about ``run`` ids.
    """
    sizes = np.array([len(t) for t in vocabulary.text])
    table, starts = np.frombuffer(b"".join(vocabulary.text), np.uint8), np.concatenate([[0], np.cumsum(sizes)])
    lead, out, at, n = 1 if vocabulary.prefix else 0, [], 0, len(offs) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + run, "right")) - 1)
        take, runs = spread(starts, ids[offs[at] : offs[end]])
        raw, cuts = table[take].tobytes(), runs[offs[at : end + 1] - offs[at]]
        out += [raw[a + (lead if raw[a : a + 1] == b" " else 0) : b].decode("utf-8", "replace") for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        at = end
    return out
