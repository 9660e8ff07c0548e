"""Language-model scores: prediction by partial matching over byte contexts, beside a unigram baseline."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlint_spark.llm.common import count_class, cut_lineage, map_batches, span_hashes, text_chunks, word_spans

#: Bytes that UTF-8 never has: before the text, and its end.
START, END = 0xFE, 0xFF
#: Hash of the token that ends a document; words hash to other values but for chance.
END_TOKEN = np.uint64(0x5EED0FE2DA71E57D)


#: The class of 1, the least of all counts.
LEAST_CLASS = 24


# ---------------------------------------------------------------- counting


def context_keys(data: np.ndarray, offs: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, offsets): for each byte of each text and for its end, ``order`` bytes of context and the byte, as one number."""
    n, texts = len(data), len(offs) - 1
    lead = (order + 1) * np.arange(texts + 1)
    wide = np.full(n + (order + 1) * texts, START, np.uint8)
    wide[np.arange(n) + np.repeat(lead[:-1] + order, np.diff(offs))] = data
    wide[offs[1:] + lead[1:] - 1] = END
    keys = np.zeros(len(wide), np.uint64)
    for k in range(order + 1):
        keys[order:] |= wide[k : len(wide) - order + k].astype(np.uint64) << np.uint64(8 * (order - k))
    symbol = np.ones(len(wide), bool)
    for k in range(order):
        symbol[offs[:-1] + lead[:-1] + k] = False
    return keys[symbol], offs + np.arange(texts + 1)


def token_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the words of each text and its end token."""
    starts, ends, first = word_spans(data, offs)
    h = np.insert(span_hashes(data, starts, ends), first[1:], END_TOKEN)
    return h, first + np.arange(len(first))


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    keys, n = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    parts.clear()
    turn = np.argsort(keys)
    keys, n = keys[turn], n[turn]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(n, first)


def counts(docs: DataFrame, order: int) -> DataFrame:
    """(kind, key, n): occurrences of contexts with their symbol (kind 0) and of tokens (kind 1) in all of ``docs`` (text).

    A partition adds up its own texts first, as long as it holds at most some 2 ** 20 different keys of a kind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], []]

        def flush(kind: int) -> Iterator[pa.RecordBatch]:
            keys, n = _added(held[kind])
            held[kind] = []
            for a in range(0, len(keys), 1 << 16):
                part = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[part]), kind, np.int8)), pa.array(keys[part].view(np.int64)), pa.array(n[part])], names=["kind", "key", "n"])

        for batch in batches:
            for _, _, data, offs in text_chunks(batch.column("text")):
                held[0].append(np.unique(context_keys(data, offs, order)[0], return_counts=True))
                held[1].append(np.unique(token_hashes(data, offs)[0], return_counts=True))
                for kind in (0, 1):
                    if sum(len(k) for k, _ in held[kind]) > 1 << 21:
                        held[kind] = [_added(held[kind])]
                        if len(held[kind][0][0]) > 1 << 20:
                            yield from flush(kind)
        for kind in (0, 1):
            if held[kind]:
                yield from flush(kind)

    return map_batches(docs.select("text"), run, "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def least_class(df: DataFrame, n: str, weight: str, most: int) -> int:
    """The least class of ``n`` from which on the summed ``weight`` stays within ``most``; one above all where even the
    highest class is more."""
    rows = df.groupBy(count_class(F.col(n)).alias("class")).agg(F.sum(weight).alias("w")).collect()  # some 500 classes
    total, least = 0, 1 << 20
    for r in sorted(rows, key=lambda r: -r["class"]):
        total += r["w"]
        if total > most:
            break
        least = r["class"]
    return least


# ---------------------------------------------------------------- the model


@dataclass(frozen=True)
class Level:
    """Contexts of one length. ``cells`` (context and symbol) and contexts are ascending; ``n`` is a cell's count less a half,
    ``kinds`` half the number of a context's symbols, and ``shared`` what its shorter context has of these symbols,
    which exclusion takes away there together with ``kinds``."""

    cells: np.ndarray
    n: np.ndarray
    contexts: np.ndarray
    total: np.ndarray
    kinds: np.ndarray
    shared: np.ndarray


def _level(cells: np.ndarray, n: np.ndarray, shorter: np.ndarray | None) -> Level:
    """A level of ascending cells and their counts; ``shorter`` has the ``n`` of each cell without its first byte."""
    contexts, first = np.unique(cells >> np.uint64(8), return_index=True)
    n = n - 0.5
    kinds = 0.5 * np.diff(np.append(first, len(cells)))
    total = np.add.reduceat(n, first) if len(first) else np.zeros(0)
    shared = np.add.reduceat(shorter, first) if shorter is not None and len(first) else np.zeros(len(contexts))
    return Level(cells, n, contexts, total, kinds, shared)


def make_levels(tables: list[tuple[np.ndarray, np.ndarray]]) -> list[Level]:
    """The trie from (cells, counts) of the orders 0, 1, ..., each ascending and closed under dropping the first byte."""
    levels: list[Level] = []
    for order, (cells, n) in enumerate(tables):
        short = cells & np.uint64((1 << (8 * order)) - 1)
        levels.append(_level(cells, n, levels[-1].n[np.searchsorted(levels[-1].cells, short)] if order and len(cells) else None))
    return levels


def _entries(level: Level, key: np.ndarray) -> tuple[np.ndarray, ...]:
    """(context known, cell seen, n, total, kinds, shared) of each key; what isn't there is 0, and n is 1."""
    if not len(level.contexts):
        none = np.zeros(len(key), bool)
        return none, none.copy(), np.ones(len(key)), np.zeros(len(key)), np.zeros(len(key)), np.zeros(len(key))
    at = np.minimum(np.searchsorted(level.contexts, key >> np.uint64(8)), len(level.contexts) - 1)
    known = level.contexts[at] == key >> np.uint64(8)
    cell = np.minimum(np.searchsorted(level.cells, key), len(level.cells) - 1)
    seen = level.cells[cell] == key
    return known, seen, np.where(seen, level.n[cell], 1.0), *(np.where(known, x[at], 0.0) for x in (level.total, level.kinds, level.shared))


def _whole_entries(levels: list[Level], rare: dict[int, Level], order: int, key: np.ndarray) -> tuple[np.ndarray, ...]:
    """``_entries`` of the frequent contexts, and of the rare ones where those lack the context."""
    found = _entries(levels[order], key)
    if order in rare:
        absent = np.flatnonzero(~found[0])
        for whole, part in zip(found, _entries(rare[order], key[absent]), strict=True):
            whole[absent] = part
    return found


def rare_levels(levels: list[Level], least_order: int, cells: np.ndarray, n: np.ndarray) -> dict[int, Level]:
    """The levels from ``least_order`` on that the rare cells of the longest order (ascending) make, beside the frequent ``levels``.

    ``cells`` must have all rare ones of each end of ``least_order`` bytes that it has. A context that ``levels`` has may
    be in part here, and ``levels`` goes first; any other is whole, for what a rare context follows is rare.
    """
    tables = {len(levels) - 1: (cells, n)}
    for k in range(len(levels) - 2, least_order - 1, -1):
        tables[k] = np.unique(tables[k + 1][0] & np.uint64((1 << (8 * (k + 1))) - 1), return_counts=True)
    rare: dict[int, Level] = {}
    for k in sorted(tables):
        cells, n = tables[k]
        rare[k] = _level(cells, n, _whole_entries(levels, rare, k - 1, cells & np.uint64((1 << (8 * k)) - 1))[2])
    return rare


def log_probability(levels: list[Level], keys: np.ndarray, rare: dict[int, Level] | None = None) -> np.ndarray:
    """log10 P(symbol | context) for keys of the longest order.

    From the longest known context down: a symbol seen there has its share, its count less a half, and the halves are the
    escape's share (escape method D). An escape is paid for and excludes the symbols of its context further down. After
    the empty context the unseen bytes share alike.
    """
    out, open_ = np.zeros(len(keys)), np.arange(len(keys))
    less, less_kinds = np.zeros(len(keys)), np.zeros(len(keys))
    for order in range(len(levels) - 1, -1, -1):
        if not len(open_):
            break
        known, seen, n, total, kinds_, shared = _whole_entries(levels, rare or {}, order, keys[open_] & np.uint64((1 << (8 * (order + 1))) - 1))
        kinds = np.where(known, kinds_ - less_kinds[open_], 0.0)
        all_ = np.where(known, total - less[open_], 0.0) + kinds
        out[open_[seen]] += np.log10(n[seen] / all_[seen])
        escape = known & ~seen & (kinds > 0)
        out[open_[escape]] += np.log10(kinds[escape] / all_[escape])
        less[open_[known]], less_kinds[open_[known]] = shared[known], kinds_[known]
        open_ = open_[~seen]
    out[open_] -= np.log10(max(256 - len(levels[0].cells), 1))
    return out


@dataclass(frozen=True)
class Model:
    order: int
    #: Frequent contexts, whole; from ``rare_from`` bytes on there are others, which are looked up by their ends.
    levels: list[Level]
    rare_from: int | None
    #: Frequent tokens (hash ascending, count); the others are looked up by a join.
    head: np.ndarray
    head_n: np.ndarray
    head_from: int
    train_tokens: int
    train_kinds: int


def train(docs: DataFrame, order: int, max_cells: int, max_head: int) -> tuple[Model, DataFrame, DataFrame]:
    """The model of all texts of ``docs`` (text), the table of all token counts (key, n), and that of the rare cells (key, n).

    Every text counts. ``max_cells`` bounds what is sent to the tasks: of each order the most frequent contexts, whole,
    down to the least class of counts at which their cells fit, none if not even the highest fits. The cells of the longest
    order whose contexts are not sent are the rare ones; those of shorter contexts follow from them. ``max_head`` bounds the tokens that are sent.
    """
    seen = cut_lineage(counts(docs, order))
    tokens = seen.filter("kind = 1").select("key", "n")
    # n: occurrences in the longest order; below it the number of one byte longer contexts that the cell follows
    cells = [seen.filter("kind = 0").select("key", "n", F.col("n").alias("times"))]
    for k in range(order - 1, -1, -1):
        short = F.col("key").bitwiseAND(F.lit((1 << (8 * (k + 1))) - 1))
        cells.insert(0, cut_lineage(cells[0].groupBy(short.alias("key")).agg(F.count("*").alias("n"), F.sum("times").alias("times"))))
    tables, least, rare_from, rare = [], 0, None, cells[-1].select("key", "n").limit(0)
    for k, table in enumerate(cells):
        kept, context = table, F.shiftright("key", 8)
        if k > 1:  # orders 0 and 1 have 2 ** 16 cells at most
            contexts = table.groupBy(context.alias("context")).agg(F.sum("times").alias("total"), F.count("*").alias("cells"))
            # a context is at most as frequent as its end, which is then kept too
            least = max(least, least_class(contexts, "total", "cells", max_cells))
            if least > LEAST_CLASS:
                kept = table.join(contexts.filter(count_class(F.col("total")) >= least), context == F.col("context"), "left_semi")
                rare_from = k if rare_from is None else rare_from
                rare = table.join(contexts.filter(count_class(F.col("total")) < least), context == F.col("context"), "left_semi").select("key", "n")
        got = kept.select("key", "n").toArrow()
        keys, n = got.column("key").to_numpy().view(np.uint64), got.column("n").to_numpy()
        turn = np.argsort(keys)
        tables.append((keys[turn], n[turn]))
    sums = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    head_from = least_class(tokens.withColumn("one", F.lit(1)), "n", "one", max_head)
    head = tokens.filter(count_class(F.col("n")) >= head_from).toArrow()
    keys, n = head.column("key").to_numpy().view(np.uint64), head.column("n").to_numpy()
    turn = np.argsort(keys)
    return Model(order, make_levels(tables), rare_from, keys[turn], n[turn], head_from, int(sums["n"]), int(sums["v"])), tokens, rare


# ---------------------------------------------------------------- scoring


def _counted(owner: np.ndarray, keys: np.ndarray, texts: int) -> pa.ListArray:
    """For each text the distinct keys that it owns, and how often."""
    turn = np.lexsort((keys, owner))
    owner, keys = owner[turn], keys[turn]
    first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(keys)))
    cuts = np.searchsorted(owner[first], np.arange(texts + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays([pa.array(keys[first].view(np.int64)), pa.array(times)], ["key", "times"]))


def score_texts(model: Model, column: pa.Array) -> Iterator[tuple]:
    """For runs of texts: (first, end, tokens, known tokens and sum of log10(count + 1) of the head, score of the keys with
    frequent contexts, the tail's tokens, the other keys)."""
    for at, end, data, offs in text_chunks(column, 1 << 20):
        keys, cuts = context_keys(data, offs, model.order)
        distinct, inverse = np.unique(keys, return_inverse=True)
        here = np.ones(len(distinct), bool)
        if model.rare_from is not None:
            here = _entries(model.levels[-1], distinct)[0]
        worth = np.zeros(len(distinct))
        worth[here] = log_probability(model.levels, distinct[here])
        score = np.add.reduceat(worth[inverse], cuts[:-1])
        rest = np.flatnonzero(~here[inverse])
        rare = _counted(np.searchsorted(cuts, rest, "right") - 1, keys[rest], end - at)
        h, cuts = token_hashes(data, offs)
        n = np.diff(cuts)
        place = np.minimum(np.searchsorted(model.head, h), max(len(model.head) - 1, 0))
        inside = model.head[place] == h if len(model.head) else np.zeros(len(h), bool)
        worth = np.where(inside, np.log10(model.head_n[place] + 1.0), 0.0) if len(model.head) else np.zeros(len(h))
        known = np.add.reduceat(inside.astype(np.int64), cuts[:-1])
        total = np.add.reduceat(worth, cuts[:-1])
        rest = np.flatnonzero(~inside)
        yield at, end, n, known, total, score, _counted(np.repeat(np.arange(end - at), n)[rest], h[rest], end - at), rare


def rare_scores(asked: DataFrame, cells: DataFrame, sent, rare_from: int) -> DataFrame:
    """(row, score): the summed log10 probabilities of the keys of ``asked`` (row, key, times), whose contexts the broadcast model lacks.

    Keys meet the rare cells (key, n) that have the same ``rare_from`` last bytes of context, so that every context of
    such a key that the model lacks is there, whole. Ends come in order, and some 2 ** 19 rows at a time are held.
    """
    mask = ((1 << (8 * rare_from)) - 1) << 8
    both = cells.select(F.lit(-1).cast("long").alias("row"), "key", F.col("n").alias("times")).unionByName(asked)

    def scored(row: np.ndarray, key: np.ndarray, times: np.ndarray) -> Iterator[pa.RecordBatch]:
        mine = row < 0
        if mine.all():
            return
        turn = np.argsort(key[mine])
        rare = rare_levels(sent.value.levels, rare_from, key[mine][turn], times[mine][turn])
        distinct, inverse = np.unique(key[~mine], return_inverse=True)
        rows, place = np.unique(row[~mine], return_inverse=True)
        worth = log_probability(sent.value.levels, distinct, rare)[inverse] * times[~mine]
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.bincount(place, worth, len(rows)))], names=["row", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, most = [], 0, 1 << 19
        for batch in batches:
            held.append([batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy()])
            size += batch.num_rows
            if size >= most:
                columns = [np.concatenate(c) for c in zip(*held, strict=True)]
                ends = columns[1] & np.uint64(mask)
                cut = int(np.searchsorted(ends, ends[-1]))  # the last end may go on
                yield from scored(*(c[:cut] for c in columns)) if cut else ()
                held, size = [[c[cut:] for c in columns]], size - cut
                most = max(1 << 19, 2 * size)
        if held:
            yield from scored(*(np.concatenate(c) for c in zip(*held, strict=True)))

    end = F.col("key").bitwiseAND(F.lit(mask))
    return map_batches(both.repartition(end).sortWithinPartitions(end), run, "row long, score double")


def lm_scores(docs: DataFrame, may_learn, order: int = 5, max_cells: int = 1 << 21, max_head: int = 1 << 19) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs`` (doc_id, text).

    ``score`` is the log10 probability of the text's bytes and its end under a PPM model (escape method D, update and symbol
    exclusion, contexts of at most ``order`` bytes) of all rows that ``may_learn`` (a function of the doc_id column) marks.
    ``base_score`` is that of its tokens, words lower-cased (A-Z) and one end, under add-one smoothed unigram counts.
    Frequent contexts and tokens are looked up in the tasks, all others joined with the counts of all training texts, so
    ``max_cells`` and ``max_head`` decide where, not what is found. Both scores are exact but for 64-bit hashes standing for words.

    Null, empty and blank texts have one token, the end. Repeated rows are scored alike and each counts in training. Without
    training rows all bytes are alike and no token is known. No rows give no rows; other columns are ignored.
    Very long texts are read whole, in memory in proportion to the longest.
    """
    model, tokens, cells = train(docs.filter(may_learn(F.col("doc_id"))), order, max_cells, max_head)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, n, known, total, score, tail, rare in score_texts(sent.value, batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(at, end - at), batch.column("doc_id").slice(at, end - at), pa.array(n), pa.array(known), pa.array(total), pa.array(score), tail, rare], names=["row", "doc_id", "n_tokens", "known", "total", "score", "tail", "rare"])

    pairs = "array<struct<key:long,times:long>>"
    found = cut_lineage(map_batches(rows, run, f"row long, doc_id long, n_tokens long, known long, total double, score double, tail {pairs}, rare {pairs}"))
    rest = found.select("row", F.inline("tail")).join(tokens.filter(count_class(F.col("n")) < model.head_from), "key")
    rest = rest.select("row", F.col("times").alias("more"), (F.col("times") * F.log10(F.col("n") + 1)).alias("added"), F.lit(0.0).alias("rare_score"))
    if model.rare_from is not None:
        rare = rare_scores(found.select("row", F.inline("rare")), cells, sent, model.rare_from)
        rest = rest.unionByName(rare.select("row", F.lit(0).cast("long").alias("more"), F.lit(0.0).alias("added"), F.col("score").alias("rare_score")))
    rest = rest.groupBy("row").agg(*(F.sum(c).alias(c) for c in ("more", "added", "rare_score")))
    joined = found.drop("tail", "rare").join(rest, "row", "left")
    return joined.select(
        "doc_id",
        (~may_learn(F.col("doc_id"))).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("total") + F.coalesce("added", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(model.train_tokens + model.train_kinds + 1))).alias("base_score"),
        (F.col("score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"),
    )
