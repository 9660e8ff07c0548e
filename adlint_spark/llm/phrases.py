"""Phrase collocations: Misra-Gries summaries find every frequent n-gram, a second pass counts them exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from adlint_spark.llm.common import cut_lineage, map_batches, mix64, seeded, span_hashes, text_chunks

UNKNOWN = "und"
#: Bits of the filter that tells tasks which n-grams may be frequent; more n-grams than it can tell apart cost time, no results.
FILTER_BITS = 26
#: Hash partitions of the n-grams; several may share a task.
BUCKETS = 1024
#: Distinct n-grams that a task holds before it sends their counts.
HELD = 1 << 20
_SPACE, _BREAK = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[9, 32]] = True
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_SEED = seeded(4, 1313) | np.uint64(1)  # odd factors


class Chunk:
    """Words of some texts: where they are, their texts' languages, and the hashes of the n-grams that begin at each."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, lang: np.ndarray, lang_seed: np.ndarray):
        n = len(data)
        breaks = _BREAK[data]
        inside = np.zeros(n + 2, bool)
        np.logical_not(_SPACE[data] | breaks, out=inside[1:-1])
        cut = np.zeros(n + 1, bool)
        cut[offs] = True
        here, before = inside[1:], inside[:-1]
        self.data = data
        self.starts, self.ends = np.flatnonzero(here & (~before | cut)), np.flatnonzero(before & (~here | cut))
        cut[:n] |= breaks
        self.piece = np.cumsum(cut)[self.starts]
        self.lang = np.repeat(lang, np.diff(np.searchsorted(self.starts, offs)))
        with np.errstate(over="ignore"):
            self.word = mix64(span_hashes(data, self.starts, self.ends) ^ lang_seed[self.lang])

    def grams(self, hashes: np.ndarray, order: int) -> np.ndarray:
        """Hashes of the n-grams of ``order`` from those of the order below; those of the last words and across pieces mean nothing."""
        with np.errstate(over="ignore"):
            return mix64(hashes[: max(len(self.word) - order + 1, 0)] * _SEED[0] + self.word[order - 1 :])

    def whole(self, order: int) -> np.ndarray:
        return self.piece[order - 1 :] == self.piece[: max(len(self.piece) - order + 1, 0)]

    def spell(self, at: np.ndarray, order: int) -> pa.Array:
        """The n-grams that begin at these words, in lower case, their words with single spaces between."""
        lower = self.data.copy()
        upper = (lower >= 65) & (lower <= 90)
        lower[upper] += 32
        need = (at[:, None] + np.arange(order)).ravel()
        starts, ends = self.starts[need], self.ends[need]
        # each word and one byte after it; a space takes that byte's place, or nothing at an n-gram's end
        size = ends - starts + 1
        to = np.concatenate([[0], np.cumsum(size)])
        source = np.repeat(starts - to[:-1], size) + np.arange(to[-1])
        out = lower[np.minimum(source, len(lower) - 1)] if len(lower) else lower
        out[to[1:] - 1] = 32
        bounds = to[::order].copy()
        keep = np.ones(len(out), bool)
        keep[bounds[1:] - 1] = False
        bounds -= np.arange(len(bounds))
        return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(out[keep]))])


def chunks_of(batch: pa.RecordBatch, code: dict[str, int]) -> Iterator[Chunk]:
    """The texts of a batch in runs; ``code`` numbers the languages met so far."""
    lang = batch.column("lang").fill_null(UNKNOWN).dictionary_encode()
    numbers = np.array([code.setdefault(x, len(code)) for x in lang.dictionary.to_pylist()], np.int64)
    rows = numbers[lang.indices.to_numpy()] if len(numbers) else np.zeros(0, np.int64)
    names = pa.array(list(code), pa.string())
    data = np.frombuffer("\0".join(code).encode(), np.uint8)
    ends = np.cumsum(pc.binary_length(names).to_numpy() + 1) - 1
    seed = span_hashes(data, np.concatenate([[0], ends[:-1] + 1]), ends, fold=False) if code else np.zeros(0, np.uint64)
    for at, end, text, offs in text_chunks(batch.column("text")):
        yield Chunk(text, offs, rows[at:end], seed)


def filter_slots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return h >> np.uint64(64 - bits), (h * _SEED[1]) >> np.uint64(64 - bits)


def may_have(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes the filter may hold."""
    bits = int(len(words) * 64).bit_length() - 1
    out = np.ones(len(h), bool)
    for slot in filter_slots(h, bits):
        out &= (words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
    return out


class Tally:
    """Counts of hashes, compacted from time to time."""

    def __init__(self, most: int = 1 << 21):
        self.held, self.size, self.most = [], 0, most

    def add(self, h: np.ndarray, n: np.ndarray | None = None) -> None:
        if len(h):
            self.held.append((h, np.ones(len(h), np.int64) if n is None else n))
            self.size += len(h)

    def compact(self) -> tuple[np.ndarray, np.ndarray]:
        h = np.concatenate([np.zeros(0, np.uint64), *(x for x, _ in self.held)])
        order = np.argsort(h)
        h = h[order]
        n = np.concatenate([np.zeros(0, np.int64), *(x for _, x in self.held)])[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        h, n = h[first], np.add.reduceat(n, first) if len(h) else n
        self.held, self.size = [(h, n)], len(h)
        return h, n

    def full(self) -> bool:
        return self.size >= self.most


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(54)).astype(np.int64)


def gram_counts(docs: DataFrame, orders: tuple[int, ...], words: Broadcast | None, pairs: Broadcast | None) -> DataFrame:
    """(bucket, mass, keys, counts) of the n-grams of ``orders`` in ``docs`` (text, lang): for each run of a task and hash partition
    one row with the n-grams' next 32 bits and their counts in the run, as packed arrays; and for each task and hash partition
    one without them, whose ``mass`` is the sum of all its counts.

    With ``words``, a filter, n-grams with other words are left out; with ``pairs`` those with other pairs of words. N-grams that share 42 bits of
    their hash count as one, which lets more through, never less.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, mass, code = Tally(HELD), np.zeros(BUCKETS, np.int64), {}

        def out(everything: bool) -> Iterator[pa.RecordBatch]:
            h, n = tally.compact()
            if not everything and 2 * len(h) < tally.most:
                return
            tally.held, tally.size = [], 0
            cuts = np.searchsorted(_bucket(h), np.arange(BUCKETS + 1))
            used = np.flatnonzero(np.diff(cuts))
            sums = np.concatenate([[0], np.cumsum(n)])[cuts]
            mass[:] += np.diff(sums)
            keys, counts = (h >> np.uint64(22)).astype(np.uint32), np.minimum(n, (1 << 32) - 1).astype(np.uint32)
            pack = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(cuts[used], cuts[used + 1], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.nulls(len(used), pa.int64()), pack(keys), pack(counts)], names=["bucket", "mass", "keys", "counts"])

        for batch in batches:
            for chunk in chunks_of(batch, code):
                grams, fit = chunk.word, np.ones(len(chunk.word), bool)
                if words is not None:
                    fit = may_have(words.value, short(chunk.word))
                for order in range(1, max(orders) + 1):
                    if order > 1:
                        grams, whole = chunk.grams(grams, order), chunk.whole(order)
                        fit = fit[: len(grams)] & fit[1 : len(grams) + 1] & whole
                        if order == 2 and pairs is not None:
                            at = np.flatnonzero(fit)
                            fit[at] = may_have(pairs.value, short(grams[at]))
                    if order in orders:
                        tally.add(short(grams[fit]))
                if tally.full():
                    yield from out(False)
        yield from out(True)
        used = np.flatnonzero(mass)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(mass[used]), pa.nulls(len(used), pa.binary()), pa.nulls(len(used), pa.binary())], names=["bucket", "mass", "keys", "counts"])

    return map_batches(docs.select("text", "lang"), run, "bucket int, mass long, keys binary, counts binary")


def short(h: np.ndarray) -> np.ndarray:
    """The 42 bits of hashes that summaries go by, in place."""
    return h & np.uint64(0xFFFF_FFFF_FFC0_0000)


class MisraGries:
    """At most ``capacity`` counters. A key of mass above what all counters lost together keeps one; ``lost`` tells how much."""

    def __init__(self, capacity: int):
        self.capacity, self.lost, self.mass = capacity, 0, 0
        self.h, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merge(self, h: np.ndarray, n: np.ndarray, lost: int = 0) -> None:
        """Adds the counters of another summary, or plain counts."""
        tally = Tally()
        tally.add(self.h, self.n)
        tally.add(h, n)
        self.h, self.n = tally.compact()
        self.lost += lost
        self.mass += int(n.sum())
        if len(self.h) > self.capacity:
            least = int(np.partition(self.n, len(self.n) - self.capacity - 1)[len(self.n) - self.capacity - 1])
            self.lost += least
            left = self.n > least
            self.h, self.n = self.h[left], self.n[left] - least


def survivors(counts: DataFrame, least: int) -> DataFrame:
    """(h): of ``gram_counts`` every n-gram that occurs ``least`` times or more, and some others.

    Each hash partition, or several that share a task, has one summary, whose capacity exceeds its mass divided by ``least``, so it loses less than
    ``least`` of any n-gram. The masses come first.
    """
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = counts.repartition(parts, "bucket").sortWithinPartitions(F.col("mass").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass, summary, held = 0, None, Tally(1 << 19)
        for batch in batches:
            for bucket, own, keys, counts in zip(*(batch.column(k) for k in range(4)), strict=True):
                if own.is_valid:
                    mass += own.as_py()
                    continue
                summary = summary or MisraGries(mass // least + 1)
                held.add((np.uint64(bucket.as_py()) << np.uint64(54)) | (np.frombuffer(keys.as_buffer(), np.uint32).astype(np.uint64) << np.uint64(22)), np.frombuffer(counts.as_buffer(), np.uint32).astype(np.int64))
                if held.full():
                    summary.merge(*held.compact())
                    held = Tally(1 << 19)
        if summary is not None:
            summary.merge(*held.compact())
            yield pa.RecordBatch.from_arrays([pa.array(summary.h[summary.n + summary.lost >= least].view(np.int64))], names=["h"])

    return map_batches(rows, run, "h long")


def filter_of(kept: DataFrame, bits: int = FILTER_BITS) -> Broadcast:
    """A Bloom filter of the hashes, of fixed size, put together by Spark and sent to all tasks: 8 MB with 26 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = np.concatenate(filter_slots(batch.column("h").to_numpy().view(np.uint64), bits))
            yield pa.RecordBatch.from_arrays([pa.array((slots >> np.uint64(6)).astype(np.int32)), pa.array((np.uint64(1) << (slots & np.uint64(63))).view(np.int64))], names=["word", "bits"])

    rows = map_batches(kept, run, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return kept.sparkSession.sparkContext.broadcast(words)


def exact_counts(docs: DataFrame, most_words: int, filters: dict[int, Broadcast], least: int) -> DataFrame:
    """(lang, phrase, words, f) of all phrases of up to ``most_words`` words that occur ``least`` times or more, and the number of
    words of each language as the phrase of 0 words. ``filters`` by number of words, the last for all longer ones.

    Phrases are counted in runs of texts by two hashes, in tasks and over all by their text. They travel in blocks, one for each hash partition and run
    of a task. Their number is at most that of the words read, and grows faster than the input where phrases come to pass ``least``. A last task holds
    the phrases of its hash partitions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code: dict[str, int] = {}
        total: dict[int, int] = {}
        held: dict[int, pa.RecordBatch] = {}
        fresh: dict[int, list[pa.RecordBatch]] = {}
        size = 0

        def merge() -> None:
            for order, parts in fresh.items():
                held[order] = _merged([*([held[order]] if order in held else []), *parts], ["lang", "bucket", "phrase"])
            fresh.clear()

        def out() -> Iterator[pa.RecordBatch]:
            names = pa.array(list(code), pa.string())
            for order, rows in held.items():
                rows = rows.take(pc.sort_indices(rows.column("bucket")))
                used, cuts = np.unique(rows.column("bucket").to_numpy(), return_index=True)
                cuts = pa.array(np.append(cuts, len(rows)).astype(np.int32))
                columns = [names.take(rows.column("lang")), rows.column("phrase").cast(pa.string()), rows.column("n")]
                yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(np.full(len(used), order, np.int32)), *(pa.ListArray.from_arrays(cuts, c) for c in columns)], names=["bucket", "words", "langs", "phrases", "counts"])
            held.clear()

        for batch in batches:
            for chunk in chunks_of(batch, code):
                for k, n in enumerate(np.bincount(chunk.lang, minlength=len(code)).tolist()):
                    total[k] = total.get(k, 0) + n
                grams, fit = chunk.word, np.ones(len(chunk.word), bool)
                for order in range(1, most_words + 1):
                    if order > 1:
                        grams, whole = chunk.grams(grams, order), chunk.whole(order)
                        fit = fit[: len(grams)] & fit[1 : len(grams) + 1] & whole
                    at = np.flatnonzero(fit)
                    fit[at] = may_have(filters[min(order, max(filters))].value, short(grams[at]))
                    at = np.flatnonzero(fit)
                    if len(at):
                        # equal hashes of one chunk stand for one phrase if their words' hashes agree as well
                        with np.errstate(over="ignore"):
                            check = sum((chunk.word[at + k] * (_SEED[3] + np.uint64(2 * k)) for k in range(order)), np.zeros(len(at), np.uint64))
                        rank = np.lexsort((check, grams[at]))
                        h, c = grams[at][rank], check[rank]
                        first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])]))
                        one = at[rank[first]]
                        columns = [pa.array(chunk.lang[one]), pa.array(_bucket(grams[one]).astype(np.int32)), chunk.spell(one, order), pa.array(np.diff(np.append(first, len(rank))))]
                        fresh.setdefault(order, []).append(pa.RecordBatch.from_arrays(columns, names=["lang", "bucket", "phrase", "n"]))
                        size += len(one)
                if size >= HELD:
                    merge()
                    size = sum(len(p) for p in held.values())
                    if 2 * size >= HELD:
                        yield from out()
                        size = 0
        merge()
        yield from out()
        some = [(x, total[k]) for x, k in code.items() if k in total]
        if some:
            one = pa.array(range(len(some) + 1), pa.int32())
            lists = [pa.ListArray.from_arrays(one, x) for x in (pa.array([x for x, _ in some], pa.string()), pa.array([""] * len(some)), pa.array([n for _, n in some], pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(some), np.int32)), pa.array(np.zeros(len(some), np.int32)), *lists], names=["bucket", "words", "langs", "phrases", "counts"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fresh = pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.string(), pa.string(), pa.int32(), pa.int64())], names=["lang", "phrase", "words", "n"]), []
        for batch in batches:
            lengths = batch.column("phrases").value_lengths().to_numpy()
            columns = [batch.column("langs").flatten(), batch.column("phrases").flatten(), pa.array(np.repeat(batch.column("words").to_numpy(), lengths)), batch.column("counts").flatten()]
            fresh.append(pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "words", "n"]))
            if sum(len(x) for x in fresh) >= HELD:
                held, fresh = _merged([held, *fresh], ["lang", "phrase", "words"]), []
        held = _merged([held, *fresh], ["lang", "phrase", "words"])
        held = held.filter(pc.or_(pc.equal(held.column("words"), 0), pc.greater_equal(held.column("n"), least)))
        yield pa.RecordBatch.from_arrays(held.columns, names=["lang", "phrase", "words", "f"])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = map_batches(docs.select("text", "lang"), run, "bucket int, words int, langs array<string>, phrases array<string>, counts array<bigint>")
    return map_batches(packed.repartition(parts, "bucket"), sums, "lang string, phrase string, words int, f long")


def _merged(parts: list[pa.RecordBatch], keys: list[str]) -> pa.RecordBatch:
    """Rows with equal keys as one, their n added up."""
    table = pa.Table.from_batches(parts).group_by(keys).aggregate([("n", "sum")]).select([*keys, "n_sum"]).rename_columns([*keys, "n"]).combine_chunks()
    schema = pa.schema([table.schema.field(k) for k in [*keys, "n"]])
    return table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_arrays([pa.array([], f.type) for f in schema], schema=schema)


def frequent_phrases(docs: DataFrame, least: int = 100, most_words: int = 5, bits: int = FILTER_BITS) -> DataFrame:
    """(lang, phrase, words, f): all phrases of one to ``most_words`` words with ``least`` or more occurrences, exact, and the words
    of each language in all (phrase '', words 0).

    Three passes of summaries: over words, over pairs of words that may be frequent, over longer phrases of such pairs. Each gives a filter that lets through all
    frequent n-grams, as the parts of a frequent phrase are as frequent; a last pass counts by text.
    """
    docs = docs.select("text", F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"))
    words = filter_of(survivors(gram_counts(docs, (1,), None, None), least), bits)
    filters = {1: words}
    if most_words > 1:
        filters[2] = filter_of(survivors(gram_counts(docs, (2,), words, None), least), bits)
    if most_words > 2:
        filters[3] = filter_of(survivors(gram_counts(docs, tuple(range(3, most_words + 1)), words, filters[2]), least), bits)
    return exact_counts(docs, most_words, filters, least)


def collocations(docs: DataFrame, least: int = 100, most_words: int = 5, top: int = 2000, bits: int = FILTER_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of 2 to ``most_words`` words of each language of ``docs`` (text, lang).

    Texts are lower-cased (A-Z) and cut into pieces at ``. , ; : ! ?`` and line breaks; words are what is between spaces and tabs. A phrase lies within a
    piece and has ``a`` >= ``least`` occurrences, overlapping ones included. Cut in two parts with l and r occurrences it scores floor(1000 * a * n / (l * r)), n being
    the language's words; its lowest score counts, of several that with the shortest first part. A phrase inside a longer one that is as frequent goes.
    Order: score, then a, both falling, then the phrase by its bytes.

    Only phrases that one word more turns into such a longer phrase need be looked for: whatever lies between a phrase and a longer, equally
    frequent one is as frequent too. Null and empty texts have no words; a null lang is ``und``. Very long texts are
    read whole, in memory in proportion to the longest. Repeated rows count again; no rows give no rows; further columns are ignored.
    """
    all_ = cut_lineage(frequent_phrases(docs, least, most_words, bits))
    n = all_.filter("words = 0").select("lang", F.col("f").alias("n"))
    parts = all_.filter("words > 0").select("lang", "phrase", "f")
    whole = all_.filter("words > 1")
    step = F.split("phrase", " ")
    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1))
    cuts = whole.select("lang", "phrase", "words", F.col("f").alias("a"), cut.alias("k")).select(
        "lang", "phrase", "words", "a", "k", F.array_join(F.slice(step, F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice(step, F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("tail")
    )
    rows = cuts.join(parts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    rows = rows.join(parts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"]).join(n, "lang")
    wide = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    rows = rows.withColumn("above", wide("a", 17) * wide("n", 17) * F.lit(1000).cast("decimal(4,0)")).withColumn("below", wide("l", 19) * wide("r", 19))
    rows = rows.withColumn("score", F.expr("above div below"))
    best = rows.groupBy("lang", "phrase", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    longer = whole.filter("words > 2").select(
        "lang", F.col("f").alias("longer"), F.explode(F.array(F.array_join(F.slice(step, F.lit(1), F.col("words") - 1), " "), F.array_join(F.slice(step, F.lit(2), F.col("words") - 1), " "))).alias("phrase")
    )
    longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    rows = best.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < 100 * F.col("a")))
    rows = rows.select("lang", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), "n", F.col("b.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # first within slices, so that no task orders all phrases of a language
    slices = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(slices)))
    rows = rows.withColumn("place", F.row_number().over(W.partitionBy("lang", "slice").orderBy(*order))).filter(F.col("place") <= top)
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
