"""Language identification with error-correcting output codes over n-gram classifiers."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlint_spark.llm.common import map_batches, release_memory, text_chunks
from adlint_spark.llm.grams import byte_grams

ORDERS = (2, 3, 4)
#: Buckets of each order: 2 ** BITS.
BITS = 14
UNKNOWN = "und"


@dataclass(frozen=True)
class Codes:
    """``codes`` (language, bit) of +1 and -1; ``weights`` (bucket, bit): log-odds of the bit for an n-gram."""

    languages: tuple[str, ...]
    codes: np.ndarray
    weights: np.ndarray


def codewords(n: int) -> np.ndarray:
    """n codewords of +1 and -1, no column constant or the opposite of another.

    Up to eight languages have the exhaustive code (2 ** (n - 1) - 1 bits, any two words differ in 2 ** (n - 2));
    more have seeded random columns, about fifteen for each doubling of n.
    """
    if n < 2:
        return np.ones((n, 1))
    if n <= 8:  # eight have 35 balanced columns only
        return np.array([c for c in itertools.product((1.0, -1.0), repeat=n) if c[0] > 0 and min(c) < 0]).T
    rng, columns = np.random.default_rng(11), {}
    while len(columns) < 15 * int(np.ceil(np.log2(n))):
        c = rng.permutation(np.where(np.arange(n) % 2, 1.0, -1.0))
        columns.setdefault(tuple(c * c[0]), c * c[0])
    return np.stack(list(columns.values()), 1)


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, bucket, n): how often the n-grams of each bucket occur in all texts of each language of ``labelled`` (text, lang).

    A partition first adds up its own texts, so at most languages x buckets rows leave it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for at, end, data, offs in text_chunks(batch.column("text")):
                grams = byte_grams(data, offs, ORDERS, BITS, True)
                owner = np.repeat(np.arange(end - at), np.diff(offs))
                for lang in set(langs[at:end]):
                    mine = (langs[at:end] == lang)[owner]
                    total = sums.setdefault(lang, np.zeros(len(ORDERS) << BITS, np.int64))
                    total += np.bincount(grams[:, mine].ravel(), minlength=len(total))
        for lang, total in sums.items():
            full = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(full), pa.string()), pa.array(full.astype(np.int32)), pa.array(total[full])], names=["lang", "bucket", "n"])

    return map_batches(labelled.select("text", "lang"), run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame, smoothing: float = 0.5) -> Codes:
    """The codes and bit classifiers of the languages in ``labelled``, from the counts of all its rows.

    The classifier of a bit sets the n-gram distributions of the languages with +1 against those with -1, each language
    counting alike. Only languages x buckets counts reach the driver.
    """
    got = gram_counts(labelled.filter("text is not null and lang is not null")).toArrow()
    names = got.column("lang").to_pylist()
    languages = sorted(set(names))
    codes = codewords(len(languages))
    counts = np.zeros((len(languages), len(ORDERS) << BITS))
    row = {lang: k for k, lang in enumerate(languages)}
    counts[[row[x] for x in names], got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    del got, names
    release_memory()
    by_order = counts.reshape(len(languages), len(ORDERS), 1 << BITS) + smoothing
    share = (by_order / by_order.sum(axis=2, keepdims=True)).reshape(counts.shape)
    weights = np.zeros((counts.shape[1], codes.shape[1]), np.float32)
    for bit in range(codes.shape[1]):
        up = codes[:, bit] > 0
        if up.any() and not up.all():
            weights[:, bit] = np.log(share[up].mean(axis=0)) - np.log(share[~up].mean(axis=0))
    return Codes(tuple(languages), codes, weights)


def decode(codes: np.ndarray, margins: np.ndarray, sharpness: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language, score, wrong bits) of each row of margins: the codeword with the least sum of logistic losses.

    The score is the softmax of the negative losses; wrong bits are those whose sign differs from the chosen word.
    """
    loss = np.logaddexp(0, -sharpness * margins[:, None, :] * codes[None]).sum(axis=2)
    best = loss.argmin(axis=1)
    score = 1 / np.exp(loss.min(axis=1, keepdims=True) - loss).sum(axis=1)
    return best, score, (margins * codes[best] <= 0).sum(axis=1)


def with_language(docs: DataFrame, model: Codes, sharpness: float = 4.0) -> DataFrame:
    """``docs`` (text, further columns) with lang_pred, score and ambiguous.

    A bit's margin is the mean log-odds of the text's n-grams. ``ambiguous`` marks texts whose bits have more errors
    than the code corrects, whose score is under 0.5, or that are ``und``: null texts, texts without a letter, and all texts
    if no language was learnt; their score is 0.
    """
    gap = int(min((np.abs(a - b).sum() / 2 for a, b in itertools.combinations(model.codes, 2)), default=1))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # buckets x bits floats
    rows = docs.withColumn("__letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)) & F.lit(bool(model.languages)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            margins = np.zeros((batch.num_rows, m.codes.shape[1] if m.languages else 1))
            for at, end, data, offs in text_chunks(batch.column("text")) if m.languages else ():
                full = np.flatnonzero(np.diff(offs))
                n = np.diff(offs)[full][:, None]
                for g in byte_grams(data, offs, ORDERS, BITS, True) if len(full) else ():
                    margins[at + full] += np.add.reduceat(m.weights[g], offs[:-1][full], axis=0) / (n * len(ORDERS))
            letter = batch.column("__letter").to_numpy(zero_copy_only=False)
            lang, score, clear = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
            if m.languages and letter.any():
                best, sure, wrong = decode(m.codes, margins[letter], sharpness)
                lang[letter], score[letter] = np.array(m.languages, object)[best], sure
                clear[letter] = (wrong <= (gap - 1) // 2) & (sure >= 0.5)
            own = [batch.column(c) for c in batch.schema.names if c != "__letter"]
            yield pa.RecordBatch.from_arrays([*own, pa.array(lang, pa.string()), pa.array(score), pa.array(~clear)], names=[*(c for c in batch.schema.names if c != "__letter"), "lang_pred", "score", "ambiguous"])

    schema = docs.drop("lang_pred", "score", "ambiguous").schema.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    return map_batches(rows.drop("lang_pred", "score", "ambiguous"), run, schema)


def languages(docs: DataFrame, may_learn) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) for every row of ``docs`` (doc_id, text, lang).

    Learns from the text and lang of rows that ``may_learn`` (a function of the doc_id column) marks; a prediction depends on
    the text alone. Null and empty texts, and texts without a letter, are ``und``. Repeated rows are predicted alike; no
    rows give no rows; other columns are ignored. Very long texts are read whole, in memory in proportion to the longest.
    """
    model = train(docs.filter(may_learn(F.col("doc_id"))))
    rows = with_language(docs.select("doc_id", "text"), model).drop("text")
    return rows.select("doc_id", (~may_learn(F.col("doc_id"))).alias("held_out"), "lang_pred", "score", "ambiguous")
