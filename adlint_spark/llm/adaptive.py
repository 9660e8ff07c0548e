"""Quality rules whose thresholds come from quantile sketches of each language and source."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from adlint_spark.llm.common import cut_lineage, hot_join, map_batches, mix64, span_hashes, text_chunks, word_spans

SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_LEADS = np.ones(256, bool)
_LEADS[0x80:0xC0] = False  # bytes that go on with a code point
#: A sketch tells values apart by their first SHARP + 1 bits.
SHARP = 6
#: Groups with fewer rows take the thresholds of their language, and languages with fewer those of all rows.
LEAST_ROWS = 200
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Measure:
    """A whole-number measure of a document, ``scale * part / of`` rounded down, and how far its fences lie.

    The fences of a group are its quartiles moved out by ``reach`` times their distance plus ``slack``, the least
    distance that counts as one; ``below`` tells whether there is a lower one.
    """

    name: str
    part: str
    of: str
    scale: int = 1000
    reach: int = 3
    slack: int = 100
    below: bool = False

    def value(self) -> Column:
        return F.when(F.col(self.of) > 0, F.expr(f"{self.scale} * {self.part} div {self.of}")).otherwise(F.lit(0)).cast("long")


#: The measures of the rules; slacks are in the measures' own units.
MEASURES = (
    Measure("word_length", "word_chars", "n_words", below=True, slack=500),
    Measure("symbols", "n_symbols", "n_words"),
    Measure("dup_lines", "n_dup_lines", "n_lines", slack=400),
    Measure("repeat_words", "n_repeat_words", "n_words", slack=350),
)


def text_counts(column: pa.Array) -> np.ndarray:
    """A row of COUNTS for each text."""
    out = []
    for at, end, data, offs in text_chunks(column):
        n, texts = len(data), end - at
        starts, ends, first = word_spans(data, offs)
        owner = np.repeat(np.arange(texts), np.diff(first))
        got = np.zeros((texts, len(COUNTS)), np.int64)
        got[:, 0] = np.diff(first)
        leads = np.concatenate([[0], np.cumsum(_LEADS[data])])
        got[:, 1] = np.bincount(owner, (leads[ends] - leads[starts]).astype(np.float64), texts)
        symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
        got[:, 2] = symbols[offs[1:]] - symbols[offs[:-1]]
        if len(starts):
            # lines, of those with a word: from a line break or a text's start to the next
            line_at = np.unique(np.concatenate([offs[:-1][np.diff(offs) > 0], np.flatnonzero(data == 10) + 1]))
            line_at = line_at[line_at < n]
            stop = np.append(line_at[1:], n)
            stop = np.where(data[stop - 1] == 10, stop - 1, stop)
            has_word = np.searchsorted(starts, stop) > np.searchsorted(starts, line_at)
            line_at, stop = line_at[has_word], np.maximum(stop, line_at)[has_word]
            of = np.searchsorted(offs, line_at, "right") - 1
            with np.errstate(over="ignore"):
                key = mix64(span_hashes(data, line_at, stop, fold=False) + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            _, earliest = np.unique(key, return_index=True)
            again = np.ones(len(key), bool)
            again[earliest] = False
            got[:, 3], got[:, 4] = np.bincount(of, minlength=texts), np.bincount(of[again], minlength=texts)
        if len(starts) > 2:
            word = span_hashes(data, starts, ends, fold=False)
            inside = np.flatnonzero(owner[2:] == owner[:-2])
            with np.errstate(over="ignore"):
                window = mix64(mix64(mix64(word[:-2] + owner[:-2].astype(np.uint64)) + word[1:-1]) + word[2:])[inside]
            _, inverse, times = np.unique(window, return_inverse=True, return_counts=True)
            twice = inside[times[inverse] > 1]
            covered = np.zeros(len(starts) + 3, np.int64)
            for k in range(3):
                covered[twice + k] = 1
            got[:, 5] = np.bincount(owner, covered[: len(starts)].astype(np.float64), texts)
        out.append(got)
    return np.concatenate(out) if out else np.zeros((0, len(COUNTS)), np.int64)


def with_counts(docs: DataFrame, *keys: str) -> DataFrame:
    """``keys`` of ``docs`` and COUNTS of its whole texts."""
    rows = docs.select(*keys, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = text_counts(batch.column("text"))
            own = [c for name, c in zip(batch.schema.names, batch.columns, strict=True) if name != "text"]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(got[:, k]) for k in range(len(COUNTS)))], names=[*keys, *COUNTS])

    schema = rows.drop("text").schema
    for name in COUNTS:
        schema = schema.add(name, "long")
    return map_batches(rows, run, schema)


def base_failed() -> Column:
    """Fewer than 50 words, or over half of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def value_range(n: Column) -> Column:
    """A whole number that rises with ``n`` >= 0: its binary length, then its first bits; at most 64 for each binary length."""
    length = F.length(F.bin(n))
    return F.when(n <= 0, F.lit(0)).otherwise(length * (1 << SHARP + 1) + F.call_function("shiftrightunsigned", n * (1 << SHARP), length - 1)).cast("long")


def least_of(bucket: Column) -> Column:
    """The least number of a value range."""
    length = F.call_function("shiftrightunsigned", bucket, F.lit(SHARP + 1)).cast("int")
    bits = (bucket % (1 << (SHARP + 1))).cast("long")
    up = F.call_function("shiftleft", bits, length - 1)
    return F.when(bucket <= 0, F.lit(0)).otherwise(F.call_function("shiftrightunsigned", up + ((1 << SHARP) - 1), F.lit(SHARP))).cast("long")


def sketches(counts: DataFrame, by: Sequence[str], measures: Sequence[Measure] = MEASURES) -> DataFrame:
    """(``by``, measure, bucket, n): quantile sketches of the measures for each group, as counts of value ranges.

    Quantiles are right within 1/64 of their value, and sketches merge by adding counts: in map tasks before the shuffle, over
    groups for a coarser one, or with those of other tables.
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(m.name).alias("measure"), value_range(m.value()).alias("bucket")) for m in measures))).alias("p")
    return counts.select(*by, pairs).groupBy(*by, F.col("p.measure").alias("measure"), F.col("p.bucket").alias("bucket")).agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, by: Sequence[str]) -> DataFrame:
    """The sketches of coarser groups."""
    return sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, by: Sequence[str]) -> DataFrame:
    """(``by``, measure, rows, low, high): the least values of the ranges that hold the first and third quartiles (ranks rounded up)."""
    group = W.partitionBy(*by, "measure")  # a sketch has some thousand ranges at most
    rows = sketch.withColumns({"upto": F.sum("n").over(group.orderBy("bucket")), "rows": F.sum("n").over(group)})
    at = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("rows"), F.col("bucket")))
    found = rows.groupBy(*by, "measure").agg(F.max("rows").alias("rows"), at(1).alias("q1"), at(3).alias("q3"))
    return found.select(*by, "measure", "rows", least_of(F.col("q1")).alias("low"), least_of(F.col("q3")).alias("high"))


def fences(sketch: DataFrame, by: Sequence[str], measures: Sequence[Measure] = MEASURES) -> DataFrame:
    """(``by``, rows, a column {measure: (least, most)}): a row for each group of ``sketch``."""
    reach, slack, below = (F.create_map(*(x for m in measures for x in (F.lit(m.name), F.lit(v(m))))) for v in (lambda m: m.reach, lambda m: m.slack, lambda m: m.below))
    out = F.col("measure")
    wide = (F.col("high") - F.col("low")) * reach[out] + slack[out]
    least = F.when(below[out], F.col("low") - wide)
    entry = F.struct(out, F.struct(least.cast("long").alias("least"), (F.col("high") + wide).cast("long").alias("most")))
    return quartiles(sketch, by).groupBy(*by).agg(F.max("rows").alias("rows"), F.map_from_entries(F.collect_list(entry)).alias("fence"))


def thresholds(counts: DataFrame, by: Sequence[str] = ("lang", "source"), measures: Sequence[Measure] = MEASURES, least_rows: int = LEAST_ROWS) -> DataFrame:
    """(``by``, rows, fence): the thresholds of each group of ``counts``.

    Groups with fewer than ``least_rows`` rows take those of the sketches merged over the groups that share all but the last column of
    ``by``, and so on up to all rows.
    """
    sketch = cut_lineage(sketches(counts, by, measures))
    levels = [fences(merged(sketch, by[:k]) if k < len(by) else sketch, by[:k], measures) for k in range(len(by), -1, -1)]
    own = levels[0].select(*by, "rows", F.struct("rows", "fence").alias("__0"))
    for k, level in enumerate(levels[1:], 1):
        keys = list(by[: len(by) - k])
        coarse = level.select(*keys, F.struct("rows", "fence").alias(f"__{k}"))
        own = own.join(coarse, keys) if keys else own.join(F.broadcast(coarse), F.lit(True))
    best = F.coalesce(*(F.when(F.col(f"__{k}.rows") >= least_rows, F.col(f"__{k}.fence")) for k in range(len(levels))), F.col(f"__{len(levels) - 1}.fence"))
    return own.select(*by, "rows", best.alias("fence"))


def adaptive_rules(docs: DataFrame, measures: Sequence[Measure] = MEASURES, least_rows: int = LEAST_ROWS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed) for every row of ``docs`` (doc_id, text, lang, source).

    ``base_failed`` is a fixed rule: fewer than 50 words, or over half of the words in three-word windows that are in the text twice. The
    other documents of each language and source give mergeable sketches of ``measures``, whose quartiles set that group's fences; a
    document stays (``kept``) if all its measures lie within. ``failed`` lists the measures that don't, by name. Fences are joined with the
    documents' counts; groups with more than their even share of documents are broadcast, the rest is shuffled.

    Whole texts are counted. Null, empty and blank texts have no words and fail the base rule. Null lang and source are groups of their
    own, and groups with few rows take coarser fences. Very long texts need memory in proportion to the longest. Repeated rows count one by one; ties at a
    fence are within; no rows give no rows; further columns are ignored.
    """
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    counted = with_counts(docs.select("doc_id", key("lang").alias("lang"), key("source").alias("source"), "text"), "doc_id", "lang", "source")
    counted = cut_lineage(counted.withColumn("base_failed", base_failed()))
    limits = cut_lineage(thresholds(counted.filter(~F.col("base_failed")), measures=measures, least_rows=least_rows))
    rows = hot_join(counted.filter(~F.col("base_failed")), limits, ["lang", "source"], "rows")
    outside = []
    for m in measures:
        fence = F.col("fence")[m.name]
        outside.append(F.when((m.value() > fence["most"]) | F.coalesce(m.value() < fence["least"], F.lit(False)), F.lit(m.name)))
    rows = rows.withColumn("failed", F.array_compact(F.array(*outside))).drop("fence")
    rest = counted.filter("base_failed").withColumn("failed", F.array().cast("array<string>"))
    rows = rows.unionByName(rest)
    kept = ~F.col("base_failed") & (F.size("failed") == 0)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "failed")
