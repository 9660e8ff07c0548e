"""Document fingerprints: one-permutation MinHash with optimal densification; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from adlint_spark.llm.common import words

#: Bits of the hash value that stay beside the bin number while minima are searched.
VALUE_BITS = 48  # a value has 47, which leaves the largest number for a mark


def shingle_hashes(w: Column, width: int) -> Column:
    """Hashes of the runs of ``width`` words of an array column; of the whole sequence if it is shorter; none without words."""
    last = F.greatest(F.size(w) - width, F.lit(0))
    runs = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(width))))
    return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(runs)


def binned(hashes: Column, bins: int) -> Column:
    """The hashes as ``bin << VALUE_BITS | value`` in order, and after each bin's values a mark, the largest value.

    Each shingle is hashed once: the hash picks bin and value.
    """
    packed = F.transform(hashes, lambda h: F.shiftleft(F.pmod(h, F.lit(bins)), VALUE_BITS) + F.shiftrightunsigned(h, 65 - VALUE_BITS))
    marks = F.transform(F.sequence(F.lit(1), F.lit(bins)), lambda i: F.shiftleft(i.cast("long"), VALUE_BITS) - 1)
    return F.sort_array(F.concat(packed, marks))


def bin_minima(ordered: Column) -> Column:
    """The first entry of each bin: its least value, or the mark of an empty bin."""
    return F.filter(ordered, lambda x, i: (i == 0) | (F.shiftright(x, VALUE_BITS) != F.shiftright(F.get(ordered, i - 1), VALUE_BITS)))


def is_mark(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << VALUE_BITS) - 1)) == (1 << VALUE_BITS) - 1


def densified(minima: Column, full: Column, bits: int) -> Column:
    """array<int>: the low ``bits`` of each bin's minimum; ``full`` has the entries of ``minima`` that aren't marks.

    An empty bin takes the value of the full bin that comes first in a random order of its own (a hash of both bins).
    No bin is full without words: the result is then empty.
    """
    low = lambda x: x.bitwiseAND(F.lit((1 << bits) - 1))

    def value(x: Column) -> Column:
        turn = lambda y: F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.shiftright(x, VALUE_BITS), F.shiftright(y, VALUE_BITS)), bits + 1), bits) + low(y)
        return low(F.when(is_mark(x), F.array_min(F.transform(full, turn))).otherwise(x)).cast("int")

    return F.when(F.size(full) == 0, F.array().cast("array<int>")).otherwise(F.transform(minima, value))


def packed(values: Column, bits: int) -> Column:
    """Hexadecimal text of the low bits, bin after bin; empty for no values."""
    digits = -(-bits // 4)
    return F.lower(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v), digits, "0")), ""))


def likeness(a: Column, b: Column, bits: int) -> Column:
    """Estimated Jaccard similarity of the shingle sets: share of equal bins, less what ``bits`` bits agree by chance.

    1 for two texts without words, 0 if one of the two has none.
    """
    chance = 2.0**-bits
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.size(a)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(F.greatest(F.lit(0.0), (same - chance) / (1 - chance)))


def with_fingerprint(df: DataFrame, text: str, out: str, bins: int = 128, bits: int = 8, width: int = 5) -> DataFrame:
    """``df`` with the column ``out``, array<int>: the fingerprint of each text.

    Words are runs other than ASCII white space, A-Z lower-cased; null counts as empty. Equal texts have equal
    fingerprints, texts with equal shingle sets too. Each step is a column of its own, so that none is computed twice.
    """
    df = df.withColumn("__words", words(F.col(text)))
    df = df.withColumn("__ordered", binned(shingle_hashes(F.col("__words"), width), bins))
    df = df.withColumn("__minima", bin_minima(F.col("__ordered")))
    df = df.withColumn("__full", F.filter("__minima", lambda x: ~is_mark(x)))
    return df.withColumn(out, densified(F.col("__minima"), F.col("__full"), bits)).drop("__words", "__ordered", "__minima", "__full")


#: Ranges of rows that look one row ahead have about so many bytes of text; beyond MOST_RANGES they grow.
RANGE_BYTES, MOST_RANGES = 8 << 20, 1 << 16


def with_range(df: DataFrame, order: str, text: str) -> DataFrame:
    """``df`` with the column __range: quantiles of ``order`` that hold some RANGE_BYTES of ``text`` each; null ``order`` comes last."""
    size = df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, min(MOST_RANGES, -(-size // RANGE_BYTES)))
    cuts = df.agg(F.percentile_approx(order, [k / parts for k in range(1, parts)], 10 * max(parts, 1000)).alias("cuts")).first()["cuts"] if parts > 1 else []
    cuts = sorted(set(cuts or []))
    if not cuts:
        return df.withColumn("__range", F.col(order).isNull().cast("int"))
    listed = F.from_json(F.lit("[" + ",".join(map(str, cuts)) + "]"), "array<bigint>")
    # how many cuts lie below the value, by halving: the place is grown bit by bit from the highest
    steps = F.array(*(F.lit(1 << bit) for bit in reversed(range(len(cuts).bit_length()))))
    spot = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when((at + step <= len(cuts)) & (F.get(listed, at + step - 1) < F.col(order)), step).otherwise(0))
    return df.withColumn("__range", F.when(F.col(order).isNull(), F.lit(len(cuts) + 1)).otherwise(spot))


def with_next(df: DataFrame, order: str, by: str, columns: list[str], firsts: DataFrame) -> DataFrame:
    """``df`` (__range, a row for each ``order``, ties by ``by``) with ``next_<column>``: the columns of the next row, of the first row after the last.

    Each range looks one row ahead, its last row takes the first one of the next range that has rows; ``firsts`` (__range,
    columns) has the first row of each.
    """
    everything = W.partitionBy()  # a row for each range
    rest = firsts.select("__range", F.struct(*columns).alias("__first"))
    rest = rest.withColumn("__wrap", F.first("__first").over(everything.orderBy("__range").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    rest = rest.select("__range", F.coalesce(F.lead("__first").over(everything.orderBy("__range")), F.col("__wrap")).alias("__after"))
    ahead = W.partitionBy("__range").orderBy(F.col(order).asc_nulls_last(), by)
    df = df.withColumn("__next", F.lead(F.struct(*columns)).over(ahead)).join(rest, "__range")
    following = F.coalesce("__next", "__after")
    return df.select("*", *(following[c].alias(f"next_{c}") for c in columns)).drop("__range", "__next", "__after")


def edited_fingerprints(docs: DataFrame, bins: int = 128, bits: int = 8, width: int = 5) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row of ``docs``.

    The edited text: the last ``floor(n_chars / 2)`` code points replaced by as many first ones (or all) of the next
    document by doc_id; the first follows the last, a lone document follows itself. ``near_edited`` compares a text
    with its edited one, ``near_next`` with the next document.

    Needs doc_id and text; other columns are ignored. A null text counts as empty: no characters, fingerprint ''. Rows that
    repeat a doc_id stand by text; null ids come last. No rows give no rows. Very long texts are read whole, in memory in proportion to the longest.
    """
    rows = with_range(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", "text")
    # the first row of each range is found before fingerprints are made, which are dear
    firsts = rows.groupBy("__range").agg(F.min_by("text", F.struct(F.col("doc_id"), F.col("text"))).alias("text"))
    printed = lambda df: with_fingerprint(df, "text", "values", bins, bits, width)
    rows = with_next(printed(rows), "doc_id", "text", ["text", "values"], printed(firsts))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "values", "next_values", edited.alias("edited"))
    rows = with_fingerprint(rows, "edited", "edited_values", bins, bits, width)
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        packed(F.col("values"), bits).alias("fingerprint"),
        packed(F.col("edited_values"), bits).alias("edited_fingerprint"),
        likeness(F.col("values"), F.col("edited_values"), bits).alias("near_edited"),
        likeness(F.col("values"), F.col("next_values"), bits).alias("near_next"),
    )
