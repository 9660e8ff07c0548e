"""Helpers that several operators share: checkpoint folder, ASCII word rules, numpy hashing of words."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes other than ASCII white space; the rule is written as a Java / RE2 pattern.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else, so that every engine agrees."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Array of the words of a text, lower-cased (A-Z); null and blank texts give an empty array."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), SPACE)
    return F.filter(parts, lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_in(doc_id: Column, modulus: int, left_out: int) -> Column:
    """True for rows that may be learnt from: crc32 of the id as text, modulo ``modulus``, is not ``left_out``.

    A null id counts as the empty text.
    """
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus != left_out


def count_class(n: Column) -> Column:
    """A whole number that rises with ``n``: its binary length, then its first four bits. Some 500 at most; 1 has the least but 0."""
    length = F.length(F.bin(n))
    return F.when(n <= 0, F.lit(0)).otherwise(length * 16 + F.call_function("shiftrightunsigned", n * 8, length - 1))


def cut_lineage(df: DataFrame) -> DataFrame:
    """``checkpoint()`` in the shared folder that the session names as ``spark.checkpoint.dir``.

    Where none is set, a local master, all of whose tasks run in the driver, takes a temporary one; a cluster is an error.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", "") and not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint(eager=True)


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, a row for each key with ``weight``, the number of left rows that have it.

    Keys with more than their even share of the rows of a shuffle partition are fewer than there are partitions. They
    are broadcast, so that no task gets all rows of one; the others are joined as usual. ``how`` is inner or left.
    Both sides are read twice: they should be tables or checkpoints.
    """
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = right.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("n")).first()["n"]
    is_hot = F.col(weight) > max(total // parts, 1)
    hot = F.broadcast(right.filter(is_hot).drop(weight))
    cold = left.join(F.broadcast(right.filter(is_hot).select(keys)), keys, "left_anti")
    return left.join(hot, keys).unionByName(cold.join(right.filter(~is_hot).drop(weight), keys, how))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- numpy, inside tasks



def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow``; at a partition's end the Python worker, which lives on, gives back the memory that it no longer uses."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release_memory()

    return df.mapInArrow(tidy, schema)


def release_memory() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(n: int, seed: int) -> np.ndarray:
    """n reproducible 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_EXACT = seeded(256, 17)
_FOLDED = _EXACT.copy()
_FOLDED[65:91] = _EXACT[97:123]  # A-Z hash as a-z
_BASE, _INVERSE = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)
_powers: list[np.ndarray] = []


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, for n positions; those for long texts aren't kept."""
    if _powers and len(_powers[0]) > n:
        return _powers[0], _powers[1]
    m = max(n, (1 << 20) + (1 << 16))
    tables = [np.concatenate([np.ones(1, np.uint64), np.full(m, b, np.uint64)]).cumprod() for b in (_BASE, _INVERSE)]
    if m < 1 << 21:
        _powers[:] = tables
    return tables[0], tables[1]


def text_chunks(column: pa.Array, max_bytes: int = 1 << 20, max_rows: int = 1 << 14) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of at most max_rows and max_bytes, or one longer text. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = min(at + max_rows, n, max(at + 1, int(np.searchsorted(offs, offs[at] + max_bytes, "right")) - 1))
        yield at, end, data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each text and the total): the words of the texts that lie in data."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    np.logical_not(_IS_SPACE[data], out=inside[1:-1])
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    here, before = inside[1:], inside[:-1]
    starts = np.flatnonzero(here & (~before | cut))
    ends = np.flatnonzero(before & (~here | cut))
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hashes of the byte spans: polynomial prefix sums modulo 2^64, then a finaliser. ``fold`` counts A-Z as a-z."""
    power, inverse = power_tables(len(data))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_FOLDED if fold else _EXACT)[data] * power[: len(data)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * inverse[starts]
        return mix64(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
