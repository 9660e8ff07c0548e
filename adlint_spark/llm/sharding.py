"""Sharding by rendezvous hashing of stable record keys over weighted shards; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def unit(key: Column) -> Column:
    """A double in (0, 1) from the first 52 bits of the md5 of a text; the same in every engine and release."""
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (from 0) with the highest score ``weight / -ln(u)``, u drawn from key and shard; ties to the larger number.

    A shard's share of the keys follows its weight. A further shard draws from all others and moves nothing between
    them; a removed one's keys alone move. A null key counts as the empty text. Weights of 0 get nothing.
    """
    if not any(w > 0 for w in weights):
        raise ValueError("a shard of positive weight is needed")
    key = F.coalesce(key.cast("string"), F.lit(""))
    draws = [F.struct((F.lit(float(w)) / -F.log(unit(F.concat_ws("/", key, F.lit(str(i)))))).alias("score"), F.lit(i).alias("shard")) for i, w in enumerate(weights) if w > 0]
    return (F.greatest(*draws) if len(draws) > 1 else draws[0])["shard"]


def shard_documents(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None, splits: int = 64) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs`` (doc_id, text).

    ``law`` is ``key``: doc_id and the weights decide the shard. ``grown_shard`` is the shard under the weights
    ``grown``, by default one more shard of the last weight. Slots number each shard's rows from 0 without gaps: a
    row's place in one of ``splits`` slices of the shard plus the sizes of the slices before, so that no task holds
    a whole shard; within a slice rows stand by doc_id, then by size and checksum, and rows that repeat all three
    are alike.

    size is the text's UTF-8 bytes (none for null) plus 8; a null text has a null text_crc32. Rows with a null doc_id
    share a shard, and are spread over its slices by their text. No rows give no rows; other columns are ignored. Very long texts are read whole, in memory in proportion to the longest.
    """
    grown = [*weights, weights[-1]] if grown is None else grown
    # the slice depends on the text too: rows that share a key don't share a slice
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
    )
    rows = rows.withColumns({"shard": rendezvous(F.col("doc_id"), weights), "grown_shard": rendezvous(F.col("doc_id"), grown)})
    part = F.md5(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text_crc32").cast("string"), F.lit(""))).cast("binary"))
    rows = rows.withColumn("slice", F.pmod(F.conv(F.substring(part, 20, 8), 16, 10).cast("long"), F.lit(splits)))
    # shards x splits rows at most, whatever the input
    counts = rows.groupBy("shard", "slice").count()
    before = W.partitionBy("shard").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("shard", "slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(W.partitionBy("shard", "slice").orderBy("doc_id", "size", "text_crc32"))
    placed = rows.withColumn("place", place).join(F.broadcast(offsets), ["shard", "slice"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("place") - 1 + F.col("offset")).cast("long").alias("slot"), "grown_shard")
