"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from adlint_spark.llm.common import cut_lineage, n_words


def size_class(size: Column) -> Column:
    """A whole number for each range of sizes, some 500 at most: by the binary length and the first bits of the size."""
    length = F.length(F.bin(size))
    low = F.when(length > 3, F.call_function("shiftrightunsigned", size * 8, length - 1)).otherwise(size * 8)
    return F.when(size <= 0, F.lit(0)).otherwise((length * 16).cast("long") + low)


def source_targets(sizes: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """(source, rows, source_size, target) for ``sizes`` (source, rows, source_size), a row for each source.

    Sources by code point, null last, take the weights in turn, repeating. The targets share the total of all sizes in
    these proportions, but stop at ``most`` times their source's size; the excess goes to the others by weight until
    none is above. That is ``least(cap, level * weight)`` for the one level that uses up the total, found from
    prefix sums over the sources by cap / weight.
    """
    listed = F.array(*(F.lit(int(w)) for w in weights))
    everything = W.partitionBy()
    nth = F.row_number().over(everything.orderBy(F.col("source").isNull(), F.col("source").cast("binary")))
    rows = sizes.withColumn("weight", F.get(listed, F.pmod(nth - 1, F.lit(len(weights)))).cast("long")).withColumn("cap", F.col("source_size") * most)
    upto = everything.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary")).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumns(
        {
            "total": F.sum("source_size").over(everything),
            "all_weight": F.sum("weight").over(everything),
            "caps": F.sum("cap").over(upto) - F.col("cap"),
            "passed": F.sum("weight").over(upto) - F.col("weight"),
        }
    )
    # the level if this source and all after it stay below their caps; capped sources are those whose cap lies below it
    free, left = F.col("total") - F.col("caps"), F.col("all_weight") - F.col("passed")
    rows = rows.withColumn("level_here", free / left).withColumn("capped", F.col("cap") * left <= free * F.col("weight"))
    level = F.min(F.when(~F.col("capped"), F.struct("caps", "level_here"))).over(everything)["level_here"]
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(level * F.col("weight"))
    return rows.select("source", "rows", "source_size", target.cast("double").alias("target"))


def mixed(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3, seed: int = 1, splits: int = 64) -> DataFrame:
    """``docs`` with the columns __size, __source_size, __target and __copies, the number of times the mix takes the row.

    Systematic sampling: a document of a source is expected target / source size times. Within a source the
    documents stand by size class, then by one of ``splits`` random slices, then by size; the prefix sum of the
    expected copies plus one random offset per source gives each document a copy for each whole number that it
    crosses. So no document has over ``most`` copies, and the words taken differ from the target by little more
    than the words of the largest document. Prefix sums are built from the sums of size class and slice,
    so no task holds a source.

    Needs doc_id, text, source; further columns stay. Size is the number of words; null, empty and blank texts have
    0 and are sampled like the others. A null source is a source of its own. A source without words has the target 0 and
    gives nothing. The order is a function of doc_id and size alone, rows that repeat both count one by one.
    No rows give no rows. Very long texts are read whole, in memory in proportion to the longest.
    """
    order = F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = docs.withColumn("__size", n_words(F.col("text")))
    rows = rows.withColumns({"__class": size_class(F.col("__size")), "__slice": F.pmod(F.conv(F.substring(order, 1, 8), 16, 10).cast("long"), F.lit(splits)), "__order": order})
    cells = cut_lineage(rows.groupBy("source", "__class", "__slice").agg(F.count("*").alias("rows"), F.sum("__size").alias("words")))
    sizes = cells.groupBy("source").agg(F.sum("rows").alias("rows"), F.sum("words").alias("source_size"))
    targets = source_targets(sizes, weights, most)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce("source", F.lit(""))).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)
    before = W.partitionBy("source").orderBy("__class", "__slice").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    cells = cells.alias("c").join(targets.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source"))).select("c.source", "__class", "__slice", "before", "source_size", "target")
    cells = cells.withColumns({"rate": F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0), "offset": offset})
    cells = cells.select(F.col("source").alias("__cell_source"), F.col("__class").alias("__cell_class"), F.col("__slice").alias("__cell_slice"), F.col("before").alias("__before"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("rate").alias("__rate"), F.col("offset").alias("__offset"))
    place = F.row_number().over(W.partitionBy("source", "__class", "__slice").orderBy("__size", "__order", "doc_id"))
    rows = rows.withColumn("__place", place).join(cells, F.col("source").eqNullSafe(F.col("__cell_source")) & (F.col("__class") == F.col("__cell_class")) & (F.col("__slice") == F.col("__cell_slice")))
    upto = lambda n: F.floor(F.col("__offset") + F.col("__rate") * n)
    nth = F.col("__before") + F.col("__place")
    return rows.withColumn("__copies", upto(nth) - upto(nth - 1)).select(*(docs[c] for c in docs.columns), "__size", "__source_size", "__target", "__copies")
