"""URL filters by a Bloom filter cascade; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adlint_spark.llm.common import LOWER, UPPER, cut_lineage

#: A level's bits are sent with the plan: 4 MB at most.
MAX_BITS = 1 << 25


@dataclass(frozen=True)
class Level:
    """A Bloom filter: 64-bit words and the hash functions' number; ``seed`` keeps levels independent."""

    words: tuple[int, ...]
    hashes: int
    seed: int

    def has(self, key: Column) -> Column:
        # parsing the literal is folded into one array constant when the plan is optimised
        words = F.from_json(F.lit("[" + ",".join(map(str, self.words)) + "]"), "array<bigint>")
        found = F.lit(True)
        for i in range(self.hashes):
            bit = bit_of(key, self.seed, i, 64 * len(self.words))
            found = found & (F.getbit(F.get(words, F.shiftright(bit, 6).cast("int")), (bit % 64).cast("int")) == 1)
        return found


def bit_of(key: Column, seed: int, i: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(i), key), F.lit(bits))


@dataclass(frozen=True)
class Cascade:
    """Exact membership for the keys of the universe that it was built over."""

    levels: tuple[Level, ...]

    def has(self, key: Column) -> Column:
        """True for listed keys. The first level that lacks the key decides: levels 1, 3, ... hold listed keys, 2, 4, ...
        keys that aren't listed. A null key is not listed."""
        found = F.lit(len(self.levels) % 2 == 1)
        for k in range(len(self.levels) - 1, -1, -1):
            found = F.when(self.levels[k].has(key), found).otherwise(F.lit(k % 2 == 1))
        return F.coalesce(found & key.isNotNull(), F.lit(False))


def build_level(keys: DataFrame, n: int, bits_per_key: int, seed: int) -> Level:
    """The Bloom filter of the distinct column ``key`` of n rows; its words are or-ed together on the executors."""
    bits = max(64, 64 * -(-n * bits_per_key // 64))
    if bits > MAX_BITS:
        raise ValueError(f"{n} keys need {bits} bits, over {MAX_BITS}: give fewer bits a key or list fewer keys")
    hashes = max(1, min(8, round(0.69 * bits_per_key)))
    bit = F.explode(F.array(*(bit_of(F.col("key"), seed, i, bits) for i in range(hashes)))).alias("bit")
    words = keys.select(bit).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))).alias("value"))
    out = [0] * (bits // 64)
    for row in words.collect():  # bits / 64 rows at most
        out[row["word"]] = row["value"]
    return Level(tuple(out), hashes, seed)


def build_cascade(listed: DataFrame, universe: DataFrame, bits_per_key: Sequence[int] = (24, 8)) -> Cascade:
    """The cascade that tells the keys of ``listed`` from all other keys of ``universe`` (one column ``key`` each).

    Level 1 holds the listed keys, with ``bits_per_key[0]``; level 2 those keys of the universe that level 1 wrongly
    has; level 3 the listed keys that level 2 has, and so on until no level is wrong. The universe may repeat keys:
    only what passes level 1 is made distinct. Null keys don't count. An empty list gives a cascade without levels.
    """
    true = cut_lineage(listed.select("key").filter(F.col("key").isNotNull()).distinct())
    n = true.count()
    if not n:
        return Cascade(())
    levels = [build_level(true, n, bits_per_key[0], 1)]
    passed = universe.select("key").filter(levels[0].has(F.col("key"))).distinct()
    wrong = cut_lineage(passed.join(true, "key", "left_anti"))
    sides = [wrong, true]
    while n := sides[0].count():
        levels.append(build_level(sides[0], n, bits_per_key[-1], len(levels) + 1))
        sides = [cut_lineage(sides[1].filter(levels[-1].has(F.col("key")))), sides[0]]
    return Cascade(tuple(levels))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or the end. Else both empty."""
    url = F.coalesce(url, F.lit(""))
    found = lambda group: F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", group)
    return F.translate(found(1), UPPER, LOWER), found(2)


def candidate_keys(host: Column, path: Column, shapes: Sequence[tuple[int, int]]) -> list[tuple[Column, Column]]:
    """(suffix, key): for each of the ``shapes`` (labels, path length) of rules, the suffix of the host of so many labels and
    the key ``suffix + path prefix``; the key is null if host or path is shorter."""
    keys = []
    for labels, length in sorted(set(shapes)):
        suffix = F.substring_index(host, ".", -labels)
        fits = (F.size(F.split(host, r"\.")) >= labels) & (F.length(path) >= length) & (host != "")
        keys.append((suffix, F.when(fits, F.concat(suffix, F.substring(path, 1, length)))))
    return keys


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages`` (page_id, url).

    ``rules`` are (action, host, path). A rule fits its host and all subdomains if the url's path starts with the
    rule's; the longest ``host + path`` wins (of equal ones that with the longer host). Blocked and allowed keys have a
    cascade each, built over every key that the pages could match, so both are exact and no join decides. Without a rule
    a url is allowed, as it is in no list. A url that is null or has no ``://`` has an empty host and path and fits no rule.
    Repeated rows are judged alike; no rows give no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    keys = candidate_keys(F.col("host"), F.col("path"), [(len(h.split(".")), len(p)) for _, h, p in rules])
    if not keys:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    universe = rows.select(F.explode(F.array(*(key for _, key in keys))).alias("key"))
    blocked, allowed = (build_cascade(listed_keys(spark, [h + p for a, h, p in rules if a == action]), universe) for action in ("block", "allow"))
    tests = []
    for suffix, key in keys:
        verdict = F.when(blocked.has(key), F.lit("block")).when(allowed.has(key), F.lit("allow"))
        tests.append(F.when(verdict.isNotNull(), F.struct(F.length(key).alias("length"), F.length(suffix).alias("host"), key.alias("rule"), verdict.alias("verdict"))))
    # greatest skips nulls, and needs two or more values
    best = F.greatest(*tests, F.lit(None).cast("struct<length:int,host:int,rule:string,verdict:string>"))
    rows = rows.withColumn("best", best)
    return rows.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))


def listed_keys(spark: SparkSession, keys: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(k,) for k in keys], "key string")
