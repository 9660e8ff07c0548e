"""Aggregates over verdicts, findings and request logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from adlint_spark.functions.values import normalize_caller
from adlint_spark.sources.io import cut_lineage

#: Upper bounds of latency buckets, in seconds.
BUCKETS = (0.0001, 0.00025, 0.0005, 0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, float("inf"))


def corpus_summary(verdicts: DataFrame) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return verdicts.agg(F.count("*").alias("total_inputs"), F.count_if("valid").alias("total_valid"), total("errors"), total("warnings"), total("infos"))


def top_rules(findings: DataFrame, k: int = 10, order: tuple[str, ...] = ("doc_id", "line", "col")) -> DataFrame:
    """The k most frequent rules, ties by rule_id, with the severity of the first finding by ``order``."""
    rows = findings.groupBy("rule_id").agg(F.count("*").alias("n"), F.min_by("severity", F.struct(*order)).alias("severity"))
    return rows.orderBy(F.desc("n"), "rule_id").limit(k)


def verdict_tally(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("caller", "valid").count()


def finding_tally(findings: DataFrame) -> DataFrame:
    """Findings (caller, rule_id, revenue_impact) counted."""
    return findings.groupBy("caller", "rule_id", "revenue_impact").count()


def error_rate(verdicts: DataFrame) -> DataFrame:
    bad = F.count_if(~F.col("valid"))
    return verdicts.groupBy("caller").agg(F.count("*").alias("total"), bad.alias("invalid"), (bad / F.greatest(F.count("*").cast("double"), F.lit(1e-9))).alias("rate"))


def revenue_findings(findings: DataFrame) -> DataFrame:
    return findings.filter("revenue_impact").groupBy("caller").count()


def with_caller(rows: DataFrame) -> DataFrame:
    return rows.withColumn("caller", normalize_caller(F.col("caller")))


def cap_callers(rows: DataFrame, order: str, n: int = 256) -> DataFrame:
    """The first n callers by ``order`` keep their label, later ones become ``other``; ``anonymous`` stays.

    Only the distinct callers are put in order; the kept labels are n rows.
    """
    firsts = rows.filter("caller <> 'anonymous'").groupBy("caller").agg(F.min(order).alias("__first"))
    kept = firsts.orderBy("__first", "caller").limit(n).select("caller", F.lit(True).alias("__kept"))
    out = rows.join(F.broadcast(kept), "caller", "left")
    return out.withColumn("caller", F.when(F.col("__kept") | (F.col("caller") == "anonymous"), F.col("caller")).otherwise("other")).drop("__kept")


def latency_histogram(log: DataFrame) -> DataFrame:
    """(method, le, n): cumulative counts for each bucket bound."""
    sums = log.groupBy("method").agg(*(F.count_if(F.col("seconds") <= le).alias(f"b{k}") for k, le in enumerate(BUCKETS)))
    pairs = F.array(*(F.struct(F.lit(le).alias("le"), F.col(f"b{k}").alias("n")) for k, le in enumerate(BUCKETS)))
    return sums.select("method", F.inline(pairs))


def request_count(log: DataFrame) -> DataFrame:
    return log.groupBy("method", "status").count()


#: How many ranges the values of a level are cut into, and how often.
RANGES, ROUNDS = 4096, 2


def quantiles(log: DataFrame, key: str, value: str, wanted: tuple[float, ...]) -> DataFrame:
    """(``key``, quantile, x): quantiles of ``value`` for each key, between two values in proportion, without a buffer of all values.

    Values are counted; ranges of equal width tell in which of them a rank lies, are cut again, and only values of the last
    ranges, a part in 16 million of a key's span, are put in order. Null values don't count.
    """
    values = cut_lineage(log.filter(F.col(value).isNotNull()).groupBy(F.col(key).alias("k"), F.col(value).cast("double").alias("x")).agg(F.count("*").alias("n")))
    spans = values.groupBy("k").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.sum("n").alias("total"))
    each = F.explode(F.array(*(F.lit(q) for q in wanted))).alias("q")
    # of a rank between two whole ones both count
    at = F.col("q") * (F.col("total") - 1)
    ranks = spans.select("*", each).withColumn("at", at).withColumn("r", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))))
    targets = ranks.select("k", "q", "at", "r", "low", ((F.col("high") - F.col("low")) / RANGES).alias("width"), F.lit(0).cast("long").alias("before"), F.col("high").alias("top"))
    for _ in range(ROUNDS):
        steps = targets.select("k", "low", "width", "top").distinct()
        place = F.when(F.col("width") > 0, F.least(F.floor((F.col("x") - F.col("low")) / F.col("width")), F.lit(RANGES - 1))).otherwise(F.lit(0)).alias("range")
        cells = values.join(F.broadcast(steps), "k").filter((F.col("x") >= F.col("low")) & (F.col("x") <= F.col("top"))).groupBy("k", "low", "width", "top", place).agg(F.sum("n").alias("n"), F.min("x").alias("first"), F.max("x").alias("last"))
        order = W.partitionBy("k", "low", "width", "top").orderBy("range")  # RANGES rows at most
        cells = cells.withColumn("upto", F.sum("n").over(order)).withColumn("until", F.col("upto") - F.col("n"))
        hit = (F.col("r") >= F.col("before") + F.col("until")) & (F.col("r") < F.col("before") + F.col("upto"))
        targets = targets.join(cells, ["k", "low", "width", "top"]).filter(hit)
        targets = targets.select("k", "q", "at", "r", F.col("first").alias("low"), ((F.col("last") - F.col("first")) / RANGES).alias("width"), (F.col("before") + F.col("until")).alias("before"), F.col("last").alias("top"))
        targets = cut_lineage(targets)
    found = values.join(F.broadcast(targets), "k").filter((F.col("x") >= F.col("low")) & (F.col("x") <= F.col("top")))
    upto = F.sum("n").over(W.partitionBy("k", "q", "r").orderBy("x"))
    found = found.withColumn("upto", F.col("before") + upto).filter(F.col("upto") > F.col("r")).groupBy("k", "q", "at", "r").agg(F.min("x").alias("x"))
    share = F.col("at") - F.floor("at")
    low, high = F.min_by("x", "r"), F.max_by("x", "r")
    return found.groupBy("k", "q", "at").agg(low.alias("a"), high.alias("b")).select(F.col("k").alias(key), F.col("q").alias("quantile"), (F.col("a") + (F.col("b") - F.col("a")) * share).alias("x"))


def load_report(log: DataFrame) -> DataFrame:
    """Quantiles, goodput and refused requests for each concurrency level."""
    ok = F.col("status") == "ok"
    names = {0.5: "p50", 0.99: "p99", 0.999: "p999"}
    found = quantiles(log, "concurrency", "seconds", tuple(names))
    wide = found.groupBy("concurrency").agg(*(F.max(F.when(F.col("quantile") == q, F.col("x"))).alias(name) for q, name in names.items()))
    sums = log.groupBy("concurrency").agg(F.max("seconds").alias("most"), F.count_if(ok).alias("good"), F.count_if(F.col("status") == "shed").alias("shed"))
    return wide.join(sums, "concurrency").select("concurrency", *names.values(), "most", "good", "shed")


def late_report(events: DataFrame, batch: str, delay_ms: int) -> DataFrame:
    """(``batch``, n, late): rows that come later than a watermark allows, for each batch of a stream as it was stored.

    The watermark is the greatest occurred_at_ms of all earlier batches, less ``delay_ms``; batches are put in order, rows aren't.
    """
    tops = events.groupBy(batch).agg(F.max("occurred_at_ms").alias("top"))
    mark = F.max("top").over(W.orderBy(batch).rowsBetween(W.unboundedPreceding, -1)) - delay_ms
    rows = events.join(F.broadcast(tops.select(batch, mark.alias("mark"))), batch)
    return rows.groupBy(batch).agg(F.count("*").alias("n"), F.count_if(F.col("occurred_at_ms") < F.col("mark")).alias("late"))


def findings_by_dimension(findings: DataFrame, dimensions: list[str]) -> DataFrame:
    return findings.groupBy(*dimensions).count()


def pod_stats(nodes: DataFrame) -> DataFrame:
    """(doc_id, ads, numbered): Ads and those with a sequence, for each document with an ad."""
    ads = nodes.filter("trail = 'VAST/Ad' and parse_error is null")
    return ads.groupBy("doc_id").agg(F.count("*").alias("ads"), F.count_if(F.col("attr")["sequence"].isNotNull()).alias("numbered"))


def gap_check(requests: DataFrame, published: DataFrame, received: DataFrame, key: str = "event_id") -> DataFrame:
    """(requested, published, received, lost): distinct keys at each point; lost ones were published and never received."""
    point = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(True))
    rows = point(requests, "requested").join(point(published, "published"), key, "full_outer").join(point(received, "received"), key, "full_outer")
    return rows.agg(*(F.count(c).alias(c) for c in ("requested", "published", "received")), F.count_if(F.col("published").isNotNull() & F.col("received").isNull()).alias("lost"))


def duplicate_siblings(nodes: DataFrame, name: str, key) -> DataFrame:
    """Elements ``name`` that repeat a key of an earlier sibling."""
    rows = nodes.filter(F.col("name") == name).withColumn("key", key).filter("key <> ''")
    nth = F.row_number().over(W.partitionBy("doc_id", "parent_id", "key").orderBy("node_id"))
    return rows.withColumn("nth", nth).filter("nth > 1").select("doc_id", "parent_id", "node_id", "key", "nth")
