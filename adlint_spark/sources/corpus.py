"""A corpus of ad documents derived from the order tables: every defect follows from keys, so SQL can tell what is found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION_OF = ("2.0", "3.0", "4.0", "4.1", "4.2", "4.3", "4.4", None, "5.0")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _when(condition: str, yes: str, no: str = "") -> Column:
    return F.when(F.expr(condition), F.lit(yes)).otherwise(F.lit(no))


def _url(path: str, secure: Column | None = None) -> Column:
    scheme = F.lit("https") if secure is None else F.when(secure, F.lit("https")).otherwise(F.lit("http"))
    return F.concat(scheme, F.lit(f"://ads.example.com/{path}/"), F.expr("cast(l_partkey as string)"))


#: Documents of a task at least, where there are more than one for each core: generated code of the rules is made once a task.
TASK_DOCUMENTS = 50_000


def keyed_orders(spark: SparkSession, sf_dir: str) -> tuple[int, DataFrame]:
    """How many tasks derive the documents, a multiple of the cores, and (k, o_custkey) dealt out to them.

    Tables are dealt out while their rows are short: texts, made after that, need no shuffle, and a task's memory doesn't grow with the tables.
    """
    cores, orders = spark.sparkContext.defaultParallelism, table(spark, sf_dir, "orders")
    n = cores * max(1, -(-orders.count() // (cores * TASK_DOCUMENTS)))
    return n, orders.select(F.col("o_orderkey").alias("k"), "o_custkey").repartition(n, "k")


def ad_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each line item with its order: k (order key), n (its number within the order), xml of its Ad.

    Switches: Wrapper where l_linenumber % 5 = 0; no sequence where k % 4 = 0 and l_linenumber is even; no Impression
    l_partkey % 13 = 0, else a second one l_partkey % 17 = 0; plain media URL l_suppkey % 4 = 1; insecure media URL
    l_suppkey % 3 = 0; Duration 30s l_partkey % 11 = 0, else 00:00:00 l_partkey % 23 = 0, else a second Duration l_partkey % 43 = 0;
    delivery l_partkey % 19 = 0; Flash l_partkey % 29 = 0; AdTitle l_partkey % 31 = 0; unknown attribute l_partkey % 37 = 0;
    unknown child l_partkey % 41 = 0; macros in the Impression: [cachebusting] l_partkey % 7 = 1, [NOTAMACRO] l_partkey % 7 = 2.
    """
    n, orders = keyed_orders(spark, sf_dir)
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").repartition(n, "l_orderkey")
    items = items.join(orders.drop("o_custkey"), F.col("l_orderkey") == F.col("k"))
    items = items.withColumn("v", F.expr("k % 9"))
    impression = F.concat(F.lit("<Impression><![CDATA["), _url("i"), F.expr("case l_partkey % 7 when 1 then '?c=[cachebusting]' when 2 then '?c=[NOTAMACRO]' else '' end"), F.lit("]]></Impression>"))
    impressions = F.when(F.expr("l_partkey % 13 = 0"), F.lit("")).when(F.expr("l_partkey % 17 = 0"), F.concat(impression, impression)).otherwise(impression)
    plain = F.expr("l_suppkey % 4 = 1")
    media = _url("m", F.expr("l_suppkey % 3 <> 0"))
    media = F.when(plain, media).otherwise(F.concat(F.lit("<![CDATA["), media, F.lit("]]>")))
    duration = F.expr("case when l_partkey % 11 = 0 then '30s' when l_partkey % 23 = 0 then '00:00:00' else '00:00:30' end")
    second = _when("l_partkey % 43 = 0 and l_partkey % 11 <> 0 and l_partkey % 23 <> 0", "<Duration>00:00:30</Duration>")
    inline = F.concat(
        F.lit('<InLine><AdSystem version="1">acme</AdSystem><AdTitle>'), _when("l_partkey % 31 = 0", "test", "Spring sale"), F.lit("</AdTitle>"),
        _when("v in (3, 4, 5, 6)", "<AdServingId>s-1</AdServingId>"), impressions, _when("l_partkey % 41 = 0", "<Bogus/>"),
        F.lit("<Creatives><Creative>"), _when("v in (2, 3, 4, 5, 6)", '<UniversalAdId idRegistry="ad-id.org">A1</UniversalAdId>'),
        F.lit("<Linear><Duration>"), duration, F.lit("</Duration>"), second,
        F.lit('<TrackingEvents><Tracking event="start"><![CDATA[https://ads.example.com/t]]></Tracking></TrackingEvents><MediaFiles><MediaFile delivery="'),
        _when("l_partkey % 19 = 0", "download", "progressive"), F.lit('" type="'), _when("l_partkey % 29 = 0", "application/x-shockwave-flash", "video/mp4"),
        F.lit('" width="640" height="360"'), _when("l_partkey % 37 = 0", ' colour="red"'), F.lit(">"), media,
        F.lit("</MediaFile></MediaFiles></Linear></Creative></Creatives></InLine>"),
    )
    wrapper = F.concat(F.lit('<Wrapper><AdSystem version="1">acme</AdSystem>'), impressions, F.lit("<VASTAdTagURI><![CDATA["), _url("p"), F.lit("]]></VASTAdTagURI></Wrapper>"))
    sequence = F.when(F.expr("k % 4 <> 0 or l_linenumber % 2 = 1"), F.concat(F.lit(' sequence="'), F.col("l_linenumber").cast("string"), F.lit('"'))).otherwise(F.lit(""))
    xml = F.concat(F.lit('<Ad id="'), F.col("l_partkey").cast("string"), F.lit('"'), sequence, F.lit(">"), F.when(F.expr("l_linenumber % 5 = 0"), wrapper).otherwise(inline), F.lit("</Ad>"))
    return items.select("k", F.struct("l_linenumber", "l_partkey", "l_suppkey", xml.alias("xml")).alias("item"))


def ad_corpus(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """(doc_id, caller, policy_id, xml): a document for each order, an Ad for each of its line items; ``more`` keeps o_custkey.

    Version by k % 9. By k % 50: 0 an unclosed root, 1 a playlist, 2 an audio document, 3 JSON-escaped, else VAST.
    """
    ads = ad_items(spark, sf_dir).groupBy("k").agg(F.array_sort(F.collect_list("item")).alias("items"))  # a pod's few ads
    _, orders = keyed_orders(spark, sf_dir)
    rows = orders.join(ads, "k", "left").withColumn("ads", F.array_join(F.transform("items", lambda a: a["xml"]), ""))
    declared = F.expr("case k % 9 " + " ".join(f"when {n} then ' version=\"{v}\"'" for n, v in enumerate(VERSION_OF) if v) + " else '' end")
    vast = F.concat(F.lit("<VAST"), declared, F.lit(">"), F.coalesce("ads", F.lit("")), F.lit("</VAST>"))
    escaped = F.replace(vast, F.lit('"'), F.lit('\\"'))
    audio = F.lit('<DAAST version="1.0"><Error><![CDATA[https://ads.example.com/e?c=[ERRORCODE]]]></Error></DAAST>')
    playlist = F.lit('<VMAP version="1.0"><AdBreak timeOffset="start" breakType="linear"><AdSource id="1"><AdTagURI><![CDATA[https://ads.example.com/t]]></AdTagURI></AdSource></AdBreak></VMAP>')
    kind = F.expr("k % 50")
    xml = F.when(kind == 0, F.concat(F.lit("<VAST"), declared, F.lit("><Ad>"))).when(kind == 1, playlist).when(kind == 2, audio).when(kind == 3, escaped).otherwise(vast)
    caller = F.expr("case when o_custkey % 97 = 0 then null when o_custkey % 101 = 0 then 'bad caller!' else concat('dsp-', o_custkey % 40) end")
    return rows.select(F.col("k").cast("string").alias("doc_id"), caller.alias("caller"), F.expr("cast(o_custkey % 5 as string)").alias("policy_id"), xml.alias("xml"), *more)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, xml): a response for each part: a Wrapper of the next part's, an ad where p_partkey % 8 = 0, none where it is divisible by 53."""
    part = table(spark, sf_dir, "part").filter("p_partkey % 53 <> 0")
    link = F.concat(F.lit('<VAST version="3.0"><Ad id="1"><Wrapper><AdSystem version="1">acme</AdSystem><Impression><![CDATA[https://ads.example.com/i]]></Impression><VASTAdTagURI><![CDATA[https://ads.example.com/'), (F.col("p_partkey") + 1).cast("string"), F.lit("]]></VASTAdTagURI></Wrapper></Ad></VAST>"))
    end = F.lit('<VAST version="3.0"></VAST>')
    return part.select(F.concat(F.lit("https://ads.example.com/"), F.col("p_partkey").cast("string")).alias("url"), F.when(F.expr("p_partkey % 8 = 0"), end).otherwise(link).alias("xml"))


def verdict_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict events of the events table; every tenth event_id comes twice."""
    rules = ["VAST-2.0-inline-impression", "VAST-2.0-url-cdata", "VAST-2.0-duration-format", "VAST-2.0-tracking-https"]
    rule = F.element_at(F.array(*map(F.lit, rules)), (F.col("event_id") % 4 + 1).cast("int"))
    events = table(spark, sf_dir, "events")
    finding = F.array(F.struct(rule.alias("rule_id"), F.lit("error").alias("severity")))
    rows = events.select(F.col("event_id").cast("string").alias("event_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("occurred_at_ms"), F.concat(F.lit("p-"), F.expr("user_id % 20")).alias("caller"), (F.col("event_type") != "error").alias("valid"), finding.alias("findings"), F.explode(F.when(F.col("event_id") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("__n"))
    return rows.drop("__n")


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(F.col("event_type").alias("method"), F.when(F.expr("event_id % 13 = 0"), "shed").otherwise("ok").alias("status"), (F.col("value") / 1e4).alias("seconds"), F.expr("cast(pow(2, event_id % 9) as int)").alias("concurrency"))


def rule_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(policy_id, rule_id, level) by region, with one unknown rule."""
    rules = F.array(*(F.lit(r) for r in ("VAST-2.0-inline-impression", "VAST-2.0-url-cdata", "VAST-2.0-duration-format", "VAST-2.0-no-such-rule")))
    levels = F.array(*map(F.lit, ("off", "info", "warning", "error")))
    nation = table(spark, sf_dir, "nation")
    rows = nation.select(F.col("n_regionkey").cast("string").alias("policy_id"), F.element_at(rules, (F.col("n_nationkey") % 4 + 1).cast("int")).alias("rule_id"), "n_nationkey")
    first = rows.groupBy("policy_id", "rule_id").agg(F.min("n_nationkey").alias("n"))
    return first.select("policy_id", "rule_id", F.element_at(levels, (F.col("n") % 4 + 1).cast("int")).alias("level"))
