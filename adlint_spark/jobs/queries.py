"""Registered queries of the ad-document operators and their SQL; the SQL works from keys alone and never sees a document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlint_spark.functions import values
from adlint_spark.operators import chains, detect, fix, tallies, verdicts
from adlint_spark.operators.rules import REVENUE, rule_catalog, run_rules
from adlint_spark.sources import corpus, planted
from adlint_spark.sources.io import cut_lineage
from adlint_spark.sources.shred import register_shred_xml

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# what each switch of the corpus gives, by document k
_CTE = """
WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 9 AS v, o_orderkey % 50 AS kind FROM orders),
i AS (SELECT o.*, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_linenumber % 5 <> 0 AS inl FROM lineitem JOIN o ON l_orderkey = k),
broken AS (SELECT k FROM o WHERE kind = 0 UNION SELECT k FROM i WHERE kind = 3 AND v = 7),
a AS (SELECT * FROM i WHERE kind NOT IN (0, 1, 2) AND k NOT IN (SELECT k FROM broken)),
d AS (SELECT * FROM o WHERE kind NOT IN (0, 1, 2) AND k NOT IN (SELECT k FROM broken)),
imp AS (SELECT *, CASE WHEN p % 17 = 0 THEN 2 ELSE 1 END AS times FROM a WHERE p % 13 <> 0),
f AS (
  SELECT k, 'VAST-2.0-parse-error' AS rule_id, 'error' AS severity, 1 AS times FROM broken
  UNION ALL SELECT k, 'VAST-2.0-json-escaped', 'error', 1 FROM o WHERE kind = 3 AND v <> 7
  UNION ALL SELECT k, 'VMAP-1.0-root-namespace', 'warning', 1 FROM o WHERE kind = 1
  UNION ALL SELECT k, 'VAST-2.0-root-version', 'error', 1 FROM d WHERE v = 7
  UNION ALL SELECT k, 'VAST-2.0-root-version-value', 'warning', 1 FROM d WHERE v = 8
  UNION ALL SELECT k, 'VAST-2.0-ad-sequence', 'warning', 1 FROM a WHERE k % 4 = 0 GROUP BY k HAVING bool_or(n % 2 = 0) AND bool_or(n % 2 = 1)
  UNION ALL SELECT k, 'VAST-2.0-inline-impression', 'error', 1 FROM a WHERE inl AND p % 13 = 0
  UNION ALL SELECT k, 'VAST-2.0-wrapper-impression', 'error', 1 FROM a WHERE NOT inl AND p % 13 = 0
  UNION ALL SELECT k, 'VAST-2.0-duplicate-impression', 'warning', 1 FROM imp WHERE p % 17 = 0
  UNION ALL SELECT k, 'VAST-2.0-macro-lowercase', 'warning', times FROM imp WHERE p % 7 = 1
  UNION ALL SELECT k, 'VAST-2.0-macro-unknown', 'warning', times FROM imp WHERE p % 7 = 2
  UNION ALL SELECT k, 'VAST-2.0-duration-format', 'error', 1 FROM a WHERE inl AND p % 11 = 0
  UNION ALL SELECT k, 'VAST-2.0-duration-zero', 'warning', 1 FROM a WHERE inl AND p % 11 <> 0 AND p % 23 = 0
  UNION ALL SELECT k, 'VAST-2.0-duplicate-singular-element', 'error', 1 FROM a WHERE inl AND p % 11 <> 0 AND p % 23 <> 0 AND p % 43 = 0
  UNION ALL SELECT k, 'VAST-2.0-mediafile-delivery-enum', 'error', 1 FROM a WHERE inl AND p % 19 = 0
  UNION ALL SELECT k, 'VAST-2.0-flash-mediafile', 'warning', 1 FROM a WHERE inl AND p % 29 = 0
  UNION ALL SELECT k, 'VAST-2.0-adtitle-quality', 'warning', 1 FROM a WHERE inl AND p % 31 = 0
  UNION ALL SELECT k, 'VAST-2.0-unknown-attribute', 'warning', 1 FROM a WHERE inl AND p % 37 = 0
  UNION ALL SELECT k, 'VAST-2.0-inline-unknown-child', 'error', 1 FROM a WHERE inl AND p % 41 = 0
  UNION ALL SELECT k, 'VAST-2.0-mediafile-https', 'warning', 1 FROM a WHERE inl AND s % 3 = 0
  UNION ALL SELECT k, 'VAST-2.0-url-cdata', 'warning', 1 FROM a WHERE inl AND s % 4 = 1
  UNION ALL SELECT k, 'VAST-4.1-mezzanine-recommended', 'info', 1 FROM a WHERE inl AND v BETWEEN 3 AND 6
  UNION ALL SELECT k, 'VAST-4.4-version-attribute', 'info', 1 FROM d WHERE v = 6),
caller AS (SELECT k, CASE WHEN c % 97 = 0 OR c % 101 = 0 THEN 'anonymous' ELSE 'dsp-' || (c % 40) END AS caller, (c % 5)::VARCHAR AS policy_id FROM o),
verdict AS (SELECT o.k, o.kind, o.v, coalesce(sum(times) FILTER (severity = 'error'), 0)::BIGINT AS errors, coalesce(sum(times) FILTER (severity = 'warning'), 0)::BIGINT AS warnings,
                   coalesce(sum(times) FILTER (severity = 'info'), 0)::BIGINT AS infos FROM o LEFT JOIN f ON f.k = o.k GROUP BY o.k, o.kind, o.v)
"""
_REVENUE = "(" + ", ".join(f"'{r}'" for r in sorted(REVENUE)) + ")"


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived documents, written out for what reads them more than once."""
    return cut_lineage(corpus.ad_corpus(spark, sf_dir))


def _nodes(spark: SparkSession, sf_dir: str, names: list[str] | None = None, roots: bool = False) -> DataFrame:
    return verdicts.elements(verdicts.prepared(corpus.ad_corpus(spark, sf_dir)), names, roots)


def _well_formed(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = verdicts.prepared(_corpus(spark, sf_dir))
    return fix.well_formed(ready, verdicts.elements(ready, [], roots=True))


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_rules(verdicts.kinds(verdicts.prepared(corpus.ad_corpus(spark, sf_dir))))


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tallies.with_caller(verdicts.verdicts_of(corpus.ad_corpus(spark, sf_dir)))


@query(_CTE + "SELECT caller, count(*) AS total, count(*) FILTER (errors > 0) AS invalid, count(*) FILTER (errors > 0) / greatest(count(*)::DOUBLE, 1e-9) AS rate FROM verdict JOIN caller USING (k) GROUP BY caller")
def error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tallies.error_rate(_verdicts(spark, sf_dir))


@query(_CTE + "SELECT k::VARCHAR AS doc_id, CASE kind WHEN 1 THEN 'VMAP' WHEN 2 THEN 'DAAST' ELSE 'VAST' END AS document_type, errors, warnings, infos, errors = 0 AS valid FROM verdict")
def document_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.verdicts_of(corpus.ad_corpus(spark, sf_dir)).select("doc_id", "document_type", "errors", "warnings", "infos", "valid")


@query(_CTE + "SELECT rule_id, severity, sum(times)::BIGINT AS n FROM f GROUP BY rule_id, severity")
def rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir).groupBy("rule_id", "severity").agg(F.count("*").alias("n"))


@query(_CTE + "SELECT rule_id, sum(times)::BIGINT AS n, min(severity) AS severity FROM f GROUP BY rule_id ORDER BY n DESC, rule_id LIMIT 10")
def top_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tallies.top_rules(_findings(spark, sf_dir))


@query(_CTE + "SELECT count(*) AS total_inputs, count(*) FILTER (errors = 0) AS total_valid, sum(errors)::BIGINT AS errors, sum(warnings)::BIGINT AS warnings, sum(infos)::BIGINT AS infos FROM verdict")
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tallies.corpus_summary(verdicts.verdicts_of(corpus.ad_corpus(spark, sf_dir)))


@query(_CTE + f"SELECT caller, rule_id, rule_id IN {_REVENUE} AS revenue_impact, sum(times)::BIGINT AS count FROM f JOIN caller USING (k) GROUP BY caller, rule_id")
def finding_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tallies.with_caller(verdicts.enrich(_findings(spark, sf_dir), rule_catalog(spark)))
    return tallies.finding_tally(rows)


@query(_CTE + f"SELECT caller, sum(times)::BIGINT AS count FROM f JOIN caller USING (k) WHERE rule_id IN {_REVENUE} GROUP BY caller")
def revenue_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tallies.with_caller(verdicts.enrich(_findings(spark, sf_dir), rule_catalog(spark)))
    return tallies.revenue_findings(rows)


@query(
    _CTE + """, pol AS (SELECT n_regionkey::VARCHAR AS policy_id, n_nationkey % 4 AS r, min(n_nationkey) % 4 AS l FROM nation GROUP BY 1, 2),
    lev AS (SELECT policy_id, ['VAST-2.0-inline-impression', 'VAST-2.0-url-cdata', 'VAST-2.0-duration-format', 'VAST-2.0-no-such-rule'][(r + 1)::INT] AS rule_id, ['off', 'info', 'warning', 'error'][(l + 1)::INT] AS level FROM pol)
    SELECT f.rule_id, coalesce(level, severity) AS severity, sum(times)::BIGINT AS n FROM f JOIN caller USING (k) LEFT JOIN lev ON lev.policy_id = caller.policy_id AND lev.rule_id = f.rule_id
    WHERE coalesce(level, '') <> 'off' GROUP BY 1, 2"""
)
def policy_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = verdicts.apply_policy(_findings(spark, sf_dir), corpus.rule_overrides(spark, sf_dir))
    return rows.groupBy("rule_id", "severity").agg(F.count("*").alias("n"))


@query("SELECT n_regionkey::VARCHAR AS policy_id, ['VAST-2.0-no-such-rule'] AS unknown_rules FROM nation GROUP BY n_regionkey HAVING bool_or(n_nationkey % 4 = 3)")
def policy_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.check_policy(corpus.rule_overrides(spark, sf_dir), rule_catalog(spark)).select("policy_id", "unknown_rules")


@query(_CTE + "SELECT k::VARCHAR AS doc_id, count(*) AS ads, count(*) FILTER (k % 4 <> 0 OR n % 2 = 1) AS numbered FROM a GROUP BY k")
def pod_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tallies.pod_stats(_nodes(spark, sf_dir, ["Ad"]))


@query(_CTE + "SELECT CASE WHEN s % 3 = 0 THEN 'http' ELSE 'https' END AS scheme, 'ads.example.com' AS host, count(*) AS n, count(DISTINCT k) AS documents FROM a WHERE inl GROUP BY 1")
def media_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detect.url_inventory(_nodes(spark, sf_dir, detect.MACRO_ELEMENTS)).filter("kind = 'MediaFile'")
    return rows.groupBy("scheme", "host").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"))


@query(_CTE + "SELECT CASE WHEN p % 29 = 0 THEN 'application/x-shockwave-flash' ELSE 'video/mp4' END AS mime_type, CASE WHEN p % 19 = 0 THEN 'download' ELSE 'progressive' END AS delivery, count(*) AS n FROM a WHERE inl GROUP BY 1, 2")
def media_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.media_files(_nodes(spark, sf_dir, ["MediaFile"])).groupBy("mime_type", "delivery").agg(F.count("*").alias("n"))


@query(_CTE + "SELECT 'start' AS event, 'Linear' AS context, count(*) AS n FROM a WHERE inl HAVING count(*) > 0")
def tracking_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.tracking_inventory(_nodes(spark, sf_dir, ["Tracking"])).groupBy("event", "context").agg(F.count("*").alias("n"))


@query(
    _CTE + """SELECT CASE WHEN b.k IS NOT NULL THEN 'malformed' WHEN o.kind NOT IN (1, 2) AND o.v = 8 THEN 'unsupported' ELSE 'supported' END AS input_status,
    CASE WHEN o.kind IN (1, 2) THEN NULL WHEN o.v < 7 THEN ['2.0', '3.0', '4.0', '4.1', '4.2', '4.3', '4.4'][(o.v + 1)::INT] WHEN o.kind <> 0 AND b.k IS NULL AND m.k IS NOT NULL THEN '2.0' END AS version, count(*) AS n
    FROM o LEFT JOIN broken b ON b.k = o.k LEFT JOIN (SELECT DISTINCT k FROM a WHERE inl) m ON m.k = o.k GROUP BY 1, 2"""
)
def detected_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detect.doc_meta(_nodes(spark, sf_dir, [], roots=True))
    return rows.groupBy("input_status", F.col("version.effective").alias("version")).agg(F.count("*").alias("n"))


@query(
    """WITH RECURSIVE hops AS (SELECT p_partkey AS root, 0 AS depth, p_partkey AS spot FROM part
    UNION ALL SELECT root, depth + 1, spot + 1 FROM hops WHERE depth < 5 AND spot % 53 <> 0 AND spot % 8 <> 0 AND spot IN (SELECT p_partkey FROM part))
    SELECT depth, count(*) AS hops, count(*) FILTER (spot % 53 = 0 OR spot NOT IN (SELECT p_partkey FROM part)) AS dead_ends FROM hops GROUP BY depth"""
)
def wrapper_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = corpus.table(spark, sf_dir, "part")
    roots = part.select(F.col("p_partkey").alias("root_id"), F.concat(F.lit("https://ads.example.com/"), F.col("p_partkey").cast("string")).alias("url"))
    hops = chains.resolve_chains(roots, corpus.responses(spark, sf_dir))
    return hops.groupBy("depth").agg(F.count("*").alias("hops"), F.count_if(F.col("xml").isNull()).alias("dead_ends"))


@query(
    """WITH RECURSIVE hops AS (SELECT p_partkey AS root, 0 AS depth, p_partkey AS spot FROM part
    UNION ALL SELECT root, depth + 1, spot + 1 FROM hops WHERE depth < 5 AND spot % 53 <> 0 AND spot % 8 <> 0 AND spot IN (SELECT p_partkey FROM part)),
    ends AS (SELECT *, spot % 53 = 0 OR spot NOT IN (SELECT p_partkey FROM part) AS dead FROM hops)
    SELECT count(*) AS hops, count(*) FILTER (dead) AS errors, CASE WHEN bool_or(dead) THEN 'error' ELSE 'none' END AS worst,
           'https://ads.example.com/' || max(spot) AS last_url, CASE WHEN NOT bool_or(dead) AND max(spot) % 8 <> 0 THEN 'Wrapper' END AS ad_type, root FROM ends GROUP BY root"""
)
def chain_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chain's length, errors, worst severity and end: an empty response, a tag too far away, or none."""
    part = corpus.table(spark, sf_dir, "part")
    roots = part.select(F.col("p_partkey").alias("root_id"), F.concat(F.lit("https://ads.example.com/"), F.col("p_partkey").cast("string")).alias("url"))
    hops = cut_lineage(chains.resolve_chains(roots, corpus.responses(spark, sf_dir)))
    documents = chains.hop_documents(hops)
    report = chains.chain_report(hops, verdicts.verdicts_of(documents), detect.inspect(chains.hop_documents(chains.last_hops(hops))))
    return report.withColumnRenamed("root_id", "root")


@query(_CTE + "SELECT name, count(*) AS n, count(DISTINCT k) AS documents FROM (SELECT k, 'Impression' AS name FROM imp, range(imp.times) UNION ALL SELECT k, unnest(['Duration', 'MediaFile']) FROM a WHERE inl UNION ALL SELECT k, 'VASTAdTagURI' FROM a WHERE NOT inl UNION ALL SELECT k, 'Duration' FROM a WHERE inl AND p % 11 <> 0 AND p % 23 <> 0 AND p % 43 = 0) GROUP BY name")
def shredded_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements counted by a table function in SQL."""
    register_shred_xml(spark)
    verdicts.prepared(corpus.ad_corpus(spark, sf_dir)).createOrReplaceTempView("ad_documents")
    names = "'Impression', 'Duration', 'MediaFile', 'VASTAdTagURI'"
    return spark.sql(f"SELECT e.name, count(*) AS n, count(DISTINCT d.doc_id) AS documents FROM ad_documents d, LATERAL shred_xml(d.xml, array({names})) e WHERE e.name IN ({names}) AND e.parse_error IS NULL GROUP BY e.name")


@query("WITH e AS (SELECT event_id // 100 AS batch, epoch_ms(ts) AS t FROM events), tops AS (SELECT batch, max(max(t)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 3600000 AS mark FROM e GROUP BY batch) SELECT batch, count(*) AS n, count(*) FILTER (t < mark) AS late FROM e JOIN tops USING (batch) GROUP BY batch")
def late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in batches of a hundred by event_id: how many a watermark of an hour would drop."""
    events = corpus.table(spark, sf_dir, "events")
    rows = events.select(F.floor(F.col("event_id") / 100).alias("batch"), F.unix_millis(F.col("ts").cast("timestamp")).alias("occurred_at_ms"))
    return tallies.late_report(rows, "batch", 3_600_000)


@query(_CTE + "SELECT k::VARCHAR AS request_id, CASE WHEN c % 7 = 0 THEN 3 END::INT AS code, CASE WHEN c % 7 <> 0 THEN errors END AS errors, CASE WHEN c % 7 <> 0 THEN warnings END AS warnings, CASE WHEN c % 7 <> 0 THEN errors + warnings + infos END AS findings FROM verdict JOIN (SELECT o_orderkey AS k, o_custkey AS c FROM orders) USING (k)")
def message_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each message: a verdict, or an error for those with a wrong context."""
    from adlint_spark import streaming

    documents = corpus.ad_corpus(spark, sf_dir, "o_custkey")
    messages = documents.select(F.col("doc_id").alias("request_id"), F.col("xml").alias("document"), F.when(F.expr("o_custkey % 7 = 0"), 300).otherwise(0).alias("wrapper_depth"))
    rows = streaming.validate_messages(messages)
    return rows.select("request_id", F.col("error.code").alias("code"), "verdict.errors", "verdict.warnings", F.size("verdict.findings").cast("long").alias("findings"))


@query(_CTE + "SELECT k::VARCHAR AS doc_id, count(*) AS n FROM a WHERE inl AND s % 3 = 0 GROUP BY k")
def https_upgrades(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = _well_formed(spark, sf_dir)
    return ready.select("doc_id", fix.upgrade_https(F.col("xml"))["n"].cast("long").alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n")).filter("n > 0")


@query(_CTE + "SELECT 'VAST-2.0-mediafile-https' AS rule_id, count(DISTINCT k) AS documents, count(*) AS n FROM a WHERE inl AND s % 3 = 0 HAVING count(*) > 0")
def fix_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = fix.fix_report(fix.fix(verdicts.prepared(corpus.ad_corpus(spark, sf_dir))))
    return report.groupBy("rule_id").agg(F.countDistinct("doc_id").alias("documents"), F.sum("n").alias("n"))


@query(planted.repairs_sql(planted.REPAIRS))
def planted_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of repair, by document."""
    fixed = fix.fix(planted.planted_documents(spark, sf_dir, planted.REPAIRS))
    return fix.fix_report(fixed).select("doc_id", "rule_id", F.col("n").cast("long").alias("n"), "path")


@query(_CTE + "SELECT rule_id, sum(times)::BIGINT AS n FROM f WHERE rule_id NOT IN ('VAST-2.0-mediafile-https', 'VAST-2.0-json-escaped') GROUP BY rule_id")
def findings_after_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = fix.fix(verdicts.prepared(corpus.ad_corpus(spark, sf_dir)), told=False).drop("was_escaped")
    return run_rules(verdicts.kinds(fixed)).groupBy("rule_id").agg(F.count("*").alias("n"))


@query(_CTE + "SELECT 'right' AS side, 'VAST-4.1-adservingid-present' AS rule_id, count(*) AS n FROM a WHERE inl AND v NOT BETWEEN 3 AND 6 UNION ALL SELECT 'right', 'VAST-4.0-universaladid-present', count(*) FROM a WHERE inl AND v NOT BETWEEN 2 AND 6 UNION ALL SELECT 'right', 'VAST-4.1-mezzanine-recommended', count(*) FROM a WHERE inl AND v NOT BETWEEN 3 AND 6 UNION ALL SELECT 'left', 'VAST-4.4-version-attribute', count(*) FROM d WHERE v = 6")
def what_if_4_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = verdicts.what_if_version(corpus.ad_corpus(spark, sf_dir), "4.1")
    return changed.groupBy("side", "rule_id").agg(F.count("*").alias("n"))


@query("SELECT event_type AS method, CASE WHEN event_id % 13 = 0 THEN 'shed' ELSE 'ok' END AS status, count(*) AS count FROM events GROUP BY 1, 2")
def request_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tallies.request_count(corpus.request_log(spark, sf_dir))


@query(
    "SELECT event_type AS method, le, count(*) FILTER (value / 1e4 <= le) AS n FROM events, (SELECT unnest(["
    + ", ".join("'infinity'::DOUBLE" if le == float("inf") else repr(le) + "::DOUBLE" for le in tallies.BUCKETS) + "]) AS le) GROUP BY 1, 2"
)
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tallies.latency_histogram(corpus.request_log(spark, sf_dir))


@query("SELECT (2 ** (event_id % 9))::INT AS concurrency, quantile_cont(value / 1e4, 0.5) AS p50, quantile_cont(value / 1e4, 0.99) AS p99, quantile_cont(value / 1e4, 0.999) AS p999, max(value / 1e4) AS most, count(*) FILTER (event_id % 13 <> 0) AS good, count(*) FILTER (event_id % 13 = 0) AS shed FROM events GROUP BY 1")
def load_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tallies.load_report(corpus.request_log(spark, sf_dir))


@query("WITH first AS (SELECT 'p-' || (user_id % 20) AS caller, min(epoch_ms(ts)) AS t FROM events GROUP BY 1), kept AS (SELECT caller FROM first ORDER BY t, caller LIMIT 8) SELECT CASE WHEN caller IN (FROM kept) THEN caller ELSE 'other' END AS caller, count(*) AS n FROM (SELECT 'p-' || (user_id % 20) AS caller FROM events) GROUP BY 1")
def capped_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tallies.with_caller(corpus.verdict_events(spark, sf_dir)).dropDuplicates(["event_id"])
    return tallies.cap_callers(rows, "occurred_at_ms", 8).groupBy("caller").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS requested, count(*) FILTER (event_id % 13 <> 0) AS published, count(*) FILTER (event_id % 25 <> 0) AS received, count(*) FILTER (event_id % 13 <> 0 AND event_id % 25 = 0) AS lost FROM events")
def delivery_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests, those of them that were not refused and so published, and what a receiver that misses every 25th event has."""
    requests = corpus.table(spark, sf_dir, "events").select("event_id")
    published = corpus.verdict_events(spark, sf_dir).filter("cast(event_id as long) % 13 <> 0")
    return tallies.gap_check(requests.select(F.col("event_id").cast("string")), published, corpus.verdict_events(spark, sf_dir).filter("cast(event_id as long) % 25 <> 0"))


def _distinct_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.verdict_events(spark, sf_dir).withColumn("ts", F.timestamp_millis("occurred_at_ms")).dropDuplicates(["event_id"])


@query("SELECT 'p-' || (user_id % 20) AS caller, event_type <> 'error' AS valid, count(*) AS count FROM events GROUP BY 1, 2")
def verdict_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tallies.verdict_tally(tallies.with_caller(_distinct_events(spark, sf_dir)))


@query("SELECT ['VAST-2.0-inline-impression', 'VAST-2.0-url-cdata', 'VAST-2.0-duration-format', 'VAST-2.0-tracking-https'][(event_id % 4 + 1)::INT] AS rule_id, 'p-' || (user_id % 20) AS caller, count(*) AS count FROM events GROUP BY 1, 2")
def findings_by_rule_and_caller(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tallies.with_caller(_distinct_events(spark, sf_dir)).select("caller", F.explode("findings").alias("f")).select("caller", "f.*")
    return tallies.findings_by_dimension(rows, ["rule_id", "caller"])


@query(f"WITH r AS (SELECT ['VAST-2.0-inline-impression', 'VAST-2.0-url-cdata', 'VAST-2.0-duration-format', 'VAST-2.0-tracking-https'][(event_id % 4 + 1)::INT] AS rule_id FROM events) SELECT rule_id, count(*) AS n FROM r WHERE rule_id IN {_REVENUE} GROUP BY 1")
def filtered_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _distinct_events(spark, sf_dir).select(F.explode("findings").alias("f")).select("f.rule_id", "f.severity")
    rows = verdicts.filter_findings(verdicts.enrich(rows, rule_catalog(spark)), severities=["error"], revenue_only=True)
    return rows.groupBy("rule_id").agg(F.count("*").alias("n"))


@query("SELECT epoch_ms(time_bucket(INTERVAL 5 MINUTE, ts)) AS start_ms, 'p-' || (user_id % 20) AS caller, event_type <> 'error' AS valid, count(*) AS n FROM events GROUP BY 1, 2, 3")
def windowed_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from adlint_spark import streaming

    return streaming.windowed_verdicts(_distinct_events(spark, sf_dir)).select(F.unix_millis("window.start").alias("start_ms"), "caller", "valid", "n")


@query("SELECT epoch_ms(time_bucket(INTERVAL 5 MINUTE, ts)) AS start_ms, 'p-' || (user_id % 20) AS caller, count(*) AS n FROM events WHERE event_id % 4 IN (0, 3) GROUP BY 1, 2")
def windowed_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    from adlint_spark import streaming

    return streaming.windowed_revenue(_distinct_events(spark, sf_dir), sorted(REVENUE)).select(F.unix_millis("window.start").alias("start_ms"), "caller", "n")


@query(_CTE + "SELECT k::VARCHAR AS doc_id, count(*) AS media, 0::BIGINT AS tracking, 0::BIGINT AS simid_files, 0::BIGINT AS simid_frames FROM a WHERE inl AND s % 3 = 0 GROUP BY k")
def insecure_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fix.https_hits(_nodes(spark, sf_dir, [*fix.TRACKING, "MediaFile", "InteractiveCreativeFile", "IFrameResource"]))


@query(_CTE + "SELECT k::VARCHAR AS doc_id, count(*) AS n FROM imp WHERE p % 17 = 0 GROUP BY k")
def repeated_impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tallies.duplicate_siblings(_nodes(spark, sf_dir, ["Impression"]), "Impression", F.col("text")).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(
    _CTE + """SELECT o.k::VARCHAR AS doc_id, coalesce(i.n, 0)::BIGINT AS impressions, coalesce(t.n, 0)::BIGINT AS trackings, CASE WHEN t.k IS NOT NULL OR w.k IS NOT NULL THEN 'acme' END AS ad_system
    FROM o LEFT JOIN (SELECT k, sum(times) AS n FROM imp GROUP BY k) i ON i.k = o.k LEFT JOIN (SELECT k, count(*) AS n FROM a WHERE inl GROUP BY k) t ON t.k = o.k LEFT JOIN (SELECT DISTINCT k FROM a WHERE NOT inl) w ON w.k = o.k"""
)
def inspected_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.inspect(verdicts.prepared(corpus.ad_corpus(spark, sf_dir))).select("doc_id", "impressions", "trackings", "ad_system")


@query("SELECT epoch_ms(time_bucket(INTERVAL 5 MINUTE, ts)) AS start_ms, 'p-' || (user_id % 20) AS caller, count(*) AS total, count(*) FILTER (event_type = 'error') AS invalid, count(*) FILTER (event_type = 'error') / count(*)::DOUBLE AS rate FROM events GROUP BY 1, 2")
def windowed_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from adlint_spark import streaming

    events = corpus.verdict_events(spark, sf_dir).withColumn("ts", F.timestamp_millis("occurred_at_ms")).dropDuplicates(["event_id"])
    rows = streaming.windowed_error_rate(events)
    return rows.select(F.unix_millis("window.start").alias("start_ms"), "caller", "total", "invalid", "rate")


@query("SELECT epoch_ms(time_bucket(INTERVAL 1 DAY, ts)) AS start_ms, ['VAST-2.0-inline-impression', 'VAST-2.0-url-cdata', 'VAST-2.0-duration-format', 'VAST-2.0-tracking-https'][(event_id % 4 + 1)::INT] AS rule_id, count(*) AS n FROM events GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY start_ms ORDER BY count(*) DESC, rule_id) <= 2")
def windowed_top_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from adlint_spark import streaming

    events = corpus.verdict_events(spark, sf_dir).withColumn("ts", F.timestamp_millis("occurred_at_ms")).dropDuplicates(["event_id"])
    rows = streaming.top_of_windows(streaming.windowed_rules(events, "1 day"), 2)
    return rows.select(F.unix_millis("window.start").alias("start_ms"), "rule_id", "n")


@query("SELECT 'p-' || (user_id % 20) AS caller, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1")
def rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    from adlint_spark import streaming

    events = tallies.with_caller(corpus.verdict_events(spark, sf_dir)).dropDuplicates(["event_id"])
    return streaming.rejections(events).groupBy("caller").agg(F.count("*").alias("n"))


@query(r"SELECT page_id, regexp_matches(url, '^(?i:https?|wss?|ftp):[/\\]*([^/\\?#@]*@)?[^/\\?#@:<>^|%\s]+(:[0-9]*)?([/\\?#].*)?$') AS uri_like, regexp_matches(url, '[ \"<>\\^`{}|]') AS illegal FROM pages")
def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return corpus.table(spark, sf_dir, "pages").select("page_id", values.is_uri_like(url).alias("uri_like"), values.has_illegal_uri_char(url).alias("illegal"))


@query("SELECT event_id AS k, event_id % 4 = 0 AS hhmmss, event_id % 4 = 0 OR event_id % 4 = 1 AND floor(value) BETWEEN 0 AND 100 AS time_or_percent, event_id % 4 = 2 AS whole, event_id % 4 = 2 AND floor(value) IN (0, 1) AS truth FROM events")
def value_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' values written as times, percentages, whole numbers and plain words."""
    rows = corpus.table(spark, sf_dir, "events").select(F.col("event_id").alias("k"), F.floor("value").alias("n"))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    n, kind = F.col("n"), F.col("k") % 4
    time = F.concat(two(F.floor(n / 3600) % 100), F.lit(":"), two(F.floor(n / 60) % 60), F.lit(":"), two(n % 60))
    text = F.when(kind == 0, time).when(kind == 1, F.concat(n.cast("string"), F.lit("%"))).when(kind == 2, n.cast("string")).otherwise(F.concat(F.lit("about "), n.cast("string")))
    c = F.col("x")
    return rows.withColumn("x", text).select("k", values.is_hhmmss(c).alias("hhmmss"), values.is_time_or_percent(c).alias("time_or_percent"), values.is_xs_integer(c).alias("whole"), values.is_xs_boolean(c).alias("truth"))


def _planted(sheet: planted.Sheet) -> Callable[[SparkSession, str], DataFrame]:
    def found(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = run_rules(verdicts.kinds(verdicts.prepared(planted.planted_documents(spark, sf_dir, sheet))))
        return rows.groupBy("rule_id", "severity", "path", "line", "col", "spec_ref").agg(F.count("*").alias("n"))

    return found


for _sheet in planted.SHEETS.values():
    QUERIES[f"planted_{_sheet.name}"], SQL[f"planted_{_sheet.name}"] = _planted(_sheet), planted.planted_sql(_sheet)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
