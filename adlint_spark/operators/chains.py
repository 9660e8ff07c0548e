"""Wrapper chains: following ad tags through a table of responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlint_spark.operators.detect import first_wrapper_uri
from adlint_spark.sources.io import cut_lineage


def resolve_chains(roots: DataFrame, responses: DataFrame, max_depth: int = 5) -> DataFrame:
    """(root_id, depth, url, label, xml): every hop of the chain from each of ``roots`` (root_id, url).

    The next hop is the response's first ad tag, as long as it is at most ``max_depth`` away. A url without response is a
    hop without xml, and ends its chain. Of several responses of one url the one whose text comes first counts. The rounds join a table of two columns; the texts are joined once, at the end.
    """
    chosen = responses.groupBy("url").agg(F.min("xml").alias("xml"))
    links = cut_lineage(chosen.select("url", first_wrapper_uri(F.col("xml")).alias("next")))
    front = roots.select("root_id", F.lit(0).alias("depth"), "url")
    hops = front
    for depth in range(1, max_depth + 1):
        front = cut_lineage(front.join(links, "url").filter("next is not null").select("root_id", F.lit(depth).alias("depth"), F.col("next").alias("url")))
        hops = hops.unionByName(front)
    label = F.when(F.col("depth") == 0, F.col("url")).otherwise(F.concat("url", F.lit(" [wrapper depth "), F.col("depth").cast("string"), F.lit("]")))
    return hops.join(chosen, "url", "left").select("root_id", "depth", "url", label.alias("label"), "xml")


def last_hops(hops: DataFrame, max_depth: int = 5) -> DataFrame:
    """The last hop of each chain that ``resolve_chains`` found: a hop tells by itself whether it has a next one."""
    return hops.filter((F.col("depth") >= max_depth) | first_wrapper_uri(F.col("xml")).isNull())


def hop_documents(hops: DataFrame, max_depth: int = 5) -> DataFrame:
    """The hops as documents to validate, all at once."""
    return hops.select(F.concat_ws("#", "root_id", "depth").alias("doc_id"), F.coalesce("xml", F.lit("")).alias("xml"), F.col("depth").alias("wrapper_depth"), F.lit(max_depth).alias("max_wrapper_depth"))


def chain_report(hops: DataFrame, verdicts: DataFrame, inspected: DataFrame) -> DataFrame:
    """(root_id, hops, errors, worst, last_url, ad_type): for each chain, its length, errors, worst severity, and where it ends in what kind of ad.

    ``verdicts`` and ``inspected`` (doc_id, ad_type; of ``last_hops`` at least) are of ``hop_documents``; a chain that ends without response has no ad_type.
    """
    rows = hops.withColumn("doc_id", F.concat_ws("#", "root_id", "depth")).join(verdicts.select("doc_id", "errors", "warnings", "infos"), "doc_id", "left").join(inspected.select("doc_id", "ad_type"), "doc_id", "left")
    worst = F.when(F.max("errors") > 0, "error").when(F.max("warnings") > 0, "warning").when(F.max("infos") > 0, "info").otherwise("none")
    end = F.max_by(F.struct("url", "ad_type"), "depth")
    return rows.groupBy("root_id").agg(F.count("*").alias("hops"), F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"), worst.alias("worst"), end["url"].alias("last_url"), end["ad_type"].alias("ad_type"))
