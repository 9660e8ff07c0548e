"""Readers and writers: files, tables, responses, events, policies; result shapes."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_SCHEMA = (
    "event_id string, occurred_at_ms long, document_type string, effective_version string, valid boolean, errors int, warnings int, infos int, "
    "findings array<struct<rule_id:string,severity:string,message:string,path:string,spec_ref:string>>, catalog_version string, catalog_digest string, engine_version string, caller string"
)


def cut_lineage(df: DataFrame) -> DataFrame:
    """``checkpoint()`` in the shared folder that the session names as ``spark.checkpoint.dir``.

    Where none is set, a local master, all of whose tasks run in the driver, takes a temporary one; a cluster is an error.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", "") and not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()


def read_ad_files(spark: SparkSession, glob: str, binary: bool = False) -> DataFrame:
    """(doc_id, xml): each file is a document, named by its path.

    ``binary`` adds ``valid_utf8``: files that aren't UTF-8 have false and no xml, where else wrong bytes would be replaced.
    """
    if not binary:
        return spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("xml"))
    rows = spark.read.format("binaryFile").load(glob)
    fine = F.is_valid_utf8(F.col("content").cast("string"))
    return rows.select(F.col("path").alias("doc_id"), F.when(fine, F.col("content").cast("string")).alias("xml"), fine.alias("valid_utf8"))


def read_ad_table(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """A table of documents; a missing or zero max_wrapper_depth is 5."""
    rows = spark.read.format(format).load(path)
    depth = F.col("max_wrapper_depth") if "max_wrapper_depth" in rows.columns else F.lit(None)
    return rows.withColumn("max_wrapper_depth", F.coalesce(F.nullif(depth.cast("int"), F.lit(0)), F.lit(5)))


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("url", "xml")


def stream_documents(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def read_policies(spark: SparkSession, path: str) -> DataFrame:
    """(policy_id, rule_id, level) of CSV files with a header."""
    return spark.read.option("header", True).csv(path).select("policy_id", "rule_id", F.lower(F.trim("level")).alias("level"))


def issue() -> Column:
    return F.struct(F.col("rule_id").alias("id"), "severity", "message", "path", "spec_ref", "line", "col")


def with_issues(verdicts: DataFrame, findings: DataFrame) -> DataFrame:
    """``verdicts`` with issues, the array of each document's findings (at most some per element of a bounded document)."""
    lists = findings.groupBy("doc_id").agg(F.array_sort(F.collect_list(issue())).alias("issues"))
    return verdicts.join(lists, "doc_id", "left")


_NO_ISSUES = "array<struct<id:string,severity:string,message:string,path:string,spec_ref:string,line:int,col:int>>"


def result_document(verdicts: DataFrame, findings: DataFrame) -> DataFrame:
    """(doc_id, json): one JSON object for each document, in the shape that bindings read: version null where there is none, the summary with valid."""
    body = F.struct(
        "document_type", F.col("version.effective").alias("version"), "input_status", F.coalesce("issues", F.array().cast(_NO_ISSUES)).alias("issues"), F.struct("errors", "warnings", "infos", "valid").alias("summary")
    )
    return with_issues(verdicts, findings).select("doc_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def ndjson_document(verdicts: DataFrame, findings: DataFrame) -> DataFrame:
    """(doc_id, json): one JSON object for each document, in the shape of result files: named as its file, version "unknown" where there is none."""
    version = F.coalesce("version.effective", F.lit("unknown")).alias("version")
    body = F.struct(F.col("doc_id").alias("file"), "document_type", version, "valid", F.struct("errors", "warnings", "infos").alias("summary"), F.coalesce("issues", F.array().cast(_NO_ISSUES)).alias("issues"))
    return with_issues(verdicts, findings).select("doc_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def write_ndjson(verdicts: DataFrame, findings: DataFrame, path: str) -> None:
    ndjson_document(verdicts, findings).select(F.col("json").alias("value")).write.text(path)


def corpus_summary_json(summary: DataFrame, top: DataFrame, revenue: list[str]) -> DataFrame:
    """(value): one JSON object of a corpus summary, with the top rules (rule_id, n, severity), at most some twenty."""
    rule = F.struct(F.col("rule_id").alias("id"), F.col("n").alias("count"), "severity", F.col("rule_id").isin(revenue).alias("revenue_impact"))
    order = F.struct((-F.col("n")).alias("a"), F.col("rule_id").alias("b"), rule.alias("rule"))
    rules = top.agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["rule"]).alias("top_rules"))
    body = F.struct(F.struct("total_inputs", "total_valid", "errors", "warnings", "infos", "top_rules").alias("summary"))
    return summary.crossJoin(F.broadcast(rules)).select(F.to_json(body).alias("value"))  # one row and one row


def write_corpus_summary(summary: DataFrame, top: DataFrame, revenue: list[str], path: str) -> None:
    corpus_summary_json(summary, top, revenue).write.text(path)


def write_fixed(fixed: DataFrame, remaining: DataFrame, path: str) -> None:
    """Repaired documents with ``applied``, the repairs by rule, and ``remaining``, the number of findings left by rule."""
    left = remaining.groupBy("doc_id", "rule_id").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("rule_id", "n"))).alias("remaining"))
    fixed.select("doc_id", "xml", "applied").join(left, "doc_id", "left").write.parquet(path)


def validation_events(verdicts: DataFrame, findings: DataFrame, documents: DataFrame) -> DataFrame:
    """Verdicts in the shape of events: upper-case severities, provenance, caller. Needs stamped verdicts and documents' received_at."""
    rows = with_issues(verdicts, findings).join(documents.select("doc_id", "caller", F.unix_millis("received_at").alias("occurred_at_ms")), "doc_id", "left")
    listed = F.transform("issues", lambda i: F.struct(i["id"].alias("rule_id"), F.upper(i["severity"]).alias("severity"), i["message"].alias("message"), i["path"].alias("path"), i["spec_ref"].alias("spec_ref")))
    empty = F.array().cast("array<struct<rule_id:string,severity:string,message:string,path:string,spec_ref:string>>")
    return rows.select(
        F.col("doc_id").alias("event_id"), "occurred_at_ms", "document_type", F.col("version.effective").alias("effective_version"), "valid", *(F.col(c).cast("int").alias(c) for c in ("errors", "warnings", "infos")),
        F.coalesce(listed, empty).alias("findings"), "catalog_version", "catalog_digest", "engine_version", "caller",
    )


def write_events(events: DataFrame, path: str, checkpoint: str):
    """A stream of events into a folder of JSON lines, each once, by its checkpoint; returns the running query."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events written under older or newer schemas: missing columns get their defaults, unknown ones are left out, unknown types
    and severities are UNKNOWN. A line that isn't a JSON object, or has a number where a text or list is due, is an error of the job.
    """
    rows = spark.read.schema(EVENT_SCHEMA).option("mode", "FAILFAST").json(path)
    rows = rows.fillna(0, ["errors", "warnings", "infos"])
    kind = F.when(F.col("document_type").isin("VAST", "VMAP", "DAAST"), F.col("document_type")).otherwise("UNKNOWN")
    level = lambda f: F.when(f["severity"].isin("ERROR", "WARNING", "INFO"), f["severity"]).otherwise("UNKNOWN")
    empty = F.array().cast("array<struct<rule_id:string,severity:string,message:string,path:string,spec_ref:string>>")
    required = lambda c: F.coalesce(F.col(c), F.raise_error(F.lit(f"an event has no {c}")).cast("string" if c == "event_id" else "long"))
    return rows.withColumns({"event_id": required("event_id"), "occurred_at_ms": required("occurred_at_ms"), "document_type": kind, "findings": F.coalesce(F.transform("findings", lambda f: f.withField("severity", level(f))), empty)})


def compatible(writer: T.StructType, reader: T.StructType, defaults: tuple[str, ...] = ("errors", "warnings", "infos", "findings")) -> list[str]:
    """Why events of one schema can't be read under another; empty if they can.

    Columns may be added or left out where the reader has a default or takes null, and whole numbers may widen. A column of another
    type, or one that is required and that the writer lacks, can't be read.
    """
    wide = {("int", "bigint"), ("smallint", "int"), ("smallint", "bigint"), ("float", "double"), ("int", "double")}
    written = {f.name: f for f in writer}
    out = []
    for f in reader:
        if f.name not in written:
            if not f.nullable and f.name not in defaults:
                out.append(f"{f.name} is required and missing")
            continue
        old, new = written[f.name].dataType, f.dataType
        if isinstance(old, T.ArrayType) and isinstance(new, T.ArrayType) and isinstance(old.elementType, T.StructType) and isinstance(new.elementType, T.StructType):
            out += [f"{f.name}: {x}" for x in compatible(old.elementType, new.elementType, ())]
        elif old.simpleString() != new.simpleString() and (old.simpleString(), new.simpleString()) not in wide:
            out.append(f"{f.name} is {old.simpleString()}, not {new.simpleString()}")
    return out
