"""Structured Streaming jobs: validating streams of documents, and windows over verdict events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from adlint_spark.functions.values import VERSIONS, normalize_caller
from adlint_spark.operators.detect import document_columns
from adlint_spark.operators.rules import KIND_COLUMNS, all_rules, each_hit, findings_of, hits, run_rules
from adlint_spark.operators.verdicts import POLICY_LEVELS, VERSION_TYPE, elements, kinds, overridden, prepared
from adlint_spark.sources.shred import whole_batches

#: Codes of refused messages.
INVALID_ARGUMENT, OUT_OF_RANGE = 3, 11
MOST_BYTES, MOST_DEPTH, DEFAULT_DEPTH = 4 << 20, 255, 5
_FINDING = "struct<rule_id:string,severity:string,message:string,path:string,spec_ref:string,line:int,col:int>"
_HEAD = f"doc_id string, note string, document_type string, input_status string, version {VERSION_TYPE}"


def validate_stream(documents: DataFrame) -> DataFrame:
    """Findings of a stream of documents (request_id as doc_id, xml): stateless, in the order that they come.

    A document that can't be read gives its parse error and the stream goes on.
    """
    return run_rules(elements(prepared(documents)))


def _refusal(messages: DataFrame) -> Column:
    """struct<code, message>: why a message can't be validated at all; null if it can."""
    column = lambda c, kind: F.col(c).cast(kind) if c in messages.columns else F.lit(None).cast(kind)
    depth, most, forced, levels = column("wrapper_depth", "long"), column("max_wrapper_depth", "long"), column("forced_version", "string"), column("rule_overrides", "map<string,string>")
    known = F.array(*(F.lit(r) for r in sorted({r.rule_id for _, r in all_rules()})))
    unknown = F.array_sort(F.array_except(F.map_keys(levels), known))
    wrong = F.map_keys(F.map_filter(levels, lambda _, v: ~F.coalesce(v.isin(*POLICY_LEVELS), F.lit(False))))
    size = F.octet_length("document")
    why = lambda code, *said: F.struct(F.lit(code).alias("code"), F.concat(*said).alias("message"))
    out = lambda c: ~F.coalesce(c.between(0, MOST_DEPTH), F.lit(True))
    return (
        F.when(size > MOST_BYTES, why(OUT_OF_RANGE, F.lit("document of "), size.cast("string"), F.lit(f" bytes exceeds the maximum of {MOST_BYTES}")))
        .when(out(depth), why(INVALID_ARGUMENT, F.lit("wrapper_depth "), depth.cast("string"), F.lit(f" exceeds the maximum of {MOST_DEPTH}")))
        .when(out(most), why(INVALID_ARGUMENT, F.lit("max_wrapper_depth "), most.cast("string"), F.lit(f" exceeds the maximum of {MOST_DEPTH}")))
        .when(~forced.isin(*VERSIONS), why(INVALID_ARGUMENT, F.lit("unknown forced_version "), forced))
        .when(F.size(wrong) > 0, why(INVALID_ARGUMENT, F.lit("rule_overrides["), F.array_min(wrong), F.lit("] has an unrecognised level")))
        .when(F.size(unknown) > 0, why(INVALID_ARGUMENT, F.lit("unknown rule IDs in rule_overrides: "), F.array_join(unknown, ", ")))
    )


def validate_messages(messages: DataFrame) -> DataFrame:
    """(request_id, verdict, error): one row for each message (request_id, document, and if there are such columns wrapper_depth,
    max_wrapper_depth, forced_version, rule_overrides, a map of levels), of a stream or a table.

    ``verdict`` has the document's type, status, version, counts and findings. A message that is too large or has a wrong
    context has ``error`` {code, message} instead, alone. Nothing is shuffled and no state is kept: the findings of the documents that the
    shredder reads at once stay together in their task, where each document's are folded to one row by its number, so a repeated request_id is
    no matter. Null documents are empty ones, null ids stay null, further columns are left out. A task holds the findings of such a batch.
    """
    rows = messages.withColumn("__error", _refusal(messages))
    has = lambda c: c in messages.columns
    depth = F.coalesce(F.nullif(F.col("max_wrapper_depth").cast("int"), F.lit(0)), F.lit(DEFAULT_DEPTH)) if has("max_wrapper_depth") else F.lit(DEFAULT_DEPTH)
    note = F.to_json(F.struct(F.col("__error").alias("error"), (F.col("rule_overrides") if has("rule_overrides") else F.lit(None)).cast("map<string,string>").alias("levels")))
    documents = rows.select(
        F.col("request_id").cast("string").alias("doc_id"),
        F.when(F.col("__error").isNull(), F.col("document")).otherwise("").alias("xml"),
        (F.coalesce(F.col("wrapper_depth").cast("int"), F.lit(0)) if has("wrapper_depth") else F.lit(0)).alias("wrapper_depth"),
        depth.alias("max_wrapper_depth"),
        (F.col("forced_version") if has("forced_version") else F.lit(None)).cast("string").alias("forced_version"),
        F.nullif(note, F.lit("{}")).alias("note"),
    )
    nodes = kinds(prepared(documents), numbered=True)
    top = F.col("node_id") == 0
    told = document_columns()
    head = [top.alias("top"), "note", *(F.when(top, told[c]).alias(name) for c, name in (("document_type", "document_type"), ("status", "input_status"), ("version", "version")))]
    found = each_hit(nodes, [*KIND_COLUMNS, "members", *head], hits()).filter("top and coalesce(nth, 0) = 0 or hit <> ''")
    shared = [*KIND_COLUMNS, "nth", "hit", "note", "document_type", "input_status", "version"]
    found = found.select(*shared, F.explode("members").alias("m")).select(*shared, "m.*")
    found = findings_of(found, "document", "node", "nth", "note", "document_type", "input_status", "version")
    said = F.from_json("note", "error struct<code:int,message:string>, levels map<string,string>")
    found = found.withColumn("severity", overridden(F.col("rule_id"), F.col("severity"), F.element_at(said["levels"], F.col("rule_id"))))
    folded = _fold(found)
    severities = F.transform("findings", lambda f: f["severity"])
    total = lambda s: F.size(F.filter(severities, lambda x: x == s)).cast("long")
    folded = folded.withColumns({f"{s}s": total(s) for s in ("error", "warning", "info")}).withColumn("said", said)
    verdict = F.struct("document_type", "input_status", "version", "errors", "warnings", "infos", (F.col("errors") == 0).alias("valid"), "findings")
    return folded.select(F.col("doc_id").alias("request_id"), F.when(F.col("said.error").isNull(), verdict).alias("verdict"), F.col("said.error").alias("error"))


def _fold(found: DataFrame) -> DataFrame:
    """One row for each document from its rows, which are among those of one of the shredder's batches; the first is its root's."""
    parts = [f.split(":")[0] for f in _FINDING[7:-1].split(",")]
    rows = found.select("document", "node", F.coalesce("nth", F.lit(0)).alias("nth"), "doc_id", "note", "document_type", "input_status", "version", *parts)
    schema = StructType.fromDDL(f"{_HEAD}, findings array<{_FINDING}>")
    shape = to_arrow_schema(schema)

    def fold(table: pa.Table) -> pa.RecordBatch:
        document, node, nth = (table.column(c).to_numpy() for c in ("document", "node", "nth"))
        order = np.lexsort((nth, node, document))
        table, document = table.combine_chunks().take(pa.array(order)), document[order]
        first = np.flatnonzero(np.concatenate([[True], document[1:] != document[:-1]]))
        kept = table.column("severity").is_valid().to_numpy(zero_copy_only=False)
        found = table.filter(pa.array(kept))
        before = np.concatenate([[0], np.cumsum(kept)])
        offsets = np.append(before[first], before[-1]).astype(np.int32)
        columns = [found.column(c).combine_chunks() if found.num_rows else pa.array([], found.schema.field(c).type) for c in parts]
        values = pa.StructArray.from_arrays(columns, fields=list(shape.field("findings").type.value_type))
        lists = pa.ListArray.from_arrays(pa.array(offsets), values)
        heads = [table.column(c).take(pa.array(first)).combine_chunks().cast(shape.field(c).type) for c in ("doc_id", "note", "document_type", "input_status", "version")]
        return pa.RecordBatch.from_arrays([*heads, lists.cast(shape.field("findings").type)], schema=shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(fold, whole_batches(batches, lambda b: b.column("document").to_numpy()))

    return rows.mapInArrow(run, schema)


def event_time(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Events by occurred_at_ms, with a watermark; later ones than ``delay`` are dropped by what follows."""
    return events.withColumn("ts", F.timestamp_millis("occurred_at_ms")).withWatermark("ts", delay)


def count_late(events: DataFrame, delay_ms: int, folder: str, on_time):
    """A writer of a stream of events (occurred_at_ms) that sets late rows apart, so that they are counted and not just dropped.

    For foreachBatch: late are rows older than the greatest time of earlier batches less ``delay_ms``; they go to ``folder``/late, the others to
    ``on_time`` (batch, batch_id). Each batch writes folders of its own, so one that is run again after a failure replaces what it wrote.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = None
        if batch_id > 0:
            earlier = spark.read.schema("top long, batch long").parquet(f"{folder}/tops").filter(F.col("batch") < batch_id)
            seen = earlier.agg(F.max("top").alias("top")).first()["top"]
        batch = batch.persist()
        late = F.col("occurred_at_ms") < F.lit(None if seen is None else seen - delay_ms).cast("long")
        batch.filter(late).write.mode("overwrite").parquet(f"{folder}/late/batch={batch_id}")
        on_time(batch.filter(~F.coalesce(late, F.lit(False))), batch_id)
        batch.agg(F.max("occurred_at_ms").alias("top")).write.mode("overwrite").parquet(f"{folder}/tops/batch={batch_id}")
        batch.unpersist()

    return events.writeStream.foreachBatch(handle)


def dedupe_events(events: DataFrame) -> DataFrame:
    """Each event_id once, within the watermark."""
    return events.dropDuplicatesWithinWatermark(["event_id"])


def _windowed(events: DataFrame, length: str, slide: str | None) -> tuple[DataFrame, Column]:
    return events.withColumn("caller", normalize_caller(F.col("caller"))), F.window("ts", length, slide)


def windowed_verdicts(events: DataFrame, length: str = "5 minutes", slide: str | None = None) -> DataFrame:
    rows, window = _windowed(events, length, slide)
    return rows.groupBy(window, "caller", "valid").agg(F.count("*").alias("n"))


def windowed_error_rate(events: DataFrame, length: str = "5 minutes", slide: str | None = None) -> DataFrame:
    rows, window = _windowed(events, length, slide)
    bad = F.count_if(~F.col("valid"))
    return rows.groupBy(window, "caller").agg(F.count("*").alias("total"), bad.alias("invalid"), (bad / F.greatest(F.count("*").cast("double"), F.lit(1e-9))).alias("rate"))


def windowed_rules(events: DataFrame, length: str = "5 minutes") -> DataFrame:
    """(window, rule_id, n) of the events' findings."""
    return events.select("ts", F.explode("findings").alias("f")).groupBy(F.window("ts", length), F.col("f.rule_id").alias("rule_id")).agg(F.count("*").alias("n"))


def top_of_windows(counts: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent rules of each window; for complete batches of ``windowed_rules``, as in foreachBatch."""
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("window").orderBy(F.desc("n"), "rule_id"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= k)


def windowed_revenue(events: DataFrame, revenue_rules: list[str], length: str = "5 minutes") -> DataFrame:
    rows, _ = _windowed(events, length, None)
    hits = rows.select("ts", "caller", F.explode("findings").alias("f")).filter(F.col("f.rule_id").isin(revenue_rules))
    return hits.groupBy(F.window("ts", length), "caller").agg(F.count("*").alias("n"))


def rejections(events: DataFrame) -> DataFrame:
    return events.filter(~F.col("valid"))
