"""Findings to verdicts: policies, summaries, gates, differences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from adlint_spark.operators.detect import document_columns, unescape_json_vast, with_detection
from adlint_spark.operators.rules import KIND_COLUMNS, LEVELS, MARKS, each_hit, findings_of, hit_rule, hits, keep_methods_small, run_rules
from adlint_spark.sources.shred import shred, whole_batches

#: Rules that a policy can't switch off; they then stay as they are.
NOT_SILENCED = ("VAST-2.0-extension-misplaced-element", "VAST-2.0-creative-extension-misplaced-element")


def prepared(documents: DataFrame) -> DataFrame:
    """``documents`` with JSON-escaped texts unescaped, and was_escaped."""
    return unescape_json_vast(documents.withColumn("xml", F.coalesce("xml", F.lit(""))))


def elements(documents: DataFrame, names: list[str] | None = None, roots: bool = True) -> DataFrame:
    """The nodes table, or its elements of some names, with detection columns."""
    return with_detection(shred(documents, names=names, roots=roots))


def kinds(documents: DataFrame, numbered: bool = False) -> DataFrame:
    """The nodes table by kind, with detection columns: for ``run_rules``, which looks at each kind once."""
    return with_detection(shred(documents, kinds=True, numbered=numbered))


#: Levels of policies, the strictest first.
POLICY_LEVELS = ("error", "warning", "info", "off")


def policy_levels(overrides: DataFrame) -> DataFrame:
    """(policy_id, rule_id, level), one for each policy and rule: of several levels the strictest; others than POLICY_LEVELS don't count."""
    rank = F.array_position(F.array(*map(F.lit, POLICY_LEVELS)), F.col("level"))
    rows = overrides.filter(F.col("level").isin(*POLICY_LEVELS))
    return rows.groupBy(F.col("policy_id").cast("string").alias("policy_id"), "rule_id").agg(F.min_by("level", rank).alias("level"))


def overridden(rule_id: Column, severity: Column, level: Column) -> Column:
    """A finding's severity under a policy's level for its rule; null if it is off."""
    off = F.coalesce((level == "off") & ~rule_id.isin(*NOT_SILENCED), F.lit(False))
    return F.when(~off, F.coalesce(F.when(level.isin("error", "warning", "info"), level), severity))


def apply_policy(findings: DataFrame, overrides: DataFrame) -> DataFrame:
    """``findings`` under ``overrides`` (policy_id, rule_id, level): ``off`` drops a finding, another level is its severity.

    Policies are small tables; Spark sends them along where they are. Of several levels that a policy has for a rule the
    strictest counts, and unknown levels don't.
    """
    rows = findings.join(policy_levels(overrides), ["policy_id", "rule_id"], "left")
    return rows.withColumn("severity", overridden(F.col("rule_id"), F.col("severity"), F.col("level"))).filter("severity is not null").select(*findings.columns)


def check_policy(overrides: DataFrame, catalog: DataFrame, strict: bool = False) -> DataFrame:
    """(policy_id, unknown_rules, bad_levels, bad_depth): what is wrong with each policy; a max_wrapper_depth, where there is such a column, lies between 0 and 255.

    ``strict`` makes the job fail with all unknown rules, or else bad levels or depths, of all policies, sorted.
    """
    rows = overrides.join(F.broadcast(catalog.select("rule_id", F.lit(True).alias("known"))), "rule_id", "left")  # under 300 rules
    bad = ~F.coalesce(F.col("level").isin(*POLICY_LEVELS), F.lit(False))
    depth = F.col("max_wrapper_depth").cast("long") if "max_wrapper_depth" in overrides.columns else F.lit(None).cast("long")
    out = rows.groupBy("policy_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("known").isNull(), F.col("rule_id")))).alias("unknown_rules"),
        F.array_sort(F.collect_set(F.when(bad, F.coalesce("level", F.lit("null"))))).alias("bad_levels"),
        F.max(F.when(~depth.between(0, 255), depth)).alias("bad_depth"),
    )
    out = out.filter("size(unknown_rules) > 0 or size(bad_levels) > 0 or bad_depth is not null")
    if strict:
        all_ = lambda c: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), ", ")
        wrong = out.agg(F.count("*").alias("n"), all_("unknown_rules").alias("rules"), all_("bad_levels").alias("levels"), F.max("bad_depth").alias("depth")).first()
        if wrong["n"]:
            said = f"unknown rule IDs: {wrong['rules']}" if wrong["rules"] else f"unknown levels: {wrong['levels']}" if wrong["levels"] else f"max_wrapper_depth {wrong['depth']} exceeds the maximum of 255"
            raise ValueError(said)
    return out


def validate(documents: DataFrame, overrides: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(verdicts, findings) of ``documents`` (doc_id, xml, further context columns). Each of the two parses the documents once."""
    findings = run_rules(kinds(prepared(documents)))
    return verdicts_of(documents, overrides), findings if overrides is None else apply_policy(findings, overrides)


VERSION_TYPE = "struct<source:string,declared:string,inferred:string,consistent:boolean,effective:string>"
_META = ("document_type", "input_status", "version")


def _by_document(nodes: DataFrame) -> DataFrame:
    """(doc_id, meta, errors, warnings, infos) of each document from its kinds, which tell its number; documents are whole in a batch of the shredder's."""
    schema = StructType.fromDDL(f"doc_id string, caller string, document_type string, input_status string, version {VERSION_TYPE}, errors long, warnings long, infos long")
    shape = to_arrow_schema(schema)
    top = F.col("node_id") == 0
    told = document_columns()
    # each mark in a text of hits is one; the inline keeps the filter from asking for the hits again
    times = lambda h, mark: F.length(h) - F.length(F.replace(h, F.lit(mark), F.lit("")))
    sums = F.transform("__hits", lambda h: F.struct(*(times(h, MARKS[k]).cast("long").alias(f"{LEVELS[k]}s") for k in LEVELS)))
    keep_methods_small(nodes.sparkSession)
    meta = [F.when(top, told["status" if c == "input_status" else c]).alias(c) for c in _META]
    rows = nodes.select(top.alias("top"), "documents", F.col("members")["doc_id"].alias("doc_ids"), F.col("members")["caller"].alias("callers"), *meta, F.array(hits()).alias("__hits"))
    rows = rows.select("*", F.inline_outer(sums)).drop("__hits").filter("top or errors + warnings + infos > 0")

    def total(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        lists = table.column("documents").combine_chunks()
        row = np.repeat(np.arange(table.num_rows), pc.list_value_length(lists).to_numpy())
        document = lists.flatten().to_numpy()
        document = document - (document[0] >> 32 << 32)
        root = table.column("top").to_numpy(zero_copy_only=False)[row]
        order = np.argsort(document[root], kind="stable")
        own = [pc.list_flatten(table.column(c).combine_chunks()).take(pa.array(order)) for c in ("doc_ids", "callers")]
        heads = [table.column(c).combine_chunks().take(pa.array(row[root][order])).cast(shape.field(c).type) for c in _META]
        counts = [np.bincount(document, table.column(f"{c}s").to_numpy()[row], minlength=len(order)).astype(np.int64) for c in LEVELS.values()]
        return pa.RecordBatch.from_arrays([*own, *heads, *map(pa.array, counts)], schema=shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(total, whole_batches(batches, lambda b: pc.list_element(b.column("documents"), 0).to_numpy()))

    return rows.mapInArrow(run, schema).select("doc_id", F.struct("caller", *_META).alias("meta"), "errors", "warnings", "infos")


def verdicts_of(documents: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(doc_id, caller, document_type, input_status, version, errors, warnings, infos, valid): a row for each document, in one pass.

    Findings are counted where they arise and summed by document within the task, so one row of a document is shuffled; with a policy
    they are looked up one by one before that.
    """
    if overrides is None:
        rows = _by_document(with_detection(shred(prepared(documents), kinds=True, counted=True)))
    else:
        nodes = kinds(prepared(documents))
        top = F.col("node_id") == 0
        told = [*document_columns().items()]
        rows = each_hit(nodes, [top.alias("top"), *(c.alias(name) for name, c in told), "members"], hits()).filter("top and coalesce(nth, 0) = 0 or hit <> ''")
        rows = rows.select("*", F.explode("members").alias("m"))
        meta = F.when(F.col("top"), F.struct("m.caller", "document_type", F.col("status").alias("input_status"), "version")).alias("meta")
        rows = rows.select("m.doc_id", "m.policy_id", meta, hit_rule(F.col("hit")).alias("r")).select("doc_id", "policy_id", "meta", "r.rule_id", "r.severity")
        rows = rows.join(policy_levels(overrides), ["policy_id", "rule_id"], "left")
        severity = overridden(F.col("rule_id"), F.col("severity"), F.col("level"))
        rows = rows.select("doc_id", "meta", *(F.coalesce(severity == s, F.lit(False)).cast("long").alias(f"{s}s") for s in LEVELS.values()))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    rows = rows.groupBy("doc_id").agg(F.first("meta", ignorenulls=True).alias("meta"), total("errors"), total("warnings"), total("infos"))
    return rows.select("doc_id", "meta.*", "errors", "warnings", "infos", (F.col("errors") == 0).alias("valid"))


def gate(verdicts: DataFrame, no_fail: bool = False, fail_on_warning: bool = False) -> DataFrame:
    bad = (F.col("errors") > 0) | ((F.col("warnings") > 0) if fail_on_warning else F.lit(False))
    return verdicts.agg((F.lit(no_fail) | ~F.coalesce(F.bool_or(bad), F.lit(False))).alias("passed"))


def enrich(findings: DataFrame, catalog: DataFrame) -> DataFrame:
    """``findings`` with source, revenue_impact, default_severity and description; the catalog has under 300 rows."""
    return findings.join(F.broadcast(catalog.select("rule_id", "source", "revenue_impact", "default_severity", "description")), "rule_id", "left")


def filter_findings(findings: DataFrame, sources: list[str] | None = None, severities: list[str] | None = None, revenue_only: bool = False) -> DataFrame:
    for column, values in (("source", sources), ("severity", severities)):
        if values is not None:
            findings = findings.filter(F.col(column).isin(values))
    return findings.filter("revenue_impact") if revenue_only else findings


def catalog_digest(catalog: DataFrame) -> DataFrame:
    """The sha-256 of the ordered catalog, one row."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "rule_id", "default_severity", "source"))), lambda r: F.concat_ws("\x1f", r["rule_id"], r["default_severity"], r["source"]))
    return catalog.agg(F.concat(F.lit("sha256:"), F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\x1e"))), ""), 256)).alias("digest"))


def stamp_provenance(verdicts: DataFrame, catalog_version: str, digest: str, engine_version: str) -> DataFrame:
    return verdicts.withColumns({"catalog_version": F.lit(catalog_version), "catalog_digest": F.lit(digest), "engine_version": F.lit(engine_version)})


FINDING_KEY = ["doc_id", "rule_id", "severity", "path", "spec_ref", "line", "col"]


def diff_findings(left: DataFrame, right: DataFrame) -> DataFrame:
    """(side, finding key): what only one of two result sets has, repeats counted."""
    left, right = left.select(FINDING_KEY), right.select(FINDING_KEY)
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def what_if_version(documents: DataFrame, target: str) -> DataFrame:
    """What changes if all documents were of version ``target``: the differences of their findings, in one pass.

    The elements stay as they are, so the rules run twice over each kind of element, and only hits of one side go on.
    """
    changed = ("trail", "first", "main", "ver")
    nodes = shred(prepared(documents), kinds=True).withColumns({f"__{c}": F.col(c) for c in changed})
    nodes = with_detection(nodes).withColumns({"__own": F.split(hits(), "\n"), "__own_paid": F.col("paid")})
    nodes = with_detection(nodes.withColumns({c: F.col(f"__{c}") for c in changed}), target).withColumn("__then", F.split(hits(), "\n"))
    only = lambda a, b: F.filter(a, lambda x: (x != "") & ~F.array_contains(b, x))
    side = lambda name, a, b, paid: F.transform(only(a, b), lambda x: F.struct(F.lit(name).alias("side"), x.alias("hit"), F.col(paid).alias("paid")))
    sides = F.concat(side("left", "__own", F.col("__then"), "__own_paid"), side("right", "__then", F.col("__own"), "paid"))
    shared = [c for c in KIND_COLUMNS if c != "paid"]
    rows = nodes.select(*shared, "members", sides.alias("__sides")).select("*", F.explode_outer("__sides").alias("s")).filter("s.hit <> ''")
    rows = rows.select(*shared, "s", F.explode("members").alias("m")).select(*shared, "s.*", "m.*")
    return findings_of(rows, "side").select("side", *FINDING_KEY)


def catalog_vs_docs(catalog: DataFrame, described: DataFrame) -> DataFrame:
    """(rule_id, status): rules missing from, surplus in or of another severity in ``described`` (rule_id, severity)."""
    both = catalog.select("rule_id", "default_severity").join(described.select("rule_id", "severity"), "rule_id", "full_outer")
    status = F.when(F.col("severity").isNull(), "missing").when(F.col("default_severity").isNull(), "extra").when(F.col("severity") != F.col("default_severity"), "severity")
    return both.select("rule_id", status.alias("status")).filter("status is not null")


