"""What a document is: masks and unescaping before the parse, type, status and version after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlint_spark.functions.values import VERSIONS, trimmed, version_ord

PLACEHOLDER_URL = "https://placeholder.invalid/"


def mask_templates(xml: Column, pattern: str, placeholder: str = PLACEHOLDER_URL) -> Column:
    """Every match of a template pattern replaced by a placeholder URL."""
    return F.regexp_replace(xml, pattern, placeholder)


def is_json_escaped(xml: Column) -> Column:
    """An escaped open tag, and no plain one."""
    plain = xml.contains('<VAST version="') | xml.contains("<VAST version='") | xml.contains('<vast version="') | xml.contains("<vast version='")
    escaped = xml.contains('<VAST version=\\"') | xml.contains('<vast version=\\"') | xml.contains("\\n<VAST") | xml.contains("\\n<vast")
    return escaped & ~plain


def _unescape_once(xml: Column) -> Column:
    # a doubled backslash is set aside first, so the passes act like one from left to right
    out = F.replace(xml, F.lit("\\\\"), F.lit("\x00"))
    for escaped, plain in (("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), ('\\"', '"'), ("\\/", "/")):
        out = F.replace(out, F.lit(escaped), F.lit(plain))
    return F.replace(out, F.lit("\x00"), F.lit("\\"))


def unescape_json_vast(documents: DataFrame, layers: int = 4) -> DataFrame:
    """``documents`` with JSON-escaped xml unescaped up to ``layers`` times, left as it was if that doesn't help, and was_escaped.

    Each layer is a column of its own: nested in one expression they would multiply.
    """
    rows = documents.withColumns({"was_escaped": F.coalesce(is_json_escaped(F.col("xml")), F.lit(False)), "__layer": F.col("xml")})
    for k in range(layers):
        again = F.col("was_escaped") if k == 0 else F.col("was_escaped") & is_json_escaped(F.col("__layer"))
        rows = rows.withColumn("__layer", F.when(again, _unescape_once(F.col("__layer"))).otherwise(F.col("__layer")))
    return rows.withColumn("xml", F.when(F.col("was_escaped") & ~is_json_escaped(F.col("__layer")), F.col("__layer")).otherwise(F.col("xml"))).drop("__layer")


def guard_document(xml: Column, max_bytes: int = 4 << 20) -> Column:
    """Why a document can't be parsed at all: too large, or a character that XML forbids; else null. The shredder says the same; this tells it without a parse."""
    return F.when(F.octet_length(xml) > max_bytes, "document too large").when(xml.rlike("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\ufffe\\uffff]"), "invalid character")


def document_type(root_name: Column) -> Column:
    return F.when(root_name == "VMAP", "VMAP").when(root_name == "DAAST", "DAAST").otherwise("VAST")


def declared_version(root_name: Column, version: Column) -> Column:
    version = trimmed(version)
    version = F.when(version == "2.0.1", "2.0").otherwise(version)
    return F.when((root_name == "VAST") & version.isin(*VERSIONS), version)


def input_status(parse_error: Column, root_name: Column, version: Column) -> Column:
    fits = F.when(root_name == "VMAP", trimmed(version) == "1.0").when(root_name == "DAAST", trimmed(version).isin("1.0", "1.1")).otherwise((root_name == "VAST") & (version.isNull() | declared_version(root_name, version).isNotNull()))
    return F.when(parse_error.isNotNull(), "malformed").when(F.coalesce(fits, F.lit(False)), "supported").otherwise("unsupported")


def detect_version(declared: Column, inferred: Column, forced: Column, kind: Column) -> Column:
    """struct<source, declared, inferred, consistent, effective>; a forced version counts as declared, other types have none."""
    declared = F.when(kind == "VAST", F.coalesce(forced, declared))
    inferred = F.when((kind == "VAST") & forced.isNull(), inferred)
    both = declared.isNotNull() & inferred.isNotNull()
    source = F.when(both, "declared_and_inferred").when(declared.isNotNull(), "declared").when(inferred.isNotNull(), "inferred").otherwise("unknown")
    return F.struct(source.alias("source"), declared.alias("declared"), inferred.alias("inferred"), F.when(both, version_ord(declared) >= version_ord(inferred)).alias("consistent"), F.coalesce(declared, inferred).alias("effective"))


def document_columns(target: str | None = None) -> dict[str, Column]:
    """document_type, status and version (struct) from what an element row tells of its document. Where only roots ask for them, their rows alone need them worked out."""
    kind, root, version = document_type(F.col("root_name")), F.col("root_name"), F.col("root_version")
    forced = F.when(F.col("base").isNull(), F.col("forced_version") if target is None else F.lit(target))
    return {"document_type": kind, "status": input_status(F.col("parse_error"), root, version), "version": detect_version(declared_version(root, version), F.col("inferred"), forced, kind)}


def with_detection(nodes: DataFrame, target: str | None = None) -> DataFrame:
    """``nodes`` with document_type, status, version (struct), v, the effective version's number, and whether rules of VAST apply.

    ``target`` is a version that all documents are taken for; VAST inside a playlist keeps its own, as with forced_version.
    The payload of a standardised CTV extension that fits the version (``paid``) is read like the element that it stands for: at its
    ``native`` trail, under the version whose model it has.
    """
    ver = F.col("ver") if target is None else F.when(F.col("base").isNull() & (document_type(F.col("root_name")) == "VAST"), F.lit(VERSIONS.index(target))).otherwise(F.col("ver"))
    vast = F.expr("root_name = 'VAST' and parse_error is null")
    # of most elements nothing but their being in no payload is looked at
    paid = F.when(F.col("payload").isNull(), False).otherwise(F.coalesce(F.col("ctv_from").isNotNull() & (ver.isNull() | ver.between(F.col("ctv_from"), F.col("ctv_to"))), F.lit(False)))
    native = paid & F.col("native").isNotNull()
    v = F.when(~paid, ver).when(F.col("payload") == "Icon", 1).when(F.col("payload").isin("AdVerifications", "Mezzanine"), 3).otherwise(ver)
    made = {
        **document_columns(target),
        "vast": vast,
        "ver": ver,
        "fits": F.coalesce(F.col("ctv_from").isNotNull() & (ver.isNull() | ver.between(F.col("ctv_from"), F.col("ctv_to"))), F.lit(False)),
        "paid": paid,
        "v": v,
        "trail": F.when(native, F.col("native")).otherwise(F.col("trail")),
        "visited": vast & (~F.col("vendor_ext") | native | (paid & (F.col("payload") == "Mezzanine") & (F.col("name") == "Mezzanine"))),
        "first": F.col("first") | native,
        "main": F.col("main") | native,
    }
    return nodes.withColumns(made)  # at once: each projection on its way copies the wide rows


def doc_meta(nodes: DataFrame) -> DataFrame:
    """A row for each document: its root's."""
    return nodes.filter("node_id = 0").select("doc_id", "caller", "policy_id", "document_type", F.col("status").alias("input_status"), "version", "root_name", "parse_error")


def first_wrapper_uri(xml: Column) -> Column:
    """The text of the first literal VASTAdTagURI element, trimmed, out of its CDATA section; null if there is none."""
    inner = trimmed(F.regexp_extract(xml, r"(?s)<VASTAdTagURI>(.*?)</VASTAdTagURI>", 1))
    return F.nullif(trimmed(F.regexp_replace(inner, r"(?s)^<!\[CDATA\[(.*)\]\]>$", "$1")), F.lit(""))


_INSPECTED = "InLine Wrapper AdSystem AdTitle Duration Impression Tracking Companion VASTAdTagURI".split()
#: Columns of elements' texts, and of numbers of elements.
_LAST = {"ad_system": "AdSystem", "ad_title": "AdTitle", "duration": "Duration", "wrapper_uri": "VASTAdTagURI"}
_COUNTED = {"impressions": "Impression", "trackings": "Tracking", "companions": "Companion"}
_INSPECTED_TYPE = "doc_id string, " + ", ".join(f"{c} string, {c}_at int" for c in ("ad_type", *_LAST)) + ", " + ", ".join(f"{c} long" for c in _COUNTED)


def _inspected(batch):
    """A row for each document of a batch of elements in order: the last name, or text, of some elements with its number, and counts."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    node = batch.column("node_id").to_numpy()
    document, name, text = np.cumsum(node == 0) - 1, batch.column("name"), batch.column("text")
    count = int(document[-1]) + 1 if len(node) else 0
    opened = batch.column("opened").to_numpy(zero_copy_only=False)
    named = {n: opened & pc.equal(name, n).to_numpy(zero_copy_only=False) for n in _INSPECTED}
    filled = pc.not_equal(text, "").to_numpy(zero_copy_only=False)
    columns = {"doc_id": batch.column("doc_id").filter(pa.array(node == 0))}
    for c, values, which in (("ad_type", name, named["InLine"] | named["Wrapper"]), *((c, text, named[n] & filled) for c, n in _LAST.items())):
        rows = np.flatnonzero(which)
        last = np.full(count, -1)
        np.maximum.at(last, document[rows], rows)
        at = pa.array(last, mask=last < 0)
        columns |= {c: values.take(at), f"{c}_at": batch.column("node_id").take(at)}
    columns |= {c: pa.array(np.bincount(document[named[n]], minlength=count).astype(np.int64)) for c, n in _COUNTED.items()}
    return pa.RecordBatch.from_pydict(columns)


def inspect(documents: DataFrame) -> DataFrame:
    """A row for each document of what its elements tell: ad type, system, title, duration, counts, wrapper URI.

    Of several the last non-empty one counts; tags with a prefix, tags closed at once and comments don't. Of a document
    that isn't well formed the elements up to the error count.
    """
    from adlint_spark.sources.shred import shred

    nodes = shred(documents.withColumn("xml", F.coalesce("xml", F.lit(""))), names=[*_INSPECTED], summed=(_inspected, _INSPECTED_TYPE))
    last = lambda c: F.max_by(c, f"{c}_at").alias(c)
    total = lambda c: F.sum(c).alias(c)
    # documents of one doc_id count as one
    return nodes.groupBy("doc_id").agg(last("ad_type"), last("ad_system"), last("ad_title"), last("duration"), total("impressions"), total("trackings"), total("companions"), last("wrapper_uri"))


def media_files(nodes: DataFrame) -> DataFrame:
    """A row for each MediaFile with a text."""
    return nodes.filter("name = 'MediaFile' and text <> ''").select("doc_id", F.col("text").alias("url"), F.col("attr")["type"].alias("mime_type"), *(F.col("attr")[c].alias(c) for c in ("delivery", "width", "height", "bitrate")))


#: Elements whose text is a URL.
URL_ELEMENTS = (
    "Impression Error ClickThrough ClickTracking CustomClick IconClickThrough IconClickTracking IconViewTracking NonLinearClickThrough NonLinearClickTracking "
    "CompanionClickThrough CompanionClickTracking Viewable NotViewable ViewUndetermined VASTAdTagURI"
).split()
MACRO_ELEMENTS = [*URL_ELEMENTS, *"MediaFile Tracking Mezzanine JavaScriptResource ExecutableResource InteractiveCreativeFile StaticResource IFrameResource ClosedCaptionFile".split()]


def url_inventory(nodes: DataFrame, kind: str = "macros") -> DataFrame:
    """A row for each element that carries a URL: its name, text, scheme and host."""
    names = MACRO_ELEMENTS if kind == "macros" else [*URL_ELEMENTS, "MediaFile", "Tracking"]
    rows = nodes.filter(F.col("name").isin(names) & F.col("parse_error").isNull())
    scheme = F.nullif(F.lower(F.regexp_extract("text", r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)), F.lit(""))
    host = F.nullif(F.lower(F.regexp_extract("text", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)), F.lit(""))
    return rows.select("doc_id", "spot", F.col("name").alias("kind"), F.col("text").alias("url"), scheme.alias("scheme"), host.alias("host"))


def bind_ctv_extensions(nodes: DataFrame) -> DataFrame:
    """(doc_id, payload, kind, status, target, target_name, playable, creatives): what the payload of each standardised CTV extension is bound to, by node_id.

    ``status`` is local (its own creative), matched (the one element with the id that it names), unmatched (none or several have it), first (it names
    none, and the first creative counts) or none. ``nodes`` has detection columns; only payloads in their place, version and shape are there.
    """
    fact = lambda c: F.col("facts")[c]
    rows = nodes.filter(F.col("paid") & (F.col("payload") == F.col("name")) & fact("#bind").isNotNull())
    media = (F.col("payload") != "UniversalAdId") & fact("#bind").isin("matched")
    target = F.when(fact("#target").isNotNull(), F.when(media, "MediaFile").otherwise("Creative"))
    return rows.select(
        "doc_id", F.col("node_id").alias("payload"), F.col("name").alias("kind"), fact("#bind").alias("status"), fact("#target").cast("int").alias("target"), target.alias("target_name"),
        F.coalesce(fact("#playable") == "1", F.lit(False)).alias("playable"), fact("#creatives").cast("int").alias("creatives"),
    )


def bind_portfolio(nodes: DataFrame) -> DataFrame:
    """(doc_id, extension, declared, status, target, native, creatives): the creative that each CTV portfolio extension describes, by node_id.

    ``status`` is matched, unmatched (no creative has the id), only (unnamed, and there is one) or unnamed; ``native`` tells that the creative has a resource of its own.
    """
    fact = lambda c: F.col("facts")[c]
    rows = nodes.filter(F.coalesce(fact("#portfolio") == "1", F.lit(False)) & F.col("first") & F.col("vast"))
    target = fact("#target").cast("int")
    named = F.coalesce(fact("#declared"), F.lit("")) != ""
    status = F.when(named & target.isNotNull(), "matched").when(named, "unmatched").when(target.isNotNull(), "only").otherwise("unnamed")
    return rows.select("doc_id", F.col("node_id").alias("extension"), fact("#declared").alias("declared"), status.alias("status"), target.alias("target"), (fact("#native") == "1").alias("native"), fact("#creatives").cast("int").alias("creatives"))


def tracking_inventory(nodes: DataFrame) -> DataFrame:
    rows = nodes.filter("name = 'Tracking' and parse_error is null")
    return rows.select("doc_id", F.col("attr")["event"].alias("event"), F.col("attr")["offset"].alias("offset"), F.col("text").alias("url"), F.try_element_at(F.split("trail", "/"), F.lit(-3)).alias("context"))
