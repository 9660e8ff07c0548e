"""Deterministic repairs of documents, and their report by rule."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from adlint_spark.functions.values import is_simid
from adlint_spark.operators.detect import doc_meta
from adlint_spark.operators.rules import run_rules
from adlint_spark.operators.verdicts import elements, prepared
from adlint_spark.sources.shred import CHUNK_BYTES, Tree, parse, take_apart

TRACKING = (
    "Impression Error ClickThrough ClickTracking CustomClick IconClickThrough IconClickTracking IconViewTracking NonLinearClickThrough "
    "NonLinearClickTracking CompanionClickThrough CompanionClickTracking Viewable NotViewable ViewUndetermined VASTAdTagURI Tracking"
).split()
#: Repairs in the order that they are applied and reported: the rule, and what is said of it.
REPAIRS = {
    "VAST-2.0-mediafile-https": "%d HTTP URL(s) upgraded to HTTPS",
    "VAST-2.0-tracking-https": "%d HTTP URL(s) upgraded to HTTPS",
    "SIMID-1.0-simid-url-https": "%d SIMID file URL(s) upgraded to HTTPS",
    "SIMID-1.1-iframe-simid-url-https": "%d SIMID frame URL(s) upgraded to HTTPS",
    "SIMID-1.0-simid-apiframework-case": "apiFramework written as SIMID on %d element(s)",
    "SIMID-1.0-simid-variable-duration-value": "variableDuration written as true on %d element(s)",
    "SIMID-1.0-simid-type-required": 'type="text/html" added to %d SIMID file(s)',
    "SIMID-1.1-iframe-simid-type-required": 'type="text/html" added to %d SIMID frame(s)',
    "VAST-4.0-conditionalad": "conditionalAd removed",
}
APPLIED = "array<struct<rule_id:string,n:int,description:string,path:string>>"
_HTTP = re.compile("http://", re.I | re.A)
# what is not a tag of an element is matched first, so that it is passed over whole
_MARKUP = re.compile(
    r"<!\[CDATA\[.*?(?:\]\]>|\Z)|<!--.*?(?:-->|\Z)|<\?.*?(?:\?>|\Z)|<!.*?(?:>|\Z)"
    r"|</[ \t\r\n]*(?P<end>[A-Za-z0-9_:.-]+)[ \t\r\n]*>"
    r"|<(?P<start>[A-Za-z_:][A-Za-z0-9_:.-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^\"'>])*+)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([A-Za-z0-9_:.-]+)(?:[ \t\r\n]*=[ \t\r\n]*(?:\"([^\"]*)\"|'([^']*)'|([^ \t\r\n>/\"']*)))?", re.S)
_SIMID_WORDS = ("apiFramework", "InteractiveCreativeFile", "IFrameResource")


def upgrade_https(xml: Column) -> Column:
    """struct<xml, n>: every http:// made https://, and how many."""
    return F.struct(F.regexp_replace(xml, "(?i)http://", "https://").alias("xml"), F.regexp_count(xml, F.lit("(?i)http://")).alias("n"))


def https_hits(nodes: DataFrame) -> DataFrame:
    """(doc_id, media, tracking, simid_files, simid_frames): elements of each kind whose text starts with http://."""
    rows = nodes.filter(F.lower(F.substring("text", 1, 7)) == "http://")
    own = F.coalesce(is_simid(F.col("attr")["apiFramework"]), F.lit(False))
    name = F.col("name")
    frame = (name == "IFrameResource") & (own | F.expr("coalesce(facts['#simid'] = '1', false)"))
    kinds = {"media": name == "MediaFile", "tracking": name.isin(TRACKING), "simid_files": (name == "InteractiveCreativeFile") & own, "simid_frames": frame}
    return rows.groupBy("doc_id").agg(*(F.count_if(c).alias(k) for k, c in kinds.items())).filter("media + tracking + simid_files + simid_frames > 0")


# ---------------------------------------------------------------- texts, inside tasks


def _intent(value: str | None) -> bool:
    return value is not None and value.strip().lower() == "simid"


def insecure(tree: Tree) -> dict[str, int]:
    """The parsed elements whose text is an http:// URL, by the rule that their upgrade answers."""
    value = lambda i, name: next((a[k + 1] for a in (tree.attrs[i],) for k in range(0, len(a), 2) if a[k].rpartition(":")[2] == name), None)
    out = dict.fromkeys(list(REPAIRS)[:4], 0)
    meant: list[bool] = []  # whether the nearest NonLinear at or above an element is meant for SIMID
    for i, (name, parent) in enumerate(zip(tree.names, tree.parents, strict=True)):
        above = parent >= 0 and meant[parent]
        meant.append(_intent(value(i, "apiFramework")) if name == "NonLinear" else above)
        if tree.texts[i][:7].lower() != "http://":
            continue
        if name == "MediaFile":
            out["VAST-2.0-mediafile-https"] += 1
        elif name == "InteractiveCreativeFile":
            out["SIMID-1.0-simid-url-https"] += _intent(value(i, "apiFramework"))
        elif name == "IFrameResource":
            out["SIMID-1.1-iframe-simid-url-https"] += _intent(value(i, "apiFramework")) or above
        elif name in TRACKING:
            out["VAST-2.0-tracking-https"] += 1
    return out


class _Tag:
    """A start tag's text and its attributes' places."""

    def __init__(self, text: str, name: str):
        self.text, self.head = text, 1 + len(name)

    def find(self, name: str) -> re.Match | None:
        at = self.head
        while (m := _ATTRIBUTE.search(self.text, at)) is not None:
            if m[1] == name:
                return m
            at = m.end()
        return None

    def value(self, name: str) -> str | None:
        m = self.find(name)
        return None if m is None else next((g for g in m.groups()[1:] if g is not None), "")

    def put(self, name: str, value: str) -> bool:
        """Replaces a quoted value; tells whether there was one."""
        m = self.find(name)
        k = None if m is None else 2 if m[2] is not None else 3 if m[3] is not None else None
        if k is not None:
            self.text = self.text[: m.start(k)] + value + self.text[m.end(k) :]
        return k is not None

    def add(self, attribute: str) -> None:
        body = self.text[:-1].rstrip()
        cut = len(body) - 1 if body.endswith("/") else len(self.text) - 1
        gap = "" if self.text[cut - 1].isspace() else " "
        self.text = f"{self.text[:cut]}{gap}{attribute}{self.text[cut:]}"


def rewrite_simid(xml: str, files: int, frames: int) -> tuple[str, dict[str, int]]:
    """The text with the SIMID repairs, and how many of each. ``files`` and ``frames`` are how many there are as parsed: where
    the text shows another number of their tags, no type is added."""
    tags = [m["start"].rpartition(":")[2] for m in _MARKUP.finditer(xml) if m["start"]]
    add_file, add_frame = tags.count("InteractiveCreativeFile") == files, tags.count("IFrameResource") == frames
    done = dict.fromkeys(list(REPAIRS)[4:8], 0)
    around: list[bool] = []

    def piece(m: re.Match) -> str:
        if m["end"]:
            if m["end"].rpartition(":")[2] == "NonLinear" and around:
                around.pop()
            return m[0]
        if not m["start"]:
            return m[0]
        name, tag = m["start"].rpartition(":")[2], _Tag(m[0], m["start"])
        api = tag.value("apiFramework")
        if _intent(api) and api != "SIMID":
            tag.put("apiFramework", "SIMID")
            done["SIMID-1.0-simid-apiframework-case"] += 1
        if name == "InteractiveCreativeFile" and _intent(api):
            known = (tag.value("variableDuration") or "").strip()
            if known.lower() == "yes" or known == "1" or known.lower() == "true" and known != "true":
                tag.put("variableDuration", "true")
                done["SIMID-1.0-simid-variable-duration-value"] += 1
            if add_file and tag.find("type") is None:
                tag.add('type="text/html"')
                done["SIMID-1.0-simid-type-required"] += 1
        if name == "IFrameResource" and add_frame and around and (_intent(api) or around[-1]) and tag.find("type") is None:
            tag.add('type="text/html"')
            done["SIMID-1.1-iframe-simid-type-required"] += 1
        if name == "NonLinear" and not m[0][:-1].rstrip().endswith("/"):
            around.append(_intent(api))
        return tag.text

    return _MARKUP.sub(piece, xml), done


def remove_conditional_ad(xml: str) -> str:
    """The text without conditionalAd attributes and the blanks before them."""
    first, *rest = xml.split("conditionalAd=")
    out = [first]
    for part in rest:
        while out and not (kept := out.pop().rstrip(" \t")):
            pass
        out.append(kept if out or kept else "")
        if part[:1] in ('"', "'"):
            part = part[1:].partition(part[0])[2]
        out.append(part)
    return "".join(out)


def repaired(xml: str) -> tuple[str, dict[str, int]]:
    """The repaired text, and how often each repair was applied. An upgrade is told of elements as parsed, up to an error if there is one."""
    applied: dict[str, int] = {}
    upgraded = _HTTP.sub("https://", xml)
    simid = any(w in xml for w in _SIMID_WORDS)
    if upgraded != xml or simid:
        tree = parse(xml)[0]
        if upgraded != xml:
            applied |= insecure(tree)
        if simid:
            upgraded, done = rewrite_simid(upgraded, tree.names.count("InteractiveCreativeFile"), tree.names.count("IFrameResource"))
            applied |= done
    without = remove_conditional_ad(upgraded) if "conditionalAd=" in upgraded else upgraded
    applied["VAST-4.0-conditionalad"] = int(without != upgraded)
    return without, {k: n for k, n in applied.items() if n}


# ---------------------------------------------------------------- documents


def well_formed(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """``documents`` that can be parsed, by their ``nodes``."""
    return documents.join(doc_meta(nodes).filter("parse_error is null").select("doc_id"), "doc_id", "left_semi")


def _plain_upgrades(texts: pa.StringArray, known: dict) -> dict[int, dict[str, int]]:
    """By a text's number what ``repaired`` tells of it, of those that are plain documents and have nothing to repair but http:// URLs."""
    found = take_apart(texts, known)
    if not len(found.documents):
        return {}
    owner = np.repeat(np.arange(len(found.documents)), np.diff(np.append(found.starts, len(found.name))))
    insecure = pc.starts_with(pc.ascii_lower(pc.utf8_slice_codeunits(found.texts, 0, 7)), "http://").to_numpy(zero_copy_only=False)
    count = lambda names: np.bincount(owner[insecure & np.isin(found.name, [k for k, x in enumerate(found.names) if x in names])], minlength=len(found.documents)).tolist()
    told = zip(found.documents.tolist(), count({"MediaFile"}), count(TRACKING), strict=True)
    return {d: {k: n for k, n in zip(list(REPAIRS)[:2], some, strict=True) if n} for d, *some in told}


def fix(documents: DataFrame, told: bool = True) -> DataFrame:
    """``documents`` (xml, further columns) with repaired xml, and ``applied``, the repairs by rule: how often, what was done, and /VAST.

    Layout, comments and CDATA sections stay as they are; only http:// is upgraded in any place, and told of the elements
    whose text it is. Documents without anything to repair pass as they are, and null stays null. No shuffle. Without ``told`` there is no
    ``applied``, and texts with http:// alone need not be parsed.
    """
    names = [c for c in documents.columns if c not in ("xml", "applied")]
    rows = documents.select(*names, "xml")
    schema = StructType([*rows.schema.fields, *(StructType.fromDDL("__rules array<string>, __times array<int>").fields if told else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            column = batch.column("xml").cast(pa.string())
            has = lambda what, x=column: pc.fill_null(pc.match_substring(x, what, ignore_case=what == "http://"), False).to_numpy(zero_copy_only=False)
            more = np.logical_or.reduce([has(w) for w in (*_SIMID_WORDS, "conditionalAd=")])
            upgrade = has("http://") & ~more
            rows = np.flatnonzero(upgrade)
            done: dict[int, dict[str, int]] = {}
            if told and len(rows):
                some, size, begin = column.take(pa.array(rows)), np.concatenate([[0], np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False)[rows])]), 0
                while begin < len(rows):
                    end = max(begin + 1, int(np.searchsorted(size, size[begin] + CHUNK_BYTES, side="right")) - 1)
                    done |= {int(rows[begin + d]): x for d, x in _plain_upgrades(some.slice(begin, end - begin), known).items()}
                    begin = end
                more[[i for i in rows.tolist() if i not in done]] = True
            new = pc.if_else(pa.array(upgrade), pc.replace_substring_regex(column, "(?i)http://", "https://"), column)
            at = np.flatnonzero(more)
            if len(at):
                each = [repaired(x) for x in column.take(pa.array(at)).to_pylist()]
                new = pc.replace_with_mask(new, pa.array(more), pa.array([x for x, _ in each], pa.string()))
                done |= {i: x for i, (_, x) in zip(at.tolist(), each, strict=True)}
            columns = [new]
            if told:
                each = [done.get(i, {}) for i in range(len(new))]
                columns += [pa.array([list(x) for x in each], pa.list_(pa.string())), pa.array([list(x.values()) for x in each], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *columns], names=schema.names)

    said = F.create_map(*(x for rule, text in REPAIRS.items() for x in (F.lit(rule), F.lit(text))))
    one = lambda rule, n: F.struct(rule.alias("rule_id"), n.alias("n"), F.replace(said[rule], F.lit("%d"), n.cast("string")).alias("description"), F.lit("/VAST").alias("path"))
    fixed = rows.mapInArrow(run, schema)
    if not told:
        return fixed
    return fixed.select(*names, "xml", F.zip_with("__rules", "__times", one).cast(APPLIED).alias("applied"))


def fix_report(fixed: DataFrame) -> DataFrame:
    """(doc_id, rule_id, n, description, path): a row for each repair of each document. A dry run is this alone."""
    return fixed.select("doc_id", F.explode_outer("applied").alias("a")).filter("a is not null").select("doc_id", "a.*")


def remaining(fixed: DataFrame) -> DataFrame:
    """The findings that are left after the repairs."""
    return run_rules(elements(prepared(fixed)))
