"""The rule families: each a list of predicates over element rows, together the catalog."""

from __future__ import annotations

import json
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The severities by their letter, and the mark that a hit of each begins with.
LEVELS = {"E": "error", "W": "warning", "I": "info"}
MARKS = {"E": "\x01", "W": "\x02", "I": "\x03"}
#: Findings of these rules cost revenue.
REVENUE = frozenset(
    "VAST-2.0-inline-impression VAST-2.0-wrapper-impression VAST-2.0-wrapper-vastadtaguri VAST-2.0-mediafile-https VAST-2.0-tracking-https "
    "VAST-2.0-url-empty VAST-2.0-json-escaped VAST-2.0-duplicate-impression VAST-4.1-vpaid-apiframework VAST-2.0-flash-mediafile "
    "VAST-2.0-mediafile-image VAST-2.0-linear-tracking-quartiles VAST-2.0-duration-zero VAST-4.1-mezzanine-recommended VAST-4.1-vpaid-in-interactive-context".split()
)


@cache
def families() -> dict:
    """The families by name. Their modules hold columns, which need a running session, so they are read when first asked for."""
    from adlint_spark.operators.rules import audio, content, ctv, playlist, required, values

    return {**required.FAMILIES, **values.FAMILIES, **content.FAMILIES, **ctv.FAMILIES, **playlist.FAMILIES, **audio.FAMILIES}


@cache
def all_rules() -> tuple:
    """(family, rule) of all families; a rule's number is its place."""
    return tuple((name, rule) for name, family in families().items() for rule in family())


def rule_catalog(spark: SparkSession, sources: list[str] | None = None) -> DataFrame:
    """(ordinal, rule_id, family, default_severity, description, source, revenue_impact): a row for each rule."""
    seen: dict[str, tuple] = {}
    for name, r in all_rules():
        seen.setdefault(r.rule_id, (len(seen), r.rule_id, name, LEVELS[r.default or r.level], r.text, r.source, r.rule_id in REVENUE))
    rows = spark.createDataFrame(list(seen.values()), "ordinal int, rule_id string, family string, default_severity string, description string, source string, revenue_impact boolean")
    return rows.filter(F.col("source").isin(sources)) if sources is not None else rows


@cache
def hits(names: tuple[str, ...] = ()) -> Column:
    """The rules that an element row breaks, as one text: a line for each with its severity's mark, the rule's number and,
    for some rules, a colon and what its path ends with; empty for most rows.

    Rules are gathered by element name, so an element meets those of its name, those for any name, and behind a gate those
    for elements out of the ordinary. The parts are flat lists of cases, which Spark compiles one by one.
    """
    by_name: dict[str, list[Column]] = {}
    by_names: dict[tuple[str, ...], list[Column]] = {}
    by_gate: dict[str, list[Column]] = {}
    for number, (family, r) in enumerate(all_rules()):
        if names and family not in names:
            continue
        if not r.names:
            by_gate.setdefault(r.gate, []).append(r.hit(number))
        elif len(r.names) > 2:  # written once for all of them
            by_names.setdefault(r.names, []).append(r.hit(number))
        else:
            for name in r.names:
                by_name.setdefault(name, []).append(r.hit(number))
    parts = [F.when(F.expr(gate), F.concat_ws("\n", *found)) if gate else F.concat_ws("\n", *found) for gate, found in by_gate.items()]
    parts += [F.when(F.expr("name in (" + ", ".join(f"'{n}'" for n in some) + ")"), F.concat_ws("\n", *found)) for some, found in by_names.items()]
    named = None
    for name, found in by_name.items():
        case = (F.expr(f"name = '{name}'"), F.concat_ws("\n", *found))
        named = F.when(*case) if named is None else named.when(*case)
    return F.concat_ws("\n", *parts, *([] if named is None else [named]))


def keep_methods_small(spark: SparkSession) -> None:
    """Has Spark use generated code of a stage only if the JVM's compiler takes its methods; unless the session says otherwise.

    The rules in one method are so long that HotSpot would only interpret it. Under its own limit of 8000 bytes Spark evaluates them as many short
    methods, which are compiled.
    """
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "65535":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def each_hit(nodes: DataFrame, columns: list, lines: Column) -> DataFrame:
    """A row (``columns``, nth, hit) for each line of ``lines``, a text of hits, of each of ``nodes``; rows without a hit have an empty or null one.

    Such rows are left for a later filter to drop: an inner explode would have the optimizer ask for the hits twice.
    """
    keep_methods_small(nodes.sparkSession)
    return nodes.select(*columns, F.split(lines, "\n").alias("__hits")).select("*", F.posexplode_outer("__hits").alias("nth", "hit")).drop("__hits")


def hit_rule(hit: Column) -> Column:
    """The fixed parts of a hit's rule."""
    return F.element_at(_rule_table(), F.substring_index(F.substring(hit, 2, 1 << 20), ":", 1).try_cast("int") + 1)


@cache
def _rule_table() -> Column:
    """array of the rules' fixed parts by number; a literal after constant folding."""
    rows = [{"rule_id": r.rule_id, "severity": LEVELS[r.level], "message": r.text, "spec_ref": r.spec, "mode": r.mode, "suffix": r.suffix, "located": r.located} for _, r in all_rules()]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<rule_id:string,severity:string,message:string,spec_ref:string,mode:string,suffix:string,located:string>>")


#: Steps of the schema form that carry their place among all siblings.
PLACED = "Creative Tracking MediaFile Mezzanine InteractiveCreativeFile Icon Extension CreativeExtension Verification ClosedCaptionFile ClickThrough ClickTracking CustomClick".split()


def _path(mode: Column) -> Column:
    """The path of the element, or of its parent, from its ``spot`` in one of the forms that rules use."""
    from adlint_spark.sources.shred import INDEXED

    listed, placed = (F.expr("array(" + ", ".join(f"'{x}'" for x in sorted(names)) + ")") for names in (INDEXED, PLACED))
    steps = F.split("spot", "/")
    inside = F.col("trail").startswith("VAST/Ad/InLine/") | F.col("trail").startswith("VAST/Ad/Wrapper/")
    # the first extension on the way; the steps after a vendor's, and a standardised payload, are not numbered
    names = F.transform(steps, lambda s: F.substring_index(s, " ", 1))
    holder = F.array_position(F.transform(names, lambda n: n.isin("Extension", "CreativeExtension")), F.lit(True)) - 1
    up = mode.isin("up", "schema_up")

    def step(s: Column, i: Column) -> Column:
        part = F.split(s, " ")
        name, nth, pos = part[0], part[1], part[2]
        index = (
            F.when(i == 0, F.lit(None).cast("string"))
            .when(name == "Ad", nth)
            .when(mode == "pos", F.when((i > 2) & inside, pos))
            .when((mode == "inner") & (i > holder), F.lit(None).cast("string"))
            .when(F.col("paid") & (i == holder), nth)
            .when(F.col("paid") & (i == holder + 1), F.lit(None).cast("string"))
            .when(mode.isin("schema", "schema_up", "inner"), F.when(F.array_contains(placed, name), pos))
            .when(F.array_contains(listed, name) | ((mode == "last") & (i == F.size(steps) - 1)), nth)
        )
        return F.when(index.isNull(), F.concat(F.lit("/"), name)).otherwise(F.concat(F.lit("/"), name, F.lit("["), index, F.lit("]")))

    wanted = F.slice(F.transform(steps, step), F.lit(1), F.greatest(F.size(steps) - up.cast("int"), F.lit(0)))
    return F.array_join(wanted, "")


FINDING_COLUMNS = ["doc_id", "caller", "policy_id", "base", "spot", "trail", "paid", "line", "col", "up_line", "up_col"]
#: Those that all elements of a kind share.
KIND_COLUMNS = ["base", "spot", "trail", "paid"]


def run_rules(nodes: DataFrame, names: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, caller, policy_id, rule_id, severity, message, path, spec_ref, line, col): the findings of all rules over
    ``nodes`` with detection columns.

    One projection decides, then hits become rows. Paths and messages are made for findings alone. No shuffle. Where ``nodes`` are
    kinds of elements, each is decided once, and its findings are those of all its members.
    """
    if "members" in nodes.columns:
        rows = each_hit(nodes, [*KIND_COLUMNS, "members"], hits(tuple(names))).filter("hit <> ''")
        return findings_of(rows.select(*KIND_COLUMNS, "hit", F.explode("members").alias("m")).select(*KIND_COLUMNS, "hit", "m.*"))
    return findings_of(each_hit(nodes, FINDING_COLUMNS, hits(tuple(names))).filter("hit <> ''"))


def findings_of(rows: DataFrame, *more: str) -> DataFrame:
    """The findings of hits (FINDING_COLUMNS, hit); ``more`` columns are kept."""
    end = F.when(F.instr("hit", ":") > 0, F.expr("substring(hit, instr(hit, ':') + 1)"))
    rows = rows.withColumns({"r": hit_rule(F.col("hit")), "end": end})
    moved = F.col("end").startswith("@")  # a child's place, which the finding names instead of the row's
    tail = F.when(moved, F.expr("substring(end, instr(end, ';') + 1)")).otherwise(F.coalesce("end", F.lit("")))
    base, mode = F.coalesce("base", F.lit("")), F.col("r.mode")
    path = F.when(mode == "root", F.concat(base, F.lit("/"))).when(mode == "top", F.concat(base, F.lit("/VAST"))).when(mode == "none", F.col("base")).otherwise(F.concat(base, _path(mode), F.coalesce("r.suffix", F.lit("")), tail))

    def place(c: str, k: int) -> Column:
        own = F.when(moved, F.regexp_extract("end", r"^@(\d+),(\d+);", k).cast("int")).otherwise(F.col(c))
        return F.when(F.col("r.located") == "own", own).when(F.col("r.located") == "up", F.col(f"up_{c}")).alias(c)

    return rows.select(*more, "doc_id", "caller", "policy_id", "r.rule_id", "r.severity", "r.message", path.alias("path"), "r.spec_ref", place("line", 1), place("col", 2))


def find_rule(spark: SparkSession, rule_id: str) -> DataFrame:
    return rule_catalog(spark).filter(F.col("rule_id") == rule_id)
