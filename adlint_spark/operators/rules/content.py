"""The content model: which children and attributes each element may have."""

from __future__ import annotations

from pyspark.sql import functions as F

from adlint_spark.functions.model import ATTRIBUTES, KNOWN, LATE, MODEL, PLACING, RENAMING, SINCE, TOLD_IN
from adlint_spark.functions.values import among, is_uri_like
from adlint_spark.operators.rules.spec import INLINE, TEXT, VAST, WRAPPER, Rule, above, inside, is_v4, leaf, on, rule

XSD, SPEC = "VAST XSD", "VAST spec"

def trails() -> dict[str, list[str]]:
    """element -> the trails on which the content model reaches it; a trail ends where a child isn't allowed."""
    out = {"InLine": [INLINE], "Wrapper": [WRAPPER]}
    todo = [("InLine", INLINE), ("Wrapper", WRAPPER)]
    while todo:
        name, trail = todo.pop()
        for kid in MODEL[name]:
            below = f"{trail}/{kid}"
            out.setdefault(kid, []).append(below)
            if kid in MODEL:
                todo.append((kid, below))
    return out


#: The content model reads the first InLine and the first Wrapper of an Ad, and all below them.
READ = VAST & F.col("main")


def unknown_child() -> list[Rule]:
    """Told at the child, whose parent's trail the content model knows."""
    out, where = [], trails()
    own = F.col("name")
    for parent, kids in MODEL.items():
        late = LATE.get(parent, ())
        end = F.concat(F.lit("/"), own)
        if parent in PLACING:
            end = F.concat(F.lit("/"), own, F.lit("["), F.col("pos"), F.lit("]"))
        elif parent in RENAMING:
            end = F.concat(F.lit(f"/{next(iter(kids))}["), F.col("pos"), F.lit("]"))
        told = (f"VAST-{SINCE.get(parent, '2.0')}-{parent.lower()}-unknown-child", "E", XSD, f"{parent} has an unknown child")
        out.append(rule(*told, "", above(*where[parent]) & READ & ~among(own, list(kids)), TOLD_IN[parent], mode="schema_up", each=F.array(end), gate="odd"))
        if late:
            early = ~F.coalesce(is_v4(), F.lit(False))
            out.append(rule(*told, " ".join(late), early & above(*where[parent]) & READ, TOLD_IN[parent], mode="schema_up", each=F.array(end)))
    return out


def text_and_attributes() -> list[Rule]:
    where = trails()
    leaves: dict[tuple[str, ...], dict[str, list[str]]] = {}
    for parent, allowed in MODEL.items():
        for kid, attributes in allowed.items():
            if attributes is not None:
                leaves.setdefault(attributes, {}).setdefault(kid, []).extend(f"{t}/{kid}" for t in where[parent])
    holders: dict[tuple[str, ...], dict[str, list[str]]] = {}
    for name, attributes in ATTRIBUTES.items():
        holders.setdefault(attributes, {})[name] = ["VAST"] if name == "VAST" else ["VAST/Ad"] if name == "Ad" else where[name]
    places = sorted({t for kids in leaves.values() for ts in kids.values() for t in ts})
    end = F.array(F.concat(F.lit("/"), F.col("name")))
    out = [rule("VAST-2.0-text-only-element", "E", XSD, "an element that holds text has children", "", above(*places) & READ, "IAB VAST 2.0 §2", mode="schema_up", each=end, gate="odd")]
    for group in (leaves, holders):
        for attributes, elements in group.items():
            out.append(_unknown_attribute(sorted(elements), [t for ts in elements.values() for t in ts], attributes))
    return out


def _unknown_attribute(names: list[str], places: list[str], allowed: tuple[str, ...]) -> Rule:
    own = F.coalesce("bare_attrs", F.map_keys("attr"))
    extra = F.filter(own, lambda a: ~among(a, allowed)) if allowed else own
    some = F.size(F.array_except(own, F.expr("array(" + ", ".join(f"'{a}'" for a in allowed) + ")"))) > 0 if allowed else F.size(own) > 0
    ends = F.transform(extra, lambda a: F.concat(F.lit("[@"), a, F.lit("]")))
    return rule("VAST-2.0-unknown-attribute", "W", XSD, "an unknown attribute", " ".join(names), (F.size("attr") > 0) & some & READ & on(*places), "IAB VAST 2.0 §2", mode="schema", each=ends)


def vendor_extensions() -> list[Rule]:
    out = []
    for holder, prefix in (("Extension", "extension"), ("CreativeExtension", "creative-extension")):
        # the names between the extension and the element
        steps = F.split("trail", "/")
        between = F.filter(steps, lambda a, i: (i >= F.array_position(steps, holder)) & (i < F.size(steps) - 1))
        inner = READ & ~F.col("fits") & inside(holder)
        outermost = among(F.col("name"), KNOWN) & ~F.exists(between, lambda a: among(a, KNOWN))
        plain = (F.col("name") == holder) & READ & leaf() & ~F.col("has_cdata") & TEXT.rlike("[&<]") & ~is_uri_like(TEXT)
        out += [
            rule(f"VAST-2.0-{prefix}-misplaced-element", "W", SPEC, "an element of the ad stands in an extension", "", inner & outermost, "IAB VAST 2.0 §2", mode="inner", gate="vendor_ext"),
            rule(f"VAST-2.0-{prefix}-cdata", "W", "W3C XML 1.0", "markup in an extension is not in a CDATA section", holder, plain, "W3C XML 1.0 §2.7", mode="schema"),
        ]
    return out


FAMILIES = {f.__name__: f for f in (unknown_child, text_and_attributes, vendor_extensions)}
