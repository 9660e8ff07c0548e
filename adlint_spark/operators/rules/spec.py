"""How a rule is written down: a condition on an element row and the place that its finding names."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from adlint_spark.operators.rules import MARKS

#: Elements of VAST documents that can be read; those that the walker reaches: all but the inside of vendor extensions.
VAST, VISITED = F.col("vast"), F.col("visited")
V = F.col("v")
TEXT = F.col("text")
INLINE, WRAPPER = "VAST/Ad/InLine", "VAST/Ad/Wrapper"


@dataclass(frozen=True)
class Rule:
    """``names``: elements that it looks at (any if empty). ``when`` decides; ``each`` gives what the paths of several findings
    end with instead. ``mode`` is the form of the path (sem: numbers among namesakes; pos and schema: places among all siblings of
    all, or of some, steps; last: sem, the last step numbered whatever it is; up and schema_up: the parent's; top: /VAST; root: /;
    none: no path), ``suffix`` its fixed end. ``located``
    tells whose line and column are given: the element's own, its parent's (up) or none. ``default`` is the level in the catalog where ``level`` is that of a variant. ``gate`` is a
    column that is false for nearly all elements, where the rule needn't be looked at."""

    rule_id: str
    level: str
    source: str
    text: str
    names: tuple[str, ...]
    when: Column
    mode: str = "sem"
    suffix: str = ""
    each: Column | None = None
    located: str = "own"
    spec: str = ""
    default: str = ""
    gate: str = ""

    def hit(self, number: int) -> Column:
        """The line, or lines, of the row's hits if the rule is broken, else null."""
        mark = f"{MARKS[self.level]}{number}"
        found = F.lit(mark) if self.each is None else F.array_join(F.transform(self.each, lambda s: F.concat(F.lit(f"{mark}:"), s)), "\n")
        return F.when(self.when, found)


def rule(rule_id: str, level: str, source: str, text: str, names: str, when: Column, spec: str = "", **more) -> Rule:
    return Rule(rule_id, level, source, text, tuple(names.split()), when, spec=spec, **more)


def by_level(r: Rule, other: str, when: Column) -> list[Rule]:
    """The rule, and in its place one of level ``other`` where ``when`` holds."""
    weaker = F.coalesce(when, F.lit(False))
    return [replace(r, when=r.when & ~weaker), replace(r, level=other, default=r.level, when=r.when & weaker)]


def attr(name: str) -> Column:
    return F.expr(f"attr['{name}']")


def lacks(name: str) -> Column:
    return F.expr(f"attr['{name}'] is null")


def has(kid: str) -> Column:
    return F.expr(f"instr(kid_names, '/{kid}/') > 0")


def count_of(kid: str) -> Column:
    return F.size(F.filter("kids", lambda k: k["name"] == kid))


def at(*trails: str) -> Column:
    """The element stands there, as the first of its name where only the first counts."""
    return F.expr(f"vast and first and trail {_among(trails)}")


def on(*trails: str) -> Column:
    return F.expr(f"trail {_among(trails)}")


def _among(texts) -> str:
    listed = ", ".join(f"'{t}'" for t in texts)
    return f"= {listed}" if len(texts) == 1 else f"in ({listed})"


def inside(name: str) -> Column:
    return F.col("trail").contains(f"/{name}/")


def is_v4() -> Column:
    return V >= 2


def any_kid(test) -> Column:
    return F.exists("kids", test)


def above(*trails: str) -> Column:
    return F.expr(f"left(trail, length(trail) - length(name) - 1) {_among(trails)}")


def fact(name: str) -> Column:
    return F.expr(f"facts['{name}']")


def told(name: str) -> Column:
    """A fact that is there or isn't."""
    return F.expr(f"coalesce(facts['{name}'] = '1', false)")


def leaf() -> Column:
    return F.expr("kid_names = ''")


def any_grand(of: str, test) -> Column:
    """Whether a child of the first child ``of`` fits."""
    return F.exists("grand", lambda g: (g["of"] == of) & test(g))


def kids_at(test, name=None) -> Column:
    """For ``each``: the place and path end of the children that fit; ``name`` tells the last step from a child and its number."""
    name = name or (lambda k, i: k["name"])
    numbered = F.transform("kids", lambda k, i: F.when(test(k), F.concat(F.lit("@"), k["line"], F.lit(","), k["col"], F.lit(";/"), name(k, i))))
    return F.array_compact(numbered)
