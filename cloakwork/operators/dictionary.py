"""Pattern dictionaries of institutions, as one native expression.

Each pattern has literals, one of which every match must hold. One test of all of them lets most rows skip the whole
dictionary; in other rows only the patterns run whose own literals occur. Hits are then resolved together.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakwork.operators.detect import find, span
from cloakwork.operators.spans import merge_contained
from cloakwork.schema import SPAN, SPANS, no_spans

FLAGS = {"IGNORECASE": re.I, "MULTILINE": re.M, "DOTALL": re.S}
#: Entity types of categories; others are hospitals.
CATEGORY_TYPES = {"url": "URL", "social": "URL", "location": "LOCATION"}
#: What the end of a hit is trimmed of.
CLOSING = ".,;:!?)]}"
#: A span with what sorts it: start, end downwards, place of its rule.
_KEYED = f"array<struct<a: int, b: int, i: int, s: {SPAN}>>"


def _whole(run: str) -> frozenset[str] | None:
    return frozenset([run]) if run else None


def _better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    """The more selective of two sets of literals: the one whose shortest is longer."""
    weight = lambda s: (min(map(len, s)), -len(s)) if s else (0, 0)
    return b if weight(b) > weight(a) else a


def _required(items) -> frozenset[str] | None:
    """Literals of which every match of a parsed pattern holds at least one; None if there are none."""
    best, run = None, ""
    for op, arg in items:
        kind = str(op)
        if kind == "LITERAL":
            run += chr(arg)
            continue
        best, run = _better(best, _whole(run)), ""
        if kind == "SUBPATTERN":
            best = _better(best, _required(arg[3]))
        elif kind == "ATOMIC_GROUP":
            best = _better(best, _required(arg))
        elif kind == "BRANCH":
            sides = [_required(side) for side in arg[1]]
            best = _better(best, frozenset().union(*sides) if all(sides) else None)
        elif kind.endswith("_REPEAT") and arg[0] > 0:
            best = _better(best, _required(arg[2]))
    return _better(best, _whole(run))


def required_literals(pattern: str, flags: int = 0) -> tuple[frozenset[str] | None, bool]:
    """The literals of which each match holds one (None: unknown), and whether their case may differ."""
    from re import _parser

    parsed = _parser.parse(pattern, flags)
    if parsed.getwidth()[0] == 0:
        raise re.error("matches the empty text")
    if parsed.state.flags & re.A:
        raise re.error("has a flag that Java's patterns lack")
    any_case = bool(parsed.state.flags & re.I) or re.search(r"\(\?[a-z]*i", pattern) is not None
    return _required(parsed), any_case


def java_pattern(pattern: str, flags: int = 0) -> str:
    """The pattern for Spark's functions: Unicode classes, lines end in \\n only, names of groups and \\Z as Java spells
    them."""

    def spelled(m: re.Match) -> str:
        if m[0].startswith("(?P="):
            return rf"\k<{m[1]}>"
        return {"(?P<": "(?<", r"\Z": r"\z"}.get(m[0], m[0])

    letters = "dU" + "".join(c for c, f in (("i", re.I), ("m", re.M), ("s", re.S)) if flags & f)
    return f"(?{letters})" + re.sub(r"\\.|\(\?P<|\(\?P=(\w+)\)", spelled, pattern, flags=re.S)


class Rule:
    """A pattern with its flags, score, label and category."""

    def __init__(self, config: dict, place: int):
        flags = 0
        for f in config.get("flags", ()):
            if f not in FLAGS:
                raise ValueError(f"rule {place}: unknown flag {f}")
            flags |= FLAGS[f]
        score, pattern = config.get("score"), config.get("pattern")
        if not isinstance(score, (int, float)) or isinstance(score, bool) or not 0 <= score <= 1:
            raise ValueError(f"rule {place}: the score is not between 0 and 1")
        if not isinstance(pattern, str) or not pattern:
            raise ValueError(f"rule {place}: no pattern")
        try:
            self.compiled = re.compile(pattern, flags)
            self.literals, self.any_case = required_literals(pattern, flags)
        except re.error as e:
            raise ValueError(f"rule {place}: {e}") from None
        self.place, self.score, self.label = place, float(score), config.get("label", f"rule_{place}")
        self.entity = CATEGORY_TYPES.get(config.get("category", "name"), "HOSPITAL")
        self.java = java_pattern(pattern, flags)


class Dictionary:
    """Ordered patterns of an institution: {institution, rules: [{pattern, flags, score, label, category}]}. A pattern
    that matches the empty text is an error."""

    def __init__(self, config: dict):
        if not isinstance(config.get("institution"), str) or not isinstance(config.get("rules"), list):
            raise ValueError("a dictionary has an institution and rules")
        self.name = config["institution"]
        self.rules = [Rule(r, i) for i, r in enumerate(config["rules"])]

    def spans(self, text: str) -> list[dict]:
        """Of one text, for trying a dictionary out: a hit within an earlier one is dropped, and one that holds earlier
        ones replaces them."""
        kept: list[dict] = []
        for r in self.rules:
            for m in r.compiled.finditer(text):
                a, b = m.start(), m.start() + len(m[0].rstrip(CLOSING))
                if a >= b or any(k["start"] <= a and b <= k["end"] for k in kept):
                    continue
                kept = [k for k in kept if not (a <= k["start"] and k["end"] <= b)]
                kept.append({"entity_type": r.entity, "start": a, "end": b, "score": r.score, "recognizer": f"Institution[{self.name}]", "pattern": r.label})
        return sorted(kept, key=lambda s: (s["start"], s["end"]))


def may_match(text: Column, rules: list[Rule]) -> Column:
    """Whether the text holds a required literal of any of the rules; true if one of them has none."""
    if any(r.literals is None for r in rules):
        return F.lit(True)
    exact = sorted({w for r in rules if not r.any_case for w in r.literals})
    loose = sorted({w for r in rules if r.any_case for w in r.literals})
    if len(exact) == 1 and not loose:
        return text.contains(F.lit(exact[0]))
    java = lambda words: "|".join(re.sub(r"([^\w\s])", r"\\\1", w) for w in words)
    return text.rlike("|".join([*([java(exact)] if exact else []), *([f"(?iU:{java(loose)})"] if loose else [])]))


def dictionary(text: Column, config: dict) -> Column:
    """Spans of a dictionary's hits, by position; a null text has none.

    In rule order a hit within an earlier one is dropped and one that holds earlier ones replaces them. As "lies within"
    is transitive, what is left are the hits that lie within no other, the earliest rule's of those at one place:
    whichever hit hides another is itself kept or hidden by a wider one. So one sort and one sweep resolve them.
    """
    rules = Dictionary(config).rules
    name = f"Institution[{config['institution']}]"

    def of(r: Rule) -> Column:
        def hit(x: Column) -> Column:
            end = x["start"] + F.length(F.rtrim(x["hit"], F.lit(CLOSING)))
            s = span(r.entity, F.struct(x["start"].alias("start"), end.alias("end")), r.score, name, r.label)
            return F.struct(x["start"].alias("a"), (-end).alias("b"), F.lit(r.place).alias("i"), s.alias("s"))

        found = F.transform(find(text, r.java), hit)
        return F.when(may_match(text, [r]), found).otherwise(F.array().cast(_KEYED)) if r.literals else found

    if not rules:
        return no_spans()
    some = F.filter(F.concat(*map(of, rules)), lambda k: -k["b"] > k["a"])
    resolved = merge_contained(F.transform(F.sort_array(some), lambda k: k["s"]))
    return F.when(text.isNotNull() & may_match(text, rules), resolved).otherwise(no_spans()).cast(SPANS)
