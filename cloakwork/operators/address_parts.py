"""US addresses split into parts by a hidden Markov model, decoded by Viterbi as a fold of column expressions.

What is seen of a token is its class: which word lists hold it, or its form. The model's counts come from addresses that
are made by rule, so that the same word ("Lake View Terrace", "Ct" for Court or Connecticut, a house or zip number of
five digits) is told by its place. Scores are whole numbers, so that every executor finds the same path.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakwork.operators.detect import DIRECTIONS, STATES, STREET_KINDS, UNITS

LABELS = ("number", "direction", "street", "kind", "unit", "city", "state", "zip", "box", "comma")
_START = len(LABELS)
#: Tokens: a box, a state of two words, a comma, and what stands between white space.
_TWO_WORDS = sorted({s for s in STATES if " " in s})
TOKEN = r"(?i)((?:P[.]?\s*O[.]?|Post\s+Office)\s+Box\b|\b(?:" + "|".join(s.replace(" ", r"\s+") for s in _TWO_WORDS) + r")\b|,|[^\s,]+)"
#: Forms, the first that fits: those of words come after the lists.
FORMS = (("comma", ","), ("box", r"(?i)p.*\s+box"), ("zip9", "[0-9]{5}-[0-9]{4}"), ("five", "[0-9]{5}"), ("digits", "[0-9]+"), ("mark", "#.*"), ("ordinal", "(?i)[0-9]+(?:st|nd|rd|th)"), ("code", "(?i)[0-9]+-?[a-z]|[a-z]-?[0-9]+|[a-z]"))
#: What never happens, and the scale of logarithms.
_NEVER, _SCALE = -1_000_000, 1000


@lru_cache(1)
def _lists() -> dict[str, str]:
    """Word -> the lists that hold it."""
    held: dict[str, list[str]] = {}
    for name, words in (("direction", DIRECTIONS), ("kind", STREET_KINDS), ("state", STATES), ("unit", UNITS)):
        for w in words:
            if name not in held.setdefault(w.lower(), []):
                held[w.lower()].append(name)
    return {w: "+".join(names) for w, names in sorted(held.items())}


def _class_of(token: str) -> str:
    word = re.sub(r"\s+", " ", token.rstrip(".").lower())
    return _lists().get(word) or next((name for name, p in FORMS if re.fullmatch(p, token)), "word")


def _class(token: Column) -> Column:
    """As _class_of."""
    lists = F.create_map(*(F.lit(x) for pair in _lists().items() for x in pair))
    found = F.try_element_at(lists, F.regexp_replace(F.rtrim(F.lower(token), F.lit(".")), r"\s+", " "))
    form = None
    for name, p in FORMS:
        fits = token.rlike(f"^(?:{p})$")
        form = F.when(fits, name) if form is None else form.when(fits, name)
    return F.coalesce(found, form.otherwise("word"))


# Words of made addresses, some of which lists hold too.
_STREETS = ("Oak", "Elm", "Main", "Lake View", "Washington", "Georgia", "St Mark", "5th", "42nd", "Park", "Old Mill", "Martin Luther King", "Maple", "West End", "Mission Ridge", "El Camino Real", "B")
_CITIES = ("Springfield", "Reno", "Salt Lake City", "New York", "St Louis", "West Point", "Oakland", "Washington", "Fort Worth", "Palo Alto", "Grand Ridge", "Los Angeles", "Park City")
_UNITS = (("Apt", "4"), ("Suite", "210"), ("#", ""), ("Unit", "B"), ("Floor", "3"), ("Ste", "12A"), ("Bldg", "7"), ("Fl", "2"), ("Apt", "5-C"))


def made_addresses(n: int = 6000) -> Iterator[list[tuple[str, str]]]:
    """Addresses by rule, as tokens with labels; the same ones each time."""
    pick = lambda words, i, step: words[(i * step + i // len(words)) % len(words)]
    comma = (",", "comma")
    for i in range(n):
        out: list[tuple[str, str]] = []
        form = i % 12
        if form == 10:
            out += [("PO Box", "box"), (str(i * 7 % 9000 + 1), "box"), comma]
        elif form < 10:
            house = str(i * 37 % (90000 if i % 5 == 0 else 9000) + 10)
            out.append((house + "B" if i % 31 == 0 else house, "number"))
            if i % 4 == 1:
                out.append((pick(DIRECTIONS, i, 5), "direction"))
            out += [(w, "street") for w in pick(_STREETS, i, 3).split()]
            if i % 19:
                out.append((pick(STREET_KINDS, i, 7), "kind"))
            if i % 9 == 2:
                out.append((pick(DIRECTIONS, i, 3), "direction"))
            if i % 3 == 0:
                kind, number = pick(_UNITS, i, 2)
                out += ([comma] if i % 2 else []) + ([(f"#{i % 90}", "unit")] if kind == "#" else [(kind, "unit"), (number, "unit")])
            if form == 9:  # a street alone
                yield out
                continue
            out += [comma] if i % 7 else []
        found = re.findall(TOKEN, pick(_CITIES, i, 5))
        out += [(w, "city") for w in found] + ([comma] if i % 6 else [])
        out.append((pick(STATES, i, 11), "state"))
        if i % 8:
            out += ([comma] if i % 23 == 0 else []) + [(f"{i * 91 % 100000:05d}" + ("-1234" if i % 10 == 3 else ""), "zip")]
        yield out


@lru_cache(1)
def _model() -> tuple[dict[str, list[int]], list[list[int]], list[int]]:
    """Scores of classes by label, of transitions to each label from each label (and the start), of ends."""
    seen, moves = Counter(), Counter()
    for tokens in made_addresses():
        before = "start"
        for token, label in tokens:
            seen[_class_of(token), label] += 1
            moves[before, label] += 1
            before = label
        moves[before, "end"] += 1
    classes = sorted({*_lists().values(), *(name for name, _ in FORMS), "word"})

    def scores(counts: Counter, key, many: list, weight: float) -> list[int]:
        total = sum(counts[key(m)] + weight for m in many)
        return [round(_SCALE * math.log((counts[key(m)] + weight) / total)) for m in many]

    emitted = {label: dict(zip(classes, scores(seen, lambda c: (c, label), classes, 0.5))) for label in LABELS}
    moved = {a: scores(moves, lambda b: (a, b), [*LABELS, "end"], 0.05) for a in (*LABELS, "start")}
    to = [[moved[a][j] for a in (*LABELS, "start")] for j in range(len(LABELS))]
    return {c: [emitted[label][c] for label in LABELS] for c in classes}, to, [moved[a][-1] for a in LABELS]


def _longs(values: list[int]) -> Column:
    return F.array(*(F.lit(v).cast("bigint") for v in values))


def _let(value: Column, f) -> Column:
    return F.element_at(F.transform(F.array(value), f), 1)


def tags(text: Column) -> Column:
    """array<struct(token, label)> of an address; empty for null or blank texts."""
    emitted, to, ends = _model()
    scores = F.map_from_arrays(F.array(*(F.lit(c) for c in emitted)), F.array(*(_longs(v) for v in emitted.values())))
    moves, last = F.array(*(_longs(row) for row in to)), _longs(ends)

    def step(a: Column, kind: Column) -> Column:
        """The best way to each label: its score and the label before."""

        def best(own: Column) -> Column:
            ways = F.transform(moves, lambda row, j: F.array_max(F.zip_with(F.transform(a["score"], lambda s, i: F.struct(s.alias("s"), i.alias("i"))), row, lambda p, m: F.struct((p["s"] + m + F.get(own, j)).alias("s"), p["i"].alias("i")))))
            return _let(ways, lambda w: F.struct(F.array_append(F.transform(w, lambda x: x["s"]), F.lit(_NEVER * 1000).cast("bigint")).alias("score"), F.array_append(a["back"], F.transform(w, lambda x: x["i"])).alias("back")))

        return _let(F.element_at(scores, kind), best)

    def path(a: Column) -> Column:
        """Labels from the last to the first, turned."""
        final = F.array_max(F.zip_with(F.transform(F.slice(a["score"], 1, len(LABELS)), lambda s, i: F.struct(s.alias("s"), i.alias("i"))), last, lambda p, e: F.struct((p["s"] + e).alias("s"), p["i"].alias("i"))))["i"]
        start = F.struct(final.alias("at"), F.array().cast("array<int>").alias("path"))
        walk = F.aggregate(F.reverse(a["back"]), start, lambda p, b: F.struct(F.get(b, p["at"]).alias("at"), F.array_append(p["path"], p["at"]).alias("path")), lambda p: p["path"])
        return F.reverse(walk)

    begin = F.struct(_longs([_NEVER * 1000] * _START + [0]).alias("score"), F.array().cast("array<array<int>>").alias("back"))
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(1))
    names = F.array(*(F.lit(x) for x in LABELS))
    return _let(tokens, lambda t: F.zip_with(t, F.aggregate(F.transform(t, _class), begin, step, path), lambda x, k: F.struct(x.alias("token"), F.get(names, k).alias("label"))))


def address_parts(text: Column) -> Column:
    """struct of the parts of an address (number, direction, street, kind, unit, city, state, zip, box), each with its
    tokens in order, null where it is absent, and valid: whether it has a street with a number, a box, or a city and state.

    Defined cases: null and blank texts have null parts and are not valid; every token but commas is in exactly one part.
    """

    def parts(t: Column) -> Column:
        of = lambda label: F.nullif(F.array_join(F.transform(F.filter(t, lambda x: x["label"] == label), lambda x: x["token"]), " "), F.lit(""))
        return F.struct(*(of(label).alias(label) for label in LABELS if label != "comma"))

    def whole(p: Column) -> Column:
        has = lambda *names: F.forall(F.array(*(p[n] for n in names)), lambda x: x.isNotNull())
        return F.struct(*(p[x].alias(x) for x in LABELS if x != "comma"), (has("number", "street") | has("box") | has("city", "state")).alias("valid"))

    return _let(_let(tags(text), parts), whole)
