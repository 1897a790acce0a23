"""Places: street numbers, streets, cities and zips become keyed picks, states stay; other places become a facility.

The tagger that splits addresses elsewhere is not available; a rule-based one takes US addresses and PO boxes.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakwork.functions.keyed import Keys
from cloakwork.operators.detect import DIRECTION, STATE, STREET, UNIT, ZIP
from cloakwork.operators.names import Namer, case_of

_ADDRESS = re.compile(rf"^\s*(?P<number>[0-9]{{1,6}})\s+(?:{DIRECTION}\s+)?(?P<street>[A-Za-z0-9' .\-]+?)\s+(?P<kind>{STREET})\.?(?:\s+{DIRECTION})?(?P<unit>\s*,?\s+{UNIT})?(?:\s*,\s*(?P<city>[A-Za-z' .\-]+?))?(?:\s*,?\s*(?P<state>{STATE})\b\.?)?(?:\s*(?P<zip>{ZIP}))?\s*$", re.I)
_BOX = re.compile(rf"^\s*(?:P\.?\s*O\.?|Post\s+Office)\s+Box\s+(?P<number>[0-9]+)(?:\s*,\s*(?P<city>[A-Za-z' .\-]+?))?(?:\s*,?\s*(?P<state>{STATE})\b\.?)?(?:\s*(?P<zip>{ZIP}))?\s*$", re.I)
_CITY = re.compile(rf"^\s*(?P<city>[A-Za-z' .\-]+?)\s*,\s*(?P<state>{STATE})\b\.?(?:\s*(?P<zip>{ZIP}))?\s*$", re.I)
_ZIP = re.compile(rf"^\s*(?P<zip>{ZIP})\s*$")
STREETS = tuple(a + b for a in ("Oak", "Elm", "Ash", "Birch", "Cedar", "Maple", "Pine", "Willow", "Stone", "River") for b in ("", " Hill", " Park", "wood", "field", "brook"))
CITIES = tuple(a + b for a in ("Green", "Fair", "Spring", "Clear", "West", "East", "North", "South", "New", "Lake") for b in ("field", "view", "ton", "dale", "brook", "port", "haven"))
#: By length: at most 5, 15 and 30 characters, and longer.
FACILITIES = ("Clinic", "Mercy", "Grace", "City Hospital", "Oak Clinic", "Hill Medical", "Valley Community Hospital", "Lakeside Medical Center", "Riverside General Hospital", "Greenfield Regional Medical Center and Clinics", "Northern Counties University Teaching Hospital")
_BOUNDS = (5, 15, 30)


def bucket(n: int) -> int:
    return sum(n > b for b in _BOUNDS)


def facilities_like(text: str, names: Sequence[str]) -> list[str]:
    return [f for f in names if bucket(len(f)) == bucket(len(text))] or list(names)


class Placer(Namer):
    def __init__(self, keys: Keys, facilities: Sequence[str] = FACILITIES, streets: Sequence[str] = STREETS, cities: Sequence[str] = CITIES, stopwords: Sequence[str] = ()):
        super().__init__(keys, facilities, stopwords)
        self.streets, self.cities = list(streets), list(cities)

    def _digits(self, text: str) -> str:
        n = self.index(text, 9 * 10 ** (len(text) - 1)) + 10 ** (len(text) - 1)
        return str(n)

    def _part(self, name: str, text: str) -> str:
        if name in ("number", "zip"):
            return "-".join(self._digits(p) for p in text.split("-"))
        new = (self.streets if name == "street" else self.cities)[self.index(text.lower(), len(self.streets if name == "street" else self.cities))]
        case = case_of(text.replace(" ", ""))
        return new.upper() if case == "upper" else new.lower() if case == "lower" else new

    def replace(self, text: str | None) -> str | None:
        if text is None or (self.spurious(text) and not _ZIP.match(text)):
            return text
        for pattern in (_ADDRESS, _BOX, _CITY, _ZIP):
            if m := pattern.match(text):
                spots = sorted((m.span(n), n) for n in m.groupdict() if n in ("number", "street", "city", "zip") and m[n])
                out, at = [], 0
                for (a, b), name in spots:
                    out += [text[at:a], self._part(name, text[a:b])]
                    at = b
                return "".join(out) + text[at:]
        names = facilities_like(text, self.names)
        new = names[self.index(text.lower(), len(names))]
        return new.title() if text[:1].isupper() else new.lower()


def replace_locations(text: Column, keys: Keys, stopwords: Sequence[str] = ()) -> Column:
    placer = Placer(keys, stopwords=stopwords)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(placer.replace)

    return run(text)
