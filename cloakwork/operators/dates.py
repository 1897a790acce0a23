"""Date shifting: recognise a date's layout, move it by a patient's jitter, write it in the same layout.

shift_dates() is the whole grammar as an Arrow function; it belongs on distinct values. shift_layout() is a native
expression for columns that hold one numeric layout, and rotate_weekday() one for weekdays.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakwork.functions.keyed import MIN_JITTER

UNKNOWN = "[DATE]"
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
_WEEKDAY = "|".join((*DAYS, *(d[:3] for d in DAYS)))
_NAME = "(?P<month>" + "|".join((*MONTHS, "Jan", "Feb", "Mar", "Apr", "Jun", "Jul", "Aug", "Sept", "Sep", "Oct", "Nov", "Dec")) + ")"
_MON, _DAY, _LATE = "(?P<month>1[0-2]|0?[1-9])", "(?P<day>3[01]|[12][0-9]|0?[1-9])", "(?P<day>1[3-9]|2[0-9]|3[01])"
_YEAR, _SEP, _SAME = "(?P<year>(?:19|20)[0-9]{2})", "(?P<sep>[/-])", "(?P=sep)"
_TIME = r"(?:2[0-3]|1[0-9]|0?[1-9]):[0-5][0-9](?::[0-5][0-9])?(?:\s*(?:AM|PM|A|P))?(?:\s*CT)?(?:\s*h)?"
_ENDS, _NO_DIGIT = r"\b", r"(?=[^0-9]*\b)"


def ordinal(n: int) -> str:
    return "th" if 10 < n % 100 < 14 else {1: "st", 2: "nd", 3: "rd"}.get(n % 10, "th")


@dataclass(frozen=True)
class Layout:
    """A pattern with the groups month, day, year and sep, as far as it has them, and how a date is written."""

    pattern: re.Pattern
    write: Callable[[dt.date, str], str]


def _layout(pattern: str, write: Callable[[dt.date, str], str]) -> Layout:
    return Layout(re.compile(r"\b" + pattern, re.I | re.A), write)


# Layouts and their order. The first that a text contains decides.
LAYOUTS = (
    _layout(rf"{_DAY}{_SEP}{_NAME}{_SAME}{_YEAR}(?:\s*{_TIME})?{_ENDS}", lambda d, s: f"{d.day:02}{s}{d.month:02}{s}{d.year}"),
    _layout(rf"{_LATE}{_SEP}{_MON}{_SAME}{_YEAR}(?:\s*{_TIME})?{_ENDS}", lambda d, s: f"{d.day:02}{s}{d.month:02}{s}{d.year}"),
    _layout(rf"{_YEAR}{_SEP}{_MON}{_SAME}{_DAY}(?:T?\s*{_TIME})?{_ENDS}", lambda d, s: f"{d.year}{s}{d.month:02}{s}{d.day:02}"),
    _layout(rf"{_NAME}{_SEP}{_DAY}{_SAME}{_YEAR}(?:\s*{_TIME})?{_NO_DIGIT}", lambda d, s: f"{MONTHS[d.month - 1]}{s}{d.day}{s}{d.year}"),
    _layout(rf"{_MON}{_SEP}{_DAY}{_SAME}{_YEAR}(?:\s*{_TIME})?{_NO_DIGIT}", lambda d, s: f"{d.month:02}{s}{d.day:02}{s}{d.year}"),
    _layout(rf"{_MON}{_SEP}{_DAY}{_SAME}(?P<year>[0-9]{{2}})(?:\s*{_TIME})?{_NO_DIGIT}", lambda d, s: f"{d.month:02}{s}{d.day:02}{s}{d.year % 100:02}"),
    _layout(rf"{_NAME} +{_DAY}(?:st|nd|rd|th)?(?:,|\s)+{_YEAR}(?:\s*{_TIME})?{_ENDS}", lambda d, s: f"{MONTHS[d.month - 1]} {d.day}{ordinal(d.day)}, {d.year}"),
    _layout(rf"{_MON}{_SEP}{_YEAR}{_ENDS}", lambda d, s: f"{d.month:02}{s}{d.year}"),
    _layout(rf"{_NAME}\s*(?:of\s+)?{_YEAR}", lambda d, s: f"{MONTHS[d.month - 1]} of {d.year}"),
    _layout(rf"{_NAME}\s+{_DAY}(?:st|nd|rd|th)?\b", lambda d, s: f"{MONTHS[d.month - 1]} {d.day}"),
    _layout(rf"{_LATE}{_SEP}{_MON}\b", lambda d, s: f"{d.day:02}{s}{d.month:02}"),
    _layout(rf"{_MON}{_SEP}{_DAY}\b", lambda d, s: f"{d.month:02}{s}{d.day:02}"),
    _layout(rf"{_YEAR}{_SEP}{_MON}\b", lambda d, s: f"{d.year}{s}{d.month:02}"),
    _layout(rf"{_YEAR}(?P<month>0[1-9]|1[0-2])(?P<day>0[1-9]|[12][0-9]|3[01])(?:\s*{_TIME})?", lambda d, s: f"{d.year}{d.month:02}{d.day:02}"),
)
_ALONE = re.compile(rf"^[^A-Za-z0-9]*({_WEEKDAY})[^A-Za-z0-9]*$", re.I)
_KEEP = re.compile(r"^(?:(?:19|20)[0-9]{2}s?|[0-9]{1,2}w(?:\s+[0-9]{1,2}d)?|[0-9]{1,2}d|.?)$", re.A)


def _month(text: str) -> int:
    return int(text) if text.isdigit() else next(i for i, m in enumerate(MONTHS, 1) if m[:3].lower() == text[:3].lower())


def _cased(new: str, like: str) -> str:
    return new.upper() if like.isupper() else new.lower() if like.islower() else new


def rotate(day: str, jitter: int) -> str:
    names = DAYS if day.title() in DAYS else tuple(d[:3] for d in DAYS)
    return _cased(names[(names.index(day.title()) + jitter) % 7], day)


def shift_date(text: str | None, jitter: int, year: int) -> str | None:
    """text with its date moved by jitter days. year: for dates that have none, and the pivot of two-digit years.

    A lone weekday is rotated. A lone month, a year or decade, a gestational age and a single character stay. A text
    without a date, or with an impossible one, becomes [DATE]. What stands beside the date is dropped.
    """
    if text is None:
        return None
    bare = text.strip()
    if _KEEP.match(bare) or (bare.title() in MONTHS or bare.title() in {m[:3] for m in MONTHS}):
        return text
    if m := _ALONE.match(text):
        return rotate(m[1], jitter)
    for layout in LAYOUTS:
        if m := layout.pattern.search(text):
            g = m.groupdict()
            y = g.get("year") or str(year)
            if len(y) == 2:
                y = ("20" if int(y) <= year % 100 else "19") + y
            try:
                moved = dt.date(int(y), _month(g["month"]), int(g.get("day") or 15)) + dt.timedelta(days=jitter)
            except (ValueError, OverflowError):
                return UNKNOWN
            return layout.write(moved, g.get("sep") or "/")
    return UNKNOWN


def shift_dates(text: Column, jitter: Column, year: int) -> Column:
    @F.pandas_udf("string")
    def run(t: pd.Series, j: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or n != n else shift_date(x, int(n), year) for x, n in zip(t, j)], dtype=object)

    return run(text, jitter.cast("double"))


def shift_layout(text: Column, jitter: Column, layout: str = "MM/dd/yyyy") -> Column:
    """Of a column with one numeric layout; null where the text does not have it."""
    return F.date_format(F.date_add(F.to_date(F.try_to_timestamp(text, F.lit(layout))), jitter), layout)


def rotate_weekday(day: Column, jitter: Column) -> Column:
    """A weekday, full or of three letters, moved by jitter days, in the same case."""
    out = None
    for names in (DAYS, tuple(d[:3] for d in DAYS)):
        at = F.array_position(F.array(*(F.lit(n) for n in names)), F.initcap(day))
        new = F.element_at(F.array(*(F.lit(n) for n in names)), (F.pmod(at - 1 + jitter, F.lit(7)) + 1).cast("int"))
        out = F.when(at > 0, new) if out is None else out.when(at > 0, new)
    return F.when(day == F.upper(day), F.upper(out)).when(day == F.lower(day), F.lower(out)).otherwise(out)


def check_jitter(jitter: int, entity_type: str) -> None:
    if abs(jitter) < MIN_JITTER:
        raise ValueError(f"jitter must be {MIN_JITTER} days or more")
    if entity_type not in ("DATE", "DATE_TIME"):
        raise ValueError(f"dates are not shifted in {entity_type}")
