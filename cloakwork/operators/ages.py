"""Ages above a limit are brought down to it, in the style they were written in.

Age shapes are looked for before all others, so that "95" or "64y" is capped too.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakwork.functions.formats import detect_format

ONES = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen")
TENS = ("twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")
LIMIT, GESTATION = 89, 42
_WRITTEN = rf"(?i)(?:({'|'.join(TENS)})(?:([-\s])({'|'.join(ONES[:9])})\b)?|({'|'.join(sorted(ONES, key=len, reverse=True))})\b)"


def _number_of(words: tuple[str, ...], first: int, step: int, text: Column) -> Column:
    at = F.array_position(F.array(*(F.lit(w) for w in words)), F.lower(text))
    return F.when(at > 0, (at - 1) * step + first).otherwise(0)


def written_value(text: Column) -> Column:
    """The number that a text spells; 0 if none."""
    part = lambda k: F.regexp_extract(text, _WRITTEN, k)
    return _number_of(TENS, 20, 10, part(1)) + _number_of(ONES[:9], 1, 1, part(3)) + _number_of(ONES, 1, 1, part(4))


def spelled(number: int, hyphen: str) -> str:
    if number < 20:
        return ONES[number - 1]
    tens, ones = divmod(number, 10)
    return TENS[tens - 2] + (hyphen + ONES[ones - 1] if ones else "") if number < 100 else str(number)


def cap_age(text: Column, limit: int = LIMIT) -> Column:
    """text with an age above limit lowered to it; gestational weeks to 42; texts of no age shape stay."""
    kind = detect_format(text, ages_first=True)
    number = F.regexp_extract(text, r"([0-9]+)(?:\.[0-9]+)?", 1).cast("int")
    plain = F.regexp_replace(text, r"[0-9]+(?:\.[0-9]+)?", F.lit(str(limit)))
    weeks = F.regexp_extract(text, r"(?i)([0-9]+)w", 1).cast("int")
    hyphen = F.contains(text, F.lit("-"))
    word = F.when(hyphen, F.lit(spelled(limit, "-"))).otherwise(F.lit(spelled(limit, " ")))
    word = F.when(F.substring(F.ltrim(text), 1, 1).rlike("[A-Z]"), F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 100))).otherwise(word)
    written = F.regexp_replace(text, _WRITTEN, word)
    months = text.rlike(r"(?i)[0-9]\s*-?\s*(?:mo|month|day|week)")
    return (
        F.when((kind == "AGE_GESTATIONAL") & (weeks > GESTATION), F.regexp_replace(text, r"(?i)[0-9]+w", F.lit(f"{GESTATION}w")))
        .when(kind.isin("AGE_NUMERIC_ONLY", "AGE_WITH_UNITS") & ~months & (number > limit), plain)
        .when((kind == "AGE_WRITTEN_NUMBERS") & (written_value(text) > limit), written)
        .otherwise(text)
    )
