"""What shape a string has: an ordered list of patterns, the first that fits wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_AUTH, _HOST, _PORT, _PATH = r"(?:[a-zA-Z0-9._-]+:[a-zA-Z0-9._-]+@)?", r"(?:[a-zA-Z0-9-]+\.)*[a-zA-Z0-9-]+(?:\.[a-zA-Z]{2,})?", r"(?::[0-9]{1,5})?", r"(?:/\S*)?"
_IP = r"(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
_DOMAIN = r"(?:[a-zA-Z0-9-]+\.)+[a-zA-Z]{2,}"
_TENS, _ONES = "twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety", "one|two|three|four|five|six|seven|eight|nine"
_TEENS = "ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen"
# Names, order and what they match, here and in FORMATS.
WHITE = {
    "LEADING_SPACE_DIGITS": r"^\s+[0-9]+$",
    "LEADING_SPACE_ALPHANUMERIC": r"^\s+[0-9a-zA-Z]+$",
    "TRAILING_SPACE_DIGITS": r"^[0-9]+\s+$",
    "TRAILING_SPACE_ALPHANUMERIC": r"^[0-9a-zA-Z]+\s+$",
}
AGES = {
    "AGE_GESTATIONAL": r"(?i)^(?:[0-9]{1,2}w(?:[0-9]{1,2}d)?|[0-9]{1,2}[-\s]?weeks?(?:[-\s]?[0-9]{1,2}[-\s]?days?)?\s*old|[0-9]{1,2}[-\s]?day[-\s]?old(?:\s+[0-9]{1,2}w[0-9]{1,2}d)?)$",
    "AGE_WRITTEN_NUMBERS": rf"(?i)^(?:(?:{_TENS})(?:[-\s](?:{_ONES}))?|{_TEENS}|{_ONES})(?:[-\s]+(?:years?|months?|weeks?|days?)(?:[-\s]+old)?)?$",
    "AGE_WITH_UNITS": r"(?i)^(?:(?:age\s*:?\s*)[(\[\"\s,>]*[0-9]{1,3}(?:\.[0-9]{1,2})?|[(\[\"\s,>s]*[0-9]{1,3}(?:\.[0-9]{1,2})?(?:\s*1/2)?[-\s]*(?:yo|y\.?o\.?|y/o|years?(?:\s*of\s*age)?|yrs?|y|months?|mo|m\.?o?|days?|weeks?)(?:[-\s]*old)?)[)\]\"\s,.]*$",
    "AGE_NUMERIC_ONLY": r"^[(\[\"\s,]*[0-9]{1,3}[)\]\"\s,]*$",
}
FORMATS = {
    "DIGITS": r"^[0-9]+$",
    "LOWERCASE": r"^[a-z]+$",
    "UPPERCASE": r"^[A-Z]+$",
    "HEX_LOWER": r"^[0-9a-f]+$",
    "HEX_UPPER": r"^[0-9A-F]+$",
    "ALPHANUMERIC_LOWER": r"^[0-9a-z]+$",
    "ALPHANUMERIC_UPPER": r"^[0-9A-Z]+$",
    "ALPHANUMERIC_MIXED": r"^[0-9a-zA-Z]+$",
    "PHONE_US": r"^\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}$",
    "PHONE_INTL": r"^\+[0-9]{1,3}[-.\s]?[0-9]{1,4}[-.\s]?[0-9]{1,4}[-.\s]?[0-9]{1,9}$",
    "SSN": r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$",
    **AGES,
    "CREDIT_CARD": r"^[0-9]{4}[-.\s]?[0-9]{4}[-.\s]?[0-9]{4}[-.\s]?[0-9]{4}$",
    "UUID": r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    "EMAIL": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "IP_ADDRESS": rf"^{_IP}$",
    "MAC_ADDRESS": r"^(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}$",
    "URL_WITH_AUTH": rf"(?i)^(?:https?|ftp)://[a-zA-Z0-9._-]+:[a-zA-Z0-9._-]+@{_HOST}{_PORT}{_PATH}$",
    "URL_HTTPS": rf"(?i)^https://{_AUTH}{_HOST}{_PORT}{_PATH}$",
    "URL_HTTP": rf"(?i)^http://{_AUTH}{_HOST}{_PORT}{_PATH}$",
    "URL_FTP": rf"(?i)^ftp://{_AUTH}{_HOST}{_PORT}{_PATH}$",
    "URL_WWW_PREFIX": rf"(?i)^www\.(?:[a-zA-Z0-9-]+\.)*[a-zA-Z0-9-]+\.[a-zA-Z]{{2,}}{_PORT}{_PATH}$",
    "URL_LOCALHOST_NO_PROTOCOL": rf"(?i)^localhost{_PORT}{_PATH}$",
    "URL_IP_NO_PROTOCOL": rf"^{_IP}{_PORT}{_PATH}$",
    "URL_DOMAIN_ONLY": rf"(?i)^{_DOMAIN}{_PORT}{_PATH}$",
    "URL_INCOMPLETE_PORT": rf"(?i)^(?:https?://)?(?:{_DOMAIN}|localhost):$",
    "URL_LEADING_DOT": rf"(?i)^\.(?:[a-zA-Z0-9-]+\.)*[a-zA-Z0-9-]+\.[a-zA-Z]{{2,}}{_PORT}{_PATH}$",
    "URL_TRAILING_DOT": rf"(?i)^(?:https?://)?{_DOMAIN}\.{_PORT}{_PATH}$",
    "URL_DOUBLE_DOT": rf"(?i)^(?:https?://)?(?:www\.)?[a-zA-Z0-9-]+\.\.+[a-zA-Z0-9-]+(?:\.[a-zA-Z]{{2,}})?{_PORT}{_PATH}$",
    "URL_MALFORMED": rf"(?i)^(?:https?://)?(?:{_DOMAIN}|localhost):{_PATH}$",
    "DATE_MDY": r"^(?:0?[1-9]|1[0-2])[/-](?:0?[1-9]|[12][0-9]|3[01])[/-][0-9]{4}$",
    "DATE_YMD": r"^[0-9]{4}[/-](?:0?[1-9]|1[0-2])[/-](?:0?[1-9]|[12][0-9]|3[01])$",
    "ZIP_CODE": r"^[0-9]{5}(?:-[0-9]{4})?$",
    "ROUTING_NUMBER": r"^[0-9]{9}$",
    "HEX_STRING": r"(?i)^[0-9a-f]{8,}$",
    "ACCOUNT_NUMBER": r"^[0-9]{8,16}$",
    "LICENSE_PLATE": r"(?i)^[A-Z0-9]{2,8}$",
}


def detect_format(text: Column, extra: dict[str, str] | None = None, ages_first: bool = False) -> Column:
    """The name of the first format that fits; null if none does.

    White-space shapes look at the text as it is, all others at the stripped text. extra: patterns to try last.
    ages_first: so that "95" or "64y" is an age before it is digits; the age operator needs that.
    """
    stripped = F.regexp_replace(text, r"^\s+|\s+$", "")
    found = None
    for name, p in WHITE.items():
        found = F.when(text.rlike(p), name) if found is None else found.when(text.rlike(p), name)
    order = ({**AGES, **FORMATS} if ages_first else FORMATS) | (extra or {})
    for name, p in order.items():
        found = found.when(stripped.rlike(p), name)
    return found


def all_formats(text: Column) -> Column:
    """All formats that fit the stripped text, in order."""
    stripped = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.filter(F.array(*(F.when(stripped.rlike(p), name) for name, p in FORMATS.items())), lambda x: x.isNotNull())


def is_format(text: Column, name: str) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "").rlike(FORMATS[name])


def extract_matches(text: Column, name: str) -> Column:
    """All parts of a text that have the format: the pattern without its anchors."""
    p = FORMATS[name].replace("^", "", 1)
    return F.regexp_extract_all(text, F.lit(f"({p[:-1] if p.endswith('$') else p})"), F.lit(1))
