"""Made-up values of the same kind, chosen by key: the same text always gets the same value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakwork.functions.formats import detect_format
from cloakwork.functions.keyed import Keys, hmac_sha256

COMPANIES = tuple(f"{a} {b}" for a in ("Alder", "Beacon", "Cobalt", "Delta", "Ember", "Falcon", "Garnet", "Harbor") for b in ("Group", "Partners", "Works", "Services", "Systems"))


def _digest(text: Column, keys: Keys, what: str) -> Column:
    return hmac_sha256(F.encode(F.concat(F.lit(f"fake:{what}:"), text), "UTF-8"), keys.both)


def digits(text: Column, keys: Keys, n: int, what: str = "digits") -> Column:
    """n digits, n at most 18."""
    big = F.conv(F.substring(_digest(text, keys, what), 1, 16), 16, 10).cast("decimal(20,0)")
    return F.lpad((big % F.lit(10**n).cast("decimal(20,0)")).cast("string"), n, "0")


def _number(text: Column, keys: Keys, what: str, low: int, high: int) -> Column:
    return (F.conv(F.substring(_digest(text, keys, what), 1, 8), 16, 10).cast("long") % (high - low + 1) + low).cast("string")


def _letters(text: Column, keys: Keys, n: int, what: str) -> Column:
    return F.translate(F.substring(_digest(text, keys, what), 1, n), "0123456789", "ghijklmnop")


def _bases(text: Column, keys: Keys) -> Column:
    """As many of A, C, G, T as text has characters: the hash of each block of 64, digit by digit."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length(text) - 1, F.lit(0)) / 64).cast("int")), lambda i: hmac_sha256(F.encode(F.concat(F.lit("fake:bases:"), i.cast("string"), F.lit(":"), text), "UTF-8"), keys.both))
    return F.substring(F.translate(F.array_join(blocks, ""), "0123456789abcdef", "ACGTACGTACGTACGT"), F.lit(1), F.length(text))


def _mask_digits(text: Column, keys: Keys) -> Column:
    """All digits replaced, all else kept."""
    stream = F.concat(digits(text, keys, 18, "phone1"), digits(text, keys, 18, "phone2"))
    chars = F.transform(F.split(text, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(stream, i % 36 + 1, F.lit(1))).otherwise(c))
    return F.array_join(chars, "")


def fake(entity: Column, text: Column, keys: Keys) -> Column:
    """A value for the entity type; 8 digits for a type that has no form of its own."""
    site = F.concat(_letters(text, keys, 8, "host"), F.lit(".example.com"))
    shape = detect_format(text)
    url = (
        F.when(shape == "URL_HTTPS", F.concat(F.lit("https://"), site))
        .when(shape == "URL_HTTP", F.concat(F.lit("http://"), site))
        .when(shape == "URL_FTP", F.concat(F.lit("ftp://"), site))
        .when(shape == "URL_WITH_AUTH", F.concat(F.lit("https://user:pass@"), site))
        .when(shape == "URL_WWW_PREFIX", F.concat(F.lit("www."), site))
        .when(shape == "URL_LOCALHOST_NO_PROTOCOL", F.lit("localhost"))
        .when(shape.isin("IP_ADDRESS", "URL_IP_NO_PROTOCOL"), F.concat_ws(".", F.lit("203"), F.lit("0"), F.lit("113"), _number(text, keys, "ip", 1, 254)))
        .when(shape == "URL_LEADING_DOT", F.concat(F.lit("."), site))
        .when(shape.isin("URL_TRAILING_DOT"), F.concat(site, F.lit(".")))
        .when(shape.isin("URL_DOUBLE_DOT", "URL_MALFORMED", "URL_INCOMPLETE_PORT"), F.concat(site, F.lit(":")))
        .when(shape == "URL_DOMAIN_ONLY", site)
        .otherwise(digits(text, keys, 8))
    )
    return (
        F.when(text.isNull(), F.lit(None).cast("string"))
        .when(entity == "AGE", _number(text, keys, "age", 18, 90))
        .when(entity.isin("EMAIL", "EMAIL_ADDRESS"), F.concat(_letters(text, keys, 8, "user"), F.lit("@example.com")))
        .when(entity.isin("URL", "WEB"), url)
        .when(entity == "IP_ADDRESS", F.concat_ws(".", F.lit("203"), F.lit("0"), F.lit("113"), _number(text, keys, "ip", 1, 254)))
        .when(entity.isin("PHONE", "PHONE_NUMBER"), _mask_digits(text, keys))
        .when(entity.isin("ORGANIZATION", "VENDOR"), F.element_at(F.array(*(F.lit(c) for c in COMPANIES)), _number(text, keys, "company", 1, len(COMPANIES)).cast("int")))
        .when(entity == "GENETIC_SEQUENCE", _bases(text, keys))
        .when(entity == "CREDIT_CARD", digits(text, keys, 16))
        .when(entity == "IBAN_CODE", F.concat(F.lit("GB"), digits(text, keys, 18)))
        .when(entity.isin("US_BANK_NUMBER"), digits(text, keys, 12))
        .when(entity == "CRYPTO", F.concat(F.lit("1"), F.substring(_digest(text, keys, "crypto"), 1, 33)))
        .when(entity.isin("US_SSN", "US_ITIN"), F.concat_ws("-", digits(text, keys, 3, "a"), digits(text, keys, 2, "b"), digits(text, keys, 4, "c")))
        .when(entity.isin("MEDICAL_LICENSE", "US_DRIVER_LICENSE", "US_PASSPORT"), F.concat(F.upper(F.substring(_letters(text, keys, 2, "license"), 1, 1)), digits(text, keys, 8)))
        .otherwise(digits(text, keys, 8))
    )
