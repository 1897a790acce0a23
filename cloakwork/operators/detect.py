"""Pattern detectors: each makes an array of spans from a text column, as one native expression.

Offsets come from the text between matches (split) and the matches (regexp_extract_all) by running lengths; both count
code points. A cheap test first lets most rows skip the patterns. Classes are spelled out in ASCII, so that Java and
other engines agree.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakwork.operators.spans import drop_overlapping_earlier, overlaps
from cloakwork.schema import SPANS, no_spans

HIT = "array<struct<start: int, end: int, hit: string>>"


def find(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, hit)."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(hits))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(HIT).alias("out"))

    def step(a: Column, x: Column) -> Column:
        b = a["at"] + F.length(x["gap"])
        e = b + F.length(x["hit"])
        return F.struct(e.alias("at"), F.array_append(a["out"], F.struct(b.alias("start"), e.alias("end"), x["hit"].alias("hit"))).alias("out"))

    found = F.aggregate(F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), start, step, lambda a: a["out"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(HIT))


def span(entity: str, x: Column, score: Column | float, recognizer: str, pattern: str | Column) -> Column:
    score = score if isinstance(score, Column) else F.lit(score)
    pattern = pattern if isinstance(pattern, Column) else F.lit(pattern)
    return F.struct(F.lit(entity).alias("entity_type"), x["start"].alias("start"), x["end"].alias("end"), score.cast("double").alias("score"), F.lit(recognizer).alias("recognizer"), pattern.alias("pattern"))


def _guarded(text: Column, test: Column, spans: Column) -> Column:
    return F.when(text.isNotNull() & test, spans).otherwise(no_spans()).cast(SPANS)


# These patterns and scores must find what users of the batch engine find today.
EMAIL = r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"
PHONE = "|".join(
    (
        r"(?:\+?1[-.\s]?)?\([0-9]{3}\)\s?[0-9]{3}[-.\s]?[0-9]{4}(?:\s*(?:ext\.?|x|extension)\s*[0-9]{1,6})?",
        r"\+[0-9]{1,3}\s?\([0-9]{1,4}\)\s?[0-9]{1,4}[-.\s]?[0-9]{1,9}",
        r"(?:1[-.\s]?)?8(?:00|33|44|55|66|77|88)[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}",
        r"\+44\s?[0-9]{4}\s?[0-9]{6}",
        r"\+[0-9]{2}\s[0-9]{2,4}\s[0-9]{3,4}\s[0-9]{2,4}",
        r"(?:1[-.\s]?)?[0-9]{3}[-.\s][0-9]{3}[-.\s][0-9]{4}",
        r"[0-9]{3}\.[0-9]{3}\.[0-9]{4}",
        r"[0-9]{2,3}[-.\s][0-9]{4}[-.\s][0-9]{4}",
        r"\b1[0-9]{10}\b",
        r"\b[0-9]{10}\b",
    )
)
SSN = r"\b(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{3}\.[0-9]{2}\.[0-9]{4}|[0-9]{3} [0-9]{2} [0-9]{4}|[0-9]{9})\b"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
IPV4 = rf"\b(?:{OCTET}\.){{3}}{OCTET}\b"
_H = "[0-9a-fA-F]{1,4}"
IPV6 = r"(?<![0-9a-fA-F:])(?:" + "|".join(
    (
        rf"(?:{_H}:){{7}}{_H}",
        rf"(?:{_H}:){{1,7}}:",
        rf"::(?:{_H}:){{0,6}}{_H}",
        rf"(?:{_H}:){{1,6}}:{_H}",
        *(rf"(?:{_H}:){{1,{a}}}(?::{_H}){{1,{7 - a}}}" for a in (5, 4, 3, 2)),
        rf"{_H}:(?::{_H}){{1,6}}",
        rf"::{_H}",
        "::",
        "fe80:(?::[0-9a-fA-F]{0,4}){0,4}%[0-9a-zA-Z]+",
        rf"::(?:ffff(?::0{{1,4}})?:)?(?:{OCTET}\.){{3}}{OCTET}",
    )
) + r")(?![0-9a-fA-F:])"
URL_PROTOCOL = r"""(?:https?|ftp|file)://[^\s<>"'\)\]]+"""
URL_WWW = r"""\bwww\.[^\s<>"'\)\]]+"""
TLDS = "com|org|net|edu|gov|mil|int|io|co|us|uk|de|fr|jp|cn|au|ca|info|biz|me|tv|cc"
URL_DOMAIN = rf"\b(?<![@/])(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]*[a-zA-Z0-9])?\.)+(?:{TLDS})\b"
ACCESSION_WORD = r"(?:ACCESSION|ACESSION|ACCESION|ACCESSSION|ACSESSION|ACCESSTION|ACCSSION|ACCE\.|ACC\.|ACCES\.)"
HAR = r"(?<=\bHAR\s{0,10}:\s{0,10})[0-9]+"
MRN = (
    (r"\b[0-9]{3}-[0-9]{2}-[0-9]{2}(?:-[0-9])?\b", 0.8),
    (r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}(?:-[0-9])?\b", 0.8),
    (r"\b[0-9]{7}-[0-9]\b", 0.8),
    (r"\b[0-9]{8}\b", 0.7),
    (r"\b[0-9]{2}-[0-9]{2}-[0-9]{2}\b", 0.6),
    (r"\b[0-9]{10}\b", 0.7),
    (r"(?i)(?<=MRN:\s)[0-9][0-9 -]*[0-9]", 0.95),
    (r"(?i)(?<=MRN:)[0-9][0-9 -]*[0-9]", 0.95),
    (r"(?i)(?<=MRN:\s\s)[0-9][0-9 -]*[0-9]", 0.95),
    (r"(?i)(?<=MR#\s)[0-9][0-9 -]*[0-9]", 0.95),
    (r"(?i)(?<=MRN\s)[0-9][0-9 -]*[0-9]", 0.95),
    (r"(?i)(?<=MR\s)[0-9][0-9 -]*[0-9]", 0.90),
    (r"(?i)(?<=Medical Record Number:\s)[0-9][0-9 -]*[0-9]", 0.95),
    (r"(?i)(?<=MED REC #:\s{1,20})(?:\([0-9]+\))?[0-9]+", 0.95),
    (r"(?i)(?<=MED REC:\s{1,20})(?:\([0-9]+\))?[0-9]+", 0.95),
)
DATA_URI, PNG, BASE64 = r"data:image/[^;]+;base64,[A-Za-z0-9+/=]{50,}", r"iVBORw0KGgo[A-Za-z0-9+/]{100,}", r"[A-Za-z0-9+/]{500,}={0,2}"
#: Terms of the public glossary of genetics of the National Human Genome Research Institute, near which a run of bases is
#: more likely a sequence.
GENETIC_TERMS = (
    "allele", "base pair", "cDNA", "chromosome", "codon", "complementary DNA", "deletion", "DNA", "DNA sequencing", "exon", "gene", "gene expression",
    "genome", "genomic", "genotype", "haplotype", "insertion", "intron", "locus", "messenger RNA", "microarray", "mitochondrial DNA", "mRNA", "mutation",
    "nucleotide", "PCR", "plasmid", "point mutation", "polymerase chain reaction", "primer", "probe", "promoter", "RNA", "sequence", "SNP",
    "substitution", "transcript", "transfer RNA", "tRNA", "variant", "vector",
)
GENETIC_CONTEXT = r"(?i)\b(?:" + "|".join(t.replace(" ", r"\s+") for t in GENETIC_TERMS) + r")s?\b"

# Postal addresses of the United States, after the postal service's public lists of states, street suffixes and units.
_STATES = {
    "Alabama": "AL", "Alaska": "AK", "Arizona": "AZ", "Arkansas": "AR", "California": "CA", "Colorado": "CO", "Connecticut": "CT",
    "Delaware": "DE", "District of Columbia": "DC", "Florida": "FL", "Georgia": "GA", "Guam": "GU", "Hawaii": "HI", "Idaho": "ID",
    "Illinois": "IL", "Indiana": "IN", "Iowa": "IA", "Kansas": "KS", "Kentucky": "KY", "Louisiana": "LA", "Maine": "ME", "Maryland": "MD",
    "Massachusetts": "MA", "Michigan": "MI", "Minnesota": "MN", "Mississippi": "MS", "Missouri": "MO", "Montana": "MT", "Nebraska": "NE",
    "Nevada": "NV", "New Hampshire": "NH", "New Jersey": "NJ", "New Mexico": "NM", "New York": "NY", "North Carolina": "NC",
    "North Dakota": "ND", "Ohio": "OH", "Oklahoma": "OK", "Oregon": "OR", "Pennsylvania": "PA", "Puerto Rico": "PR", "Rhode Island": "RI",
    "South Carolina": "SC", "South Dakota": "SD", "Tennessee": "TN", "Texas": "TX", "Utah": "UT", "Vermont": "VT", "Virginia": "VA",
    "Washington": "WA", "West Virginia": "WV", "Wisconsin": "WI", "Wyoming": "WY",
}
_SUFFIXES = {
    "Alley": "Aly", "Avenue": "Ave", "Bend": "Bnd", "Boulevard": "Blvd", "Circle": "Cir", "Court": "Ct", "Cove": "Cv", "Crescent": "Cres",
    "Crossing": "Xing", "Drive": "Dr", "Expressway": "Expy", "Freeway": "Fwy", "Gardens": "Gdns", "Heights": "Hts", "Highway": "Hwy",
    "Landing": "Lndg", "Lane": "Ln", "Loop": "Lp", "Parkway": "Pkwy", "Place": "Pl", "Plaza": "Plz", "Ridge": "Rdg", "Road": "Rd",
    "Route": "Rte", "Square": "Sq", "Street": "St", "Terrace": "Ter", "Trail": "Trl", "Turnpike": "Tpke", "View": "Vw",
}
_WHOLE_SUFFIXES = ("Mews", "Pass", "Path", "Pike", "Row", "Run", "Walk", "Way")


def _any(words: Sequence[str]) -> str:
    """One of some words, longer ones first."""
    return "(?:" + "|".join(sorted((w.replace(" ", r"\s+") for w in words), key=lambda w: (-len(w), w))) + ")"


STATES = (*_STATES, *_STATES.values())
STREET_KINDS = (*_SUFFIXES, *_SUFFIXES.values(), *_WHOLE_SUFFIXES)
STATE, STREET = _any(STATES), _any(STREET_KINDS)
DIRECTIONS = ("North", "Northeast", "Northwest", "South", "Southeast", "Southwest", "East", "West", "N", "NE", "NW", "S", "SE", "SW", "E", "W")
DIRECTION = _any(DIRECTIONS) + "[.]?"
ZIP = "[0-9]{5}(?:-[0-9]{4})?"
UNITS = ("Apartment", "Apt", "Building", "Bldg", "Floor", "Fl", "Lot", "Room", "Rm", "Suite", "Ste", "Unit")
#: A unit's name and number, or its number alone after a number sign.
UNIT = rf"(?:{_any(UNITS)}[.]?\s*[#]?|[#])\s*[A-Za-z0-9-]{{1,8}}"
_HOUSE, _NAME_WORD, _TOWN = "[0-9]{1,6}(?:-[0-9]{1,5})?[A-Za-z]?", "[A-Za-z0-9]['A-Za-z0-9-]*[.]?", "[A-Za-z]['A-Za-z-]*[.]?(?:\\s+[A-Za-z]['A-Za-z-]*[.]?){0,3}"
_LINE = rf"\b{_HOUSE}\s+(?:{DIRECTION}\s+)?(?:{_NAME_WORD}\s+){{1,5}}?{STREET}[.]?(?:\s+{DIRECTION}\b)?(?:\s*,?\s+{UNIT})?"
_TAIL = rf"\s*,?\s*\b{STATE}\b[.]?\s*,?\s*"
_BOX = r"\b(?:P[.]?\s*O[.]?|Post\s+Office)\s+Box\s+[0-9]{1,7}"
#: Units of the metric system that prescriptions have: a number with one is a quantity, which no address holds.
QUANTITIES = ("cm", "g", "kg", "mcg", "mg", "mL", "mm", "mmol", "ng")
DOSE = r"(?i)\b[0-9]+(?:[.][0-9]+)?\s*" + _any(QUANTITIES) + r"\b"
# The names and scores of the three forms.
ADDRESS = (
    (rf"(?i){_LINE}\s*,\s*{_TOWN}{_TAIL}{ZIP}\b", 0.95, "full_address"),
    (rf"(?i){_LINE}(?:\s+{_TOWN})?{_TAIL}{ZIP}\b", 0.90, "address_state_zip"),
    (rf"(?i){_BOX}\s*,\s*{_TOWN}{_TAIL}(?:{ZIP}\b)?", 0.85, "po_box"),
)
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept|Sep|Oct|Nov|Dec"


def email(text: Column) -> Column:
    return _guarded(text, F.contains(text, F.lit("@")), F.transform(find(text, EMAIL), lambda x: span("EMAIL_ADDRESS", x, 0.85, "email", "email")))


def phone(text: Column) -> Column:
    found = F.transform(find(text, f"(?i)(?:{PHONE})"), lambda x: span("PHONE", x, 0.7, "phone", "phone"))
    return _guarded(text, text.rlike("[0-9]{4}"), found)


def valid_ssn(hit: Column) -> Column:
    """Area, group and serial that were never issued are no numbers, nor are known examples."""
    d = F.regexp_replace(hit, "[^0-9]", "")
    area = F.substring(d, 1, 3)
    return ~(
        area.isin("000", "666")
        | F.startswith(area, F.lit("9"))
        | (F.substring(d, 4, 2) == "00")
        | (F.substring(d, 6, 4) == "0000")
        | d.rlike(r"^([0-9])\1{8}$")
        | d.isin("078051120", "123456789", "987654321")
    )


def ssn(text: Column) -> Column:
    plain = lambda x: x["hit"].rlike("^[0-9]{9}$")
    found = F.transform(F.filter(find(text, SSN), lambda x: valid_ssn(x["hit"])), lambda x: span("US_SSN", x, F.when(plain(x), 0.3).otherwise(0.85), "ssn", F.when(plain(x), "plain").otherwise("delimited")))
    return _guarded(text, text.rlike("[0-9]{4}"), found)


def ipv4(text: Column) -> Column:
    found = F.transform(find(text, IPV4), lambda x: span("IP_ADDRESS", x, 0.85, "ip", "ipv4"))
    return _guarded(text, text.rlike(r"[0-9]\.[0-9]"), found)


def url(text: Column) -> Column:
    """Protocol, IPv6, IPv4, www and bare domains; the branch follows from the form of the match."""
    p = f"(?i)(?:{URL_PROTOCOL}|{IPV6}|{IPV4}|{URL_WWW}|{URL_DOMAIN})"

    def kind(h: Column) -> Column:
        return F.when(h.rlike("^(?i)(?:https?|ftp|file)://"), "protocol").when(h.rlike("^[0-9a-fA-F:.%]*:[0-9a-zA-Z:.%]*$"), "ipv6").when(h.rlike(rf"^(?:{OCTET}\.){{3}}{OCTET}$"), "ipv4").when(h.rlike(r"^(?i)www\."), "www").otherwise("domain")

    def one(x: Column) -> Column:
        k = kind(x["hit"])
        kept = F.when(k.isin("ipv4", "ipv6"), F.length(x["hit"])).otherwise(F.length(F.regexp_replace(x["hit"], r"[.,;:!?)\]}]+$", "")))
        y = F.struct(x["start"].alias("start"), (x["start"] + kept).alias("end"))
        return span("URL", y, F.when(k == "www", 0.8).when(k == "domain", 0.6).otherwise(0.85), "url", k)

    return _guarded(text, F.contains(text, F.lit(".")) | F.contains(text, F.lit(":")), F.filter(F.transform(find(text, p), one), lambda s: s["end"] > s["start"]))


def accession(text: Column) -> Column:
    """Numbers after the word, then standalone ones that lie in none of those."""
    value = r"[A-Z]{1,4}[0-9\-]{4,15}"
    named = rf"(?i)\b{ACCESSION_WORD}\s*(?:NUMBER|NO\.?|NUM\.?)?\s*:?\s*{value}\b"

    def tail(x: Column) -> Column:
        n = F.length(F.regexp_extract(x["hit"], rf"(?i)({value})$", 1))
        return F.struct((x["end"] - n).alias("start"), x["end"].alias("end"))

    first = F.transform(find(text, named), lambda x: span("ACC_NUM", tail(x), 1.0, "accession", "accession_with_context"))
    alone = F.transform(find(text, r"(?i)\b[A-Z]{1,4}[0-9\-]{6,15}\b"), lambda x: span("ACC_NUM", x, 0.3, "accession", "standalone_accession"))
    alone = F.filter(alone, lambda s: ~F.exists(first, lambda k: (k["start"] <= s["start"]) & (s["end"] <= k["end"])))
    return _guarded(text, text.rlike("[A-Za-z][0-9-]{4}"), F.concat(first, alone))


def _each(text: Column, pattern: str, entity: str, score: float, recognizer: str, name: str) -> Column:
    return F.transform(find(text, pattern), lambda x: span(entity, x, score, recognizer, name))


def har(text: Column) -> Column:
    """The pattern as it stands and, scored alike, without regard to case."""
    found = [_each(text, p, "HAR", 0.95, "har", n) for p, n in ((HAR, "har_pattern"), (f"(?i){HAR}", "har_pattern_alt"))]
    return _guarded(text, F.contains(F.upper(text), F.lit("HAR")), F.concat(*found))


def mrn(text: Column) -> Column:
    found = [_each(text, p, "MRN", s, "mrn", f"mrn_{k}") for k, (p, s) in enumerate(MRN, 1)]
    return _guarded(text, text.rlike("[0-9]{2}"), F.concat(*found))


def _free_of(taken: list[Column], spans: Column) -> Column:
    """Spans that overlap none of those taken."""
    every = F.concat(no_spans(), *taken)
    return F.filter(spans, lambda s: ~F.exists(every, lambda k: overlaps(k, s)))


def address(text: Column) -> Column:
    """US addresses in three forms by our own grammar, each free of what an earlier one took; none that holds a dose."""
    found: list[Column] = []
    for p, score, name in ADDRESS:
        hits = F.filter(find(text, p), lambda x: ~x["hit"].rlike(DOSE))
        found.append(_free_of(found, F.transform(hits, lambda x: span("LOCATION", x, score, "address", name))))
    return _guarded(text, text.rlike("[0-9]{5}") | text.rlike("(?i)box"), F.concat(*found))


def base64_image(text: Column) -> Column:
    found = [_each(text, p, "BASE64_IMAGE", s, "base64", n) for p, s, n in ((DATA_URI, 0.95, "data_uri"), (PNG, 0.90, "png"), (BASE64, 0.70, "generic"))]
    return _guarded(text, text.rlike("[A-Za-z0-9+/]{50}"), drop_overlapping_earlier(F.concat(*found)))


def genetic_score(hit: Column, around: Column) -> Column:
    n = F.length(hit)
    share = lambda b: (n - F.length(F.translate(F.upper(hit), b, ""))) / n
    most = F.greatest(share("A"), share("C"), share("G"), share("TU"))
    base = F.when(n > 50, 0.8).when(n > 30, 0.7).otherwise(0.6)
    named = F.lower(around).rlike(GENETIC_CONTEXT)
    return F.least(F.lit(0.95), F.round(base + F.when(most < 0.7, 0.1).otherwise(0.0) + F.when(named, 0.1).otherwise(0.0), 2))


def genetic(text: Column) -> Column:
    """At least 20 bases; longer, mixed ones and those near a word of the field score higher."""

    def one(x: Column) -> Column:
        a = F.greatest(x["start"] - 100, F.lit(0))
        around = F.concat(F.substring(text, a + 1, x["start"] - a), F.lit(" "), F.substring(text, x["end"] + 1, F.lit(100)))
        return span("GENETIC_SEQUENCE", x, genetic_score(x["hit"], around), "genetic", "bases")

    return _guarded(text, text.rlike("(?i)[ATGCU]{20}"), F.transform(find(text, r"(?i)\b[ATGCU]{20,}\b"), one))


def date(text: Column) -> Column:
    """Our own grammar, made of the layouts that date shifting knows."""
    sep = "[/-]"
    mon, day, year = "(?:1[0-2]|0?[1-9])", "(?:3[01]|[12][0-9]|0?[1-9])", "(?:19|20)[0-9]{2}"
    p = "|".join(
        (
            rf"{year}{sep}{mon}{sep}{day}(?:T[0-9]{{1,2}}:[0-9]{{2}}(?::[0-9]{{2}})?)?",
            rf"{day}{sep}(?:{MONTHS}){sep}{year}",
            rf"(?:{MONTHS}){sep}{day}{sep}{year}",
            rf"{mon}{sep}{day}{sep}(?:{year}|[0-9]{{2}})",
            rf"(?:1[3-9]|2[0-9]|3[01]){sep}{mon}{sep}{year}",
            rf"(?:{MONTHS})\s+{day}(?:st|nd|rd|th)?(?:,|\s)+{year}",
            rf"(?:{MONTHS})\s+(?:of\s+)?{year}",
            rf"{mon}{sep}{year}",
            rf"(?:{MONTHS})\s+{day}(?:st|nd|rd|th)?",
        )
    )
    found = F.transform(find(text, rf"(?i)\b(?:{p})\b"), lambda x: span("DATE_TIME", x, 0.6, "date", "layouts"))
    return _guarded(text, text.rlike("[0-9]"), found)


DETECTORS: dict[str, Callable[[Column], Column]] = {
    "EMAIL_ADDRESS": email,
    "PHONE": phone,
    "US_SSN": ssn,
    "IP_ADDRESS": ipv4,
    "URL": url,
    "ACC_NUM": accession,
    "HAR": har,
    "MRN": mrn,
    "LOCATION": address,
    "BASE64_IMAGE": base64_image,
    "GENETIC_SEQUENCE": genetic,
    "DATE_TIME": date,
}


def detect(text: Column, entities: Sequence[str]) -> Column:
    """Spans of the requested entities; only their detectors are in the plan."""
    unknown = set(entities) - set(DETECTORS)
    if unknown:
        raise ValueError(f"no detector for {sorted(unknown)}")
    return F.concat(no_spans(), *(DETECTORS[e](text) for e in dict.fromkeys(entities)))


def cached(spans_json: Column, entities: Sequence[str]) -> Column:
    """Stored results of the requested entities; text that is no JSON array of spans gives none."""
    got = F.from_json(spans_json, "array<struct<entity_type: string, start: int, end: int, score: double, recognition_metadata: struct<recognizer_name: string, matched_pattern: string>>>")
    made = F.transform(got, lambda x: F.struct(x["entity_type"], x["start"], x["end"], x["score"], x["recognition_metadata"]["recognizer_name"].alias("recognizer"), x["recognition_metadata"]["matched_pattern"].alias("pattern")).cast("struct<entity_type: string, start: int, end: int, score: double, recognizer: string, pattern: string>"))
    return F.coalesce(F.filter(made, lambda s: s["entity_type"].isin(list(entities)) & s["start"].isNotNull() & s["end"].isNotNull()), no_spans())


def passthrough(text: Column) -> Column:
    return no_spans()
