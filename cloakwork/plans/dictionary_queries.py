"""Queries on pattern dictionaries; the SQL has hits by words and places, or as written by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.operators.dictionary import dictionary
from cloakwork.plans.catalogue import query, table


def _rule(pattern: str, score: float, label: str, category: str, any_case: bool = True) -> dict:
    return {"pattern": pattern, "flags": ["IGNORECASE"] if any_case else [], "score": score, "label": label, "category": category}


#: Rules on common words: some hold others, some overlap them, two meet at the same places.
WORDS = {
    "institution": "Words",
    "rules": [
        _rule(r"\bthe\b[.,;]*", 0.7, "the", "location", any_case=False),
        _rule(r"\bof\s+the\b", 0.9, "of_the", "facility"),
        _rule(r"\b(?:and|that)\s+of\s+the\b", 0.95, "that_of_the", "url"),
        _rule(r"\bthe\b", 0.5, "any_the", "name"),
        _rule(r"\bthe\s+of\b", 0.8, "the_of", "social"),
    ],
}


@query(r"""WITH d AS (SELECT doc_id, regexp_extract_all(text, '[\pL\pM\pN_]+') AS w, regexp_split_to_array(text, '[\pL\pM\pN_]+') AS g FROM documents WHERE text IS NOT NULL),
i AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM d),
l AS (SELECT doc_id, i, w[i] AS w, length(g[i]) AS n, g[i + 1] AS gap FROM i),
p AS (SELECT *, CAST(SUM(n + length(w)) OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS b FROM l),
t AS (SELECT doc_id, w, lower(w) AS a0, b - length(w) AS a, b, regexp_full_match(gap, '\s+') AS near, lead(lower(w)) OVER o AS a1, lead(b) OVER o AS b1,
 lead(regexp_full_match(gap, '\s+')) OVER o AS near1, lead(lower(w), 2) OVER o AS a2, lead(b, 2) OVER o AS b2 FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h AS (SELECT doc_id, a, b, 0 AS r, 'LOCATION' AS entity_type, 0.7 AS score, 'the' AS label FROM t WHERE w = 'the'
 UNION ALL SELECT doc_id, a, b1, 1, 'HOSPITAL', 0.9, 'of_the' FROM t WHERE a0 = 'of' AND near AND a1 = 'the'
 UNION ALL SELECT doc_id, a, b2, 2, 'URL', 0.95, 'that_of_the' FROM t WHERE a0 IN ('and', 'that') AND near AND a1 = 'of' AND near1 AND a2 = 'the'
 UNION ALL SELECT doc_id, a, b, 3, 'HOSPITAL', 0.5, 'any_the' FROM t WHERE a0 = 'the'
 UNION ALL SELECT doc_id, a, b1, 4, 'URL', 0.8, 'the_of' FROM t WHERE a0 = 'the' AND near AND a1 = 'of')
SELECT doc_id, a AS "start", b AS "end", entity_type, CAST(score AS DOUBLE) AS score, label FROM h
WHERE NOT EXISTS (SELECT 1 FROM h k WHERE k.doc_id = h.doc_id AND k.a <= h.a AND h.b <= k.b AND (k.a < h.a OR h.b < k.b OR k.r < h.r))""")
def dictionary_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered rules over whole documents: hits within others are gone, overlapping ones stay, the earlier of equals."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(dictionary(F.col("text"), WORDS)).alias("s"))
    return rows.select("doc_id", "s.start", "s.end", "s.entity_type", "s.score", F.col("s.pattern").alias("label"))


#: A dictionary like a hospital's own: addresses in the net, handles, names, codes.
CLINIC = {
    "institution": "Harbor Clinic",
    "rules": [
        _rule(r"www\.harbor\w+\.(?:org|com)\S*", 0.95, "address", "url"),
        _rule(r"harborclinic", 0.9, "bare", "name"),
        _rule(r"(?<!\w)@harbor\w+", 0.9, "handle", "social"),
        _rule(r"\bHarbor\s+Clinic\b", 0.9, "clinic", "facility"),
        _rule(r"\bHarbor\b", 0.7, "harbor", "name", any_case=False),
        _rule(r"\bHC\b", 0.7, "short", "abbreviation", any_case=False),
        _rule(r"\bMC\s+\d{4,5}\b", 0.75, "code", "location"),
        _rule(r"\b(?:ICU|NICU)-\d{4}\b", 0.7, "unit", "location"),
    ],
}
#: Texts and their spans by hand: start, end, entity type, label.
FORMS = (
    ("see www.harborclinic.org/map).", ((4, 28, "URL", "address"),)),
    ("HARBOR clinic, then Harbor.", ((0, 13, "HOSPITAL", "clinic"), (20, 26, "HOSPITAL", "harbor"))),
    ("ask @harbor_team or @harborclinic", ((4, 16, "URL", "handle"), (20, 33, "URL", "handle"))),
    ("MC 4471 in NICU-2030, HC", ((0, 7, "LOCATION", "code"), (11, 20, "LOCATION", "unit"), (22, 24, "HOSPITAL", "short"))),
    ("no harbour, XHCX, mc 12", ()),
    ("Ärzte im Harbor\nClinic", ((9, 22, "HOSPITAL", "clinic"),)),
    ("ÄHC HC", ((4, 6, "HOSPITAL", "short"),)),
    ("a@harborclinic harbor", ((2, 14, "HOSPITAL", "bare"),)),
    (None, ()),
)
_ROWS = ", ".join(f"({k}, {a}, {b}, '{t}', '{label}')" for k, (_, spans) in enumerate(FORMS) for a, b, t, label in spans)


@query(f"""SELECT c_custkey, a AS "start", b AS "end", t AS entity_type, label FROM customer JOIN (VALUES {_ROWS}) f(k, a, b, t, label) ON k = c_custkey % {len(FORMS)}""")
def dictionary_forms_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose spans are written by hand, followed by the customer's name."""
    form = F.element_at(F.array(*(F.lit(t) for t, _ in FORMS)), (F.col("c_custkey") % len(FORMS)).cast("int") + 1)
    text = F.concat(form, F.lit(" "), F.col("c_name"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.explode(dictionary(text, CLINIC)).alias("s"))
    return rows.select("c_custkey", "s.start", "s.end", "s.entity_type", F.col("s.pattern").alias("label"))
