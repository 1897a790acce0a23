"""Names split into parts by an automaton over classes of tokens, as one fold of column expressions.

A token is a comma or what stands between commas and white space. The automaton reads names in the order of speech
("Dr. Ludwig van Beethoven, Jr.") and in that of lists ("van Beethoven, Ludwig, Jr.").
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakwork.operators.names import PARTICLES, SALUTATIONS, SUFFIXES

PARTS = "struct<title: string, given: string, middle: string, particle: string, surname: string, suffix: string>"

#: (state, class of the token) -> (next state, what is done with the token). States: start, names (in the order of
#: speech), comma (after the first one), listed (names after a surname and a comma), after (suffixes after names).
TRANSITIONS = {
    ("start", "title"): ("start", "title"),
    ("start", "particle"): ("names", "name"),
    ("start", "suffix"): ("names", "name"),
    ("start", "word"): ("names", "name"),
    ("start", "comma"): ("start", "skip"),
    ("names", "title"): ("names", "name"),
    ("names", "particle"): ("names", "name"),
    ("names", "suffix"): ("after", "suffix"),
    ("names", "word"): ("names", "name"),
    ("names", "comma"): ("comma", "skip"),
    ("after", "title"): ("names", "back"),
    ("after", "particle"): ("names", "back"),
    ("after", "suffix"): ("after", "suffix"),
    ("after", "word"): ("names", "back"),
    ("after", "comma"): ("comma", "skip"),
    ("comma", "title"): ("comma", "title"),
    ("comma", "particle"): ("listed", "turn"),
    ("comma", "suffix"): ("comma", "suffix"),
    ("comma", "word"): ("listed", "turn"),
    ("comma", "comma"): ("comma", "skip"),
    ("listed", "title"): ("listed", "name"),
    ("listed", "particle"): ("listed", "name"),
    ("listed", "suffix"): ("listed", "suffix"),
    ("listed", "word"): ("listed", "name"),
    ("listed", "comma"): ("listed", "skip"),
}
_STATE = "struct<state: string, titles: array<string>, names: array<string>, surname: array<string>, suffixes: array<string>>"


def _plain(token: Column) -> Column:
    return F.regexp_replace(F.lower(token), "[^a-z0-9]", "")


def _among(word: Column, words: frozenset[str]) -> Column:
    return word.isin(sorted(words))


def _class(token: Column, a: Column) -> Column:
    """A suffix before any comma needs a name before it, besides what can only be a surname."""
    plain, early = _plain(token), a["state"].isin("start", "names")
    enough = ~early | (F.size(a["names"]) + F.size(a["titles"]) > 1)
    return (
        F.when(token == ",", "comma")
        .when((a["state"] == "start") & _among(plain, SALUTATIONS), "title")
        .when(_among(plain, SUFFIXES) & enough & (F.size(a["names"]) > 0), "suffix")
        .when((a["state"] == "comma") & _among(plain, SALUTATIONS), "title")
        .when(_among(plain, PARTICLES), "particle")
        .otherwise("word")
    )


def _step(table: Column, a: Column, token: Column) -> Column:
    move = F.element_at(table, F.concat_ws(" ", a["state"], _class(token, a)))

    def to(m: Column) -> Column:
        done = m["action"]
        none = F.array().cast("array<string>")
        one = F.array(token)
        return F.struct(
            m["state"].alias("state"),
            F.when(done == "title", F.concat(a["titles"], one)).otherwise(a["titles"]).alias("titles"),
            F.when(done == "name", F.concat(a["names"], one)).when(done == "back", F.concat(a["names"], a["suffixes"], one)).when(done == "turn", one).otherwise(a["names"]).alias("names"),
            F.when(done == "turn", a["names"]).otherwise(a["surname"]).alias("surname"),
            F.when(done == "suffix", F.concat(a["suffixes"], one)).when(done == "back", none).otherwise(a["suffixes"]).alias("suffixes"),
        )

    return F.element_at(F.transform(F.array(move), to), 1)


def _split(a: Column) -> Column:
    """The parts of the final state: in the order of speech a surname is the last word, or starts at the first particle
    that is neither first nor last; in the order of lists particles at the end ("Beethoven, Ludwig van") are its, too."""
    n, listed = F.size(a["names"]), F.size(a["surname"]) > 0
    is_particle = lambda t: _among(_plain(t), PARTICLES)
    inner = F.filter(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: (i <= n - 2) & is_particle(F.try_element_at(a["names"], i + 1)))
    at = F.when(listed, n).when(n == 1, F.when(F.size(a["titles"]) > 0, 0).otherwise(1)).otherwise(F.coalesce(F.try_element_at(inner, F.lit(1)), F.greatest(n - 1, F.lit(0))))

    def parts(x: Column) -> Column:
        family, first = x["family"], x["first"]
        lead = F.coalesce(F.try_element_at(F.filter(F.transform(family, lambda t, i: F.when(~is_particle(t) | (i == F.size(family) - 1), i)), lambda i: i.isNotNull()), F.lit(1)), F.lit(0))
        kept = F.coalesce(F.array_max(F.transform(first, lambda t, i: F.when(~is_particle(t) | (i == 0), i + 1))), F.lit(0))
        text = lambda tokens: F.nullif(F.array_join(tokens, " "), F.lit(""))
        return F.struct(
            text(a["titles"]).alias("title"),
            text(F.slice(first, 1, 1)).alias("given"),
            text(F.slice(first, 2, F.greatest(kept - 1, F.lit(0)))).alias("middle"),
            text(F.concat(F.slice(first, kept + 1, F.greatest(F.size(first), F.lit(1))), F.slice(family, 1, lead))).alias("particle"),
            text(F.slice(family, lead + 1, F.greatest(F.size(family), F.lit(1)))).alias("surname"),
            text(a["suffixes"]).alias("suffix"),
        )

    family = F.when(listed, a["surname"]).otherwise(F.slice(a["names"], at + 1, F.greatest(n, F.lit(1))))
    return F.element_at(F.transform(F.array(F.struct(family.alias("family"), F.slice(a["names"], 1, at).alias("first"))), parts), 1)


def name_parts(text: Column) -> Column:
    """struct(title, given, middle, particle, surname, suffix) of a person's name; parts that are absent are null.

    Defined cases: null, empty and blank texts have null parts only; a single word is a given name, after a title a
    surname; words after a suffix without comma make the suffix a name ("John V Smith"); tokens are kept as written, and
    every token but commas is in exactly one part.
    """
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(,|[^\s,]+)"), F.lit(1))
    keys = [F.lit(f"{state} {kind}") for state, kind in TRANSITIONS]
    moves = [F.struct(F.lit(state).alias("state"), F.lit(action).alias("action")) for state, action in TRANSITIONS.values()]
    table = F.map_from_arrays(F.array(*keys), F.array(*moves))
    none = F.array().cast("array<string>")
    start = F.struct(F.lit("start").alias("state"), none.alias("titles"), none.alias("names"), none.alias("surname"), none.alias("suffixes")).cast(_STATE)
    return F.aggregate(tokens, start, lambda a, t: _step(table, a, t), _split).cast(PARTS)
