"""Queries on the parts of names and addresses; the SQL has the parts of each form as written by hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.operators.address_parts import address_parts
from cloakwork.operators.name_parts import name_parts
from cloakwork.plans.catalogue import query, table

#: Forms of names, @ a word of the row, and their parts: title, given, middle, particle, surname, suffix.
NAME_FORMS = (
    ("John @", None, "John", None, None, "@", None),
    ("Dr. Ludwig van @", "Dr.", "Ludwig", None, "van", "@", None),
    ("@, Ludwig van", None, "Ludwig", None, "van", "@", None),
    ("van der @, Anna M., MD", None, "Anna", "M.", "van der", "@", "MD"),
    ("@, John, Jr.", None, "John", None, None, "@", "Jr."),
    ("Mr. @", "Mr.", None, None, None, "@", None),
    ("@", None, "@", None, None, None, None),
    ("Prof. Maria de la @, PhD", "Prof.", "Maria", None, "de la", "@", "PhD"),
    ("John V @", None, "John", "V", None, "@", None),
    ("Henry @ II", None, "Henry", None, None, "@", "II"),
    ("O'@, Mary-Jane", None, "Mary-Jane", None, None, "O'@", None),
    ("Anh Do", None, "Anh", None, None, "Do", None),
    ("Dr. @ MD", "Dr.", None, None, None, "@", "MD"),
    ("J. R. R. @", None, "J.", "R. R.", None, "@", None),
    ("Sen. John Q. @ III, Esq.", "Sen.", "John", "Q.", None, "@", "III Esq."),
    ("Rev. Dr. Martin Luther @, Jr.", "Rev. Dr.", "Martin", "Luther", None, "@", "Jr."),
    ("Al @", None, "Al", None, None, "@", None),
    ("@,John", None, "John", None, None, "@", None),
    ("@, Dr. John", "Dr.", "John", None, None, "@", None),
    ("Jose dos Santos @", None, "Jose", None, "dos", "Santos @", None),
    ("", None, None, None, None, None, None),
    (None, None, None, None, None, None, None),
)
_PARTS = ("title", "given", "middle", "particle", "surname", "suffix")


def _literal(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def _values(forms: tuple) -> str:
    """A SQL table of forms, numbered."""
    return "(VALUES " + ", ".join(f"({i}, {', '.join(map(_literal, f))})" for i, f in enumerate(forms)) + ")"


def _pick(forms: tuple, key: Column, word: Column) -> Column:
    """The form of a row, with its word."""
    texts = F.array(*(F.lit(f[0]) for f in forms))
    return F.replace(F.element_at(texts, (key % len(forms)).cast("int") + 1), F.lit("@"), word)


_NAME_COLUMNS = ", ".join(f"replace({c}, '@', w) AS {c}" for c in ("name", *_PARTS))


@query(f"""SELECT c_custkey, {_NAME_COLUMNS} FROM (SELECT c_custkey, upper(c_mktsegment[1:1]) || lower(c_mktsegment[2:]) AS w FROM customer)
JOIN {_values(NAME_FORMS)} f(k, name, {', '.join(_PARTS)}) ON k = c_custkey % {len(NAME_FORMS)}""")
def name_parts_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", _pick(NAME_FORMS, F.col("c_custkey"), F.initcap("c_mktsegment")).alias("name"))
    return rows.withColumn("p", name_parts(F.col("name"))).select("c_custkey", "name", "p.*")


#: Forms of addresses, @ a number of the row, and their parts: number, direction, street, kind, unit, city, state, zip, box.
ADDRESS_FORMS = (
    ("@ Oak Street, Springfield, CA 94305", "@", None, "Oak", "Street", None, "Springfield", "CA", "94305", None),
    ("@ N. Elm Rd Apt 4, Salt Lake City, Utah 84101", "@", "N.", "Elm", "Rd", "Apt 4", "Salt Lake City", "Utah", "84101", None),
    ("@ Lake View Terrace, Reno, NV 89501-1234", "@", None, "Lake View", "Terrace", None, "Reno", "NV", "89501-1234", None),
    ("@ Washington Ave, Washington, DC 20001", "@", None, "Washington", "Ave", None, "Washington", "DC", "20001", None),
    ("@ 5th Ave, New York, New York 10001", "@", None, "5th", "Ave", None, "New York", "New York", "10001", None),
    ("@ Maple Ct, Hartford, CT 06101", "@", None, "Maple", "Ct", None, "Hartford", "CT", "06101", None),
    ("90210 Sunset Blvd #@, Los Angeles, CA 90069", "90210", None, "Sunset", "Blvd", "#@", "Los Angeles", "CA", "90069", None),
    ("P.O. Box @, Fort Worth, TX 76101", None, None, None, None, None, "Fort Worth", "TX", "76101", "P.O. Box @"),
    ("Palo Alto, CA 94301", None, None, None, None, None, "Palo Alto", "CA", "94301", None),
    ("@ West 42nd St Fl 2, Miami, FL 33101", "@", "West", "42nd", "St", "Fl 2", "Miami", "FL", "33101", None),
    ("@ Main St Oakland CA 94612", "@", None, "Main", "St", None, "Oakland", "CA", "94612", None),
    ("@ St Mark Pl, St Louis, MO 63101", "@", None, "St Mark", "Pl", None, "St Louis", "MO", "63101", None),
    ("@ Birch Lane", "@", None, "Birch", "Lane", None, None, None, None, None),
    ("", None, None, None, None, None, None, None, None, None),
    (None, None, None, None, None, None, None, None, None, None),
)
_ADDRESS_PARTS = ("number", "direction", "street", "kind", "unit", "city", "state", "zip", "box")
_ADDRESS_COLUMNS = ", ".join(f"replace({c}, '@', w) AS {c}" for c in ("address", *_ADDRESS_PARTS))


@query(f"""SELECT s_suppkey, {_ADDRESS_COLUMNS}, coalesce(address, '') <> '' AS valid FROM (SELECT s_suppkey, CAST(s_suppkey % 900 + 100 AS VARCHAR) AS w FROM supplier)
JOIN {_values(ADDRESS_FORMS)} f(k, address, {', '.join(_ADDRESS_PARTS)}) ON k = s_suppkey % {len(ADDRESS_FORMS)}""")
def address_parts_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", _pick(ADDRESS_FORMS, F.col("s_suppkey"), (F.col("s_suppkey") % 900 + 100).cast("string")).alias("address"))
    return rows.withColumn("p", address_parts(F.col("address"))).select("s_suppkey", "address", "p.*")
