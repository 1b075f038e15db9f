"""Quantities recorded in different units: read terms, map unit spellings, convert.

Distinct texts are read into (number, unit spelling) terms. The distinct spellings are mapped to
units through an inverted index of character n-grams over a few canonical names and a weighted edit
distance that verifies the candidates; the alias dictionary that results is joined to all terms.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from gristmill.scratch import staged

# Symbols of units, in nanometres or days; None marks a unit that is known and not converted.
SYMBOLS = {
    "length": {"um": 1e3, "mm": 1e6, "cm": 1e7, "dm": 1e8, "m": 1e9, "km": 1e12, "in": 25.4e6, '"': 25.4e6, "″": 25.4e6, "''": 25.4e6, "ft": 304.8e6,
               "'": 304.8e6, "′": 304.8e6, "yd": 914.4e6, "mi": 1609.344e9, "nm": None, "pm": None},
    "time": {"d": 1.0, "w": 7.0, "h": 1 / 24, "min": None, "s": None, "mo": None, "yr": None},
}
# One name per unit and language, in English also the plural. All other spellings come through the index.
NAMES = {
    "length": {"micron": 1e3, "microns": 1e3, "thou": 25_400.0, "thous": 25_400.0, "mil": 25_400.0, "mils": 25_400.0, "inch": 25.4e6, "inches": 25.4e6,
               "zoll": 25.4e6, "pulgada": 25.4e6, "pouce": 25.4e6, "pollice": 25.4e6, "foot": 304.8e6, "feet": 304.8e6, "fuss": 304.8e6, "pie": 304.8e6,
               "yard": 914.4e6, "mile": 1609.344e9, "metre": 1e9},
    "time": {"day": 1.0, "days": 1.0, "tag": 1.0, "día": 1.0, "jour": 1.0, "giorno": 1.0, "dag": 1.0, "week": 7.0, "weeks": 7.0, "woche": 7.0, "semana": 7.0,
             "semaine": 7.0, "settimana": 7.0, "hour": 1 / 24, "hours": 1 / 24, "stunde": 1 / 24, "std": 1 / 24, "hora": 1 / 24, "heure": 1 / 24,
             "ora": 1 / 24, "uur": 1 / 24, "month": None, "monat": None, "mes": None, "mois": None, "year": None, "jahr": None, "año": None,
             "minute": None, "second": None},
}
# What a prefix makes of a metre, in nanometres; those out of any workshop's reach are known and not converted.
PREFIXES = {"milli": 1e6, "micro": 1e3, "centi": 1e7, "deci": 1e8, "kilo": 1e12, "deca": None, "hecto": None, "nano": None, "pico": None, "femto": None,
            "mega": None, "giga": None, "tera": None}
# What may stand before a quantity, and numbers in words.
LABELS = r"(?:oal|length|len|long|l|od|o\.d|dia|diam|diameter|outside|ø|⌀|lt|lead time|approx|about|circa|ca|~)(?:\.(?!\d))?\s*[=:]?\s*"
WORDS = "one two three four five six seven eight nine ten eleven twelve".split()
DESCRIBED = (
    r"\b(inch(?:es)?|centimet(?:re|er)s?|cm|millimet(?:re|er)s?|mm|feet|foot|met(?:re|er)s?|microns?|micromet(?:re|er)s?|thou|mils?)\b"
)

_NUMBER = r"(?:\d+(?:\s+|-)\d+/\d+|\d+/\d+|\d[\d,]*(?:\.\d+)?|\.\d+)"
_UNIT = r"(?:[\p{L}]+\.?(?:\(\p{L}+\))?|''|[\"'″′])"
_TERM = rf"{_NUMBER}\s*(?:{_UNIT})?"
VOWELS = "aeiouyáéíóúäöü"


def weighted_distance(spelled: str, name: str) -> float:
    """Edit distance of a spelling from a name, by how likely people make the change.

    A swap, a vowel for a vowel or a doubled letter costs half. Vowels left out of a name of four letters or more and
    letters that make a plural at its end cost a quarter, anything else one.
    """
    n, m = len(spelled), len(name)
    rows = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if not i and not j:
                continue
            x, y = spelled[i - 1] if i else "", name[j - 1] if j else ""
            best = float("inf")
            if i and j:
                best = rows[i - 1][j - 1] + (0.0 if x == y else 0.5 if x in VOWELS and y in VOWELS else 1.0)
            if i:
                best = min(best, rows[i - 1][j] + (0.25 if j == m and x in "sen" else 0.5 if i > 1 and spelled[i - 2] == x else 1.0))
            if j:
                best = min(best, rows[i][j - 1] + (0.25 if y in VOWELS and m > 3 else 0.5 if j > 1 and name[j - 2] == y else 1.0))
            if i > 1 and j > 1 and x == name[j - 2] and spelled[i - 2] == y:
                best = min(best, rows[i - 2][j - 2] + 0.5)
            rows[i][j] = best
    return rows[n][m]


@F.pandas_udf(T.DoubleType())
def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([weighted_distance(x, y) for x, y in zip(a, b)], dtype="float64")


def known_units(spark: SparkSession) -> DataFrame:
    """``kind, name, factor, fuzzy``: what is known of units; only names of two letters or more are met by other spellings."""
    rows = [(kind, name, factor, len(name) > 1 and name.isalpha()) for of in (SYMBOLS, NAMES) for kind, names in of.items() for name, factor in names.items()]
    rows += [("length", prefix + "metre", factor, True) for prefix, factor in PREFIXES.items()]
    return spark.createDataFrame(rows, "kind string, name string, factor double, fuzzy boolean")


def unit_spelling(c: Column) -> Column:
    """Lower case without a final dot or a plural in brackets, the sign for micro as u, sharp s as ss."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(c), r"\(\p{L}+\)$", ""), r"\.$", "")
    return F.regexp_replace(F.regexp_replace(bare, "[µμ]", "u"), "ß", "ss")


def _consonants(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, ""), lambda x: (x != "") & ~F.instr(F.lit(VOWELS), x).cast("boolean")))


def furthest(spelled: Column, name: Column) -> Column:
    """The largest distance at which a spelling still means a name: a quarter of the longer one's letters, long ones less."""
    longer = F.greatest(F.length(spelled), F.length(name))
    return F.least(longer * 0.25, longer * 0.1 + 1.0)


MARGIN = 0.2  # by which a unit must be nearer than any other


def alias_dictionary(spellings: DataFrame) -> DataFrame:
    """``kind, spelling, factor`` for the rows of ``spellings`` (``kind, spelling``) that name a unit.

    Known names match as they are. Others of two letters or more meet known names through an inverted index of character
    n-grams. The grams are single consonants, since any longer gram is lost by edits that the distance allows, while a
    consonant that lacks costs one: a name meets all spellings that lack no more of its consonants than ``furthest``.
    The weighted edit distance decides. A spelling as near (within ``MARGIN``) to a name of another size means nothing;
    one nearest to a unit that is not converted (kilo- and nanometres are no millimetres) means nothing either.
    """
    known = known_units(spellings.sparkSession)
    spellings = spellings.select("kind", "spelling").distinct()
    exact = spellings.join(F.broadcast(known), (spellings.kind == known.kind) & (spellings.spelling == known.name)).select(
        spellings.kind, "spelling", "factor"
    )
    unknown = spellings.join(exact, ["kind", "spelling"], "left_anti").filter(F.length("spelling").between(2, 40))
    index = known.filter("fuzzy").select("kind", "name", "factor", F.size(_consonants(F.col("name"))).alias("size"), F.explode(_consonants(F.col("name"))).alias("gram"))
    probes = unknown.withColumn("gram", F.explode(_consonants(F.col("spelling"))))
    far = furthest(F.col("spelling"), F.col("name"))
    near = (
        probes.join(F.broadcast(index), ["kind", "gram"])
        .groupBy("kind", "spelling", "name", "factor", "size").agg(F.count("*").alias("shared"))
        .filter(F.col("shared") >= F.col("size") - far)
        .withColumn("distance", _distance("spelling", "name")).filter(F.col("distance") <= far)
    )
    best = near.groupBy("kind", "spelling").agg(
        F.min_by("factor", "distance").alias("factor"), F.min("distance").alias("nearest"), F.collect_set(F.struct("factor", "distance")).alias("met")
    )
    rival = F.exists("met", lambda m: (m["distance"] < F.col("nearest") + MARGIN) & ~m["factor"].eqNullSafe(F.col("factor")))
    return exact.unionByName(best.filter(~rival).select("kind", "spelling", "factor")).filter("factor is not null")


def _number(c: Column) -> Column:
    """A decimal, a fraction or a whole number and a fraction. Commas before exactly three digits group."""
    plain = F.regexp_replace(F.regexp_replace(c, r",(?=\d{3}(?!\d))", ""), ",", ".")
    top = F.regexp_extract(c, r"(\d+)/(\d+)$", 1).try_cast("double")
    low = F.regexp_extract(c, r"(\d+)/(\d+)$", 2).try_cast("double")
    whole = F.coalesce(F.regexp_extract(c, r"^(\d+)(?:\s+|-)\d+/", 1).try_cast("double"), F.lit(0.0))
    return F.when(F.instr(c, "/") > 0, whole + F.try_divide(top, low)).otherwise(plain.try_cast("double"))


def _words_to_digits(c: Column) -> Column:
    word = F.regexp_extract(c, rf"^({'|'.join(WORDS)})\b", 1)
    digits = F.create_map(*[F.lit(x) for k, w in enumerate(WORDS, 1) for x in (w, str(k))])
    return F.when(word == "", c).otherwise(F.concat(F.try_element_at(digits, word), F.substring(c, F.length(word) + 1, F.length(c))))


def terms_of(texts: DataFrame) -> DataFrame:
    """``texts`` (with ``kind, text, described``) beside ``n, number, spelling``: one row per term.

    A text counts only if it is, after a label or sign, nothing but terms. ``+a/-b`` counts as ``a``.
    A lone number takes the unit that ``described`` names, else mm or days.
    """
    body = F.regexp_replace(F.lower(F.trim("text")), rf"^{LABELS}(?=[\d.±+]|{'|'.join(WORDS)})", "")
    body = F.regexp_replace(body, r"^\+\s*([^/+-][^/]*(?:\d/\d+[^/]*)?)/\s*-.*$", "$1")
    body = F.trim(_words_to_digits(F.regexp_replace(body, r"^(?:±|\+/-|\+-|\+)\s*", "")))
    whole = rf"^(?:{_NUMBER})\s*(?:{_UNIT})?(?:\s*[-,]?\s*(?:{_NUMBER})\s*(?:{_UNIT}))*$"
    terms = F.when(body.rlike(whole), F.regexp_extract_all(body, F.lit(_TERM), F.lit(0)))
    # an outer explode keeps the terms from being worked out twice, once more to filter what has none
    each = texts.withColumn("_terms", terms).select(*texts.columns, F.posexplode_outer("_terms").alias("n", "_term")).filter("_term is not null")
    fallback = F.coalesce("described", F.when(F.col("kind") == "time", "d").otherwise("mm"))
    unit = F.trim(F.regexp_replace("_term", rf"^{_NUMBER}\s*", ""))
    return each.select(*texts.columns, "n", _number(F.regexp_extract("_term", _NUMBER, 0)).alias("number"),
                       unit_spelling(F.when(unit == "", fallback).otherwise(unit)).alias("spelling"))


def convert(texts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, text, quantity`` of the texts that state a quantity, in nanometres or days.

    ``texts`` has the key columns, ``kind`` (length or time), ``text`` and ``described`` (a unit
    spelling the row states elsewhere, or null); further columns are not read. Repeated rows give repeated results. Null, blank and other
    texts give no row; neither do texts of which a term has no known unit. Each distinct text is read once, however many rows
    have it, and its quantity is joined back to the rows.
    """
    states = F.col("text").rlike(rf"(?i)[0-9]|\b(?:{'|'.join(WORDS)})\b")
    rows = texts.select(*keys, "kind", "text", "described").filter(F.col("text").isNotNull() & states)
    once = rows.select("kind", "text", "described").distinct()
    terms = staged(terms_of(once), "terms")
    aliases = alias_dictionary(terms.select("kind", "spelling"))
    valued = terms.join(aliases, ["kind", "spelling"], "left").withColumn("value", F.col("number") * F.col("factor"))
    read = (
        valued.groupBy("kind", "text", "described")
        .agg(F.sum("value").alias("sum"), F.count("value").alias("known"), F.count("*").alias("terms"))
        .filter("known = terms").select("kind", "text", "described", F.round("sum").cast("bigint").alias("quantity"))
    )
    a, b = rows.alias("a"), read.alias("b")
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("kind", "text", "described")]
    return a.join(b, on).select(*[F.col(f"a.{k}").alias(k) for k in keys], F.col("a.text").alias("text"), "b.quantity")
