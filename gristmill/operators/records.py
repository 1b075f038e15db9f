"""Operators over structured records: lookup, survivorship, versions, conflicts, claims, upserts."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from gristmill.functions.keys import clean_key, plain_codes
from gristmill.functions.normalize import nearly_equal
from gristmill.functions.text import CODE


def where_equal(df: DataFrame, **values) -> DataFrame:
    """Rows whose columns equal the values, null equal to null."""
    return df.filter(reduce(and_, [F.col(c).eqNullSafe(F.lit(v)) for c, v in values.items()], F.lit(True)))


def referencing(df: DataFrame, refs: DataFrame, columns: list[str], ref: str = "ref") -> DataFrame:
    """Rows beside each ``ref`` that one of their string columns equals (blanks and case aside)."""
    values = F.array_distinct(F.array_compact(F.array(*[F.upper(F.trim(F.col(c))) for c in columns])))
    return df.withColumn(ref, F.explode(values)).join(refs.select(F.upper(F.trim(ref)).alias(ref)).distinct(), ref, "left_semi")


def upsert(current: DataFrame, arriving: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Current rows replaced by arriving ones of the same keys, the latest of each by ``version``.

    Of equal versions the arriving one wins. Rows with a null key are kept apart from others only
    by that null, as one key.
    """
    both = current.withColumn("_new", F.lit(0)).unionByName(arriving.withColumn("_new", F.lit(1)))
    rest = [c for c in both.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(version, "_new")).alias("r")
    return both.groupBy(*keys).agg(newest).select(*keys, "r.*").drop("_new").select(*current.columns)


def collapse(df: DataFrame, key: str, order: Column, first: list[str], last: list[str], listed: list[str]) -> DataFrame:
    """One row per key: the first and the last value present of some columns by ``order``, all of others in order.

    The pre-aggregation keeps one candidate per column, so keys with many rows are no burden, but
    for the ``listed`` columns, which return all there is.
    """
    by = df.withColumn("_o", order)
    picks = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_o"))).alias(c) for c in first]
    picks += [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_o"))).alias(c) for c in last]
    picks += [
        F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("_o", F.col(c).alias("v")))))["v"].alias(f"{c}_values") for c in listed
    ]
    return by.groupBy(key).agg(*picks)


def versions(df: DataFrame, key: str, effective: list[str]) -> DataFrame:
    """``df`` beside ``version`` (from 1), ``valid_to`` (the next one's first column) and ``is_current``."""
    order = Window.partitionBy(key).orderBy(*effective)
    after = F.lead(effective[0]).over(order)
    # the last version is the one without a next row, whatever its dates
    return df.withColumn("version", F.row_number().over(order)).withColumn("valid_to", after).withColumn(
        "is_current", F.lead(F.lit(1)).over(order).isNull()
    )


def survivors(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The best row of each key by ``order`` (authority, completeness, recency and so on)."""
    best = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")


def conflicts(df: DataFrame, key: list[str], field: str) -> DataFrame:
    """``key, n_values, lowest, highest`` of the keys that have more than one value of ``field``."""
    return (
        df.groupBy(*key).agg(F.countDistinct(field).alias("n_values"), F.min(field).alias("lowest"), F.max(field).alias("highest"))
        .filter("n_values > 1")
    )


def absent(subjects: DataFrame, facts: DataFrame, on: list[str]) -> DataFrame:
    """Subjects of which no fact is known, the facts being all there are."""
    return subjects.join(facts.select(*on).distinct(), on, "left_anti")


def verify(claims: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """``claims`` (``key, claimed``) beside ``found`` and ``verified``: the claim re-run against ``facts`` (``key, value``).

    A claim about a key without a fact is not verified.
    """
    known = facts.select(key, F.col("value").cast("string").alias("found"))
    agrees = F.coalesce(nearly_equal(F.col("claimed").cast("string"), F.col("found")), F.lit(False))
    return claims.join(known, key, "left").withColumn("verified", agrees)


def first_typing(df: DataFrame, text: str, order: Column, by: list[str] | None = None) -> DataFrame:
    """One row for each text that is equal but for case and blanks: the first by ``order``."""
    best = F.min_by(F.struct(*df.columns), order).alias("r")
    same = F.md5(F.lower(F.trim(F.col(text))))
    return df.groupBy(*(by or []), same.alias("_same")).agg(best).select("r.*")


def majority(df: DataFrame, key: str, value: str) -> DataFrame:
    """``key, winner, n_votes, unanimous``; of equally frequent values the smallest wins."""
    votes = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    return votes.groupBy(key).agg(
        F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias("winner"), F.sum("n").alias("n_votes"),
        (F.count("*") == 1).alias("unanimous"),
    )


def across(tables: dict[str, DataFrame], keys: dict[str, str], wanted: DataFrame) -> DataFrame:
    """``key, table_name, n_rows``: in which tables each wanted key (``key``) is the key of a row; keys compare as by ``clean_key``."""
    found = [df.distinct().select(clean_key(F.col(keys[name])).alias("key"), F.lit(name).alias("table_name")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, found).join(wanted.select("key").distinct(), "key", "left_semi").groupBy("key", "table_name").agg(F.count("*").alias("n_rows"))


def naming(df: DataFrame, refs: DataFrame, ref: str = "ref") -> DataFrame:
    """Rows beside each ``ref``, an identifier, that stands anywhere in one of their fields, lists included."""
    fields = [F.concat_ws(" ", F.col(f.name)) if f.dataType.typeName() in ("string", "array") else F.col(f.name).cast("string") for f in df.schema.fields]
    found = F.array_distinct(F.regexp_extract_all(plain_codes(F.concat_ws(" ", *fields)), F.lit(CODE), F.lit(0)))
    return df.withColumn(ref, F.explode(found)).join(refs.select(ref).distinct(), ref, "left_semi")


COUNTRIES = {"US": ("USA", "U.S.A.", "UNITED STATES", "US")}  # fixed values: typings of a country that count as the same


def in_country(df: DataFrame, column: str, country: str = "US") -> DataFrame:
    return df.filter(F.upper(F.trim(column)).isin(*COUNTRIES[country]))


def verify_sets(claimed: DataFrame, found: DataFrame, key: str, member: str) -> DataFrame:
    """``key, n_claimed, n_found, verified``: whether the members claimed for a key are all and only those found.

    Counts decide, so no set is gathered into one row. A claim of nothing needs nothing to be found.
    """
    both = claimed.select(key, member).distinct().withColumn("c", F.lit(1)).join(found.select(key, member).distinct().withColumn("f", F.lit(1)), [key, member], "full")
    per = both.groupBy(key).agg(F.count("c").alias("n_claimed"), F.count("f").alias("n_found"), F.count(F.when(F.col("c") == F.col("f"), 1)).alias("n_both"))
    return per.select(key, "n_claimed", "n_found", ((F.col("n_both") == F.col("n_claimed")) & (F.col("n_both") == F.col("n_found"))).alias("verified"))
