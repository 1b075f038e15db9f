"""Scalar normalizers as Column functions. Text that states no value gives null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def present(c: Column) -> Column:
    """Null for what stands for nothing."""
    t = F.trim(c)
    return F.when((t != "") & ~F.upper(t).isin("MISSING", "N/A", "-"), t)


def _part(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit("")).try_cast("double")


def duration_hours(c: Column) -> Column:
    """``4.5h``, ``360 min``, ``3:00`` and ``1h30m`` as hours, to four places."""
    t = F.lower(F.trim(c))
    clock = _part(t, r"^(\d+):(\d{1,2})$") + _part(t, r"^(\d+):(\d{1,2})$", 2) / 60.0
    both = _part(t, r"^(\d+)\s*h\s*(\d+)\s*m(?:in)?$") + _part(t, r"^(\d+)\s*h\s*(\d+)\s*m(?:in)?$", 2) / 60.0
    hours = _part(t, r"^(\d+(?:\.\d+)?)\s*h(?:rs?|ours?)?$")
    minutes = _part(t, r"^(\d+(?:\.\d+)?)\s*m(?:in(?:utes?|s)?)?$") / 60.0
    return F.round(F.coalesce(clock, both, hours, minutes), 4)


def lead_days(c: Column) -> Column:
    """Weeks and days in English as whole days; a bare number is days."""
    t = F.lower(F.trim(c))
    weeks = _part(t, r"^(?:approx\. |lt )?(\d+(?:\.\d+)?)\s*(?:weeks?|wks?|w|week\(s\))$") * 7.0
    days = _part(t, r"^(?:approx\. |lt )?(\d+(?:\.\d+)?)\s*(?:days?|d)?$")
    return F.floor(F.coalesce(weeks, days)).cast("bigint")


def first_number(c: Column) -> Column:
    return F.regexp_extract(F.replace(c, F.lit(","), F.lit("")), r"\d+(?:\.\d+)?", 0).try_cast("double")


def whole_number(c: Column) -> Column:
    return F.regexp_extract(F.replace(c, F.lit(","), F.lit("")), r"^\s*(\d+)\s*$", 1).try_cast("bigint")


def any_date(c: Column) -> Column:
    t = F.trim(c)
    return F.coalesce(F.try_to_date(t, "yyyy-MM-dd"), F.try_to_date(t, "MM/dd/yyyy"))


def line_total(quantity: Column, price: Column) -> Column:
    return F.when((quantity != 0) & (price != 0), F.round(quantity * price, 2))


def oee(availability: Column, performance: Column, quality: Column) -> Column:
    """Overall effectiveness in per cent, cut (not rounded) to one place."""
    return F.floor(availability * performance * quality * 1000.0) / 10.0


# Conversion factors.
FACTORS = {("mm", "in"): 1 / 25.4, ("in", "mm"): 25.4, ("nm", "ft_lb"): 0.737562149, ("kg_m3", "g_cm3"): 0.001, ("h", "min"): 60.0, ("wk", "d"): 7.0}


def convert(value: Column, from_unit: str, to_unit: str) -> Column:
    return F.round(value * F.lit(FACTORS[from_unit, to_unit]), 4)


def nearly_equal(a: Column, b: Column) -> Column:
    """Numbers within 1e-4, other text equal but for case and blanks around it."""
    x, y = a.try_cast("double"), b.try_cast("double")
    return F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) <= 1e-4).otherwise(F.lower(F.trim(a)) == F.lower(F.trim(b)))


def factors(spark) -> DataFrame:
    """``from_unit, to_unit, factor``: the conversions as a table to join to values in mixed units."""
    return spark.createDataFrame([(*units, f) for units, f in FACTORS.items()], "from_unit string, to_unit string, factor double")
