"""Column functions for keys and dates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clean_key(c: Column) -> Column:
    """Upper case, plain hyphens, no blanks: the form in which typed keys are compared."""
    return F.upper(F.regexp_replace(F.regexp_replace(c, r"[\s\p{Z}​﻿]+", ""), r"[\p{Pd}−­]", "-"))


def plain_codes(c: Column) -> Column:
    """Text whose keys are in the form of ``clean_key``: upper case, plain hyphens, no invisible characters; blanks stay."""
    return F.upper(F.regexp_replace(F.regexp_replace(c, r"[\x{200b}\x{2060}\x{feff}]+", ""), r"[\p{Pd}−­]", "-"))


def month_of(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")
