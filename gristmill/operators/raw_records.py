"""Rows that fail to parse: an error-recovering recursive-descent reader for delimited records.

Grammar of one text (``FileSpec.columns`` fixes how many fields a record has)::

    text    := record (line_break record)*
    record  := field ("," field)*
    field   := quoted | bare
    quoted  := '"' (any character but '"' | '""')* '"'      followed by "," or the end
    bare    := characters other than '"', "," and line breaks

A syntax error is located and kept, and reading goes on at the next validated record start: a line
that opens with the file's key followed by a comma. Values are then checked and typed column by
column. Every text yields at least one record row, so nothing is lost.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# Forms of the values in the three files.
_QUANTITY = re.compile(r"(?:[0-9]+|[0-9]{1,3}(?:,[0-9]{3})+)")
_AMOUNT = re.compile(
    r"(?:(?:[$€£]|USD|EUR|GBP) ?)?(?P<a>(?:[0-9]+|[0-9]{1,3}(?:,[0-9]{3})+)(?:\.[0-9]{2})?)"
    r"|(?P<b>(?:[0-9]+|[0-9]{1,3}(?:,[0-9]{3})+)(?:\.[0-9]{2})?) ?(?:[$€£]|USD|EUR|GBP)"
)
_DATE = re.compile(r"(?:(?P<y>[0-9]{4})-(?P<m>[0-9]{2})-(?P<d>[0-9]{2})|(?P<m2>[0-9]{2})/(?P<d2>[0-9]{2})/(?P<y2>[0-9]{4}))")
_DURATION = re.compile(r"[0-9]+(?:\.[0-9]+)? ?h|[0-9]+ ?min|[0-9]+:[0-5][0-9]|[0-9]+h[0-5]?[0-9]m")
_EMAIL = re.compile(r"[^@\s]+@[^@\s]+\.[^@\s]+")
_BARE = re.compile(r'[^",\r\n]*')
_QUOTED = re.compile(r'"([^"]*(?:""[^"]*)*)"')

ERROR_TYPE = "array<struct<code:string,field:int,pos:int>>"
RECORD_TYPE = f"part int, n_parts int, starts_at int, ok boolean, values array<string>, errors {ERROR_TYPE}"


def _id(prefix: str) -> Callable[[str], bool]:
    form = re.compile(prefix + "-[0-9]+")
    return lambda v: form.fullmatch(v) is not None


def _date(v: str) -> bool:
    m = _DATE.fullmatch(v)
    if not m:
        return False
    try:
        dt.date(int(m["y"] or m["y2"]), int(m["m"] or m["m2"]), int(m["d"] or m["d2"]))
    except ValueError:
        return False
    return True


def _quantity(v: str) -> bool:
    return _QUANTITY.fullmatch(v) is not None and v.strip("0,") != ""


def _amount(v: str) -> bool:
    m = _AMOUNT.fullmatch(v)
    return m is not None and (m["a"] or m["b"]).strip("0,.") != ""


def _or_empty(rule: Callable[[str], bool]) -> Callable[[str], bool]:
    return lambda v: v == "" or rule(v)


def _filled(v: str) -> bool:
    return v != ""


@dataclass(frozen=True)
class FileSpec:
    """A file's key prefix, its columns in order and the rule of each column (None: anything goes)."""

    key: str
    columns: tuple[str, ...]
    rules: tuple[Callable[[str], bool] | None, ...]

    @property
    def anchor(self) -> re.Pattern[str]:
        return re.compile(rf'(?:\r\n|\n|\r)[ \t]*(?="?[ \t]*{self.key}-[0-9]+[ \t]*"?,)')


FILES = {
    "erp/suppliers_master.csv": FileSpec(
        "SUP",
        ("supplier_id", "name", "country", "products", "lead_time", "contact_email"),
        (_id("SUP"), _filled, None, _filled, _filled, _or_empty(lambda v: _EMAIL.fullmatch(v) is not None)),
    ),
    "erp/purchase_orders.csv": FileSpec(
        "PO",
        ("po", "supplier", "part", "qty", "unit_price", "moq", "lead_time", "po_date"),
        (_id("PO"), None, None, _quantity, _amount, _or_empty(_quantity), _filled, _date),
    ),
    "maintenance/cmms_export.csv": FileSpec(
        "WO",
        ("wo", "asset", "machine", "wo_date", "downtime", "mtbf_hours", "technician", "notes"),
        (_id("WO"), None, _id("MCH"), _date, lambda v: _DURATION.fullmatch(v) is not None,
         _or_empty(lambda v: v.isascii() and v.isdigit()), None, None),
    ),
}


class _Reader:
    """Recursive descent over one text; one method per rule of the grammar."""

    def __init__(self, spec: FileSpec):
        self.spec, self.anchor = spec, spec.anchor

    def text(self, raw: str) -> list[tuple[int, list[str] | None, list[tuple[str, int, int]]]]:
        out, at = [], 0
        while True:
            start = at
            values, errors, at = self.record(raw, at)
            out.append((start, values, errors))
            if at >= len(raw):
                return out

    def record(self, raw: str, at: int) -> tuple[list[str] | None, list[tuple[str, int, int]], int]:
        values: list[str] = []
        places: list[int] = []
        start = at
        while True:
            places.append(at)
            value, at, wrong = self.field(raw, at)
            if wrong:
                return None, [(wrong, len(values), at)], self.resume(raw, start, at)
            values.append(value)
            if at < len(raw) and raw[at] == ",":
                at += 1
                continue
            if at < len(raw):  # a line break: another record may start here, anything else is an error
                if (m := self.anchor.match(raw, at)) is None:
                    return None, [("line_break_in_bare_field", len(values) - 1, at)], self.resume(raw, start, at)
                at = m.end()
            return values, self.check(values, places), at

    def field(self, raw: str, at: int) -> tuple[str, int, str]:
        """Value, end and kind of error ('' if none) of the field at ``at``."""
        if raw.startswith('"', at):
            if (m := _QUOTED.match(raw, at)) is None:
                return "", at, "quote_not_closed"
            end = m.end()
            if end < len(raw) and raw[end] not in ",\r\n":
                return "", end, "text_after_quote"
            return m[1].replace('""', '"'), end, ""
        m = _BARE.match(raw, at)
        end = m.end()
        if raw.startswith('"', end):
            return "", end, "quote_in_bare_field"
        return m[0], end, ""

    def resume(self, raw: str, start: int, at: int) -> int:
        """The next validated record start after the broken record's own, or the end of the text.

        A broken quote may have swallowed record starts, so the search begins where the record did.
        """
        m = self.anchor.search(raw, start + 1 if start else 0)
        while m and m.end() <= start:
            m = self.anchor.search(raw, m.end())
        return m.end() if m else len(raw)

    def check(self, values: list[str], places: list[int]) -> list[tuple[str, int, int]]:
        """Errors of the values, each with its field and where that begins."""
        want = len(self.spec.columns)
        if len(values) != want:
            k = min(len(values), want)
            return [("too_many_fields" if len(values) > want else "too_few_fields", k, places[min(k, len(places) - 1)])]
        return [
            ("invalid_" + name, k, places[k])
            for k, (name, rule) in enumerate(zip(self.spec.columns, self.spec.rules))
            if rule is not None and not rule(values[k].strip())
        ]


def parse_records(df: DataFrame, id_col: str = "record_id", file_col: str = "source_file", raw_col: str = "raw",
                  files: dict[str, FileSpec] = FILES) -> DataFrame:
    """One row per record found in each text: ``id_col, file_col, part, n_parts, starts_at, ok, values, errors``.

    ``part`` counts the ``n_parts`` records of a text from 1, ``starts_at`` is the record's first character,
    ``values`` is null where the quoting broke. A null or empty text gives one row with the error
    ``empty_text``, an unknown file one with ``unknown_file``. Only the three named columns are
    read, so further columns of any name do no harm; repeated rows give repeated results.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        readers = {name: _Reader(spec) for name, spec in files.items()}
        for batch in batches:
            rows = []
            for rid, file, raw in zip(batch["id"], batch["file"], batch["raw"]):
                if not raw:
                    rows.append((rid, file, 1, 1, 0, False, None, [("empty_text", 0, 0)]))
                elif file not in readers:
                    rows.append((rid, file, 1, 1, 0, False, None, [("unknown_file", 0, 0)]))
                else:
                    found = readers[file].text(raw)
                    for n, (start, values, errors) in enumerate(found, 1):
                        rows.append((rid, file, n, len(found), start, not errors, values, errors))
            yield pd.DataFrame(rows, columns=["id", "file", "part", "n_parts", "starts_at", "ok", "values", "errors"])

    id_type = df.schema[id_col].dataType.simpleString()
    slim = df.select(F.col(id_col).alias("id"), F.col(file_col).alias("file"), F.col(raw_col).alias("raw"))
    out = slim.mapInPandas(read, f"id {id_type}, file string, {RECORD_TYPE}")
    return out.withColumnsRenamed({"id": id_col, "file": file_col})


def failed(parsed: DataFrame, id_col: str = "record_id") -> DataFrame:
    """Ids of texts that are not exactly one valid record."""
    return parsed.filter(~F.col("ok") | (F.col("n_parts") > 1)).select(id_col).distinct()


def _value(name: str, spec: FileSpec) -> Column:
    return F.trim(F.col("values")[spec.columns.index(name)])


def _digits(c: Column, to: str) -> Column:
    return F.nullif(F.regexp_replace(c, "[^0-9.]", ""), F.lit("")).cast(to)


def _any_date(c: Column) -> Column:
    return F.coalesce(F.try_to_date(c, "yyyy-MM-dd"), F.try_to_date(c, "MM/dd/yyyy"))


def typed(parsed: DataFrame, file: str, files: dict[str, FileSpec] = FILES, strict: bool = True) -> DataFrame:
    """The valid records of one file as typed columns, beside ``record_id`` and ``record_part``; empty text becomes null.

    With ``strict`` only texts that are exactly one record count, as in ``failed``; without, also the valid records of a text of
    several, those that reading found again after a broken quote among them.
    """
    spec = files[file]
    rows = parsed.filter((F.col("source_file") == file) & F.col("ok"))
    typed_as = {
        "qty": lambda c: _digits(c, "bigint"), "moq": lambda c: _digits(c, "bigint"),
        "unit_price": lambda c: _digits(c, "decimal(18,2)"), "mtbf_hours": lambda c: _digits(c, "bigint"),
        "po_date": _any_date, "wo_date": _any_date,
    }
    columns = [
        typed_as.get(name, lambda c: F.nullif(c, F.lit("")))(_value(name, spec)).alias(name) for name in spec.columns
    ]
    rows = rows.filter("n_parts = 1") if strict else rows
    return rows.select("record_id", F.col("part").alias("record_part"), *columns)
