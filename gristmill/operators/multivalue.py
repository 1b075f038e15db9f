"""Several values packed in one field: split by a parsing expression grammar.

Ordered alternatives, the first that matches wins::

    list   := sep* (value sep+)* value? sep*
    value  := quoted / bracketed / bare
    quoted := '"' ('""' / not '"')* '"' &(sep / end)
    bracketed := open (not close)* close &(sep / end)      only where brackets are given
    bare   := (not sep)+

A quote that is not closed, or is followed by more text, makes ``quoted`` fail; the reader backtracks
and takes the place as ``bare``, with the flag ``malformed_quote``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# What separates values. A slash counts between blanks; in lists of keys any slash, & and "and" do.
PRODUCT_SEPARATOR = r"[;,|\t\n\r]|(?<=[ \t\n\r])/(?=[ \t\n\r])"
KEY_SEPARATOR = r"[;,|\t\n\r/&]|(?<=[ \t\n\r])(?:and|AND|And)(?=[ \t\n\r])"
_BLANKS = re.compile(r"\s*")


@dataclass(frozen=True)
class ListGrammar:
    separator: str = PRODUCT_SEPARATOR
    brackets: tuple[tuple[str, str], ...] = ()

    def compiled(self) -> tuple[re.Pattern[str], list[re.Pattern[str]]]:
        sep = self.separator
        ends = rf"(?=\s*(?:{sep}|\Z))"
        alternatives = [re.compile(rf'"(?P<v>[^"]*(?:""[^"]*)*)"{ends}')]
        alternatives += [re.compile(rf"(?P<v>{re.escape(o)}[^{re.escape(c)}]*{re.escape(c)}){ends}") for o, c in self.brackets]
        return re.compile(sep), alternatives


def split_text(text: str, sep: re.Pattern[str], alternatives: list[re.Pattern[str]]) -> list[tuple[str, str]]:
    """(item, flag) of each value of ``text`` that is not blank; flag is '' or 'malformed_quote'."""
    out, at, n = [], 0, len(text)
    while at <= n:
        start = _BLANKS.match(text, at).end()
        item, flag = None, ""
        for k, alternative in enumerate(alternatives):
            if m := alternative.match(text, start):
                item, end = (m["v"].replace('""', '"') if k == 0 else m["v"]), m.end()
                break
        if item is None:
            flag = "malformed_quote" if text.startswith('"', start) else ""
            m = sep.search(text, start)
            end = m.start() if m else n
            item = text[start:end]
        item = item.strip()
        if item:
            out.append((item, flag))
        m = sep.search(text, end)
        if m is None:
            break
        at = m.end()
    return out


def split_values(df: DataFrame, field: str | Column, keep: list[Column | str], grammar: ListGrammar = ListGrammar()) -> DataFrame:
    """``keep`` columns beside ``pos, item, flag``: one row per value of ``field``, ``pos`` from 1.

    Null and blank fields give no row, empty places do not count. Items have no blanks around them
    and keep their spelling; a quoted item loses its outer quotes. Texts of any length are read whole.
    """
    sep, alternatives = grammar.compiled()

    @F.pandas_udf("array<struct<item:string,flag:string>>")
    def pieces(texts: pd.Series) -> pd.Series:
        return pd.Series([split_text(t, sep, alternatives) if t is not None else [] for t in texts], dtype=object)

    column = F.col(field) if isinstance(field, str) else field
    slim = df.filter(column.isNotNull()).select(*keep, pieces(column).alias("_pieces"))
    kept = [c for c in slim.columns if c != "_pieces"]
    # an outer explode keeps the pieces from being worked out twice, once more to filter what has none
    return slim.select(*kept, F.posexplode_outer("_pieces").alias("pos", "_piece")).filter("pos is not null").select(
        *kept, (F.col("pos") + 1).cast("bigint").alias("pos"), F.col("_piece.item").alias("item"), F.col("_piece.flag").alias("flag")
    )
