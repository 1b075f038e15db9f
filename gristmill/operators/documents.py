"""Operators over documents: chunks, classes, aliases in text, mentions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from gristmill.functions.text import CODE


def cut_chunks(text: str, size: int, overlap: int) -> list[str]:
    """Paragraphs packed up to ``size`` characters; a longer one is cut, its pieces overlapping. In document order."""
    out: list[str] = []
    held: list[str] = []
    used = 0
    for paragraph in (p.strip() for p in text.split("\n\n")):
        if not paragraph:
            continue
        if held and used + 2 + len(paragraph) > size:
            out.append("\n\n".join(held))
            held, used = [], 0
        if len(paragraph) > size:
            starts = range(0, max(1, len(paragraph) - overlap), size - overlap)
            out += [paragraph[k : k + size] for k in starts]
        else:
            used += len(paragraph) + (2 if held else 0)
            held.append(paragraph)
    return out + (["\n\n".join(held)] if held else [])


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 1200, overlap: int = 150) -> DataFrame:
    """``key, ordinal, chunk``; null and blank texts have no chunk. Texts of any length are cut whole."""
    key_type = docs.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, n, c) for k, t in zip(batch["key"], batch["text"]) if t for n, c in enumerate(cut_chunks(t, size, overlap), 1)]
            yield pd.DataFrame(rows, columns=["key", "ordinal", "chunk"])

    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return slim.mapInPandas(cut, f"key {key_type}, ordinal int, chunk string").withColumnRenamed("key", key)


def classify(c: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(class, matches): the class whose pattern matches most often; of equals the first; none: uncategorized."""
    lower = F.lower(c)
    counts = [F.regexp_count(lower, F.lit(pattern)) for _, pattern in rules]
    most = F.greatest(*counts) if len(counts) > 1 else counts[0]
    label = F.when(most.isNull() | (most == 0), "uncategorized")
    for (name, _), n in zip(rules, counts):
        label = label.when(n == most, name)
    return label, F.coalesce(most, F.lit(0))


def phrases_in(docs: DataFrame, phrases: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, alias, id``: which aliases stand in which texts, as whole words and regardless of case.

    ``phrases`` has ``alias, id``. Texts are taken apart into runs of words, which meet the aliases
    by equality; only runs that open with an alias's first word and have its length are made, so
    aliases of any length are looked for. Aliases without a word are not.
    """
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    named = phrases.select("id", "alias", words(F.col("alias")).alias("w")).filter(F.size("w") > 0)
    named = named.select("id", "alias", F.size("w").alias("n"), F.col("w")[0].alias("head"), F.array_join("w", " ").alias("run")).distinct()
    heads = named.select("head", "n").distinct()
    read = docs.select(F.col(key), words(F.col(text)).alias("w"))
    at = read.select(key, "w", F.posexplode("w").alias("at", "head")).join(heads, "head")
    runs = at.select(key, F.array_join(F.slice("w", F.col("at") + 1, F.col("n")), " ").alias("run")).distinct()
    return runs.join(named, "run").select(key, "alias", "id").distinct()


def mentions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, code, n``: identifiers in texts and how often."""
    found = docs.select(key, F.explode(F.regexp_extract_all(text, F.lit(CODE), F.lit(0))).alias("code"))
    return found.groupBy(key, "code").agg(F.count("*").alias("n"))


def removed(documents: DataFrame, units: DataFrame, edges: DataFrame, key: str = "doc_id", code: str = "doc_code") -> tuple[DataFrame, DataFrame]:
    """(``units``, ``edges``) without what hangs on the removed ``documents``: their units by ``key``, edges with either end at their ``code``."""
    gone = documents.select(F.col(code).alias("_gone")).filter("_gone is not null").distinct()
    left = units.join(documents.select(key).distinct(), key, "left_anti")
    for end in ("src", "dst"):
        edges = edges.join(gone, F.col(end) == F.col("_gone"), "left_anti")
    return left, edges


def longest_aliases(texts: DataFrame, phrases: DataFrame, key: str, text: str, least: int = 3) -> DataFrame:
    """``key, id, turn, rank``: what each text names: explicit identifiers first, then aliases of ``least`` letters or more, the longest first.

    Each id counts once for a text, by its best turn (1 identifier, 2 alias); of equally long aliases the first by name.
    """
    explicit = texts.select(key, F.posexplode(F.array_distinct(F.regexp_extract_all(text, F.lit(CODE), F.lit(0)))).alias("at", "id"))
    explicit = explicit.select(key, "id", F.struct(F.lit(1).alias("turn"), F.col("at").alias("place"), F.lit("").alias("alias")).alias("order"))
    named = phrases_in(texts, phrases.filter(F.length("alias") >= least), key, text)
    named = named.select(key, "id", F.struct(F.lit(2).alias("turn"), (-F.length("alias")).alias("place"), "alias").alias("order"))
    best = explicit.unionByName(named).groupBy(key, "id").agg(F.min("order").alias("order"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("order", "id"))
    return best.select(key, "id", F.col("order.turn").alias("turn"), rank.alias("rank"))
