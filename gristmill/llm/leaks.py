"""Evaluation texts leaking into training text: windows of test words looked up in a broadcast set.

Test items are few, and the size of what every task holds for them is checked before they are broadcast: the hash set of their
normalised word n-grams goes to every task, training texts are scanned window by window, hits are
verified word by word and joined into spans. Larger test sets take the other way: a bitmap of their n-grams, of fixed size,
goes to every task, and the few windows that it lets pass are joined to the n-grams word by word.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gristmill.llm.lookalikes import judge_token, mixed_tokens, plain, repair, shape_of
from gristmill.scratch import staged

WINDOW = 13
INDEX_BYTES = 64 << 20  # of memory that the index of all items may take in a task
BYTES_PER_WORD = 300  # of that for each word of the items: a window of word numbers, its entry and the words themselves
BITS = 1 << 27  # of the bitmap of n-grams: 16 MB

_WORD = re.compile(r"[^\W_]+")
SPANS = "array<struct<item_id:bigint,start:int,end:int>>"


def words_of(text: str) -> list[str]:
    """Runs of letters and digits, regardless of case."""
    return _WORD.findall(text.casefold())


def places_of(text: str) -> list[tuple[int, int]]:
    """Places in ``text`` of ``words_of(text)``, whose case folding may have other lengths."""
    return [m.span() for m in _WORD.finditer(text)]


def _placed(form: str, shape: str, n_words: int) -> tuple[str, list[tuple[int, int]]]:
    """The text to report and its words' places; its shape where words come out otherwise in the form."""
    at = places_of(form)
    return (form, at) if len(at) == n_words else (shape, places_of(shape))


class _Folded:
    """Words known whatever their case."""

    def __init__(self, words):
        self.words = words

    def __contains__(self, word: str) -> bool:
        return word.casefold() in self.words


class ItemIndex:
    """Hash set of the items' n-grams over word numbers; each n-gram knows the items that hold it."""

    def __init__(self, items: list[tuple[int, str]], n: int):
        self.n = n
        self.vocabulary: dict[str, int] = {}
        self.grams: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(shape_of(plain(text)))]
            for k in range(len(ids) - n + 1):
                self.grams.setdefault(tuple(ids[k : k + n]), set()).add(item)
        self.known = _Folded(self.vocabulary)

    def normal(self, text: str) -> str:
        """The normal form, with the items' words as vocabulary."""
        return repair(plain(text), self.known)

    def hits(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(item, first word, word after the last) of the runs of ``n`` or more words shared with items.

        Windows are looked up within runs of words that the items know at all; a window in the set
        equals an item's word by word, as it is compared by the numbers of its words.
        """
        n, known, grams = self.n, self.vocabulary.get, self.grams
        ids = [known(w, -1) for w in words]
        gaps = [k for k, i in enumerate(ids) if i < 0]
        spans: dict[int, list[list[int]]] = {}
        start = 0
        for stop in [*gaps, len(ids)]:
            for k in range(start, stop - n + 1):
                for item in grams.get(tuple(ids[k : k + n]), ()):
                    runs = spans.setdefault(item, [])
                    if runs and runs[-1][1] == k + n - 1:
                        runs[-1][1] = k + n
                    else:
                        runs.append([k, k + n])
            start = stop + 1
        return [(item, a, b) for item, runs in spans.items() for a, b in runs]


def find_leaks(docs: DataFrame, items: DataFrame, n: int = WINDOW, key: str = "doc_id", text: str = "text",
               index_bytes: int = INDEX_BYTES) -> DataFrame:
    """``key, normal_text, spans`` of the documents that share ``n`` or more consecutive words with an item.

    ``items`` has ``item_id, item_text``. Words are compared by their looks (see ``lookalikes``);
    ``spans`` are places in the normal form, by characters. Null texts and texts of fewer words share
    nothing; a repeated document is reported as often as it comes, a repeated item once. Texts are
    scanned whole, and only the named columns are read. Both ways, by the size of the items, give the same rows.
    """
    items = items.filter("item_text is not null").select(F.col("item_id").cast("bigint"), "item_text").distinct()
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("text is not null")
    words = F.regexp_count("item_text", F.lit(r"[\p{L}\p{N}]+"))
    size = items.select(F.coalesce(F.sum(words), F.lit(0)).alias("words")).first()["words"]
    found = _scan(slim, items, n) if size * BYTES_PER_WORD <= index_bytes else _join(slim, items, n)
    return found.withColumnRenamed("key", key)


def _scan(slim: DataFrame, items: DataFrame, n: int) -> DataFrame:
    shared = slim.sparkSession.sparkContext.broadcast([tuple(r) for r in items.collect()])
    key_type = slim.schema["key"].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = ItemIndex(shared.value, n)
        for batch in batches:
            rows = []
            for k, t in zip(batch["key"], batch["text"]):
                shape = shape_of(plain(t))
                words = words_of(shape)
                if hits := index.hits(words):
                    form, at = _placed(index.normal(t), shape, len(words))
                    rows.append((k, form, [(i, at[a][0], at[b - 1][1]) for i, a, b in hits]))
            yield pd.DataFrame(rows, columns=["key", "normal_text", "spans"])

    return slim.mapInPandas(scan, f"key {key_type}, normal_text string, spans {SPANS}")


def _windows(df: DataFrame, key: str, text: str, n: int, bits: np.ndarray | None = None) -> DataFrame:
    """``key, at, gram``: the windows of ``n`` words, where ``bits`` are given those whose bit is set."""
    key_type = df.schema[key].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(bits) if bits is not None else None

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t in zip(batch[key], batch[text]):
                words = words_of(shape_of(plain(t)))
                grams = [" ".join(words[j : j + n]) for j in range(len(words) - n + 1)]
                if shared is not None and grams:
                    places = np.fromiter((zlib.crc32(g.encode("utf-8", "replace")) for g in grams), dtype="int64", count=len(grams)) % BITS
                    passed = np.flatnonzero((shared.value[places >> 3] >> (places & 7)) & 1)
                    rows += [(k, int(j), grams[j]) for j in passed]
                else:
                    rows += [(k, j, g) for j, g in enumerate(grams)]
            yield pd.DataFrame(rows, columns=["key", "at", "gram"])

    return df.select(key, text).mapInPandas(cut, f"key {key_type}, at int, gram string")


def _bitmap(grams: DataFrame) -> np.ndarray:
    """A bit for each n-gram, by its checksum; of fixed size however many there are."""
    place = F.crc32(F.encode("gram", "UTF-8")) % BITS + 1
    parts = grams.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit")).groupBy("bucket").agg(
        F.bitmap_construct_agg("bit").alias("bits")
    )
    out = np.zeros(BITS // 8, dtype="uint8")
    for r in parts.toLocalIterator():
        part = np.frombuffer(r["bits"], dtype="uint8")
        out[(r["bucket"] - 1) * len(part) : r["bucket"] * len(part)] = part
    return out


def _known(texts: DataFrame, items: DataFrame) -> DataFrame:
    """``key, known``: the items' words among the repairs of a text's mixed tokens, as the vocabulary is too large to send."""
    key_type = texts.schema["key"].dataType.simpleString()

    def proposals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, judge_token(m)[2].casefold()) for k, t in zip(batch["key"], batch["text"]) for m in mixed_tokens(plain(t))]
            yield pd.DataFrame(rows, columns=["key", "word"])

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"word": sorted({w for t in batch["item_text"] for w in words_of(shape_of(plain(t)))})})

    asked = texts.select("key", "text").mapInPandas(proposals, f"key {key_type}, word string").distinct()
    return asked.join(items.select("item_text").mapInPandas(words, "word string").distinct(), "word", "left_semi").groupBy("key").agg(F.collect_set("word").alias("known"))


def _join(slim: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """For test sets too large to broadcast: the windows that the bitmap lets pass meet the items' n-grams by their words."""
    key_type = slim.schema["key"].dataType.simpleString()
    grams = staged(_windows(items, "item_id", "item_text", n).select(F.col("key").alias("item_id"), "gram").distinct(), "grams")
    hits = (
        _windows(slim, "key", "text", n, _bitmap(grams)).join(grams, "gram").groupBy("key", "item_id")
        .agg(F.collect_set("at").alias("at")).groupBy("key").agg(F.collect_list(F.struct("item_id", "at")).alias("hits"))
    )

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t, hits, known in zip(batch["key"], batch["text"], batch["hits"], batch["known"]):
                shape = shape_of(plain(t))
                form, at = _placed(repair(plain(t), _Folded(() if known is None else set(known))), shape, len(words_of(shape)))
                spans = []
                for hit in hits:
                    runs: list[list[int]] = []
                    for j in sorted(hit["at"]):
                        if runs and runs[-1][1] == j + n - 1:
                            runs[-1][1] = j + n
                        else:
                            runs.append([j, j + n])
                    spans += [(hit["item_id"], at[a][0], at[b - 1][1]) for a, b in runs]
                rows.append((k, form, spans))
            yield pd.DataFrame(rows, columns=["key", "normal_text", "spans"])

    leaked = staged(slim.join(hits, "key").select("key", "text", "hits"), "leaked")
    return leaked.join(_known(leaked, items), "key", "left").select("key", "text", "hits", "known").mapInPandas(merge, f"key {key_type}, normal_text string, spans {SPANS}")


def leaked_pairs(leaks: DataFrame, key: str = "doc_id") -> DataFrame:
    return leaks.select(key, F.explode(F.array_distinct(F.col("spans.item_id"))).alias("item_id")).distinct()


def without_spans(leaks: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, cleaned, n_removed``: normal texts with the leaked spans cut out (overlapping ones as one)."""
    starts = F.array_sort("spans", lambda a, b: F.coalesce(F.nullif(a["start"] - b["start"], F.lit(0)), b["end"] - a["end"]))
    piece = lambda acc, upto: F.concat(
        acc["kept"], F.substr(F.col("normal_text"), acc["at"] + 1, F.greatest(upto - acc["at"], F.lit(0)))
    )
    start = F.struct(F.lit("").alias("kept"), F.lit(0).alias("at"))
    cut = F.aggregate(starts, start, lambda acc, s: F.struct(piece(acc, s["start"]).alias("kept"), F.greatest(acc["at"], s["end"]).alias("at")),
                      lambda acc: F.concat(acc["kept"], F.substr(F.col("normal_text"), acc["at"] + 1)))
    return leaks.select(key, cut.alias("cleaned"), F.size("spans").alias("n_removed"))
