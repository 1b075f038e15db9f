"""Visually identical text with different characters: one normal form for all text.

Character level: full-width forms, ligatures, doubled signs, kinds of hyphen and of blank become
their plain selves, invisible characters go, accents are composed. Superscripts, case and accents
stay, as they can be seen.

Token level, script-aware: letters of several scripts share a shape. The dominant script of a
token is that of its letters which no other script shares; a token of mixed script has its
look-alikes replaced by that script's letters, if the result is a word of the corpus (written
somewhere in one script). A token of shared shapes only takes the script of the text before it.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from gristmill.scratch import staged

# Letters of Cyrillic and Greek that have the shape of the Latin letter beside them.
CYRILLIC = dict(zip("аеорсхуіѕјһԁԛԝүАВЕЅІЈКМНОРСТХУҮԌԜԚ", "aeopcxyisjhdqwyABESIJKMHOPCTXYYGWQ"))
GREEK = dict(zip("ονΑΒΕΖΗΙΚΜΝΟΡΤΥΧϲϳ", "ovABEZHIKMNOPTYXcj"))

_TOKEN = regex.compile(r"[\p{L}\p{M}]+")
NEUTRAL = "μΩ"  # signs of units, at home in any script
_SUSPECT = regex.compile(r"[\p{Cyrillic}\p{Greek}--[μΩ\N{OHM SIGN}]]", regex.V1)
#: The same for Java, to tell in the JVM which texts need a second look.
SUSPECT_TEXT = r"[\p{IsCyrillic}\p{IsGreek}&&[^μΩ\u2126]]"


@lru_cache(maxsize=1)
def plain_characters() -> dict[int, str | None]:
    """Code points whose look is that of another text, by rule from the character database."""
    table: dict[int, str | None] = {}
    for cp in [*range(0x80, 0x3400), *range(0xA000, 0xD800), *range(0xE000, 0x20000)]:
        c = chr(cp)
        kind = unicodedata.category(c)
        shape = unicodedata.decomposition(c)
        if kind == "Zs":
            table[cp] = " "
        elif kind == "Cf" or 0xFE00 <= cp <= 0xFE0F:
            table[cp] = None
        elif shape.startswith(("<wide>", "<narrow>", "<noBreak>")) or " LIGATURE " in unicodedata.name(c, "") and shape.startswith("<compat>"):
            table[cp] = unicodedata.normalize("NFKC", c)
    table |= {0xB5: "μ", 0x2010: "-", 0x2011: "-", 0xFE63: "-", 0x180E: None}  # micro sign and kinds of hyphen
    return table


@lru_cache(maxsize=1)
def _special() -> re.Pattern[str]:
    return re.compile("[" + "".join(map(re.escape, map(chr, plain_characters()))) + "]")


def plain(text: str) -> str:
    """The character-level form."""
    if text.isascii():
        return text
    table = plain_characters()
    return unicodedata.normalize("NFC", _special().sub(lambda m: table[ord(m[0])] or "", text))


@lru_cache(maxsize=1)
def _scripts() -> tuple[dict[str, dict[str, str]], frozenset[str]]:
    """To each script its letters by the Latin letter of the same shape, and all shared letters."""
    to = {"Cyrillic": {}, "Greek": {}, "Latin": {}}
    for name, pairs in (("Cyrillic", CYRILLIC), ("Greek", GREEK)):
        for own, latin in pairs.items():
            to[name].setdefault(latin, own)
    shared = frozenset(CYRILLIC) | frozenset(GREEK) | frozenset(CYRILLIC.values()) | frozenset(GREEK.values())
    return to, shared


@lru_cache(maxsize=65536)
def _script(letter: str) -> str:
    return unicodedata.name(letter, "").split(" ")[0].capitalize()


_LOOK_ALIKE = re.compile("[" + "".join([*CYRILLIC, *GREEK]) + "]")
_LATIN = CYRILLIC | GREEK


def shape_of(text: str) -> str:
    """Every look-alike as its Latin letter; accents stay where they are."""
    if text.isascii() or not _SUSPECT.search(text):
        return text
    parts = unicodedata.normalize("NFD", text)
    return unicodedata.normalize("NFC", _LOOK_ALIKE.sub(lambda m: _LATIN[m[0]], parts))


@lru_cache(maxsize=200_000)
def in_script(token: str, script: str) -> str:
    """The token with each look-alike that ``script`` has written in that script."""
    to = _scripts()[0].get(script, {})
    parts = unicodedata.normalize("NFD", token)
    letters = (CYRILLIC.get(c) or GREEK.get(c) or c for c in parts)
    return unicodedata.normalize("NFC", "".join(to.get(c, c) for c in letters))


@lru_cache(maxsize=200_000)
def judge_token(token: str) -> tuple[str, str, str]:
    """(kind, script, proposal): 'pure' in one script, 'mixed' with a repair, 'torn' between scripts, 'open' to any.

    The script is that of the letters whose shape no other script shares; a token that looks the
    same has the same script, proposal and (but for pure and mixed) kind.
    """
    shared = _scripts()[1]
    letters = [c for c in unicodedata.normalize("NFD", token) if c.isalpha() and c not in NEUTRAL]
    own = {_script(c) for c in letters if c not in shared}
    if not own:
        return "open", "", ""
    if len(own) > 1:
        return "torn", "", shape_of(token)
    (script,) = own
    if all(_script(c) == script for c in letters):
        return "pure", script, token
    return "mixed", script, in_script(token, script)


def mixed_tokens(text: str) -> set[str]:
    return {t for t in _TOKEN.findall(text) if not t.isascii() and judge_token(t)[0] == "mixed"}


_IN_CODE = re.compile(r"-?[0-9]")


def repair(text: str, words, keep_torn: bool = True) -> str:
    """The token-level form of a ``plain`` text, ``words`` holding the repairs that the corpus knows.

    With ``keep_torn`` a mixed token that cannot be repaired stays as it is typed; without, it is
    written by its shape, which makes texts that look the same equal. A token of shared shapes
    only is Latin where it opens a code (``MCH-3``), else in the script of the token before it.
    """
    if text.isascii() or not _SUSPECT.search(text):
        return text
    found = list(_TOKEN.finditer(text))
    judged = [judge_token(m[0]) for m in found]
    script = next((j[1] for j in judged if j[1]), "Latin")
    out, at = [], 0
    for m, (kind, own, proposal) in zip(found, judged):
        token, script = m[0], own or script
        if kind == "open":
            token = in_script(token, "Latin" if _IN_CODE.match(text, m.end()) else script)
        elif kind == "mixed" and proposal in words:
            token = proposal
        elif kind in ("mixed", "torn") and not keep_torn:
            token = shape_of(token)
        out += [text[at : m.start()], token]
        at = m.end()
    return "".join(out) + text[at:]


def known_repairs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``token, repaired``: the mixed-script tokens of a corpus whose repair is one of its words.

    Words and proposals are gathered as sets within each batch of texts before they are shuffled.
    """

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words: set[str] = set()
            for t in batch["text"]:
                if t:
                    words.update(_TOKEN.findall(plain(t)))
            rows = []
            for w in words:
                kind, _, proposal = ("pure", "Latin", w) if w.isascii() else judge_token(w)
                if kind == "pure":
                    rows.append((w, None))
                elif kind == "mixed":
                    rows.append((proposal, w))
            yield pd.DataFrame(rows, columns=["word", "token"])

    seen = docs.select(F.col(text).alias("text")).mapInPandas(gather, "word string, token string")
    by_word = seen.groupBy("word").agg(F.max(F.col("token").isNull()).alias("known"), F.collect_set("token").alias("tokens"))
    return by_word.filter("known and size(tokens) > 0").select(F.explode("tokens").alias("token"), F.col("word").alias("repaired"))


BROADCAST_REPAIRS = 500_000  # distinct repaired words that may be broadcast; about 20 MB


def unify(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = True,
          broadcast_repairs: int = BROADCAST_REPAIRS) -> DataFrame:
    """``key, normal_text, look, stored`` for every row of ``docs``.

    ``normal_text`` is the repaired text (left out without ``with_text``), ``look`` a 128-bit digest
    of its appearance: equal for texts that look the same throughout, also where no word of the
    corpus decides a token. ``stored`` is a hash of the text as it came. Null texts stay null;
    empty ones stay empty. Rows are kept as often as they come, and only the two named columns are
    read. The accepted repairs are broadcast up to ``broadcast_repairs``; beyond that they are
    joined to the mixed tokens of the texts that have any.
    """
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("stored"))
    key_type = slim.schema["key"].dataType.simpleString()
    repairs = staged(known_repairs(slim), "repairs")
    def out(batch: pd.DataFrame, normal: list[str | None], seen: list[str | None]) -> pd.DataFrame:
        rows = {"key": batch["key"], "stored": batch["stored"], "look": [_digest(t) for t in seen]}
        return pd.DataFrame(rows | ({"normal_text": normal} if with_text else {}))

    def tokens_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "token": [list(mixed_tokens(plain(t))) for t in batch["text"]]})

    def repaired(batches: Iterator[pd.DataFrame], shared=None) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [None if t is None else plain(t) for t in batch["text"]]
            words = repeat(shared.value) if shared else [() if w is None else set(w) for w in batch["words"]]
            pairs = list(zip(texts, words))
            normal = [None if t is None else repair(t, w) for t, w in pairs] if with_text else []
            yield out(batch, normal, [None if t is None else repair(t, w, keep_torn=False) for t, w in pairs])

    schema = f"key {key_type}, stored bigint, look string" + ", normal_text string" * with_text
    words = repairs.select("repaired").distinct()
    if words.count() <= broadcast_repairs:
        shared = docs.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in words.collect()))
        return slim.mapInPandas(lambda batches: repaired(batches, shared), schema).withColumnRenamed("key", key)
    suspect = F.coalesce(F.col("text").rlike(SUSPECT_TEXT), F.lit(False))
    words_of = (
        slim.filter(suspect).mapInPandas(tokens_of, f"key {key_type}, token array<string>").select("key", F.explode("token").alias("token"))
        .join(repairs, "token").groupBy("key").agg(F.collect_set("repaired").alias("words"))
    )
    joined = slim.filter(suspect).join(words_of, "key", "left").select("key", "stored", "text", "words")
    rest = slim.filter(~suspect).withColumn("words", F.lit(None).cast("array<string>"))
    return joined.unionByName(rest).mapInPandas(repaired, schema).withColumnRenamed("key", key)


def _digest(text: str | None) -> str | None:
    return None if text is None else hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=16).hexdigest()


def look_alike_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key_a, key_b``: pairs of rows whose stored texts differ but look the same throughout.

    Rows meet by ``look``; exact copies are one kind of stored text, and only kinds that differ are
    paired, so copies alone cost nothing. Rows without a text or key have no pair.
    """
    rows = staged(unify(docs, key, text, with_text=False).filter(f"look is not null and {key} is not null").distinct(), "looks")
    # pairs of different stored texts of one look first, then their rows: every pair of rows made is one of the result
    kinds = rows.select("look", "stored").distinct()
    a, b = kinds.alias("a"), kinds.alias("b")
    differ = a.join(b, (F.col("a.look") == F.col("b.look")) & (F.col("a.stored") < F.col("b.stored"))).select(
        F.col("a.look").alias("look"), F.col("a.stored").alias("stored"), F.col("b.stored").alias("other")
    )
    one = rows.withColumnRenamed(key, "_one").join(differ, ["look", "stored"]).select("look", "_one", F.col("other").alias("stored"))
    both = one.join(rows.withColumnRenamed(key, "_two"), ["look", "stored"])
    return both.filter("_one <> _two").select(F.least("_one", "_two").alias(f"{key}_a"), F.greatest("_one", "_two").alias(f"{key}_b")).distinct()


def look_alike_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, class_id, n_kinds, n_documents``: each row whose look is that of a different stored text, with the smallest key of its class.

    Equal rows count once; rows without a text or key are in no class. Copies alone make no class.
    """
    rows = staged(unify(docs, key, text, with_text=False).filter(f"look is not null and {key} is not null").distinct(), "looks")
    per_kind = rows.groupBy("look", "stored").agg(F.min(key).alias("first"), F.count("*").alias("n"))
    classes = per_kind.groupBy("look").agg(F.min("first").alias("class_id"), F.count("*").alias("n_kinds"), F.sum("n").alias("n_documents")).filter("n_kinds > 1")
    return rows.join(classes, "look").select(key, "class_id", "n_kinds", "n_documents")
