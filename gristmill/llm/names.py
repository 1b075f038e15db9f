"""Variant spellings of organisations' names: a trie join over the names' words.

What many firms share is learned from the known names: their trades (word sequences that end the
names of many firms) and leading words (given names, regions). A name is read into its trade, its
legal form, a leading word and the words that are its own. Known own words are put into tries,
sharded by pieces of the word of which bounded edits leave one untouched; Levenshtein automata walk
each trie with the spelled words, and another trie holds the shared words. A spelling means a known
name if its own words find partners in any order, none left over but a leading word, and the trades
agree.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gristmill.scratch import staged

# Legal forms by their spelling without dots, and words that name nobody.
LEGAL = {
    "bv": "bv", "llc": "llc", "corp": "corp", "corporation": "corp", "co": "co", "company": "co", "inc": "inc",
    "incorporated": "inc", "oy": "oy", "oyj": "oy", "sa": "sa", "srl": "srl", "ltd": "ltd", "limited": "ltd", "plc": "plc",
    "ab": "ab", "gmbh": "gmbh", "ag": "ag", "spa": "spa", "nv": "nv", "kg": "kg", "sas": "sas", "sl": "sl", "as": "as", "aps": "aps",
}
FILLERS = {"div", "division", "the", "group"}

TRADE_SHARE, TRADE_LEAST = 200, 3  # a trade ends the names of one firm in so many, and of so many firms at least
LEAD_SHARE, LEAD_LEAST = 1000, 2  # the same for leading words
TRADE_WORDS = 3
MAX_SHARED = 100_000
LONG = 8  # known words of this length may carry two edits, shorter ones one

_LETTERS = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe"})
_UMLAUTS = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue"})
_DOTTED = re.compile(r"\b((?:[a-z]\. ?){2,})(?!\w)")
_SPACED = re.compile(r"(?<!\w)[a-z](?: [a-z]){1,3}(?!\w)")
_HYPHEN = re.compile(r"(?<=\w)[-'’‐‑]+(?=\w)")
_WORD = re.compile(r"[^\W_]+|[&+]")


def fold(text: str) -> str:
    text = unicodedata.normalize("NFKD", text.casefold().translate(_LETTERS))
    return "".join(c for c in text if not unicodedata.combining(c))


def _made_of(short: str, word: str) -> bool:
    letters = iter(word)
    return all(c in letters for c in short)


def bound(length: int) -> int:
    """Edits that a word of this length may carry."""
    return 0 if length < 4 else 1 if length < LONG else 2


END = ""  # marks the end of a word in a trie


def build_trie(words: list[str]) -> dict:
    root: dict = {}
    for word in words:
        node = root
        for c in word:
            node = node.setdefault(c, {})
        node[END] = word
    return root


def walk(node: dict, word: str, edits: int) -> dict[str, int]:
    """Words of the trie within ``edits`` insertions, deletions, substitutions or swaps, with their number."""
    found: dict[str, int] = {}

    def step(node: dict, at: int, left: int) -> None:
        while True:
            rest = len(word) - at
            if END in node and rest <= left:
                used = edits - left + rest
                found[node[END]] = min(used, found.get(node[END], used))
            if left:
                for c, child in node.items():
                    if c == END:
                        continue
                    step(child, at, left - 1)  # a letter too few
                    if rest and c != word[at]:
                        step(child, at + 1, left - 1)  # another letter
                if rest:
                    step(node, at + 1, left - 1)  # a letter too many
                if rest > 1 and word[at] != word[at + 1] and (swapped := node.get(word[at + 1], {}).get(word[at])) is not None:
                    step(swapped, at + 2, left - 1)
            if not rest or (child := node.get(word[at])) is None:
                return
            node, at = child, at + 1

    step(node, 0, edits)
    return found




@dataclass
class Shared:
    """What many firms share: trades, each a sequence of words, and leading words."""

    trades: list[str]
    leads: frozenset[str]
    trie: dict = field(init=False)
    by_word: dict[str, list[str]] = field(init=False)
    cache: dict[str, dict[str, int]] = field(init=False, default_factory=dict)

    def __post_init__(self):
        self.by_word = {}
        for trade in self.trades:
            for word in trade.split():
                self.by_word.setdefault(word, []).append(trade)
        self.trie = build_trie(list(self.by_word))

    def trades_of(self, token: str) -> dict[str, int]:
        """Trades of which a word may stand for a part, with how far off it is.

        0 the word itself, 1 a beginning of three letters or more (but for an ending) or a slip, 2 some of its letters in order.
        """
        if (known := self.cache.get(token)) is not None:
            return known
        far: dict[str, int] = {token: 0} if token in self.by_word else {}
        if not far and len(token) >= 3:
            root = re.sub("e?s?$", "", token)
            for word in self.by_word:
                if word[0] == token[0] and len(token) < len(word):
                    if word.startswith(token) or len(root) >= 3 and word.startswith(root):
                        far[word] = 1
                    elif _made_of(token, word):
                        far[word] = 2
            for word, edits in walk(self.trie, token, bound(len(token))).items() if len(token) > 4 else ():
                if edits <= bound(len(word)):
                    far[word] = 1
        out: dict[str, int] = {}
        for word, off in far.items():
            for trade in self.by_word[word]:
                out[trade] = min(off, out.get(trade, off))
        if len(self.cache) > 200_000:
            self.cache.clear()
        self.cache[token] = out
        return out


def split_name(text: str) -> tuple[list[tuple[str, str]], str | None, str | None]:
    """(words, each with its transcribed form, initial, legal form) of a name; joining signs stay as ``&``.

    A hyphen within a word does not count, a letter with a dot is an initial.
    """
    text = _HYPHEN.sub("", unicodedata.normalize("NFC", text.casefold()))
    text = _DOTTED.sub(lambda m: re.sub(r"[. ]", "", m[0]) + " ", text)
    text = _SPACED.sub(lambda m: short if (short := m[0].replace(" ", "")) in LEGAL else m[0], text)
    words: list[tuple[str, str]] = []
    initial, legal = None, None
    for word in _WORD.findall(text):
        plain = fold(word)
        if plain not in LEGAL and plain[1:] in LEGAL and len(plain) <= 4 and plain[0] != plain[1]:
            initial, plain = initial or plain[0], plain[1:]  # an initial run together with a dotted legal form
        if plain in LEGAL:
            legal = LEGAL[plain]
        elif plain in FILLERS:
            continue
        elif plain in ("&", "+", "and"):
            words.append(("&", "&"))
        elif len(plain) == 1:
            initial = initial or plain
        else:
            words.append((plain, fold(word.translate(_UMLAUTS))))
    return words, initial, legal


def read_name(text: str, shared: Shared) -> tuple[list[list[str]], str | None, str | None, str | None]:
    """(own words, each with its transcribed form, trade, leading word, legal form) of a name."""
    words, leading, legal = split_name(text)
    own: list[list[str]] = []
    named: list[tuple[str, dict[str, int]]] = []
    spoken = [w for w in words if w[0] != "&"]
    at = 0
    while at < len(spoken):
        plain, umlaut = spoken[at]
        trades = shared.trades_of(plain)
        if at + 1 < len(spoken) and 0 not in trades.values():
            # one word typed as two
            both = shared.trades_of(plain + spoken[at + 1][0])
            if both and not shared.trades_of(spoken[at + 1][0]) or 0 in both.values():
                named.append((plain + spoken[at + 1][0], both))
                at += 2
                continue
        if trades:
            named.append((plain, trades))
        else:
            own.append(sorted({plain, umlaut}))
        at += 1
    trade = None
    if named:
        best: dict[str, tuple[int, int]] = {}
        for _, trades in named:
            for t, off in trades.items():
                n, total = best.get(t, (0, 0))
                best[t] = (n + 1, total + off)
        trade = min(best, key=lambda t: (-best[t][0], best[t][1], len(t), t))
        own += [[plain] for plain, trades in named if trade not in trades]
    if len(own) > 1 and leading is None and (k := next((k for k, forms in enumerate(own) if forms[0] in shared.leads), None)) is not None:
        leading = own.pop(k)[0]
    return own, trade, leading, legal


def shared_words(master: DataFrame) -> Shared:
    """The trades and leading words of the known names (``id, name``), by the number of ids that have them.

    A trade is a sequence of up to ``TRADE_WORDS`` words at the end of the names of one id in ``TRADE_SHARE`` (three at
    least); a sequence that is nearly always part of a longer one is left out. A leading word opens the names of one
    id in ``LEAD_SHARE`` (two at least) before another word that is no trade, and no sign joins it to that word. By
    these shares there are some thousands of either at most, however many firms there are; the number is checked.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, [w for w, _ in split_name(n)[0]]) for i, n in zip(batch["id"], batch["name"])]
            yield pd.DataFrame(rows, columns=["id", "words"])

    read_names = staged(master.mapInPandas(read, "id string, words array<string>").distinct(), "names")
    n = read_names.agg(F.countDistinct("id")).first()[0]

    def counted(phrases: DataFrame, least: float) -> list[tuple[str, int]]:
        rows = phrases.groupBy("phrase").agg(F.countDistinct("id").alias("n")).filter(F.col("n") >= least).limit(MAX_SHARED + 1).collect()
        if len(rows) > MAX_SHARED:
            raise ValueError("too many words are shared by many firms")
        return sorted((r["phrase"], r["n"]) for r in rows)

    spoken = F.filter("words", lambda w: w != "&")
    ends = read_names.select("id", spoken.alias("w")).filter(F.size("w") > 1).select(
        "id", "w", F.explode(F.sequence(F.lit(1), F.least(F.lit(TRADE_WORDS), F.size("w") - 1))).alias("k"))
    tails = counted(ends.select("id", F.array_join(F.slice("w", -F.col("k"), F.col("k")), " ").alias("phrase")), max(TRADE_LEAST, n / TRADE_SHARE))
    trades = [t for t, n_t in tails if not any(u.endswith(" " + t) and n_u >= 0.8 * n_t for u, n_u in tails)]
    final = {t.split()[0] for t in trades}
    opened = read_names.filter((F.size("words") > 2) & (F.col("words")[1] != "&") & ~F.col("words")[1].isin(sorted(final) or [""]))
    leads = counted(opened.select("id", F.col("words")[0].alias("phrase")), max(LEAD_LEAST, n / LEAD_SHARE))
    return Shared(trades, frozenset(w for w, _ in leads) - set(trades))


PIECES = 3


def _pieces(length: int) -> list[tuple[int, int]]:
    """(start, size) of the pieces of a word of this length."""
    cuts = [length * k // PIECES for k in range(PIECES + 1)]
    return list(zip(cuts, [b - a for a, b in zip(cuts, cuts[1:])]))


def shards_held(word: str) -> list[str]:
    """Where a known word is put: once for each of its pieces, with its length and the piece's place."""
    return [f"{len(word)}.{k}.{word[a : a + size]}" for k, (a, size) in enumerate(_pieces(len(word)))]


def shards_asked(word: str) -> set[str]:
    """Where a spelled word is looked up, for all lengths within the bound.

    One edit of any kind leaves one of three pieces untouched, as a swap touches two at most, and so do two
    insertions, deletions or substitutions; an untouched piece is moved by no more places than letters came in or went.
    """
    out = set()
    for length in range(max(1, len(word) - 2), len(word) + 3):
        more, edits = len(word) - length, bound(length)
        if abs(more) > edits:
            continue
        spare = edits - abs(more)
        lo, hi = min(0, more) - spare // 2, max(0, more) + spare // 2
        for k, (a, size) in enumerate(_pieces(length)):
            out.update(f"{length}.{k}.{word[a + s : a + s + size]}" for s in range(lo, hi + 1) if a + s >= 0 and a + s + size <= len(word))
    return out


def _spread_once(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column in a fixed number of tasks: the work per row counts, not the bytes by which small tasks are merged."""
    return df.select(column).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), column).distinct()


SHARD_ROWS = 20_000  # spelled words of a shard that one task walks


def near_words(spelled: DataFrame, known: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``word, known, edits``: the known words within ``bound`` of each spelled word.

    Both have the column ``word``. The spelled words of a large shard are cut into blocks of some ``shard_rows``, each of
    which holds the shard's trie. Words of up to three letters must be as they are known.
    """

    def put(of) -> callable:
        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame([(w, s) for w in batch["word"] for s in of(w)], columns=["word", "shard"])

        return rows

    asked = _spread_once(spelled, "word").mapInPandas(put(shards_asked), "word string, shard string")
    held = _spread_once(known, "word").mapInPandas(put(shards_held), "word string, shard string")
    blocks = asked.groupBy("shard").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("blocks"))
    held = held.join(blocks, "shard").select("word", "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("held"))
    large = blocks.filter("blocks > 1")
    asked = asked.join(large, "shard", "left").select(
        "word", "shard", F.pmod(F.xxhash64("word"), F.coalesce("blocks", F.lit(1))).cast("int").alias("block"), F.lit(False).alias("held"))

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, words, trie = None, [], None
        for batch in batches:
            rows = []
            for word, shard, block, is_held in zip(batch["word"], batch["shard"], batch["block"], batch["held"]):
                if at != (shard, block):
                    at, words, trie = (shard, block), [], None
                if is_held:
                    words.append(word)
                elif words:
                    trie = trie or build_trie(words)
                    edits = bound(int(shard.split(".", 1)[0]))
                    rows += [(word, k, n) for k, n in walk(trie, word, edits).items()]
            yield pd.DataFrame(rows, columns=["word", "known", "edits"])

    n = int(spelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = held.unionByName(asked).repartition(n, "shard", "block").sortWithinPartitions("shard", "block", F.desc("held"))
    return both.mapInPandas(join, "word string, known string, edits int").distinct()


def parsed_names(names: DataFrame, shared: Shared) -> DataFrame:
    """``name, n_own, own, trade, leading, legal`` of each distinct name that has own words."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(name, *read_name(name, shared)) for name in batch["name"]]
            yield pd.DataFrame([(n, len(own), own, t, lead, legal) for n, own, t, lead, legal in rows if own],
                               columns=["name", "n_own", "own", "trade", "leading", "legal"])

    parsed = "name string, n_own int, own array<array<string>>, trade string, leading string, legal string"
    return _spread_once(names, "name").mapInPandas(read, parsed)


def _words(parsed: DataFrame) -> DataFrame:
    return parsed.select("name", F.posexplode("own").alias("place", "forms")).select("name", "place", F.explode("forms").alias("word"))


def _short_for(a: Column, b: Column) -> Column:
    """Whether ``a`` is made of the first and some other letters of ``b`` in their order."""
    return (F.length(a) < F.length(b)) & F.rlike(b, F.concat(F.lit("^"), F.regexp_replace(a, "(.)", "$1.*")))


def _agree(a: Column, b: Column) -> Column:
    """Leading words agree if equal, if one is missing, or if one is short for the other."""
    return F.coalesce((a == b) | _short_for(a, b) | _short_for(b, a), F.lit(True))


PROFILE = ("words", "trade", "leading", "legal")


def profiles(parsed: DataFrame) -> DataFrame:
    """``parsed`` beside ``words``: its own words without order, the key under which names meet."""
    return parsed.withColumn("words", F.array_join(F.array_sort(F.transform("own", lambda forms: forms[0])), " "))


def match_profiles(spelled: DataFrame, known: DataFrame) -> DataFrame:
    """``name, words, trade, leading, legal, edits, odds, lacks, own_profile``: what each spelling may stand for.

    Both are ``profiles``. Names meet word by word: a spelling stands for known own words if each of them
    has a near word at a place of its own, and no place is left over but one that takes the part of a leading word, or is
    short for the one word that has none. ``odds``
    counts disagreements of legal form and leading word, ``lacks`` those that the known name does not state. A spelling without a trade may stand for any.
    """
    forms = known.select(F.explode("own").alias("f")).select(F.explode("f").alias("form"), F.col("f")[0].alias("known")).distinct()
    s_words = _words(spelled)
    near = near_words(s_words, forms.select(F.col("form").alias("word"))).withColumnRenamed("known", "form").join(forms, "form")
    placed = s_words.join(near.groupBy("word", "known").agg(F.min("edits").alias("edits")), "word")
    index = known.select("words", F.col("n_own").alias("n_known"), F.explode("own").alias("f")).select("words", "n_known", F.col("f")[0].alias("known")).distinct()
    met = placed.join(index, "known").groupBy("name", "words", "n_known").agg(F.collect_set(F.struct("known", "edits", "place")).alias("pairs"))
    of_word = lambda w: F.array_min(F.transform(F.filter("pairs", lambda p: p["known"] == w), lambda p: p["edits"]))
    met = met.withColumn("held", F.array_distinct("pairs.known")).withColumn("places", F.array_distinct("pairs.place")).filter(
        (F.size("places") == F.size("held")) & (F.size("held") >= F.col("n_known") - 1))
    met = met.select("name", "words", "n_known", "places", "held", F.aggregate("held", F.lit(0), lambda sum, w: sum + of_word(w)).alias("edits"))
    own = spelled.select("name", "n_own", "own", F.col("words").alias("s_words"), *[F.col(c).alias(f"s_{c}") for c in PROFILE[1:]])
    met = met.join(own, "name").filter((F.col("n_own") == F.col("n_known")) | (F.col("n_own") == F.col("n_known") + 1) & F.col("s_leading").isNull())
    left = F.array_except(F.sequence(F.lit(0), F.col("n_own") - 1), F.col("places"))
    met = met.withColumn("left", F.when(F.col("n_own") > F.size("held"), F.element_at(F.col("own"), left[0] + 1)[0]))
    # a word that lacks: what is left over may be short for it
    lacking = F.array_except(F.split("words", " "), "held")[0]
    short = (F.col("n_own") == F.col("n_known")) & (F.length("left") >= 3) & _short_for(F.col("left"), lacking)
    met = met.filter((F.size("held") == F.col("n_known")) | short)
    met = met.withColumn("edits", F.col("edits") + (F.size("held") < F.col("n_known")).cast("int")).withColumn(
        "left", F.when(F.col("n_own") > F.col("n_known"), F.col("left")))
    known = known.select(*PROFILE).distinct()
    met = met.join(known, "words").filter(F.col("s_trade").isNull() | F.col("s_trade").eqNullSafe(F.col("trade")))
    met = met.filter(F.col("left").isNull() | F.col("leading").isNotNull())
    odd_legal = F.coalesce(F.col("s_legal") != F.col("legal"), F.lit(False)).cast("int")
    odds = odd_legal + (~_agree(F.coalesce("s_leading", "left"), F.col("leading"))).cast("int")
    same = (F.col("s_words") == F.col("words")) & F.col("s_trade").eqNullSafe(F.col("trade"))
    same = same & F.col("s_leading").eqNullSafe(F.col("leading")) & F.col("s_legal").eqNullSafe(F.col("legal"))
    lacks = (F.coalesce("s_leading", "left").isNotNull() & F.col("leading").isNull()).cast("int") + (F.col("s_legal").isNotNull() & F.col("legal").isNull()).cast("int")
    return met.select("name", *PROFILE, "edits", odds.alias("odds"), lacks.alias("lacks"), same.alias("own_profile"))


def organisations(ids: DataFrame, links: DataFrame) -> DataFrame:
    """``id, org``: the smallest id of each id's component; ``links`` has ``a, b`` both ways.

    In every round each id takes the smallest label of its neighbours and then that label's own label, so
    labels run through a chain in a number of rounds that grows with the logarithm of its length. Rounds are written out,
    and only whether something changed comes to the driver.
    """
    labels = staged(ids.select("id", F.col("id").alias("org")).distinct(), "orgs")
    while True:
        offered = links.join(labels, links.a == labels.id).groupBy("b").agg(F.min("org").alias("offer"))
        nearer = labels.join(offered, labels.id == offered.b, "left").select("id", "org", F.least("org", F.coalesce("offer", "org")).alias("next"))
        jump = nearer.select(F.col("id").alias("next"), F.col("next").alias("far"))
        after = staged(nearer.join(jump, "next", "left").select(
            "id", F.least("next", F.coalesce("far", "next")).alias("org"), (F.least("next", F.coalesce("far", "next")) < F.col("org")).alias("moved")), "orgs")
        labels = after.select("id", "org")
        if after.filter("moved").isEmpty():
            return labels


def _kin(matches: DataFrame, known: DataFrame, hub: DataFrame) -> DataFrame:
    """``a, b``: ids whose names mean one organisation.

    Names mean the same if they differ by one edit at most and agree in trade, legal form and leading word. A name that
    lacks one of these joins nothing unless all complete names that it agrees with agree with each other: it never makes one
    of two that differ.
    """
    close = matches.filter("odds = 0 and edits <= 1").join(
        known.select("name", *[F.col(c).alias(f"own_{c}") for c in PROFILE[1:]]).distinct(), "name")
    # an incomplete name looks for complete ones, not the other way round
    for c in PROFILE[1:]:
        close = close.filter(F.col(c).isNotNull() | F.col(f"own_{c}").isNull())
    sure = None
    per_name = close.groupBy("name").agg(*[F.countDistinct(F.when(F.length(c) > 1, F.col(c))).alias(f"n_{c}") for c in PROFILE[1:]])
    for c in PROFILE[1:]:
        one = F.col(f"own_{c}").isNotNull() | (F.col(f"n_{c}") <= 1)
        sure = one if sure is None else sure & one
    close = close.join(per_name, "name").filter(sure).filter("own_trade is not null or trade is not null")
    same = [F.col(f"k.{c}").eqNullSafe(F.col(f"h.{c}")) for c in PROFILE]
    met = close.alias("k").join(hub.alias("h"), same).select("k.name", F.col("h.hub").alias("b"))
    return known.select("name", "id").join(met, "name").select(F.col("id").alias("a"), "b")


def link_names(spellings: DataFrame, master: DataFrame) -> DataFrame:
    """``spelling, supplier_id``: what each spelling means, by the smallest id of its organisation.

    ``spellings`` has ``spelling``, ``master`` has ``supplier_id, supplier_name``; all names of the
    master count as spellings too. Ids are one organisation if they share a complete name, or if names of
    theirs differ by one edit at most and agree in trade, legal form and leading word (see ``_kin``). Blanks around names
    do not count; null and blank ones give no row. A known name means its own; any
    other spelling that may mean several organisations equally well means none. Repeated rows count once.
    """
    trimmed = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    master = master.select(F.trim("supplier_id").alias("id"), trimmed(F.col("supplier_name")).alias("name")).distinct()
    master = staged(master.filter("id is not null and name <> ''"), "master")
    shared = shared_words(master)
    texts = spellings.select(trimmed(F.col("spelling")).alias("name")).filter("name <> ''")
    parsed = staged(profiles(parsed_names(texts.unionByName(master.select("name")), shared)), "parsed")
    known = staged(parsed.join(master, "name"), "known")
    matches = staged(match_profiles(parsed, known), "matches")

    hub = known.groupBy(*PROFILE).agg(F.min("id").alias("hub"))
    same = [F.col(f"k.{c}").eqNullSafe(F.col(f"h.{c}")) for c in PROFILE]
    links = _kin(matches, known, hub).filter("a <> b").distinct()
    links = staged(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    orgs = organisations(master, links)

    named = known.select(*PROFILE, "id").distinct().join(orgs, "id").groupBy(*PROFILE, "org").agg(F.lit(1).alias("_")).drop("_")
    rank = F.struct(~F.col("own_profile"), "edits", "odds", "lacks")
    meant = matches.withColumn("rank", rank).alias("k").join(named.alias("h"), same).select("k.name", "k.rank", "h.org")
    best = meant.groupBy("name").agg(F.min("rank").alias("rank"))
    return meant.join(best, ["name", "rank"]).groupBy("name").agg(F.min("org").alias("lo"), F.max("org").alias("hi")).filter("lo = hi").select(
        F.col("name").alias("spelling"), F.col("lo").alias("supplier_id")
    )
