"""Mixing sources to target weights: min-cost flow over membership patterns, then seeded selection.

Documents are aggregated by the set of sources they belong to. Token capacity flows from these
patterns to the sources' quotas; the k-th use of a document costs k - 1, so repeating is a last
resort and is spread evenly. What a pattern gives to a source then becomes whole uses of all its
documents and one more use of some, chosen in a seeded order through two-level running sums.
"""

from __future__ import annotations

import base64
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from gristmill.scratch import staged

#: The pattern by which the rank vocabulary splits text before its merges (a fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BUCKET_ROWS = 1000  # documents of a source that are put in order together, about
MAX_PATTERNS = 20_000


@lru_cache(maxsize=1)
def _encoding(ranks: bytes):
    import tiktoken

    merges = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=merges, special_tokens={})


def with_tokens(docs: DataFrame, text: str, ranks_file: str, column: str = "n_tokens") -> DataFrame:
    """``docs`` beside the number of tokens of ``text`` in a public rank vocabulary; null texts have none.

    The vocabulary file is read once by the driver and broadcast; it is of fixed size.
    """
    with open(ranks_file, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(ranks.value)
        for texts in batches:
            yield pd.Series([len(encoding.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return docs.withColumn(column, count(F.col(text)))


@dataclass
class _Arc:
    """An arc of convex cost: its first ``unit`` costs ``cost``, each further one, up to ``units``, one more."""

    to: int
    unit: int
    units: int
    cost: int = 0
    used: int = 0

    def forth(self) -> tuple[int, int]:
        """(room, cost) of the unit that is being used."""
        k = self.used // self.unit
        return ((k + 1) * self.unit - self.used, self.cost + k) if k < self.units else (0, 0)

    def back(self) -> tuple[int, int]:
        """(room, cost) of taking back from the unit used last."""
        if not self.used:
            return 0, 0
        k = (self.used - 1) // self.unit
        return self.used - k * self.unit, -(self.cost + k)


class _Flow:
    """Min-cost flow by successive shortest paths, over patterns and sources (small by construction)."""

    def __init__(self, n: int):
        self.arcs: list[list[tuple[_Arc, bool, int]]] = [[] for _ in range(n)]

    def arc(self, a: int, b: int, unit: int, units: int = 1) -> _Arc:
        arc = _Arc(b, max(unit, 1), units if unit else 0)
        self.arcs[a].append((arc, True, b))
        self.arcs[b].append((arc, False, a))
        return arc

    def run(self, start: int, end: int) -> None:
        height = [0] * len(self.arcs)
        while True:
            far = [float("inf")] * len(self.arcs)
            far[start], via, queue = 0, {}, [(0, start)]
            while queue:
                d, a = heapq.heappop(queue)
                if d > far[a]:
                    continue
                for arc, forth, to in self.arcs[a]:
                    room, step = arc.forth() if forth else arc.back()
                    if room and (cost := d + step + height[a] - height[to]) < far[to]:
                        far[to], via[to] = cost, (a, arc, forth, room)
                        heapq.heappush(queue, (cost, to))
            if far[end] == float("inf"):
                return
            height = [h + f if f < float("inf") else h for h, f in zip(height, far)]
            path, at = [], end
            while at != start:
                a, arc, forth, room = via[at]
                path.append((arc, forth, room))
                at = a
            room = min(r for _, _, r in path)
            for arc, forth, _ in path:
                arc.used += room if forth else -room


def route(patterns: list[tuple[tuple[str, ...], int]], targets: list[tuple[str, float, int]]) -> tuple[dict[str, int], dict[tuple[tuple[str, ...], str], int]]:
    """(quota of each source, tokens each pattern gives to each source).

    ``patterns`` are (sources, tokens), ``targets`` (source, share, most repeats). The total is that
    of all patterns with a named source; a source that cannot fill its quota falls short of it. One arc of convex cost
    joins a pattern to a source, however often it may repeat.
    """
    caps = {s: (share, most) for s, share, most in targets}
    live = [(p, t) for p, t in patterns if t and any(s in caps for s in p)]
    total = sum(t for _, t in live)
    quota = {s: round(share * total) for s, (share, _) in caps.items()}
    names = sorted(quota)
    place = {s: 2 + len(live) + j for j, s in enumerate(names)}
    flow = _Flow(2 + len(live) + len(names))
    given: dict[tuple[tuple[str, ...], str], _Arc] = {}
    for i, (p, tokens) in enumerate(live):
        flow.arc(0, 2 + i, tokens * sum(caps[s][1] for s in p if s in caps))
        for s in p:
            if s in caps:
                given[p, s] = flow.arc(2 + i, place[s], tokens, caps[s][1])
    for s in names:
        flow.arc(place[s], 1, quota[s])
    flow.run(0, 1)
    return quota, {key: arc.used for key, arc in given.items()}


def _named_only(sources: Column, targets: DataFrame) -> Column:
    """Those of an array of sources that a target names, each once and in order; the targets are few and are routed on the driver anyway."""
    rows = targets.filter("source is not null and target_share is not null").select("source").distinct().collect()
    names = F.array(*[F.lit(r["source"]) for r in rows]).cast("array<string>")
    return F.array_sort(F.array_intersect(sources, names))


def plan_mix(tokens: DataFrame, targets: DataFrame) -> DataFrame:
    """``pattern, source, tokens, whole, rest, quota``: what each pattern gives to each source.

    ``tokens`` has ``sources`` (array), ``n_tokens``; ``targets`` ``source, target_share, max_repeats``.
    Only the table of patterns, of at most ``MAX_PATTERNS`` rows, comes to the driver; a pattern holds named sources
    only, so sources that no target names do not count.
    """
    spark = tokens.sparkSession
    named = targets.filter("source is not null and target_share is not null").groupBy("source").agg(
        F.max("target_share").alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("most")
    )
    by_pattern = tokens.groupBy(_named_only(F.col("sources"), targets).alias("pattern")).agg(F.sum("n_tokens").alias("tokens")).filter(F.size("pattern") > 0)
    rows = by_pattern.limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} combinations of named sources")
    patterns = [(tuple(r["pattern"]), int(r["tokens"] or 0)) for r in rows]
    quota, given = route(patterns, [(r["source"], float(r["share"]), int(r["most"])) for r in named.collect()])
    size = dict(patterns)
    out = [(list(p), s, size[p], f // size[p], f % size[p], quota[s]) for (p, s), f in given.items()]
    out += [([], s, 0, 0, 0, q) for s, q in quota.items() if not any(s == t for _, t in given)]
    return spark.createDataFrame(out, "pattern array<string>, source string, tokens bigint, whole bigint, rest bigint, quota bigint")


def mix(docs: DataFrame, targets: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source",
        ranks_file: str, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(documents with their number of uses, report by source).

    The first is ``key, source, n_tokens, repeats``, one row per document and source that uses it;
    the second ``source, target_share, quota_tokens, mixed_tokens, actual_share, n_documents,
    most_repeats``. A document of no named source is never used; a named source without documents
    appears in the report with nothing. Null texts and empty ones have no tokens, a null source is
    no source. Where a quota ends within a document, the document counts to the side that leaves
    the smaller error. ``source`` may be one name or an array of names. Each row of ``docs`` is a
    document of its own, whatever other rows hold.
    """
    one = docs.schema[source].dataType.typeName() == "string"
    sources = F.when(F.col(source).isNull(), F.array().cast("array<string>")).otherwise(F.array(source)) if one else F.coalesce(F.col(source), F.array().cast("array<string>"))
    slim = docs.select(F.col(key).alias("key"), sources.alias("sources"), F.col(text).alias("text"))
    tokens = staged(with_tokens(slim, "text", ranks_file).select("key", "n_tokens", _named_only(F.col("sources"), targets).alias("pattern")), "tokens")
    plan = plan_mix(tokens.withColumnRenamed("pattern", "sources"), targets)
    offered = tokens.withColumn("source", F.explode("pattern")).join(F.broadcast(plan.filter("tokens > 0").drop("tokens")), ["pattern", "source"])
    bits = max(12, math.ceil(math.log2(max(tokens.count(), 1) / BUCKET_ROWS)))
    drawn = offered.withColumn("draw", F.xxhash64(F.lit(seed), "source", "key")).withColumn("bucket", F.shiftright("draw", 64 - bits))
    group = ["pattern", "source"]
    sums = drawn.groupBy(*group, "bucket").agg(F.sum("n_tokens").alias("in_bucket"))
    before = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = drawn.join(sums.withColumn("before", F.coalesce(F.sum("in_bucket").over(before), F.lit(0))), [*group, "bucket"])
    ends_here = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("in_bucket") > F.col("rest"))
    within = Window.partitionBy(*group, "bucket").orderBy("draw", "key").rowsBetween(Window.unboundedPreceding, -1)
    cut = placed.filter(ends_here).withColumn("at", F.col("before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    cut = cut.withColumn("extra", (F.col("at") + F.col("n_tokens") / 2 <= F.col("rest")).cast("bigint")).drop("at")
    within_rest = (F.col("rest") > 0) & (F.col("before") + F.col("in_bucket") <= F.col("rest"))
    rest = placed.filter(~ends_here).withColumn("extra", within_rest.cast("bigint"))
    chosen = cut.unionByName(rest).withColumn("repeats", F.col("whole") + F.col("extra")).filter("repeats > 0")
    chosen = chosen.select(F.col("key").alias(key), "source", "n_tokens", "repeats")
    used = chosen.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("repeats")).alias("mixed"), F.count("*").alias("n"), F.max("repeats").alias("most")
    )
    named = plan.groupBy("source").agg(F.max("quota").alias("quota_tokens")).join(
        targets.groupBy("source").agg(F.max("target_share").alias("target_share")), "source"
    )
    mixed = F.coalesce("mixed", F.lit(0).cast("bigint"))
    report = named.join(used, "source", "left").select(
        "source", "target_share", "quota_tokens", mixed.alias("mixed_tokens"),
        F.try_divide(mixed, F.sum(mixed).over(Window.partitionBy(F.lit(1)))).alias("actual_share"),
        F.coalesce("n", F.lit(0).cast("bigint")).alias("n_documents"), F.coalesce("most", F.lit(0).cast("bigint")).alias("most_repeats"),
    )
    return chosen, report
