"""A graph as two DataFrames: nodes (``id``), edges (``src, rel, dst``); reads are undirected."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from gristmill.functions.keys import clean_key, plain_codes
from gristmill.functions.text import identifiers
from gristmill.scratch import staged


def both_ways(edges: DataFrame) -> DataFrame:
    back = edges.select(F.col("dst").alias("src"), "rel", F.col("src").alias("dst"))
    return edges.select("src", "rel", "dst").unionByName(back).filter("src is not null and dst is not null").distinct()


def neighbors(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``src, rel, dst`` of the edges at ``nodes`` (``id``), each read away from them."""
    return both_ways(edges).join(nodes.select(F.col("id").alias("src")).distinct(), "src", "left_semi")


def reach(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """``seed, id, hops`` of all nodes within ``depth`` hops of each seed (``seed``), by shortest way.

    The frontier is joined to the edges once per hop, and nodes reached before are left out, so a
    walk never turns back. Each hop is written out; nothing but its emptiness comes to the driver.
    """
    links = staged(both_ways(edges).select("src", "dst").distinct(), "links")
    start = seeds.select("seed", F.col("seed").alias("id")).distinct().withColumn("hops", F.lit(0))
    hops = [start]
    for hop in range(1, depth + 1):
        seen = reduce(DataFrame.unionByName, hops).select("seed", "id")
        frontier = hops[-1].join(links, F.col("id") == links.src).select("seed", F.col("dst").alias("id")).distinct()
        hops.append(staged(frontier.join(seen, ["seed", "id"], "left_anti").withColumn("hops", F.lit(hop)), "hop"))
        if hops[-1].isEmpty():
            break
    return reduce(DataFrame.unionByName, hops)


def shortest_paths(edges: DataFrame, pairs: DataFrame, depth: int) -> DataFrame:
    """``src, dst, hops, path``: for each pair the shortest path of at most ``depth`` hops.

    Of equally short paths the first by its node ids is taken. Pairs without a path have no row.
    """
    links = staged(both_ways(edges).select(F.col("src").alias("at"), "dst").distinct().withColumnRenamed("dst", "next"), "links")
    front = pairs.select("src").distinct().select("src", F.col("src").alias("at"), F.array("src").alias("path"))
    done = [front]
    for _ in range(depth):
        step = front.join(links, "at").select("src", F.col("next").alias("at"), F.concat("path", F.array("next")).alias("path"))
        best = step.groupBy("src", "at").agg(F.min("path").alias("path"))
        seen = reduce(DataFrame.unionByName, done).select("src", "at")
        front = staged(best.join(seen, ["src", "at"], "left_anti"), "front")
        if front.isEmpty():
            break
        done.append(front)
    reached = reduce(DataFrame.unionByName, done).withColumnRenamed("at", "dst")
    return pairs.distinct().join(reached, ["src", "dst"]).select("src", "dst", (F.size("path") - 1).alias("hops"), F.array_join("path", ">").alias("path"))


def path_through(edges: DataFrame, routes: DataFrame, depth: int) -> DataFrame:
    """``src, via, dst, hops, path``: shortest paths of two legs through a waypoint."""
    first = shortest_paths(edges, routes.select("src", F.col("via").alias("dst")), depth)
    second = shortest_paths(edges, routes.select(F.col("via").alias("src"), "dst"), depth)
    a = first.select("src", F.col("dst").alias("via"), F.col("hops").alias("h1"), F.col("path").alias("p1"))
    b = second.select(F.col("src").alias("via"), "dst", F.col("hops").alias("h2"), F.col("path").alias("p2"))
    tail = F.regexp_replace("p2", "^[^>]*", "")
    return routes.distinct().join(a, ["src", "via"]).join(b, ["via", "dst"]).select(
        "src", "via", "dst", (F.col("h1") + F.col("h2")).alias("hops"), F.concat("p1", tail).alias("path")
    )


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which an end is no node, with which end."""
    ids = nodes.select(F.col("id")).distinct()
    left = edges.join(ids, edges.src == ids.id, "left_anti").withColumn("missing", F.lit("src"))
    return left.unionByName(edges.join(ids, edges.dst == ids.id, "left_anti").withColumn("missing", F.lit("dst")))


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """``id, aliases, sources``: one row per id with the sorted union of its lists."""
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    return nodes.groupBy("id").agg(union("aliases").alias("aliases"), union("sources").alias("sources"))


def merge_edges(edges: DataFrame, order: str) -> DataFrame:
    """One edge per (src, rel, dst): the first by ``order``."""
    first = Window.partitionBy("src", "rel", "dst").orderBy(order)
    return edges.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def edges_of_rows(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``src, rel, dst``: every identifier in a row's other columns, related to the row by the column's name.

    Keys count whatever their case and kind of hyphen; both ends come in the form of ``clean_key``.
    """
    return _related(rows.select(clean_key(F.col(key)).alias("src"), *columns), columns)


def walk_scores(reached: DataFrame) -> DataFrame:
    """``id, score`` from ``reach``: 1 for a seed, 1 / hops for what is further, the best over all seeds."""
    score = F.when(F.col("hops") == 0, 1.0).otherwise(1.0 / F.col("hops"))
    return reached.groupBy("id").agg(F.max(score).alias("score"))


def first_meeting(edges: DataFrame, starts: DataFrame, goals: DataFrame, depth: int) -> DataFrame:
    """``src, dst, hops, path``: for each start (``src``) the shortest path to the first node among ``goals`` (``id``); of equally short ones the first by its ids.

    Only the starts' own reach is walked, and a pair of start and goal comes from that reach, not from all pairs.
    """
    reached = reach(edges, starts.select(F.col("src").alias("seed")).distinct(), depth).filter("hops > 0")
    near = reached.join(goals.select("id").distinct(), "id", "left_semi")
    least = near.groupBy("seed").agg(F.min("hops").alias("hops"))
    pairs = near.join(least, ["seed", "hops"]).select(F.col("seed").alias("src"), F.col("id").alias("dst"))
    found = shortest_paths(edges, pairs, depth)
    return found.groupBy("src").agg(F.min(F.struct("hops", "path", "dst")).alias("m")).select("src", "m.dst", "m.hops", "m.path")


def verified_hops(hops: DataFrame, edges: DataFrame) -> DataFrame:
    """``hops`` (``src, dst``) beside ``verified``: whether an edge joins the two, in either direction."""
    there = both_ways(edges).select("src", "dst").distinct().withColumn("verified", F.lit(True))
    return hops.join(there, ["src", "dst"], "left").withColumn("verified", F.coalesce("verified", F.lit(False)))


IDENTITY = r"^(?:id|.*_id|po|wo|qid|key)$"  # names of columns that say which thing a row is about


def edges_of_table(rows: DataFrame) -> DataFrame:
    """``src, rel, dst`` of any table: its subject is the first identifier of the identity-like column, else the first of the row.

    All string columns are read in their order; a row without an identifier gives none.
    """
    texts = [f.name for f in rows.schema.fields if f.dataType.simpleString() == "string"]
    named = [c for c in texts if re.match(IDENTITY, c)]
    ids = {c: identifiers(plain_codes(F.coalesce(F.col(c), F.lit("")))) for c in texts}
    first = F.element_at(F.flatten(F.array(*[ids[c] for c in [*named[:1], *texts]])), 1) if texts else F.lit(None)
    return _related(rows.filter(F.size(F.flatten(F.array(*ids.values()))) > 0).select(first.alias("src"), *texts), texts)


def _related(rows: DataFrame, columns: list[str]) -> DataFrame:
    long = rows.unpivot(["src"], columns, "rel", "text")
    found = long.select("src", F.upper(F.regexp_replace("rel", "[^A-Za-z0-9]+", "_")).alias("rel"), F.explode(identifiers(plain_codes(F.col("text")))).alias("dst"))
    return found.filter("src <> dst").distinct()


def grounded(entities: DataFrame, relations: DataFrame, texts: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(entities that stand in their text word for word, relations of which both ends are such and differ).

    ``entities`` has ``key, entity``, ``relations`` ``key, src, dst``, ``texts`` ``key, text``.
    """
    kept = entities.join(texts.select(key, "text"), key).filter("entity <> '' and contains(text, entity)").drop("text").distinct()
    ends = relations.filter("src <> dst")
    for end in ("src", "dst"):
        ends = ends.join(kept.select(key, F.col("entity").alias(end)), [key, end], "left_semi")
    return kept, ends.select(key, "src", "dst").distinct()
