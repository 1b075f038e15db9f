import math
from collections import Counter

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from gristmill.functions.text import tokens
from gristmill.operators import graph as G, search as S

from .conftest import rows

DOCS = [(1, "alpha beta beta"), (2, "beta gamma"), (3, "delta"), (4, None), (5, ""), (6, "beta gamma")]


def bm25(query):
    texts = {k: (t or "").split() for k, t in DOCS}
    n, mean, df = len(texts), sum(map(len, texts.values())) / len(texts), Counter(w for t in texts.values() for w in set(t))
    score = {}
    for k, t in texts.items():
        s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in query.split() if w in t)
        if s:
            score[k] = round(s, 6)
    return score


def test_bm25_counts_repeated_terms_and_breaks_ties_by_key(spark):
    docs = spark.createDataFrame([(*d, "x") for d in DOCS], "doc_id long, text string, term string")
    queries = spark.createDataFrame([("a", "beta gamma beta"), ("b", "unknown"), ("c", None)], "query_id string, text string")
    got = S.top_k(S.bm25(queries, docs, tokens(F.col("text"))), 3)
    assert {(r["doc_id"], r["score"]) for r in got.collect()} <= set(bm25("beta gamma beta").items())
    assert [r["doc_id"] for r in got.orderBy("rank").collect()] == sorted(bm25("beta gamma beta"), key=lambda k: (-bm25("beta gamma beta")[k], k))[:3]
    assert S.bm25(queries, docs.limit(0), tokens(F.col("text"))).count() == 0


def test_vector_search_equals_brute_force_in_any_blocks(spark):
    rng = np.random.default_rng(0)
    vectors = [(k, rng.normal(size=8).tolist()) for k in range(200)] + [(200, None), (201, [1.0])]
    vectors += [(300 + k, vectors[k][1]) for k in range(5)]  # ties
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    queries = df.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    real = {k: np.array(v) for k, v in vectors if v and len(v) == 8}
    expected = {(q, k) for q in real if q % 20 == 0 for k in sorted(real, key=lambda k: (-round(float(real[q] @ real[k]), 6), k))[:5]}
    for size in (1 << 20, 64):
        assert rows(S.vector_top_k(queries, df, 5, block_bytes=size).select("query_id", "vec_id")) == expected
    assert S.vector_top_k(queries.limit(0), df, 5).count() == 0


@settings(max_examples=5, deadline=None)
@given(st.permutations(range(6)), st.permutations(range(6)))
def test_fusion_sums_shares(spark, a, b):
    lane = lambda p: spark.createDataFrame([("q", k, p.index(k) + 1) for k in p], "query_id string, doc_id long, rank int")
    got = {r["doc_id"]: r["score"] for r in S.fuse([("x", 1, lane(a)), ("y", 3, lane(b))]).collect()}
    assert all(abs(got[k] - (1 / (61 + a.index(k)) + 3 / (61 + b.index(k)))) < 1e-12 for k in range(6))


def test_metrics_and_coverage(spark):
    ranked = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 9, 1)], "query_id string, doc_id long, rank int")
    gold = spark.createDataFrame([("a", 2), ("a", 1), ("b", 5), ("b", 5)], "query_id string, doc_id long")
    m = S.retrieval_metrics(ranked, gold).first()
    assert (m["n_queries"], m["recall_at_1"], m["recall_at_3"], m["mrr"]) == (2, 0.0, 0.5, 0.5)
    evidence = spark.createDataFrame([("a", ["oven", "pump"], "The oven's lid"), ("a", ["oven", "pump"], "pumpkin")], "query_id string, terms array<string>, text string")
    assert S.coverage(evidence, "terms", "text").first()["covered"] == 0.5


EDGES = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "e"), ("e", "d"), ("x", "y"), ("a", "b"), (None, "q")]


def brute_hops(seed, depth):
    near = {}
    for a, b in EDGES:
        if a and b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    hops, front = {seed: 0}, {seed}
    for h in range(1, depth + 1):
        front = {n for f in front for n in near.get(f, ())} - set(hops)
        hops |= dict.fromkeys(front, h)
    return {(seed, k, h) for k, h in hops.items()}


def test_reach_and_paths(spark):
    edges = spark.createDataFrame([(a, "R", b) for a, b in EDGES], "src string, rel string, dst string")
    seeds = spark.createDataFrame([("a",), ("x",), ("lone",)], "seed string")
    for depth in (1, 3):
        assert rows(G.reach(edges, seeds, depth)) == set().union(*(brute_hops(s, depth) for s in ("a", "x", "lone")))
    pairs = spark.createDataFrame([("a", "d"), ("a", "x"), ("a", "a")], "src string, dst string")
    assert rows(G.shortest_paths(edges, pairs, 4)) == {("a", "d", 2, "a>e>d"), ("a", "a", 0, "a")}
    via = spark.createDataFrame([("a", "c", "d")], "src string, via string, dst string")
    assert rows(G.path_through(edges, via, 4)) == {("a", "c", "d", 3, "a>b>c>d")}
    nodes = spark.createDataFrame([(n,) for n in "abcdexy"[:-1]], "id string")
    assert rows(G.dangling(edges.filter("src is not null"), nodes)) == {("x", "R", "y", "dst")}
    assert G.merge_edges(edges.withColumn("o", F.lit(1)), "o").count() == len(set(EDGES))
    assert G.reach(edges.limit(0), seeds, 2).count() == 3 and rows(G.neighbors(edges, spark.createDataFrame([("d",)], "id string"))) == {("d", "R", "c"), ("d", "R", "e")}


def test_rows_become_edges(spark):
    df = spark.createDataFrame([("PRT-1", "on MCH-3011 and MCH-3012", "PRT-1"), ("PRT-2", None, "")], "part string, `used on` string, other string")
    assert rows(G.edges_of_rows(df, "part", ["used on", "other"])) == {("PRT-1", "USED_ON", "MCH-3011"), ("PRT-1", "USED_ON", "MCH-3012")}
