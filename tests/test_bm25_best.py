"""The best by BM25 without scoring every pair, against all pairs."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gristmill.functions.text import tokens
from gristmill.operators import search as S
from gristmill.plans import answers, reference
from gristmill.scratch import scratch_dir

from .conftest import rows


def written(spark, name: str) -> set:
    return set(Path(scratch_dir(spark).removeprefix("file://")).glob(f"{name}-*"))


def pairs_of(spark, run) -> int:
    """How many scored pairs a run writes."""
    before = written(spark, "scores")
    run()
    return sum(spark.read.parquet(f"file://{p}").count() for p in written(spark, "scores") - before)


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(7)
    text = lambda: " ".join(rng.choice(["the", "pump", "of", "oven", "line", f"mch-{rng.randrange(60)}", f"b{rng.randrange(30)}"]) for _ in range(rng.randrange(1, 14)))
    docs = [(k, text()) for k in range(150)]
    docs += [(200 + k, docs[k][1]) for k in range(20)]  # ties
    docs += [(300, None), (301, ""), (302, "unasked"), (5, docs[5][1]), (6, "the pump mch-3"), (None, "oven mch-7")]  # repeated keys, of one length and of two
    queries = [(f"q{k}", text()) for k in range(40)] + [("same", "the pump of the oven"), ("same2", "the pump of the oven"), ("none", "nowhere"), ("null", None)]
    spark_docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).localCheckpoint()
    return spark.createDataFrame(queries, "query_id string, text string"), spark_docs


@pytest.mark.parametrize("common, block, cells", [(0.01, 1 << 19, 1 << 22), (0.3, 1 << 19, 1 << 22), (0.3, 50, 60), (1.0, 1 << 19, 40), (0.0, 50, 30)])
def test_best_of_each_query_are_those_of_all_pairs(spark, made, monkeypatch, common, block, cells):
    monkeypatch.setattr(S, "CELLS", cells)
    queries, docs = made
    expected = S.top_k(S.bm25(queries, docs, tokens(F.col("text"))), 7)
    got = S.ranked(S.index(queries, docs, tokens(F.col("text"))), 7, common=common, block=block)
    assert got.columns == expected.columns and rows(got) == rows(expected)


def test_repeated_keys_are_added_up_by_length(spark):
    docs = spark.createDataFrame([(1, "pump pump"), (1, "pump oven"), (1, "pump"), (2, "line")], "doc_id long, text string")
    queries = spark.createDataFrame([("a", "pump")], "query_id string, text string")
    n, mean, df = 4, 6 / 4, 2  # two texts of key 1: that of two words each, and that of one
    part = lambda tf, length: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))
    import math

    score = math.log(1 + (n - df + 0.5) / (df + 0.5)) * (part(3, 2) + part(1, 1))
    assert rows(S.bm25_top_k(queries, docs, tokens(F.col("text")), 3)) == {("a", 1, round(score, 6), 1)}


def test_terms_too_many_to_send_out_give_the_same_postings(spark, made):
    queries, docs = made
    terms = queries.select(F.explode(tokens(F.col("text"))).alias("term"))
    held = lambda most: sorted((d or -1, n, sorted(zip(t, f))) for d, n, t, f in rows_of(S.postings(docs, tokens(F.col("text")), terms, most_bytes=most)))
    rows_of = lambda df: [tuple(r) for r in df.select("doc", "length", F.coalesce("terms", F.array()).alias("t"), F.coalesce("tfs", F.array()).alias("f")).collect()]
    assert held(1 << 20) == held(0)


def write_tables(spark, tmp_path, n: int = 600):
    """Titles and questions that differ in their code alone, over documents that hold all their other words."""
    text = F.concat(F.lit("The work report on machine MCH-"), F.col("id") % 97, F.lit(" was last repaired "), F.repeat(F.lit("pump "), (F.col("id") % 5).cast("int")))
    docs = spark.range(1, n + 1).select(F.col("id").alias("doc_id"), text.alias("text"), F.concat(F.lit("Work report MCH-"), F.col("id") % 97).alias("title"), F.concat(F.lit("KB-"), F.col("id")).alias("doc_code"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    asked = spark.range(0, 300).select(F.format_string("Q%07d", "id").alias("qid"), F.concat(F.lit("When was MCH-"), F.col("id"), F.lit(" last repaired?")).alias("question"), (F.col("id") % 2 == 0).alias("answerable"), F.array(F.concat(F.lit("KB-"), F.col("id"))).alias("gold_doc_ids"))
    asked.write.parquet(f"{tmp_path}/questions.parquet")
    return str(tmp_path)


def test_title_weighted_search_does_not_score_all_pairs(spark, tmp_path):
    d = write_tables(spark, tmp_path)
    words = F.concat(*[tokens(F.col("title"))] * 3, tokens(F.col("text")))
    expected = S.top_k(S.bm25(reference._title_queries(spark, d), spark.read.parquet(f"{d}/documents.parquet"), words), 10)
    assert rows(reference.bm25_title_weighted(spark, d)) == rows(expected)
    assert 0 < pairs_of(spark, lambda: reference.bm25_title_weighted(spark, d)) < 6 * 600 / 4


def test_overlap_by_postings_is_that_of_the_texts(spark, made):
    queries, docs = made
    of = S.index(queries, docs, tokens(F.col("text")))
    found = S.ranked(of, 3).select("query_id", "doc_id").union(spark.createDataFrame([("null", 1), ("q1", 300), ("q1", 302)], "query_id string, doc_id long")).localCheckpoint()
    texts = found.join(queries.withColumnRenamed("text", "question"), "query_id").join(docs, "doc_id")
    expected = texts.select("query_id", "doc_id", S.overlap(F.col("question"), F.col("text")).alias("score"))
    assert sorted(S.overlaps(of, queries, found).collect()) == sorted(expected.collect())


def test_evidence_is_looked_through_once_with_the_same_coverage(spark):
    docs = spark.createDataFrame([(1, "The oven's lid"), (2, "pumpkin, clamp-force"), (3, None), (4, "pump"), (4, "valve")], "doc_id long, text string")
    asked = spark.createDataFrame([("a", ["oven", "pump"]), ("b", ["clamp-force", "force", "lid"]), ("c", ["oven"]), ("d", ["pump", "valve"]), ("e", [])], "query_id string, terms array<string>")
    found = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("c", 3), ("d", 4), ("e", 1), ("b", 99)], "query_id string, doc_id long")
    expected = rows(S.coverage(found.join(asked, "query_id").join(docs, "doc_id"), "terms", "text"))
    assert rows(S.coverage_of(found, asked, docs)) == rows(S.coverage_of(found, asked, docs, most_terms=0)) == expected


def test_evidence_does_not_score_all_pairs(spark, tmp_path):
    d = write_tables(spark, tmp_path)
    assert 0 < pairs_of(spark, lambda: answers.retrieve_evidence(spark, d)) < 100 * 600 / 4


def test_lanes_do_not_score_all_pairs(spark, tmp_path):
    d = write_tables(spark, tmp_path)
    assert 0 < pairs_of(spark, lambda: reference.weighted_rrf_lanes(spark, d)) < 100 * 600 / 4


@pytest.mark.parametrize("name, queries", [("abstention", 100), ("coverage_fraction", 100), ("retrieval_quality", 100), ("bm25_topk", 6), ("lexical_rerank", 6)])
def test_no_search_scores_all_pairs(spark, tmp_path, name, queries):
    d = write_tables(spark, tmp_path)
    assert 0 < pairs_of(spark, lambda: reference.QUERIES[name](spark, d)) < queries * 600 / 4
