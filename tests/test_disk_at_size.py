"""Searches over many long documents: what they shuffle and write is a small part of the texts."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gristmill import scratch
from gristmill.plans import reference

N, ASKED = 3000, 200


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Texts of 60 unasked words each; together with a code of its own each text holds all other words of the questions and titles."""
    d = tmp_path_factory.mktemp("size")
    unasked = F.concat_ws(" ", *[F.sha2(F.concat_ws("-", "id", F.lit(k)), 256) for k in range(60)])
    text = F.concat(F.lit("The work report on machine MCH-"), F.col("id") % 997, F.lit(" was last repaired. "), unasked)
    docs = spark.range(1, N + 1, 1, 4).select(F.col("id").alias("doc_id"), text.alias("text"), F.concat(F.lit("Work report on machine MCH-"), F.col("id") % 997).alias("title"), F.concat(F.lit("KB-"), F.col("id")).alias("doc_code"))
    docs.write.parquet(f"{d}/documents.parquet")
    asked = spark.range(ASKED).select(F.format_string("Q%07d", F.col("id") * 3).alias("qid"), F.concat(F.lit("When was the machine MCH-"), F.col("id"), F.lit(" last repaired?")).alias("question"), (F.col("id") % 2 == 0).alias("answerable"), F.array(F.concat(F.lit("KB-"), F.col("id"))).alias("gold_doc_ids"))
    asked.write.parquet(f"{d}/questions.parquet")
    return str(d)


def size(path: str) -> int:
    return sum(p.stat().st_size for p in Path(path.removeprefix("file://")).rglob("*.parquet"))


def shuffled(spark) -> dict[int, int]:
    """Bytes that each stage of this session shuffled, as far as Spark still keeps them."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return {s.stageId(): s.shuffleWriteBytes() for s in map(stages.apply, range(stages.size()))}


@pytest.mark.parametrize("name", ["weighted_rrf_lanes", "abstention", "coverage_fraction", "retrieval_quality", "bm25_topk", "lexical_rerank"])
def test_neither_texts_nor_all_pairs_are_written(spark, made, monkeypatch, name):
    monkeypatch.setattr(scratch, "SPREAD_BYTES", 0)  # small inputs are spread on purpose
    last, kept = max(shuffled(spark)), size(scratch.scratch_dir(spark))
    assert reference.QUERIES[name](spark, made).count()
    moved = sum(n for k, n in shuffled(spark).items() if k > last)
    assert 0 < moved + size(scratch.scratch_dir(spark)) - kept < size(made) / 10
