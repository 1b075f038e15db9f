"""Queries of the corpus operators, named by problem, and the SQL that some are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gristmill.functions.keys import clean_key
from gristmill.llm import leaks, lookalikes, mixing, names
from gristmill.llm.sql import SQL  # noqa: F401
from gristmill.scratch import spread, table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    master = table(spark, sf_dir, "suppliers_master")
    typed = table(spark, sf_dir, "purchase_orders").select(F.col("supplier").alias("spelling"))
    typed = typed.unionByName(table(spark, sf_dir, "bom_parts").select(F.col("supplier").alias("spelling"))).distinct()
    typed = typed.filter(~clean_key(F.col("spelling")).rlike("^SUP-?[0-9]+$"))
    return names.link_names(typed, master)


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(_documents(spark, sf_dir), table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_pairs(_leaks(spark, sf_dir))


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test item with the number of documents it leaked into."""
    hit = p7_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n"))
    items = table(spark, sf_dir, "eval_items").select("item_id").distinct()
    return items.join(hit, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0).cast("bigint")).alias("n_documents"))


def p7_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.without_spans(_leaks(spark, sf_dir))


RANKS_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, targets = _documents(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    return mixing.mix(docs, targets, ranks_file=RANKS_FILE, seed=8)[0]


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, targets = _documents(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    return mixing.mix(docs, targets, ranks_file=RANKS_FILE, seed=8)[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.look_alike_pairs(_documents(spark, sf_dir))


def p9_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.look_alike_classes(_documents(spark, sf_dir))


def p9_normal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lookalikes.unify(_documents(spark, sf_dir))
    return done.select("doc_id", "normal_text", "look")


QUERIES = {f.__name__: f for f in (p5_found, p7_found, p7_items, p7_cleaned, p8_mix, p8_report, p9_found, p9_classes, p9_normal_texts)}
