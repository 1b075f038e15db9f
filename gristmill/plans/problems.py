"""Queries of the data-cleaning operators of the core, named by problem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gristmill.functions.keys import clean_key, month_of
from gristmill.operators import multivalue, orphans, raw_records, spikes, units
from gristmill.scratch import table

METRICS = ["availability", "performance", "quality"]


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_records.parse_records(table(spark, sf_dir, "raw_records"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_records.failed(_parsed(spark, sf_dir))


def p1_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts failed, by file and first reason."""
    bad = _parsed(spark, sf_dir).filter(~F.col("ok"))
    first = bad.groupBy("record_id", "source_file").agg(F.min_by(F.col("errors")[0]["code"], "part").alias("reason"))
    return first.groupBy("source_file", "reason").agg(F.count("*").alias("n_records"))


def p1_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records of each file are valid, and how many of them stand in a text with others or with a broken part."""
    good = _parsed(spark, sf_dir).filter("ok").groupBy("source_file")
    return good.agg(F.count("*").alias("n_valid"), F.count_if(F.col("n_parts") > 1).alias("n_recovered"))


def p1_purchase_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_records.typed(_parsed(spark, sf_dir), "erp/purchase_orders.csv").drop("record_part")


def p1_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_records.typed(_parsed(spark, sf_dir), "erp/suppliers_master.csv").drop("record_part")


def p1_work_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_records.typed(_parsed(spark, sf_dir), "maintenance/cmms_export.csv").drop("record_part")


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes.flag_readings(table(spark, sf_dir, "oee_daily"), "machine", "reading_date", "reading_id", METRICS)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir).select("reading_id", "metric").distinct()


def p2_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir).groupBy("metric", "verdict").agg(F.count("*").alias("n_values"))


def split_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src_table, row_key, pos, item, flag`` of used_on and products."""
    key = [F.lit("bom_parts").alias("src_table"), F.col("part_id").alias("row_key")]
    used_on = multivalue.split_values(
        table(spark, sf_dir, "bom_parts").select("part_id", "used_on").distinct(), "used_on", key,
        multivalue.ListGrammar(multivalue.KEY_SEPARATOR),
    )
    key = [F.lit("suppliers_master").alias("src_table"), F.col("supplier_id").alias("row_key")]
    products = multivalue.split_values(
        table(spark, sf_dir, "suppliers_master").select("supplier_id", "products").distinct(), "products", key
    )
    return used_on.unionByName(products)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_fields(spark, sf_dir).select("src_table", "row_key", "pos", "item").distinct()


def p3_item_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each item is named in each table, whatever its case."""
    return (
        p3_found(spark, sf_dir).groupBy("src_table", F.lower("item").alias("item"))
        .agg(F.count("*").alias("n_places"), F.countDistinct("row_key").alias("n_rows"))
    )


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ref_table, row_key, target, key, ts``: every typed reference, each once."""
    orders = table(spark, sf_dir, "purchase_orders").select(
        F.lit("purchase_orders").alias("ref_table"), F.col("po").alias("row_key"), F.lit("part").alias("target"),
        clean_key(F.col("part")).alias("key"), F.col("loaded_at").alias("ts"),
    ).filter(F.col("key").rlike("^PRT-[0-9]+$"))
    bom = table(spark, sf_dir, "bom_parts").select("part_id", "used_on", "loaded_at").distinct()
    machines = multivalue.split_values(
        bom, "used_on", ["part_id", "loaded_at"], multivalue.ListGrammar(multivalue.KEY_SEPARATOR)
    ).select(
        F.lit("bom_parts").alias("ref_table"), F.col("part_id").alias("row_key"), F.lit("machine").alias("target"),
        clean_key(F.col("item")).alias("key"), F.col("loaded_at").alias("ts"),
    ).filter(F.col("key").rlike("^MCH-[0-9]+$"))

    def listed(name: str, row_key: str, ids: str) -> DataFrame:
        return table(spark, sf_dir, name).select(
            F.lit(name).alias("ref_table"), F.col(row_key).alias("row_key"), F.lit("document").alias("target"),
            F.explode(ids).alias("key"), F.col("loaded_at").alias("ts"),
        ).withColumn("key", clean_key(F.col("key"))).filter("key != ''")

    docs = listed("questions", "qid", "gold_doc_ids").unionByName(listed("ingestion_manifest", "source_file", "maps_to_doc_ids"))
    return orders.unionByName(machines).unionByName(docs)


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``target, key, loaded_at, deleted_at`` of all that can be referred to."""

    def of(name: str, key: str, target: str) -> DataFrame:
        return table(spark, sf_dir, name).select(
            F.lit(target).alias("target"), clean_key(F.col(key)).alias("key"), "loaded_at", "deleted_at"
        )

    parts, machines = of("bom_parts", "part_id", "part"), of("machines", "machine_id", "machine")
    return parts.unionByName(machines).unionByName(of("documents", "doc_code", "document"))


def _advanced(spark: SparkSession, sf_dir: str, refs: DataFrame) -> tuple[orphans.OrphanState, DataFrame]:
    """The state after all that has arrived, and the references that came as orphans; what a query does not read of it is not worked out."""
    return orphans.advance(orphans.no_state(spark), refs, orphans.parent_moves(targets(spark, sf_dir)), keep=False)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    opened = _advanced(spark, sf_dir, references(spark, sf_dir))[1]
    return opened.select("ref_table", "row_key", F.col("key").alias("missing_key"), month_of(F.col("ts")).alias("ref_month")).distinct()


def p4_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orphans per referring table at the end of each month in which they changed."""
    open_now = orphans.snapshots(_advanced(spark, sf_dir, references(spark, sf_dir).distinct())[0])
    return open_now.select("ref_table", month_of(F.col("period")).alias("month"), "opened_net", "open_orphans")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    bom = table(spark, sf_dir, "bom_parts")
    described = F.nullif(F.regexp_extract(F.lower("description"), units.DESCRIBED, 1), F.lit(""))
    sizes = bom.select(
        F.lit("bom_parts").alias("src_table"), F.col("part_id").alias("row_key"), described.alias("described"),
        F.lit("length").alias("kind"), "dim_length", "dim_od", "tolerance",
    ).unpivot(["src_table", "row_key", "described", "kind"], ["dim_length", "dim_od", "tolerance"], "field_name", "text")
    times = table(spark, sf_dir, "suppliers_master").select(
        F.lit("suppliers_master").alias("src_table"), F.col("supplier_id").alias("row_key"),
        F.lit(None).cast("string").alias("described"), F.lit("time").alias("kind"),
        F.lit("lead_time").alias("field_name"), F.col("lead_time").alias("text"),
    )
    done = units.convert(sizes.unionByName(times), ["src_table", "row_key", "field_name"])
    return done.select("src_table", "row_key", "field_name", "quantity").distinct()


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_reasons, p1_recovered, p1_purchase_orders, p1_suppliers, p1_work_orders, p2_found, p2_verdicts, p3_found,
              p3_item_counts, p4_found, p4_snapshots, p6_found)
}
