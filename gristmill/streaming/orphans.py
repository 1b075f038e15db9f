"""Pending references as a stream: the kept orphan state advanced batch by batch."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from gristmill.operators.orphans import OrphanState, advance, no_state


def kept_state(spark: SparkSession, home: str, period: str = "month", before: int | None = None) -> OrphanState:
    """The state after the last batch (before batch ``before``) of the stream that writes to ``home``."""
    try:
        done = spark.read.schema("epoch bigint").json(f"{home}/batches/*")
    except AnalysisException:  # no batch is done yet
        return no_state(spark, period)
    if before is not None:
        done = done.filter(F.col("epoch") < before)
    last = done.agg(F.max("epoch")).first()[0]
    if last is None:
        return no_state(spark, period)
    return OrphanState(*[spark.read.parquet(f"{home}/epoch={last}/{part}") for part in ("parents", "waiting")], period)


def track(events: DataFrame, home: str, period: str = "month") -> StreamingQuery:
    """Advance the state with each batch of ``events`` until what is there now is done.

    ``events`` has ``target, key, ts, kind, ref_table, ref_id``; kind is ``parent``, ``deleted`` or ``ref``. Within a batch they
    come in any order, also several of one key: each counts at its own time. The state after a batch is a table of its
    own under ``home``, and so are the references that came as orphans (``opened``); a batch that is run again after
    a failure starts from the state before it and replaces its own tables.
    """
    spark = events.sparkSession

    def step(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        state = kept_state(spark, home, period, epoch)
        refs = batch.filter("kind = 'ref'").select("target", "key", "ts", "ref_table", "ref_id")
        delta = F.when(F.col("kind") == "parent", 1).otherwise(-1)
        moves = batch.filter("kind <> 'ref' and key is not null and ts is not null").select("target", "key", "ts", delta.alias("delta"))
        after, opened = advance(state, refs, moves, keep=False)
        for name, df in (("parents", after.parents), ("waiting", after.waiting), ("opened", opened)):
            df.write.mode("overwrite").parquet(f"{home}/epoch={epoch}/{name}")
        spark.range(1).select(F.lit(epoch).cast("bigint").alias("epoch")).write.mode("overwrite").json(f"{home}/batches/done={epoch}")
        batch.unpersist()

    return events.writeStream.foreachBatch(step).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start()


def opened(spark: SparkSession, home: str) -> DataFrame:
    """All references that came as orphans so far."""
    return spark.read.option("basePath", home).parquet(f"{home}/epoch=*/opened").drop("epoch")
