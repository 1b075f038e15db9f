"""Incremental tables: arriving records are appended batch by batch, reading takes each key's latest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def upsert_stream(arriving: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream's batches to ``path``, each as its own partition, until what is there now is done.

    A batch that is run again after a failure replaces its own partition, so rows count once.
    """

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return arriving.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, keys: list[str], version: str) -> DataFrame:
    """The latest row of each key by ``version``, then by the batch in which it came."""
    df = spark.read.option("basePath", path).parquet(path)
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(version, "epoch")).alias("r")
    return df.groupBy(*keys).agg(newest).select(*keys, "r.*").drop("epoch")


def done(query: StreamingQuery) -> None:
    """Wait until a stream has taken in what is there now; its failure is raised."""
    query.awaitTermination()


def finished(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append what a stream gives to ``path`` until what is there now is done."""
    done(stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())


def windowed_counts(events: DataFrame, ts: str, kind: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``start, kind, n, total`` per tumbling window, closed once the watermark has passed."""
    at = events.withWatermark(ts, late).groupBy(F.window(ts, width), kind)
    return at.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), kind, "n", "total")
