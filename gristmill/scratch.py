"""Shared scratch space: where lineage is cut and intermediate tables are written."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Where that is unset, a local session (tests) gets a folder of its own, which goes when the session's process ends; on a
    cluster it is an error, as executors would each write to their own disk.
    """
    path = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not path:
        if not (spark.sparkContext.master or "").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="gristmill-")
        atexit.register(shutil.rmtree, folder, True)
        path = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back.

    The rows survive the loss of an executor, and everything after reads the table instead of
    repeating the work before it.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


SPREAD_BYTES = 4 << 20  # of input for each core


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` over all cores where its input is small (less than ``SPREAD_BYTES`` a core); else as it is.

    For work that is heavy per row: one small file of long texts would otherwise be one task. Larger inputs have splits enough
    for every core and are never shuffled by this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores, key) if size < cores * SPREAD_BYTES else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
