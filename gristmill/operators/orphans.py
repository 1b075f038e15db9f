"""References to records that do not exist: keyed pending-orphan state, kept and advanced incrementally.

The state is two tables. The parent index holds the moves of each key: +1 where a parent arrives, -1
where one is deleted. The waiting table counts the references to each key by referring table and
period. ``advance`` takes what has arrived since: new references probe the index at their own
time, arriving parents resolve the references that wait for them and deletions reopen them, as
the waiting counts hang on the key's living parents. One advance over everything, several over
successive increments, and a stream that advances batch by batch give the same.

References are never sorted or grouped by key: the intervals in which a key had a living parent are few, and are joined to
references that are spread over shards, so a key named by a third of all rows is no burden.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gristmill.scratch import staged

KEY = ("target", "key")
SHARDS = 8
MOVES = "target string, key string, ts timestamp_ntz, delta bigint"
WAITING = "ref_table string, target string, key string, period timestamp_ntz, refs bigint"


@dataclass(frozen=True)
class OrphanState:
    """Kept between increments: ``parents`` (``target, key, ts, delta``) and ``waiting`` (``ref_table, target, key, period, refs``)."""

    parents: DataFrame
    waiting: DataFrame
    period: str = "month"


def no_state(spark: SparkSession, period: str = "month") -> OrphanState:
    return OrphanState(spark.createDataFrame([], MOVES), spark.createDataFrame([], WAITING), period)


def period_of(ts: Column, period: str) -> Column:
    return F.date_trunc(period, ts).cast("timestamp_ntz")


def parent_moves(parents: DataFrame) -> DataFrame:
    """``target, key, ts, delta``: +1 where a parent arrives, -1 where it is deleted.

    ``parents`` has ``target, key, loaded_at, deleted_at``. A row without ``loaded_at``, or deleted
    before it was loaded, was never there. Equal rows count once.
    """
    there = parents.select(*KEY, "loaded_at", "deleted_at").distinct().filter(
        F.col("key").isNotNull() & F.col("loaded_at").isNotNull()
        & (F.col("deleted_at").isNull() | (F.col("deleted_at") > F.col("loaded_at")))
    )
    move = F.explode(F.array(
        F.struct(F.col("loaded_at").cast("timestamp_ntz").alias("ts"), F.lit(1).alias("delta")),
        F.struct(F.col("deleted_at").cast("timestamp_ntz").alias("ts"), F.lit(-1).alias("delta")),
    ))
    moves = there.select(*KEY, move.alias("m")).select(*KEY, "m.ts", "m.delta").filter("ts is not null")
    return moves.groupBy(*KEY, "ts").agg(F.sum("delta").alias("delta"))


def living(moves: DataFrame) -> DataFrame:
    """``target, key, since, until``: when a key had a living parent; ``until`` is null while it has one.

    ``moves`` has one row per key and time.
    """
    by_time = Window.partitionBy(*KEY).orderBy("ts")
    alive = F.sum("delta").over(by_time.rowsBetween(Window.unboundedPreceding, 0)) > 0
    turns = moves.withColumn("alive", alive)
    turns = turns.withColumn("before", F.coalesce(F.lag("alive").over(by_time), F.lit(False))).filter("alive <> before")
    ends = turns.withColumn("until", F.lead("ts").over(by_time))
    return ends.filter("alive").select(*KEY, F.col("ts").alias("since"), "until")


def probe(refs: DataFrame, moves: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The rows of ``refs`` whose key had no living parent at their time. At equal times parents move before references probe."""
    spread = refs.withColumn("_shard", F.pmod(F.xxhash64(*[F.col(c) for c in refs.columns]), F.lit(shards)).cast("int"))
    index = living(moves).withColumn("_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    r, i = spread.alias("r"), index.alias("i")
    on = [F.col(f"r.{c}") == F.col(f"i.{c}") for c in (*KEY, "_shard")]
    at = F.col("r.ts").cast("timestamp_ntz")
    return r.join(i, [*on, F.col("i.since") <= at, F.col("i.until").isNull() | (F.col("i.until") > at)], "left_anti").drop("_shard")


def advance(state: OrphanState, refs: DataFrame, moves: DataFrame, keep: bool = True) -> tuple[OrphanState, DataFrame]:
    """(state after what has arrived, the references that came as orphans).

    ``refs`` has ``target, key, ts, ref_table`` and columns of its own, ``moves`` is as from ``parent_moves``: the arrivals and
    deletions of the increment. Increments follow each other in time: what one brings is not
    before what the last one brought, but within an increment rows and moves come in any order. References without
    key or time are left out; repeated ones are all judged alike. Without parents every reference is an orphan. With
    ``keep`` the state is written to the shared folder, so it outlives the increment and the executors that made it.
    """
    refs = refs.filter(F.col("key").isNotNull() & F.col("ts").isNotNull())
    save = staged if keep else lambda df, name: df
    parents = save(state.parents.unionByName(moves.select(*KEY, F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("delta").cast("bigint").alias("delta")))
                   .groupBy(*KEY, "ts").agg(F.sum("delta").alias("delta")), "parents")
    counted = refs.groupBy("ref_table", *KEY, period_of(F.col("ts"), state.period).alias("period")).agg(F.count("*").alias("refs"))
    waiting = state.waiting.unionByName(counted).groupBy("ref_table", *KEY, "period").agg(F.sum("refs").alias("refs"))
    return OrphanState(parents, save(waiting, "waiting"), state.period), probe(refs, parents)


def find_orphans(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """The rows of ``refs`` whose key had no living parent at their time: one advance from nothing; see ``advance``."""
    return advance(no_state(refs.sparkSession), refs, parent_moves(parents), keep=False)[1]


def snapshots(state: OrphanState) -> DataFrame:
    """``ref_table, period, opened_net, open_orphans``: the pending references at each period's end.

    A reference is open while its key has no living parent: arriving parents resolve those that
    wait, deletions reopen them. Only periods in which something changed for a table have a row.
    """
    asked, moves = state.waiting, state.parents
    named = asked.select("ref_table", *KEY).distinct()
    moved = moves.groupBy(*KEY, period_of(F.col("ts"), state.period).alias("period")).agg(F.sum("delta").alias("delta"))
    changes = (
        asked.withColumn("delta", F.lit(0).cast("bigint"))
        .unionByName(moved.join(named, list(KEY)).withColumn("refs", F.lit(0).cast("bigint")))
        .groupBy("ref_table", *KEY, "period").agg(F.sum("refs").alias("refs"), F.sum("delta").alias("delta"))
    )
    by_key = Window.partitionBy("ref_table", *KEY).orderBy("period")
    until = by_key.rowsBetween(Window.unboundedPreceding, 0)
    pending = F.when(F.sum("delta").over(until) <= 0, F.sum("refs").over(until)).otherwise(0)
    net = (
        changes.withColumn("pending", pending)
        .withColumn("change", F.col("pending") - F.coalesce(F.lag("pending").over(by_key), F.lit(0)))
        .groupBy("ref_table", "period").agg(F.sum("change").alias("opened_net"))
    )
    over_time = Window.partitionBy("ref_table").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    return net.withColumn("open_orphans", F.sum("opened_net").over(over_time))


def open_orphans(refs: DataFrame, parents: DataFrame, period: str = "month") -> DataFrame:
    """The snapshots after one advance over all of ``refs`` and ``parents``."""
    return snapshots(advance(no_state(refs.sparkSession, period), refs, parent_moves(parents), keep=False)[0])
