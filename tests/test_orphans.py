import random

from pyspark.sql import functions as F

from gristmill.operators import orphans as O
from gristmill.streaming.orphans import kept_state, opened, track

from .conftest import day, rows

REFS = "target string, key string, ts timestamp, ref_table string, row_key string, alive int"
PARENTS = "target string, key string, loaded_at timestamp, deleted_at timestamp"


def brute(refs, parents):
    def lives(r):
        return any(p[:2] == r[:2] and p[2] and p[2] <= r[2] and (not p[3] or p[3] > r[2]) for p in parents)

    return {(*r[:3], *r[3:]) for r in refs if r[1] and r[2] and not lives(r)}


def test_against_brute_force(spark):
    rng = random.Random(5)
    parents = [("p", f"K{rng.randrange(30)}", day(rng.randrange(200)), None if rng.random() < 0.5 else day(rng.randrange(250))) for _ in range(60)]
    parents += parents[:10] + [("p", "K1", None, None), ("p", None, day(1), None)]
    # a third of all references name one key
    refs = [("p", "K3" if rng.random() < 0.3 else f"K{rng.randrange(40)}", day(rng.randrange(220)), "t", f"r{k}", 1) for k in range(400)]
    refs += refs[:20] + [("p", None, day(1), "t", "x", 1), ("p", "K1", None, "t", "y", 1), ("p", "K50", day(3), "t", None, None)]
    got = O.find_orphans(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS))
    assert rows(got) == brute(refs, parents) and got.count() >= len(brute(refs, parents))
    for shards in (1, 3):
        assert rows(O.probe(spark.createDataFrame(refs, REFS).filter("key is not null and ts is not null"), O.parent_moves(spark.createDataFrame(parents, PARENTS)), shards)) == brute(refs, parents)


def history(rng):
    parents = [("p", f"K{rng.randrange(12)}", day(rng.randrange(120)), None if rng.random() < 0.4 else day(rng.randrange(150))) for _ in range(60)]
    refs = [("p", f"K{rng.randrange(14)}", day(rng.randrange(150)), rng.choice("tu"), f"r{k}", 1) for k in range(300)]
    return refs, parents


def test_increments_equal_one_advance(spark):
    """Three increments, the state kept between them, give the orphans and snapshots of one, and of the whole history at once."""
    refs, parents = history(random.Random(3))
    refs, moves = spark.createDataFrame(refs, REFS), O.parent_moves(spark.createDataFrame(parents, PARENTS))
    once, found = O.advance(O.no_state(spark), refs, moves)
    state, parts = O.no_state(spark), set()
    for lo, hi in ((-1, 40), (40, 41), (41, 400)):
        part = lambda df: df.filter((F.col("ts") >= F.lit(day(lo))) & (F.col("ts") < F.lit(day(hi))))  # noqa: B023, E731
        state, opened = O.advance(state, part(refs), part(moves))
        parts |= rows(opened)
    assert parts == rows(found) != set()
    assert rows(O.snapshots(state)) == rows(O.snapshots(once)) == rows(O.open_orphans(refs, spark.createDataFrame(parents, PARENTS)))


def test_stream_equals_one_advance(spark, tmp_path):
    """The same history as a stream of three files, each with several events of a key in no order."""
    rng = random.Random(6)
    refs, parents = history(rng)
    moves = [(*tuple(r)[:3], "parent" if r["delta"] > 0 else "deleted", None, None) for r in O.parent_moves(spark.createDataFrame(parents, PARENTS)).collect() for _ in range(abs(r["delta"]))]
    events = [(*r[:3], "ref", *r[3:5]) for r in refs] + moves
    rng.shuffle(events)
    schema = "target string, key string, ts timestamp_ntz, kind string, ref_table string, ref_id string"
    for n, (lo, hi) in enumerate(((-1, 50), (50, 90), (90, 400))):
        part = [e for e in events if day(lo) <= e[2] < day(hi)]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        track(stream, str(tmp_path / "home")).awaitTermination()
    state, found = O.advance(O.no_state(spark), spark.createDataFrame(refs, REFS), O.parent_moves(spark.createDataFrame(parents, PARENTS)))
    assert {tuple(r)[4] for r in opened(spark, str(tmp_path / "home")).collect()} == {r["row_key"] for r in found.collect()}
    assert rows(O.snapshots(kept_state(spark, str(tmp_path / "home")))) == rows(O.snapshots(state))


def test_moves_come_before_references_of_the_same_time(spark):
    parents = spark.createDataFrame([("p", "A", day(5), day(9))], PARENTS)
    refs = [("p", "A", day(d), "t", str(d), 1) for d in (4, 5, 8, 9)]
    assert {r[4] for r in O.find_orphans(spark.createDataFrame(refs, REFS), parents).collect()} == {"4", "9"}


def test_snapshots_resolve_and_reopen(spark):
    parents = spark.createDataFrame([("p", "A", day(40), day(70))], PARENTS)  # there in February only
    refs = spark.createDataFrame([("p", "A", day(3), "t", "1", 1), ("p", "A", day(45), "t", "2", 1), ("p", "B", day(100), "t", "3", 1)], REFS)
    got = {(r["period"].month, r["opened_net"], r["open_orphans"]) for r in O.open_orphans(refs, parents).collect()}
    assert got == {(1, 1, 1), (2, -1, 0), (3, 2, 2), (4, 1, 3)}


def test_empty(spark):
    refs, parents = spark.createDataFrame([("p", "A", day(1), "t", "1", 1)], REFS), spark.createDataFrame([], PARENTS)
    assert O.find_orphans(refs, parents).count() == 1
    assert O.find_orphans(refs.limit(0), parents).count() == 0 and O.open_orphans(refs.limit(0), parents).count() == 0
