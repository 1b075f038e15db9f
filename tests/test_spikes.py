import duckdb
import numpy as np
import pandas as pd

from gristmill.operators import spikes as S
from gristmill.plans.problem_sql import SQL

from .conftest import day, rows

SCHEMA = "reading_id long, machine string, reading_date timestamp, a double, extra string, block int"


def series(values, machine="M", start=0):
    return [(start + k, machine, day(k), v, "x", 1) for k, v in enumerate(values)]


def flags(spark, data):
    df = spark.createDataFrame(data, SCHEMA)
    return rows(S.flag_readings(df, "machine", "reading_date", "reading_id", ["a"]))


def wave(n, level=0.8, seed=1):
    return np.round(level + np.random.default_rng(seed).normal(0, 0.01, n), 4).tolist()


def test_spike_stuck_and_impossible(spark):
    v = wave(120)
    v[30] = 0.3
    v[60:66] = [0.81] * 6
    v[90], v[95], v[100] = 1.2, -0.1, None
    got = flags(spark, series(v))
    assert got == {(30, "a", "spike"), *((k, "a", "stuck") for k in range(60, 66)), (90, "a", "impossible"), (95, "a", "impossible")}


def test_lasting_change_is_normal_and_adjacent_spikes_are_found(spark):
    v = wave(60) + wave(60, 0.5, 2)
    assert flags(spark, series(v)) == set()
    v[20], v[21] = 0.2, 0.2
    assert flags(spark, series(v)) == {(20, "a", "spike"), (21, "a", "spike")}


def test_percent_machines_and_redelivery(spark):
    v = [round(100 * x, 2) for x in wave(80)]
    v[10] = 0.8
    data = series(v) + series(wave(80), "N", 1000)
    assert flags(spark, data + data) == {(10, "a", "spike")}


def test_year_end_and_missing(spark):
    v = wave(200)
    data = [(k, "M", day(k - 100), x, "x", 1) for k, x in enumerate(v)]
    data[99] = (99, "M", day(-1), 0.1, "x", 1)  # last day of the year
    data += [(500, "M", None, 1.5, "x", 1), (501, None, day(1), 0.5, "x", 1), (502, "M", day(300), None, "x", 1)]
    assert flags(spark, data) == {(99, "a", "spike"), (500, "a", "impossible")}
    assert flags(spark, []) == set()


def brute_details(x):
    """Of each place the largest coefficient over the scale of its level, by the plain definition."""
    best = np.zeros(len(x))
    for level in range(S.LEVELS):
        h = 1 << level
        c = {k: abs(x[k + h : k + 2 * h].mean() - x[k : k + h].mean()) for k in range(len(x) - 2 * h + 1)}
        scale = S.ROBUST * np.median(list(c.values()))
        for k, v in c.items():
            best[k : k + 2 * h] = np.maximum(best[k : k + 2 * h], v / scale)
    return best


def test_candidates_equal_the_definition_and_hold_every_spike():
    rng, tested, spikes = np.random.default_rng(3), 0, 0
    for _ in range(50):
        x = 0.8 + rng.normal(0, 0.01, 150)
        at = int(rng.integers(0, 150))
        x[at] += 0.15
        group = np.zeros(150, dtype=int)
        details = S.haar_details(x, group)
        hit = S.candidates(details, [np.full(150, S.ROBUST * np.nanmedian(d)) for d in details])
        assert (hit == (brute_details(x) > S.CANDIDATE)).all() and hit[at]
        tested, spikes = tested + int(hit.sum()), spikes + 1
    assert spikes < tested < 0.15 * 50 * 150  # the wavelet leaves few values to test
    assert not S.zero_detail_runs(np.array([1.0, 1, 1, 1, 2]), 5).any()
    assert S.zero_detail_runs(np.array([2.0, 1, 1, 1, 1, 1]), 5).tolist() == [False] + [True] * 5
    assert S.zero_detail_runs(np.ones(8), 5, np.array([0] * 4 + [1] * 4)).sum() == 0


def noisy_years():
    rng = np.random.default_rng(8)
    v = np.concatenate([0.7 + rng.normal(0, 0.03, 365), 0.9 + rng.normal(0, 0.004, 366)]).clip(0, 1).round(4)
    v[[50, 200, 400, 500, 501, 700]] = [0.2, 0.99, 0.7, 0.6, 0.61, 0.97]
    v[300:307] = 0.7123
    return v.tolist()


def by_sql(data):
    db = duckdb.connect()
    oee_daily = pd.DataFrame([(r[0], r[1], r[2], r[3], None, None) for r in data], columns=["reading_id", "machine", "reading_date", "availability", "performance", "quality"])
    db.register("oee_daily", oee_daily.astype({"performance": "float64", "quality": "float64"}))
    return {r[0] for r in db.execute(SQL["p2_found"]).fetchall()}


def test_scatter_is_that_of_the_whole_history_however_it_is_cut(spark):
    data = series(noisy_years()) + series(wave(300), "N", 10_000)
    df = spark.createDataFrame(data, SCHEMA)
    want = by_sql(data)
    assert want >= {50, 300, 306, 500}
    for block in (S.BLOCK, 200, 64):
        got = rows(S.flag_readings(df, "machine", "reading_date", "reading_id", ["a"], block=block))
        assert {r[0] for r in got} == want


def test_the_wavelet_decides_what_is_tested(spark):
    """Without candidates nothing is a spike; with all values as candidates nothing more is."""
    df = spark.createDataFrame(series(noisy_years()), SCHEMA)
    flags = lambda c: rows(S.flag_readings(df, "machine", "reading_date", "reading_id", ["a"], candidate=c))
    assert flags(S.CANDIDATE) == flags(-1.0) and {r[2] for r in flags(1e9)} == {"stuck"}


def test_hot_source_nan_and_ties(spark):
    """Many readings of one source on one day, NaN and readings of one day in the order of their ids."""
    rng = np.random.default_rng(1)
    v = (0.8 + rng.normal(0, 0.01, 3000)).round(4)
    v[1500], v[2000] = 0.1, float("nan")
    data = [(k, "H", day(k // 1000), float(x), "x", 1) for k, x in enumerate(v)]
    df = spark.createDataFrame(data, SCHEMA)
    want = {(1500, "a", "spike"), (2000, "a", "impossible")}
    for block in (4096, 300):
        assert rows(S.flag_readings(df, "machine", "reading_date", "reading_id", ["a"], block=block)) == want
