"""Implausible readings: spikes, stuck values and impossible values, judged per source.

Each source's series is taken apart with an undecimated Haar wavelet. Detail coefficients are held
against their robust scale over the source's whole history; only values under a large coefficient
of some level are candidates and are checked against the sound values around them. Runs of zero detail
are sticking; bounds find impossible readings.

Readings are numbered per source through counts of short spans of days, cut into blocks of bounded
size with some neighbours on either side, and worked on twice: once for the statistics of each
source, which Spark aggregates over all its blocks, and once to judge. So neither a long history nor
a source with very many readings is ever one group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

LEVELS = 3
CANDIDATE = 3.0  # times the robust scale of a level's details
ROBUST = 1.5  # times the median absolute deviation
SPAN = 8  # days of a source that are numbered together
BLOCK, HALO = 4096, 128  # readings of a block, and of its neighbours on either side
PLACES = 6  # decimals of the full scale to which deviations are counted


def zero_detail_runs(x: np.ndarray, least: int, group: np.ndarray | None = None) -> np.ndarray:
    """Members of runs of ``least`` or more equal values: runs of zero detail at the finest level."""
    if not len(x):
        return np.zeros(0, dtype=bool)
    other = x[1:] != x[:-1]
    if group is not None:
        other |= group[1:] != group[:-1]
    edges = np.concatenate([[0], np.flatnonzero(other) + 1, [len(x)]])
    return np.repeat(np.diff(edges) >= least, np.diff(edges))


def haar_details(s: np.ndarray, group: np.ndarray, levels: int = LEVELS) -> list[np.ndarray]:
    """For each level the absolute coefficient that ends at each place; NaN where its support leaves the group."""
    total, out = np.concatenate([[0.0], np.cumsum(s)]), []
    for level in range(levels):
        half = 1 << level
        detail = np.full(len(s), np.nan)
        if len(s) >= 2 * half:
            mean = (total[half:] - total[:-half]) / half
            inside = group[2 * half - 1 :] == group[: len(s) - 2 * half + 1]
            detail[2 * half - 1 :][inside] = np.abs(mean[half:] - mean[:-half])[inside]
        out.append(detail)
    return out


def candidates(details: list[np.ndarray], scales: list[np.ndarray], times: float = CANDIDATE) -> np.ndarray:
    """Places that lie under a coefficient above ``times`` the robust scale of its level."""
    n = len(details[0])
    cover = np.zeros(n + 1, dtype=np.int64)
    for level, (detail, scale) in enumerate(zip(details, scales)):
        with np.errstate(invalid="ignore"):
            ends = np.flatnonzero(detail > times * scale)
        np.add.at(cover, ends - (2 << level) + 1, 1)
        np.add.at(cover, ends + 1, -1)
    return np.cumsum(cover[:n]) > 0


def _medians(s: np.ndarray, group: np.ndarray, at: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(median, number) of the values at ``at + steps`` of the same group."""
    places = at[:, None] + steps
    inside = (places >= 0) & (places < len(s))
    places = np.clip(places, 0, max(len(s) - 1, 0))
    inside &= group[places] == group[at][:, None]
    held = np.sort(np.where(inside, s[places], np.inf), axis=1)
    n = inside.sum(axis=1)
    row = np.arange(len(at))
    return (held[row, np.maximum(n - 1, 0) // 2] + held[row, np.minimum(n // 2, held.shape[1] - 1)]) / 2, n


def levels_of(s: np.ndarray, group: np.ndarray, reach: int) -> np.ndarray:
    """The running median of ``reach`` values each way, fewer at a group's ends."""
    return _medians(s, group, np.arange(len(s)), np.arange(-reach, reach + 1))[0]


def distances(s: np.ndarray, group: np.ndarray, at: np.ndarray, reach: int) -> np.ndarray:
    """How far the values at ``at`` stand from the nearest median of what is before, after and around them (three values at least); else 0."""
    before, after = np.arange(-reach, 0), np.arange(1, reach + 1)
    far = np.full(len(at), np.inf)
    for steps in (before, after, np.concatenate([before, after])):
        middle, n = _medians(s, group, at, steps)
        enough = n >= 3
        far[enough] = np.minimum(far[enough], np.abs(s[at] - middle)[enough])
    return np.where(np.isinf(far), 0.0, far)


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of a sorted partition cut so that each group (``g``) is whole."""
    held = None
    for batch in chain(batches, [None]):
        if batch is not None:
            held = batch if held is None or not len(held) else pd.concat([held, batch], ignore_index=True)
            g = held["g"].to_numpy()
            whole = len(held) - 1 - int(np.argmax(g[::-1] != g[-1])) + 1 if len(held) and (g != g[-1]).any() else 0
            ready, held = held.iloc[:whole], held.iloc[whole:]
        else:
            ready = held
        if ready is not None and len(ready):
            yield ready


def _group_numbers(rows: pd.DataFrame) -> np.ndarray:
    g = rows["g"].to_numpy()
    return np.concatenate([[0], np.cumsum(g[1:] != g[:-1])])


def _group_medians(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The median of each group's values but for NaN, which a group without any has."""
    if not len(group):
        return np.zeros(0)
    edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    held = values[np.lexsort((values, group))]  # NaN comes last
    n = np.add.reduceat(~np.isnan(values), edges)
    return (held[edges + np.maximum(n - 1, 0) // 2] + held[np.minimum(edges + n // 2, len(held) - 1)]) / 2 * np.where(n, 1.0, np.nan)


def _per_metric(rows: pd.DataFrame, n: int, run: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each metric: number, places of its values, impossible, stuck, places of the sound ones and their group."""
    group = _group_numbers(rows)
    full = rows["full"].to_numpy("float64")
    for k in range(n):
        v = rows[f"m{k}"].to_numpy("float64")
        at = np.flatnonzero(~np.isnan(v))
        x = v[at]
        wrong = ~((x >= 0) & (x <= full[at]))
        stuck = zero_detail_runs(x, run, group[at])
        sound = at[~wrong & ~stuck]
        yield k, at, wrong, stuck, sound, group[sound]


def _numbered(rows: DataFrame, metrics: int) -> DataFrame:
    """``rows`` (each once) beside ``pos`` within their source, its number of rows (``of``) and its ``full`` scale."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    day = F.datediff("day", F.lit("1970-01-01").cast("date"))
    rows = rows.withColumn("span", F.coalesce(F.floor(day / SPAN), F.lit(-(1 << 40)))).withColumn("h", F.xxhash64("src", "span"))
    rows = rows.repartition(n, "h").distinct()  # the hash comes first wherever rows are put in order, as names differ late
    order = Window.partitionBy("h", "src", "span").orderBy("day", "rid")
    values = [F.col(f"m{k}") for k in range(metrics)]
    finite = [F.when(v < float("inf"), v) for v in values]
    add = lambda cols: reduce(lambda a, b: a + b, cols)
    low, high = [F.when(v <= 1.5, v) for v in finite], [F.when(v > 1.5, v) for v in finite]
    most = lambda f, cols: f(*cols) if len(cols) > 1 else cols[0]
    spans = rows.groupBy("h", "src", "span").agg(
        F.count("*").alias("rows"), F.sum(add([v.isNotNull().cast("int") for v in finite])).alias("n"), F.sum(add([v.isNotNull().cast("int") for v in high])).alias("above"),
        F.max(most(F.greatest, low)).alias("low"), F.min(most(F.least, high)).alias("high"),
    )
    before = Window.partitionBy("src").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("src")
    n_all, above = F.sum("n").over(whole), F.sum("above").over(whole)
    percent = (above * 2 > n_all) | (above * 2 == n_all) & (n_all > 0) & (F.max("low").over(whole) + F.min("high").over(whole) > 3.0)
    starts = spans.select("h", "src", "span", F.sum("rows").over(whole).alias("of"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"), F.when(percent, 100.0).otherwise(1.0).alias("full"))
    placed = rows.withColumn("n", F.row_number().over(order)).join(starts, ["h", "src", "span"])
    return placed.select("rid", "src", "day", *values, "full", "of", (F.col("start") + F.col("n") - 1).alias("pos"))


def flag_readings(df: DataFrame, source: str, day: str, row_id: str, metrics: Sequence[str], *,
                  reach: int = 9, times: float = 8.0, run: int = 5, candidate: float = CANDIDATE, block: int = BLOCK) -> DataFrame:
    """``row_id, metric, verdict`` of each value that is impossible, stuck or a spike.

    ``reach`` sound values each way are a value's surroundings, ``times`` the scatter it may stand apart,
    ``run`` the number of equal values in a row that count as stuck, ``candidate`` times its scale a wavelet
    coefficient that makes the values under it candidates. A source whose median is above
    1.5 reports percent (full scale 100), any other a fraction (full scale 1). The scatter of a source and metric and the scales
    of its coefficients are those of its whole history, counted in steps of a millionth of the full scale, so that
    they are exact for readings of so many decimals and a source has a bounded number of steps.

    Equal rows count once. Values that are null are left out, NaN is impossible; rows without a
    date are only held against the bounds; rows without a source form one source. Surroundings and runs are sought among
    the ``HALO`` readings beside a block. Only the named columns are read.
    """
    metrics, m = list(metrics), len(metrics)
    value = lambda c: F.when(F.isnan(F.col(c).cast("double")), float("inf")).otherwise(F.col(c).cast("double"))
    src = F.when(F.col(source).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(source).cast("string")))
    rows = df.select(F.col(row_id).alias("rid"), src.alias("src"), F.col(day).cast("date").alias("day"),
                     *[value(c).alias(f"m{k}") for k, c in enumerate(metrics)])
    placed = _numbered(rows, m)
    undated = placed.filter("day is null").select("rid", F.explode(F.array(*[
        F.struct(F.lit(name).alias("metric"), F.col(f"m{k}").alias("x"), F.col("full")) for k, name in enumerate(metrics)])).alias("v"))
    undated = undated.filter("not (v.x >= 0 and v.x <= v.full)").select("rid", "v.metric", F.lit("impossible").alias("verdict"))

    own, within = F.floor(F.col("pos") / block), F.col("pos") % block
    copies = F.array_compact(F.array(own, F.when((within < HALO) & (own > 0), own - 1), F.when(within >= block - HALO, own + 1)))
    blocks = placed.filter("day is not null").withColumn("block", F.explode(copies)).withColumn("own", own == F.col("block"))
    mark = F.right(F.hex(F.xxhash64("src", "block")), F.lit(8))  # eight letters by which names in a sort differ at once
    name = F.concat_ws("/", mark, F.col("block").cast("string"), "src")
    blocks = blocks.withColumn("g", name)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = blocks.select("g", "src", "of", "rid", "pos", "own", "full", *[f"m{k}" for k in range(m)]).repartition(n, "g")
    parts = [f"{part}{k}" for k in range(m) for part in ("dev", *(f"c{h}_" for h in range(LEVELS)))]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _groups(batches):
            own, full = rows["own"].to_numpy(bool), rows["full"].to_numpy("float64")
            out: dict[str, np.ndarray] = {}
            for k, _, _, _, sound, group in _per_metric(rows, m, run):
                s = rows[f"m{k}"].to_numpy("float64")[sound]
                for part, values in zip(("dev", *(f"c{h}_" for h in range(LEVELS))), [np.abs(s - levels_of(s, group, reach)), *haar_details(s, group)]):
                    column = np.full(len(rows), np.nan)
                    column[sound] = np.round(values / full[sound], PLACES)
                    out[f"{part}{k}"] = column[own]
            group = _group_numbers(rows)[own]
            src, of = rows["src"].to_numpy()[own], rows["of"].to_numpy()[own]
            alone = of <= block
            first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]] & alone) if len(group) else np.zeros(0, dtype=int)
            whole = {part: _group_medians(values[alone], group[alone]) for part, values in out.items()}
            yield pd.DataFrame({"src": src[first], "of": of[first], **whole})
            yield pd.DataFrame({"src": src[~alone], "of": of[~alone], **{part: values[~alone] for part, values in out.items()}})

    # the medians of a source that is one block are taken there, those of others over all their values
    measured = blocks.sortWithinPartitions("g", "pos").mapInPandas(measure, "src string, of bigint, " + ", ".join(f"{p} double" for p in parts))
    scales = measured.groupBy("src").agg(F.max("of").alias("of"), *[(F.median(p) * ROBUST).alias(p) for p in parts])
    of_block = scales.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("of") - 1) / block)))).select(name.alias("g"), *parts)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _groups(batches):
            own, rid, full = rows["own"].to_numpy(bool), rows["rid"].to_numpy(), rows["full"].to_numpy("float64")
            found: list[tuple[np.ndarray, str, str]] = []
            for k, at, wrong, stuck, sound, group in _per_metric(rows, m, run):
                s, scale = rows[f"m{k}"].to_numpy("float64")[sound], full[sound]
                hit = candidates(haar_details(s, group), [rows[f"c{h}_{k}"].to_numpy("float64")[sound] * scale for h in range(LEVELS)], candidate)
                test = np.flatnonzero(hit & own[sound])
                far = distances(s, group, test, reach) > times * rows[f"dev{k}"].to_numpy("float64")[sound[test]] * scale[test]
                found += [(sound[test[far]], metrics[k], "spike"), (at[stuck & ~wrong], metrics[k], "stuck"), (at[wrong], metrics[k], "impossible")]
            for places, metric, verdict in found:
                places = places[own[places]]
                if len(places):
                    yield pd.DataFrame({"rid": rid[places], "metric": metric, "verdict": verdict})

    id_type = df.schema[row_id].dataType.simpleString()
    # both passes read the same exchange, so neither may leave out a column of it
    judged = blocks.join(of_block, "g", "left").sortWithinPartitions("g", "pos").mapInPandas(judge, f"rid {id_type}, metric string, verdict string")
    return judged.unionByName(undated).withColumnRenamed("rid", row_id)
