import os
import random

import pytest

from gristmill.operators import units as U
from gristmill.plans.problems import p6_found

CASES = {
    "250 mm": 250_000_000, "OAL 430.3 MM": 430_300_000, "L=5,59 cm": 55_900_000, "2,170.2": 2_170_200_000, "1,271": 1_271_000_000, '26-5/8"': 676_275_000,
    "3/4 in": 19_050_000, "Ø.5 in.": 12_700_000, "5' 3\"": 1_600_200_000, "2 ft 6 in": 762_000_000, "± .9 thou": 22_860, "+/-14 µm": 14_000, "+-96 μm": 96_000,
    "+0.042 millimetres/-0.042 millimetres": 42_000, "1.5 metre": 1_500_000_000, "12 milimetres": 12_000_000,
    "H7": None, "ISO 2768-m": None, "DIN 7168 mittel": None, "see drawing": None, "-": None, "": None, "5 furlongs": None, "per 5 mm drawing": None,
}
TIMES = {"5 weeks": 35, "approx. 7 days": 7, "LT 14 days": 14, "9w 6d": 69, "336 hrs": 14, "42": 42, "six weeks": 42, "3 semanas": 21, "6 Wochen": 42, "28 Tage": 28,
         "14 días": 14, "10 week(s)": 70, "9.0 weeks": 63, "on request": None}
SCHEMA = "id string, kind string, text string, described string, extra int"


def convert(spark, data):
    return {tuple(r)[:2]: r["quantity"] for r in U.convert(spark.createDataFrame(data, SCHEMA), ["id"]).select("id", "text", "quantity").collect()}


def test_notations(spark):
    data = [("a", "length", t, None, 1) for t in CASES] + [("a", "time", t, None, 1) for t in TIMES]
    got = convert(spark, data + data)
    assert got == {("a", t): q for t, q in {**CASES, **TIMES}.items() if q is not None}


def test_described_unit_counts_only_without_one(spark):
    got = convert(spark, [("a", "length", "2", "inches", 1), ("b", "length", "2 mm", "inch", 1), ("c", "length", "2", None, 1), ("d", "length", None, "cm", 1)])
    assert got == {("a", "2"): 50_800_000, ("b", "2 mm"): 2_000_000, ("c", "2"): 2_000_000}
    assert convert(spark, []) == {} and convert(spark, [("l", "length", "9" * 100_000 + "x", None, 1)]) == {}


def aliases(spark, spelled, kind="length"):
    df = spark.createDataFrame([(kind, s) for s in spelled], "kind string, spelling string")
    return {r["spelling"]: r["factor"] for r in U.alias_dictionary(df).collect()}


def test_other_spellings_come_through_the_index(spark):
    got = aliases(spark, ["millimetrs", "centimters", "inchs", "mm", "metr", "milimeter", "mikrometer", "zentimeter", "metros", "mtrs", "inches", "mils", "bananas", "zz"])
    assert got == {"millimetrs": 1e6, "milimeter": 1e6, "mm": 1e6, "centimters": 1e7, "zentimeter": 1e7, "inchs": 25.4e6, "inches": 25.4e6, "metr": 1e9,
                   "metros": 1e9, "mtrs": 1e9, "mikrometer": 1e3, "mils": 25_400.0}
    times = aliases(spark, ["days", "wks", "wk", "hrs", "hr", "tage", "tagen", "días", "semaines", "wochen", "stunden", "weeeks", "months", "mins", "years"], "time")
    assert {k: round(1 / v) if v < 1 else v for k, v in times.items()} == {
        "days": 1, "tage": 1, "tagen": 1, "días": 1, "wks": 7, "wk": 7, "semaines": 7, "wochen": 7, "weeeks": 7, "hrs": 24, "hr": 24, "stunden": 24}


def test_other_units_are_never_taken_for_known_ones(spark):
    got = aliases(spark, ["kilometres", "kilometer", "miles", "picometers", "nanometre", "femtometres", "yards", "diameter", "parameter", "nm", "megametre"])
    assert got == {"kilometres": 1e12, "kilometer": 1e12, "miles": 1609.344e9, "yards": 914.4e6}


def misspelt(name, rng):
    """One slip: two letters swapped, one doubled, left out or replaced."""
    k = rng.randrange(1, len(name) - 1)
    swap = name[:k] + name[k + 1] + name[k] + name[k + 2 :]
    other = name[:k] + rng.choice("aeiourtnsl") + name[k + 1 :]
    return rng.choice([swap, name[:k] + name[k] + name[k:], name[:k] + name[k + 1 :], other])


def test_held_out_misspellings(spark):
    """Slips in full names, plurals included, none of which the lists hold: nine in ten come out, none as another unit."""
    rng = random.Random(11)
    names = {"millimetre": 1e6, "millimeters": 1e6, "centimetres": 1e7, "centimeter": 1e7, "micrometre": 1e3, "microns": 1e3, "metres": 1e9, "inches": 25.4e6, "pulgadas": 25.4e6}
    want = {s: f for n, f in names.items() for s in {misspelt(n, rng) for _ in range(25)} - set(names)}
    got = aliases(spark, list(want))
    assert sum(got.get(s) == f for s, f in want.items()) >= 0.9 * len(want) and not [s for s in got if got[s] != want[s]]
    want = {s: 7.0 for n in ("weeks", "wochen", "semanas", "semaines", "settimana") for s in {misspelt(n, rng) for _ in range(25)} - {n}}
    got = aliases(spark, list(want), "time")
    assert sum(got.get(s) == f for s, f in want.items()) >= 0.9 * len(want) and not [s for s in got if got[s] != want[s]]


@pytest.mark.parametrize("gone", (0, 1))
def test_the_index_carries_the_load(spark, monkeypatch, gone):
    """With every second name taken out of the list nearly all given texts still come out, by way of the rest."""
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    whole = p6_found(spark, sf).count()
    monkeypatch.setattr(U, "NAMES", {kind: dict(list(of.items())[gone::2]) for kind, of in U.NAMES.items()})
    assert p6_found(spark, sf).count() >= 0.98 * whole


def test_weighted_distance():
    far = U.weighted_distance
    assert far("week", "week") == 0 and far("weeek", "week") == 0.5 and far("wekes", "weeks") == 0.5 and far("abc", "xyz") >= 2.5
    assert far("wks", "week") == 0.75 and far("tagen", "tag") == 0.5 and far("kilometre", "millimetre") > 1
