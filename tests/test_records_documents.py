import pytest
from pyspark.sql import functions as F

from gristmill.operators import documents as D, records as R

from .conftest import day, rows


def test_upsert_latest_wins(spark):
    now = spark.createDataFrame([("a", 1, "old"), ("b", 5, "kept")], "k string, v int, x string")
    new = spark.createDataFrame([("a", 2, "new"), ("b", 4, "late"), ("c", 1, "first"), ("b", 5, "tie")], "k string, v int, x string")
    assert rows(R.upsert(now, new, ["k"], "v")) == {("a", 2, "new"), ("b", 5, "tie"), ("c", 1, "first")}
    assert rows(R.upsert(now.limit(0), new.limit(0), ["k"], "v")) == set()


def test_versions_and_survivors(spark):
    df = spark.createDataFrame([("s", day(1), 1), ("s", day(1), 2), ("s", day(9), 3), ("t", None, 4)], "k string, d timestamp, n int")
    got = {(r["n"], r["version"], r["is_current"]) for r in R.versions(df, "k", ["d", "n"]).collect()}
    assert got == {(1, 1, False), (2, 2, False), (3, 3, True), (4, 1, True)}
    assert {r["n"] for r in R.survivors(df, ["k"], [F.desc("n")]).collect()} == {3, 4}


def test_collapse_conflicts_claims(spark):
    df = spark.createDataFrame([("a", 1, "x", None), ("a", 2, None, "l1"), ("a", 3, "z", "l2")], "k string, o int, name string, lead string")
    got = R.collapse(df.withColumn("raw", F.col("lead")), "k", F.col("o"), ["name"], ["lead"], ["raw"]).first()
    assert (got["name"], got["lead"], got["raw_values"]) == ("x", "l2", ["l1", "l2"])
    assert rows(R.conflicts(df, ["k"], "name")) == {("a", 2, "x", "z")}
    claims = spark.createDataFrame([("a", 12.0), ("b", 1.0), ("c", 3.0)], "k string, claimed double")
    facts = spark.createDataFrame([("a", 12.00001), ("b", 2.0)], "k string, value double")
    assert {(r["k"], r["verified"]) for r in R.verify(claims, facts, "k").collect()} == {("a", True), ("b", False), ("c", False)}
    assert rows(R.absent(claims.select("k"), facts, ["k"])) == {("c",)}


def test_lookups_votes_and_first_typing(spark):
    df = spark.createDataFrame([(1, "Ab ", None), (2, "ab", "x"), (3, None, "x"), (4, "c", "y")], "id int, t string, v string")
    assert rows(R.where_equal(df, v=None)) == {(1, "Ab ", None)}
    assert {r["id"] for r in R.first_typing(df, "t", F.col("id")).collect()} == {1, 3, 4}
    assert rows(R.majority(df.withColumn("g", F.lit("g")), "g", "v")) == {("g", "x", 3, False)}
    refs = spark.createDataFrame([("AB",)], "ref string")
    assert {r["id"] for r in R.referencing(df, refs, ["t", "v"]).collect()} == {1, 2}


@pytest.mark.parametrize("text", ["a\n\nb", "x" * 3000, "p " * 700 + "\n\n" + "q" * 1300 + "\n\nend", "", "\n\n\n"])
def test_chunks_keep_everything_in_order(text):
    got = D.cut_chunks(text, 1200, 150)
    assert all(0 < len(c) <= 1200 for c in got)
    at = 0
    for c in got:
        for piece in c.split("\n\n"):
            found = text.find(piece, max(0, at - 150))
            assert 0 <= found <= at + 4
            at = found + len(piece)
    assert at >= len(text.rstrip())


def test_classes_and_phrases(spark):
    label, n = D.classify(F.col("t"), [("pump", "pump"), ("oven", "oven|heat")])
    df = spark.createDataFrame([("Pump pump oven",), ("heat pump",), ("nothing",), (None,)], "t string")
    assert [tuple(r) for r in df.select(label, n).collect()] == [("pump", 2), ("pump", 1), ("uncategorized", 0), ("uncategorized", 0)]
    docs = spark.createDataFrame([(1, "The Bolt & Co. AG wrote."), (2, "bolt co"), (3, None)], "doc_id long, text string")
    names = spark.createDataFrame([("bolt & co. ag", "S1"), ("bolt co", "S2"), ("wrote", "S3")], "alias string, id string")
    assert rows(D.phrases_in(docs, names)) == {(1, "bolt & co. ag", "S1"), (1, "bolt co", "S2"), (1, "wrote", "S3"), (2, "bolt co", "S2")}
