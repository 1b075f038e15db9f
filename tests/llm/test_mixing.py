import random

import pytest

from gristmill.llm import mixing as M

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def test_routing_fills_quotas_and_repeats_last():
    patterns = [(("a",), 1000), (("b",), 100), (("a", "b"), 200), ((), 50)]
    quota, given = M.route(patterns, [("a", 0.5, 1), ("b", 0.4, 2), ("c", 0.1, 3)])
    assert quota == {"a": 650, "b": 520, "c": 130}
    assert sum(f for (_, s), f in given.items() if s == "a") == 650
    # all that b can have: its own 100 twice and the shared 200 twice, short of the quota by nothing
    assert sum(f for (_, s), f in given.items() if s == "b") == 520
    assert all(f <= size * (1 if s == "a" else 2) for (p, s), f in given.items() for q, size in patterns if q == p)
    assert M.route([], [("a", 1.0, 1)]) == ({"a": 0}, {})


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choices(["alpha", "beta", "gamma"], k=rng.randrange(1, 60))), rng.choice("aaaab")) for k in range(600)]
    rows += [(1000, None, "a"), (1001, "", "b"), (1002, "no source", None), (1003, "elsewhere", "z"), (1004, "word " * 3000, "a")]
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, n_tokens int, rest int")


def test_mix(spark, docs):
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 2), ("none", 0.1, 4)], "source string, target_share double, max_repeats long")
    chosen, report = M.mix(docs, targets, ranks_file=RANKS, seed=1)
    got = {r["source"]: r for r in report.collect()}
    assert set(got) == {"a", "b", "none"} and got["none"]["mixed_tokens"] == 0
    rows = chosen.collect()
    for s, most in (("a", 1), ("b", 2)):
        mine = [r for r in rows if r["source"] == s]
        assert all(1 <= r["repeats"] <= most for r in mine) and sum(r["n_tokens"] * r["repeats"] for r in mine) == got[s]["mixed_tokens"]
        assert len({r["doc_id"] for r in mine}) == len(mine)
    assert abs(got["a"]["mixed_tokens"] - got["a"]["quota_tokens"]) <= 1500  # half of the longest document
    assert got["b"]["most_repeats"] == 2 and abs(sum(r["actual_share"] for r in got.values()) - 1) < 1e-9
    again = M.mix(docs, targets, ranks_file=RANKS, seed=1)[0]
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in rows}
    other = M.mix(docs, targets, ranks_file=RANKS, seed=2)[0]
    assert {tuple(r) for r in other.collect()} != {tuple(r) for r in rows}


def test_empty(spark, docs):
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats long")
    chosen, report = M.mix(docs.limit(0), targets, ranks_file=RANKS)
    assert chosen.count() == 0 and report.first()["mixed_tokens"] == 0
    chosen, report = M.mix(docs, targets.limit(0), ranks_file=RANKS)
    assert chosen.count() == 0 and report.count() == 0


def test_tokens_are_those_of_the_vocabulary(spark, docs):
    one = M.with_tokens(spark.createDataFrame([("hello world",), (None,), ("",)], "text string"), "text", RANKS)
    assert [r["n_tokens"] for r in one.collect()] == [2, 0, 0]
