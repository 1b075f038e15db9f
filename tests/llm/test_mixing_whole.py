import itertools

from gristmill.llm import mixing as M

from .test_mixing import RANKS


def test_unnamed_sources_do_not_count_as_patterns(spark, monkeypatch):
    monkeypatch.setattr(M, "MAX_PATTERNS", 3)
    rows = [(k, "some words", ["a", f"host{k}"] if k % 2 else [f"host{k}"]) for k in range(40)]
    docs = spark.createDataFrame([*rows, (50, "more words", ["b", "a", "b"]), (51, "more words", ["b", None])], "doc_id long, text string, source array<string>")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats long")
    chosen, report = M.mix(docs, targets, ranks_file=RANKS)
    got = {r["source"]: r for r in report.collect()}
    assert got["a"]["quota_tokens"] == got["a"]["mixed_tokens"] == got["b"]["quota_tokens"] == 22 and got["b"]["mixed_tokens"] == 4
    assert {r["doc_id"] for r in chosen.collect()} <= {*range(1, 40, 2), 50, 51}


def test_overlapping_sources_on_spark(spark):
    """Documents of several sources fill what their sources lack; no document is used more often than its source allows."""
    rows = [(k, "some words here", s) for k, s in enumerate([["a"]] * 40 + [["b"]] * 5 + [["a", "b"]] * 15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source array<string>")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], "source string, target_share double, max_repeats long")
    chosen, report = M.mix(docs, targets, ranks_file=RANKS)
    got = {r["source"]: r for r in report.collect()}
    assert got["a"]["mixed_tokens"] == got["a"]["quota_tokens"] == got["b"]["quota_tokens"] == got["b"]["mixed_tokens"] == 90
    uses = {(r["doc_id"], r["source"]): r["repeats"] for r in chosen.collect()}
    assert all(n <= (1 if s == "a" else 2) for (_, s), n in uses.items()) and {d for d, s in uses if s == "b"} <= set(range(40, 60))


def test_many_repeats_are_one_arc():
    quota, given = M.route([(("a",), 10), (("b",), 10_000)], [("a", 0.5, 10**9), ("b", 0.5, 1)])
    assert quota == {"a": 5005, "b": 5005} and given == {(("a",), "a"): 5005, (("b",), "b"): 5005}


def test_least_cost_by_enumeration():
    """On small cases the routed repeats cost no more than the best of all ways."""
    patterns, targets = [(("a",), 2), (("a", "b"), 3), (("b", "c"), 2)], [("a", 0.4, 3), ("b", 0.3, 3), ("c", 0.3, 3)]
    quota, given = M.route(patterns, targets)
    price = lambda flow, unit: sum(k // unit for k in range(flow))
    size = dict(patterns)
    cost = sum(price(f, size[p]) for (p, _), f in given.items())
    arcs = list(given)
    best = None
    for flows in itertools.product(*[range(0, quota[s] + 1) for _, s in arcs]):
        if all(sum(f for f, (_, s) in zip(flows, arcs) if s == t) == sum(f for (_, s), f in given.items() if s == t) for t in quota):
            if all(f <= 3 * size[p] for f, (p, _) in zip(flows, arcs)):
                c = sum(price(f, size[p]) for f, (p, _) in zip(flows, arcs))
                best = c if best is None else min(best, c)
    assert cost == best
