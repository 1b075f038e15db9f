from gristmill.operators import units as U


def test_every_spelling_that_the_distance_accepts_meets_its_name(spark):
    """The index of grams loses nothing: the dictionary is that of all pairs of spelling and name."""
    known = [tuple(r) for r in U.known_units(spark).collect()]
    spelled = {(k, n[:i] + n[i + 1] + n[i] + n[i + 2 :]) for k, n, _, _ in known for i in range(len(n) - 1)}
    spelled |= {(k, n[:i] + n[i + 1 :] + "s") for k, n, _, _ in known for i in range(len(n))} | {(k, n + "en") for k, n, _, _ in known}
    spelled = {(k, s) for k, s in spelled if len(s) > 1}
    want = {}
    for kind, s in spelled:
        exact = [f for k, n, f, _ in known if (k, n) == (kind, s)]
        far = [(U.weighted_distance(s, n), f) for k, n, f, fuzzy in known if k == kind and fuzzy]
        far = [(d, f) for (d, f), n in zip(far, [n for k, n, _, fuzzy in known if k == kind and fuzzy]) if d <= min(max(len(s), len(n)) / 4, max(len(s), len(n)) / 10 + 1)]
        if exact:
            best = set(exact)
        else:
            least = min((d for d, _ in far), default=0)
            best = {f for d, f in far if d < least + U.MARGIN}
        if len(best) == 1 and None not in best:
            want[kind, s] = best.pop()
    got = {(r["kind"], r["spelling"]): r["factor"] for r in U.alias_dictionary(spark.createDataFrame(list(spelled), "kind string, spelling string")).collect()}
    assert got == want and {s for _, s in got} >= {"inhc", "icnh", "weke"}
