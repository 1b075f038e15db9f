from gristmill.operators import documents as D, graph as G, records as R, search as S

from .conftest import rows


def test_floor_is_kept_and_each_document_counts_once(spark):
    schema = "query_id string, doc_id long, rank int"
    sure = spark.createDataFrame([("q", 1, 1), ("q", 2, 2), ("q", 3, 3), ("r", 9, 1)], schema)
    again = spark.createDataFrame([("q", 4, 1), ("q", 2, 2), ("q", 5, 3)], schema)
    assert rows(S.floor_union(sure, again, 2, 4)) == {("q", 1, 1, "floor"), ("q", 2, 2, "floor"), ("q", 4, 3, "reranked"), ("q", 5, 4, "reranked"), ("r", 9, 1, "floor")}
    assert rows(S.floor_union(sure.limit(0), again, 2, 1)) == {("q", 4, 1, "reranked")}


def test_best_branch(spark):
    a = spark.createDataFrame([("q", 1, 0.9), ("q", 2, 0.9)], "query_id string, doc_id long, score double")
    b = spark.createDataFrame([("q", 2, 0.8), ("q", 3, 0.8), ("q", 1, None)], a.schema)
    assert rows(S.best_branch([a, b])) == {("q", 1, 0.9), ("q", 2, 0.9), ("q", 3, 0.8)}


EDGES = [("a", "X", "b"), ("b", "X", "c"), ("c", "X", "d"), ("b", "X", "e"), ("e", "X", "d"), ("z", "X", None)]


def test_walk_scores_and_first_meeting(spark):
    edges = spark.createDataFrame(EDGES, "src string, rel string, dst string")
    seeds = spark.createDataFrame([("a",), ("c",)], "seed string")
    assert rows(G.walk_scores(G.reach(edges, seeds, 3))) == {("a", 1.0), ("c", 1.0), ("b", 1.0), ("d", 1.0), ("e", 0.5)}
    starts, goals = spark.createDataFrame([("a",), ("d",), ("z",)], "src string"), spark.createDataFrame([("d",), ("e",), ("b",)], "id string")
    assert rows(G.first_meeting(edges, starts, goals.filter("id <> 'b'"), 3)) == {("a", "e", 2, "a>b>e"), ("d", "e", 1, "d>e")}
    assert rows(G.first_meeting(edges, starts, goals.limit(0), 3)) == set()


def test_hops_either_way(spark):
    edges = spark.createDataFrame(EDGES, "src string, rel string, dst string")
    hops = spark.createDataFrame([("b", "a", 1), ("a", "c", 2), (None, "a", 3), ("a", "b", 4)], "src string, dst string, n int")
    assert {r["n"]: r["verified"] for r in G.verified_hops(hops, edges).collect()} == {1: True, 2: False, 3: False, 4: True}


def test_edges_of_any_table(spark):
    data = [("x", "prt\u20111 old", "see MCH-30 and MCH-31", 5), ("PRT-22", "WO-10", None, 6), (None, None, "nothing", 7), (None, "WO-11", "MCH-30", 8)]
    df = spark.createDataFrame([("PRT-20" if d[0] == "x" else d[0], *d[1:]) for d in data], "part_id string, note string, used string, n int")
    assert rows(G.edges_of_table(df)) == {("PRT-20", "USED", "MCH-30"), ("PRT-20", "USED", "MCH-31"), ("PRT-22", "NOTE", "WO-10"), ("WO-11", "USED", "MCH-30")}
    assert G.edges_of_table(df.limit(0)).count() == 0


def test_only_what_stands_in_the_text_is_kept(spark):
    texts = spark.createDataFrame([(1, "A-1 with B-2"), (2, None), (3, "B-2")], "doc_id long, text string")
    entities = spark.createDataFrame([(1, "A-1"), (1, "B-2"), (1, "C-3"), (1, ""), (2, "A-1"), (3, "B-2"), (3, "A-1"), (1, None)], "doc_id long, entity string")
    links = spark.createDataFrame([(1, "A-1", "B-2"), (1, "A-1", "A-1"), (1, "A-1", "C-3"), (3, "B-2", "A-1"), (1, "A-1", "B-2")], "doc_id long, src string, dst string")
    kept, related = G.grounded(entities, links, texts)
    assert rows(kept) == {(1, "A-1"), (1, "B-2"), (3, "B-2")} and [tuple(r) for r in related.collect()] == [(1, "A-1", "B-2")]


def test_removed_documents_leave_nothing(spark):
    gone = spark.createDataFrame([(1, "D-1"), (2, None)], "doc_id long, doc_code string")
    units = spark.createDataFrame([(1, "u"), (2, "v"), (3, "w"), (3, "w")], "doc_id long, unit string")
    edges = spark.createDataFrame([("D-1", "M", "D-3"), ("D-3", "M", "D-1"), ("D-3", "M", "D-4")], "src string, rel string, dst string")
    left, kept = D.removed(gone, units, edges)
    assert left.count() == 2 and rows(kept) == {("D-3", "M", "D-4")}
    assert D.removed(gone.limit(0), units, edges)[1].count() == 3


def test_longest_alias_first(spark):
    texts = spark.createDataFrame([(1, "Old Mill Press near PRT-20 at the Mill"), (2, None), (3, "ab")], "k long, text string")
    names = spark.createDataFrame([("mill", "L1"), ("old mill press", "M2"), ("ab", "X"), ("mill", "M2")], "alias string, id string")
    assert rows(D.longest_aliases(texts, names, "k", "text")) == {(1, "PRT-20", 1, 1), (1, "M2", 2, 2), (1, "L1", 2, 3)}


def test_lookups_over_tables_and_lists(spark):
    a = spark.createDataFrame([("prt-1", "x"), ("PRT-1", "x"), ("PRT-2", "y"), (None, "z")], "id string, v string")
    want = spark.createDataFrame([("PRT-1",), ("PRT-9",)], "key string")
    assert rows(R.across({"a": a, "b": a.limit(0)}, {"a": "id", "b": "id"}, want)) == {("PRT-1", "a", 2)}
    listed = spark.createDataFrame([(1, ["kb-10", "KB-11"], "see PRT-20", 3), (2, None, None, 4)], "n int, codes array<string>, note string, ref_ int")
    refs = spark.createDataFrame([("KB-10",), ("PRT-20",), ("KB-99",)], "ref string")
    assert {(r["n"], r["ref"]) for r in R.naming(listed, refs).collect()} == {(1, "KB-10"), (1, "PRT-20")}
    where = spark.createDataFrame([(" usa ",), ("U.S.A.",), ("France",), (None,)], "c string")
    assert R.in_country(where, "c").count() == 2


def test_sets_are_equal_or_not(spark):
    claimed = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", 1), ("c", 1)], "k string, m int")
    found = spark.createDataFrame([("a", 2), ("a", 1), ("b", 1), ("b", 3), ("d", 5)], "k string, m int")
    assert rows(R.verify_sets(claimed, found, "k", "m")) == {("a", 2, 2, True), ("b", 1, 2, False), ("c", 1, 0, False), ("d", 0, 1, False)}
