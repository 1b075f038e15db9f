import unicodedata

from gristmill.llm import lookalikes as L

from ..conftest import rows


def test_characters():
    assert L.plain("Ｆｕｌｌ　１２ ﬁne KΩ co​op­ é a‑b") == "Full 12 fine KΩ coop é a-b"
    assert L.plain("10² ½ é A") == "10² ½ é A"  # what can be seen stays


def test_tokens():
    assert L.judge_token("thе")[0] == "mixed" and L.judge_token("thе")[2] == "the"
    assert L.judge_token("смена")[0] == "pure" and L.judge_token("сменa")[2] == "смена"
    assert L.judge_token("kΩ")[0] == "pure" and L.judge_token("сор")[0] == "open" and L.judge_token("Жzz")[0] == "torn"
    assert L.repair("thе end", {"the"}) == "the end" and L.repair("thе end", set()) == "thе end"
    assert L.repair("смена с 5", set()) == "смена с 5" and L.repair("смена МСН-3 THE", set()).split()[1] == "MCH-3"
    assert L.shape_of("ёж") == "ëж" and L.in_script("c", "Cyrillic") == "с"


DOCS = [
    (1, "The oven at MCH-3 runs."), (2, "Thе oven at MCH-3 runs."), (3, "Τhe oven at МCH‐3 runs."), (4, "The oven at MCH-3 runs."), (5, "the oven at MCH-3 runs."),
    (6, "Станок стоит с утра"), (7, "Cтaнок стоит c утра"), (8, None), (9, ""), (10, "​"), (11, "Ωохx Жzz"), (12, "Ωoxx Жzz"), (13, "café"), (14, "café"), (15, "cafe"),
]


def frame(spark, data):
    return spark.createDataFrame([(k, t, "x", 1) for k, t in data], "doc_id long, text string, look string, key int")


def brute(data):
    def look(t):
        return L.shape_of(unicodedata.normalize("NFC", t.translate(L.plain_characters())))

    return {(a, b) for a, x in data for b, y in data if a < b and x is not None and y is not None and x != y and look(x) == look(y)}


def test_pairs_against_brute_force(spark):
    expected = brute(DOCS)
    assert {(1, 2), (1, 3), (6, 7), (9, 10), (11, 12), (13, 14)} <= expected and (1, 4) not in expected and (13, 15) not in expected
    assert rows(L.look_alike_pairs(frame(spark, DOCS))) == expected
    assert rows(L.look_alike_pairs(frame(spark, []))) == set()


def test_both_ways_of_repair_agree_and_equal_looks_get_one_text(spark):
    df = frame(spark, DOCS + [(20, "z" * 200_000 + " thе")])
    a = {r["doc_id"]: (r["normal_text"], r["look"]) for r in L.unify(df).collect()}
    b = {r["doc_id"]: (r["normal_text"], r["look"]) for r in L.unify(df, broadcast_repairs=0).collect()}
    assert a == b and len(a) == len(DOCS) + 1
    assert a[1] == a[2] == a[3] and a[6][0] == a[7][0] == "Станок стоит с утра" and a[8] == (None, None) and a[13][0] == "café"
    assert L.unify(df.union(df)).count() == 2 * len(a)
