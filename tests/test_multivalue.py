from hypothesis import given, strategies as st

from gristmill.operators import multivalue as M

from .conftest import rows

PRODUCT, KEYS = M.ListGrammar().compiled(), M.ListGrammar(M.KEY_SEPARATOR).compiled()


def items(text, grammar=PRODUCT):
    return [i for i, _ in M.split_text(text, *grammar)]


def test_separators():
    assert items("a; b ,c | d\te\nf / g/h") == ["a", "b", "c", "d", "e", "f", "g/h"]
    assert items("a/b & c and d;band", KEYS) == ["a", "b", "c", "d", "band"]
    assert items(" ;; a ,, ; ") == ["a"]
    assert items("nuts & bolts") == ["nuts & bolts"]


def test_quotes():
    assert items('"a, b"; "c ""d"" e" | 1/2" rod') == ["a, b", 'c "d" e', '1/2" rod']
    assert items('" a ";b') == ["a", "b"]
    assert M.split_text('"a; b', *PRODUCT) == [('"a', "malformed_quote"), ("b", "")]
    assert M.split_text('"a" x; b', *PRODUCT) == [('"a" x', "malformed_quote"), ("b", "")]
    assert items('"M-1" and "M-2"/"M-3"', KEYS) == ["M-1", "M-2", "M-3"]


def test_brackets_are_an_option():
    grammar = M.ListGrammar(brackets=(("[", "]"),)).compiled()
    assert items("[a, b]; c", grammar) == ["[a, b]", "c"]
    assert items("[a, b]; c") == ["[a", "b]", "c"]


@given(st.lists(st.text(alphabet='ab"; ,', min_size=1, max_size=6).map(str.strip).filter(bool), max_size=6))
def test_quoted_values_come_back(values):
    packed = ";".join('"' + v.replace('"', '""') + '"' for v in values)
    assert items(packed) == [v.strip() for v in values]


def test_rows(spark):
    df = spark.createDataFrame([("k", "a;b", 5), ("k", "a;b", 5), ("n", None, 1), ("e", "  ", 1), ("l", ";".join(["v"] * 50_000), 1)], "id string, field string, item int")
    got = M.split_values(df.filter("id <> 'l'"), "field", ["id"])
    assert sorted(tuple(r) for r in got.collect()) == [("k", 1, "a", ""), ("k", 1, "a", ""), ("k", 2, "b", ""), ("k", 2, "b", "")]
    assert M.split_values(df.filter("id = 'l'"), "field", ["id"]).count() == 50_000
    assert rows(M.split_values(df.limit(0), "field", ["id"])) == set()
