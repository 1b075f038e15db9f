import random

from gristmill.llm import leaks as K

from ..conftest import rows

rng = random.Random(4)
WORDS = [f"w{k}" for k in range(60)]
ITEMS = [(k, " ".join(rng.choices(WORDS, k=30))) for k in range(8)] + [(50, "too short"), (51, None)]


def docs():
    out = []
    for k in range(60):
        words = rng.choices(WORDS, k=80)
        if k % 3 == 0:
            item = ITEMS[k % 8][1].split()
            n = rng.choice([11, 12, 13, 14, 30])
            at = rng.randrange(0, 31 - n)
            words[20:20] = [w.upper() if k % 2 else w.replace("w", "ԝ") for w in item[at : at + n]]
        out.append((k, rng.choice([" ", ", ", "\n"]).join(words)))
    return out + [(100, None), (101, ""), (102, "long " * 50_000 + ITEMS[0][1])]


DOCS = docs()


def brute(n):
    grams = {}
    for i, t in ITEMS:
        w = (t or "").split()
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    found = set()
    for d, t in DOCS:
        w = [x for x in K.words_of((t or "").replace("ԝ", "w"))]
        for k in range(len(w) - n + 1):
            found |= {(d, i) for i in grams.get(tuple(w[k : k + n]), ())}
    return found


def frames(spark):
    return (spark.createDataFrame([(k, t, 1, 2) for k, t in DOCS], "doc_id long, text string, key int, spans int"),
            spark.createDataFrame([(k, t, 1) for k, t in ITEMS + ITEMS[:2]], "item_id long, item_text string, text int"))


def test_both_ways_against_brute_force(spark):
    d, i = frames(spark)
    for n in (13, 5):
        assert rows(K.leaked_pairs(K.find_leaks(d, i, n))) == brute(n)
        assert rows(K.leaked_pairs(K.find_leaks(d, i, n, index_bytes=0))) == brute(n)
    assert rows(K.leaked_pairs(K.find_leaks(d.limit(0), i))) == set() == rows(K.leaked_pairs(K.find_leaks(d, i.limit(0))))


def test_removed_spans_do_not_leak_again(spark):
    d, i = frames(spark)
    clean = K.without_spans(K.find_leaks(d, i))
    assert {r["doc_id"] for r in clean.collect()} == {a for a, _ in brute(13)}
    again = clean.select("doc_id", clean["cleaned"].alias("text"))
    assert K.find_leaks(again, i).count() == 0
    text = dict(DOCS)[102]
    assert clean.filter("doc_id = 102").first()["cleaned"].strip() == text[: text.index(ITEMS[0][1])].strip()
