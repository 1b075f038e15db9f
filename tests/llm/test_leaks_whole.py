import random

from gristmill.llm import leaks as K

from ..conftest import rows

WORDS = [f"word{c}e" for c in "abcdefghij"]


def test_both_ways_write_the_same_text(spark):
    rng = random.Random(3)
    item = rng.choices(WORDS, k=20)
    odd = [w.replace("o", "\u043e", 1) if k % 3 == 0 else w.upper() for k, w in enumerate(item)]
    texts = [" ".join(odd), "b\u0435fore w\u043erdae, " + " ".join(item) + " \u0442\u0435\u0441\u0442 Word\u0430e", "nothing w\u043erdae", None]
    docs = spark.createDataFrame([*enumerate(texts), (1, texts[1])], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item[3:]))], "item_id long, item_text string")
    plain = lambda df: {(r["doc_id"], r["normal_text"], tuple(sorted(map(tuple, r["spans"])))) for r in df.collect()}
    scanned, joined = (K.find_leaks(docs, items, index_bytes=b) for b in (1 << 20, 0))
    assert plain(joined) == plain(scanned) and {k for k, _, _ in plain(joined)} == {0, 1} and joined.count() == 3
    assert rows(K.without_spans(joined)) == rows(K.without_spans(scanned))
