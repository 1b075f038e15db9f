from gristmill.operators import documents as D, graph as G
from gristmill.plans import reference

from .conftest import rows


def test_badly_typed_keys_become_edges(spark):
    data = [(" prt\u20111", "mch-3039; Mch-3144, MCH\u20103031 and MCH\u20133371"), ("PRT-1", "MCH-3039/prt\u22121"), ("PRT-2", None)]
    df = spark.createDataFrame(data, "part string, used_on string")
    assert rows(G.edges_of_rows(df, "part", ["used_on"])) == {("PRT-1", "USED_ON", f"MCH-{n}") for n in (3039, 3144, 3031, 3371)}


def test_quality_and_abstention_use_the_labels(spark, tmp_path):
    docs = [(1, "oven PRT-11 oven", "KB-11"), (2, "pump and valve", "KB-12"), (3, "valve", "KB-13")]
    spark.createDataFrame(docs, "doc_id long, text string, doc_code string").write.parquet(f"{tmp_path}/documents.parquet")
    asked = [
        ("Q0102", "the oven", True, ["kb\u201111"]), ("q 201", "a valve", True, ["KB-12", "KB-99"]), ("Q300", "the pump", False, []),
        ("Q402", "PRT-11", False, []), ("Q501", "nothing here", True, ["KB-13"]), ("Q501", "nothing here", True, ["KB-13"]), ("Q502", "oven", True, ["KB-11"]),
    ]
    spark.createDataFrame(asked, "qid string, question string, answerable boolean, gold_doc_ids array<string>").write.parquet(f"{tmp_path}/questions.parquet")
    m = reference.retrieval_quality(spark, str(tmp_path)).first()
    assert (m["n_queries"], m["recall_at_1"], m["recall_at_10"], m["mrr"]) == (3, 0.333333, 0.333333, 0.5)
    assert rows(reference.abstention(spark, str(tmp_path)).select("answerable", "n_queries", "n_answered")) == {(True, 3, 0), (False, 2, 0)}


def test_no_mail_is_dropped_for_its_characters(spark, tmp_path):
    heads = ["Subject: a", "\uff33\uff55\uff42\uff4a\uff45\uff43\uff54: a", "Sub\u0458e\u0441t: a", "S\u2060ubject: a", "Sub\xadject: a", "From: b\n\u0405ubject: a", "From: b", "Subject:"]
    mails = [(k, f"{h}\n\nHello\nSubject: not this", "email") for k, h in enumerate(heads)]
    spark.createDataFrame([*mails, (90, "Subject: a note", "sop"), (91, None, "email")], "doc_id long, text string, doc_type string").write.parquet(f"{tmp_path}/documents.parquet")
    got = rows(reference.mail_parts(spark, str(tmp_path)).select("doc_id", "subject"))
    assert got == {*((k, "a") for k in range(6)), (6, None), (7, ""), (91, None)}


def test_long_aliases_are_looked_for(spark):
    names = [("robert doflesar welding supply s.r.l.", "S1"), ("a b c d e f g h i j k l", "S2"), ("...", "S3")]
    docs = spark.createDataFrame([(1, "From Robert Doflesar Welding Supply S.R.L. today"), (2, "a b c d e f g h i j k l"), (3, "a b c d e f g h i j k")], "doc_id long, text string")
    got = D.phrases_in(docs, spark.createDataFrame(names, "alias string, id string"))
    assert rows(got) == {(1, names[0][0], "S1"), (2, names[1][0], "S2")}
