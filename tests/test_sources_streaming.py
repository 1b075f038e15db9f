import json

from gristmill.sources import readers as S
from gristmill.streaming import tables as T

from .conftest import rows


def test_csv_and_json(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id, name \n1, "x, y" \n,\n2\n')
    df = S.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["id", "name"] and [r["id"] for r in df.collect()] == ["1", "2"]
    (tmp_path / "v.csv").write_text("# unit: mm/s\ntimestamp,value\nt1,1.5\nt2,bad\n")
    assert rows(S.read_samples(spark, str(tmp_path / "v.csv"))) == {("t1", 1.5)}
    (tmp_path / "a.jsonl").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    assert rows(S.read_json_lines(spark, str(tmp_path / "a.jsonl"), "a int")) == {(1,), (2,)}
    assert [r["line"] for r in S.broken_lines(spark, str(tmp_path / "a.jsonl"), "a int").collect()] == ["broken"]
    S.write_json_lines(spark.createDataFrame([(1,), (None,)], "a int"), str(tmp_path / "out.jsonl"))
    assert rows(S.read_json_lines(spark, str(tmp_path / "out.jsonl"), "a int", strict=True)) == {(1,), (None,)}
    m = {"plant": "P", "machines": [{"id": "MCH-1", "codename": "Owl", "type": "mill", "line": "L1", "line_codename": "LX", "program": None}]}
    (tmp_path / "m.json").write_text(json.dumps(m))
    nodes, edges = S.read_master(spark, str(tmp_path / "m.json"))
    assert {r["id"] for r in nodes.collect()} == {"MCH-1", "L1"} and rows(edges) == {("MCH-1", "ON_LINE", "L1")}


def test_mixed_folder(spark, tmp_path):
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4\n")
    (tmp_path / "w.txt").write_bytes(b"caf\xe9 \x93quoted\x94 \x80 5")
    (tmp_path / "j.json").write_text('{ "a" : [1,  2] }')
    (tmp_path / "k.json").write_text("{ broken")
    (tmp_path / "d.html").write_text("<p>a &lt; b</p>")
    (tmp_path / "e.eml").write_text("Subject: Hi\n\nbody\n> quoted\n")
    (tmp_path / "f.csv").write_text('a,"b, c"\n,\n d ,"say ""x"""\n')
    got = {r["path"][-6:]: r for r in S.read_files(spark, str(tmp_path)).collect()}
    text = {k: r["text"] for k, r in got.items()}
    assert text["d.html"[-6:]] == "a < b" and text["/e.eml"] == "body" and got["/e.eml"]["title"] == "Hi" and text["/f.csv"] == 'a | b, c\nd | say "x"'
    assert text["/w.txt"] == "caf\xe9 \u201cquoted\u201d \u20ac 5" and text["j.json"] == '{"a":[1,2]}' and text["k.json"] == "{ broken"
    assert text["/c.pdf"] is None and got["/c.pdf"]["error"] == "no reader for pdf"
    two = spark.createDataFrame([("p", "== DATASHEET A ==\nx\n== DATASHEET B ==\ny\n")], "path string, text string")
    assert [(r["part"], r["text"].strip()) for r in S.split_documents(two).collect()] == [(1, "x"), (2, "y")]
    S.write_csv(spark.createDataFrame([("q", ["a", "b"], True)], "id string, l array<string>, b boolean"), str(tmp_path / "out"))
    assert "id,l,b\nq,a;b,true\n" in [f.read_text() for f in (tmp_path / "out").glob("*.csv")]


def test_upsert_stream(spark, tmp_path):
    schema, src, out = "k string, v int, x string", str(tmp_path / "in"), str(tmp_path / "t")
    for batch in ([("a", 1, "one"), ("b", 1, "b")], [("a", 2, "two"), ("a", 0, "late")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        T.upsert_stream(spark.readStream.schema(schema).parquet(src), out, str(tmp_path / "c")).awaitTermination()
    assert rows(T.latest(spark, out, ["k"], "v").select("k", "v", "x")) == {("a", 2, "two"), ("b", 1, "b")}


def test_windowed_counts(spark, tmp_path):
    from .conftest import day

    spark.createDataFrame([(day(0), "a", 1.0), (day(0), "a", 2.0), (day(3), "a", 9.0)], "ts timestamp, kind string, value double").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, kind string, value double").parquet(str(tmp_path / "e"))
    q = T.windowed_counts(stream, "ts", "kind").writeStream.format("memory").queryName("counted").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["n"], r["total"]) for r in spark.table("counted").collect()] == [(2, 3.0)]
