import pytest
from pyspark.sql import functions as F

from gristmill.functions import keys as KY, normalize as N, text as X


def value(spark, column, v, kind="string"):
    return spark.createDataFrame([(v,)], f"c {kind}").select(column(F.col("c")).alias("v")).first()["v"]


@pytest.mark.parametrize("text,hours", [("4.5h", 4.5), ("360 min", 6.0), ("3:00", 3.0), ("1h30m", 1.5), ("0h45m", 0.75), ("soon", None), (None, None), ("", None)])
def test_durations(spark, text, hours):
    assert value(spark, N.duration_hours, text) == hours


@pytest.mark.parametrize("text,days", [("5 weeks", 35), ("2 wks", 14), ("42", 42), ("approx. 7 days", 7), ("1.5 weeks", 10), ("later", None), (None, None)])
def test_lead_times(spark, text, days):
    assert value(spark, N.lead_days, text) == days


def test_numbers_dates_and_totals(spark):
    assert value(spark, N.first_number, "USD 1,115.00") == 1115.0 and value(spark, N.whole_number, "5,000") == 5000
    assert str(value(spark, N.any_date, "02/29/2024")) == "2024-02-29" and value(spark, N.any_date, "02/30/2024") is None
    df = spark.createDataFrame([(200.0, 42.5), (5000.0, 0.35), (0.0, 3.0), (None, 3.0)], "q double, p double")
    assert [r[0] for r in df.select(N.line_total(F.col("q"), F.col("p"))).collect()] == [8500.0, 1750.0, None, None]
    df = spark.createDataFrame([(0.91, 0.95, 0.952), (0.84, 0.93, 0.98)], "a double, p double, q double")
    assert [r[0] for r in df.select(N.oee(F.col("a"), F.col("p"), F.col("q"))).collect()] == [82.3, 76.5]
    assert value(spark, N.present, "missing") is None and value(spark, N.present, " x ") == "x"


def test_text_functions(spark):
    assert value(spark, X.tokens, "The Oven-3 is a 5kW unit") == ["the", "oven-3", "is", "5kw", "unit"]
    assert value(spark, X.identifiers, "See PRT-20 and PRT-20, not XPRT-2a or SUP-10101.") == ["PRT-20", "SUP-10101"]
    assert value(spark, X.content_terms, "What does the spindle of MCH-30 need about 400 spindle checks?") == ["spindle", "need", "checks"]
    assert value(spark, X.slug, " Blue -- steel/Bolt ") == "ING-BLUE-STEEL-BOLT"
    html = "<nav>menu</nav><h1>T &amp; U</h1><ul><li>one</li><li>two</li></ul><script>x</script><p>a<br>b</p>"
    assert value(spark, X.strip_html, html) == "T & U\n\n- one\n\n- two\n\na\nb"
    mail = "From: a\nSubject: Re: parts\n\nHello,\n> old\nnew line\n-- \nAnn"
    assert value(spark, X.mail_subject, mail) == "Re: parts" and value(spark, X.mail_body, mail) == "Hello,\nnew line"
    assert value(spark, X.mend_scanned, "bolt PRT-2O0l of 2O25-0l-15 and NCR-7OO1, but TOOL-BOX Ole") == "bolt PRT-2001 of 2025-01-15 and NCR-7001, but TOOL-BOX Ole"
    assert value(spark, X.resolve_entities, "a &lt; b &amp;lt; &#233;&#x20AC; &deg;C &bogus; & &#0; x") == "a < b &lt; é€ °C &bogus; & &#0; x"
    assert value(spark, X.space_units, "1h30m at 5kW") == "1 h 30 m at 5 kW"
    assert value(spark, X.name_phrases, "Blue Heron of the Old Mill Press Line and Blue Heron") == ["Blue Heron", "Old Mill Press Line"]
    assert value(spark, X.title_of, "\n\n  # Head \nrest") == "# Head" and value(spark, X.stem, "weeks") == "week"
    assert value(spark, X.without_citations, "It holds [KB-12] . Yes [NCR-3], so.") == "It holds. Yes, so."
    assert value(spark, KY.clean_key, " prt‑ 20 0​1 ") == "PRT-2001"
    for column in (X.tokens, X.strip_html, X.mail_body, X.slug, X.content_terms, KY.clean_key):
        assert value(spark, column, None) is None


def test_bytes(spark):
    assert value(spark, X.decode_text, "﻿Käse\r\nx".encode(), "binary") == "Käse\nx"
    assert value(spark, X.decode_text, "Käse".encode("latin-1"), "binary") == "Käse"
