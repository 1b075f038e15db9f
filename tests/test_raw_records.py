from gristmill.operators import raw_records as R

from .conftest import rows

PO = "erp/purchase_orders.csv"
SUP = "erp/suppliers_master.csv"
WO = "maintenance/cmms_export.csv"
GOOD = 'PO-1,"Ab, Inc.",PRT-9,"5,000",$ 42.50,,2 weeks,2025-02-28'


def parse(spark, *raws, file=PO):
    df = spark.createDataFrame([(k, file, raw) for k, raw in enumerate(raws)], "record_id long, source_file string, raw string")
    return R.parse_records(df)


def test_valid_records_are_typed(spark):
    parsed = parse(spark, GOOD, "PO-2,,,7,0.35 USD,\" 1,000 \",3 d,02/29/2024")
    assert R.failed(parsed).count() == 0
    got = {r["po"]: r for r in R.typed(parsed, PO).collect()}
    assert got["PO-1"]["qty"] == 5000 and str(got["PO-1"]["unit_price"]) == "42.50" and got["PO-1"]["moq"] is None
    assert got["PO-1"]["supplier"] == "Ab, Inc." and got["PO-2"]["moq"] == 1000 and got["PO-2"]["supplier"] is None


def test_each_rule_has_a_reason(spark):
    bad = {
        "invalid_po": "PX-1,a,b,1,1,,d,2025-01-01", "invalid_qty": "PO-1,a,b,0,1,,d,2025-01-01", "invalid_unit_price": "PO-1,a,b,1,$1 USD,,d,2025-01-01",
        "invalid_moq": "PO-1,a,b,1,1,x,d,2025-01-01", "invalid_lead_time": "PO-1,a,b,1,1,, ,2025-01-01", "invalid_po_date": "PO-1,a,b,1,1,,d,2025-02-29",
        "too_few_fields": "PO-1,a", "too_many_fields": GOOD + ",x", "quote_not_closed": 'PO-1,"a,b,1,1,,d,2025-01-01',
        "text_after_quote": 'PO-1,"a"b,c,1,1,,d,2025-01-01', "quote_in_bare_field": 'PO-1,a"b,c,1,1,,d,2025-01-01',
        "line_break_in_bare_field": "PO-1,a\nb,c,1,1,,d,2025-01-01", "empty_text": None,
    }
    got = {r["record_id"]: r["errors"][0]["code"] for r in parse(spark, *bad.values()).collect()}
    assert [got[k] for k in range(len(bad))] == list(bad)


def test_amounts_and_counts():
    assert all(R._amount(v) for v in ("1", "1.50", "€1,234.00", "$ 9", "9 USD", "GBP 1,000"))
    assert not any(R._amount(v) for v in ("", "0", "0.00", "1.5", "1,23", "$ 1 $", "USD  1", "-1", "1.000", "USD"))
    assert R._quantity("12,345") and not R._quantity("1,2345") and not R._quantity("0")


def test_reading_resumes_at_the_next_record_start(spark):
    broken = 'PO-1,"a,b,1,1,,d,2025-01-01\n' + GOOD + "\nPO-3,only"
    got = [(r["part"], r["ok"], r["starts_at"]) for r in parse(spark, broken).orderBy("part").collect()]
    assert got == [(1, False, 0), (2, True, broken.index(GOOD)), (3, False, broken.index("PO-3"))]
    # a line that opens with a key but is no record start does not count as one
    assert parse(spark, "PO-1,a\nPO-2 is late,b").count() == 1


def test_line_breaks_and_quotes_in_quoted_fields(spark):
    wo = 'WO-1,Pike,MCH-3,01/31/2025,1h30m,,"Ann","said ""stop"",\nthen left"'
    parsed = parse(spark, wo, file=WO)
    assert R.failed(parsed).count() == 0
    assert R.typed(parsed, WO).first()["notes"] == 'said "stop",\nthen left'
    assert R.failed(parse(spark, wo.replace("1h30m", "1h60m"), file=WO)).count() == 1


def test_edges(spark):
    assert parse(spark, "x" * 300_000).first()["errors"][0]["code"] == "too_few_fields"
    assert parse(spark, GOOD, file="other.csv").first()["errors"][0]["code"] == "unknown_file"
    empty = spark.createDataFrame([], "record_id long, source_file string, raw string")
    assert R.failed(R.parse_records(empty)).count() == 0
    # further columns of clashing names, repeated rows
    df = spark.createDataFrame([(1, PO, GOOD, "x", 9)] * 2, "record_id long, source_file string, raw string, part string, ok int")
    assert R.parse_records(df).count() == 2 and R.typed(R.parse_records(df), PO).count() == 2
    assert rows(R.failed(parse(spark, GOOD + "\n" + GOOD.replace("PO-1", "PO-2")))) == {(0,)}
