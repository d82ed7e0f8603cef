import json
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgersift.sources import files, headers
from tests.conftest import rows


def test_sniff():
    assert files.sniff("a;b;c\n1;2,5;3\n".encode()) == ("utf-8-sig", ";")
    assert files.sniff("näme|x\nä|1\n".encode("cp1252"))[1] == "|"
    assert files.sniff(b"") == ("utf-8-sig", ",")


def test_load_delimited(spark, tmp_path):
    p = tmp_path / "in.csv"
    p.write_bytes("﻿Invoice No; Vendor Name ;Date;Amount\n 1 ;Zoë;2025-01-02;$1,000.50\n2;\"A;B\";bad;x\n".encode())
    df = files.load(spark, str(p))
    assert df.columns == ["Invoice No", "Vendor Name", "Date", "Amount"] and df.first()[1] == "Zoë"
    got = headers.load_invoices(spark, str(p))
    assert rows(got.select("invoice_id", "vendor_name", "invoice_date", "total_amount")) == [("1", "Zoë", date(2025, 1, 2), Decimal("1000.50")), ("2", "A;B", None, None)]
    with pytest.raises(ValueError):
        files.load(spark, str(tmp_path / "x.doc"))


def test_load_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"source": "x", "items": [{"a": 1, "b": " y "}, {"a": 2}]}))
    assert rows(files.load(spark, str(tmp_path / "a.json"))) == [("1", "y"), ("2", None)]
    (tmp_path / "b.json").write_text(json.dumps([{"a": 1}, {"a": 2}]))
    assert files.load(spark, str(tmp_path / "b.json")).count() == 2
    # the form of the document decides, not how many fields it has
    (tmp_path / "d.json").write_text(json.dumps({"n": 1, "to": "x", "day": "y", "zeta": [{"a": 1}, {"a": 2}], "alpha": [{"b": 1}]}))
    assert rows(files.load(spark, str(tmp_path / "d.json"))) == [("1",), ("2",)]
    (tmp_path / "e.json").write_text(json.dumps([{"vendor_id": "V1", "rates": [{"r": 1}, {"r": 2}]}]))
    assert [r.vendor_id for r in files.load(spark, str(tmp_path / "e.json")).collect()] == ["V1"]
    (tmp_path / "f.json").write_text('{"a": 1}\n{"a": 2}\n{"a": 3}\n')
    assert rows(files.load(spark, str(tmp_path / "f.json"))) == [("1",), ("2",), ("3",)]
    (tmp_path / "g.json").write_text('{\n "a": 1,\n "b": "x"\n}')
    assert rows(files.load(spark, str(tmp_path / "g.json"))) == [("1", "x")]


def test_line_breaks_in_values(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n1,"two\nlines"\n2,one\n')
    assert rows(files.load(spark, str(tmp_path / "a.csv"))) == [("1", "two\nlines"), ("2", "one")]
    (tmp_path / "b.csv").write_text('k,v\n1,"a ""quoted"" word"\n2,one\n')
    assert rows(files.load(spark, str(tmp_path / "b.csv"))) == [("1", 'a "quoted" word'), ("2", "one")]


def test_contracts(spark, tmp_path):
    data = [
        {"vendor_id": "V1", "contract_start": "2024-01-01", "contract_end_date": "2024-12-31", "contracted_items": [{"description": "Beam", "unit_price": "12.5"}], "volume_discount": {"threshold": 100, "discount_pct": "5"}, "scope": ["a"], "escalation_clause": {"max_annual_increase_pct": 3}},
        {"vendor_id": "V2", "rates": [], "annual_escalation_pct": "2.5"},
    ]
    (tmp_path / "c.json").write_text(json.dumps(data))
    a, b = files.read_contracts(spark, str(tmp_path / "c.json")).orderBy("vendor_id").collect()
    assert a.rates[0].rate == Decimal("12.5000") and a.rates[0].unit == "ea" and a.volume_discounts[0].threshold_quantity == 100 and a.annual_escalation_pct == Decimal("3.0000") and a.contract_start_date == date(2024, 1, 1)
    assert b.rates == [] and b.volume_discounts == [] and b.scope_of_work == [] and b.annual_escalation_pct == Decimal("2.5000")


def test_headers():
    got = headers.map_headers(["Inv #", "Supplier Name", "Supplier Code", "Bill Date", "Date Paid", "Net Amount", "P.O. Number", "Qty", "Unit Cost", "Item Desc", "Status", "Odd"])
    assert {f: h for f, (h, _) in got.items()} == {
        "invoice_number": "Inv #", "vendor_name": "Supplier Name", "vendor_id": "Supplier Code", "invoice_date": "Bill Date", "payment_date": "Date Paid", "total_amount": "Net Amount", "po_number": "P.O. Number",
        "quantity": "Qty", "unit_price": "Unit Cost", "line_item_description": "Item Desc", "payment_status": "Status",
    }
    assert headers.unmapped(["Inv #", "Odd"], got) == ["Odd"]
    assert headers.map_headers(["Amount"], [{"Amount": "$1.00"}])["total_amount"][1] == 1.0


@pytest.mark.parametrize("name", sorted(headers.TEMPLATES))
def test_templates(name):
    wanted = headers.TEMPLATES[name]
    got = headers.map_template([h.upper() for h in wanted.values()], name)
    assert set(got) == set(wanted) and all(c == 1.0 for _, c in got.values())


def test_required(spark):
    with pytest.raises(ValueError, match="vendor_name"):
        headers.apply_mapping(spark.createDataFrame([("1",)], "n string"), {"invoice_number": ("n", 1.0)})


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", [1, 2]), ("<b>", None)], "k string, v array<int>")
    for kind in ("parquet", "json", "csv"):
        files.write_table(df, str(tmp_path / kind), kind)
        assert files.load(spark, str(tmp_path / kind)).count() == 2 if kind == "x" else (tmp_path / kind).is_dir()
    files.summary_json(df, str(tmp_path / "s.json"))
    files.summary_html(df, str(tmp_path / "s.html"), "T")
    assert len(json.loads((tmp_path / "s.json").read_text())) == 2 and "&lt;b&gt;" in (tmp_path / "s.html").read_text()
    files.summary_json(spark.range(1500), str(tmp_path / "long.json"))
    files.summary_html(spark.range(1500), str(tmp_path / "long.html"), "T")
    assert len(json.loads((tmp_path / "long.json").read_text())) == 1500 and (tmp_path / "long.html").read_text().count("<tr>") == 1501
    files.summary_json(df.limit(0), str(tmp_path / "none.json"))
    assert json.loads((tmp_path / "none.json").read_text()) == []


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert rows(files.upsert(old, spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int"), ["k"])) == [("a", 1), ("b", 3), ("c", 4)]
    assert rows(files.upsert(old, spark.createDataFrame([("b", 3), ("b", 7), ("b", 5)], "k string, v int"), ["k"])) == [("a", 1), ("b", 7)]


def test_trimmed(spark):
    df = spark.createDataFrame([(" x ", "")], "` a` string, b string")
    assert files.trimmed(df).columns == ["a", "b"] and rows(files.trimmed(df)) == [("x", None)]
    assert files.trimmed(df.withColumn("n", F.lit(1))).first().n == 1
