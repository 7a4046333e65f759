"""Problem 5: records with rejects."""

import csv
import io

from hypothesis import given, settings
from hypothesis import strategies as st

from stratalith.operators.rejects import FIELDS, assemble, base_type, judge, parse_records, physical_lines, rejected_rows, valid_rows

NAMES = frozenset({"text", "numeric", "timestamp with time zone"})


def record(name="c", ordinal="1", kind="text", more=""):
    return f"s,t,{name},{ordinal},{kind},u,n,t,,{more}"


def reason(raw):
    return judge(raw, NAMES)[1]


def test_reasons_in_order():
    assert reason(None) == reason("") == reason("a,b") == "column_count"
    assert reason('a"b,c') == reason('"ab') == reason('"a"b') == reason("a\nb") == reason(record(name='x"y')) == "quoting"
    assert reason(record(name=" ")) == reason(record(name="\\N")) == reason(record(name="\tc")) == reason(record(name="a\x7f")) == "column_name"
    for bad in ("0", "-1", "1.0", "2147483648", "9" * 500, "", "１"):
        assert reason(record(ordinal=bad)) == "ordinal_position"
    for bad in ("", "texts", "numeric(1;2)", "numeric()", "numeric(1,2,3)"):
        assert reason(record(kind=f'"{bad}"')) == "data_type"


def test_accepted_spellings():
    for good in (" TEXT\t", "text[][]", "numeric( 12 , 2 )", "numeric(3)[]", "timestamp(3)  with time zone"):
        assert reason(record(kind=f'"{good}"')) is None
    assert reason("﻿" + record() + "\r\n\n") is None and reason(record(ordinal=" 007\t")) is None and reason(record(ordinal="2147483647")) is None
    assert judge(record(more='"two\nlines, ""quoted"""'), NAMES)[0][9] == 'two\nlines, "quoted"'
    assert base_type("Numeric(1,2) []") == "numeric"


def test_assembly_of_lines():
    text = 'a,"b\nc"\r\nd,e\n"f\r\n\r\ng",h'
    assert list(assemble(physical_lines(text))) == ['a,"b\nc"\r\n', "d,e\n", '"f\r\n\r\ng",h']


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet='ab",\n\r \\N', max_size=6), min_size=10, max_size=10))
def test_round_trip_of_quoted_records(fields):
    out = io.StringIO()
    csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="\n").writerow(fields)
    assert judge(out.getvalue(), NAMES)[1] != "quoting" and judge(out.getvalue(), NAMES)[1] != "column_count"


def test_operator_keeps_every_record(spark):
    rows = [(1, record(), "x"), (1, record(), "x"), (2, None, "y"), (3, record(ordinal="x"), None), (4, record(name="n", more="\\N"), "z" * 100_000)]
    parsed = parse_records(spark.createDataFrame(rows, "id long, raw string, column_name string"), spark.createDataFrame([("text",), (None,)], "type_name string"), keep=("id", "column_name"))
    assert parsed.count() == 5 and valid_rows(parsed).count() == 3
    assert sorted((r["id"], r["reason"]) for r in rejected_rows(parsed).collect()) == [(2, "column_count"), (3, "ordinal_position")]
    assert set(FIELDS) <= set(parsed.columns) and "source_column_name" in parsed.columns
    row = valid_rows(parsed).where("id = 1").first()
    assert row["ordinal_position"] == 1 and row["is_nullable"] is True and row["default_expression"] is None


def test_empty_table(spark):
    parsed = parse_records(spark.createDataFrame([], "raw string"), spark.createDataFrame([("text",)], "type_name string"))
    assert parsed.collect() == []
