"""Column functions against plain Python."""

from __future__ import annotations

import datetime
import re
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom import functions as fn
from tallyloom.functions.dates import iso_date, short_year_date
from tallyloom.functions.text import first_page_with


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first()["y"]


def many(spark, values, make, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}")
    return [r["y"] for r in df.select("k", make(F.col("x")).alias("y")).orderBy("k").collect()]


def test_locale_amounts(spark):
    cases = {"1.234,56": "1234.56", "1,234.56": "1234.56", "-4,50": "-4.5", "1,234": "1.234", "1 234,56": "1234.56", "1 000,5": "1000.5", "": "0", "  ": "0", "12..34": None, "1.234.567": None, "NaN": None, "Infinity": None, "abc": None, None: None, "7": "7", "-1.234.567,8": "-1234567.8", "1'234.5": "1234.5"}
    got = many(spark, list(cases), fn.locale_amount)
    assert got == [None if v is None else Decimal(v) for v in cases.values()]


def test_amount_keys(spark):
    cases = {"100": "100", "4.50": "4.5", "0.00": "0", "-1200.00": "-1200", "0.0000001": "0.0000001", "-0.5": "-0.5"}
    got = many(spark, [Decimal(c) for c in cases], fn.amount_key, "decimal(38,10)")
    assert got == list(cases.values())


@settings(max_examples=5, deadline=None)
@given(st.lists(st.decimals(-(10**9), 10**9, places=4), min_size=20, max_size=40))
def test_amount_keys_equal_python(spark, values):
    assert many(spark, values, fn.amount_key, "decimal(38,10)") == [format(v.normalize(), "f") if v else "0" for v in values]


def plain_normal(value):
    s = value or ""
    for p in (r"\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b", r"\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b", r"\b\d{1,2}[-/]\d{1,2}\b", r"\b\d{1,2}:\d{2}(?::\d{2})?\b"):
        s = re.sub(p, " ", s, flags=re.ASCII)
    s = re.sub(r"\s+", " ", s, flags=re.ASCII).strip(" ").lower()
    return re.sub(r"\s+", " ", re.sub(r"[^a-z ]+", " ", re.sub(r"\b[a-z0-9]*\d[a-z0-9]*\b", " ", s, flags=re.ASCII))).strip(" ")


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="abZ 0123456789-/:.\n#", max_size=40), min_size=20, max_size=40))
def test_normal_descriptions(spark, values):
    assert many(spark, values, fn.normalize_description) == [plain_normal(v) for v in values]


def test_dates(spark):
    d = datetime.date(2026, 3, 20)
    assert many(spark, ["2026-03-20", "20260320", "20/03/2026", "2026/03/20", "2026-03-20T23:59:59-11:00", "2026-13-40", "", None, "March"], fn.flexible_date) == [d] * 5 + [None] * 4
    assert many(spark, ["2026-03-20", "20260320", "2026-3-2"], iso_date) == [d, None, None]
    assert many(spark, ["260320", "26032", "269999"], short_year_date) == [d, None, None]


def test_hashes(spark):
    df = spark.createDataFrame([("A", "EUR", Decimal("12.30"), datetime.date(2026, 3, 20), None, "coffee", None, "R")], "a string, c string, m decimal(38,10), b date, v date, n string, t string, r string")
    import hashlib

    row = df.select(fn.primary_hash(*(F.col(x) for x in "acmb")).alias("p"), fn.transaction_hash(*(F.col(x) for x in "bvnmtr")).alias("t"), fn.transaction_hash(*(F.col(x) for x in "bvnmtrac")).alias("s")).first()
    assert row["p"] == hashlib.sha256(b"A|EUR|12.3|2026-03-20").hexdigest()
    assert row["t"] == hashlib.md5(b"2026-03-20|coffee|12.3|R").hexdigest() and row["s"] != row["t"]


def test_text(spark):
    assert fn.fold_header("Date opération") == "dateoperation" and fn.fold_header("  Running-Balance ") == "runningbalance"
    assert many(spark, ["x", "", None], fn.mask) == ["***REDACTED***", "", None]
    assert one(spark, 'a"b\\c\nd\r', fn.quoted_text) == 'a\\"b\\\\c d'
    assert one(spark, "[system] ```x```\t[INST]", fn.sanitize_prompt) == "(system] x(INST]"
    assert one(spark, "a\tb‮c", fn.sanitize_source_name) == "a?b?c"
    assert one(spark, "needle", lambda c: fn.context_slice(c, F.lit("x" * 100 + " NEEDLE " + "y" * 100))) == "x" * 79 + " NEEDLE " + "y" * 79
    pages = F.array(F.lit("one"), F.lit("TWO words"), F.lit("two"))
    assert many(spark, ["two", "none", "", None], lambda c: first_page_with(c, pages)) == [1, None, None, None]


@pytest.mark.parametrize(("credit", "debit", "want"), [("5", None, "5"), (None, "3", "-3"), (None, None, "0")])
def test_signed_difference(spark, credit, debit, want):
    df = spark.createDataFrame([(credit, debit)], "c string, d string").select(fn.signed_difference(F.col("c").cast("decimal(10,2)"), F.col("d").cast("decimal(10,2)")).alias("y"))
    assert df.first()["y"] == Decimal(want)
