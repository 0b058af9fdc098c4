from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from kohorte.functions import columns as c
from kohorte.functions import gates
from kohorte.operators.retention import maturity_days


def one(spark, expr, **values):
    """Value of an expression over one row of named string/number literals."""
    names = list(values)
    row = spark.range(1).select(*[F.lit(values[n]).alias(n) for n in names]) if names else spark.range(1)
    return row.select(expr.alias("x")).first()["x"]


def strings(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("v"))).collect()]


def test_country_normalisers(spark):
    assert strings(spark, ["UK", "GB", "ES", None], c.normal_country) == ["GB", "GB", "ES", None]
    assert strings(spark, [" uk ", "es", None], c.country_or_unknown) == ["GB", "ES", "UNKNOWN"]


def test_sizes_do_not_raise(spark):
    assert strings(spark, ["9MB", "512KB", "9mb", "1.5 MB", "x", "MB", None], c.size_in_mb) == [9.0, 0.5, 9.0, 1.5, None, None, None]


def test_file_groups_are_case_specific(spark):
    assert strings(spark, ["DOC", "docx", "DOCX", "XLS", "csv", "Pdf", None], c.file_group) == [
        "doc", "doc", "others", "others", "others", "pdf", "others"]


def test_segments(spark):
    def segment(v):
        return c.customer_segment(c.email_domain(v))
    assert strings(spark, ["A@GMAIL.com", "x@firm.com", None], segment) == ["B2C", "B2B", "B2B"]


def test_keyword(spark):
    assert strings(spark, ["pdf FREE", "Gratuit", "buy", None], c.keyword_class) == ["free", "free", "other", "other"]
    assert strings(spark, ["pdf FREE", "free pdf"], lambda v: c.keyword_class(v, ["free"], ignore_case=False)) == ["other", "free"]


def test_week_labels(spark):
    d = F.lit(date(2025, 12, 29))
    assert one(spark, c.calendar_week_label(d)) == "2025-W1"
    assert one(spark, c.iso_week_label(d)) == "2026-W1"
    assert one(spark, c.week_span_label(F.lit(date(2026, 1, 7)))) == "05-11 Jan 2026 (W02)"


def test_money_rounds_half_up_and_ignores_the_last_bit(spark):
    assert one(spark, c.money(F.lit(41.62499999999999))) == Decimal("41.63")
    assert one(spark, c.whole_units(F.lit(Decimal("2.50")))) == 3
    assert one(spark, c.whole_units(F.lit(Decimal("-2.70")))) == -3


def test_division_by_zero_is_null(spark):
    assert one(spark, c.safe_div(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, c.ratio(F.lit(1), F.lit(4))) == 0.25


def test_static_rates_default_to_one(spark):
    assert strings(spark, ["AUD", "EUR", "JPY", None], lambda v: c.static_eur(F.lit(Decimal("10.00")), v)) == [
        Decimal("6.11240000"), Decimal("10.00000000"), Decimal("10.00000000"), Decimal("10.00000000")]


def test_text_helpers(spark):
    assert strings(spark, ["a\r\nb"], c.one_line) == ["a  b"]
    assert one(spark, c.decimal_comma(F.lit(Decimal("98.88")))) == "98,88"
    assert one(spark, c.percent_text(F.lit(0.1234))) == "12.3%"
    assert one(spark, c.percent_text(F.lit(None).cast("double"))) == "N/A"


def test_completed_days_not_calendar_days(spark):
    rows = spark.createDataFrame([("2000-01-01 12:00:00",), ("2000-01-02 00:00:00",)], "t string")
    got = rows.select(c.whole_days_between(date(2000, 1, 3), F.col("t").cast("timestamp"))).collect()
    assert [r[0] for r in got] == [1, 1]


def test_email_gates(spark):
    people = spark.createDataFrame([(1, None), (2, "a@internal.x"), (3, "a@b.c"), (4, "test@internal.x")], "id int, email string")
    def ids(df):
        return sorted(r["id"] for r in df.collect())
    assert ids(gates.external_customers(people, "%internal%")) == [3]
    assert ids(gates.external_customers(people, "%internal%", keep_missing=True)) == [1, 3]
    assert ids(gates.not_all_like(people, "email", ["%internal%", "%test%"])) == [2, 3]


def test_maturity_rules():
    assert [maturity_days(r, "first") for r in (1, 2, 3)] == [8, 37, 65]
    assert [maturity_days(r, "second") for r in (1, 2, 3)] == [15, 43, 71]
    with pytest.raises(ValueError):
        maturity_days(1, "third")
