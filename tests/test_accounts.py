"""Accounts of gates and joins, and rows that a CSV file can't hold."""

import random

import pytest
from pyspark.sql import functions as F

from kohorte.operators.accounting import PLAIN, Account
from kohorte.sources.catalog import read_csv, read_csv_checked


def rows(df):
    return sorted(map(repr, df.collect()))


def counted(left, right, how):
    """(rows, lost, gained) of a join on the first value, pair by pair."""
    partners = [sum(r[0] == x[0] for r in right) if x[0] is not None else 0 for x in left]
    return len(left), sum(n == 0 for n in partners), 0 if how == "left_semi" else sum(max(n - 1, 0) for n in partners)


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_joins_are_counted_and_unchanged(spark, how):
    rng = random.Random(2)
    left = [(rng.choice([None, *range(8)]), i) for i in range(200)] + [(50, i) for i in range(100)]      # a hot key
    right = [(rng.choice([None, 1, 2, 3, 4, 50]), f"v{i}") for i in range(20)]
    a, b = spark.createDataFrame(left, "k int, i int"), spark.createDataFrame(right, "k int, v string")
    account = Account()
    got = account.join(a, b, "k", "step", how)
    assert rows(got) == rows(PLAIN.join(a, b, "k", "step", how)) and got.columns == a.join(b, "k", how).columns
    assert [tuple(r) for r in account.rows(spark).collect()] == [(1, "step", f"{how} join", *counted(left, right, how))]


def test_gates_and_joins_one_after_the_other(spark):
    """Losses and gains add up to the rows that arrive at the next step, nulls lose their row at a gate, and empty tables count as nothing."""
    left = [(k, None if k % 5 == 0 else k % 3) for k in range(60)]
    right = [(k % 20,) for k in range(30)]
    a, b = spark.createDataFrame(left, "k int, x int"), spark.createDataFrame(right, "k int")
    account = Account()
    out = account.join(account.gate(a, F.col("x") > 0, "x"), b, "k", "b", "inner")
    n = len(out.collect())
    first, second = account.rows(spark).collect()
    assert first["rows"] == 60 and first["lost"] == sum(x is None or x == 0 for _, x in left)
    assert second["rows"] == 60 - first["lost"] and n == second["rows"] - second["lost"] + second["gained"]
    empty = Account()
    empty.join(a.limit(0), b, "k", "b").collect()
    assert [tuple(r)[3:] for r in empty.rows(spark).collect()] == [(0, 0, 0)]


HEADER = "subscription_id,tenure,user_revenue,initial_payment_date,status,note"
GOOD = ['1,3,29.95,2000-01-01 00:00:00,active,plain', '2,,,,churned,', '3,4,1.00,2000-01-02 00:00:00,"act,ive","a ""quote"""', '4,-1,0.00,,active,']
BAD = {'x,3,29.95,,active,': "subscription_id: x is no bigint", '5,3,lots,,active,': "user_revenue: lots is no decimal(18,2)",
       '6,3,1.00,no day,active,': "initial_payment_date: no day is no timestamp", '7,3,1.00': "3 fields of 6", '8,3,1.00,,active,,more': "7 fields of 6",
       '9,3.5,1.00,,active,': "tenure: 3.5 is no bigint"}


def test_malformed_rows_are_kept_apart(spark, tmp_path):
    lines = [*GOOD, *BAD]
    (tmp_path / "csv").mkdir()
    for name, part in (("a", lines[::2]), ("b", lines[1::2])):
        (tmp_path / "csv" / f"{name}.csv").write_text("\n".join([HEADER, *part]) + "\n")
    good = read_csv_checked(spark, str(tmp_path / "csv"), "subscription_fact", str(tmp_path / "bad"))
    bad = spark.read.parquet(str(tmp_path / "bad")).collect()
    assert {r["line"]: r["reason"] for r in bad} == BAD
    assert all(r["file"].endswith("/a.csv" if r["line"] in lines[::2] else "/b.csv") for r in bad)
    (tmp_path / "only").mkdir()
    (tmp_path / "only" / "good.csv").write_text("\n".join([HEADER, *GOOD]) + "\n")
    assert rows(good) == rows(read_csv(spark, str(tmp_path / "only"), "subscription_fact"))
    again = read_csv_checked(spark, str(tmp_path / "only"), "subscription_fact", str(tmp_path / "bad"))
    assert rows(again) == rows(good) and spark.read.parquet(str(tmp_path / "bad")).count() == 0
