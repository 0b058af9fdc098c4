from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fixtures import P, at, charge, table, tables
from kohorte.functions import constants as k
from kohorte.operators import cohorts, counters, dashboards, funnel, ledger, payback
from kohorte.operators.facts import subscription_fact, subscription_segments
from kohorte.sources.catalog import Tables


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_latest_copy_wins_and_ties_are_stable(spark):
    txn = table(spark, "transactions", [
        charge(1, 1, "0.95", "2000-02-01"), charge(1, 1, "0.95", "2000-02-03"),
        charge(2, 1, "5.00", "2000-02-01"), charge(2, 1, "9.00", "2000-02-01")])
    for parts in (1, 5):
        got = counters.dedup_latest_txn(txn.repartition(parts))
        assert rows(got, "id", "amount", F.col("payment_date").cast("date")) == [
            (1, Decimal("0.95"), date(2000, 2, 3)), (2, Decimal("9.00"), date(2000, 2, 1))]


def test_renewals_count_a_subscription_once_per_trial(spark):
    t = tables(spark, [
        charge(1, 1, "0.95", "2000-02-01"), charge(2, 1, "0.95", "2000-02-01"), charge(3, 1, "29.95", "2000-02-08"),
        charge(4, 1, "29.95", "2000-03-08"), charge(5, 1, "29.95", "2000-03-09", kind=1), charge(6, 2, "0.95", "2000-02-01"),
        charge(7, 3, "0.95", "2000-02-01", customer=2), charge(8, 4, "0.95", "2000-02-01", customer=3)])
    got = cohorts.cohort_renewals(t, P)
    # twice (2 * 0.95 + 29.95) rounded, plus one lone trial; internal and unaddressed customers are out
    assert rows(got, "date", "ip_country", "sales", "revenue", "renewal", "renewal_2", "refunds") == [
        (date(2000, 2, 1), "US", 2, 64 + 1, 1, 1, 2)]


def test_second_invoice_repeats_only_in_legacy(spark):
    t = tables(spark, [charge(1, 1, "0.95", "2000-02-01")], invoices_sii=[(1, "A"), (1, "B")])
    assert rows(cohorts.cohort_renewals(t, P), "revenue") == [(1,)]
    assert rows(cohorts.cohort_renewals(t, P, legacy=True), "revenue") == [(4,)]


@pytest.mark.parametrize("requested,expected", [
    (None, (0, 0, 0)), ("2000-02-05", (1, 0, 0)), ("2000-02-08", (0, 1, 0)), ("2000-02-20", (0, 1, 0)), ("2000-03-08", (0, 0, 1))])
def test_unsubscribe_windows_are_half_open(spark, requested, expected):
    sub = (1, 1, 0, 1, "Active", at("2000-02-01"), requested and at(requested), None)
    t = tables(spark, [charge(1, 1, "0.95", "2000-02-01"), charge(2, 1, "29.95", "2000-02-08"),
                       charge(3, 1, "29.95", "2000-03-08")], subscriptions=[sub])
    got = cohorts.renewal_windows(t, P)
    assert rows(got, "req_before_r1", "req_before_r2", "req_before_r3") == [expected]


def test_refund_windows(spark):
    t = tables(spark, [charge(1, 1, "0.95", "2000-02-01"), charge(2, 1, "29.95", "2000-02-08"),
                       charge(3, 1, "29.95", "2000-03-08"), charge(4, 1, "29.95", "2000-02-08", kind=1),
                       charge(5, 1, "29.95", "2000-03-09", kind=1), charge(6, 2, "0.95", "2000-02-01"),
                       charge(7, 2, "0.95", "2000-02-02", kind=1)])
    got = cohorts.renewal_windows(t, P)
    assert rows(got, "sales", "ref_before_r1", "ref_before_r2", "ref_before_r3") == [(2, 1, 1, 1)]


def test_payback_window_takes_three_charges_and_refunds_to_day_37(spark):
    t = tables(spark, [charge(1, 1, "0.95", "2000-02-01"), charge(2, 1, "29.95", "2000-02-08"),
                       charge(3, 1, "29.95", "2000-03-07"), charge(4, 1, "29.95", "2000-04-04"),
                       charge(5, 1, "10.00", "2000-03-09", kind=1), charge(6, 1, "20.00", "2000-03-10", kind=1)])
    columns = ("sales", "charges", "refunds", "real_revenue", "real_revenue_37d", "first_renewals")
    assert rows(payback.payback_by_country(t, P), *columns) == [
        (1, 4, 2, Decimal("60.80"), Decimal("50.85"), 1)]
    # totals once per transaction row: six rows
    assert rows(payback.payback_by_country(t, P, legacy_repeat=True), "charges", "refunds") == [(24, 12)]


@pytest.mark.parametrize("rate", [Decimal("0.0000"), None])
def test_missing_rate_is_ignored(spark, rate):
    t = tables(spark, [charge(1, 1, "0.95", "2000-02-01"), charge(2, 2, "0.95", "2000-02-01", currency="USD")],
               eur_exchange_rates=[(date(2000, 2, 1), "EUR", Decimal("2.0000")), (date(2000, 2, 1), "USD", rate)])
    assert rows(payback.cohort_revenue_eur(t, P), "total_amount", "real_revenue") == [(Decimal("0.48"), Decimal("0.48"))]


def test_smart_equals_real_for_mature_cohorts(spark):
    t = tables(spark, [charge(1, 1, "0.95", "2000-02-01"), charge(2, 1, "29.95", "2000-02-08"),
                       charge(3, 2, "0.95", "2000-12-20")])
    daily = rows(payback.payback_daily(t, P), "cohort_date", "predicted_d35_revenue", "real_d35_revenue", "smart_d35_revenue")
    assert daily == [(date(2000, 2, 1), Decimal("0.95"), Decimal("30.90"), Decimal("30.90")),
                     (date(2000, 12, 20), Decimal("0.95"), Decimal("0.95"), Decimal("0.95"))]


def test_subscriptions_with_a_refund_are_not_active(spark):
    t = tables(spark, [charge(1, 1, "0.95", "2000-02-01"), charge(2, 2, "0.95", "2000-02-01"),
                       charge(3, 2, "0.95", "2000-02-03", kind=1)])
    assert rows(counters.active_subs_no_refund(t, P), "subscription_status", "total") == [("Active", 1)]
    assert rows(counters.status_counts(t, P), "subscription_status", "total") == [("Active", 2)]


def test_fact_takes_highest_country_or_customers(spark):
    t = tables(spark, [charge(1, 1, "0.95", "2000-02-01", agent=1), charge(2, 1, "29.95", "2000-02-08", agent=2),
                       charge(3, 2, "0.95", "2000-02-01", agent=1), charge(4, 3, "0.95", "2000-02-01"),
                       charge(5, 3, "0.95", "2000-02-02", kind=1)])
    got = subscription_fact(t, P)
    assert rows(got, "subscription_id", "tenure", "ip_country", "cohort") == [
        (1, 2, "US", date(2000, 2, 1)), (2, 1, "GB", date(2000, 2, 1))]
    assert rows(subscription_segments(t, P), "subscription_id", "tenure", "ip_country", "cohort", "user_segment") == [
        (1, 1, "GB", "2000-02", "B2C"), (1, 1, "US", "2000-02", "B2C"), (2, 1, "GB", "2000-02", "B2C")]


def test_dated_ltv_gaps_take_the_default(spark):
    days = [(date(2026, 3, d), "US") for d in (24, 25, 26, 27)] + [(date(2026, 3, 24), "JP"), (date(2026, 3, 24), "ES")]
    got = ledger.with_dated_ltv(spark.createDataFrame(days, "date date, ip_country string"))
    assert {(r["date"].day, r["ip_country"]): str(r["ltv"]) for r in got.collect()} == {
        (24, "US"): "100.90", (25, "US"): "92.24", (26, "US"): "92.24", (27, "US"): "85.94", (24, "JP"): "92.24",
        (24, "ES"): "101.60"}


def test_overlapping_windows_are_refused():
    ledger.check_windows(k.DATED_LTV)
    with pytest.raises(ValueError):
        ledger.check_windows([("US", "2026-01-01", "2026-02-01", 1), ("US", "2026-02-01", None, 2)])


def test_country_mapping_merges_uk(spark):
    t = Tables({"countries": lambda: table(spark, "countries", [
        ("United Kingdom ", "UK"), ("united kingdom", "GB"), ("Spain", "ES")])})
    assert rows(funnel.country_mapping(t), "c_name", "iso") == [("spain", "ES"), ("united kingdom", "GB")]


def test_spine_keeps_null_keys_without_measures(spark):
    a = spark.createDataFrame([("d1", "US", 5), ("d1", None, 7)], "date string, ip_country string, spend bigint")
    b = spark.createDataFrame([("d1", "US", 1), ("d2", "FR", 2)], "date string, ip_country string, charges bigint")
    got = dashboards.on_spine([(a, ["spend"], True), (b, ["charges"], False)], ["date", "ip_country"])
    assert {(r["date"], r["ip_country"]): (r["spend"], r["charges"]) for r in got.collect()} == {
        ("d1", "US"): (5, 1), ("d1", None): (None, None)}


def test_distinct_users_ignores_missing_user(spark):
    events = spark.createDataFrame([("d", 1, "x"), ("d", 1, "x"), ("d", 2, "y"), ("d", None, "x")], "date string, amplitude_id int, e string")
    got = funnel.distinct_users(events, {"x": F.col("e") == "x", "y": F.col("e") == "y"}, "date")
    assert rows(got, "x", "y") == [(1, 1)]


def test_hot_subscription_against_brute_force(spark):
    """A third of the charges on one subscription, every join planned as a shuffle join."""
    txn, key = [], 0
    for i in range(300):
        key += 1
        sub = 1 if i % 3 == 0 else 2 + i % 7
        txn.append(charge(key, sub, "0.95" if i < 9 else "29.95", f"2000-0{2 + i % 6}-{1 + i % 27:02d}"))
        if i % 10 == 0:
            key += 1
            txn.append(charge(key, sub, "29.95", f"2000-0{3 + i % 5}-{1 + i % 27:02d}", kind=1))
    t = tables(spark, txn)
    small = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(small)
    spark.conf.set(small, "-1")
    try:
        got = rows(payback.payback_by_country(t, P), "cohort_date", "sales", "charges", "refunds", "real_revenue", "real_revenue_37d")
    finally:
        spark.conf.set(small, before)
    want = {}
    for trial in txn:
        if trial[7] == 0 and trial[9] == Decimal("0.95"):
            mine = [x for x in txn if x[3] == trial[3]]
            paid = sorted((x for x in mine if x[7] == 0), key=lambda x: (x[12], x[0]))
            back = [x for x in mine if x[7] == 1]
            cell = want.setdefault(trial[12].date(), [set(), 0, 0, Decimal(0), Decimal(0)])
            cell[0].add(trial[3])
            cell[1] += len(paid)
            cell[2] += len(back)
            cell[3] += sum(x[9] for x in paid) - sum(x[9] for x in back)
            cell[4] += sum(x[9] for x in paid[:3]) - sum(
                x[9] for x in back if (x[12].date() - trial[12].date()).days <= 37)
    assert got == sorted((d, len(c[0]), *c[1:]) for d, c in want.items())
