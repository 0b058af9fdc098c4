"""Stored activity, validity windows as a table."""

import random
from datetime import date, timedelta
from decimal import Decimal

import pytest

from fixtures import P, charge, tables
from kohorte.functions import constants as k
from kohorte.operators import activity, counters, dashboards, ledger, payback
from kohorte.plans import registry
from kohorte.plans.registry import PARAMS, _site_spend_open, _viewers
from kohorte.sources.driver_lens import lens
from kohorte.sources.stored import NamedInputs

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def unbroadcast(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for key in keys:
        spark.conf.set(key, "-1")
    yield
    for key in keys:
        spark.conf.unset(key)


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.select(a.columns).collect()))


def test_subscription_key_needs_no_exchange_after_the_write(spark, unbroadcast):
    t = lens(spark, FOLDER)
    stored = activity.store_transactions(t, PARAMS)
    paid = activity.payback_by_country(stored, t, PARAMS)
    for df in (paid, dashboards.dashboard_daily(t, PARAMS, activity=stored)):
        text = plan(df)
        assert "subscription_days" in text and "hashpartitioning(subscription" not in text
    moved = activity.store_ledger(t, PARAMS)
    whole = dashboards.dashboard_multisite(t, PARAMS, spend=_site_spend_open(t, PARAMS), viewers=_viewers(t, PARAMS), ltv_windows=k.DATED_LTV,
                                           activity=moved)
    assert "ledger_days" in plan(whole) and "hashpartitioning(subscription" not in plan(whole)
    # What reads the stored days doesn't read the payments again.
    assert "orders.parquet" not in plan(activity.payback_by_site(moved))


@pytest.mark.parametrize("repeat", [False, True])
def test_stored_reports_equal_those_from_raw_tables(spark, repeat):
    t = lens(spark, FOLDER)
    stored, moved = activity.store_transactions(t, PARAMS), activity.store_ledger(t, PARAMS)
    assert same(activity.payback_by_country(stored, t, PARAMS, legacy_repeat=repeat), payback.payback_by_country(t, PARAMS, legacy_repeat=repeat))
    assert same(activity.payback_by_site(moved, legacy_repeat=repeat), ledger.payback_by_site(t, PARAMS, legacy_repeat=repeat))
    assert same(counters.sales_revenue_daily(t, PARAMS, activity=stored), counters.sales_revenue_daily(t, PARAMS))
    assert same(ledger.sales_by_site(t, PARAMS, activity=moved), ledger.sales_by_site(t, PARAMS))


def test_stored_activity_of_odd_payments(spark):
    """No subscription, no invoice, two invoices, two currencies, payments of one moment, internal customers, refunds after 37 days."""
    charges = [
        charge(1, 1, "0.95", "2000-02-01"), charge(2, 1, "0.95", "2000-02-01", currency="USD"), charge(3, 1, "29.95", "2000-02-01"),
        charge(4, 1, "39.95", "2000-02-01"), charge(5, 1, "29.95", "2000-02-09"), charge(6, 1, "29.95", "2000-02-09", kind=1),
        charge(7, 1, "29.95", "2000-06-09", kind=1), charge(8, None, "0.95", "2000-02-01"), charge(9, None, "29.95", "2000-02-01"),
        charge(10, 2, "0.95", "2000-02-01", customer=2), charge(11, 3, "0.95", "2000-02-01", status=0), charge(12, 3, "0.95", "2000-02-02"),
        charge(13, 4, "0.95", "2000-02-02", agent=1), charge(14, 5, "0.95", "2000-02-02", customer=4, agent=1), charge(15, 99, "0.95", "2000-02-03")]
    charges += [charge(100 + i, 7, "0.95" if i == 0 else "29.95", f"2000-03-{i % 28 + 1:02d}") for i in range(60)]     # one large subscription
    invoices = [(c[0], None if c[0] == 5 else f"INV-{c[0]}") for c in charges if c[0] not in (3, 12)] + [(1, "B")]
    rates = [(date(2000, m, d), c, Decimal(r)) for m in (2, 3) for d in range(1, 29) for c, r in (("EUR", "1.0000"), ("USD", "1.2500"))]
    t = tables(spark, charges, invoices_sii=invoices, eur_exchange_rates=rates)
    stored = activity.store_transactions(t, P)
    assert same(activity.payback_by_country(stored, t, P), payback.payback_by_country(t, P))
    assert same(counters.sales_revenue_daily(t, P, activity=stored), counters.sales_revenue_daily(t, P))
    loose = stored.where("subscription_id is null").select(activity.KEY).collect()
    assert loose and all(r[0] < 0 for r in loose)
    none = stored.limit(0)
    assert activity.payback_by_country(none, t, P).collect() == []


def covering(windows, country, day):
    return next((v for c, a, b, v in windows if c == country and (a or date.min) <= day <= (b or date.max)), None)


def test_windows_of_any_number_against_all_pairs(spark):
    """Gaps, open ends, windows of a day, countries without windows, null keys."""
    rng, windows, first = random.Random(5), [], date(2000, 1, 1)
    for n in range(40):
        at_day, end = 0, rng.randint(0, 300)
        while at_day < end:
            length = rng.choice([0, 0, 1, 5, 30])
            a, b = first + timedelta(at_day), first + timedelta(at_day + length)
            windows.append((f"c{n}", a, b, Decimal(len(windows))))
            at_day += length + 1 + rng.choice([0, 0, 3])
        if n % 4 == 0 and at_day:
            windows.append((f"c{n}", first + timedelta(at_day), None, Decimal("-1.00")))
        if n % 5 == 0:
            windows.append((f"c{n}", None, first - timedelta(3), Decimal("-2.00")))
    table = spark.createDataFrame(windows, "country string, valid_from date, valid_to date, value decimal(10,2)")
    keys = [(f"c{rng.randrange(45)}", first + timedelta(rng.randint(-9, 310)), i) for i in range(3000)] + [(None, first, -1), ("c0", None, -2)]
    rows = spark.createDataFrame(keys, "ip_country string, date date, n int")
    got = {r["n"]: r["ltv"] for r in ledger.with_dated_ltv(rows, table, Decimal("7.00")).collect()}
    assert got == {i: Decimal("7.00") if (v := covering(windows, c, d) if c and d else None) is None else v for c, d, i in keys}
    text = plan(ledger.with_dated_ltv(rows, table))
    assert "NestedLoop" not in text and "Cartesian" not in text
    assert {r["ltv"] for r in ledger.with_dated_ltv(rows, table.limit(0), Decimal("7.00")).collect()} == {Decimal("7.00")}


def test_overlapping_windows_are_an_error(spark):
    table = spark.createDataFrame([("ES", date(2000, 1, 1), None, Decimal("1")), ("ES", date(2000, 5, 1), None, Decimal("2"))],
                                  "country string, valid_from date, valid_to date, value decimal(10,2)")
    keys = spark.createDataFrame([("ES", date(2000, 6, 1))], "country string, date date")
    with pytest.raises(Exception, match="validity windows of ES overlap"):
        ledger.dated_values(keys, table).collect()


def test_model_inputs_are_written_once_for_all_models(spark, tmp_path):
    """Reports that share them give the same rows as alone and don't read the payments again; other parameters have inputs of their own."""
    inputs = NamedInputs(spark, str(tmp_path / "inputs"))
    names = ["retention_curve", "cr_by_price", "model_prep", "ltv_projection_dim", "life_table", "km_survival", "retention_curve_early"]
    own = {name: sorted(map(repr, registry.run(name, spark, FOLDER).collect())) for name in names}
    written = {}
    for name in names:
        assert sorted(map(repr, registry.run(name, spark, FOLDER, inputs=inputs).collect())) == own[name]
        files = {f: f.stat().st_mtime_ns for f in (tmp_path / "inputs").rglob("*.parquet")}
        assert written.items() <= files.items()
        written = files
    tables = {f.parent.name.rpartition("-")[0] for f in written}
    assert tables == {"subscription_fact", "model_rows", "model_cells_0", "segment_cells"}
    assert len({f.parent.name for f in written}) == len(tables) + 2        # the early report's fact and cells
    again = NamedInputs(spark, str(tmp_path / "inputs"))
    assert "orders.parquet" not in plan(registry.run("cr_by_price", spark, FOLDER, inputs=again))
    again.forget("segment_cells", PARAMS)
    assert sorted(map(repr, registry.run("life_table", spark, FOLDER, inputs=again).collect())) == own["life_table"]
