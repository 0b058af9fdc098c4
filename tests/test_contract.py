"""The registered queries against their oracle statements, at the smallest scale, and plan checks."""

import pytest

import __spark_entry__ as contract
from check import compare, duck
from fixtures import P, charge, tables
from kohorte.operators.shared import trial_charges
from kohorte.plans import oracle, registry
from kohorte.sources.catalog import from_catalog, from_parquet, read_csv
from kohorte.sources.sinks import write_csv, write_report

FOLDER = "/root/testdata/sf0.001"
ORACLES = oracle.oracle_sql()
QUERIES = {name: contract.queries()[name] for name in registry.queries()}
MODELLED = {"segment_posterior", "lt_horizons_posterior"}
# One or two per family; check.py compares all of them.
COMPARED = ["sales_daily", "cohort_renewals", "renewal_windows", "payback_daily", "payback_by_method", "funnel_daily",
            "recurrence_pyramid", "dashboard_daily", "subscription_fact", "km_survival", "src_csv_roundtrip", "lt_cumulative",
            "scenario_report", "spend_by_site_open", "dashboard_multisite", "retention_curve_increase", "processor_cohort",
            "segment_hazard", "lt_horizons_modelled", "ltv_by_window_table", "dedup_incremental", "life_table_incremental", "funnel_monthly", "funnel_streamed", "projection_check",
            "ledger_reconcile_account", "reviews_export_account", "src_csv_quarantine", "payback_by_method_ranked", "payback_by_site_ranked"]


@pytest.fixture(scope="module")
def duckdb_tables():
    return duck(FOLDER)


def test_every_query_has_an_oracle_unless_modelled():
    assert set(QUERIES) - set(ORACLES) == MODELLED
    assert set(ORACLES) <= set(QUERIES)
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", COMPARED)
def test_matches_oracle(spark, duckdb_tables, name):
    n, problems = compare(name, duckdb_tables, spark, FOLDER, ORACLES[name])
    assert not problems


def test_reports_are_sorted_where_they_are_written(spark, tmp_path):
    registry.write("renewal_windows", spark, FOLDER, str(tmp_path / "report"))
    rows = [(r["date"], r["ip_country"] or "") for r in spark.read.parquet(str(tmp_path / "report")).collect()]
    assert rows and rows == sorted(sorted(rows, key=lambda r: r[1]), key=lambda r: r[0], reverse=True)


@pytest.mark.parametrize("name", ["cohort_renewals", "renewal_windows", "payback_by_method", "dashboard_multisite", "subscription_fact"])
def test_plans_stay_in_the_jvm_without_products(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "ArrowEval", "CartesianProduct", "NestedLoop"))


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    source = tables(spark, [charge(1, 1, "0.95", "2000-02-01")])
    for name in ("transactions", "customers", "invoices_sii"):
        source[name].write.parquet(str(tmp_path / name))
    stored = from_parquet(spark, str(tmp_path), ["transactions", "customers", "invoices_sii"])
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    trials = trial_charges(stored, P, below=P.trial_below, since=P.start)
    assert trials.count() == 1
    plan = trials._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "/transactions]" in line and "FileScan" in line)
    for pushed in ("EqualTo(transaction_status,1)", "EqualTo(transaction_type,0)", "LessThan(amount,", "GreaterThanOrEqual(created_at,2000-01-01"):
        assert pushed in scan
    assert "apm_type" not in scan and "currency" not in scan


def test_sources(spark, tmp_path):
    source = tables(spark, [charge(1, 1, "0.95", "2000-02-01")])
    source["customers"].createOrReplaceTempView("people")
    assert from_catalog(spark, {"customers": "people"})["customers"].count() == 4
    write_csv(source["customers"].select("ip_country", "id"), str(tmp_path / "csv"))
    back = read_csv(spark, str(tmp_path / "csv"), "customers")
    assert back.dtypes == [("ip_country", "string"), ("id", "bigint")] and back.count() == 4
    write_report(source["customers"], str(tmp_path / "report"), partition_by=["ip_country"])
    assert spark.read.parquet(str(tmp_path / "report")).count() == 4
