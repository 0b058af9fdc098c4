"""Every operator as a named query over the driver tables.

A query builds the lens, runs its operator with the parameters below and publishes the result in
plain types (decimals as doubles), under the column names its oracle statement uses.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import replace
from datetime import date
from decimal import Decimal
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from kohorte.operators import (
    accounting, activity, cohorts, counters, dashboards, facts, funnel, hazard, incremental, ledger, payback, projection, retention,
)
from kohorte.functions.gates import REFUND, successful
from kohorte.params import Params
from kohorte.plans.oracle import lens_ltv_windows
from kohorte.session import configure, cut_lineage, shared_folder
from kohorte.sources.catalog import Tables, read_csv, read_csv_checked
from kohorte.sources.driver_lens import lens
from kohorte.sources import sinks
from kohorte.sources.schemas import SCHEMAS
from kohorte.sources.state import remove
from kohorte.sources.stored import NamedInputs
from kohorte.streaming import funnel as streamed

PARAMS = Params(
    as_of=date(2001, 8, 1),
    start=date(1995, 1, 1),
    merchant_sites={"m0": "A", "m1": "A", "m2": "B", "m3": "B", "m4": "B", "m5": "C", "m6": "C"},
    report_sites=("A", "B"),
    processor_merchants=("m0", "m1"),
    funnel_projects=("editor", "web"),
    acquisition_projects=("editor", "web", "mobile"),
    test_subscriptions=(25, 26, 27, 28),
    price_dates={Decimal("39.95"): date(1998, 1, 1), Decimal("49.95"): date(1999, 1, 1)},
)
BASELINE_VOLUME = 100


def publish(df: DataFrame, *, rounded: tuple[str, ...] = (), as_date: tuple[str, ...] = ()) -> DataFrame:
    """Decimals to doubles, integers to bigint; products and sums of doubles cut at six digits."""
    columns = []
    for f in df.schema.fields:
        c, kind = F.col(f.name), f.dataType.simpleString()
        if f.name in rounded:
            c = F.round(c.cast("double"), 6)
        elif f.name in as_date:
            c = c.cast("date")
        elif kind.startswith("decimal"):
            c = c.cast("double")
        elif kind == "int":
            c = c.cast("bigint")
        columns.append(c.alias(f.name))
    return df.select(*columns)


DATES = ("initial_payment_date", "latest_payment_date")


def _kept(t: Tables, p: Params, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A model input under its name, if the tables have a place for it; else stored for this report alone."""
    return t.inputs.get(name, p, build) if t.inputs is not None else cut_lineage(build())


def _fact(t: Tables, p: Params) -> DataFrame:
    def build() -> DataFrame:
        return facts.subscription_fact(t, p, feed="transactions_dup")
    return t.inputs.get("subscription_fact", p, build) if t.inputs is not None else build()


def _model_prep(t: Tables, p: Params) -> DataFrame:
    """Of the fact only subscriptions that a model can take are stored: they are read for the volumes, too."""
    rows = _kept(t, p, "model_rows", lambda: retention.model_rows(_fact(t, p), p).drop("started"))
    return retention.volume_gate(rows, p)


def _prepared(t: Tables, p: Params, tenure_offset: int = 0) -> DataFrame:
    """The invoiced fact folded to cells and stored: one pass over the data, whatever reads the cells."""
    cells = _kept(t, p, f"model_cells_{tenure_offset}", lambda: retention.fold(
        retention.model_rows(_fact(t, p), p, tenure_offset=tenure_offset), "ip_country", "tier", "amount"))
    return retention.volume_gate(cells, p)


def _increase(t: Tables, p: Params) -> DataFrame:
    """Cells of the price-increase model, which counts tenure from the charge after the trial."""
    return _prepared(t, p, tenure_offset=1)


def _segments(t: Tables, p: Params) -> DataFrame:
    return _kept(t, p, "segment_cells", lambda: retention.fold(
        retention.model_rows(facts.subscription_segments(t, p), p, tenure_offset=1, markets=False, annual=True), "user_segment"))


def _users(segments: DataFrame) -> DataFrame:
    return segments.groupBy("user_segment").agg(retention.heads(segments).alias("users"))


def _site_spend(t: Tables, p: Params) -> DataFrame:
    return funnel.spend_by_site(t, p, first_site="B", second_site="A", second_project="web")


def _site_spend_open(t: Tables, p: Params) -> DataFrame:
    """As the multi-site dashboard has it: the second source without a first day."""
    return funnel.spend_by_site(t, p, first_site="B", second_site="A", second_project="web", second_since=None)


def _viewers(t: Tables, p: Params) -> DataFrame:
    return funnel.funnel_by_site(t, p, step_site="B", page_site="A", page_projects=("mobile",))


def _multisite(t: Tables, p: Params, *, legacy_repeat: bool) -> DataFrame:
    return dashboards.dashboard_multisite(
        t, p, spend=_site_spend_open(t, p), viewers=_viewers(t, p), ltv_windows=lens_ltv_windows(), legacy_repeat=legacy_repeat,
        activity=activity.store_ledger(t, p))


def _daily(t: Tables, p: Params, *, legacy_repeat: bool) -> DataFrame:
    return dashboards.dashboard_daily(t, p, legacy_repeat=legacy_repeat, activity=activity.store_transactions(t, p))


def _ltv_by_window(t: Tables, p: Params) -> DataFrame:
    keys = ledger.ledger_enriched(t, p).select("date", "ip_country").distinct()
    return ledger.with_dated_ltv(keys, lens_ltv_windows())


def _ltv_by_window_table(t: Tables, p: Params) -> DataFrame:
    """The same days and countries, valued from a table of windows."""
    keys = ledger.ledger_enriched(t, p).select("date", "ip_country").distinct()
    return ledger.with_dated_ltv(keys, t["ltv_windows"])


def _points(t: Tables, p: Params) -> DataFrame:
    return projection.curve_points(_prepared(t, p), p)


def _loglog(t: Tables, p: Params) -> DataFrame:
    return projection.power_law_loglog(_points(t, p), ["ip_country"])


def _fit(t: Tables, p: Params) -> DataFrame:
    return projection.power_law_fit(_points(t, p), ["ip_country"])


def _projection_curves(t: Tables, p: Params) -> DataFrame:
    return projection.scenario_curves(_prepared(t, p), p, countries=p.model_countries)


def _stitched(t: Tables, p: Params) -> DataFrame:
    return _projection_curves(t, p).where(F.col("price").isNotNull()).select("ip_country", "price", "month", "retention")


def _scenarios(t: Tables, p: Params) -> DataFrame:
    curves = projection.scenario_curves(
        _prepared(t, p), p, countries=p.model_countries, min_volume=BASELINE_VOLUME, baseline_age=180, new_cycles=2)
    return projection.scenario_report(curves, p)


def _projection_check(t: Tables, p: Params) -> DataFrame:
    """The lifetime projection, written as a dimension and read back as of today, beside the published one."""
    spark = t["customers"].sparkSession
    path = f"{shared_folder(spark)}/lifetimes-{uuid4().hex}"
    sinks.write_dimension(projection.ltv_projection_dim(_projection_curves(t, p), p), path, ["country", "price"], p.as_of)
    own = sinks.read_dimension(spark, path, on=p.as_of)
    published = projection.published_lifetimes(t["customers"].sparkSession).withColumnRenamed("lt_36m", "published_lt_36m")
    return own.join(published, ["country", "price"], "left").select(
        "country", "price", "lt_36m", "published_lt_36m", (F.col("lt_36m") - F.col("published_lt_36m")).alias("difference"))


def _lt_cumulative(t: Tables, p: Params) -> DataFrame:
    return projection.lt_cumulative(projection.price_curves(_increase(t, p), p), ["amount"])


def _empirical(segments: DataFrame) -> DataFrame:
    return projection.empirical_hazard(retention.life_table(segments))


def _modelled(segments: DataFrame) -> DataFrame:
    return hazard.segment_hazard(retention.life_table(segments))


def _posterior(segments: DataFrame) -> DataFrame:
    return hazard.segment_posterior(retention.life_table(segments))


def _horizons(t: Tables, p: Params, hazard_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    segments = _segments(t, p)
    return projection.lt_horizons(hazard_of(segments), _users(segments))


def _min_days(t: Tables, p: Params) -> DataFrame:
    """Renewal cycle and maturity rule -> required account age, and subscriptions that have it."""
    prepared = _prepared(t, p)

    def per_rule(rule: str) -> DataFrame:
        counts = retention.retention_counts(prepared, [], p.max_cycles, rule)
        ages = F.array(*[F.lit(retention.maturity_days(r, rule)) for r in range(1, p.max_cycles + 1)])
        return counts.select(F.lit(rule).alias("rule"), "r", F.element_at(ages, F.col("r").cast("int")).alias("min_days"),
                             "eligible")
    return per_rule("first").unionByName(per_rule("second"))


def _csv_roundtrip(t: Tables, p: Params) -> DataFrame:
    """The subscription fact through a CSV export and back, as the models receive it."""
    spark = t["customers"].sparkSession
    path = f"{shared_folder(spark)}/fact-{uuid4().hex}"
    sinks.write_csv(_fact(t, p), path)
    return read_csv(spark, path, "subscription_fact").groupBy("ip_country", "status").agg(
        F.count(F.lit(1)).alias("subscriptions"), F.sum("tenure").alias("tenure"), F.sum("user_revenue").alias("user_revenue"))


def _csv_quarantine(t: Tables, p: Params) -> DataFrame:
    """The subscription fact through a CSV export in which every tenth subscription has a broken row: good rows by status, beside the
    broken ones by reason."""
    spark = t["customers"].sparkSession
    path = f"{shared_folder(spark)}/broken-{uuid4().hex}"
    fact, own = _fact(t, p), F.col("subscription_id")
    texts = fact.select(*[F.col(c).cast("string").alias(c) for c in fact.columns]).withColumns({
        "tenure": F.when(own % 20 == 10, F.lit("many")).otherwise(F.col("tenure")),
        "user_revenue": F.when(own % 20 == 0, F.lit("lots")).otherwise(F.col("user_revenue"))})
    sinks.write_csv(texts, f"{path}/csv")
    good = read_csv_checked(spark, f"{path}/csv", "subscription_fact", f"{path}/quarantine")
    kept = good.groupBy(F.lit("good").alias("kind"), F.col("status").alias("what")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("tenure").alias("tenure"))
    bad = spark.read.parquet(f"{path}/quarantine").groupBy(F.lit("bad").alias("kind"), F.col("reason").alias("what")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.lit(None).cast("bigint").alias("tenure"))
    return kept.unionByName(bad)


def _on_vs_where(t: Tables, p: Params) -> DataFrame:
    """The same condition in ON keeps unmatched customers, in WHERE it does not."""
    txn = t["transactions"].select("id", F.col("customer_id").alias("c"), "transaction_status", "transaction_type")
    people = t["customers"].select(F.col("id").alias("owner"))
    matched = F.col("owner") == F.col("c")
    refund = F.col("transaction_type") == REFUND
    on = people.join(successful(txn).where(refund), matched, "left")
    where = successful(people.join(txn, matched, "left")).where(refund)
    counted = [df.agg(F.count(F.lit(1)).alias("n_rows"), F.count("id").alias("n_matched")).withColumn("placement", F.lit(n))
               for n, df in (("on", on), ("where", where))]
    return counted[0].unionByName(counted[1])


def _dedup(t: Tables, p: Params) -> DataFrame:
    return counters.dedup_latest_txn(t["transactions_dup"])


def _monthly_users(t: Tables, p: Params) -> DataFrame:
    """(month, country) -> exact distinct users of the first step, and whether each step's merged daily sketches come within four standard errors
    (and one user) of the exact number."""
    spark = t["customers"].sparkSession
    path = f"{shared_folder(spark)}/sketches-{uuid4().hex}"
    sinks.write_days(funnel.funnel_sketches(t, p), path)
    month = F.trunc("date", "month").alias("span")
    merged = funnel.sketched_users(spark.read.parquet(path), month, "ip_country").withColumnsRenamed({s: f"{s}_merged" for s in funnel.STEPS})
    exact = funnel.funnel_by_span(t, p, F.trunc(F.col("event_time").cast("date"), "month"))
    both = exact.withColumnRenamed("ip_country", "place").join(
        merged.withColumnRenamed("span", "month"), (F.col("span") == F.col("month")) & F.col("place").eqNullSafe(F.col("ip_country")), "left")
    near = functools.reduce(lambda a, b: a & b, [
        F.abs(F.col(s) - F.col(f"{s}_merged")) <= 1 + 4 * 0.0082 * F.col(s) for s in funnel.STEPS])
    return both.select(F.col("span").alias("date"), F.col("place").alias("ip_country"), *funnel.STEPS, F.coalesce(near, F.lit(False)).alias("merged_agrees"))


def _accounted(report: Callable[[accounting.Account], DataFrame], t: Tables) -> DataFrame:
    """What the gates and joins of a report did, from a run of the whole report."""
    account = accounting.Account()
    report(account).write.format("noop").mode("overwrite").save()
    return account.rows(t["customers"].sparkSession)


STREAM_FEEDS = 4


def _streamed(t: Tables, p: Params) -> DataFrame:
    """The funnel from a stream of the events, in ``STREAM_FEEDS`` feeds of as many days each."""
    spark = t["customers"].sparkSession
    path = f"{shared_folder(spark)}/stream-{uuid4().hex}"
    stamp = F.col("event_time").cast("date")
    first, last = t["events"].agg(F.min(stamp), F.max(stamp)).first()
    days = (last - first).days // STREAM_FEEDS + 1 if first else 1
    for number in range(STREAM_FEEDS):
        own = F.floor(F.datediff(stamp, F.lit(first)) / days) == number
        t["events"].where(F.coalesce(own, F.lit(number == 0))).repartition(2).write.parquet(f"{path}/events/feed={number}")
    stream = spark.readStream.schema(SCHEMAS["events"]).option("maxFilesPerTrigger", 2).parquet(f"{path}/events/*")
    tables = Tables({"events": lambda: stream, "countries": lambda: t["countries"]})
    streamed.write_funnel(streamed.first_sights(tables, p), f"{path}/funnel", f"{path}/checkpoint").awaitTermination()
    return streamed.read_funnel(spark, f"{path}/funnel")


def _feeds(rows: DataFrame, stamp: str, bounds: Sequence[int] = (1996, 1998, 2000)) -> Iterator[DataFrame]:
    """The history in feeds: the years of a timestamp, what lies outside them with the first or last.

    It is read once and stored by feed, as feeds arrive: a filter over it would build the whole history again for every feed
    and every pass over one. The files go when the last feed is folded in.
    """
    spark, year = rows.sparkSession, F.year(stamp)
    number = functools.reduce(lambda cases, i: cases.when(year >= bounds[i], i + 1), reversed(range(len(bounds))), F.when(year.isNull(), 0))
    folder = f"{shared_folder(spark).rstrip('/')}/feeds-{uuid4().hex}"
    rows.withColumn("feed_number", number.otherwise(0)).write.partitionBy("feed_number").parquet(folder)
    stored = spark.read.schema(StructType([*rows.schema.fields, StructField("feed_number", IntegerType())])).parquet(folder)
    for i in range(len(bounds) + 1):
        yield stored.where(F.col("feed_number") == i).drop("feed_number")
    remove(spark, folder)


def _dedup_incremental(t: Tables, p: Params) -> DataFrame:
    """The deduplicated transactions from feeds that are folded in one after the other."""
    rows, spark = t["transactions_dup"], t["customers"].sparkSession
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    latest = incremental.LatestRows(spark, f"{shared_folder(spark)}/latest-{uuid4().hex}", schema)
    for feed in _feeds(rows, "payment_date"):
        latest.fold(feed)
    return latest.read()


def _life_cells(t: Tables, p: Params) -> DataFrame:
    spark = t["customers"].sparkSession
    cells = incremental.LifeCells(spark, f"{shared_folder(spark)}/cells-{uuid4().hex}")
    paid = t["transactions"].select("created_at", *incremental.PAYMENT)
    for number, feed in enumerate(_feeds(paid, "created_at")):
        cells.fold(number, feed, t, p)
    return cells.cells(p)


Builder = Callable[[Tables, Params], DataFrame]

BUILDERS: dict[str, tuple[Builder, Mapping]] = {
    # counters and exports
    "sales_daily": (lambda t, p: counters.sales_daily(t, p, before=p.as_of), {}),
    "registers_daily": (lambda t, p: counters.registers_daily(t, p, first=p.start, last=p.as_of), {}),
    "status_counts": (counters.status_counts, {}),
    "active_subs_no_refund": (counters.active_subs_no_refund, {}),
    "sales_revenue_daily": (counters.sales_revenue_daily, {}),
    "file_size_mix": (lambda t, p: counters.file_size_mix(t, p, first=p.start, last=date(2000, 3, 1)), {}),
    "reviews_export": (lambda t, p: counters.reviews_export(t, p, after=date(1998, 1, 2)), {}),
    "reviews_export_account": (lambda t, p: _accounted(
        lambda account: counters.reviews_export(t, p, after=date(1998, 1, 2), account=account), t), {}),
    "recurrence_per_sub": (counters.recurrence_per_sub, {}),
    "dedup_latest_txn": (_dedup, {"as_date": ("created_at", "payment_date")}),
    "dedup_incremental": (_dedup_incremental, {"as_date": ("created_at", "payment_date")}),
    # cohorts
    "cohort_renewals": (cohorts.cohort_renewals, {}),
    "renewal_windows": (cohorts.renewal_windows, {}),
    # payback
    "payback_daily": (payback.payback_daily, {}),
    "recurrence_ratios": (payback.recurrence_ratios, {}),
    "payback_weekly": (payback.payback_weekly, {}),
    "payback_by_device": (payback.payback_by_device, {}),
    "payback_by_keyword": (payback.payback_by_keyword, {}),
    "cohort_revenue_eur": (payback.cohort_revenue_eur, {}),
    "payback_by_method": (payback.payback_by_method, {}),
    "payback_by_method_ranked": (lambda t, p: payback.payback_by_method(t, p, legacy_rank=True), {}),
    # funnel and spend
    "funnel_daily": (funnel.funnel_daily, {}),
    "funnel_by_site": (_viewers, {}),
    "funnel_monthly": (_monthly_users, {}),
    "funnel_streamed": (_streamed, {}),
    "country_mapping": (lambda t, p: funnel.country_mapping(t), {}),
    "spend_daily": (funnel.spend_daily, {}),
    "spend_by_site": (_site_spend, {}),
    "spend_by_site_open": (_site_spend_open, {}),
    # ledger
    "ledger_enriched": (ledger.ledger_enriched, {}),
    "ledger_reconcile": (ledger.ledger_reconcile, {}),
    "ledger_reconcile_account": (lambda t, p: _accounted(lambda account: ledger.ledger_reconcile(t, p, account=account), t), {}),
    "subscription_net": (ledger.subscription_net, {}),
    "recurrence_pyramid": (lambda t, p: ledger.recurrence_pyramid(t, p, _site_spend(t, p)), {}),
    "sales_by_site": (ledger.sales_by_site, {}),
    "ltv_by_window": (_ltv_by_window, {}),
    "ltv_by_window_table": (_ltv_by_window_table, {}),
    "payback_by_site": (ledger.payback_by_site, {}),
    "payback_by_site_ranked": (lambda t, p: ledger.payback_by_site(t, p, legacy_repeat=True, legacy_rank=True), {}),
    "processor_cohort": (ledger.processor_cohort, {}),
    # dashboards
    "dashboard_daily": (lambda t, p: _daily(t, p, legacy_repeat=False), {}),
    "dashboard_daily_repeat": (lambda t, p: _daily(t, p, legacy_repeat=True), {}),
    "dashboard_multisite": (lambda t, p: _multisite(t, p, legacy_repeat=False), {}),
    "dashboard_multisite_repeat": (lambda t, p: _multisite(t, p, legacy_repeat=True), {}),
    # model input
    "subscription_fact": (_fact, {"as_date": DATES}),
    "subscription_segments": (facts.subscription_segments, {"as_date": DATES}),
    "model_prep": (_model_prep, {"as_date": DATES}),
    # retention
    "segment_descriptives": (lambda t, p: retention.segment_descriptives(_segments(t, p)), {}),
    "price_descriptives": (lambda t, p: retention.price_descriptives(_prepared(t, p)), {}),
    "top_countries": (lambda t, p: retention.top_countries(_prepared(t, p)), {}),
    "cr_by_price": (lambda t, p: retention.cr_by_price(_prepared(t, p)), {}),
    "cr_by_price_increase": (lambda t, p: retention.cr_by_price(_increase(t, p)), {}),
    "life_table": (lambda t, p: retention.life_table(_segments(t, p)), {}),
    "km_survival": (lambda t, p: retention.km_survival(_segments(t, p)), {"rounded": ("survival_rate",)}),
    "life_table_incremental": (lambda t, p: retention.life_table(_life_cells(t, p)), {}),
    "km_survival_incremental": (lambda t, p: retention.km_survival(_life_cells(t, p)), {"rounded": ("survival_rate",)}),
    "empirical_lifetime": (lambda t, p: retention.empirical_lifetime(retention.km_survival(_segments(t, p))),
                           {"rounded": ("lifetime_months",)}),
    "retention_table": (lambda t, p: retention.retention_table(_prepared(t, p), p), {}),
    "retention_curve": (lambda t, p: retention.retention_curve(_prepared(t, p), p), {}),
    "retention_table_increase": (lambda t, p: retention.retention_table(_increase(t, p), p, cycles=4), {}),
    "retention_curve_increase": (lambda t, p: retention.retention_curve(_increase(t, p), p), {}),
    "min_days": (_min_days, {}),
    # projection
    "power_law_loglog": (_loglog, {"rounded": ("alpha", "beta")}),
    "power_law_fit": (_fit, {"rounded": ("alpha", "beta")}),
    "base_curve": (lambda t, p: projection.country_base(_prepared(t, p), p)[1], {"rounded": ("retention",)}),
    "stitched_curve": (_stitched, {"rounded": ("retention",)}),
    "scenario_report": (_scenarios, {"rounded": ("lt_36m", *[f"month_{m}" for m in range(1, 37)])}),
    "ltv_projection_dim": (lambda t, p: projection.ltv_projection_dim(_projection_curves(t, p), p), {}),
    "projection_check": (_projection_check, {}),
    "lt_cumulative": (_lt_cumulative, {"rounded": ("retention", "lifetime")}),
    "curve_detail": (lambda t, p: projection.curve_detail(projection.price_curves(_increase(t, p), p), p), {}),
    # lifetime from hazards
    "segment_hazard": (lambda t, p: _modelled(_segments(t, p)), {"rounded": ("hazard",)}),
    "segment_posterior": (lambda t, p: _posterior(_segments(t, p)), {"rounded": ("hazard", "low", "high")}),
    "lt_horizons": (lambda t, p: _horizons(t, p, _empirical), {}),
    "lt_horizons_modelled": (lambda t, p: _horizons(t, p, _modelled), {}),
    "lt_horizons_posterior": (lambda t, p: _horizons(t, p, lambda s: _posterior(s).select("user_segment", "month", "hazard")), {}),
    "ltv_cumulative": (lambda t, p: projection.ltv_cumulative(_empirical(_segments(t, p)), p), {"rounded": ("ltv",)}),
    "ltv_cumulative_modelled": (lambda t, p: projection.ltv_cumulative(_modelled(_segments(t, p)), p), {"rounded": ("ltv",)}),
    # sources and semantics
    "src_csv_roundtrip": (_csv_roundtrip, {}),
    "src_csv_quarantine": (_csv_quarantine, {}),
    "trap_on_vs_where": (_on_vs_where, {}),
}


# Reports of a day on which much of the data is young: maturity rules and predicted shares matter then.
EARLY = replace(PARAMS, as_of=date(1998, 1, 1))
EARLY_REPORTS = ("payback_daily", "payback_weekly", "payback_by_device", "recurrence_ratios", "retention_table", "retention_curve", "min_days",
                 "cr_by_price", "km_survival", "life_table")
SORTS = {    # order of the reports' rows where they are written (``sinks.write_report``)
    "dashboard_daily": ("-spend", "date", "ip_country"), "renewal_windows": ("-date", "ip_country"),
    "recurrence_pyramid": ("-cohort_date",), "lt_horizons": ("-lt_12", "user_segment"),
}


def run(name: str, spark: SparkSession, folder: str, *, inputs: NamedInputs | None = None) -> DataFrame:
    """A query's result. ``inputs`` keeps the model inputs of all queries that share it (and the data)."""
    early = name.endswith("_early") and name not in BUILDERS
    build, publishing = BUILDERS[name.removesuffix("_early") if early else name]
    tables = lens(configure(spark), folder)
    tables.inputs = inputs
    return publish(build(tables, EARLY if early else PARAMS), **publishing)


def names() -> list[str]:
    return [*BUILDERS, *[f"{name}_early" for name in EARLY_REPORTS]]


def write(name: str, spark: SparkSession, folder: str, path: str) -> None:
    """A report in its order, as Parquet."""
    sinks.write_report(run(name, spark, folder), path, order_by=SORTS.get(name, ()))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, folder, n=name: run(n, spark, folder)) for name in names()}
