"""The payment ledger: movements with acquisition country and site, cohorts, recurrence pyramid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kohorte.functions import constants as k
from kohorte.functions import gates
from kohorte.functions.columns import (
    count_if, country_or_unknown, day, local_date, lookup, money, month_start, normal_country, ratio, safe_div, sum_if,
)
from kohorte.operators.accounting import PLAIN, Plain
from kohorte.operators.funnel import located_events
from kohorte.operators.shared import first_rows, with_repeated_ranks
from kohorte.params import Params
from kohorte.sources.catalog import Tables


def is_opening() -> Column:
    return F.col("event_subtype") == k.OPENING_SUBTYPE


def is_charge() -> Column:
    return F.col("event_type") == "charge"


def is_refund() -> Column:
    return F.col("event_type") == "refund"


def movements(t: Tables, p: Params, *, known_customers: bool = True, with_email: bool = False, account: Plain = PLAIN) -> DataFrame:
    """Successful movements of the reported merchants with their site, internal customers left out.

    ``known_customers=False`` skips the customer gate; ``with_email`` adds the customer's address.
    """
    rows = account.gate(t["money_movements"], F.col("merchant_id").isin(list(p.merchant_sites)), "reported merchants")
    rows = account.gate(rows, (F.col("status") == "succeeded") & (F.col("event_date") >= day(p.start)), "succeeded since the start")
    rows = rows.withColumn("site", lookup(F.col("merchant_id"), p.merchant_sites, p.no_site))
    if known_customers:
        owners = gates.external_customers(t["processor_customers"], p.internal_mail).select(
            F.col("id").alias("customer_id"), "email")
        rows = account.join(rows, owners if with_email else owners.select("customer_id"), "customer_id", "external customers",
                            "inner" if with_email else "left_semi")
    return rows


def acquisition_country(t: Tables, p: Params) -> DataFrame:
    """Charge id -> country of its purchase event, one row per charge (the smallest code if several)."""
    events = located_events(t, p, p.acquisition_projects).where(F.col("event_type") == p.purchase_event)
    located = events.select(
        F.get_json_object("event_properties", f"$.{p.charge_key}").alias("charge_id"),
        country_or_unknown(F.coalesce("iso", "country")).alias("event_country"))
    return located.where(F.col("charge_id").isNotNull()).groupBy("charge_id").agg(
        F.min("event_country").alias("event_country"))


def with_country(rows: DataFrame, t: Tables, p: Params, *, account: Plain = PLAIN) -> DataFrame:
    """Country of the purchase event, else of the card, else UNKNOWN."""
    return account.join(rows, acquisition_country(t, p), "charge_id", "purchase events").withColumn(
        "ip_country", normal_country(F.coalesce("event_country", "card_address_country", F.lit("UNKNOWN")))
    ).drop("event_country")


def ledger_enriched(t: Tables, p: Params, *, known_customers: bool = True) -> DataFrame:
    """Movement rows with country and site."""
    return with_country(movements(t, p, known_customers=known_customers), t, p).select(
        F.col("event_date").alias("date"), "event_type", "subscription_id", "event_subtype",
        F.col("recurrence_cycle").cast("bigint").alias("recurrence_cycle"), "card_funding", "ip_country", "gross_amount",
        "payment_method_type", "site", "charge_id", "customer_id")


def ledger_reconcile(t: Tables, p: Params, *, account: Plain = PLAIN) -> DataFrame:
    """Movement rows beside the internal transaction with the same external id, and its invoice. An ``accounting.Account`` tells what
    each gate and join did to the rows."""
    internal = t["transactions"].where(F.col("id_transaction").isNotNull()).select(
        F.col("id_transaction").alias("charge_id"), F.col("id").alias("transaction_id"), "id_transaction",
        F.col("customer_id").alias("customer_id_internal"), F.col("amount").alias("amount_internal"),
        F.col("currency").alias("currency_internal"))
    rows = with_country(movements(t, p, with_email=True, account=account), t, p, account=account)
    rows = account.join(rows, internal, "charge_id", "internal transactions")
    return (
        account.join(rows, t["invoices_sii"], "transaction_id", "invoices")
        .select(F.col("event_date").alias("date"), "event_type", "charge_id",
                F.col("customer_id").alias("processor_customer_id"),
                F.col("subscription_id").alias("processor_subscription_id"), "event_subtype",
                F.col("recurrence_cycle").cast("bigint").alias("recurrence_cycle"), "id_transaction",
                "customer_id_internal", "amount_internal", "currency_internal", "email", "ip_country", "gross_amount",
                "payment_method_type", "invoice_number", "site"))


def subscription_net(t: Tables, p: Params) -> DataFrame:
    """Subscription -> cohort attributes of its first purchase, net revenue, net cycles after it.

    Only the opening charges need a country, so only they meet the purchase events; the totals are a
    map-side aggregate of the whole ledger. Both sides then join on the subscription.
    """
    rows = movements(t, p, known_customers=False)
    opening = with_country(rows.where(is_opening() & is_charge()), t, p).groupBy("subscription_id").agg(
        F.min("event_date").alias("cohort_date"), F.max("ip_country").alias("ip_country"), F.max("site").alias("site"),
        F.max("card_funding").alias("card_funding")).where(F.col("subscription_id").isNotNull())
    totals = rows.groupBy("subscription_id").agg(
        F.sum("gross_amount").cast("decimal(18,2)").alias("net_revenue"),
        (count_if(is_charge()) - count_if(is_refund()) - 1).alias("net_cycles"))
    return opening.join(totals, "subscription_id", "left")


def recurrence_pyramid(t: Tables, p: Params, spend: DataFrame, *, depth: int = 12, ltv_depth: int = 3) -> DataFrame:
    """Cohort (day, country, card funding, site) -> subscriptions and revenue with at least k = 0..depth net cycles.

    ``ltv_rk`` adds up the revenue of the nested sets 0..k, so a long-lived subscription counts once per level.
    ``ltv_rk_exact`` counts every subscription with 0..k net cycles once.
    """
    keys = ["cohort_date", "ip_country", "card_funding", "site"]
    levels, top = range(depth + 1), max(depth, ltv_depth + 1)
    # The pass over subscriptions adds up two numbers per number of cycles, revenue in whole cents; the wide
    # table is made from those few rows.
    per_cycle = subscription_net(t, p).where(F.col("site").isin(list(p.report_sites))).groupBy(
        *keys, F.least(F.col("net_cycles"), F.lit(top)).alias("cycles"),
    ).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("net_revenue") * 100).cast("bigint")).alias("cents"))

    def from_level(i: int, value: str) -> Column:
        return F.sum(F.when(F.col("cycles") >= i, F.col(value)).otherwise(F.lit(0)))

    wide = per_cycle.groupBy(*keys).agg(
        F.sum("n").alias("initial_sales"), *[from_level(i, "n").alias(f"r{i}") for i in levels],
        *[from_level(i, "cents").alias(f"cents_{i}") for i in range(top + 1)])
    cohorts = wide.select(*keys, "initial_sales", *[f"r{i}" for i in levels], *[
        (F.col(f"cents_{i}").cast("decimal(18,0)") / 100).cast("decimal(18,2)").alias(f"rev_r{i}") for i in range(top + 1)])
    size = F.col("initial_sales")

    def nested(i: int) -> Column:
        return sum((F.col(f"rev_r{j}") for j in range(1, i + 1)), F.col("rev_r0"))

    return cohorts.join(spend, (cohorts.cohort_date == spend.date) & (cohorts.ip_country == spend.ip_country)
                        & (cohorts.site == spend.site), "left").select(
        month_start(F.col("cohort_date")).alias("cohort_month"), "cohort_date", cohorts.ip_country, cohorts.site,
        "initial_sales", "card_funding", F.coalesce("spend", F.lit(0).cast("decimal(18,2)")).alias("spend"),
        *[F.col(f"r{i}") for i in levels],
        *[F.col(f"rev_r{i}") for i in levels],
        *[money(ratio(nested(i), size)).alias(f"ltv_r{i}") for i in range(ltv_depth + 1)],
        *[money(ratio(F.col("rev_r0") - F.col(f"rev_r{i + 1}"), size)).alias(f"ltv_r{i}_exact")
          for i in range(ltv_depth + 1)])


def sales_by_site(t: Tables, p: Params, *, activity: DataFrame | None = None) -> DataFrame:
    """(local day, country, site) -> sales, net revenue, number and amount of refunds.

    ``activity``: stored ledger days (``activity.store_ledger``) in place of the movements.
    """
    amount = F.col("gross_amount")
    if activity is None:
        rows = ledger_enriched(t, p).withColumns({"opening": is_opening(), "times": F.lit(1)})
    else:
        rows = activity.where(F.col("part") == "day")
    return rows.groupBy(
        local_date(F.col("date").cast("timestamp"), p.local_zone).alias("date"),
        country_or_unknown(F.col("ip_country")).alias("ip_country"), "site",
    ).agg(
        sum_if(F.col("opening"), F.col("times")).alias("sales"), F.sum(amount).cast("decimal(18,2)").alias("user_revenue"),
        sum_if(is_refund(), F.col("times")).alias("refunds"), (-sum_if(is_refund(), amount)).cast("decimal(18,2)").alias("amount_refunds"))


def dated_values(keys: DataFrame, windows: DataFrame) -> DataFrame:
    """(country, date) rows -> value of the window that covers them; no row where none does.

    ``windows``: (country, valid_from, valid_to, value), both ends included, NULL is open. They may be as many as they like: days
    and windows of a country are swept in order of their dates, the last window that has begun being the only one that can
    cover a day. Windows of one country must not overlap, which is checked on the way, so a country has at most as many of them as the
    calendar has days, and so do its distinct keys: a sweep is no longer than the calendar, however many rows a country has.
    """
    opened = windows.select(
        "country", F.coalesce(F.col("valid_from").cast("date"), day("0001-01-01")).alias("date"),
        F.coalesce(F.col("valid_to").cast("date"), day("9999-12-31")).alias("until"), "value").where(F.col("country").isNotNull())
    in_order = Window.partitionBy("country").orderBy("date", "until")
    clash = F.raise_error(F.concat(F.lit("validity windows of "), "country", F.lit(" overlap at "), F.col("date").cast("string")))
    opened = opened.withColumn("until", F.when(F.lag("until").over(in_order) >= F.col("date"), clash.cast("date")).otherwise(F.col("until")))
    events = opened.select("country", "date", F.struct("until", "value").alias("window")).unionByName(
        keys.select("country", F.col("date").cast("date").alias("date")).distinct().withColumn("asked", F.lit(True)), allowMissingColumns=True)
    # A window that begins on a day covers it: windows come before keys.
    so_far = Window.partitionBy("country").orderBy("date", F.asc_nulls_first("asked")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = events.withColumn("last", F.last("window", ignorenulls=True).over(so_far))
    return swept.where(F.col("asked") & (F.col("last.until") >= F.col("date"))).select("country", "date", F.col("last.value").alias("value"))


def with_dated_ltv(rows: DataFrame, windows: DataFrame | Sequence[tuple] = tuple(k.DATED_LTV), default=k.DATED_LTV_DEFAULT) -> DataFrame:
    """Adds ``ltv`` by country and date from closed validity windows (None is open); gaps take the default.

    ``windows`` is a table (country, valid_from, valid_to, value) of any size or a list of such rows.
    """
    if not isinstance(windows, DataFrame):
        check_windows(windows)
        windows = rows.sparkSession.createDataFrame(
            [tuple(w) for w in windows], "country string, valid_from string, valid_to string, value decimal(10,2)")
    found = dated_values(rows.select(F.col("ip_country").alias("country"), "date"), windows).select(
        F.col("country").alias("ltv_country"), F.col("date").alias("ltv_date"), F.col("value").cast("decimal(10,2)").alias("ltv"))
    same = (F.col("ip_country") == F.col("ltv_country")) & (F.col("date").cast("date") == F.col("ltv_date"))
    return rows.join(found, same, "left").withColumn(
        "ltv", F.coalesce("ltv", F.lit(default).cast("decimal(10,2)"))).drop("ltv_country", "ltv_date")


def check_windows(windows: Sequence[tuple]) -> None:
    by_country: dict[str, list[tuple[str, str]]] = {}
    for country, first, last, _ in windows:
        by_country.setdefault(country, []).append((first or "0001-01-01", last or "9999-12-31"))
    for country, spans in by_country.items():
        spans.sort()
        for (_, last), (first, _) in zip(spans, spans[1:]):
            if first <= last:
                raise ValueError(f"validity windows of {country} overlap at {first}")


def payback_by_site(t: Tables, p: Params, *, legacy_repeat: bool = False, legacy_rank: bool = False) -> DataFrame:
    """(cohort day, country, site) -> charges, refunds, revenue, revenue of the first three rows per event type
    (refunds included), subscriptions with a net renewal.

    ``legacy_rank=True`` ranks rows after each is repeated for each opening of its subscription (``shared.with_repeated_ranks``).
    """
    rows = movements(t, p).where(F.col("subscription_id").isNotNull())
    opened = with_country(rows.where(is_opening()), t, p)
    if legacy_rank:
        opened = with_repeated_ranks(opened, "charge_id", p.payback_charges)
    cohort = opened.groupBy("subscription_id", F.col("event_date").alias("cohort_date"), "ip_country", "site",
                            *(["n_own", "n_early"] if legacy_rank else [])).agg(F.count(F.lit(1)).alias("n_trials"))
    totals = rows.groupBy("subscription_id").agg(
        count_if(is_charge()).alias("n_charges"), count_if(is_refund()).alias("n_refunds"),
        F.sum("gross_amount").cast("decimal(18,2)").alias("revenue"))
    early = first_rows(rows.select("subscription_id", "event_type", "event_date", "charge_id", "gross_amount"),
                       ["subscription_id", "event_type"], ["event_date", "charge_id"], p.payback_charges)
    early = early.groupBy("subscription_id").agg(F.sum("gross_amount").cast("decimal(18,2)").alias("early_revenue"),
                                                 F.collect_list(F.struct("rank", "gross_amount")).alias("early_rows"))
    joined = cohort.join(totals, "subscription_id", "left").join(early, "subscription_id", "left")
    if legacy_rank:
        zero = F.lit(0).cast("decimal(18,2)")
        joined = joined.withColumn("early_revenue", F.aggregate(
            F.filter("early_rows", lambda r: r["rank"] <= F.col("n_early")), zero, lambda acc, r: (acc + r["gross_amount"]).cast("decimal(18,2)")))
    return site_payback(joined, legacy_repeat=legacy_repeat, repeats=F.col("n_own") if legacy_rank else None)


def site_payback(rows: DataFrame, *, legacy_repeat: bool, repeats: Column | None = None) -> DataFrame:
    """Cohort rows with their subscription's totals and early revenue, folded to (cohort day, country, site)."""
    n = F.col("n_trials")
    times = n * (F.col("n_charges") + F.col("n_refunds")) if legacy_repeat else n
    net = F.col("n_charges") - F.col("n_refunds")
    if repeats is None:
        first_renewals = count_if(net > 1)
    else:       # a subscription may have several rows in a cohort: one for each number of early rows
        rows, times = rows.withColumn("renewed", repeats * net > 1), times * repeats if legacy_repeat else times
        first_renewals = F.count_distinct(F.when(F.col("renewed"), F.col("subscription_id")))
    return rows.groupBy("cohort_date", "ip_country", "site").agg(
        F.sum(times * F.col("n_charges")).alias("charges"), F.sum(times * F.col("n_refunds")).alias("refunds"),
        F.sum(n * F.col("revenue")).cast("decimal(18,2)").alias("real_revenue"),
        F.sum(n * F.col("early_revenue")).cast("decimal(18,2)").alias("real_revenue_37d"),
        first_renewals.alias("first_renewals"))


def processor_cohort(t: Tables, p: Params, *, subscription: str | None = None, legacy: bool = False) -> DataFrame:
    """(cohort day, country) -> charges, refunds and net revenue in EUR from the processor's own tables (cents).

    Refunds are counted per charge before they meet it, so two refunds of one charge do not repeat its amount. Neither
    do two invoices, of which the smallest subscription id counts; ``legacy`` repeats a charge for each of them.
    """
    own = F.col("merchant_id").isin(list(p.processor_merchants)) & (F.col("status") == "succeeded")
    refunds = t["processor_refunds"].where(own & (F.col("amount") > 0)).groupBy(F.col("charge_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n_refunds"))
    invoices = t["processor_invoices"].select(F.col("charge_id").alias("id"), "subscription_id")
    if not legacy:
        invoices = invoices.groupBy("id").agg(F.min("subscription_id").alias("subscription_id"))
    owners = gates.external_customers(t["processor_customers"], p.internal_mail, keep_missing=True).select(
        F.col("id").alias("customer_id"))
    rates = t["eur_exchange_rates"].select("date", F.lower("code").alias("currency"), "rate")
    charges = (
        t["processor_charges"].where(own).withColumn("date", F.col("captured_at").cast("date"))
        .join(invoices, "id").join(refunds, "id", "left").join(owners, "customer_id")
        .join(rates, ["date", "currency"], "left")
        .withColumns({
            "ip_country": F.coalesce("card_country", "card_address_country", F.lit("UNKNOWN")),
            "eur": safe_div((F.col("amount") - F.col("amount_refunded")) / 100, F.col("rate").cast("double"))}))
    if subscription is not None:
        charges = charges.where(F.col("subscription_id") == subscription)
    cohort = charges.where((F.col("description") == p.creation_text) & F.col("subscription_id").isNotNull()).groupBy(
        "subscription_id", F.col("date").alias("cohort_date"), "ip_country").agg(F.count(F.lit(1)).alias("n_trials"))
    totals = charges.groupBy("subscription_id").agg(
        F.count(F.lit(1)).alias("charges"), F.sum(F.coalesce("n_refunds", F.lit(0))).alias("refunds"),
        F.sum("eur").alias("revenue"))
    n = F.col("n_trials")
    return cohort.join(totals, "subscription_id").groupBy("cohort_date", "ip_country").agg(
        F.sum(n * F.col("charges")).alias("sub_charges"), F.sum(n * F.col("refunds")).alias("sub_refunds"),
        money(F.sum(n * F.col("revenue"))).alias("real_revenue"))
