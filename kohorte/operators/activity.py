"""Stored activity of subscriptions: the transactions and the ledger folded once, for all reports that read them.

Each table has one row per subscription, day and kind of payment (``part`` = ``day``) and the first payments of each
subscription (``part`` = ``first``). Everything that a report needs of the payer, the plan and the purchase event is resolved before
the table is written, so what reads it groups and joins by ``subscription_key`` without another exchange. A report takes
the stored frame in place of the raw tables: ``sales_revenue_daily(t, p, activity=...)``.

``subscription_key`` is the subscription's id; payments without one get a negative key each by payer and day, so that they
don't meet in one bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kohorte.functions import gates
from kohorte.functions.columns import count_if, money, safe_div, sum_if
from kohorte.operators import ledger
from kohorte.operators.shared import customer_keys, first_rows, is_charge, is_refund, on_or_after, subscription_prices
from kohorte.params import Params
from kohorte.sources.catalog import Tables
from kohorte.sources.stored import store_bucketed

KEY = "subscription_key"
PAYMENT = ["subscription_id", "customer_id", "transaction_type", "amount", "currency", "user_agent_id", "utms_id", "mid_id", "apm_type"]


def _keyed(df: DataFrame, *spread: str) -> DataFrame:
    """Adds the key; a text id is hashed."""
    own = F.col("subscription_id")
    if df.schema["subscription_id"].dataType.simpleString() == "string":
        own = F.when(own.isNotNull(), F.xxhash64(own).bitwiseAND(2**62 - 1))
    return df.withColumn(KEY, F.coalesce(own.cast("bigint"), -1 - F.xxhash64(*spread).bitwiseAND(2**40 - 1)))


def _payer(rows: DataFrame, t: Tables, p: Params) -> DataFrame:
    """Adds the customer's country, whether the customer is external, and the country and device of the user agent."""
    people = customer_keys(t, p).withColumn("external", F.lit(True))
    agents = t["http_user_agents"].select(F.col("id").alias("user_agent_id"), "device", F.col("ip_country_iso_code").alias("agent_country"))
    return rows.join(people, "customer_id", "left").join(agents, "user_agent_id", "left").withColumn(
        "external", F.coalesce("external", F.lit(False)))


def subscription_days(t: Tables, p: Params) -> DataFrame:
    """Successful transactions by subscription, day, type, amount and attributes, with their number and how many of them have an invoice
    (``invoiced``) and one with a number (``numbered``); and each subscription's first ``p.payback_charges`` charges."""
    paid = gates.successful(t["transactions"])
    has_invoice = t["invoices_sii"].groupBy(F.col("transaction_id").alias("id")).agg(
        F.max(F.col("invoice_number").isNotNull().cast("int")).alias("numbered"))
    day_rows = paid.join(has_invoice, "id", "left").groupBy(*PAYMENT, F.col("created_at").cast("date").alias("date")).agg(
        F.count(F.lit(1)).alias("times"), F.count("numbered").alias("invoiced"), F.coalesce(F.sum("numbered"), F.lit(0)).alias("numbered"))
    plans = subscription_prices(t).select("subscription_id", "price_trial")
    days = _payer(day_rows.join(plans, "subscription_id", "left"), t, p).withColumn("part", F.lit("day"))
    early = first_rows(gates.successful_charges(paid).where(F.col("subscription_id").isNotNull()).select("subscription_id", "created_at", "id", "amount"),
                       ["subscription_id"], ["created_at", "id"], p.payback_charges)
    first = early.select("subscription_id", "amount", F.col("created_at").cast("date").alias("date"),
                         F.lit(gates.CHARGE).alias("transaction_type"), F.lit(1).cast("bigint").alias("times"), F.lit("first").alias("part"))
    return _keyed(days.unionByName(first, allowMissingColumns=True), "customer_id", "date")


def ledger_days(t: Tables, p: Params) -> DataFrame:
    """Ledger movements of known external customers by subscription, day, type, site and country of acquisition, with number and amount; and each
    subscription's first ``p.payback_charges`` movements of each type."""
    rows = ledger.movements(t, p)
    keys = ["subscription_id", F.col("event_date").alias("date"), "event_type", ledger.is_opening().alias("opening"), "site", "ip_country"]
    days = ledger.with_country(rows, t, p).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("times"), F.sum("gross_amount").cast("decimal(18,2)").alias("gross_amount")).withColumn("part", F.lit("day"))
    early = first_rows(
        rows.where(F.col("subscription_id").isNotNull()).select("subscription_id", "event_type", "event_date", "charge_id", "gross_amount"),
        ["subscription_id", "event_type"], ["event_date", "charge_id"], p.payback_charges)
    first = early.select("subscription_id", "event_type", F.col("event_date").alias("date"), F.col("gross_amount").cast("decimal(18,2)").alias("gross_amount"),
                         F.lit(1).cast("bigint").alias("times"), F.lit("first").alias("part"))
    return _keyed(days.unionByName(first, allowMissingColumns=True), "date", "ip_country", "site")


def store_transactions(t: Tables, p: Params) -> DataFrame:
    return store_bucketed(subscription_days(t, p), KEY, "subscription_days")


def store_ledger(t: Tables, p: Params) -> DataFrame:
    return store_bucketed(ledger_days(t, p), KEY, "ledger_days")


# ------------------------------------------------------------------ what reports read


def _days(activity: DataFrame) -> DataFrame:
    return activity.where(F.col("part") == "day")


def _first(activity: DataFrame) -> DataFrame:
    return activity.where(F.col("part") == "first")


def paid_sales(activity: DataFrame, p: Params) -> DataFrame:
    """Payments with a numbered invoice of external customers since the start, ``times`` counting those with one."""
    rows = _days(activity).where(F.col("external") & (F.col("numbered") > 0))
    return on_or_after(rows, "date", p.start).withColumn("times", F.col("numbered"))


def priced_trials(activity: DataFrame, p: Params) -> DataFrame:
    """Invoiced charges that equal the trial price of their plan, ``times`` counting them; the country falls back to the user agent's."""
    rows = _days(activity).where(is_charge() & F.col("external") & (F.col("invoiced") > 0) & (F.col("amount") == F.col("price_trial"))
                                 & F.col("subscription_id").isNotNull())
    return on_or_after(rows, "date", p.start).withColumns(
        {"times": F.col("invoiced"), "ip_country": F.coalesce("ip_country", "agent_country")})


def totals(activity: DataFrame) -> DataFrame:
    """Per subscription: numbers and amounts of charges and refunds, and the refunds by day."""
    known = _days(activity).where(F.col("subscription_id").isNotNull())
    parts = known.groupBy(KEY, "transaction_type", F.when(is_refund(), F.col("date")).alias("day")).agg(
        F.sum("times").alias("n"), F.sum(F.col("amount") * F.col("times").cast("decimal(18,0)")).cast("decimal(18,2)").alias("amount"))
    return parts.groupBy(KEY).agg(
        sum_if(is_charge(), F.col("n")).alias("n_charges"), sum_if(is_refund(), F.col("n")).alias("n_refunds"),
        sum_if(is_charge(), F.col("amount")).cast("decimal(18,2)").alias("charged"),
        sum_if(is_refund(), F.col("amount")).cast("decimal(18,2)").alias("refunded"),
        F.collect_list(F.when(is_refund(), F.struct("day", "amount"))).alias("refund_days"))


def trial_payback(activity: DataFrame, t: Tables, p: Params, trials: DataFrame, *dims: str, legacy_repeat: bool = False) -> DataFrame:
    """Sales, charges, refunds, net and 37-day revenue in EUR and first renewals by ``cohort_date`` and ``dims``.

    ``trials`` are rows of :func:`priced_trials` with the dims. The rate depends on the day and the currency of the trial only, so amounts
    are folded over subscriptions first and meet the rates as a few rows.
    """
    cohort = trials.groupBy(KEY, F.col("date").alias("cohort_date"), *dims, "currency").agg(F.sum("times").alias("n_trials"))
    early = _first(activity).groupBy(KEY).agg(F.sum("amount").cast("decimal(18,2)").alias("early_charged"))
    zero = F.lit(0).cast("decimal(18,2)")
    in_time = F.filter("refund_days", lambda r: r["day"] <= F.date_add("cohort_date", p.payback_days))
    rows = cohort.join(totals(activity), KEY, "left").join(early, KEY, "left").withColumn("early_refunded", F.coalesce(
        F.aggregate(in_time, zero, lambda acc, r: (acc + r["amount"]).cast("decimal(18,2)")), zero))
    # A subscription with trials in two currencies on a day is one sale.
    lead = F.row_number().over(Window.partitionBy(KEY, "cohort_date", *dims).orderBy("currency")) == 1
    n = F.col("n_trials")
    times = n * (F.col("n_charges") + F.col("n_refunds")) if legacy_repeat else n
    folded = rows.withColumn("lead", lead).groupBy("cohort_date", *dims, "currency").agg(
        count_if(F.col("lead")).alias("sales"), F.sum(times * F.col("n_charges")).alias("charges"), F.sum(times * F.col("n_refunds")).alias("refunds"),
        F.sum(n * (F.col("charged") - F.col("refunded"))).alias("net"),
        F.sum(n * (F.col("early_charged") - F.col("early_refunded"))).alias("early_net"),
        count_if(F.col("lead") & (F.col("n_charges") - F.col("n_refunds") > 1)).alias("first_renewals"))
    rates = t["eur_exchange_rates"].select(F.col("date").alias("cohort_date"), F.col("code").alias("currency"), "rate")

    def in_eur(value: str) -> Column:
        return money(F.sum(safe_div(F.col(value).cast("double"), F.col("rate").cast("double"))))

    return folded.join(rates, ["cohort_date", "currency"], "left").groupBy("cohort_date", *dims).agg(
        F.sum("sales").alias("sales"), F.sum("charges").alias("charges"), F.sum("refunds").alias("refunds"),
        in_eur("net").alias("real_revenue"), in_eur("early_net").alias("real_revenue_37d"), F.sum("first_renewals").alias("first_renewals"))


def payback_by_country(activity: DataFrame, t: Tables, p: Params, *, legacy_repeat: bool = False) -> DataFrame:
    return trial_payback(activity, t, p, priced_trials(activity, p), "ip_country", legacy_repeat=legacy_repeat)


def payback_by_site(movements: DataFrame, *, legacy_repeat: bool = False) -> DataFrame:
    """As ``ledger.payback_by_site``, from stored ledger days."""
    known = _days(movements).where(F.col("subscription_id").isNotNull())
    cohort = known.where("opening").groupBy(KEY, F.col("date").alias("cohort_date"), "ip_country", "site").agg(F.sum("times").alias("n_trials"))
    sums = known.groupBy(KEY).agg(
        sum_if(ledger.is_charge(), F.col("times")).alias("n_charges"), sum_if(ledger.is_refund(), F.col("times")).alias("n_refunds"),
        F.sum("gross_amount").cast("decimal(18,2)").alias("revenue"))
    early = _first(movements).groupBy(KEY).agg(F.sum("gross_amount").cast("decimal(18,2)").alias("early_revenue"))
    return ledger.site_payback(cohort.join(sums, KEY, "left").join(early, KEY, "left"), legacy_repeat=legacy_repeat)
