"""Plain counters and exports: sales, registrations, statuses, file sizes, reviews, deduplication."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohorte.functions import constants as k
from kohorte.functions import gates
from kohorte.functions.columns import (
    calendar_week_label, count_if, day, file_group, iso_week_label, lookup, money, one_line, size_in_mb, sum_if,
    whole_units,
)
from kohorte.operators.accounting import PLAIN, Plain
from kohorte.operators.activity import paid_sales
from kohorte.operators.shared import (
    is_charge, is_refund, customer_keys, first_rows, invoiced_activity, on_or_after, per_subscription,
    subscription_prices, trial_charges,
)
from kohorte.params import Params
from kohorte.sources.catalog import Tables


def sales_daily(t: Tables, p: Params, *, before: date | None = None) -> DataFrame:
    """(date, country) -> successful invoiced trial charges, up to the day before ``before``."""
    trials = trial_charges(t, p, below=p.wide_trial_below)
    if before is not None:
        trials = trials.where(F.col("created_at").cast("date") < day(before))
    return trials.groupBy("date", "ip_country").agg(F.count(F.lit(1)).alias("n_sales"))


def registers_daily(t: Tables, p: Params, *, first: date, last: date) -> DataFrame:
    """(date, country) -> new external customers between two days, both included."""
    day_of = F.col("created_at").cast("date")
    return (
        gates.external_customers(t["customers"], p.internal_mail).where(day_of.between(day(first), day(last)))
        .groupBy(day_of.alias("created_at_register"), "ip_country").agg(F.count(F.lit(1)).alias("n_registers")))


def _subscription_owner(t: Tables, p: Params) -> DataFrame:
    """Subscriptions of external customers with their status."""
    owners = customer_keys(t, p).select(F.col("customer_id").alias("customer_id_np"))
    return t["subscriptions"].select(
        F.col("id").alias("subscription_id"), "customer_id_np", "subscription_status").join(owners, "customer_id_np")


def status_counts(t: Tables, p: Params) -> DataFrame:
    """Subscription status -> trial charges of its subscriptions (invoiced or not)."""
    per_sub = (
        gates.successful_charges(t["transactions"]).where(F.col("amount") < F.lit(p.trial_below))
        .groupBy("subscription_id").agg(F.count(F.lit(1)).alias("n")))
    return per_sub.join(_subscription_owner(t, p), "subscription_id").groupBy("subscription_status").agg(
        F.sum("n").alias("total"))


def active_subs_no_refund(t: Tables, p: Params) -> DataFrame:
    """Status -> invoiced trial charges, without subscriptions that ever had an invoiced refund.

    "Never refunded" is a conditional count in the same pass over the fact instead of an anti join.
    """
    rows = gates.invoiced(gates.successful(t["transactions"]), t["invoices_sii"])
    small = is_charge() & (F.col("amount") < F.lit(p.wide_trial_below))
    per_sub = (
        rows.where(small | is_refund()).groupBy("subscription_id")
        .agg(count_if(small).alias("n"), count_if(is_refund()).alias("refunds"))
        .where((F.col("refunds") == 0) & (F.col("n") > 0)))
    return per_sub.join(_subscription_owner(t, p), "subscription_id").groupBy("subscription_status").agg(
        F.sum("n").alias("total"))


def sales_revenue_daily(t: Tables, p: Params, *, iso_year: bool = False, activity: DataFrame | None = None) -> DataFrame:
    """(date, country) -> sales, whole net revenue and refunds, with week label and the country's lifetime value.

    ``activity``: stored subscription days (``activity.store_transactions``) in place of the transactions.
    """
    if activity is not None:
        return _priced_sales(paid_sales(activity, p), iso_year=iso_year)
    rows = on_or_after(gates.successful(t["transactions"]), "created_at", p.start)
    # Folded before it meets prices and customers: equal charges of a subscription and day are one row.
    rows = gates.invoiced(rows, t["invoices_sii"]).groupBy(
        "customer_id", "subscription_id", "transaction_type", "amount", F.col("created_at").cast("date").alias("date")).agg(
        F.count(F.lit(1)).alias("times"))
    rows = rows.join(subscription_prices(t).select("subscription_id", "price_trial"), "subscription_id", "left")
    return _priced_sales(rows.join(customer_keys(t, p), "customer_id"), iso_year=iso_year)


def _priced_sales(rows: DataFrame, *, iso_year: bool) -> DataFrame:
    times, amount = F.col("times"), F.col("amount") * F.col("times").cast("decimal(18,0)")
    label = iso_week_label if iso_year else calendar_week_label
    return rows.groupBy("date", "ip_country").agg(
        sum_if(is_charge() & (F.col("price_trial") == F.col("amount")), times).alias("sales"),
        whole_units(sum_if(is_charge(), amount) - sum_if(is_refund(), amount)).alias("user_revenue"),
        sum_if(is_refund(), times).alias("refunds"),
        whole_units(sum_if(is_refund(), amount)).alias("amount_refunds"),
    ).select(
        "date", "ip_country", label(F.col("date")).alias("week"),
        lookup(F.col("ip_country"), k.COUNTRY_LTV, k.COUNTRY_LTV_DEFAULT).cast("decimal(18,2)").alias("ltv"),
        "sales", "user_revenue", "refunds", "amount_refunds")


def file_size_mix(t: Tables, p: Params, *, first: date, last: date) -> DataFrame:
    """File group -> files and mean size in MB, created between two midnights (both included)."""
    stamp = F.col("created_at").cast("timestamp")
    within = stamp.between(day(first).cast("timestamp"), day(last).cast("timestamp"))
    return t["files"].where(within).groupBy(file_group(F.col("file_format")).alias("file_format")).agg(
        F.count("id").alias("n_files"), money(F.avg(size_in_mb(F.col("file_size")))).alias("avg_size_mb"))


def latest_subscription(t: Tables) -> DataFrame:
    """The newest subscription of every customer (ties: highest id)."""
    newest = first_rows(
        t["subscriptions"].select("id", "customer_id_np", "subscription_type_id", "subscription_status", "created_at"),
        ["customer_id_np"], [F.desc("created_at"), F.desc("id")], 1)
    return newest.drop("rank", "created_at")


def reviews_export(t: Tables, p: Params, *, after: date, account: Plain = PLAIN) -> DataFrame:
    """Review rows on one line each, with the status and plan of the author's latest subscription.

    Left joins by e-mail address: a review whose address belongs to several customers repeats. An ``accounting.Account`` tells how often.
    """
    reviews = account.gate(t["reviews"], F.col("created_at") > day(after).cast("timestamp"), "after the day")
    reviews = account.gate(reviews, gates.outside_all("email", [p.internal_mail, p.second_mail_pattern]), "mail patterns")
    authors = t["customers"].where(F.col("email").isNotNull()).select("email", F.col("id").alias("customer_id_np"))
    plans = t["subscription_types"].select(F.col("id").alias("subscription_type_id"), "name")
    nothing = F.lit(None).cast("string")
    rows = account.join(reviews, authors, "email", "authors")
    rows = account.join(rows, latest_subscription(t).drop("id"), "customer_id_np", "latest subscription")
    return (
        account.join(rows, plans, "subscription_type_id", "plan")
        .select(F.col("created_at").cast("date").alias("created_at"), nothing.alias("a"), nothing.alias("a2"), "email",
                F.col("rating").cast("bigint").alias("rating"), one_line(F.col("comment")).alias("comment"),
                "subscription_status", "name"))


def recurrence_per_sub(t: Tables, p: Params, *, min_age_days: int = 8) -> DataFrame:
    """(subscription, country, first day, price) -> successful invoiced charges after the first one,
    for trials strictly after the start day and at least ``min_age_days`` old."""
    trials = trial_charges(t, p, below=p.trial_below, after=p.start).where(
        F.col("created_at").cast("timestamp") < day(p.days_ago(min_age_days)).cast("timestamp"))
    trials = per_subscription(trials, "ip_country", F.col("date").alias("initial_purchase_date"))
    charges = invoiced_activity(t, p).where(F.col("n_charges") > 0).select("subscription_id", "n_charges")
    prices = subscription_prices(t).select("subscription_id", F.col("price_amount").alias("amount"))
    return trials.join(charges, "subscription_id").join(prices, "subscription_id").select(
        F.col("subscription_id").alias("id"), "ip_country", "initial_purchase_date", "amount",
        (F.col("n_trials") * F.col("n_charges") - 1).alias("n_recurrences"))


def dedup_latest_txn(transactions: DataFrame) -> DataFrame:
    """One row per transaction id: the latest payment date. The other columns break ties, so that the kept
    row does not depend on the order of the files."""
    rest = [c for c in transactions.columns if c not in ("id", "payment_date")]
    order = [F.desc("payment_date"), *[F.desc(c) for c in rest]]
    return first_rows(transactions, ["id"], order, 1).drop("rank")
