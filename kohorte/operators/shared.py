"""Building blocks used by several reports.

Layout rule for the transaction fact: reduce it to one row per subscription (or per
subscription and day) with map-side aggregation *before* anything is joined on
``subscription_id``. A subscription that owns a large share of the rows then arrives at its
join as one row per map task, and the subscription-keyed joins share one partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kohorte.functions import gates
from kohorte.functions.columns import count_if, day, sum_if
from kohorte.params import Params
from kohorte.sources.catalog import Tables

def is_charge() -> Column:
    return F.col("transaction_type") == gates.CHARGE


def is_refund() -> Column:
    return F.col("transaction_type") == gates.REFUND


def on_or_after(df: DataFrame, column: str, since: date | None, after: date | None = None) -> DataFrame:
    """Bounds on the day of a timestamp; Catalyst rewrites them to a pushed timestamp range."""
    if since is not None:
        df = df.where(F.col(column).cast("date") >= day(since))
    if after is not None:
        df = df.where(F.col(column).cast("date") > day(after))
    return df


def customer_keys(t: Tables, p: Params, **gate) -> DataFrame:
    return gates.external_customers(t["customers"], p.internal_mail, **gate).select(
        F.col("id").alias("customer_id"), "ip_country")


def trial_charges(t: Tables, p: Params, *, below, since: date | None = None, after: date | None = None,
                  legacy: bool = False) -> DataFrame:
    """Successful, invoiced, small first charges of external customers: one row per charge."""
    small = gates.successful_charges(t["transactions"]).where(F.col("amount") < F.lit(below))
    small = on_or_after(small, "created_at", since, after)
    small = gates.invoiced(small, t["invoices_sii"], legacy=legacy).select(
        "subscription_id", "customer_id", "user_agent_id", "utms_id", "created_at",
        F.col("created_at").cast("date").alias("date"))
    return small.join(customer_keys(t, p), "customer_id")


def per_subscription(trials: DataFrame, *keys: str | Column) -> DataFrame:
    """Trial rows folded to one row per subscription and reporting key, with their number ``n_trials``."""
    return trials.where(F.col("subscription_id").isNotNull()).groupBy("subscription_id", *keys).agg(
        F.count(F.lit(1)).alias("n_trials"))


def invoiced_activity(t: Tables, p: Params, *, legacy: bool = False) -> DataFrame:
    """Per subscription: net revenue, net renewals and refunds over successful invoiced transactions."""
    rows = gates.invoiced(gates.successful(t["transactions"]), t["invoices_sii"], legacy=legacy)
    amount, renewal = F.col("amount"), F.col("amount") > F.lit(p.renewal_above)
    return rows.groupBy("subscription_id").agg(
        (sum_if(is_charge(), amount) - sum_if(is_refund(), amount)).cast("decimal(18,2)").alias("net_revenue"),
        (count_if(is_charge() & renewal) - count_if(is_refund() & renewal)).alias("net_renewals"),
        count_if(is_charge()).alias("n_charges"),
        count_if(is_refund()).alias("n_refunds"),
    ).where(F.col("subscription_id").isNotNull())


def all_activity(t: Tables) -> DataFrame:
    """Per subscription: charge and refund counts and amounts over successful transactions, invoiced or not."""
    amount = F.col("amount")
    return gates.successful(t["transactions"]).groupBy("subscription_id").agg(
        count_if(is_charge()).alias("n_charges"),
        count_if(is_refund()).alias("n_refunds"),
        sum_if(is_charge(), amount).cast("decimal(18,2)").alias("charged"),
        sum_if(is_refund(), amount).cast("decimal(18,2)").alias("refunded"),
    ).where(F.col("subscription_id").isNotNull())


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows per key. The rank filter is also applied before the shuffle, so a hot key sends
    at most ``n`` rows per map task."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def with_repeated_ranks(trials: DataFrame, trial_id: str, most: int) -> DataFrame:
    """Adds to trials what ranks over repeated rows come to: ``n_own``, the trials of the subscription, and ``n_early``, how many of its first
    payments of a type a trial has among the first ``most`` rows.

    Where each payment is repeated for each of m trials and the rows are ranked by time (ties: by trial), the i-th payment of the j-th trial
    has the rank (i - 1) m + j. So the repeated rows need not be made. Only the first ``most`` trials can have any.
    """
    known = trials.where(F.col("subscription_id").isNotNull())
    ranked = first_rows(known.select("subscription_id", F.col(trial_id).alias("of_trial")), ["subscription_id"], ["of_trial"], most, "nth_trial")
    own = known.groupBy("subscription_id").agg(F.count(F.lit(1)).alias("n_own"))
    placed = ranked.join(own, "subscription_id").select(
        "of_trial", (F.floor((F.lit(most) - F.col("nth_trial")) / F.col("n_own")) + 1).cast("int").alias("n_early"))
    return known.join(own, "subscription_id").join(placed, F.col(trial_id) == F.col("of_trial"), "left").withColumn(
        "n_early", F.coalesce("n_early", F.lit(0))).drop("of_trial")


def with_plan_price(subs: DataFrame, t: Tables, *, required: bool = False) -> DataFrame:
    """Adds the prices of the plan to rows with a ``subscription_type_id``; where there is no plan, NULL or, if one is
    ``required``, no row."""
    how = "inner" if required else "left"
    plans = t["subscription_types"].select(F.col("id").alias("subscription_type_id"), F.col("price_id"))
    prices = t["prices"].select(F.col("id").alias("price_id"), F.col("amount").alias("price_amount"),
                                F.col("amount_trial").alias("price_trial"), F.col("currency").alias("price_currency"))
    return subs.join(plans, "subscription_type_id", how).join(prices, "price_id", how).drop(
        "price_id", "subscription_type_id")


def subscription_prices(t: Tables) -> DataFrame:
    """Subscription -> price of its plan."""
    return with_plan_price(t["subscriptions"].select(F.col("id").alias("subscription_id"), "subscription_type_id"), t)
