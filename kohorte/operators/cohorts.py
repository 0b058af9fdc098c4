"""Cohort renewals and the windows in which customers leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kohorte.functions import gates
from kohorte.functions.columns import count_if, week_span_label, whole_units
from kohorte.operators.shared import first_rows, invoiced_activity, per_subscription, trial_charges
from kohorte.params import Params
from kohorte.sources.catalog import Tables


def cohort_renewals(t: Tables, p: Params, *, legacy: bool = False) -> DataFrame:
    """(trial day, country) -> sales, whole net revenue, subscriptions with net renewals >= 1 and >= 2, refunds.

    A subscription with several trials on one day counts its transactions once per trial.
    """
    trials = per_subscription(trial_charges(t, p, below=p.trial_below, after=p.start, legacy=legacy), "date", "ip_country")
    rows = trials.join(invoiced_activity(t, p, legacy=legacy), "subscription_id")
    n = F.col("n_trials")
    return rows.groupBy("date", "ip_country").agg(
        F.count(F.lit(1)).alias("sales"),
        F.sum(whole_units(n * F.col("net_revenue"))).alias("revenue"),
        count_if(n * F.col("net_renewals") > 0).alias("renewal"),
        count_if(n * F.col("net_renewals") > 1).alias("renewal_2"),
        F.sum(n * F.col("n_refunds")).alias("refunds"),
    ).withColumn("week", week_span_label(F.col("date")))


def renewal_milestones(t: Tables, p: Params, n: int = 3) -> DataFrame:
    """Subscription -> time of its first ``n`` renewals (successful charges above the threshold)."""
    renewals = gates.successful_charges(t["transactions"]).where(
        F.col("subscription_id").isNotNull() & (F.col("amount") > F.lit(p.renewal_above))
    ).select("subscription_id", "created_at", "id")
    ranked = first_rows(renewals, ["subscription_id"], ["created_at", "id"], n, "seq")
    return ranked.groupBy("subscription_id").agg(
        *[F.max(F.when(F.col("seq") == k, F.col("created_at"))).alias(f"r{k}") for k in range(1, n + 1)])


def _in_window(at: Column, k: int) -> Column:
    """Half-open window before renewal ``k``: [r(k-1), rk), open to the right when rk never came."""
    before = F.col(f"r{k}").isNull() | (at < F.col(f"r{k}"))
    return before if k == 1 else F.coalesce(at >= F.col(f"r{k - 1}"), F.lit(False)) & before


def renewal_windows(t: Tables, p: Params) -> DataFrame:
    """(trial day, country) -> sales, net renewals 1-3, and the unsubscribe requests and refunds that fall
    before the first, between first and second, and between second and third renewal."""
    steps = (1, 2, 3)
    trials = per_subscription(trial_charges(t, p, below=p.trial_below, after=p.start), "date", "ip_country")
    marks = renewal_milestones(t, p)
    refunds = gates.invoiced(gates.successful_refunds(t["transactions"]), t["invoices_sii"])
    # Only whether a refund exists in a window matters, so equal moments fold before the join.
    refunds = refunds.select("subscription_id", F.col("created_at").alias("refunded_at")).distinct()
    refund_flags = refunds.join(marks, "subscription_id", "left").groupBy("subscription_id").agg(
        *[F.max(F.when(_in_window(F.col("refunded_at"), k), 1).otherwise(0)).alias(f"ref{k}") for k in steps])
    requests = t["subscriptions"].select(
        F.col("id").alias("subscription_id"), F.col("requested_unsubscribed_date").alias("requested"))
    rows = (
        trials.join(invoiced_activity(t, p).select("subscription_id", "net_renewals"), "subscription_id")
        .join(requests, "subscription_id").join(marks, "subscription_id", "left")
        .join(refund_flags, "subscription_id", "left"))
    net = F.col("n_trials") * F.col("net_renewals")
    asked = F.col("requested").isNotNull()
    return rows.groupBy("date", "ip_country").agg(
        F.count(F.lit(1)).alias("sales"),
        *[count_if(net >= k).alias(f"renewal_{k}") for k in steps],
        *[count_if(asked & _in_window(F.col("requested"), k)).alias(f"req_before_r{k}") for k in steps],
        *[count_if(F.col(f"ref{k}") == 1).alias(f"ref_before_r{k}") for k in steps],
    ).withColumn("week", week_span_label(F.col("date")))
