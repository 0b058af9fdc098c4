"""Payback: what a cohort has returned by day 35-37, real, predicted and hybrid, in EUR.

Two families. The *price based* reports value a subscription by its plan price and its number
of net renewals, converted with constant rates. The *transaction based* reports add up charges and
refunds, converted with the rate of the cohort day.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kohorte.functions import gates
from kohorte.functions.columns import count_if, day, keyword_class, money, ratio, safe_div, static_eur, sum_if, week_start
from kohorte.operators.shared import (
    all_activity, customer_keys, first_rows, invoiced_activity, is_charge, is_refund, on_or_after, per_subscription, subscription_prices,
    trial_charges, with_repeated_ranks,
)
from kohorte.params import Params
from kohorte.sources.catalog import Tables

# ---------------------------------------------------------------- price based


def valued_subscriptions(t: Tables, p: Params, *, below, keys: Callable[[DataFrame], DataFrame] | None = None,
                         dims: tuple[str, ...] = ("ip_country",)) -> DataFrame:
    """One row per trial group: cohort date, dimensions, EUR trial and recurring price, net renewals."""
    trials = trial_charges(t, p, below=below, since=p.start)
    trials = keys(trials) if keys else trials
    trials = per_subscription(trials, F.col("date").alias("cohort_date"), *dims)
    prices = subscription_prices(t).select(
        "subscription_id",
        static_eur(F.col("price_trial"), F.col("price_currency")).alias("trial"),
        static_eur(F.col("price_amount"), F.col("price_currency")).alias("recurring"))
    activity = invoiced_activity(t, p).select("subscription_id", "net_renewals")
    return trials.join(prices, "subscription_id").join(activity, "subscription_id").withColumn(
        "renewals", F.col("n_trials") * F.col("net_renewals"))


def _real(otherwise: Column) -> Column:
    """Trial price plus at most two recurring prices; a negative number of net renewals gives ``otherwise``."""
    trial, recurring, n = F.col("trial"), F.col("recurring"), F.col("renewals")
    return (F.when(n == 0, trial).when(n == 1, trial + recurring).when(n >= 2, trial + recurring + recurring)
            .otherwise(otherwise))


def cohort_value(valued: DataFrame, *keys: str) -> DataFrame:
    """Sums per cohort date and dimensions: everything the price-based reports need."""
    zero = F.lit(0).cast("decimal(20,8)")
    return valued.groupBy("cohort_date", *keys).agg(
        F.count(F.lit(1)).alias("new_sales"),
        count_if(F.col("renewals") > 0).alias("renewed_1"),
        count_if(F.col("renewals") > 1).alias("renewed_2"),
        F.sum("trial").alias("trial_value"),
        F.sum("recurring").alias("recurring_value"),
        F.sum(_real(zero)).alias("real_value"),
        F.sum(_real(F.lit(None))).alias("known_value"))


def _mature_ratios(daily: DataFrame, p: Params) -> tuple[Column, Column, Column]:
    old = F.col("cohort_date") <= day(p.days_ago(p.ratio_min_age_days))
    return tuple(F.sum(F.when(old, F.col(c)).otherwise(0)) for c in ("new_sales", "renewed_1", "renewed_2"))


def recurrence_ratios(t: Tables, p: Params) -> DataFrame:
    """Country -> mature sample size and the shares that renewed at least once and twice (both of all sales)."""
    daily = cohort_value(valued_subscriptions(t, p, below=p.trial_below), "ip_country")
    n, once, twice = _mature_ratios(daily, p)
    return (
        daily.groupBy("ip_country").agg(n.alias("sample_size"), once.alias("once"), twice.alias("twice"))
        .where(F.col("sample_size") > p.ratio_more_than)
        .select("ip_country", "sample_size", ratio(F.col("once"), F.col("sample_size")).alias("r1"),
                ratio(F.col("twice"), F.col("sample_size")).alias("r2")))


def _with_prediction(daily: DataFrame, p: Params) -> DataFrame:
    """Adds ``predicted``: trial value plus recurring value weighted by the country's mature ratios (0 if too few).

    The ratios are window sums over the daily aggregate, where a country has one row per cohort day.
    """
    n, once, twice = (c.over(Window.partitionBy("ip_country")) for c in _mature_ratios(daily, p))
    sized = daily.withColumns({"n": n, "once": once, "twice": twice})
    share = F.when(F.col("n") > p.ratio_more_than, ratio(F.col("once") + F.col("twice"), F.col("n"))).otherwise(F.lit(0.0))
    return sized.withColumn(
        "predicted", F.col("trial_value").cast("double") + F.col("recurring_value").cast("double") * share)


def _mature(p: Params) -> Column:
    return F.datediff(day(p.as_of), F.col("cohort_date")) > p.payback_days


def payback_daily(t: Tables, p: Params) -> DataFrame:
    """(cohort day, country) -> sales and predicted, real and smart revenue by day 35.

    Smart is real for cohorts older than the payback period and predicted for the others.
    """
    daily = _with_prediction(cohort_value(valued_subscriptions(t, p, below=p.trial_below), "ip_country"), p)
    return daily.where(F.col("ip_country").isin(list(p.payback_countries))).select(
        "cohort_date", "ip_country", "new_sales",
        money(F.col("predicted")).alias("predicted_d35_revenue"),
        money(F.col("real_value")).alias("real_d35_revenue"),
        money(F.when(_mature(p), F.col("known_value").cast("double")).otherwise(F.col("predicted")))
        .alias("smart_d35_revenue"))


def payback_weekly(t: Tables, p: Params) -> DataFrame:
    """(cohort week, country, cost of that week) -> as :func:`payback_daily`; smart counts mature cohorts only."""
    daily = _with_prediction(cohort_value(valued_subscriptions(t, p, below=p.trial_below), "ip_country"), p)
    weekly = daily.where(F.col("ip_country").isin(list(p.payback_countries))).groupBy(
        week_start(F.col("cohort_date")).alias("cohort_week"), "ip_country",
    ).agg(
        F.sum("new_sales").alias("new_sales"), F.sum("predicted").alias("predicted"), F.sum("real_value").alias("real"),
        F.sum(F.when(_mature(p), F.col("known_value")).otherwise(F.lit(0))).alias("smart"))
    costs = t["marketing_spends_pdf"].groupBy(
        week_start(F.col("date")).alias("cohort_week"), F.col("geo").alias("ip_country")).agg(F.sum("costs").alias("costs"))
    return weekly.join(costs, ["cohort_week", "ip_country"], "left").select(
        "cohort_week", "ip_country", F.col("costs").cast("decimal(18,2)").alias("costs"), "new_sales",
        money(F.col("predicted")).alias("predicted_d35_revenue"),
        money(F.col("real")).alias("real_d35_revenue"), money(F.col("smart")).alias("smart_d35_revenue"))


def _agents(t: Tables) -> DataFrame:
    return t["http_user_agents"].select(
        F.col("id").alias("user_agent_id"), "device", F.col("ip_country_iso_code").alias("agent_country"))


def _terms(t: Tables, *, ignore_case: bool = True) -> DataFrame:
    return t["utms"].select(
        F.col("id").alias("utms_id"), keyword_class(F.col("utm_term"), ignore_case=ignore_case).alias("keyword"))


def payback_by_device(t: Tables, p: Params) -> DataFrame:
    """(cohort day, device, country of the user agent) -> sales and real revenue by day 35."""
    def keys(trials: DataFrame) -> DataFrame:
        return trials.drop("ip_country").join(_agents(t), "user_agent_id", "left").withColumns({
            "device": F.coalesce("device", F.lit(p.default_device)), "ip_country": F.col("agent_country")})

    valued = valued_subscriptions(t, p, below=p.wide_trial_below, keys=keys, dims=("device", "ip_country"))
    return cohort_value(valued, "device", "ip_country").select(
        "cohort_date", "device", "ip_country", "new_sales", money(F.col("real_value")).alias("real_d35_revenue"))


def payback_by_keyword(t: Tables, p: Params) -> DataFrame:
    """(cohort day, keyword class) -> sales and real revenue by day 35."""
    def keys(trials: DataFrame) -> DataFrame:
        return trials.join(_terms(t), "utms_id", "left").withColumn("keyword", F.coalesce("keyword", F.lit("other")))

    valued = valued_subscriptions(t, p, below=p.wide_trial_below, keys=keys, dims=("keyword",))
    return cohort_value(valued, "keyword").select(
        "cohort_date", "keyword", "new_sales", money(F.col("real_value")).alias("real_d35_revenue"))


# ---------------------------------------------------------- transaction based


def priced_trials(t: Tables, p: Params) -> DataFrame:
    """Successful charges that equal the trial price of their plan, with customer country and the day's EUR rate.

    Only amounts that occur as a trial price can match, so the charges are cut down by that short
    list before they are shuffled.
    """
    charges = on_or_after(gates.successful_charges(t["transactions"]), "created_at", p.start)
    trial_amounts = t["prices"].select(F.col("amount_trial").alias("amount")).distinct()
    charges = charges.join(trial_amounts, "amount", "left_semi")
    charges = gates.invoiced(charges, t["invoices_sii"], numbered=False)
    plan = subscription_prices(t).select("subscription_id", F.col("price_trial").alias("amount"))
    rates = t["eur_exchange_rates"].select("date", F.col("code").alias("currency"), "rate")
    return (
        charges.withColumn("date", F.col("created_at").cast("date"))
        .join(plan, ["subscription_id", "amount"]).join(customer_keys(t, p), "customer_id")
        .join(rates, ["date", "currency"], "left").join(_agents(t), "user_agent_id", "left")
        .withColumn("ip_country", F.coalesce("ip_country", "agent_country")))


def cohort_revenue_eur(t: Tables, p: Params) -> DataFrame:
    """(cohort day, country) -> all amounts and net revenue in EUR at the rate of the cohort day.

    Amounts are summed per rate first, so one division serves all subscriptions of a day and currency.
    """
    cohort = per_subscription(priced_trials(t, p), F.col("date").alias("cohort_date"), "ip_country", "rate")
    rows = cohort.join(all_activity(t), "subscription_id", "left")
    per_rate = rows.groupBy("cohort_date", "ip_country", "rate").agg(
        F.sum(F.col("n_trials") * F.col("charged")).alias("charged"),
        F.sum(F.col("n_trials") * F.col("refunded")).alias("refunded"))
    def in_eur(value: Column) -> Column:
        return safe_div(value.cast("double"), F.col("rate").cast("double"))
    return per_rate.groupBy("cohort_date", "ip_country").agg(
        money(F.sum(in_eur(F.col("charged") + F.col("refunded")))).alias("total_amount"),
        money(F.sum(in_eur(F.col("charged") - F.col("refunded")))).alias("real_revenue"))


def daily_activity(txn: DataFrame) -> DataFrame:
    """Per subscription: charge and refund counts and amounts, and its refunds as a list of (day, amount).

    The first aggregation leaves one charge row and one refund row per day, so the list is never longer than
    the calendar.
    """
    parts = txn.groupBy(
        "subscription_id", "transaction_type", F.when(is_refund(), F.col("created_at").cast("date")).alias("day"),
    ).agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast("decimal(18,2)").alias("amount"))
    return parts.groupBy("subscription_id").agg(
        sum_if(is_charge(), F.col("n")).alias("n_charges"), sum_if(is_refund(), F.col("n")).alias("n_refunds"),
        sum_if(is_charge(), F.col("amount")).cast("decimal(18,2)").alias("charged"),
        sum_if(is_refund(), F.col("amount")).cast("decimal(18,2)").alias("refunded"),
        F.collect_list(F.when(is_refund(), F.struct("day", "amount"))).alias("refund_days"))


def trial_payback(t: Tables, p: Params, cohort: DataFrame, *dims: str, legacy_repeat: bool = False, legacy_rank: bool = False) -> DataFrame:
    """Sales, charges, refunds, net and 37-day revenue and first renewals by ``cohort_date`` and ``dims``.

    ``cohort`` has one row per subscription, cohort date, dims and rate. The 37-day revenue is the first
    charges of a subscription less its refunds up to 37 days after the cohort date. Charges and refunds count
    each transaction once; ``legacy_repeat=True`` counts a subscription's totals once per transaction row
    instead, for comparison with reports built that way. So does ``legacy_rank=True`` with ranks: a subscription's first charges are the first rows after
    each charge is repeated for each of its trials, and its net charges are counted as often (``cohort`` has ``n_own`` and ``n_early``,
    see ``shared.with_repeated_ranks``).

    All four inputs have one row per subscription (the cohort: per trial), so the joins share one partitioning.
    """
    txn = gates.successful(t["transactions"]).where(F.col("subscription_id").isNotNull())
    charges = txn.where(F.col("transaction_type") == gates.CHARGE)
    early = first_rows(charges.select("subscription_id", "created_at", "id", "amount"),
                       ["subscription_id"], ["created_at", "id"], p.payback_charges)
    early = early.groupBy("subscription_id").agg(
        F.sum("amount").cast("decimal(18,2)").alias("early_charged"), F.collect_list(F.struct("rank", "amount")).alias("early_rows"))
    activity = daily_activity(txn)
    zero = F.lit(0).cast("decimal(18,2)")
    in_time = F.filter("refund_days", lambda r: r["day"] <= F.date_add("cohort_date", p.payback_days))
    early_refunded = F.coalesce(
        F.aggregate(in_time, zero, lambda acc, r: (acc + r["amount"]).cast("decimal(18,2)")), zero)
    rows = (
        cohort.join(activity, "subscription_id", "left").join(early, "subscription_id", "left")
        .withColumn("early_refunded", early_refunded))
    net = F.col("n_charges") - F.col("n_refunds")
    if legacy_rank:
        net = F.col("n_own") * net
        rows = rows.withColumn("early_charged", F.when(F.col("early_charged").isNotNull(), F.aggregate(
            F.filter("early_rows", lambda r: r["rank"] <= F.col("n_early")), zero, lambda acc, r: (acc + r["amount"]).cast("decimal(18,2)"))))
    n = F.col("n_trials")
    times = n * (F.col("n_charges") + F.col("n_refunds")) if legacy_repeat else n

    def in_eur(gain: str, loss: str) -> Column:
        return F.sum(safe_div((n * (F.col(gain) - F.col(loss))).cast("double"), F.col("rate").cast("double")))

    per_sub = rows.groupBy("subscription_id", "cohort_date", *dims).agg(
        F.sum(times * F.col("n_charges")).alias("charges"), F.sum(times * F.col("n_refunds")).alias("refunds"),
        in_eur("charged", "refunded").alias("revenue"), in_eur("early_charged", "early_refunded").alias("early_revenue"),
        F.max(net).alias("net"))
    return per_sub.groupBy("cohort_date", *dims).agg(
        F.count(F.lit(1)).alias("sales"), F.sum("charges").alias("charges"), F.sum("refunds").alias("refunds"),
        money(F.sum("revenue")).alias("real_revenue"), money(F.sum("early_revenue")).alias("real_revenue_37d"),
        count_if(F.col("net") > 1).alias("first_renewals"))


def payback_by_method(t: Tables, p: Params, *, legacy_repeat: bool = False, legacy_rank: bool = False) -> DataFrame:
    """(day, country, merchant account, payment method, device, keyword) -> sales, charges, refunds, revenue in EUR."""
    dims = ("ip_country", "internal_mid_name", "apm_type", "device", "keyword")
    accounts = t["mids"].select(F.col("id").alias("mid_id"), "internal_mid_name")
    trials = (
        priced_trials(t, p).join(_terms(t), "utms_id", "left").join(accounts, "mid_id", "left")
        .withColumns({"keyword": F.coalesce("keyword", F.lit("other")), "apm_type": F.coalesce("apm_type", F.lit("Null"))}))
    if legacy_rank:
        trials = with_repeated_ranks(trials, "id", p.payback_charges)
    cohort = per_subscription(trials, F.col("date").alias("cohort_date"), *dims, "rate", *(["n_own", "n_early"] if legacy_rank else []))
    return trial_payback(t, p, cohort, *dims, legacy_repeat=legacy_repeat, legacy_rank=legacy_rank).withColumnRenamed("cohort_date", "date")


def payback_by_country(t: Tables, p: Params, *, legacy_repeat: bool = False) -> DataFrame:
    """(cohort day, country) -> the measures of :func:`payback_by_method`, as the daily dashboard shows them."""
    cohort = per_subscription(priced_trials(t, p), F.col("date").alias("cohort_date"), "ip_country", "rate")
    return trial_payback(t, p, cohort, "ip_country", legacy_repeat=legacy_repeat)
