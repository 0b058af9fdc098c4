"""Dashboards: several metric sets on one spine of keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kohorte.functions import constants as k
from kohorte.functions.columns import day
from kohorte.operators import activity as stored
from kohorte.operators import counters, funnel, ledger, payback
from kohorte.params import Params
from kohorte.sources.catalog import Tables


def on_spine(parts: Sequence[tuple[DataFrame, Sequence[str], bool]], keys: Sequence[str]) -> DataFrame:
    """Metric sets side by side on the union of their keys.

    ``parts`` holds (frame, its measures, whether its keys belong to the spine). Each frame has at most one
    row per key, so stacking them and folding by key gives the spine with every set left-joined to it, in one
    shuffle instead of a distinct and a join per set. As in a join, a NULL key keeps its spine row but no measures.
    """
    types = {m: f.schema[m].dataType for f, measures, _ in parts for m in measures}
    whole = ~F.exists(F.array(*[F.col(c).isNull() for c in keys]), lambda missing: missing)
    stacked = None
    for frame, measures, spine in parts:
        part = frame.select(
            *keys, F.lit(spine).alias("spine"),
            *[(F.when(whole, F.col(m)) if m in measures else F.lit(None)).cast(types[m]).alias(m) for m in types])
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked.groupBy(*keys).agg(F.max("spine").alias("spine"), *[F.max(m).alias(m) for m in types]).where(
        "spine").drop("spine")


def zero_filled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType)) for c in columns})


PAYBACK = ["real_revenue", "real_revenue_37d", "charges", "refunds", "first_renewals"]


def dashboard_daily(t: Tables, p: Params, *, legacy_repeat: bool = False, activity: DataFrame | None = None) -> DataFrame:
    """(day, country) -> spend, sales, funnel and payback, zero where absent, and totals per day.

    With ``activity`` (``activity.store_transactions``) sales and payback read the stored days, not the transactions.
    """
    sales = ["sales", "ltv", "user_revenue", "amount_refunds"]
    steps = list(funnel.STEPS)
    if activity is None:
        paid = payback.payback_by_country(t, p, legacy_repeat=legacy_repeat)
    else:
        paid = stored.payback_by_country(activity, t, p, legacy_repeat=legacy_repeat)
    paid = paid.withColumnRenamed("cohort_date", "date")
    rows = on_spine([
        (funnel.spend_daily(t, p), ["spend"], True),
        (counters.sales_revenue_daily(t, p, activity=activity).drop("refunds", "week"), sales, True),
        (funnel.funnel_daily(t, p), steps, True),
        (paid.select("date", "ip_country", *PAYBACK), PAYBACK, False),
    ], ["date", "ip_country"])
    per_day = Window.partitionBy("date")
    rows = rows.withColumns({
        "grand_total_sales": F.sum("sales").over(per_day),
        "grand_total_spend": F.sum("spend").over(per_day).cast("decimal(18,2)")})
    return zero_filled(rows, ["spend", *sales, *steps, *PAYBACK])


def dashboard_multisite(t: Tables, p: Params, *, spend: DataFrame, viewers: DataFrame, ltv_windows: Sequence[tuple],
                        legacy_repeat: bool = False, activity: DataFrame | None = None) -> DataFrame:
    """(day, country, site) up to yesterday, reported sites only -> spend, sales, dated LTV, viewers, payback.

    With ``activity`` (``activity.store_ledger``) sales and payback read the stored days, not the movements.
    """
    sold = ledger.with_dated_ltv(ledger.sales_by_site(t, p, activity=activity), ltv_windows, k.DATED_LTV_DEFAULT)
    if activity is None:
        paid = ledger.payback_by_site(t, p, legacy_repeat=legacy_repeat)
    else:
        paid = stored.payback_by_site(activity, legacy_repeat=legacy_repeat)
    paid = paid.withColumnRenamed("cohort_date", "date")
    sales = ["sales", "ltv", "user_revenue", "amount_refunds"]
    measures = ["spend", *sales, "landing_page_viewers", *PAYBACK]
    wanted = F.col("site").isin(list(p.report_sites)) & (F.col("date") <= day(p.yesterday))
    rows = on_spine([
        (spend.where(wanted), ["spend"], True),
        (sold.drop("refunds").where(wanted), sales, True),
        (viewers.where(wanted), ["landing_page_viewers"], True),
        (paid.select("date", "ip_country", "site", *PAYBACK).where(wanted), PAYBACK, False),
    ], ["date", "ip_country", "site"])
    return zero_filled(rows, measures)
