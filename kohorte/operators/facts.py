"""One row per subscription: the input of the retention and lifetime models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kohorte.functions import constants as k
from kohorte.functions import gates
from kohorte.functions.columns import count_if, customer_segment, day, email_domain, keyword_class, month_start, sum_if
from kohorte.operators.counters import dedup_latest_txn
from kohorte.operators.shared import is_charge, is_refund, with_plan_price
from kohorte.params import Params
from kohorte.sources.catalog import Tables

PARTIAL = ["charges", "refunds", "charged", "refunded"]


def _totals(*keys: str, rows: DataFrame) -> DataFrame:
    """Counts, amounts and payment dates per key; a hot subscription is one row per map task."""
    amount = F.col("amount")
    return rows.where(F.col("subscription_id").isNotNull()).groupBy(*keys).agg(
        count_if(is_charge()).alias("charges"), count_if(is_refund()).alias("refunds"),
        sum_if(is_charge(), amount).alias("charged"), sum_if(is_refund(), amount).alias("refunded"),
        F.min("payment_date").alias("first_payment"), F.max("payment_date").alias("last_payment"))


def _merge() -> list[Column]:
    return [*[F.sum(c).alias(c) for c in PARTIAL], F.min("first_payment").alias("first_payment"),
            F.max("last_payment").alias("last_payment")]


def _subscribers(t: Tables, p: Params, after, *, plan_required: bool = False) -> DataFrame:
    """Real subscriptions of external customers, created after a day, with status, price and customer fields."""
    subs = t["subscriptions"].where(
        (F.col("subscription_status") != k.REGISTERED) & (F.col("created_at").cast("date") > day(after)))
    if p.test_subscriptions:
        subs = subs.where(~F.col("id").isin([int(i) for i in p.test_subscriptions]))
    left = F.col("unsubscribed_date").isNotNull() | (F.col("subscription_status") == k.UNSUBSCRIBED)
    owners = gates.external_customers(t["customers"], p.internal_mail).select(
        F.col("id").alias("customer_id_np"), "email", F.col("ip_country").alias("customer_country"))
    subs = subs.select(F.col("id").alias("subscription_id"), "customer_id_np", "product_id", "subscription_type_id",
                       F.when(left, "churned").otherwise("active").alias("status"))
    return with_plan_price(subs, t, required=plan_required).join(owners, "customer_id_np")


def _measures() -> list[Column]:
    return [
        F.col("subscription_id"), (F.col("charges") - F.col("refunds")).alias("tenure"),
        (F.col("charged") - F.col("refunded")).cast("decimal(18,2)").alias("user_revenue"),
        F.col("first_payment").alias("initial_payment_date"), F.col("last_payment").alias("latest_payment_date"),
        F.col("status"), F.col("price_amount").alias("amount"), F.col("price_trial").alias("amount_trial"),
        F.col("ip_country")]


def subscription_fact(t: Tables, p: Params, *, after=None, feed: str = "transactions", plan_required: bool = True) -> DataFrame:
    """Invoiced form: latest copy of every transaction, one row per subscription, highest country code.

    Subscriptions without a plan are left out; with ``plan_required=False`` they stay, without prices.

    A transaction without an agent country takes the customer's, so the highest code is the
    greater of the agents' highest and, if any agent country is missing, the customer's.
    """
    # Only the columns read below: the deduplication sorts by all it is given.
    raw = t[feed].select("id", "subscription_id", "user_agent_id", "transaction_type", "transaction_status", "amount",
                         "payment_date")
    txn = gates.invoiced(gates.successful(dedup_latest_txn(raw)), t["invoices_sii"], numbered=False)
    agents = t["http_user_agents"].select(F.col("id").alias("user_agent_id"), "ip_country_iso_code")
    per_agent = _totals("subscription_id", "user_agent_id", rows=txn).join(agents, "user_agent_id", "left")
    per_sub = per_agent.groupBy("subscription_id").agg(
        *_merge(), F.max("ip_country_iso_code").alias("agent_country"),
        F.max(F.col("ip_country_iso_code").isNull()).alias("agent_missing"))
    rows = per_sub.where(F.col("charges") > F.col("refunds")).join(
        _subscribers(t, p, after or p.start, plan_required=plan_required), "subscription_id")
    rows = rows.withColumn(
        "ip_country", F.greatest("agent_country", F.when(F.col("agent_missing"), F.col("customer_country"))))
    return rows.select(*_measures(), month_start(F.col("first_payment")).alias("cohort"))


VISIT = ["subscription_id", "user_agent_id", "utms_id"]


def visit_totals(txn: DataFrame) -> DataFrame:
    """Totals per subscription, user agent and campaign: what :func:`merged_visits` adds up and :func:`segments_of` reads."""
    return _totals(*VISIT, rows=txn)


def merged_visits(totals: DataFrame) -> DataFrame:
    return totals.groupBy(*VISIT).agg(*_merge())


def subscription_segments(t: Tables, p: Params, *, after=None) -> DataFrame:
    """Segment form: all successful transactions, one row per subscription, country, device and keyword,
    with product, mail domain and B2C/B2B segment. ``cohort`` is a ``yyyy-MM`` label."""
    return segments_of(visit_totals(gates.successful(t["transactions"])), t, p, after=after)


def segments_of(totals: DataFrame, t: Tables, p: Params, *, after=None) -> DataFrame:
    """:func:`subscription_segments` from totals of visits."""
    agents = t["http_user_agents"].select(F.col("id").alias("user_agent_id"), "device", "ip_country_iso_code")
    terms = t["utms"].select(
        F.col("id").alias("utms_id"), keyword_class(F.col("utm_term"), ["free"], ignore_case=False).alias("keyword"))
    products = t["products"].select(F.col("id").alias("product_id"), "sub_product")
    visits = (
        totals.join(agents, "user_agent_id", "left").join(terms, "utms_id", "left")
        .withColumn("keyword", F.coalesce("keyword", F.lit("other"))))
    who = _subscribers(t, p, after or p.start).join(products, "product_id", "left")
    domain = email_domain(F.col("email"))
    rows = visits.join(who, "subscription_id").withColumns({
        "ip_country": F.coalesce("ip_country_iso_code", "customer_country"), "email_domain": domain,
        "user_segment": customer_segment(domain)})
    keys = ["subscription_id", "status", "price_amount", "price_trial", "keyword", "sub_product", "email_domain",
            "user_segment", "device", "ip_country"]
    return rows.groupBy(*keys).agg(*_merge()).where(F.col("charges") > F.col("refunds")).select(
        *_measures(), F.date_format("first_payment", "yyyy-MM").alias("cohort"), "keyword", "sub_product",
        "email_domain", "user_segment", "device")
