"""Retention: preparation of the subscription fact, descriptives, life tables, survival, maturity-gated curves.

Everything that reads the fact is one grouped aggregation; what follows works on rows
per (segment, month) or (country, price, cycle).
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kohorte.functions import constants as k
from kohorte.functions.columns import day, lookup, money, ratio, whole_days_between, whole_months_between
from kohorte.params import Params


def maturity_days(cycle: int, rule: str) -> int:
    """Account age from which a subscription could have reached renewal ``cycle``.

    ``first``: 8 days for the first renewal, then 28-day cycles after the trial week plus 2 days of grace;
    ``second``: 8 days of grace throughout.
    """
    if rule == "first":
        return k.FIRST_RENEWAL_DAYS if cycle == 1 else k.TRIAL_DAYS + k.CYCLE_DAYS * (cycle - 1) + k.FIRST_RULE_GRACE
    if rule == "second":
        return k.TRIAL_DAYS + k.CYCLE_DAYS * (cycle - 1) + k.SECOND_RULE_GRACE
    raise ValueError(f"unknown maturity rule {rule!r}")


TIER_OF = {country: tier for tier, members in k.MARKET_TIERS.items() for country in members}


def model_rows(fact: DataFrame, p: Params, *, tenure_offset: int = 0, obs_end: date | None = None, markets: bool = True,
               annual: bool = False) -> DataFrame:
    """Fact rows that may enter a model, with churn flag, account age, start day and market tier.

    Drops subscriptions that start after ``obs_end``, annual plans (unless ``annual``), tenures below zero
    after ``tenure_offset`` and, with ``markets``, countries without a tier.
    """
    end = obs_end or p.as_of
    began = F.col("initial_payment_date")
    rows = fact.where(began.cast("timestamp") <= day(end).cast("timestamp"))
    if not annual:
        rows = rows.where(F.col("amount") < F.lit(p.annual_from))
    rows = rows.withColumn("tenure", (F.col("tenure") - tenure_offset).cast("bigint")).where(F.col("tenure") >= 0)
    rows = rows.withColumns({
        "churned": F.when(F.col("status") == "churned", 1).otherwise(0).cast("bigint"),
        "account_age_days": whole_days_between(end, began), "age": whole_months_between(end, began),
        "started": began.cast("date")})
    if not markets:
        return rows
    return rows.withColumn("tier", lookup(F.col("ip_country"), TIER_OF)).where(F.col("tier").isNotNull())


WEIGHT = "n_subscriptions"
CELL = ["tenure", "account_age_days", "age", "churned", "started"]


def fold(rows: DataFrame, *dims: str) -> DataFrame:
    """Subscriptions counted per cell of ``dims``, tenure, age, churn and start day.

    All that the models read, and no longer than the calendar times the tenures per dimension, however many
    subscriptions there are. The functions below take cells and single rows alike.
    """
    return rows.groupBy(*dims, *CELL).agg(F.count(F.lit(1)).alias(WEIGHT))


def heads(df: DataFrame, cond: Column | None = None, value: Column | None = None) -> Column:
    """Number of subscriptions (or sum of ``value`` over them) for which ``cond`` holds; 0 on an empty group."""
    weight = F.col(WEIGHT) if WEIGHT in df.columns else F.lit(1)
    amount = weight if value is None else weight * value
    amount = amount if cond is None else F.when(cond, amount)
    return F.coalesce(F.sum(amount), F.lit(0)).cast("bigint")


def volume_gate(rows: DataFrame, p: Params) -> DataFrame:
    """Rows of countries with at least ``min_country_volume`` subscriptions."""
    volume = rows.groupBy("ip_country").agg(heads(rows).alias("n")).where(F.col("n") >= p.min_country_volume)
    return rows.join(volume.select("ip_country"), "ip_country", "left_semi")


def model_prep(fact: DataFrame, p: Params, **options) -> DataFrame:
    """Model rows of countries with enough volume. Reads ``fact`` twice: pass a stored one."""
    return volume_gate(model_rows(fact, p, **options), p)


# ------------------------------------------------------------------ descriptive


def segment_descriptives(prepared: DataFrame, segment: str = "user_segment") -> DataFrame:
    return prepared.groupBy(segment).agg(
        heads(prepared).alias("users"),
        ratio(heads(prepared, value=F.col("churned")), heads(prepared)).alias("avg_churn_rate"))


def price_descriptives(prepared: DataFrame, top: int = 3) -> DataFrame:
    """The ``top`` prices by users, with mean and longest tenure."""
    return prepared.groupBy("amount").agg(
        heads(prepared).alias("users"),
        ratio(heads(prepared, value=F.col("tenure")), heads(prepared)).alias("tenure_avg"),
        F.max("tenure").alias("tenure_max")).orderBy(F.desc("users"), "amount").limit(top)


def top_countries(prepared: DataFrame, top: int = 5) -> DataFrame:
    return prepared.groupBy("ip_country").agg(heads(prepared).alias("users")).orderBy(
        F.desc("users"), "ip_country").limit(top)


def cr_by_price(prepared: DataFrame, *, first_days: int = k.FIRST_RENEWAL_DAYS, second_days: int = k.SECOND_RENEWAL_DAYS) -> DataFrame:
    """Price -> users, and the percentage of old enough ones that reached the first and second renewal."""
    age, tenure = F.col("account_age_days"), F.col("tenure")

    def percent(days: int, reached: int) -> Column:
        return money(ratio(heads(prepared, (age >= days) & (tenure >= reached)), heads(prepared, age >= days)) * 100)

    return prepared.groupBy("amount").agg(
        heads(prepared).alias("n"),
        heads(prepared, age >= first_days).alias("eligible_r1"), percent(first_days, 2).alias("cr_sale_to_r1"),
        heads(prepared, age >= second_days).alias("eligible_r2"), percent(second_days, 3).alias("cr_sale_to_r2"))


# ------------------------------------------------------------------- life table


def _at_risk(counts: DataFrame, last: DataFrame, segment: str) -> DataFrame:
    """Counts per (segment, month) put on the gapless months 0..last; at risk = everyone who got that far."""
    months = last.select(segment, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last"))).alias("month"))
    later = Window.partitionBy(segment).orderBy(F.desc("month")).rowsBetween(Window.unboundedPreceding, 0)
    return months.join(counts, [segment, "month"], "left").select(
        segment, "month", F.sum(F.coalesce("reached", F.lit(0))).over(later).alias("n_risk"),
        F.coalesce("events", F.lit(0)).cast("bigint").alias("n_event"))


def life_table(prepared: DataFrame, segment: str = "user_segment") -> DataFrame:
    """(segment, month 0..longest tenure) -> subscriptions with at least that tenure, and those churned at it."""
    counts = prepared.groupBy(segment, F.col("tenure").alias("month")).agg(
        heads(prepared).alias("reached"), heads(prepared, value=F.col("churned")).alias("events"))
    return _at_risk(counts, counts.groupBy(segment).agg(F.max("month").alias("last")), segment)


def running_product(value: Column, window) -> Column:
    """Product of ``value`` up to the current row; exact for zeros and signs."""
    zeros = F.count(F.when(value == 0, 1)).over(window)
    negatives = F.count(F.when(value < 0, 1)).over(window)
    size = F.exp(F.coalesce(F.sum(F.when(value != 0, F.log(F.abs(value)))).over(window), F.lit(0.0)))
    return F.when(zeros > 0, F.lit(0.0)).when(negatives % 2 == 1, -size).otherwise(size)


def by_month(segment: str):
    return Window.partitionBy(segment).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)


def km_survival(prepared: DataFrame, segment: str = "user_segment") -> DataFrame:
    """(segment, month 0..highest age) -> at risk, events, survival; months nobody is at risk in are left out.

    At risk needs both age and tenure to reach the month; an event counts at its tenure whatever the age.
    ``lifetime`` is the area under the segment's whole curve.
    """
    reach = F.least("age", "tenure")
    events = prepared.where(F.col("churned") == 1).groupBy(segment, F.col("tenure").alias("month")).agg(
        F.lit(0).cast("bigint").alias("reached"), heads(prepared).alias("events"))
    reached = prepared.where(reach >= 0).groupBy(segment, reach.alias("month")).agg(
        heads(prepared).alias("reached"), F.lit(0).cast("bigint").alias("events"))
    counts = reached.unionByName(events).groupBy(segment, "month").agg(
        F.sum("reached").alias("reached"), F.sum("events").alias("events"))
    last = prepared.groupBy(segment).agg(F.max("age").alias("last")).where(F.col("last") >= 0)
    table = _at_risk(counts, last, segment).where(F.col("n_risk") > 0)
    kept = 1 - ratio(F.col("n_event"), F.col("n_risk"))
    return table.withColumn("p_survival", kept).withColumn(
        "survival_rate", running_product(F.col("p_survival"), by_month(segment)))


def empirical_lifetime(survival: DataFrame, segment: str = "user_segment") -> DataFrame:
    return survival.groupBy(segment).agg(F.sum("survival_rate").alias("lifetime_months"))


# ------------------------------------------------------- maturity-gated retention


def retention_counts(prepared: DataFrame, keys: Sequence[str], cycles: int, rule: str) -> DataFrame:
    """(keys, r = 1..cycles) -> old enough subscriptions and those of them that were charged r more times.

    One pass with a pair of conditional counts per cycle; the rows are unfolded after the aggregation.
    """
    age, tenure = F.col("account_age_days"), F.col("tenure")
    pairs = []
    for r in range(1, cycles + 1):
        old = age >= maturity_days(r, rule)
        pairs.append(F.struct(F.lit(r).cast("bigint").alias("r"), heads(prepared, old).alias("eligible"),
                              heads(prepared, old & (tenure >= r + 1)).alias("survivors")))
    folded = prepared.groupBy(*keys).agg(F.array(*pairs).alias("cells"))
    return folded.select(*keys, F.inline("cells"))


def retention_table(prepared: DataFrame, p: Params, *, cycles: int = 3, rule: str = "first") -> DataFrame:
    """(country, price, r) for the whole grid -> eligible, retained share; NULL share below ``min_eligible``."""
    cells = [(c, Decimal(x), r) for c in p.model_countries for x in p.price_points for r in range(1, cycles + 1)]
    grid = prepared.sparkSession.createDataFrame(cells, "ip_country string, amount decimal(10,2), r bigint")
    wanted = prepared.where(F.col("ip_country").isin(list(p.model_countries)) & F.col("amount").isin(list(p.price_points)))
    counts = retention_counts(wanted, ["ip_country", "amount"], cycles, rule)
    eligible = F.coalesce("eligible", F.lit(0))
    return grid.join(counts, ["ip_country", "amount", "r"], "left").select(
        "ip_country", "amount", "r", eligible.alias("eligible"),
        F.when(eligible >= p.min_eligible, ratio(F.col("survivors"), F.col("eligible"))).alias("retention"))


def observed_points(prepared: DataFrame, keys: Sequence[str], *, cycles: int, rule: str, at_least: int) -> DataFrame:
    """(keys, r) -> retained share, up to the cycle before the first with fewer than ``at_least`` subscriptions."""
    counts = retention_counts(prepared, keys, cycles, rule)
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    first_gap = F.min(F.when(F.col("eligible") < at_least, F.col("r"))).over(whole)
    return counts.withColumn("gap", first_gap).where(F.col("gap").isNull() | (F.col("r") < F.col("gap"))).select(
        *keys, "r", "eligible", ratio(F.col("survivors"), F.col("eligible")).alias("retention"))


def with_trial(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Points renumbered as cycles, the trial being cycle 1 with everyone in it."""
    shifted = points.select(*keys, (F.col("r") + 1).alias("cycle"), "retention")
    trial = points.where(F.col("r") == 1).select(*keys, F.lit(1).cast("bigint").alias("cycle"), F.lit(1.0).alias("retention"))
    return trial.unionByName(shifted)


def retention_curve(prepared: DataFrame, p: Params, *, rule: str = "first", at_least: int | None = None) -> DataFrame:
    """(country, price, cycle) -> retained share; cycle 1 is the trial, curves end before the first thin cycle."""
    wanted = prepared.where(F.col("ip_country").isin(list(p.model_countries)) & F.col("amount").isin(list(p.price_points)))
    keys = ["ip_country", "amount"]
    points = observed_points(wanted, keys, cycles=p.max_cycles, rule=rule, at_least=at_least or p.min_eligible)
    return with_trial(points, keys)
