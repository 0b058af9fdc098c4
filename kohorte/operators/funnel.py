"""Product-event funnel, country names and marketing spend."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kohorte.functions import constants as k
from kohorte.functions.columns import country_or_unknown, day, money, normal_country
from kohorte.operators.shared import on_or_after
from kohorte.params import Params
from kohorte.sources.catalog import Tables

# Funnel step -> event that marks it.
STEPS = k.FUNNEL_EVENTS


def country_mapping(t: Tables) -> DataFrame:
    """Lower-case country name -> ISO code, one row per name, UK written GB."""
    low, high = F.min("country_iso_2"), F.max("country_iso_2")
    return t["countries"].groupBy(F.lower(F.trim("country_name")).alias("c_name")).agg(
        F.when((low == "UK") | (high == "UK"), F.lit("GB")).otherwise(high).alias("iso"))


def located_events(t: Tables, p: Params, projects: Sequence[str]) -> DataFrame:
    """Events of some projects with ``iso`` looked up by country name; unmatched names keep NULL."""
    events = t["events"].where(
        F.col("project_id").isin(list(projects)) & (F.col("environment") == p.environment))
    events = on_or_after(events, "event_time", p.start)
    return events.withColumn("c_name", F.lower(F.trim("country"))).join(country_mapping(t), "c_name", "left")


def distinct_users(events: DataFrame, steps: Mapping[str, Column], *keys: str) -> DataFrame:
    """Distinct users per step. First one row of flags per user, then a sum: two aggregations that both
    combine on the map side, instead of one expanded copy of every event per step."""
    reached = F.col("amplitude_id").isNotNull()
    per_user = events.groupBy(*keys, "amplitude_id").agg(
        *[F.max(F.when(reached & cond, 1).otherwise(0)).alias(name) for name, cond in steps.items()])
    return per_user.groupBy(*keys).agg(*[F.sum(name).alias(name) for name in steps])


def funnel_daily(t: Tables, p: Params, *, unknown: bool = False) -> DataFrame:
    """(day, country) -> distinct users per funnel step.

    ``unknown=True`` normalises the country and calls a missing one UNKNOWN; otherwise the name as sent
    stands in for an unmatched country.
    """
    place = F.coalesce("iso", "country")
    events = located_events(t, p, p.funnel_projects).select(
        F.col("event_time").cast("date").alias("date"),
        (country_or_unknown(place) if unknown else place).alias("ip_country"), "event_type", "amplitude_id")
    return distinct_users(events, {n: F.col("event_type") == e for n, e in STEPS.items()}, "date", "ip_country")


LG_K = 14      # 16,384 registers: a standard error of 0.8 %


def funnel_sketches(t: Tables, p: Params, *, lg_k: int = LG_K) -> DataFrame:
    """(day, country) -> a sketch of the distinct users of each step.

    Users of a week or a month are not the sum of its days' users; sketches can be merged over any span and are at most some kilobytes
    a cell. Stored by day (``sinks.write_days``), a day is written once and never read again from events.
    """
    events = located_events(t, p, p.funnel_projects).select(
        F.col("event_time").cast("date").alias("date"), F.coalesce("iso", "country").alias("ip_country"), "event_type", "amplitude_id")
    return events.groupBy("date", "ip_country").agg(*[
        F.hll_sketch_agg(F.when(F.col("event_type") == event, F.col("amplitude_id")), F.lit(lg_k)).alias(name) for name, event in STEPS.items()])


def sketched_users(sketches: DataFrame, *keys: Column | str) -> DataFrame:
    """``keys`` of the sketches' rows -> distinct users per step, within about three standard errors of the exact number."""
    merged = sketches.groupBy(*keys).agg(*[F.hll_union_agg(name).alias(name) for name in STEPS])
    return merged.withColumns({name: F.coalesce(F.hll_sketch_estimate(name), F.lit(0)).cast("bigint") for name in STEPS})


def funnel_by_span(t: Tables, p: Params, span: Column) -> DataFrame:
    """(span, country) -> exact distinct users per funnel step from the events; ``span`` is of ``event_time``."""
    events = located_events(t, p, p.funnel_projects).select(
        span.alias("span"), F.coalesce("iso", "country").alias("ip_country"), "event_type", "amplitude_id")
    return distinct_users(events, {n: F.col("event_type") == e for n, e in STEPS.items()}, "span", "ip_country")


def page_funnel_daily(t: Tables, p: Params, *, projects: Sequence[str], event: str = "view_page",
                      page: str = "tool_page", page_key: str = "page_name") -> DataFrame:
    """(day, country) -> distinct users that saw one page, read from the event's JSON properties."""
    events = located_events(t, p, projects).where(
        F.col("event_type").isin(k.PAGE_EVENTS)).select(
        F.col("event_time").cast("date").alias("date"),
        country_or_unknown(F.coalesce("iso", "country")).alias("ip_country"), "amplitude_id",
        ((F.col("event_type") == event)
         & (F.get_json_object("event_properties", f"$.{page_key}") == page)).alias("on_page"))
    return distinct_users(events, {"landing_page_viewers": F.col("on_page")}, "date", "ip_country")


def funnel_by_site(t: Tables, p: Params, *, step_site: str, page_site: str, page_projects: Sequence[str]) -> DataFrame:
    """(day, country, site) -> landing page viewers of the event-based and of the page-based site."""
    by_event = funnel_daily(t, p, unknown=True).select("date", "ip_country", "landing_page_viewers").withColumn(
        "site", F.lit(step_site))
    by_page = page_funnel_daily(t, p, projects=page_projects).withColumn("site", F.lit(page_site))
    return by_event.unionByName(by_page)


def spend_daily(t: Tables, p: Params) -> DataFrame:
    """(day, country) -> marketing cost."""
    return t["marketing_spends_pdf"].where(F.col("date") >= F.lit(str(p.start)).cast("date")).groupBy(
        "date", normal_country(F.col("geo")).alias("ip_country")).agg(money(F.sum("costs")).alias("spend"))


def spend_by_site(t: Tables, p: Params, *, first_site: str, second_site: str, second_project: str,
                  second_since: date | None | str = "start") -> DataFrame:
    """(day, country, site) -> marketing cost of two sources. The site is a constant per source, so the
    union cannot produce equal rows and needs no distinct.

    The first source counts from ``p.start``, the second from ``second_since`` (``"start"``: the same day; None: all days).
    """
    since = p.start if second_since == "start" else second_since
    first = t["marketing_spends_pdf"].where(F.col("date") >= day(p.start)).groupBy(
        "date", country_or_unknown(F.col("geo")).alias("ip_country"), F.lit(first_site).alias("site"))
    second = t["marketing_spends_web"].where(F.col("project_id") == second_project)
    if since is not None:
        second = second.where(F.col("date") >= day(since))
    second = second.groupBy(
        "date", F.coalesce(normal_country(F.col("geo")), F.lit("UNKNOWN")).alias("ip_country"),
        F.lit(second_site).alias("site"))
    return first.agg(money(F.sum("costs")).alias("spend")).unionByName(second.agg(money(F.sum("costs")).alias("spend")))
