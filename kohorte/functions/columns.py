"""Column expressions shared by the operators. All stay on the JVM side."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import date
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from kohorte.functions import constants as k


def day(value: date | str) -> Column:
    return F.lit(str(value)).cast("date")


def literal(value) -> Column:
    """A literal; decimals keep a fixed type so that map values agree."""
    return F.lit(value).cast("decimal(18,6)") if isinstance(value, Decimal) else F.lit(value)


def lookup(key: Column, table: Mapping, default=None) -> Column:
    """Constant dictionary lookup, as a map literal: no join, no broadcast."""
    entries = [literal(x) for pair in table.items() for x in pair]
    hit = F.try_element_at(F.create_map(*entries), key)
    return hit if default is None else F.coalesce(hit, literal(default))


def count_if(cond: Column) -> Column:
    """Number of rows for which ``cond`` holds; 0, never NULL, on an empty group."""
    return F.count(F.when(cond, F.lit(1)))


def sum_if(cond: Column, value: Column) -> Column:
    return F.sum(F.when(cond, value).otherwise(F.lit(0)))


def safe_div(num: Column, den: Column) -> Column:
    """``num / den``, NULL where the denominator is zero."""
    return num / F.nullif(den, F.lit(0))


def ratio(num: Column, den: Column) -> Column:
    return safe_div(num.cast("double"), den.cast("double"))


def money(value: Column) -> Column:
    """Two-decimal amount; doubles are first cut at six digits so that the last bit cannot tip a half cent."""
    return F.round(value.cast("decimal(28,6)"), 2).cast("decimal(18,2)")


def whole_units(value: Column) -> Column:
    """Money rounded half up to whole units (a bare cast would truncate)."""
    return F.round(value.cast("decimal(28,6)"), 0).cast("bigint")


def normal_country(code: Column) -> Column:
    return F.when(code == "UK", F.lit("GB")).otherwise(code)


def country_or_unknown(code: Column) -> Column:
    return normal_country(F.coalesce(F.upper(F.trim(code)), F.lit("UNKNOWN")))


def static_eur(amount: Column, currency: Column) -> Column:
    return (amount * lookup(currency, k.STATIC_FX, k.STATIC_FX_DEFAULT).cast("decimal(7,6)")).cast("decimal(18,8)")


def calendar_week_label(ts: Column) -> Column:
    """``2026-W9``: calendar year with the ISO week, so the last days of December may read ``W1``."""
    return F.concat(F.year(ts).cast("string"), F.lit("-W"), F.weekofyear(ts).cast("string"))


def iso_week_label(ts: Column) -> Column:
    """As :func:`calendar_week_label` with the ISO year."""
    return F.concat(F.extract(F.lit("yearofweek"), ts).cast("string"), F.lit("-W"), F.weekofyear(ts).cast("string"))


def week_span_label(d: Column) -> Column:
    """``05-11 Jan 2026 (W02)``: first and last day of the week, and its ISO number."""
    monday = F.date_trunc("week", d).cast("date")
    return F.concat(
        F.date_format(monday, "dd"), F.lit("-"), F.date_format(F.date_add(monday, 6), "dd MMM yyyy"),
        F.lit(" (W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"), F.lit(")"),
    )


def week_start(d: Column) -> Column:
    return F.date_trunc("week", d).cast("date")


def month_start(d: Column) -> Column:
    return F.date_trunc("month", d).cast("date")


def local_date(ts: Column, zone: str) -> Column:
    return F.from_utc_timestamp(ts, zone).cast("date")


def whole_days_between(end: date, start: Column) -> Column:
    """Completed 24-hour days from ``start`` to midnight of ``end`` (not calendar boundaries)."""
    seconds = F.unix_timestamp(F.lit(str(end)).cast("timestamp")) - F.unix_timestamp(start.cast("timestamp"))
    return F.floor(seconds / F.lit(86400)).cast("bigint")


def whole_months_between(end: date, start: Column) -> Column:
    return (F.lit(end.year * 12 + end.month) - (F.year(start) * 12 + F.month(start))).cast("bigint")


def email_domain(email: Column) -> Column:
    return F.lower(F.split_part(email, F.lit("@"), F.lit(2)))


def customer_segment(domain: Column) -> Column:
    """B2C for the consumer mailbox providers, B2B otherwise, missing addresses included."""
    return F.when(domain.isin(k.CONSUMER_MAIL_DOMAINS), "B2C").otherwise("B2B")


def keyword_class(term: Column, words: Iterable[str] = tuple(k.FREE_WORDS), *, ignore_case: bool = True) -> Column:
    hits = [term.ilike(f"%{w}%") if ignore_case else term.like(f"%{w}%") for w in words]
    return F.when(reduce(lambda a, b: a | b, hits), "free").otherwise("other")


def file_group(fmt: Column) -> Column:
    return lookup(fmt, k.FILE_FORMAT_GROUPS, k.FILE_FORMAT_OTHER)


def size_in_mb(text: Column) -> Column:
    """``'12.3MB'`` / ``'450KB'`` in any case to megabytes; NULL for anything else."""
    number = F.regexp_extract(text, r"(?i)^\s*([0-9]+(?:\.[0-9]+)?)\s*[MK]B\s*$", 1).try_cast("double")
    return F.when(text.ilike("%MB%"), number).when(text.ilike("%KB%"), number / 1024)


def one_line(text: Column) -> Column:
    return F.translate(text, "\n\r", "  ")


def decimal_comma(value: Column) -> Column:
    """Presentation only: ``98.88`` as ``98,88``."""
    return F.regexp_replace(value.cast("string"), r"\.", ",")


def percent_text(rate: Column, digits: int = 1) -> Column:
    """Presentation only: ``0.1234`` as ``12.3%``, ``N/A`` when missing."""
    text = F.concat(F.format_string(f"%.{digits}f", rate * 100), F.lit("%"))
    return F.when(rate.isNotNull(), text).otherwise("N/A")


def logistic(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def power_law(x: Column, alpha: Column, beta: Column) -> Column:
    return alpha * F.pow(x.cast("double"), beta)
