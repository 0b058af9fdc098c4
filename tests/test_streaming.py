"""The streaming funnel, sketches of users, dimensions with history."""

import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fixtures import P, table
from kohorte.operators import funnel, ledger
from kohorte.params import Params
from kohorte.sources import sinks
from kohorte.sources.catalog import Tables
from kohorte.sources.schemas import SCHEMAS
from kohorte.streaming import funnel as streamed

OWN = Params(as_of=P.as_of, start=date(2000, 1, 1), funnel_projects=("web",))
COUNTRIES = [("Spain", "ES"), ("United Kingdom", "UK"), ("United Kingdom", "GB")]


def rows(df):
    return sorted(map(repr, df.collect()))


def event(when, user, kind="landing_page_viewed", country=" spain", project="web"):
    return (when, kind, user, country, project, "prod", "{}")


def events(n, seed=1, days=6):
    rng, kinds = random.Random(seed), [*funnel.STEPS.values(), "other"]
    return [event(datetime(2000, 3, 1) + timedelta(minutes=rng.randrange(days * 1440)), rng.choice([None, *range(12)]), rng.choice(kinds),
                  rng.choice([" Spain ", "United Kingdom", "Atlantis", None]), rng.choice(["web", "web", "mobile"])) for _ in range(n)]


def batch(spark, given):
    t = Tables({"events": lambda: table(spark, "events", given), "countries": lambda: table(spark, "countries", COUNTRIES)})
    return funnel.funnel_daily(t, OWN)


@pytest.fixture
def stream(spark, tmp_path):
    """Adds events to the source and runs the query over what is new."""
    source, made = tmp_path / "events", []

    def run(given, delay="2 days", broken=False):
        if given:
            table(spark, "events", given).coalesce(1).write.mode("append").parquet(str(source))
        reader = spark.readStream.schema(SCHEMAS["events"]).parquet(str(source))
        t = Tables({"events": lambda: reader, "countries": lambda: table(spark, "countries", COUNTRIES)})
        query = streamed.write_funnel(streamed.first_sights(t, OWN, delay=delay), str(tmp_path / "funnel"), str(tmp_path / "checkpoint"))
        query.awaitTermination()
        made.append(query)
        return streamed.read_funnel(spark, str(tmp_path / "funnel"))
    return run


def test_stream_equals_batch(spark, stream):
    """Feeds in order, copies of events, users seen again in a later feed, a feed without news."""
    given = sorted(events(400), key=lambda e: e[0])
    for k in range(0, 400, 100):
        got = stream(given[k:k + 100] + given[max(0, k - 30):k])
    assert rows(got.select(batch(spark, given).columns)) == rows(batch(spark, given))
    assert rows(stream([])) == rows(got)


def test_late_events_inside_the_watermark_count(spark, stream):
    on_time = [event(datetime(2000, 3, d, 12), 1) for d in (1, 2, 3)]
    late, too_late = event(datetime(2000, 3, 2, 1), 2), event(datetime(2000, 3, 1, 1), 3)
    stream(on_time)
    stream([event(datetime(2000, 3, 4, 12), 1)])          # the watermark is two days behind: 1 March has ended
    got = stream([late, too_late])
    want = batch(spark, [*on_time, event(datetime(2000, 3, 4, 12), 1), late])
    assert rows(got.select(want.columns)) == rows(want)


def test_a_repeated_batch_counts_once(spark, stream, tmp_path):
    given = events(60)
    got = rows(stream(given))
    # The checkpoint forgets that the last batch was written, as after a crash between sink and commit.
    for commit in (tmp_path / "checkpoint" / "commits").iterdir():
        commit.rename(tmp_path / f"lost-{commit.name}")
    assert rows(stream([])) == got
    (tmp_path / "funnel" / "batch=99").mkdir()            # a batch that was never completed
    assert rows(streamed.read_funnel(spark, str(tmp_path / "funnel"))) == got


def test_sketches_merge_over_any_span(spark, tmp_path):
    """Thousands of users, most of them on several days; a day written again replaces itself."""
    users = spark.range(0, 40_000).selectExpr(
        "timestamp'2000-03-01' + make_dt_interval(cast(id % 20 as int)) as event_time",
        "case id % 2 when 0 then 'landing_page_viewed' else 'sign_up' end as event_type", "(id * 7919) % 9001 as amplitude_id",
        "'Spain' as country", "'web' as project_id", "'prod' as environment", "'{}' as event_properties")
    t = Tables({"events": lambda: users, "countries": lambda: table(spark, "countries", COUNTRIES)})
    path = str(tmp_path / "sketches")
    sinks.write_days(funnel.funnel_sketches(t, OWN), path)
    again = Tables({"events": lambda: users.where("cast(event_time as date) = '2000-03-05'"), "countries": lambda: t["countries"]})
    sinks.write_days(funnel.funnel_sketches(again, OWN), path)
    stored = spark.read.parquet(path)
    assert stored.count() == 20
    for span in (F.trunc("date", "month"), F.trunc("date", "week"), F.col("date")):
        merged = {(r["span"], r["ip_country"]): r for r in funnel.sketched_users(stored, span.alias("span"), "ip_country").collect()}
        on = {"month": F.trunc(F.col("event_time").cast("date"), "month"), "week": F.trunc(F.col("event_time").cast("date"), "week")}
        name = "month" if "month" in str(span) else "week" if "week" in str(span) else None
        exact = funnel.funnel_by_span(t, OWN, on[name] if name else F.col("event_time").cast("date")).collect()
        assert len(exact) == len(merged)
        for r in exact:
            for step in funnel.STEPS:
                assert abs(merged[r["span"], r["ip_country"]][step] - r[step]) <= 4 * 0.0082 * r[step]


def lifetimes(spark, *values):
    return spark.createDataFrame([(c, Decimal(p), Decimal(v)) for c, p, v in values], "country string, price decimal(10,2), lt_36m decimal(18,2)")


def test_dimension_keeps_its_history(spark, tmp_path):
    """Written on three days, one of them twice: changed, unchanged, new and ended rows, read as of any day."""
    path, keys = str(tmp_path / "dim"), ["country", "price"]
    with pytest.raises(ValueError):
        sinks.read_dimension(spark, path)
    first, second, third = date(2000, 1, 1), date(2000, 2, 1), date(2000, 3, 1)
    sinks.write_dimension(lifetimes(spark, ("ES", "29.95", "3.00"), ("FR", "29.95", "4.00"), ("IT", "29.95", "5.00")), path, keys, first)
    sinks.write_dimension(lifetimes(spark, ("ES", "29.95", "9.99")), path, keys, second)
    sinks.write_dimension(lifetimes(spark, ("ES", "29.95", "3.00"), ("FR", "29.95", "4.50"), ("GB", "29.95", "1.00")), path, keys, second)
    sinks.write_dimension(lifetimes(spark, ("ES", "29.95", "3.00"), ("FR", "29.95", "4.00"), ("IT", "29.95", "5.00")), path, keys, third)
    held = sorted((r["country"], str(r["lt_36m"]), r["valid_from"], r["valid_to"]) for r in sinks.read_dimension(spark, path).collect())
    assert held == [("ES", "3.00", first, None), ("FR", "4.00", first, date(2000, 1, 31)), ("FR", "4.00", third, None),
                    ("FR", "4.50", second, date(2000, 2, 29)), ("GB", "1.00", second, date(2000, 2, 29)),
                    ("IT", "5.00", first, date(2000, 1, 31)), ("IT", "5.00", third, None)]
    at = lambda d: {r["country"]: str(r["lt_36m"]) for r in sinks.read_dimension(spark, path, on=d).collect()}
    assert at(date(2000, 1, 15)) == {"ES": "3.00", "FR": "4.00", "IT": "5.00"}
    assert at(date(2000, 2, 15)) == {"ES": "3.00", "FR": "4.50", "GB": "1.00"}
    assert at(date(1999, 1, 1)) == {}
    # A version that broke off is not seen, and a reader of the version before goes on.
    (tmp_path / "dim" / "version=77").mkdir()
    assert at(third) == {"ES": "3.00", "FR": "4.00", "IT": "5.00"}
    sinks.write_dimension(lifetimes(spark, ("ES", "29.95", "1.00")), path, keys, date(2000, 4, 1))
    assert at(date(2000, 4, 1)) == {"ES": "1.00"} and at(date(2000, 3, 31)) == {"ES": "3.00", "FR": "4.00", "IT": "5.00"}


def test_a_report_joins_the_written_dimension(spark, tmp_path):
    """Validity columns are what dated values are looked up by."""
    path = str(tmp_path / "dim")
    for value, day in (("3.00", date(2000, 1, 1)), ("4.00", date(2000, 2, 1))):
        sinks.write_dimension(spark.createDataFrame([("ES", Decimal(value))], "country string, value decimal(10,2)"), path, ["country"], day)
    keys = spark.createDataFrame([("ES", date(2000, 1, 31)), ("ES", date(2000, 2, 1)), ("ES", date(1999, 1, 1))], "ip_country string, date date")
    got = {r["date"]: str(r["ltv"]) for r in ledger.with_dated_ltv(keys, sinks.read_dimension(spark, path), Decimal("7.00")).collect()}
    assert got == {date(2000, 1, 31): "3.00", date(2000, 2, 1): "4.00", date(1999, 1, 1): "7.00"}
