"""State folded from feeds equals a rebuild."""

import random
from datetime import datetime, timedelta

import pytest

from fixtures import P, at, charge, table, tables
from kohorte.operators import counters, facts, incremental, retention
from kohorte.plans import registry
from kohorte.sources.schemas import SCHEMAS
from kohorte.sources.state import PartitionedState


def rows(df):
    return sorted(map(repr, df.collect()))


def test_latest_rows_from_feeds(spark, tmp_path):
    """Later copies, ties, copies of one feed, a feed folded twice and in another order."""
    rng = random.Random(1)
    feed = []
    for i in range(120):
        for _ in range(rng.randint(1, 3)):
            row = list(charge(i, i % 9, rng.choice(["0.95", "29.95"]), "2000-02-01", currency=rng.choice(["EUR", None])))
            row[13] = at("2000-02-01") + timedelta(days=rng.randint(0, 2))
            feed.append(tuple(row))
    whole = table(spark, "transactions", feed)
    want = rows(counters.dedup_latest_txn(whole))
    for name, order in (("a", [0, 1, 2]), ("b", [2, 0, 1, 0])):
        latest = incremental.LatestRows(spark, str(tmp_path / name), SCHEMAS["transactions"], parts=3)
        for k in order:
            latest.fold(table(spark, "transactions", feed[k::3]))
        assert rows(latest.read().select(whole.columns)) == want
    empty = incremental.LatestRows(spark, str(tmp_path / "c"), SCHEMAS["transactions"])
    empty.fold(whole.limit(0))
    assert empty.read().collect() == []


def test_only_touched_partitions_are_rewritten(spark, tmp_path):
    state = PartitionedState(spark, str(tmp_path / "s"), "id bigint, v bigint", "id", parts=8)
    add = lambda rows: rows.groupBy("id").max("v").withColumnRenamed("max(v)", "v")
    state.merge(spark.createDataFrame([(i, 1) for i in range(40)], "id bigint, v bigint"), add)
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "s").rglob("*.parquet")}
    state.merge(spark.createDataFrame([(7, 5)], "id bigint, v bigint"), add)
    after = {f: f.stat().st_mtime_ns for f in (tmp_path / "s").rglob("*.parquet")}
    kept = set(before.items()) & set(after.items())
    assert len({f.parent for f, _ in kept}) == len({f.parent for f in before}) - 1
    assert rows(state.read()) == sorted(f"Row(id={i}, v={5 if i == 7 else 1})" for i in range(40))


def history(seed=3):
    """Payments of 30 subscriptions over 40 days, refunds and failures among them."""
    rng, out = random.Random(seed), []
    for sub in range(1, 31):
        when, n = rng.randint(0, 10), rng.randint(1, 6)
        for k in range(n):
            kind = int(k and rng.random() < 0.3)
            out.append(charge(1000 * sub + k, sub, "29.95", str(datetime(2000, 2, 1) + timedelta(days=when))[:10], kind=kind,
                              status=int(rng.random() < 0.9), agent=rng.choice([1, 2, None]), term=rng.choice([1, None])))
            when += rng.randint(0, 9)
    return sorted(out, key=lambda r: (r[12], r[0]))


def subscriptions(churned):
    return [(i, 1 if i % 3 else 4, 0, 1, "Unsuscribed" if i in churned else "Active", at("2000-01-15"), None, None) for i in range(1, 31)]


def rebuilt(t):
    return retention.fold(retention.model_rows(facts.subscription_segments(t, P), P, tenure_offset=1, markets=False, annual=True), "user_segment")


def test_life_cells_day_by_day(spark, tmp_path, monkeypatch):
    """Every few days the folded tables equal a rebuild; runs that break off at any step are completed by the same call; statuses change."""
    paid = history()
    days = sorted({r[12] for r in paid})
    feeds = [days[i:i + 8] for i in range(0, len(days), 8)]
    cells, churned, seen = incremental.LifeCells(spark, str(tmp_path / "cells"), parts=3), set(), []
    for number, some in enumerate(feeds):
        new = [r for r in paid if r[12] in some]
        seen += new
        turned = {5, 6} if number == 1 else {20} if number == 3 else set()
        churned |= turned
        t = tables(spark, seen, subscriptions=subscriptions(churned))
        changed = spark.createDataFrame([(i,) for i in turned], "subscription_id bigint")
        feed = table(spark, "transactions", new)
        if number in (1, 2):      # broken off: before the counts, and between the two tables
            broken = "write" if number == 1 else "places"
            with monkeypatch.context() as m:
                if broken == "write":
                    m.setattr(incremental, "CELL", ["no such column"])
                else:
                    m.setattr(cells.places, "apply", lambda staging: 1 / 0)
                with pytest.raises(Exception):
                    cells.fold(number, feed, t, P, changed=changed)
        cells.fold(number, feed, t, P, changed=changed)
        cells.fold(number, feed, t, P, changed=changed)       # a feed counts once
        if number == 3:
            cells.compact(2)
        want = rebuilt(t)
        assert rows(retention.life_table(cells.cells(P))) == rows(retention.life_table(want))
        assert rows(retention.km_survival(cells.cells(P))) == rows(retention.km_survival(want))
    cells.compact(len(feeds) - 1)
    assert rows(retention.life_table(cells.cells(P))) == rows(retention.life_table(want))
    assert all(r[retention.WEIGHT] > 0 for r in cells.cells(P).collect())


def counted(spark, df):
    """``df``, and the number of its rows that have been built so far, over all passes."""
    built = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            built.add(batch.num_rows)
            yield batch

    return df.mapInArrow(passed, df.schema), built


def test_payments_are_built_once(spark, tmp_path):
    """Neither the feeds of a history nor the folding of a feed builds the rows again for every pass over them."""
    paid = history()
    whole, built = counted(spark, table(spark, "transactions", paid))
    cells = incremental.LifeCells(spark, str(tmp_path / "cells"), parts=3)
    cells.fold(0, whole, tables(spark, paid, subscriptions=subscriptions(set())), P)
    assert built.value == len(paid)
    assert rows(retention.life_table(cells.cells(P))) == rows(retention.life_table(rebuilt(tables(spark, paid, subscriptions=subscriptions(set())))))
    assert not (tmp_path / "cells" / "aside" / "0").exists()
    stamped = [(i, at(day) if day else None) for i, day in enumerate(
        [None, "1995-12-31", "1996-01-01", "1997-05-01", "1998-01-01", "1999-12-31", "2000-01-01", "2031-01-01"])]
    whole, built = counted(spark, spark.createDataFrame(stamped, "id bigint, stamp timestamp"))
    parts = []
    for feed in registry._feeds(whole, "stamp"):
        assert feed.columns == whole.columns and feed.count() == 2
        parts.append(sorted(r["id"] for r in feed.collect()))
    assert parts == [[0, 1], [2, 3], [4, 5], [6, 7]] and built.value == len(stamped)


def test_a_partition_may_become_empty(spark, tmp_path):
    """A refund of the only charge takes the subscription out of every cell."""
    first, back = [charge(1, 1, "29.95", "2000-02-01"), charge(2, 1, "29.95", "2000-02-09")], [charge(k, 1, "29.95", "2000-03-01", kind=1) for k in (3, 4)]
    cells = incremental.LifeCells(spark, str(tmp_path / "cells"), parts=2)
    cells.fold(0, table(spark, "transactions", first), tables(spark, first), P)
    assert [r["n_risk"] for r in retention.life_table(cells.cells(P)).collect()] == [1, 1]
    cells.fold(1, table(spark, "transactions", back), tables(spark, first + back), P)
    assert cells.cells(P).collect() == [] and cells.places.read().collect() == []
