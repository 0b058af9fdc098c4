"""Reports kept up to date by a day's feed, equal to a rebuild from the whole history.

* :class:`LatestRows`: the last version of every transaction (``counters.dedup_latest_txn``).
* :class:`LifeCells`: cells of the life tables, with retractions: a refund or a later payment moves a subscription from one cell to another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kohorte.functions import gates
from kohorte.functions.columns import whole_months_between
from kohorte.operators import facts, retention
from kohorte.params import Params
from kohorte.sources.catalog import Tables
from kohorte.sources.state import PartitionedState, exists, listed, remove


def latest_versions(rows: DataFrame, key: str = "id", stamp: str = "payment_date") -> DataFrame:
    """One row per key: the greatest stamp, ties by the other columns in their order. A maximum of rows, so parts of a feed can be
    folded in any order and more than once."""
    rest = [c for c in rows.columns if c not in (key, stamp)]
    return rows.groupBy(key).agg(F.max(F.struct(stamp, *rest)).alias("last")).select(
        *[F.col(c) if c == key else F.col(f"last.{c}").alias(c) for c in rows.columns])


class LatestRows:
    """The last version of every row by id, in a folder of its own."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, *, key: str = "id", stamp: str = "payment_date", parts: int = 16):
        self.state, self.key, self.stamp = PartitionedState(spark, f"{folder.rstrip('/')}/latest", schema, key, parts=parts), key, stamp

    def fold(self, feed: DataFrame) -> None:
        self.state.merge(feed, lambda rows: latest_versions(rows, self.key, self.stamp))

    def read(self) -> DataFrame:
        return self.state.read()


# What a feed's payments are read for.
PAYMENT = ["subscription_id", "user_agent_id", "utms_id", "transaction_type", "transaction_status", "amount", "payment_date"]
VISITS = ("subscription_id bigint, user_agent_id bigint, utms_id bigint, charges bigint, refunds bigint, charged decimal(20,2), refunded decimal(20,2), "
          "first_payment timestamp, last_payment timestamp")
PLACES = "subscription_id bigint, user_segment string, tenure bigint, churned bigint, started timestamp"
CELL = ["user_segment", "tenure", "churned", "started"]


class LifeCells:
    """Signed counts of subscriptions by segment, tenure, churn and start, one set for each feed.

    Beside them are the totals of every subscription's visits, to which a feed's payments are added, and the cells where each subscription
    stands. For the subscriptions that a feed touches, what they stood for is taken back (-1) and what they stand for now is added.

    A feed has a number; feeds come in ascending order. Totals and places of the touched partitions are stored aside first, then the signed counts, and
    then the former take their place. If a run breaks off, the same call again completes it: with the signed counts stored, what is aside is applied
    and nothing is counted twice. Compacting adds up the sets.
    """

    def __init__(self, spark: SparkSession, folder: str, *, parts: int = 16):
        folder = folder.rstrip("/")
        self.spark, self.folder, self.parts = spark, folder, parts
        self.visits = PartitionedState(spark, f"{folder}/visits", VISITS, "subscription_id", parts=parts)
        self.places = PartitionedState(spark, f"{folder}/places", PLACES, "subscription_id", parts=parts)

    def _counts(self, feed: int) -> str:
        return f"{self.folder}/counts/feed={feed}"

    def _aside(self, feed: int, name: str) -> str:
        return f"{self.folder}/aside/{feed}/{name}"

    def fold(self, feed: int, payments: DataFrame, t: Tables, p: Params, *, changed: DataFrame | None = None) -> None:
        """Add a feed's transactions. ``changed`` names subscriptions (``subscription_id``) whose status, plan or owner is another one now."""
        if not exists(self.spark, f"{self._counts(feed)}/_SUCCESS"):
            self._prepare(feed, payments, t, p, changed)
        if exists(self.spark, self._aside(feed, "visits")):
            self.visits.apply(self._aside(feed, "visits"))
            self.places.apply(self._aside(feed, "places"))
        remove(self.spark, f"{self.folder}/aside/{feed}")

    def _prepare(self, feed: int, payments: DataFrame, t: Tables, p: Params, changed: DataFrame | None) -> None:
        # Stored, as four passes follow over what may be costly to build.
        totals = facts.visit_totals(gates.successful(payments))
        totals.write.mode("overwrite").parquet(self._aside(feed, "new"))
        new = self.spark.read.schema(totals.schema).parquet(self._aside(feed, "new"))
        keys = new.select("subscription_id")
        keys = (keys if changed is None else keys.unionByName(changed.select(F.col("subscription_id").cast("bigint")))).distinct()
        parts = self.visits.touched(keys)
        if parts:
            self.visits.staged(facts.merged_visits(self.visits.of_parts(parts).unionByName(new)), parts, self._aside(feed, "visits"))
            now = self.visits.staged_rows(self._aside(feed, "visits"))
            stood = self.places.of_parts(parts)
            there = stood.join(keys, "subscription_id", "left_anti").unionByName(self._places(now.join(keys, "subscription_id", "left_semi"), t, p))
            self.places.staged(there, parts, self._aside(feed, "places"))
            stand = self.places.staged_rows(self._aside(feed, "places"))
        else:
            stood = stand = self.spark.createDataFrame([], PLACES)
        signed = stood.withColumn("sign", F.lit(-1)).unionByName(stand.withColumn("sign", F.lit(1))).groupBy(*CELL).agg(
            F.sum("sign").alias(retention.WEIGHT)).where(F.col(retention.WEIGHT) != 0)
        signed.write.mode("overwrite").parquet(self._counts(feed))

    def _places(self, visits: DataFrame, t: Tables, p: Params) -> DataFrame:
        rows = retention.model_rows(facts.segments_of(visits, t, p), p, tenure_offset=1, markets=False, annual=True)
        return rows.select("subscription_id", "user_segment", "tenure", "churned", F.col("initial_payment_date").cast("timestamp").alias("started"))

    def cells(self, p: Params) -> DataFrame:
        """Cells as ``retention.fold`` makes them, ages as of ``p.as_of``; life tables and survival read them."""
        if not exists(self.spark, f"{self.folder}/counts"):
            sets = self.spark.createDataFrame([], f"user_segment string, tenure bigint, churned bigint, started timestamp, {retention.WEIGHT} bigint")
        else:
            sets = self.spark.read.parquet(f"{self.folder}/counts").drop("feed")
        whole = sets.groupBy(*CELL).agg(F.sum(retention.WEIGHT).alias(retention.WEIGHT)).where(F.col(retention.WEIGHT) != 0)
        return whole.withColumn("age", whole_months_between(p.as_of, F.col("started")))

    def compact(self, upto: int) -> None:
        """Add up the sets of feeds up to ``upto`` as one, the set of ``upto``. What a run that broke off has left is completed first."""
        for number in [n for n in self._numbers("compacted", "upto") if n != upto] + [upto]:
            aside = f"{self.folder}/compacted/upto={number}"
            if not exists(self.spark, f"{aside}/_SUCCESS"):
                if number != upto:
                    remove(self.spark, aside)
                    continue
                sets = self.spark.read.parquet(f"{self.folder}/counts").where(F.col("feed") <= upto)
                sets.groupBy(*CELL).agg(F.sum(retention.WEIGHT).alias(retention.WEIGHT)).where(F.col(retention.WEIGHT) != 0).write.mode(
                    "overwrite").parquet(aside)
            for feed in self._numbers("counts", "feed"):
                if feed < number:
                    remove(self.spark, self._counts(feed))
            self.spark.read.parquet(aside).write.mode("overwrite").parquet(self._counts(number))
            remove(self.spark, aside)

    def _numbers(self, name: str, column: str) -> list[int]:
        """Numbers of the folders ``column=number``."""
        return sorted(int(x.removeprefix(f"{column}=")) for x in listed(self.spark, f"{self.folder}/{name}") if x.startswith(f"{column}="))
