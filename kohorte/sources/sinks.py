"""Where results go. Reports are written by the executors; showing them is the caller's business."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kohorte.sources.state import exists, listed, remove


def write_report(df: DataFrame, path: str, *, partition_by: Sequence[str] = (), order_by: Sequence[str] = (),
                 mode: str = "overwrite") -> None:
    """Write a report; ``order_by`` sorts it here (``-name``: descending), where its readers need an order."""
    if order_by:
        df = df.orderBy(*[F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order_by])
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_days(df: DataFrame, path: str, *, day: str = "date") -> None:
    """Rows by day; the days that ``df`` has replace those of the same date, other days stay."""
    df.repartition(day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


VERSION = "version="


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions of a dimension: those with the marker that the writer sets last."""
    return sorted(int(name.removeprefix(VERSION)) for name in listed(spark, path)
                  if name.startswith(VERSION) and exists(spark, f"{path}/{name}/_SUCCESS"))


def write_dimension(df: DataFrame, path: str, keys: Sequence[str], valid_from: date, *, kept: int = 2) -> None:
    """A small result (the lifetime projection) as a dimension with its history.

    Rows that differ from what holds now are valid from ``valid_from`` on, and what they replace until the day before; a key that ``df`` doesn't
    have any more ends there, too. Writing the same day again replaces what that day wrote. Readers see the version before or the
    new one, never a part: a version counts once its last file is there. ``kept`` versions stay for readers that have begun.
    """
    spark, since = df.sparkSession, F.lit(valid_from)
    versions = _versions(spark, path)
    values = [c for c in df.columns if c not in keys]
    new = df.withColumns({"valid_from": since, "valid_to": F.lit(None).cast("date")})
    if versions:
        old = spark.read.parquet(f"{path}/{VERSION}{versions[-1]}")
        # As it was before this day: rows of the day are out, rows that the day ended are open.
        old = old.where(F.col("valid_from") < since).withColumn(
            "valid_to", F.when(F.col("valid_to") < F.date_sub(since, 1), F.col("valid_to")))
        now = old.where(F.col("valid_to").isNull())
        names = [F.col(c) for c in (*keys, *values)]
        same = functools.reduce(Column.__and__, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*keys, *values)])
        unchanged = now.select(*names, "valid_from").alias("a").join(df.select(*names).alias("b"), same, "left_semi")
        fresh = new.alias("a").join(now.select(*names).alias("b"), same, "left_anti")
        ended = now.select(*names, "valid_from").alias("a").join(df.select(*names).alias("b"), same, "left_anti").withColumn(
            "valid_to", F.date_sub(since, 1))
        new = old.where(F.col("valid_to").isNotNull()).unionByName(unchanged.withColumn("valid_to", F.lit(None).cast("date"))).unionByName(
            ended).unionByName(fresh)
    number = max([int(n.removeprefix(VERSION)) for n in listed(spark, path) if n.startswith(VERSION)], default=0) + 1
    new.coalesce(1).write.parquet(f"{path}/{VERSION}{number}")
    for stale in versions[:max(0, len(versions) + 1 - kept)]:
        remove(spark, f"{path}/{VERSION}{stale}")


def read_dimension(spark: SparkSession, path: str, on: date | None = None) -> DataFrame:
    """The newest version: the rows that are valid on a day or, without one, all with ``valid_from`` and ``valid_to``."""
    versions = _versions(spark, path)
    if not versions:
        raise ValueError(f"no dimension at {path}")
    rows = spark.read.parquet(f"{path}/{VERSION}{versions[-1]}")
    if on is None:
        return rows
    holds = (F.col("valid_from") <= F.lit(on)) & (F.col("valid_to").isNull() | (F.col("valid_to") >= F.lit(on)))
    return rows.where(holds).drop("valid_from", "valid_to")


def write_csv(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)
