"""What gates and joins do to the rows of a report: run-time counts, delivered beside it.

An :class:`Account` is handed to a report. At each step the report's rows are counted where they pass (``DataFrame.observe``), so the
numbers come with the run of the report and cost no run of their own (a stage that runs again after a lost executor may count its rows
again):

* rows: those that arrive;
* lost: those that the step drops, or that find no partner (a left join keeps them, without the partner's values);
* gained: those that a step adds by repeating a row for each further partner.

To know how often a row will be repeated, a join's right side is counted by key first; both joins share one partitioning.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

PARTNERS = "__partners"


class Plain:
    """The same steps, uncounted: what a report runs without an account."""

    def gate(self, df: DataFrame, keep: Column, step: str) -> DataFrame:
        return df.where(keep)

    def join(self, left: DataFrame, right: DataFrame, key: str, step: str, how: str = "left") -> DataFrame:
        return left.join(right, key, how)


PLAIN = Plain()


def _numbers(seen: Observation) -> tuple[int, ...]:
    try:
        found = seen.get
    except Py4JJavaError:       # no rows got here, and the optimizer left the step out
        found = {}
    return tuple(int(found.get(c) or 0) for c in ("rows", "lost", "gained"))


class Account(Plain):
    """Counts of the steps of one report; :meth:`rows` after the report has run."""

    def __init__(self):
        self._steps: list[tuple[str, str, Observation]] = []

    def _watch(self, df: DataFrame, step: str, kind: str, lost: Column, gained: Column) -> DataFrame:
        seen = Observation()
        self._steps.append((step, kind, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(F.when(lost, 1).otherwise(0)).alias("lost"),
                          F.sum(F.coalesce(gained, F.lit(0)).cast("bigint")).alias("gained"))

    def gate(self, df: DataFrame, keep: Column, step: str) -> DataFrame:
        """``df.where(keep)``; rows for which the condition is NULL are lost."""
        return self._watch(df, step, "gate", ~F.coalesce(keep, F.lit(False)), F.lit(0)).where(keep)

    def join(self, left: DataFrame, right: DataFrame, key: str, step: str, how: str = "left") -> DataFrame:
        """``left.join(right, key, how)`` for inner, left and left_semi; a NULL key has no partner."""
        many = right.groupBy(key).agg(F.count(F.lit(1)).alias(PARTNERS))
        counted = left.join(many, key, "left")
        further = F.lit(0) if how == "left_semi" else F.greatest(F.col(PARTNERS) - 1, F.lit(0))
        counted = self._watch(counted, step, f"{how} join", F.col(PARTNERS).isNull(), further)
        if how == "left_semi":
            return counted.where(F.col(PARTNERS).isNotNull()).drop(PARTNERS).select(left.columns)
        return counted.drop(PARTNERS).join(right, key, how)

    def rows(self, spark: SparkSession) -> DataFrame:
        """(step number, step, kind, rows, lost, gained), once the report has run."""
        found = [(i, step, kind, *_numbers(seen)) for i, (step, kind, seen) in enumerate(self._steps, 1)]
        return spark.createDataFrame(found, "number int, step string, kind string, rows bigint, lost bigint, gained bigint")
