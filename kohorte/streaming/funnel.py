"""The daily funnel from a stream of product events.

An event counts the first time that its user is seen on a day, in a country, at a step. The state store holds what was seen; a day's
state goes when the watermark has passed its end, and events of that day are too late from then on. Events that are late by less than the
watermark's delay count. The sink writes each micro-batch's new users as a folder of its own, which a repeated batch replaces, so
a restarted query counts nothing twice; the funnel is the sum of the folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kohorte.operators.funnel import STEPS, located_events
from kohorte.params import Params
from kohorte.sources.catalog import Tables
from kohorte.sources.state import listed

NO_STEP = ""
BATCH = "date date, ip_country string, step string, users bigint"


def first_sights(t: Tables, p: Params, *, delay: str = "2 days") -> DataFrame:
    """(day, ip_country, step, amplitude_id) of a streaming table ``events``, each once; ``day`` is a window.

    A day and country with events of other kinds only has a row with the step ``NO_STEP``, as the batch funnel has.
    """
    timed = t["events"].withColumn("event_time", F.col("event_time").cast("timestamp")).withWatermark("event_time", delay)
    events = located_events(Tables({"events": lambda: timed, "countries": lambda: t["countries"]}), p, p.funnel_projects)
    step = F.lit(None).cast("string")
    for name, event in STEPS.items():
        step = F.when((F.col("event_type") == event) & F.col("amplitude_id").isNotNull(), name).otherwise(step)
    seen = events.select(
        F.window("event_time", "1 day").alias("day"), F.coalesce("iso", "country").alias("ip_country"), "amplitude_id",
        F.explode(F.array_compact(F.array(F.lit(NO_STEP), step))).alias("step"))
    return seen.withColumn("amplitude_id", F.when(F.col("step") != NO_STEP, F.col("amplitude_id"))).dropDuplicates(
        ["day", "ip_country", "step", "amplitude_id"])


def write_funnel(sights: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start the query; ``trigger`` as of ``DataStreamWriter.trigger``, by default all that is there now."""
    def sink(batch: DataFrame, number: int) -> None:
        batch.groupBy(F.col("day.start").cast("date").alias("date"), "ip_country", "step").agg(
            F.count("amplitude_id").alias("users")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return sights.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def read_funnel(spark: SparkSession, path: str) -> DataFrame:
    """(date, ip_country) -> distinct users per step, as ``funnel.funnel_daily``, of what has arrived so far."""
    whole = [name for name in listed(spark, path) if name.startswith("batch=") and "_SUCCESS" in listed(spark, f"{path}/{name}")]
    rows = spark.read.schema(BATCH).parquet(*[f"{path}/{name}" for name in whole]) if whole else spark.createDataFrame([], BATCH)
    return rows.groupBy("date", "ip_country").agg(
        *[F.coalesce(F.sum(F.when(F.col("step") == name, F.col("users"))), F.lit(0)).alias(name) for name in STEPS])
