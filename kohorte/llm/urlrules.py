"""Allow and block rules for urls by a sort-merge range join.

A host is written with its labels reversed, so that a rule's host and all its subdomains are one interval of
keys. Urls are dealt into key ranges and sorted; each range also gets the rules whose intervals meet it. One
sweep over a range keeps a stack of the rules whose intervals are open (they nest), and the longest of them whose
path begins the url's path decides.

Null urls, and urls without ``://``, have an empty host and path and get the default verdict, as every url that
no rule fits. Repeated rows are judged each. Of rules of equal length the one with the longer host wins, then
block before allow.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kohorte.llm.scratch import Scratch, partitions

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
SWEPT = "id long, host string, path string, rule string, verdict string"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def reversed_key(host: Column) -> Column:
    """``a.example.net`` -> net, example, a joined by a character below all others of a key."""
    plain = F.translate(host, "\x00\x01\x02", "\x03\x04\x05")
    return F.array_join(F.reverse(F.split(plain, "[.]", -1)), "\x01")


def _fits(host: str, path: str, rule: dict) -> bool:
    return path.startswith(rule["path"]) and (host == rule["host"] or host.endswith("." + rule["host"]))


def _sweep(default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, list[dict]]] = []    # open intervals, the innermost last
        range_now = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["bucket"] != range_now:
                    stack, range_now = [], row["bucket"]
                key = row["key"]
                while stack and not (key == stack[-1][0] or key.startswith(stack[-1][0] + "\x01")):
                    stack.pop()
                if row["verdict"] is not None:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, []))
                    stack[-1][1].append(row)
                    continue
                host, path, best = row["host"], row["path"], None
                for _, rules in reversed(stack):
                    for rule in rules:
                        if _fits(host, path, rule):
                            rank = (len(rule["host"]) + len(rule["path"]), len(rule["host"]), rule["verdict"] == "block")
                            if best is None or rank > best[0]:
                                best = (rank, rule)
                out.append((row["id"], host, path, best and best[1]["host"] + best[1]["path"],
                            best[1]["verdict"] if best else default))
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64())] + [pa.array(c, pa.string()) for c in columns[1:]],
                names=["id", "host", "path", "rule", "verdict"])
    return run


def judge(pages: DataFrame, rules: DataFrame, *, id_column: str = "page_id", url_column: str = "url",
          default: str = "allow") -> DataFrame:
    """``id_column``, host, path, rule and verdict of every row of ``pages``.

    ``rules`` has host, path (beginning with ``/``) and verdict (allow or block). Other columns are left behind.
    """
    spark = pages.sparkSession
    scratch, n = Scratch(spark, "urlrules"), partitions(spark)
    urls = pages.select(F.col(id_column).cast("long").alias("id"), host_of(F.col(url_column)).alias("host"),
                        path_of(F.col(url_column)).alias("path"))
    # The path and id split a host that has many urls over several ranges.
    ranged = scratch.keep(urls.withColumn("key", reversed_key(F.col("host")))
                          .repartitionByRange(n, "key", "path", "id").withColumn("bucket", F.spark_partition_id()), "ranged")
    bounds = ranged.groupBy("bucket").agg(F.min("key").alias("low"), F.max("key").alias("high")).collect()  # one row a range
    ranges = F.array(*[F.struct(F.lit(b["bucket"]).alias("bucket"), F.lit(b["low"]).alias("low"), F.lit(b["high"]).alias("high"))
                       for b in bounds]) if bounds else None
    listed = rules.select(F.lit(None).cast("long").alias("id"), F.translate("host", UPPER, LOWER).alias("host"), "path",
                          F.col("verdict")).withColumn("key", reversed_key(F.col("host")))
    met = listed.where(F.lit(False)).withColumn("bucket", F.lit(0)) if ranges is None else listed.withColumn(
        "bucket", F.explode(F.transform(
            F.filter(ranges, lambda r: (r["high"] >= F.col("key")) & (r["low"] < F.concat(F.col("key"), F.lit("\x02")))),
            lambda r: r["bucket"])))
    columns = ["bucket", "key", "id", "host", "path", "verdict"]
    both = ranged.withColumn("verdict", F.lit(None).cast("string")).select(columns).unionByName(met.select(columns))
    dealt = both.repartition(n, "bucket").sortWithinPartitions("bucket", "key", F.col("verdict").isNull())
    return dealt.mapInArrow(_sweep(default), SWEPT).withColumnRenamed("id", id_column)
