"""Tables that are written once and read by several reports: bucketed and sorted by the key they are joined on."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from kohorte.session import shared_folder
from kohorte.sources.state import exists, remove


def store_bucketed(df: DataFrame, key: str, label: str, *, buckets: int | None = None) -> DataFrame:
    """``df`` as a table of ``buckets`` files (as many as shuffle partitions, if not given), each sorted by ``key``.

    Frames that read it group and join by ``key`` without an exchange. Its files are in the shared folder, under a name of
    their own; the caller drops the table when no report reads it any more.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"{label}_{uuid4().hex}"
    df.repartition(n, key).write.format("parquet").bucketBy(n, key).sortBy(key).option(
        "path", f"{shared_folder(spark).rstrip('/')}/{name}").saveAsTable(name)
    return spark.table(name)


class NamedInputs:
    """Derived tables under names in one folder, for all reports of one state of the data: written when the first report asks for
    them, read by every later one, in this session or another.

    A name stands for the table and for all that its content depends on (``key``, such as the parameters). New data want a new folder, or
    :meth:`forget`. Two sessions that ask for the same name at once may both write it; the content is the same.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str, key: object) -> str:
        return f"{self.folder}/{name}-{hashlib.sha256(repr(key).encode()).hexdigest()[:16]}"

    def get(self, name: str, key: object, build: Callable[[], DataFrame]) -> DataFrame:
        path = self.path(name, key)
        if not exists(self.spark, f"{path}/_SUCCESS"):      # set last by the writer
            build().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def forget(self, name: str, key: object) -> None:
        remove(self.spark, self.path(name, key))
