"""Intermediate tables in the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kohorte.session import shared_folder


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Scratch:
    """Parquet tables under one folder: they cut lineage and outlive the executors that wrote them."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no frame still to be run reads; without a name all of them."""
        context = self.spark.sparkContext
        for path in [self.path(n) for n in names] or [self.folder]:
            target = context._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


ROW = "__row"


def free(name: str, taken: list[str]) -> str:
    """``name``, or a longer one that none of the columns has."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def keyed(docs: DataFrame, scratch: Scratch, id_column: str, text_column: str) -> tuple[DataFrame, str]:
    """``docs`` and the name of its column of unique numbers that ascend with the id, nulls last.

    Ids without nulls and repeats are such numbers. Else the rows are sorted, of equal ids by text hash, and stored once with
    their numbers in a column ``ROW`` (or a longer name, if ``docs`` has one of that name).
    """
    own = F.col(id_column).cast("long")
    if docs.select(own.alias("own")).groupBy("own").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or own is null").isEmpty():
        return docs, id_column
    # The place in the input deals out a large group of equal rows.
    row = free(ROW, docs.columns)
    names = [free(f"{ROW}_{x}", docs.columns) for x in ("id", "text", "at")]
    order = [F.asc_nulls_last(names[0]), *names[1:]]
    added = dict(zip(names, (own, F.xxhash64(text_column), F.monotonically_increasing_id())))
    ranged = docs.withColumns(added).repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    return scratch.keep(ranged.withColumn(row, F.monotonically_increasing_id()).drop(*names), "keyed"), row
