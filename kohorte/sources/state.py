"""State that a feed is folded into day by day: Parquet tables of which only the touched partitions are rewritten."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PART = "part"


def _place(spark: SparkSession, path: str):
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(context._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    files, target = _place(spark, path)
    return files.exists(target)


def remove(spark: SparkSession, path: str) -> None:
    files, target = _place(spark, path)
    files.delete(target, True)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    files, target = _place(spark, path)
    return [f.getPath().getName() for f in files.listStatus(target)] if files.exists(target) else []


class PartitionedState:
    """Rows by key, dealt by a hash of the key into ``parts`` partitions.

    :meth:`staged` computes what the partitions that a feed touches will hold and stores that aside; :meth:`apply` puts it in
    their place, and may be repeated: a run that breaks off between the two is mended by applying again.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, *, parts: int = 16):
        self.spark, self.path, self.schema, self.key, self.parts = spark, path.rstrip("/"), schema, key, parts

    def part_of(self, key: str | None = None) -> Column:
        return F.pmod(F.xxhash64(key or self.key), F.lit(self.parts)).cast("int")

    def read(self) -> DataFrame:
        return self._stored().drop(PART)

    def _stored(self) -> DataFrame:
        schema = f"{self.schema}, {PART} int"
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path).where(F.col(self.key).isNotNull())

    def touched(self, keys: DataFrame) -> list[int]:
        """Partitions of some keys: at most ``parts`` numbers."""
        return sorted(r[0] for r in keys.select(self.part_of()).distinct().collect())

    def of_parts(self, parts: Sequence[int]) -> DataFrame:
        """The stored rows of some partitions; other files are not read."""
        return self._stored().where(F.col(PART).isin(list(parts))).drop(PART)

    def staged(self, rows: DataFrame, parts: Sequence[int], staging: str) -> None:
        """Store the future content of ``parts``. A row without a key marks each of them, so that one that has become empty is replaced, too."""
        fields = StructType.fromDDL(self.schema).fields
        own = rows.select(*[F.col(f.name).cast(f.dataType) for f in fields]).withColumn(PART, self.part_of()).where(F.col(PART).isin(list(parts)))
        marks = self.spark.createDataFrame([(part,) for part in parts], f"{PART} int")
        own.unionByName(marks, allowMissingColumns=True).repartition(len(parts) or 1, PART).write.mode("overwrite").partitionBy(PART).parquet(staging)

    def staged_rows(self, staging: str) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, {PART} int").parquet(staging).where(F.col(self.key).isNotNull()).drop(PART)

    def apply(self, staging: str) -> None:
        rows = self.spark.read.schema(f"{self.schema}, {PART} int").parquet(staging)
        # As staged, every partition is a file or a few, so nothing is dealt out again.
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(self.path)

    def merge(self, feed: DataFrame, combine: Callable[[DataFrame], DataFrame]) -> None:
        """Fold ``feed`` into the rows of its partitions, where folding the same feed again changes nothing."""
        parts = self.touched(feed)
        if not parts:
            return
        staging = f"{self.path}-staging"
        columns = self.read().columns
        self.staged(combine(self.of_parts(parts).unionByName(feed.select(*columns))), parts, staging)
        self.apply(staging)
        remove(self.spark, staging)
