"""Where logical tables come from: catalog names, parquet folders, CSV files."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kohorte.sources.schemas import SCHEMAS, schema_of


class Tables(Mapping[str, DataFrame]):
    """Logical tables, each resolved when an operator first asks for it.

    ``inputs`` (``stored.NamedInputs``), if given, is where model inputs that are derived from the tables are kept for other reports.
    """

    def __init__(self, makers: Mapping[str, Callable[[], DataFrame]], inputs=None):
        self.inputs = inputs
        self._makers = dict(makers)
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


def from_catalog(spark: SparkSession, names: Mapping[str, str]) -> Tables:
    """Logical name -> one-, two- or three-part catalog name (or temporary view)."""
    return Tables({logical: (lambda n=name: spark.table(n)) for logical, name in names.items()})


def from_parquet(spark: SparkSession, folder: str, names: list[str] | None = None) -> Tables:
    wanted = names or list(SCHEMAS)
    return Tables({n: (lambda n=n: spark.read.parquet(f"{folder}/{n}")) for n in wanted})


def read_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    """CSV export with a header line, read with the declared schema: no inference pass.

    Columns are matched by header name, so a file may leave out or reorder them.
    """
    header = spark.read.option("header", True).csv(path).columns
    declared = {f.name: f for f in schema_of(table).fields}
    ddl = ", ".join(f"`{c}` {declared[c].dataType.simpleString() if c in declared else 'string'}" for c in header)
    return spark.read.schema(ddl).option("header", True).option("enforceSchema", False).csv(path)


CORRUPT = "__corrupt"


def read_csv_checked(spark: SparkSession, path: str, table: str, quarantine: str) -> DataFrame:
    """As :func:`read_csv`, for files that may hold malformed rows: good rows are returned, bad ones are kept in a table of their own.

    A row is bad if it has more or fewer fields than the header, or a value that the column's type can't hold; an empty value is NULL and
    good. ``quarantine`` gets a Parquet table (file, line, reason): the row as it is, its file, and what is wrong with the first value that is. It
    is written by this call, and is empty where all rows are good. Both come from one parse, which is stored beside the quarantine, so that they can't differ.
    """
    header = spark.read.option("header", True).csv(path).columns
    declared = {f.name: f for f in schema_of(table).fields}
    kinds = {c: declared[c].dataType.simpleString() if c in declared else "string" for c in header}
    ddl = ", ".join(f"`{c}` {kind}" for c, kind in kinds.items())
    parsed = spark.read.schema(f"{ddl}, {CORRUPT} string").option("header", True).option("enforceSchema", False).option(
        "mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).csv(path)
    parsed = parsed.withColumn("__file", F.col("_metadata.file_path"))
    stored = f"{quarantine.rstrip('/')}-parsed-{uuid4().hex}"
    parsed.write.parquet(stored)
    rows = spark.read.schema(f"{ddl}, {CORRUPT} string, __file string").parquet(stored)
    bad = rows.where(F.col(CORRUPT).isNotNull())
    texts = F.from_csv(CORRUPT, ", ".join([*[f"`{c}` string" for c in header], "`__more` string"]), {"mode": "PERMISSIVE"})
    split = bad.withColumn("text", texts).withColumn("fields", F.size(F.split(CORRUPT, ",", -1)))
    wrong = [F.when(F.col(f"text.`{c}`").isNotNull() & F.expr(f"try_cast(text.`{c}` as {kind})").isNull(),
                    F.concat(F.lit(f"{c}: "), F.col(f"text.`{c}`"), F.lit(f" is no {kind}"))) for c, kind in kinds.items() if kind != "string"]
    count = F.concat(F.col("fields").cast("string"), F.lit(f" fields of {len(header)}"))
    reason = F.coalesce(F.when((F.col("fields") != len(header)) & ~F.contains(F.col(CORRUPT), F.lit('"')), count), *wrong, F.lit("malformed"))
    split.select(F.col("__file").alias("file"), F.col(CORRUPT).alias("line"), reason.alias("reason")).write.mode("overwrite").parquet(quarantine)
    return rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT, "__file")
