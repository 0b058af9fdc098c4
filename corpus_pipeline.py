"""A corpus from raw documents to token ids, one operator a stage.

Every stage is judged by what it takes from its predecessor: documents that the classifier rejects go; line runs that
occur earlier are cut, and a document that has no word left after that goes; of each group of near copies the one with the
smallest id stays; documents with a benchmark passage go; the rest is encoded and decoded. All but the last stage
return the columns of documents, with ``n_chars`` of the text as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kohorte.llm import decontaminate, ebayes, lines, partenum, queries
from kohorte.llm.scratch import Scratch

BATCH_ROWS = 2_000      # of whole texts sent to a Python worker at a time; executors hold several batches for each core


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to ``BATCH_ROWS``; what runs after it in the session has them too."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(name))
    if rows <= 0 or rows > BATCH_ROWS:      # 0 and less: no limit
        spark.conf.set(name, str(BATCH_ROWS))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return ebayes.judged(docs, labels).where("kept").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    cut = lines.dedup_lines(docs, length_column="n_chars")
    emptied = (F.col("n_removed") > 0) & (F.length(F.translate("text", " \t\n\x0b\f\r", "")) == 0)
    return cut.where(~emptied).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return partenum.first_of_class(docs).select(docs.columns)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return queries.coded(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_free),
    ("BPE encoding and decoding", token_ids),
]

# Trained models, suffix arrays, set joins and BPE can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
