"""Token counts of flat token files by a scan for the end-of-document id.

The files are bare sequences of fixed-width ids without an index. They are read as blocks of bounded size whose borders
fall anywhere between ids. A task searches its blocks for the end id with one vectorised comparison and gives out, for
each block, the number of ids and where the end ids are. A prefix scan over the blocks of a file then tells each block
how many ids and documents come before it and where the last document before it ended; so a document that spans
blocks, or a block without an end id, gets its length without any block being read twice.

Ids after the last end id of a file are a document without an end (``ended`` false). Empty files have no documents, two
end ids in a row enclose an empty one. Only block numbers, never ids, meet in the scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kohorte.llm import bpe

BLOCK_BYTES = 1 << 20
FILE_BYTES = 8 << 20
# Ids are big-endian: so an end id can be given to a text writer, as the UTF-8 bytes of a character.
KINDS = {2: ">u2", 4: ">u4"}
SCANNED = "file string, block int, n_ids long, ends array<int>"
FILES = "file string, doc_ids array<long>, payload binary"


def _filled(end_id: int, width: int, file_bytes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Flat files from batches of (key, packed ids)."""
    kind = pa.schema([("file", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("payload", pa.binary())])
    part, number, end = TaskContext.get().partitionId(), 0, int(end_id).to_bytes(width, "big")
    keys: list[int] = []
    held: list[bytes] = []
    size = 0

    def file() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"file": [f"{part:05d}-{number:05d}"], "doc_ids": [keys], "payload": [b"".join(held)]}, schema=kind)

    for batch in batches:
        for key, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
            wide = np.frombuffer(ids.as_py() or b"", "<u4")
            if len(wide) and (wide.max() >= 1 << 8 * width or (wide == end_id).any()):
                raise ValueError(f"document {key} has an id that a flat file can't hold")
            keys.append(key)
            held.append(wide.astype(KINDS[width]).tobytes() + end)
            size += len(held[-1])
            if size >= file_bytes:
                yield file()
                keys, held, size, number = [], [], 0, number + 1
    if keys:
        yield file()


def flat_files(encoded: DataFrame, *, end_id: int, width: int = 2, id_column: str = "doc_id", file_bytes: int = FILE_BYTES) -> DataFrame:
    """(file, doc_ids, payload): contents of flat files of about ``file_bytes``, and the order of the documents in each.

    ``encoded`` has packed little-endian 32-bit ``ids``. An id that is the end id, or wider than the file's, is an error.
    """
    rows = encoded.select(F.col(id_column).cast("long").alias("key"), "ids")
    return rows.mapInArrow(partial(_filled, end_id, width, file_bytes), FILES)


def tokenized_files(docs: DataFrame, vocabulary: str, *, end_id: int, width: int = 2, id_column: str = "doc_id",
                    text_column: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """``flat_files`` of the BPE ids of texts, in one Python worker a task."""
    rows = docs.select(F.col(id_column).cast("long").alias("key"), F.col(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _filled(end_id, width, file_bytes, bpe.encoded_batches(vocabulary, batches))

    return rows.mapInArrow(run, FILES)


def write_flat(encoded: DataFrame, path: str, *, end_id: int, width: int = 2) -> None:
    """Write packed ids as flat files in any file system that Spark reaches, a file a partition.

    The text writer is used for its raw bytes; its line separator is the end id, which has to be UTF-8.
    """
    separator = int(end_id).to_bytes(width, "big").decode("utf-8")
    kind = KINDS[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.frombuffer(x or b"", "<u4").astype(kind).tobytes() for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], names=["value"])

    rows = encoded.select("ids").mapInArrow(run, "value binary")
    # Bytes pass through a cast to string unchanged; nothing reads them as characters.
    rows.select(F.col("value").cast("string")).write.option("lineSep", separator).text(path)


def _cut(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks from batches of (file, content)."""
    kind = pa.schema([("file", pa.string()), ("block", pa.int32()), ("payload", pa.binary())])
    for batch in batches:
        for row in range(len(batch)):
            data = batch.column(1)[row].as_buffer()
            for number, at in enumerate(range(0, data.size, size)):
                part = data.slice(at, min(size, data.size - at)).to_pybytes()
                yield pa.RecordBatch.from_pydict({"file": [batch.column(0)[row].as_py()], "block": [number], "payload": [part]}, schema=kind)


def _found(end_id: int, width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where the end ids are, from batches of (file, block, payload)."""
    for batch in batches:
        sizes, ends = [], []
        for row in range(len(batch)):
            ids = np.frombuffer(batch.column(2)[row].as_buffer(), KINDS[width])
            sizes.append(len(ids))
            ends.append(np.flatnonzero(ids == end_id).astype(np.int32))
        at = np.cumsum([0] + [len(e) for e in ends])
        flat = np.concatenate(ends) if ends else np.zeros(0, np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))],
            names=["file", "block", "n_ids", "ends"])


def read_blocks(spark: SparkSession, path: str, *, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, block, payload) of all files under ``path``."""
    content = spark.read.format("binaryFile").load(path).select("path", "content")
    return content.mapInArrow(partial(_cut, block_bytes // width * width), "file string, block int, payload binary")


def scan(blocks: DataFrame, end_id: int, *, width: int = 2) -> DataFrame:
    """(file, block, n_ids, ends): where in each block the end id is."""
    return blocks.select("file", "block", "payload").mapInArrow(partial(_found, end_id, width), SCANNED)


def scan_files(files: DataFrame, end_id: int, *, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``scan`` of ``flat_files``, cut into blocks in the same worker."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _found(end_id, width, _cut(block_bytes // width * width, batches))

    return files.select("file", "payload").mapInArrow(run, SCANNED)


def documents(scanned: DataFrame) -> DataFrame:
    """(file, nth, start, n_tokens, ended) of each document: its number in the file, the ids before it, and its ids
    without the end id."""
    by_file = Window.partitionBy("file").orderBy("block")      # a few numbers a block
    before = by_file.rowsBetween(Window.unboundedPreceding, -1)
    numbers = scanned.select("file", "block", "n_ids", F.size("ends").alias("n_ends"), F.get("ends", F.size("ends") - 1).alias("last")) \
        .withColumn("begin", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    placed = numbers.select(
        "file", "block", "begin", "n_ids", F.coalesce(F.sum("n_ends").over(before), F.lit(0)).alias("docs_before"),
        F.coalesce(F.last(F.col("begin") + F.col("last") + 1, ignorenulls=True).over(before), F.lit(0)).alias("open_at"),
        (F.col("begin") + F.col("last") + 1).alias("closed_at"), F.row_number().over(Window.partitionBy("file").orderBy(F.desc("block"))).alias("from_end"))
    both = scanned.select("file", "block", "ends").join(placed, ["file", "block"])
    pairs = F.arrays_zip(F.concat(F.array(F.lit(None).cast("int")), "ends").alias("before"), F.col("ends").alias("end"))
    ended = both.select("file", "docs_before", "open_at", "begin", F.posexplode(pairs).alias("i", "pair")).where("pair.end is not null").select(
        "file", (F.col("docs_before") + F.col("i")).alias("nth"),
        F.coalesce(F.col("begin") + F.col("pair.before") + 1, F.col("open_at")).alias("start"),
        (F.col("begin") + F.col("pair.end")).alias("stop"), F.lit(True).alias("ended"))
    tail = both.where("from_end = 1").select(
        "file", (F.col("docs_before") + F.size("ends")).alias("nth"), F.coalesce("closed_at", "open_at").alias("start"),
        (F.col("begin") + F.col("n_ids")).alias("stop"), F.lit(False).alias("ended")).where("stop > start")
    return ended.unionByName(tail).select("file", F.col("nth").cast("long").alias("nth"), "start", (F.col("stop") - F.col("start")).alias("n_tokens"), "ended")


def named(files: DataFrame, found: DataFrame, *, id_column: str = "doc_id") -> DataFrame:
    """``id_column``, file, start and n_tokens of every document of ``flat_files``, from their ``documents``."""
    listed = files.select("file", F.posexplode("doc_ids").alias("nth", id_column))
    return listed.join(found, ["file", "nth"]).select(id_column, "file", "start", "n_tokens")
