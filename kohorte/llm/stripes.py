"""Source divergence audit: in-mapper stripes of terms, merged by key, from which divergences are emitted.

Mapping. Each task folds its whole documents into stripes: (lang, term) to the number of documents that have the term
and to its occurrences in each source. Beyond ``HELD`` entries a task spills its stripes and begins anew.

Merging. Stripes are dealt out by (lang, term) and sorted; a task reads them one after the other and adds up neighbours of
the same key. A term has as many stripes as tasks have spilled it, whatever its occurrences. Terms in fewer than
``least_documents`` documents of their language go.

Emitting. The terms of a language are dealt into buckets of about ``BUCKET``, its sources into rows of ``ROWS``; each
(bucket, row of sources) turns its stripes into integer shares p and yields, for its sources against all others,
the sum of their differences, and for each of its sources the most raised terms. Sums and ranks follow in Spark.

Shares are p = 1 + floor(10^9 * (count + 5) / (N + 5 * V)), by long division in 64-bit integers: exact below 9 * 10^15
occurrences. Terms are compared by their bytes, not by hashes.

Null texts, languages and sources are read as empty strings. A text without terms still makes its (lang, source) occur. Repeated
rows count as often as they occur. A language without kept terms has pairs of value 0 and no terms. An empty table
gives no rows. Columns other than the three named are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from kohorte.llm.scratch import Scratch, partitions
from kohorte.llm.textops import flat, slices, text_batch

LEAST_DOCUMENTS, TOP = 30, 50
HELD = 1 << 18          # entries (lang, term, source) that a task holds
BUCKET, ROWS = 4096, 256

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_LETTER = np.zeros(256, bool)
_LETTER[0x61:0x7B] = True
_LETTER[0x80:] = True       # once lower-cased

_STRIPE = pa.schema([("lang", pa.string()), ("term", pa.string()), ("df", pa.int64()),
                     ("counts", pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())])))])
_STRIPE_DDL = "lang string, term string, df long, counts array<struct<source: string, n: long>>"
_KEY = ["lang", "term"]


def _encoded(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = column.fill_null("").dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of every term of the texts its text's row and its place in the list of distinct terms, and that list."""
    raw, at = flat(texts)
    raw = _LOWER[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[at] = True
    letter = _LETTER[raw]
    starts = np.flatnonzero(letter & (cut[:-1] | ~np.concatenate([[False], letter[:-1]])))
    place = np.concatenate([np.cumsum(letter) - letter, [letter.sum()]])
    offsets = np.append(place[starts], place[-1]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[letter])])
    coded = words.dictionary_encode()
    return (np.searchsorted(at, starts, side="right") - 1, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64),
            coded.dictionary.cast(pa.string()))


def _folded(batch: pa.RecordBatch, first: int, texts: pa.Array) -> pa.Table:
    """(lang, term, source, df, n) of some documents of the batch."""
    row, term, vocabulary = terms(texts)
    lang, langs = _encoded(batch.column(0).slice(first, len(texts)))
    source, sources = _encoded(batch.column(1).slice(first, len(texts)))
    group = lang * len(sources) + source
    seen, n = np.unique(row * max(len(vocabulary), 1) + term, return_counts=True)
    row, term = np.divmod(seen, max(len(vocabulary), 1))
    keys, place = np.unique(group[row] * max(len(vocabulary), 1) + term, return_inverse=True)
    of, term = np.divmod(keys, max(len(vocabulary), 1))
    return pa.table({
        "lang": langs.take(pa.array(of // max(len(sources), 1))), "term": vocabulary.take(pa.array(term)),
        "source": sources.take(pa.array(of % max(len(sources), 1))),
        "df": pa.array(np.bincount(place, minlength=len(keys)).astype(np.int64)),
        "n": pa.array(np.bincount(place, n, minlength=len(keys)).astype(np.int64))})


def _added(parts: list[pa.Table]) -> pa.Table:
    both = pa.concat_tables(parts)
    return both.group_by(["lang", "term", "source"], use_threads=False).aggregate([("df", "sum"), ("n", "sum")]).rename_columns(
        ["lang", "term", "source", "df", "n"])


def _striped(entries: pa.Table) -> pa.Table:
    """One row for each (lang, term) of added-up entries, in the order of their bytes."""
    entries = entries.take(pc.sort_indices(entries, sort_keys=[(c, "ascending") for c in ("lang", "term", "source")])).combine_chunks()
    lang, term = entries["lang"].combine_chunks(), entries["term"].combine_chunks()
    new = np.ones(len(entries), bool)
    if len(entries) > 1:
        new[1:] = pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1])).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(new)
    counts = pa.StructArray.from_arrays([entries["source"].combine_chunks(), entries["n"].combine_chunks()], names=["source", "n"])
    df = np.add.reduceat(entries["df"].to_numpy(), first) if len(first) else np.zeros(0, np.int64)
    return pa.Table.from_arrays([lang.take(pa.array(first)), term.take(pa.array(first)), pa.array(df, pa.int64()), pa.ListArray.from_arrays(
        pa.array(np.append(first, len(entries)).astype(np.int32)), counts)], schema=_STRIPE)


def _map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    for batch in batches:
        for first, texts in slices(text_batch(batch)):
            held.append(_folded(batch, first, texts))
            if sum(map(len, held)) > HELD:
                held = [_added(held)]
                if len(held[0]) > HELD // 2:
                    yield from _striped(held[0]).to_batches(8192)
                    held = []
    if held:
        yield from _striped(_added(held)).to_batches(8192)


def _entries(stripes: pa.Table) -> pa.Table:
    counts = stripes["counts"].combine_chunks()
    sizes = pc.list_value_length(counts).to_numpy(zero_copy_only=False).astype(np.int64)
    of, inner = pa.array(np.repeat(np.arange(len(stripes)), sizes)), counts.flatten()
    df = np.zeros(int(sizes.sum()), np.int64)      # a stripe's documents go with its first entry
    df[np.cumsum(sizes) - sizes] = stripes["df"].to_numpy()
    return pa.table({"lang": stripes["lang"].combine_chunks().take(of), "term": stripes["term"].combine_chunks().take(of),
                     "source": inner.field("source"), "df": pa.array(df), "n": inner.field("n")})


def _merge(least: int):
    """Sorted stripes of a task added up by key; the last key of a batch waits for the next batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, waiting = None, []

        def closed(table: pa.Table) -> Iterator[pa.RecordBatch]:
            yield from table.filter(pc.greater_equal(table["df"], least)).to_batches(8192)

        for batch in batches:
            if not batch.num_rows:
                continue
            entries = _entries(pa.Table.from_batches([batch]))
            merged = _striped(_added([*waiting, entries]))
            yield from closed(merged.slice(0, len(merged) - 1))
            waiting = [_entries(merged.slice(len(merged) - 1))]
        if waiting:
            yield from closed(_striped(_added(waiting)))
    return run


def stripes(docs: DataFrame, *, least_documents: int = LEAST_DOCUMENTS, lang: str = "lang", source: str = "source",
            text_column: str = "text") -> DataFrame:
    """(lang, term, df, counts by source) of every term in at least so many documents of its language."""
    read = docs.select(F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(source, F.lit("")).alias("source"),
                       F.coalesce(text_column, F.lit("")).alias("text"))
    spilled = read.mapInArrow(_map, _STRIPE_DDL)
    dealt = spilled.repartition(partitions(docs.sparkSession), *_KEY).sortWithinPartitions(*_KEY)
    return dealt.mapInArrow(_merge(least_documents), _STRIPE_DDL)


def share(counts: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(10^9 * (counts + 5) / (total + 5 * kept)), by long division."""
    rest, of = counts + 5, total + 5 * kept
    out = np.zeros(np.broadcast_shapes(np.shape(rest), np.shape(of)), np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // of
        rest = rest % of
    return out + 1


def _emit(top: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """Stripes of a bucket, and all sources of the language (those of this row of sources marked)."""
        names, totals = right["source"].to_pylist(), right["n"].to_numpy()
        mine = np.flatnonzero(right["mine"].to_numpy(zero_copy_only=False))
        lang, kept, whole = right["lang"][0].as_py(), right["v"][0].as_py(), right["n_lang"][0].as_py()
        entries = _entries(left)
        place = {name: i for i, name in enumerate(names)}
        coded, known = _encoded(entries["source"].combine_chunks())
        source = np.array([place[x] for x in known.to_pylist()], np.int64)[coded] if len(entries) else coded
        sizes = pc.list_value_length(left["counts"]).to_numpy().astype(np.int64)
        term, n = np.repeat(np.arange(len(left)), sizes), entries["n"].to_numpy()

        def dense(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.full(len(names), -1)
            at[columns] = np.arange(len(columns))
            here = at[source] >= 0
            counts = np.zeros((len(left), len(columns)), np.int64)
            counts[term[here], at[source[here]]] = n[here]
            return counts, share(counts, totals[columns][None, :], kept) if kept else counts

        own_counts, own = dense(mine)
        rows: list[tuple[str, str, str, str, int]] = []
        for lo in range(0, len(names), ROWS):
            others = np.arange(lo, min(lo + ROWS, len(names)))
            _, p = dense(others)
            for k, s in enumerate(mine):
                away = np.abs(p - own[:, k:k + 1]).sum(axis=0)
                rows += [(lang, names[s], "pair", names[t], int(away[t - lo])) for t in others if t != s]
        if len(left):
            words = left["term"].to_pylist()
            usual = np.zeros(len(left), np.int64)
            np.add.at(usual, term, n)
            usual = share(usual, np.int64(whole), kept)
            for k, s in enumerate(mine):
                raised = np.flatnonzero((own_counts[:, k] > 0) & (own[:, k] > usual))
                by = own[raised, k] - usual[raised]
                if len(by) > top:
                    near = by >= np.partition(by, len(by) - top)[len(by) - top]
                    raised, by = raised[near], by[near]
                best = sorted(zip((-by).tolist(), (words[i].encode() for i in raised)))[:top]
                rows += [(lang, names[s], "term", word.decode(), -value) for value, word in best]
        columns = list(zip(*rows)) if rows else [[], [], [], [], []]
        return pa.table([pa.array(c, pa.string()) for c in columns[:4]] + [pa.array(columns[4], pa.int64())],
                        names=["lang", "source", "part", "item", "value"])
    return run


def divergences(docs: DataFrame, *, least_documents: int = LEAST_DOCUMENTS, top: int = TOP, lang: str = "lang", source: str = "source",
                text_column: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): of each source its distance to every other source of the language (part pair) and
    the ``top`` terms that it raises most above the language's share (part term)."""
    scratch = Scratch(docs.sparkSession, "stripes")
    kept = scratch.keep(stripes(docs, least_documents=least_documents, lang=lang, source=source, text_column=text_column), "kept")
    counted = kept.select("lang", F.inline("counts")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    occurring = docs.select(F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(source, F.lit("")).alias("source")).distinct()
    groups = scratch.keep(occurring.join(counted, ["lang", "source"], "left").na.fill(0, ["n"]), "groups")
    langs = groups.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.count(F.lit(1)).alias("n_sources")).join(sizes, "lang", "left").na.fill(0, ["v"]) \
        .withColumns({"buckets": F.greatest(F.lit(1), F.ceil(F.col("v") / BUCKET)), "rows": F.ceil(F.col("n_sources") / ROWS)})
    langs = scratch.keep(langs, "langs")
    left = kept.join(langs.select("lang", "buckets", "rows"), "lang").select(
        "lang", F.pmod(F.xxhash64("term"), F.col("buckets")).alias("bucket"), F.explode(F.expr("sequence(0, rows - 1)")).alias("row"),
        "term", "counts", "df")
    right = groups.join(langs, "lang").withColumn("of", F.pmod(F.xxhash64("source"), F.col("rows"))).select(
        "lang", F.explode(F.expr("sequence(0, buckets - 1)")).alias("bucket"), "source", "n", "n_lang", "v", "of", "rows").select(
        "lang", "bucket", F.explode(F.expr("sequence(0, rows - 1)")).alias("row"), "source", "n", "n_lang", "v", "of").select(
        "lang", "bucket", "row", "source", "n", "n_lang", "v", (F.col("of") == F.col("row")).alias("mine"))
    key = ["lang", "bucket", "row"]
    emitted = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(
        _emit(top), "lang string, source string, part string, item string, value long")
    summed = emitted.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = summed.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))
