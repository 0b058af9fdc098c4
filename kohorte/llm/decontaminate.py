"""Benchmark decontamination with a generalised suffix automaton of the test items.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased, as 64-bit hashes. The automaton holds
all substrings of all items. Documents are streamed through it: it follows, word by word, the longest suffix read
so far that some item contains. Where that length reaches the window (10 words, or the whole of a shorter item)
the words of the window are hit. Only stretches in which every two neighbours are neighbours in some item are
streamed; elsewhere the length can't exceed one.

The items are cut into shares of at most ``SHARE_WORDS`` words (an item is never cut); each share has an automaton
of its own, which is what a task holds, and the driver holds one share at a time. With several shares a document's hits are
added up over all of them, by row, before anything is judged or cut. Null or empty texts have no words; rows with repeated or
null document ids are rows of their own; a null item id is read as an empty one; items of one id count as one; an empty
benchmark hits nothing.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohorte.llm.scratch import Scratch, free, keyed
from kohorte.llm.textops import NON_ALNUM, flat, hashed, released, slices, text_batch

WINDOW = 10
SHARE_WORDS = 400_000
WORD = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOUND = "key long, n_words long, n_hit long, items array<string>, spans array<struct<first:int,last:int>>"


class Automaton:
    """Generalised suffix automaton over integer sequences, with the items of each window."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int = WINDOW):
        self.window = window
        self.to: list[dict[int, int]] = [{}]
        self.length, self.link = [0], [-1]
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        self.items: dict[tuple[int, int], set[str]] = defaultdict(set)   # (state, window length) -> items
        for name, words in items:
            size = min(window, len(words))
            for i in range(len(words) - size + 1 if size else 0):
                state = 0
                for word in words[i:i + size]:
                    state = self.to[state][word]
                self.items[state, size].add(name)
        self.sizes = sorted({size for _, size in self.items}, reverse=True)

    def _state(self, length: int, to: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.to.append(to)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, before: int, state: int, word: int) -> int:
        """The part of ``state`` that is one longer than ``before``, as a state of its own."""
        twin = self._state(self.length[before] + 1, dict(self.to[state]), self.link[state])
        self.link[state] = twin
        while before >= 0 and self.to[before].get(word) == state:
            self.to[before][word] = twin
            before = self.link[before]
        return twin

    def _extend(self, last: int, word: int) -> int:
        known = self.to[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, known, word)
        new, before = self._state(self.length[last] + 1, {}, 0), last
        while before >= 0 and word not in self.to[before]:
            self.to[before][word] = new
            before = self.link[before]
        if before >= 0:
            state = self.to[before][word]
            self.link[new] = state if self.length[state] == self.length[before] + 1 else self._split(before, state, word)
        return new

    def stream(self, words: list[int]) -> Iterator[tuple[int, int, set[str]]]:
        """(last word, window length, items) of each window that ends in ``words``."""
        state = length = 0
        shortest = self.sizes[-1] if self.sizes else 1 << 60
        for i, word in enumerate(words):
            while state and word not in self.to[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.to[state]:
                state = self.to[state][word]
                length += 1
            if length < shortest:
                continue
            at = state
            for size in self.sizes:
                if size <= length:
                    while self.length[self.link[at]] >= size:
                        at = self.link[at]
                    found = self.items.get((at, size))
                    if found:
                        yield i, size, found


class Share:
    """An automaton and the tables that tell where it has to be run."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        raw, at = flat(pa.array([text for _, text in items], pa.large_string()))
        h, offsets = hashed(raw, at, NON_ALNUM)
        self.words = np.unique(h)
        ids = np.searchsorted(self.words, h)
        sequences = [(name, ids[offsets[i]:offsets[i + 1]].tolist()) for i, (name, _) in enumerate(items)]
        self.automaton = Automaton(sequences, window)
        inside = np.ones(len(ids), bool)
        inside[offsets[1:-1][offsets[1:-1] < len(ids)]] = False     # a pair doesn't cross two items
        self.pairs = np.unique((ids[:-1] * len(self.words) + ids[1:])[inside[1:]]) if len(ids) > 1 else np.zeros(0, np.int64)
        self.seen = np.zeros(1 << 16, bool)
        self.seen[self.words >> np.uint64(48)] = True

    def identify(self, h: np.ndarray) -> np.ndarray:
        """Number of each known word, -1 for others."""
        out = np.full(len(h), -1, np.int64)
        if len(self.words):
            maybe = np.flatnonzero(self.seen[h >> np.uint64(48)])
            found = np.minimum(np.searchsorted(self.words, h[maybe]), len(self.words) - 1)
            same = self.words[found] == h[maybe]
            out[maybe[same]] = found[same]
        return out

    def stretches(self, ids: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of words in which a window can lie."""
        if not self.automaton.sizes or not len(ids):
            return []
        shortest = self.automaton.sizes[-1]
        if shortest == 1:
            good = ids >= 0
            extra = 0
        else:
            good = np.zeros(len(ids), bool)
            both = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
            keys = ids[both] * len(self.words) + ids[both + 1]
            at = np.minimum(np.searchsorted(self.pairs, keys), max(len(self.pairs) - 1, 0))
            good[both[self.pairs[at] == keys]] = True if len(self.pairs) else False
            crossing = offsets[1:-1]
            good[crossing[crossing > 0] - 1] = False
            extra = 1
        edges = np.flatnonzero(np.diff(np.concatenate([[0], good.astype(np.int8), [0]])))
        first, last = edges[::2], edges[1::2]
        if shortest == 1:   # a stretch must not cross two texts
            cuts = offsets[1:-1]
            pieces = []
            for a, b in zip(first.tolist(), last.tolist()):
                inner = cuts[np.searchsorted(cuts, a, "right"):np.searchsorted(cuts, b, "left")]
                bounds = [a, *np.unique(inner).tolist(), b]
                pieces += list(zip(bounds, bounds[1:]))
            return pieces
        long = last - first >= shortest - 1
        return list(zip(first[long].tolist(), (last[long] + extra).tolist()))


def _search(shares: list[tuple[str, str]], window: int):
    own: list[Share] = []

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not own:
            own.append(Share(shares, window))
        share = own[0]
        for batch in batches:
            for first, texts in slices(text_batch(batch)):
                raw, at = flat(texts)
                h, offsets = hashed(raw, at, NON_ALNUM)
                ids = share.identify(h)
                marked = np.zeros(len(h) + 1, np.int64)
                names: dict[int, set[str]] = defaultdict(set)
                for a, b in share.stretches(ids, offsets):
                    row = int(np.searchsorted(offsets, a, side="right")) - 1
                    for i, size, items in share.automaton.stream(ids[a:b].tolist()):
                        marked[a + i - size + 1] += 1
                        marked[a + i + 1] -= 1
                        names[row] |= items
                hit = np.cumsum(marked[:-1]) > 0
                upto = np.concatenate([[0], np.cumsum(hit)])
                n_hit = upto[offsets[1:]] - upto[offsets[:-1]]
                spans = [[] for _ in range(len(texts))]
                for row in np.flatnonzero(n_hit):
                    own_hits = hit[offsets[row]:offsets[row + 1]]
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], own_hits.astype(np.int8), [0]])))
                    spans[row] = [{"first": int(a), "last": int(b) - 1} for a, b in zip(edges[::2], edges[1::2])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array(np.diff(offsets), pa.int64()), pa.array(n_hit, pa.int64()),
                     pa.array([sorted(names[r]) if r in names else [] for r in range(len(texts))], pa.list_(pa.string())),
                     pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))],
                    names=["key", "n_words", "n_hit", "items", "spans"])
    return run


def _shares(items: DataFrame, id_column: str, text_column: str) -> Iterator[list[tuple[str, str]]]:
    """The items, a bounded share at a time; at least one share, which may be empty."""
    own = items.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    share, held = [], 0
    for row in own.orderBy("item", "text").toLocalIterator():
        n = len(WORD.findall(row["text"]))
        if share and held + n > SHARE_WORDS:
            yield share
            share, held = [], 0
        share.append((row["item"], row["text"]))
        held += n
    yield share


def _merged_spans(spans: list[list[dict]]) -> list[dict]:
    out: list[dict] = []
    for span in sorted((s for some in spans for s in some), key=lambda s: s["first"]):
        if out and span["first"] <= out[-1]["last"] + 1:
            out[-1] = {"first": out[-1]["first"], "last": max(out[-1]["last"], span["last"])}
        else:
            out.append({"first": span["first"], "last": span["last"]})
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, id_column: str = "doc_id", text_column: str = "text",
                       item_column: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``id_column``, n_words, n_hit, items (sorted ids as strings) and spans (first and last hit word) of every document."""
    rows = docs.select(F.col(id_column).cast("long").alias("key"), F.col(text_column).alias("text"))
    shares = _shares(benchmark, item_column, item_text)
    first, second = next(shares), next(shares, None)
    if second is None:
        return rows.mapInArrow(_search(first, window), FOUND).withColumnRenamed("key", id_column)
    scratch = Scratch(docs.sparkSession, "decontaminate")
    numbered, key = keyed(docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")), scratch, "id", "text")
    numbered = numbered.select(F.col(key).cast("long").alias("key"), F.col("id").cast("long").alias("id"), "text")
    found = _in_shares(numbered.select("key", "text"), itertools.chain([first, second], shares), window, scratch)
    if key == "id":
        return found.withColumnRenamed("key", id_column)
    return numbered.select("key", F.col("id").alias(id_column)).join(found, "key").drop("key")


def _in_shares(rows: DataFrame, shares: Iterable[list[tuple[str, str]]], window: int, scratch: Scratch) -> DataFrame:
    """The findings of all shares for rows with unique keys, added up by key; each share's are stored before the next one is read."""
    parts = [scratch.keep(rows.mapInArrow(_search(share, window), FOUND), f"share-{k}") for k, share in enumerate(shares)]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            merged = [_merged_spans(s) for s in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([sum(s["last"] - s["first"] + 1 for s in m) for m in merged], pa.int64()),
                 batch.column(2), pa.array(merged, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))],
                names=["key", "n_words", "n_hit", "items", "spans"])

    return functools.reduce(DataFrame.unionByName, parts).groupBy("key").agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.collect_list("spans").alias("spans")).mapInArrow(merge, FOUND)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_column: str = "doc_id", text_column: str = "text",
                  length_column: str | None = "n_chars", window: int = WINDOW, max_coverage: float = 0.0) -> DataFrame:
    """``docs`` without documents of which more than ``max_coverage`` of the words are hit; in the others the
    hit spans are cut out. With the default 0 every contaminated document goes; with one share of items in one narrow pass. All columns
    are kept; ``length_column``, if there is one, is the code points of the new text."""
    shares = _shares(benchmark, "item_id", "text")
    first, second = next(shares), next(shares, None)
    if second is None:
        return docs.mapInArrow(_filter(first, window, text_column, length_column, max_coverage), docs.schema)
    scratch = Scratch(docs.sparkSession, "decontaminate")
    numbered, key = keyed(docs, scratch, id_column, text_column)
    of, spans = free("of_row", numbered.columns), free("hit_spans", numbered.columns)
    rows = numbered.select(F.col(key).cast("long").alias("key"), F.col(text_column).alias("text"))
    found = _in_shares(rows, itertools.chain([first, second], shares), window, scratch)
    judged = found.where(F.col("n_hit") <= max_coverage * F.col("n_words")).select(F.col("key").alias(of), F.col("spans").alias(spans))
    kept = numbered.join(judged, F.col(key).cast("long") == F.col(of)).select(*docs.columns, spans)
    return kept.mapInArrow(_cut_spans(spans, docs.columns, text_column, length_column), docs.schema)


def _cut_spans(spans_column: str, names: list[str], text_column: str, length_column: str | None):
    """The texts without the words of their spans."""
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(batch.schema.get_field_index(spans_column))
            part = batch.select(names)
            for first, texts in slices(text_batch(batch, text_column)):
                raw, at = flat(texts)
                _, offsets, starts, stops = hashed(raw, at, NON_ALNUM, spans=True)
                hit = np.zeros(len(starts), bool)
                for row, own in enumerate(found.slice(first, len(texts)).to_pylist()):
                    for span in own:
                        hit[offsets[row] + span["first"]:offsets[row] + span["last"] + 1] = True
                yield _without(part.slice(first, len(texts)), raw, at, offsets, starts, stops, hit, text_column, length_column)
    return run


def _without(part: pa.RecordBatch, raw: np.ndarray, at: np.ndarray, offsets: np.ndarray, starts: np.ndarray, stops: np.ndarray, hit: np.ndarray,
             text_column: str, length_column: str | None) -> pa.RecordBatch:
    """The rows with the hit words cut out of their texts."""
    upto = np.concatenate([[0], np.cumsum(hit)])
    edited = np.flatnonzero(upto[offsets[1:]] - upto[offsets[:-1]])
    if not len(edited):
        return part
    values = part.column(part.schema.get_field_index(text_column)).to_pylist()
    lengths = part.column(part.schema.get_field_index(length_column)).to_pylist() if length_column else None
    for row in edited.tolist():
        pieces, begin = [], int(at[row])
        for k in np.flatnonzero(hit[offsets[row]:offsets[row + 1]]) + offsets[row]:
            pieces.append(raw[begin:starts[k]].tobytes())
            begin = int(stops[k])
        pieces.append(raw[begin:at[row + 1]].tobytes())
        values[row] = b"".join(pieces).decode("utf-8")
        if lengths is not None:
            lengths[row] = len(values[row])
    columns = {f.name: part.column(i) for i, f in enumerate(part.schema)}
    columns[text_column] = pa.array(values, part.schema.field(text_column).type)
    if lengths is not None:
        columns[length_column] = pa.array(lengths, part.schema.field(length_column).type)
    return pa.RecordBatch.from_arrays(list(columns.values()), schema=part.schema)


def _filter(items: list[tuple[str, str]], window: int, text_column: str, length_column: str | None, max_coverage: float):
    own: list[Share] = []

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not own:
            own.append(Share(items, window))
        share = own[0]
        for batch in batches:
            for first, texts in slices(text_batch(batch, text_column)):
                raw, at = flat(texts)
                h, offsets, starts, stops = hashed(raw, at, NON_ALNUM, spans=True)
                ids = share.identify(h)
                marked = np.zeros(len(h) + 1, np.int64)
                for a, b in share.stretches(ids, offsets):
                    for i, size, _ in share.automaton.stream(ids[a:b].tolist()):
                        marked[a + i - size + 1] += 1
                        marked[a + i + 1] -= 1
                hit = np.cumsum(marked[:-1]) > 0
                upto = np.concatenate([[0], np.cumsum(hit)])
                n_hit, n = upto[offsets[1:]] - upto[offsets[:-1]], np.diff(offsets)
                kept = n_hit <= max_coverage * n
                # What goes needs no cutting.
                hit &= np.repeat(kept, n)
                part = _without(batch.slice(first, len(texts)), raw, at, offsets, starts, stops, hit, text_column, length_column)
                yield part.filter(pa.array(kept))
    return run
