"""Line dedup with a suffix array over line ids.

The documents, in ascending id order, are sequences of line ids. Prefix doubling sorts all suffixes that begin with a
line that occurs more than once: by their first 1, 2, 8, 32 ... lines, each time from the ranks of the round
before at two places (the first round) or four; a round is a window over a document's lines, a grouped count, a range
sort and a join. Ranks are kept for all rounds, so two neighbours in the suffix array tell within a factor of four how
many lines they share; the rest is compared line by line, and only where the neighbours' preceding lines differ (else
the length is one less than at the line before).

A sweep over the suffix array then keeps the stack of open longest-common-prefix intervals, each with its earliest
suffix, and gives for each suffix the longest run of lines that also begins at an earlier place. Partitions of the array
are swept apart; what crosses their borders is a stack of at most one entry for each different length.

Result: a line is deleted if it lies in a run of at least ``min_words`` words that occurs, line for line, also
earlier (at a smaller id, or higher up in the same document; the two may overlap). The first copy of every line stays.
Lines are equal if their characters are. Null texts are kept as they are and have no lines; an empty text is one
empty line. Rows with the same id or without one are documents of their own: null ids come last, equal ids in the order of
their texts' hashes (``scratch.keyed``). Other columns are carried along.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from kohorte.llm.scratch import Scratch, free, keyed, partitions
from kohorte.llm.textops import released, text_batch

MIN_WORDS = 50
ALONE = 1 << 62     # ranks of lines that occur once, above all others

Place = tuple[int, int]


def line_ids(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(doc, n_lines, pos, id) of every line."""
    cut = docs.where(F.col(text_column).isNotNull()).select(
        F.col(id_column).cast("long").alias("doc"), F.split(F.col(text_column), "\n", -1).alias("lines"))
    return cut.select("doc", F.size("lines").alias("n_lines"), F.posexplode(F.transform("lines", lambda x: F.xxhash64(x))).alias("pos", "id"))


def _ranked(keys: DataFrame, n: int, *names: str) -> DataFrame:
    """``rank``: numbers that ascend with the sorted keys over all partitions."""
    return keys.repartitionByRange(n, *names).sortWithinPartitions(*names).withColumn("rank", F.monotonically_increasing_id())


def _at(name: str, distance: int) -> Column:
    """``name`` at the line so many places further on in the document; null where that line is not among the rows."""
    return F.first(name).over(Window.partitionBy("doc").orderBy("pos").rangeBetween(distance, distance))


def suffix_ranks(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc, n_lines, pos, id, before, ranks): suffixes that begin with a repeated line; ``ranks`` by 1, 2, 8, 32 ... lines,
    ``before`` the id of the line above if that is repeated too."""
    n = partitions(lines.sparkSession)
    repeated = lines.groupBy("id").count().where("count > 1").select("id")
    dup = scratch.keep(lines.join(repeated, "id", "left_semi").select("doc", "n_lines", "pos", "id"), "repeated")
    first = scratch.keep(_ranked(dup.select("id").distinct(), n, "id"), "rank-0")
    now = dup.join(first, "id").select("doc", "n_lines", "pos", "id", _at("id", -1).alias("before"), "rank", F.array("rank").alias("ranks"))
    now = scratch.keep(now, "suffixes-0")
    classes, step, k = first.count(), 1, 0
    while True:
        factor = 4 if k else 2
        places = range(step, factor * step, step)
        names = ["rank1", *(f"rank{i}" for i in range(2, factor + 1))]
        both = now.withColumns({name: _at("rank", t) for name, t in zip(names[1:], places)}).withColumnRenamed("rank", "rank1")
        for name, t in zip(names[1:], places):
            there = F.col("pos") + t
            alone = F.xxhash64("doc", there).bitwiseAND(F.lit(ALONE - 1)).bitwiseOR(F.lit(ALONE))
            both = both.withColumn(name, F.coalesce(name, F.when(there >= F.col("n_lines"), F.lit(-1)).otherwise(alone)))
        k += 1
        both = scratch.keep(both, f"pairs-{k}")
        seen = Observation()     # filled while the ranks are written
        ranked = scratch.keep(_ranked(both.select(*names).distinct(), n, *names).observe(
            seen, F.count(F.lit(1)).alias("n")), f"rank-{k}")
        found = seen.get["n"]
        if found == classes:    # no class was split: all that is equal now is equal to its end
            return now
        after = both.join(ranked, names).select(
            "doc", "n_lines", "pos", "id", "before", "rank", F.concat("ranks", F.array("rank")).alias("ranks"))
        now = scratch.keep(after, f"suffixes-{k}")
        scratch.drop(f"suffixes-{k - 1}", f"pairs-{k}", f"rank-{k}")
        classes, step = found, factor * step


def suffix_array(suffixes: DataFrame, scratch: Scratch) -> DataFrame:
    """(part, at, doc, pos, lcp): the suffixes in order (``at`` ascends over all parts), and how many lines each shares
    with the one before."""
    n = partitions(suffixes.sparkSession)
    order = ["rank", "doc", "pos"]
    array = scratch.keep(
        suffixes.repartitionByRange(n, *order).sortWithinPartitions(*order)
        .withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()), "array")
    row = F.struct("doc", "pos", "before", "ranks", "n_lines")
    # The last suffix of each part, one row a part, goes in front of the next part.
    last = array.groupBy("part").agg(F.max_by(row, "at").alias("last"))
    parts = sorted(r["part"] for r in array.select("part").distinct().collect())
    following = {a: b for a, b in zip(parts, parts[1:])}
    if following:
        table = F.create_map(*[F.lit(x) for pair in following.items() for x in pair])
        last = last.withColumn("part", table[F.col("part")]).where("part is not null")
        array_last = array.join(F.broadcast(last), "part", "left")      # at most one row a partition
    else:
        array_last = array.withColumn("last", F.lit(None).cast(array.select(row.alias("r")).schema["r"].dataType))
    previous = F.coalesce(F.lag(row).over(Window.partitionBy("part").orderBy("at")), F.col("last"))
    near = array_last.withColumn("p", previous)
    shared = F.size(F.filter(F.arrays_zip(F.col("ranks").alias("x"), F.col("p.ranks").alias("y")), lambda z: z["x"] == z["y"]))
    near = near.select("part", "at", "doc", "pos", "n_lines", F.col("p.doc").alias("doc2"), F.col("p.pos").alias("pos2"),
                       F.when(F.col("p").isNull(), 0).otherwise(shared).alias("levels"), F.size("ranks").alias("all_levels"),
                       (F.col("before") == F.col("p.before")).alias("follows"))
    near = scratch.keep(near.withColumn("follows", F.coalesce("follows", F.lit(False))), "near")
    # Lines to compare where the number of shared lines lies between two ranked lengths: 2 and 8, 8 and 32 ...
    lines = suffixes.select("doc", "pos", "id")
    asked = near.where("levels > 1 and levels < all_levels and not follows").select(
        "at", "doc", "pos", "doc2", "pos2",
        F.explode(F.expr("sequence(shiftleft(1, 2 * levels - 3), least(shiftleft(1, 2 * levels - 1) - 1, n_lines - pos))")).alias("t"))
    mine = asked.withColumn("pos", F.col("pos") + F.col("t")).join(lines, ["doc", "pos"], "left").select(
        "at", "t", F.col("id").alias("id1"), F.col("doc2").alias("doc"), (F.col("pos2") + F.col("t")).alias("pos"))
    compared = mine.join(lines, ["doc", "pos"], "left").where("id1 is null or id is null or id1 <> id")
    shorter = compared.groupBy("at").agg(F.min("t").alias("t"))
    level = F.when(F.col("levels") == 0, 0).when(F.col("levels") == F.col("all_levels"), F.col("n_lines") - F.col("pos")) \
        .when(F.col("levels") == 1, 1).otherwise(F.coalesce("t", F.expr("shiftleft(1, 2 * levels - 1) - 1")))
    direct = near.join(shorter, "at", "left").withColumn("lcp", F.when(~F.col("follows"), level))
    chain = F.last(F.col("lcp") + F.col("pos"), ignorenulls=True).over(Window.partitionBy("doc").orderBy("pos"))
    return scratch.keep(direct.select("part", "at", "doc", "pos", F.coalesce("lcp", chain - F.col("pos")).cast("int").alias("lcp")), "lcps")


class Stack:
    """Open intervals: lengths and the earliest place of each, both ascending from the bottom."""

    def __init__(self, entries: list[tuple[int, Place]] = ()):
        self.lengths = [e[0] for e in entries]
        self.places = [tuple(e[1]) for e in entries]

    def close(self, length: int) -> None:
        """What is open beyond ``length`` is open to ``length`` only."""
        earliest = None
        while self.lengths and self.lengths[-1] > length:
            self.lengths.pop()
            earliest = self.places.pop()    # places ascend: the last one popped is the earliest
        if earliest is not None and length > 0:
            self.push(length, earliest)

    def push(self, length: int, place: Place) -> None:
        while self.places and self.places[-1] >= place and self.lengths[-1] <= length:
            self.lengths.pop()
            self.places.pop()
        if not self.lengths or self.lengths[-1] < length:
            self.lengths.append(length)
            self.places.append(place)

    def longest(self, place: Place) -> int:
        """The longest open interval with an earlier place."""
        at = bisect_left(self.places, place)
        return self.lengths[at - 1] if at else 0

    def entries(self) -> list[tuple[int, Place]]:
        return list(zip(self.lengths, self.places))


ENDLESS = 1 << 31


def sweep(places: list[Place], lcps: list[int], stack: Stack) -> list[int]:
    """For each place the longest interval with an earlier place before it; ``lcps`` is with the one before."""
    out = []
    for place, lcp in zip(places, lcps):
        stack.close(lcp)
        out.append(stack.longest(place))
        stack.push(ENDLESS, place)
    return out


def _both_ways(table: pa.Table, left: Stack, right: Stack, beyond: int) -> tuple[list[int], list[int]]:
    table = table.sort_by("at")
    places = list(zip(table["doc"].to_pylist(), table["pos"].to_pylist()))
    lcps = table["lcp"].to_pylist()
    back = sweep(places[::-1], [beyond, *lcps[:0:-1]], right)[::-1]
    return sweep(places, lcps, left), back


def earlier_runs(array: DataFrame) -> DataFrame:
    """(doc, pos, run): the longest run of lines from each place that also begins at an earlier one."""
    entries = "array<struct<length:long,doc:long,pos:int>>"
    kind = pa.list_(pa.struct([("length", pa.int64()), ("doc", pa.int64()), ("pos", pa.int32())]))

    def packed(stack: Stack) -> list[dict]:
        return [{"length": n, "doc": p[0], "pos": p[1]} for n, p in stack.entries()]

    def summary(table: pa.Table) -> pa.Table:
        left, right = Stack(), Stack()
        _both_ways(table, left, right, 0)
        rows = table.sort_by("at")
        return pa.table({"part": rows["part"].slice(0, 1), "first": rows["lcp"].slice(0, 1),
                         "least": pa.array([min(rows["lcp"].to_pylist()[1:], default=ENDLESS)], pa.int64()),
                         "forth": pa.array([packed(left)], kind), "back": pa.array([packed(right)], kind)})

    grouped = array.groupBy("part")
    ends = sorted(grouped.applyInArrow(summary, f"part int, first int, least long, forth {entries}, back {entries}").collect(),
                  key=lambda r: r["part"])     # one row a partition
    before, after, beyond = {}, {}, {}
    stack = Stack()
    for end in ends:
        before[end["part"]] = stack.entries()
        stack.close(min(end["first"], end["least"]))
        for e in end["forth"]:
            _merge(stack, e)
    stack, border = Stack(), 0
    for end in reversed(ends):
        after[end["part"]], beyond[end["part"]] = stack.entries(), border
        stack.close(min(border, end["least"]))
        for e in end["back"]:
            _merge(stack, e)
        border = end["first"]

    def swept(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        forth, back = _both_ways(table, Stack(before[part]), Stack(after[part]), beyond[part])
        rows = table.sort_by("at")
        return pa.table({"doc": rows["doc"], "pos": rows["pos"], "run": pa.array(np.maximum(forth, back), pa.int32())})

    return grouped.applyInArrow(swept, "doc long, pos int, run int").where("run > 0")


def _merge(stack: Stack, entry) -> None:
    """Add an entry of a later stack; entries come with ascending lengths and places."""
    length, place = entry["length"], (entry["doc"], entry["pos"])
    keep = [(n, p) for n, p in stack.entries() if not (n <= length and p >= place)]
    if not any(n >= length and p <= place for n, p in keep):
        keep.append((length, place))
    keep.sort()
    stack.__init__(keep)


def _cut(min_words: int, names: list[str], text_column: str, length_column: str | None, runs_column: str):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(batch.schema.get_field_index(runs_column)).to_pylist()
            texts = text_batch(batch, text_column).to_pylist()
            n_lines, n_removed, removed_words = [], [], []
            for row, (text, runs) in enumerate(zip(texts, found)):
                lines = [] if text is None else text.split("\n")
                n_lines.append(len(lines))
                gone = np.zeros(len(lines) + 1, np.int64)
                if runs:
                    words = np.array([len(x.encode().split()) for x in lines])
                    upto = np.concatenate([[0], np.cumsum(words)])
                    for r in runs:
                        a, b = r["pos"], r["pos"] + r["run"]
                        if upto[b] - upto[a] >= min_words:
                            gone[a] += 1
                            gone[b] -= 1
                away = np.cumsum(gone[:-1]) > 0
                n_removed.append(int(away.sum()))
                removed_words.append(int(words[away].sum()) if runs else 0)
                if n_removed[-1]:
                    texts[row] = "\n".join(x for x, g in zip(lines, away) if not g)
            columns = []
            for name in names:
                i = batch.schema.get_field_index(name)
                if name == text_column:
                    columns.append(pa.array(texts, batch.schema.field(i).type))
                elif name == length_column:
                    old = batch.column(i).to_pylist()
                    columns.append(pa.array([len(t) if r else o for t, o, r in zip(texts, old, n_removed)], batch.schema.field(i).type))
                else:
                    columns.append(batch.column(i))
            yield pa.RecordBatch.from_arrays(
                columns + [pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed_words, pa.int64())],
                names=names + ["n_lines", "n_removed", "removed_words"])
    return run


def dedup_lines(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", length_column: str | None = None,
                min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of ``docs`` with the text cut (and ``length_column`` set to its code points where it was), and n_lines
    (of the old text), n_removed and removed_words. Columns of ``docs`` with these names are replaced."""
    scratch, work = Scratch(docs.sparkSession, "lines"), Scratch(docs.sparkSession, "lines-work")
    added = ["n_lines", "n_removed", "removed_words"]
    plain = docs.drop(*added)
    docs, key = keyed(plain, scratch, id_column, text_column)
    lines = work.keep(line_ids(docs, key, text_column), "lines")
    runs = earlier_runs(suffix_array(suffix_ranks(lines, work), work))
    found, of = free("__runs", docs.columns), free("__doc", docs.columns)
    grouped = scratch.keep(runs.groupBy(F.col("doc").alias(of)).agg(F.collect_list(F.struct("pos", "run")).alias(found)), "runs")
    work.drop()
    joined = docs.join(grouped, F.col(key).cast("long") == F.col(of), "left").drop(of)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
    return joined.mapInArrow(_cut(min_words, plain.columns, text_column, length_column, found),
                             schema + ", n_lines long, n_removed long, removed_words long")
