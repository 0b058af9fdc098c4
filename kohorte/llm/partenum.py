"""Set-similarity join on word shingles by PartEnum signatures.

A document's set is its distinct five-word shingles (64-bit hashes). Two sets of Jaccard similarity 0.75 or more
have sizes in the same band or in neighbouring bands [lo, lo / 0.75], and differ in at most k = 2 hi / 7 shingles. For
each band the shingle domain is cut into n partitions, somewhat more than k. A difference spoils one partition, so the
pair agrees on at least n - k of them, and thus on the signatures of all subsets of agreeing partitions. A set emits
the signatures of its own band and of the next one.

Subsets: all n - k partitions together for k up to 3, pairs of partitions while there are at most ``PAIRED``, else
single ones. From ``FILLED`` partitions on (sets of about 90 shingles or more) empty partitions give no signature, and at
most the first ``EMITTED`` partitions do. Differences fall into partitions by hash, so a pair at the threshold
agrees on a filled partition with probability 0.44; the agreements that are asked for are so few that a pair misses
them with a probability below 1e-10, whatever the texts.

Frequent signatures (empty partitions, partitions filled by one shared passage) are dropped by the prefix argument: two
sets that share s signatures share one that isn't among the s - 1 most frequent of either. What remains is
grouped; the sets of a group are compared with its most connected member, then those still in different components
with those that have one of their rarest shingles. Sets with equal content are one set throughout, so copies are never paired. Every link is checked on
the texts; signatures only propose.

Null and empty texts, and texts without a word, have an empty set and link with nothing; fewer than five words
make one shingle. Rows with the same id or without one are documents of their own; a component has the smallest id that
isn't null, and its first document is the one with that id (of equal ids the one whose text has the smallest hash). Other
columns are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kohorte.llm.components import connected
from kohorte.llm.scratch import Scratch, keyed
from kohorte.llm.textops import flat, hashed, mix, released, slices, text_batch, windows

PERCENT = 75
SHINGLE = 5
PAIRED, FILLED, EMITTED = 13, 40, 96
AGREES, MISSED = 0.44, 1e-10


@cache
def bands(percent: int, largest: int) -> tuple[int, ...]:
    """Smallest size of each band, up to the one that holds ``largest``."""
    lows = [1]
    while lows[-1] <= largest:
        lows.append(100 * lows[-1] // percent + 1)
    return tuple(lows)


@cache
def scheme(percent: int, band: int) -> tuple[int, int, np.ndarray | None, int]:
    """Of a band: partitions, partitions that give signatures, the subsets (None: single ones), signatures that a
    similar pair shares at least."""
    lows = bands(percent, 1)
    while len(lows) < band + 2:
        lows = bands(percent, lows[-1] * 2)
    high = lows[band + 1] - 1
    k = 2 * high * (100 - percent) // (100 + percent)
    if k == 0:
        return 1, 1, None, 1
    n = k + (k + 1) // 2 + 1
    if k <= 3:
        return n, n, np.array(list(combinations(range(n), n - k))), 1
    if n <= PAIRED:
        return n, n, np.array(list(combinations(range(n), 2))), comb(n - k, 2)
    if n < FILLED:
        return n, n, None, n - k
    emitted, shared, missed = min(n, EMITTED), 0, 0.0
    while missed < MISSED:
        missed += comb(emitted, shared) * AGREES ** shared * (1 - AGREES) ** (emitted - shared)
        shared += 1
    return n, emitted, None, max(shared - 1, 1)


def signatures(own: np.ndarray, band: int, percent: int = PERCENT) -> tuple[np.ndarray, int]:
    """Signatures of a set in a band, and how many of the most frequent can be dropped."""
    n, emitted, subsets, shared = scheme(percent, band)
    salt = mix(np.array([band + 1], np.uint64))[0]
    spread = mix(own + salt)
    part = (spread % np.uint64(n)).astype(np.int64)
    sums = np.zeros(n, np.uint64)
    np.add.at(sums, part, mix(spread))
    if subsets is None:
        order = (np.flatnonzero(sums[:emitted]) if n >= FILLED else np.arange(emitted)).astype(np.uint64)
        base = sums[order.astype(np.int64)]
    else:
        factors = mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
        base, order = (sums[subsets] * factors[subsets]).sum(axis=1, dtype=np.uint64), np.arange(len(subsets), dtype=np.uint64)
    return mix(base + mix(order + salt)), shared - 1


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    h, offsets = hashed(*flat(texts))
    shingles, at = windows(h, offsets, SHINGLE)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        yield np.unique(shingles[a:b])


def fingerprint(own: np.ndarray) -> int:
    return int(mix(np.array([mix(own).sum(dtype=np.uint64) + np.uint64(len(own))], np.uint64)).view(np.int64)[0])


@released
def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in slices(text_batch(batch)):
            sets = [(len(s), fingerprint(s)) for s in shingle_sets(texts)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i).slice(first, len(texts)) for i in range(2)], pa.array([n for n, _ in sets], pa.int64()),
                 pa.array([f for _, f in sets], pa.int64())], names=["row", "doc", "n", "fp"])


def _signatures(percent: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(text_batch(batch)):
                rows, found = [], []
                for own in shingle_sets(texts):
                    if not len(own):
                        continue
                    lows = bands(percent, len(own))
                    band, fp = int(np.searchsorted(lows, len(own), side="right")) - 1, fingerprint(own)
                    for one in (band, band + 1):
                        signed, spare = signatures(own, one, percent)
                        rows.append((fp, len(own), spare, one & 1))
                        found.append(signed)
                at = np.cumsum([0] + [len(s) for s in found])
                values = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
                columns = list(zip(*rows)) or [()] * 4
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds)]
                    + [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values))],
                    names=["fp", "n", "spare", "odd", "sigs"])
    return run


def _compare(percent: int):
    """Pairs of texts that are similar; the last text's set is kept, as neighbours often share it."""
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str, np.ndarray] | None = None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            linked = []
            for row in range(len(batch)):
                sets = []
                for name in ("text_a", "text_b"):
                    text = batch.column(batch.schema.get_field_index(name)).slice(row, 1)
                    if name == "text_a":
                        if last is None or last[0] != a[row]:
                            last = (a[row], next(shingle_sets(text)))
                        sets.append(last[1])
                    else:
                        sets.append(next(shingle_sets(text)))
                both = len(np.intersect1d(*sets, assume_unique=True))
                if 100 * both >= percent * (len(sets[0]) + len(sets[1]) - both):
                    linked.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([a[r] for r in linked], pa.int64()), pa.array([b[r] for r in linked], pa.int64())],
                                             names=["a", "b"])
    return run


def _linked(pairs: DataFrame, sigs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose texts are similar. Pairs that share fewer signatures than similar ones do are left out
    before texts are met; the member's text comes first, then the centre's."""
    def of(side: str) -> DataFrame:
        return sigs.select(F.col("fp").alias(side), F.col("need").alias(f"need_{side}"), F.col("sigs").alias(f"sigs_{side}"))

    near = pairs.join(of("b"), "b").join(of("a"), "a") \
        .where(F.size(F.array_intersect("sigs_a", "sigs_b")) >= F.least("need_a", "need_b")).select("a", "b")
    of_b = texts.select(F.col("fp").alias("b"), F.col("text").alias("text_b"))
    of_a = texts.select(F.col("fp").alias("a"), F.col("text").alias("text_a"))
    return near.join(of_b, "b").join(of_a, "a").select("a", "b", "text_a", "text_b").mapInArrow(_compare(percent), "a long, b long")


def _compatible(percent: int):
    return 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")


def classes(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", percent: int = PERCENT) -> DataFrame:
    """``id_column``, n_shingles and component_id: the smallest id that links reach, the document's own included."""
    if percent < PERCENT:
        raise ValueError(f"the number of shared signatures asked for holds from {PERCENT} percent on")
    result, scratch = Scratch(docs.sparkSession, "partenum"), Scratch(docs.sparkSession, "partenum-work")
    docs, key = keyed(docs.select(id_column, text_column), scratch, id_column, text_column)
    rows = docs.select(F.col(key).cast("long").alias("row"), F.col(id_column).cast("long").alias("doc"), F.col(text_column).alias("text"))
    sets = result.keep(rows.mapInArrow(_fingerprints, "row long, doc long, n long, fp long"), "sets")
    signed = rows.select("text").mapInArrow(_signatures(percent), "fp long, n int, spare int, odd int, sigs array<long>")
    live = signed.select(F.explode("sigs").alias("sig")).groupBy("sig").count().where("count > 1").select("sig")
    members = signed.select("fp", "n", "spare", "odd", F.explode("sigs").alias("sig")).join(live, "sig", "left_semi").distinct()
    members = scratch.keep(members, "members")
    often = members.groupBy("sig").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    by_set = F.row_number().over(Window.partitionBy("fp", "odd").orderBy(F.desc("often"), "sig"))
    kept = members.join(often, "sig").withColumn("nth", by_set).where("nth > spare").select("sig", "fp", "n", "often")
    kept = scratch.keep(kept, "kept")
    score = kept.groupBy("fp").agg(F.sum("often").alias("score"))
    groups = scratch.keep(kept.select("sig", "fp", "n").join(score, "fp"), "groups")
    asked = groups.select("fp").distinct()
    shared = members.join(asked, "fp", "left_semi").groupBy("fp").agg(
        (F.min("spare") + 1).alias("need"), F.collect_list(F.col("sig").bitwiseAND(F.lit((1 << 31) - 1)).cast("int")).alias("sigs"))     # a set's own signatures
    found = _closed(groups, scratch.keep(shared, "sigs"), _texts(rows, sets, groups, scratch), scratch, percent)
    found = result.keep(found, "roots")
    scratch.drop()
    return _labelled(sets, found).withColumnRenamed("doc", id_column)


def _texts(rows: DataFrame, sets: DataFrame, groups: DataFrame, scratch: Scratch) -> DataFrame:
    """One text for each set that has a candidate."""
    of_set = sets.join(groups.select("fp").distinct(), "fp", "left_semi").groupBy("fp").agg(F.min("row").alias("row"))
    return scratch.keep(rows.join(of_set, "row").select("fp", "text"), "texts")


def _closed(groups: DataFrame, sigs: DataFrame, texts: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """(a, b): each linked set and the smallest set of its component.

    Sets first meet the most connected member of each of their groups. A second round is for what signatures join
    and is in different components still: of these sets all that share a rare shingle are compared, so that many texts
    with the same long passage, and thus the same signatures, don't all meet each other.
    """
    member = F.struct("score", "fp", "n")
    center = groups.groupBy("sig").agg(F.max(member).alias("c"), F.count(F.lit(1)).alias("m")).where("m > 1")
    to_center = groups.join(center, "sig").select(
        F.col("c.fp").alias("a"), F.col("fp").alias("b"), F.col("c.n").alias("n_a"), F.col("n").alias("n_b")).where("a <> b")
    tested = scratch.keep(to_center.where(_compatible(percent)).select("a", "b").distinct(), "pairs-0")
    edges = scratch.keep(_linked(tested, sigs, texts, percent), "edges-0")
    roots = connected(edges, scratch, "roots-0")
    placed = groups.join(roots.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left") \
        .withColumn("root", F.coalesce("root", "fp"))
    open_sigs = placed.groupBy("sig").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("sig")
    asked = scratch.keep(placed.join(open_sigs, "sig", "left_semi").select("fp", "n", "root").distinct(), "open")
    ordered = _rarest(asked, texts, percent).where(_compatible(percent)).select("a", "b").distinct()
    done = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    fresh = scratch.keep(ordered.join(done, ["a", "b"], "left_anti"), "pairs-1")
    linked = scratch.keep(_linked(fresh, sigs, texts, percent), "edges-1")
    return roots if linked.isEmpty() else connected(edges.unionByName(linked), scratch, "roots-1")


@released
def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in slices(text_batch(batch)):
            sets = [s.view(np.int64) for s in shingle_sets(texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, len(texts)), pa.array(sets, pa.list_(pa.int64()))], names=["fp", "shingles"])


def _rarest(asked: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets of open groups that aren't in one component and share one of their rarest shingles.

    Similar sets of sizes m and n share at least o = p / (1 + p) (m + n) shingles. So of each, in one order from rare to
    frequent, one of the first n - p n + 1 is shared; and the first that they share leaves enough behind it to get to o.
    """
    cut = texts.join(asked, "fp").select("fp", "text").mapInArrow(_shingles, "fp long, shingles array<long>")
    each = cut.select("fp", F.explode("shingles").alias("shingle"))
    common = each.groupBy("shingle").count().where("count > 1")
    nth = F.row_number().over(Window.partitionBy("fp").orderBy("count", "shingle"))
    of_set = Window.partitionBy("fp")       # a set's own shingles
    placed = each.join(common, "shingle").join(asked, "fp").withColumn("at", nth + F.col("n") - F.count(F.lit(1)).over(of_set)) \
        .where(f"at <= n - (n * {percent} + 99) div 100 + 1").select("shingle", "fp", "n", "root", "at")
    left, right = (placed.select("shingle", *[F.col(c).alias(f"{c}_{side}") for c in ("fp", "n", "root", "at")]) for side in "ab")
    reach = 1 + F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    return left.join(right, "shingle").where(F.col("fp_a") < F.col("fp_b")).where("root_a <> root_b") \
        .where((100 + percent) * reach >= percent * (F.col("n_a") + F.col("n_b"))) \
        .select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"), "n_a", "n_b")


def _labelled(sets: DataFrame, roots: DataFrame) -> DataFrame:
    placed = sets.where("n > 0").join(roots.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left") \
        .withColumn("root", F.coalesce("root", "fp"))
    first = placed.groupBy("root").agg(F.min("doc").alias("component_id"))
    linked = placed.join(first, "root").select("doc", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(sets.where("n = 0").select("doc", F.col("n").alias("n_shingles"), F.col("doc").alias("component_id")))


def first_of_class(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` without those whose component has an earlier document: of each component one row stays."""
    rows, key = keyed(docs, Scratch(docs.sparkSession, "partenum-rows"), id_column, text_column)
    own = classes(rows, id_column=key, text_column=text_column, percent=percent).where(F.col(key) == F.col("component_id")).select(key)
    return rows.join(own, key, "left_semi").select(docs.columns)
