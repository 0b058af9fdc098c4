"""Hard-negative mining over a multiway hyperplane tree with distance ranges.

Rows are (id, label, vector). A vector is scaled and floored to integers; a score is the integer inner product with an
anchor, higher first, ties by smaller id. An anchor's positives are its first rows of the same label. For each positive, the first rows
of other labels whose score lies between ``low`` percent of the positive's and the positive's are its hard negatives.

Tree. Split points are picked farthest-first from a bounded sample (the ``SAMPLE`` rows of the smallest hashes). Every row goes
down the tree to the nearest split point of each node and ends in a leaf. Each split point keeps, for every sibling subtree (and
its own), the least and the greatest distance to any of its rows; each subtree also keeps the range of its lengths.

Search. A window of scores and a subtree's lengths give an annulus around the anchor: |x - a|^2 = |a|^2 + |x|^2 - 2 s. By the
triangle inequality a subtree is left out as soon as the range that any split point of the node keeps for it doesn't meet
the annulus. An anchor first meets the leaf where it belongs; the scores found there are the window's lower end for all other leaves. In
leaves all rows are compared: leaves and their anchors meet in blocks of bounded size, so a leaf of any size (one vector
with a third of all rows) is many tasks. The result is exact whatever the tree; the sample only decides the speed.

Rows with a null label, a null vector or a null or non-finite component take no part, nor do those longer than ``LONGEST`` after
scaling, whose distances 53 bits can't hold. A shorter vector is as if filled up with zeros. Rows with a null id are
rows of their own and come last in ties; repeated ids are rows of their own, in a fixed order. Equal rows keep all their
places. An anchor without positives, and a positive without negatives, give no rows. Empty tables give no rows.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from kohorte.llm.scratch import Scratch, keyed

SAMPLE = 4096
DEGREE, LEAF = 8, 64            # split points of a node; sample rows of a leaf
ROWS, ANCHORS = 16384, 1024     # of a block
LONGEST = float(2**25)          # products and distances of two such vectors are exact in doubles
_FAR = float("inf")


@dataclass
class Node:
    points: np.ndarray
    children: list[int]         # a node's number, or -1 - leaf
    nearest: np.ndarray = field(default=None)       # [i, j]: least distance of split point i to subtree j
    farthest: np.ndarray = field(default=None)
    shortest: np.ndarray = field(default=None)      # [j]: squared lengths
    longest: np.ndarray = field(default=None)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all of b; exact for integers in range."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def grow(sample: np.ndarray) -> list[Node]:
    """The tree of a sample; its first node is the root. A sample that can't be split has one node with one leaf."""
    nodes: list[Node] = []
    leaves = 0

    def split(rows: np.ndarray) -> int:
        nonlocal leaves
        chosen, gaps = [0], None
        while len(rows) > LEAF and len(chosen) < DEGREE:
            away = _squares(rows[chosen[-1:]], rows)[0]
            gaps = away if gaps is None else np.minimum(gaps, away)
            if gaps.max() <= 0:
                break
            chosen.append(int(gaps.argmax()))
        if len(chosen) == 1 and nodes:
            leaves += 1
            return -leaves
        at = len(nodes)
        nodes.append(Node(rows[chosen].copy(), []))
        side = _squares(rows, rows[chosen]).argmin(1)
        for j in range(len(chosen)):
            if len(chosen) == 1:
                leaves += 1
                nodes[at].children.append(-leaves)
            else:
                nodes[at].children.append(split(rows[side == j]))
        return at

    if len(sample):
        split(sample)
    return nodes


def place(nodes: list[Node], x: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """The leaf of every row; and of every node met, (its number, rows, squared distances to its points, child taken)."""
    leaf, met = np.zeros(len(x), np.int64), []
    todo = [(0, np.arange(len(x)))]
    while todo:
        n, rows = todo.pop()
        if not len(rows):
            continue
        away = _squares(x[rows], nodes[n].points)
        side = away.argmin(1)
        met.append((n, rows, away, side))
        for j, child in enumerate(nodes[n].children):
            if child < 0:
                leaf[rows[side == j]] = -1 - child
            else:
                todo.append((child, rows[side == j]))
    return leaf, met


def survivors(nodes: list[Node], a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of every leaf that may hold a vector whose score with the row is between ``low`` and ``high``."""
    found = [(np.zeros(0, np.int64), 0)]
    own = (a * a).sum(1)
    todo = [(0, np.arange(len(a)))] if nodes else []
    while todo:
        n, rows = todo.pop()
        node = nodes[n]
        if not len(rows) or node.nearest is None:
            continue
        away = np.sqrt(_squares(a[rows], node.points))
        with np.errstate(invalid="ignore"):
            inner = np.sqrt(np.maximum(own[rows, None] + node.shortest - 2 * high[rows, None], 0))
            outer = own[rows, None] + node.longest - 2 * low[rows, None]
        for j, child in enumerate(node.children):
            if not np.isfinite(node.longest[j]):
                continue            # no row at all
            reach = np.sqrt(np.maximum(outer[:, j], 0))
            slack = 1e-6 * (1 + np.sqrt(own[rows]) + np.sqrt(node.longest[j]))
            alive = outer[:, j] >= 0
            for i in range(len(node.points)):
                alive &= away[:, i] + reach + slack >= node.nearest[i, j]
                alive &= np.maximum(away[:, i] - reach, inner[:, j] - away[:, i]) - slack <= node.farthest[i, j]
            if child < 0:
                found.append((rows[alive], -1 - child))
            else:
                todo.append((child, rows[alive]))
    return (np.concatenate([r for r, _ in found]),
            np.repeat(np.array([leaf for _, leaf in found], np.int64), [len(r) for r, _ in found]))


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    """Vectors stored as little-endian doubles."""
    data = np.frombuffer(b"".join(column.to_pylist()), "<f8")
    return data.reshape(len(column), dimension) if dimension else np.zeros((len(column), 0))


def _column(batch: pa.RecordBatch | pa.Table, name: str) -> pa.Array:
    column = batch.column(batch.schema.get_field_index(name))
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _numbers(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    return _column(batch, name).to_numpy(zero_copy_only=False)


def _scaled(scale: float, dimension: int):
    """Vectors floored to integers and padded to one dimension; those out of range go."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = _column(batch, "vector")
            sizes = np.diff(lists.offsets.to_numpy())
            x = np.zeros((len(lists), dimension))
            at = np.arange(dimension)[None, :] < sizes[:, None]
            x[at] = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), float)
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(x * scale)
                fits = np.sqrt((x * x).sum(1)) <= LONGEST
            part = batch.filter(pa.array(fits))
            data = pa.array([row.astype("<f8").tobytes() for row in x[fits]], pa.binary())
            yield pa.RecordBatch.from_arrays([_column(part, c) for c in ("key", "id", "label", "anchor")] + [data],
                                             names=["key", "id", "label", "anchor", "vector"])
    return run


def _placed(nodes: list[Node], dimension: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, _ = place(nodes, _matrix(_column(batch, "vector"), dimension))
            yield batch.append_column("leaf", pa.array(leaf))
    return run


def _ranges(nodes: list[Node], dimension: int):
    """Of a task's rows the distances of split point ``i`` to subtree ``j``, squared (i = -1: lengths)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], tuple[float, float]] = {}
        for batch in batches:
            x = _matrix(_column(batch, "vector"), dimension)
            lengths = (x * x).sum(1)
            for n, rows, away, side in place(nodes, x)[1]:
                for j in np.unique(side).tolist():
                    own = side == j
                    for i, values in [(-1, lengths[rows[own]]), *enumerate(away[own].T)]:
                        least, most = held.get((n, i, j), (_FAR, -_FAR))
                        held[n, i, j] = min(least, float(values.min())), max(most, float(values.max()))
        keys = list(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[c] for k in keys], pa.int32()) for c in range(3)] + [pa.array([held[k][c] for k in keys], pa.float64()) for c in range(2)],
            names=["node", "i", "j", "least", "most"])
    return run


def _reaching(nodes: list[Node], dimension: int):
    """Anchors at every leaf that any of their windows meets, but the one where they belong."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high = (np.array(_column(batch, c).to_pylist(), float).reshape(batch.num_rows, -1) for c in ("low", "high"))
            a, width = _matrix(_column(batch, "vector"), dimension), low.shape[1]
            row, leaf = survivors(nodes, np.repeat(a, width, axis=0), low.ravel(), high.ravel())
            pairs = np.unique(np.stack([row // max(width, 1), leaf], axis=1), axis=0)
            pairs = pairs[pairs[:, 1] != _numbers(batch, "home")[pairs[:, 0]]]
            for lo in range(0, len(pairs), 4096):
                part = pairs[lo:lo + 4096]
                yield batch.take(pa.array(part[:, 0])).append_column("leaf", pa.array(part[:, 1]))
    return run


def _best(score: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties by smaller key."""
    if len(score) > k:
        near = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return near[np.lexsort((key[near], -score[near]))[:k]]
    return np.lexsort((key, -score))


def _compared(same: bool, k: int, dimension: int):
    """The best rows of a block for each window of each anchor of a block: of the anchor's label, or of others."""
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if len(anchors) and len(rows):
            a, x = (_matrix(_column(t, "vector"), dimension) for t in (anchors, rows))
            key, label, of, own = _numbers(rows, "key"), _numbers(rows, "label"), _numbers(anchors, "key"), _numbers(anchors, "label")
            lows, highs = (_column(anchors, c).to_pylist() for c in ("low", "high"))
            for first in range(0, len(a), 256):
                scores = a[first:first + 256] @ x.T
                for r, score in enumerate(scores, first):
                    fits = np.flatnonzero(((label == own[r]) & (key != of[r])) if same else label != own[r])
                    for window, (low, high) in enumerate(zip(lows[r], highs[r])):
                        within = fits[(score[fits] >= low) & (score[fits] <= high)]
                        best = within[_best(score[within], key[within], k)]
                        out.append((np.full(len(best), of[r]), np.full(len(best), window, np.int32), key[best], score[best].astype(np.int64)))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, t) for t in (np.int64, np.int32, np.int64, np.int64)]
        return pa.table(dict(zip(("anchor", "window", "key", "score"), columns)))
    return run


class Index:
    """Rows by leaf, written once, and the tree with its ranges."""

    def __init__(self, rows: DataFrame, scratch: Scratch):
        self.scratch = scratch
        self.dimension = rows.agg(F.max(F.octet_length("vector"))).first()[0] or 0
        self.dimension //= 8
        sample = rows.select("vector").orderBy(F.xxhash64("key"), "key").limit(SAMPLE).collect()     # at most SAMPLE
        self.nodes = grow(np.array([np.frombuffer(r[0], "<f8") for r in sample]).reshape(len(sample), self.dimension))
        self.rows = rows
        if not self.nodes:
            return
        schema = "key long, id long, label long, anchor boolean, vector binary"
        self.rows = scratch.keep(rows.mapInArrow(_placed(self.nodes, self.dimension), f"{schema}, leaf long"), "leaves")
        # As many rows as the tree has pairs of split points.
        spans = self.rows.mapInArrow(_ranges(self.nodes, self.dimension), "node int, i int, j int, least double, most double") \
            .groupBy("node", "i", "j").agg(F.min("least").alias("least"), F.max("most").alias("most")).collect()
        for node in self.nodes:
            k = len(node.points)
            node.nearest, node.farthest = np.full((k, k), _FAR), np.full((k, k), -_FAR)
            node.shortest, node.longest = np.full(k, _FAR), np.full(k, -_FAR)
        for s in spans:
            node = self.nodes[s["node"]]
            if s["i"] < 0:
                node.shortest[s["j"]], node.longest[s["j"]] = s["least"], s["most"]
            else:
                node.nearest[s["i"], s["j"]], node.farthest[s["i"], s["j"]] = s["least"] ** 0.5, s["most"] ** 0.5
        counts = self.rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
        self.blocks = scratch.keep(counts.select("leaf", F.ceil(F.col("n") / ROWS).alias("row_blocks")), "blocks")

    def compare(self, anchors: DataFrame, same: bool, k: int, name: str) -> DataFrame:
        """(anchor, window, key, score): the best ``k`` rows for each window among the leaves that ``anchors`` names."""
        asked = anchors.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / ANCHORS).alias("anchor_blocks")).join(self.blocks, "leaf")
        sizes = self.scratch.keep(asked, f"{name}-sizes")
        left = anchors.join(sizes, "leaf").select(
            "key", "label", "vector", "low", "high", "leaf", F.pmod(F.xxhash64("key"), F.col("anchor_blocks")).alias("ours"),
            F.explode(F.expr("sequence(0, row_blocks - 1)")).alias("theirs"))
        right = self.rows.join(sizes, "leaf").select(
            "key", "label", "vector", "leaf", F.explode(F.expr("sequence(0, anchor_blocks - 1)")).alias("ours"),
            F.pmod(F.xxhash64("key"), F.col("row_blocks")).alias("theirs"))
        block = ["leaf", "ours", "theirs"]
        return left.groupBy(*block).cogroup(right.groupBy(*block)).applyInArrow(
            _compared(same, k, self.dimension), "anchor long, window int, key long, score long")

    def best(self, anchors: DataFrame, same: bool, k: int, name: str) -> DataFrame:
        """The best ``k`` rows of all for each window of ``anchors`` (key, label, vector, home, low, high): first at home, then
        wherever better ones may be."""
        order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "key")
        top = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        home = self.scratch.keep(top(self.compare(anchors.withColumn("leaf", F.col("home")), same, k, f"{name}-home")), f"{name}-home")
        reached = home.where(F.col("rank") == k).groupBy("anchor").agg(
            F.map_from_entries(F.collect_list(F.struct("window", F.col("score").cast("double").alias("score")))).alias("reached"))
        narrowed = anchors.join(reached.withColumnRenamed("anchor", "key"), "key", "left").withColumn("low", F.expr(
            "transform(low, (l, w) -> greatest(l, coalesce(try_element_at(reached, w), l)))")).drop("reached")
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrowed.schema.fields)
        away = self.scratch.keep(narrowed.mapInArrow(_reaching(self.nodes, self.dimension), f"{schema}, leaf long"), f"{name}-reaching")
        found = home.drop("rank").unionByName(self.compare(away, same, k, f"{name}-away"))
        return self.scratch.keep(top(found), name)


def prepared(rows: DataFrame, scratch: Scratch, *, label: Column, anchor: Column, id_column: str, vector_column: str, scale: float) -> DataFrame:
    """(key, id, label, anchor, vector): rows that take part, with unique keys ascending with the id."""
    read = rows.select(F.col(id_column).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
                       F.col(vector_column).cast("array<double>").alias("vector"))
    # exists() is null where a component is null and no other is out of range
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(_FAR)))
    whole = read.where(F.col("label").isNotNull() & F.col("vector").isNotNull()).where(~odd)
    numbered, key = keyed(whole, scratch, "id", "vector")
    dimension = whole.agg(F.max(F.size("vector"))).first()[0] or 0
    ready = numbered.select(F.col(key).alias("key"), "id", "label", "anchor", "vector")
    return scratch.keep(ready.mapInArrow(_scaled(scale, dimension), "key long, id long, label long, anchor boolean, vector binary"), "rows")


def mine(rows: DataFrame, *, label: Column, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, scale: float = 256.0,
         id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that ``anchor`` selects."""
    scratch = Scratch(rows.sparkSession, "negatives")
    ready = prepared(rows, scratch, label=label, anchor=anchor, id_column=id_column, vector_column=vector_column, scale=scale)
    index = Index(ready, scratch)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not index.nodes:
        return rows.sparkSession.createDataFrame([], schema)
    anchors = scratch.keep(index.rows.where("anchor").select("key", "label", "vector", F.col("leaf").alias("home")), "anchors")
    every = anchors.withColumns({"low": F.array(F.lit(-_FAR)), "high": F.array(F.lit(_FAR))})
    near = index.best(every, True, positives, "positives")
    # The window of every positive, in the order of their ranks.
    windows = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("near")).select(
        F.col("anchor").alias("key"), F.expr(
            f"transform(near, n -> double(({low} * n.score) div 100 + if(({low} * n.score) % 100 > 0, 1, 0)))").alias("low"),
        F.expr("transform(near, n -> double(n.score))").alias("high"))
    far = index.best(anchors.join(windows, "key"), False, negatives, "negatives")
    names = index.rows.select("key", "id")
    pairs = near.select("anchor", F.col("rank").alias("of"), F.col("key").alias("positive"), F.col("score").alias("positive_score")).join(
        far.select("anchor", (F.col("window") + 1).alias("of"), "rank", F.col("key").alias("negative"), F.col("score").alias("negative_score")),
        ["anchor", "of"])
    for column in ("anchor", "positive", "negative"):
        pairs = pairs.join(names.select(F.col("key").alias(column), F.col("id").alias(f"{column}_id")), column)
    return pairs.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
