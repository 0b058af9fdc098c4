"""Toxicity: a factorization machine over hashed terms.

Terms of a text are its distinct words (letters and digits, A-Z lower-cased) and the first four and five bytes of longer words,
each as a 64-bit hash; so are compounds of a known beginning. A text's logit is w0 + the sum of its terms' weights + the
sum over all pairs of its terms of the products of their factors, which is half of |sum of factors|^2 - sum of |factors|^2: linear in the
number of terms. Pairs such as an insult with the mention of a group get weight that no sum of single weights can have.

Training takes at most ``MAX_LABELLED`` labelled rows (smallest hashes of ids); equal texts with equal labels count once.
Terms in fewer than ``LEAST_SEEN`` of them have no weight. In each round tasks add up gradients and curvatures over their
documents; the driver adds the tasks' sums, as many numbers as terms are beyond chance, and takes a diagonal Newton step with a
threshold: what is within ``NOISE`` standard errors of chance stays at zero, for weights and factors alike. The weights
come first, then factors grow from small values at the terms that have weights. A round that raises the penalised loss is taken
back and the steps are halved. The last rounds fit the terms that are left without thresholds.

Scoring reads only the text. Null and empty texts have no terms and the score of w0. A row with a null id is never learned
from, and counts as held out, as its id is read as the empty text. Repeated ids are rows of their own and share their
label; of several labels of an id the highest counts, a null label is none. Without labelled rows all scores are 0. Other
columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kohorte.llm.scratch import Scratch
from kohorte.llm.textops import NON_ALNUM, flat, hashed, mix, slices, text_batch

MAX_LABELLED = 20_000
LEAST_SEEN, NOISE, RIDGE = 5, 3.0, 0.5
FACTORS, SPREAD = 4, 0.2
LINEAR_ROUNDS, ROUNDS, RELAXED = 30, 20, 16
SHARDS = 8
_HEADS = 1 << 20        # a table of the keys' first 20 bits
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[0x41:0x5B] += np.uint64(0x20)


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of the texts, as often as they occur, and the text of each."""
    raw, at = flat(texts)
    h, offsets, starts, stops = hashed(raw, at, NON_ALNUM, spans=True)
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    hashes, rows = [h], [row]
    code = np.zeros(len(starts), np.uint64)
    for j in range(5):
        long = stops - starts > max(j, 3)
        code, starts, stops, row = code[long], starts[long], stops[long], row[long]
        code = code + (_LOWER[raw[starts + j]] << np.uint64(8 * j))
        if j >= 3:
            longer = stops - starts > j + 1
            hashes.append(mix(code[longer] * np.uint64(16) + np.uint64(j)))
            rows.append(row[longer])
    return np.concatenate(hashes), np.concatenate(rows)


def _lookup(keys: np.ndarray, heads: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, place among ``keys``) of every distinct known term, ordered."""
    h, row = terms(texts)
    if not len(keys) or not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    maybe = heads[h >> np.uint64(44)]
    h, row = h[maybe], row[maybe]
    found = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    same = keys[found] == h
    return np.divmod(np.unique(row[same].astype(np.int64) * len(keys) + found[same]), len(keys))


def _heads(keys: np.ndarray) -> np.ndarray:
    heads = np.zeros(_HEADS, bool)
    heads[keys >> np.uint64(44)] = True
    return heads


@dataclass
class Model:
    """Sorted hashes of the terms with weights or factors."""
    keys: np.ndarray
    intercept: float
    weights: np.ndarray
    factors: np.ndarray

    def logits(self, row: np.ndarray, term: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Logits of ``n`` texts with those terms, and the sums of their factors."""
        own = self.factors[term]
        sums = np.stack([np.bincount(row, own[:, k], minlength=n) for k in range(own.shape[1])], axis=1) if own.shape[1] else np.zeros((n, 0))
        pairs = (sums * sums).sum(1) - np.bincount(row, (own * own).sum(1), minlength=n)
        return self.intercept + np.bincount(row, self.weights[term], minlength=n) + pairs / 2, sums

    def used(self) -> "Model":
        """Without the terms that have neither."""
        some = (self.weights != 0) | (self.factors != 0).any(1)
        return Model(self.keys[some], self.intercept, self.weights[some], self.factors[some])

    def scores(self, texts: pa.Array, heads: np.ndarray) -> np.ndarray:
        logit, _ = self.logits(*_lookup(self.keys, heads, texts), len(texts))
        return _probability(logit)


def _probability(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def _distinct(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of the texts, ordered, and of each text that has one: the term's place and the text."""
    h, row = terms(texts)
    order = np.lexsort((row, h))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    keys, place = np.unique(h[new], return_inverse=True)
    return keys, place, row[new]


_TOTALS = ["n", "gradient", *[f"g{k}" for k in range(FACTORS)], *[f"s{k}" for k in range(FACTORS)]]


def _totals(model: "Model"):
    """Of every term the texts that have it, the gradient of its weight, and for each factor gradient and squared slope at zero."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = _heads(model.keys)
        for batch in batches:
            for first, texts in slices(text_batch(batch), 16 << 20):
                logit, sums = model.logits(*_lookup(model.keys, heads, texts), len(texts))
                residual = batch.column(0).slice(first, len(texts)).to_numpy(zero_copy_only=False) - _probability(logit)
                keys, place, row = _distinct(texts)
                if not sums.shape[1]:
                    sums = np.zeros((len(texts), FACTORS))
                values = [np.ones(len(texts)), residual, *(residual[:, None] * sums).T, *(sums**2).T]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), *[pa.array(np.bincount(place, v[row], minlength=len(keys))) for v in values]],
                    names=["term", *_TOTALS])
    return run


def _known(keys: np.ndarray):
    """The label and the known terms of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = _heads(keys)
        for batch in batches:
            for first, texts in slices(text_batch(batch)):
                row, term = _lookup(keys, heads, texts)
                at = np.searchsorted(row, np.arange(len(texts) + 1))
                data = [term[a:b].astype("<i4").tobytes() for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(data, pa.binary())], names=["toxic", "terms"])
    return run


_SUMS = "documents long, loss double, residual double, curvature double, weights binary, factors binary"


def _gradient(model: Model, moving: np.ndarray, drifting: np.ndarray):
    """A task's sums: the loss, and for the intercept and every weight and factor the gradient and a bound of the curvature.

    Coordinates move at the same time, so a document's curvature counts once for each of its ``moving`` terms
    (``drifting`` ones for factors). The third sum is the squared slope, from which chance follows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, k = model.factors.shape
        total, weights, factors = np.zeros(4), np.zeros((3, size)), np.zeros((3, k, size))
        for batch in batches:
            for first, held in slices(batch.column(1), 1 << 21):
                raw, at = flat(held)
                term, n = raw.view("<i4").astype(np.int64), len(held)
                row = np.repeat(np.arange(n), np.diff(at) // 4)
                y = batch.column(0).slice(first, n).to_numpy(zero_copy_only=False)
                logit, sums = model.logits(row, term, n)
                p = _probability(logit)
                r, c = y - p, p * (1 - p)
                c_w = c * (1 + np.bincount(row, moving[term], minlength=n))
                total += [n, -np.log(np.maximum(np.where(y == 1, p, 1 - p), 1e-12)).sum(), r.sum(), c_w.sum()]
                weights += [np.bincount(term, x, minlength=size) for x in (r[row], c_w[row], np.ones(len(row)))]
                if k:
                    linked = (sums != 0).any(1)[row]
                    row, term = row[linked], term[linked]
                    c_v = c * (1 + np.bincount(row, drifting[term], minlength=n))
                    for j in range(k):
                        slope = sums[row, j] - model.factors[term, j]
                        factors[:, j] += [np.bincount(term, x, minlength=size) for x in (r[row] * slope, c_v[row] * slope**2, slope**2)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(total[0])]), *[pa.array([x]) for x in total[1:]], pa.array([weights.tobytes()]), pa.array([factors.tobytes()])],
            names=["documents", "loss", "residual", "curvature", "weights", "factors"])
    return run


def _moved(now: np.ndarray, gradient: np.ndarray, curvature: np.ndarray, threshold: np.ndarray, pace: float) -> np.ndarray:
    """A Newton step on each coordinate, then toward zero by the threshold; steps of at most one."""
    scale = curvature + RIDGE
    goal = now + (gradient - RIDGE * now) / scale
    goal = np.sign(goal) * np.maximum(np.abs(goal) - threshold / scale, 0)
    moved = now + np.clip(pace * (goal - now), -1, 1)
    return np.where((goal == 0) & (np.abs(moved) < 1e-2), 0.0, moved)


def _sums(shards: DataFrame, model: Model, moving: np.ndarray, drifting: np.ndarray) -> tuple:
    size, width = model.factors.shape
    rows = shards.select("toxic", "terms").mapInArrow(_gradient(model, moving, drifting), _SUMS).where("documents > 0").collect()   # a row a task
    return (sum(r["loss"] for r in rows), sum(r["residual"] for r in rows), sum(r["curvature"] for r in rows),
            sum(np.frombuffer(r["weights"]).reshape(3, size) for r in rows),
            sum(np.frombuffer(r["factors"]).reshape(3, width, size) for r in rows))


def _descended(shards: DataFrame, model: Model, spread: float, rounds: int) -> Model:
    """The model after some rounds; ``spread``: the threshold for a squared slope of one."""
    moving, drifting = model.weights != 0, (model.factors != 0).any(1)
    pace, best = 1.0, None
    for _ in range(rounds):
        loss, *sums = _sums(shards, model, moving, drifting)
        noise = spread * np.sqrt(sums[2][2])
        loss += RIDGE / 2 * ((model.weights**2).sum() + (model.factors**2).sum()) + noise @ np.abs(model.weights)
        if best is not None and loss > best[0]:
            pace /= 2
            _, model, sums, moving, drifting = best
        else:
            best = (loss, model, sums, moving, drifting)
        residual, curvature, w, v = sums
        factors = model.factors
        if factors.shape[1]:
            chance = spread * np.sqrt(v[2])
            factors = np.where(drifting[:, None], _moved(factors.T, v[0], v[1], chance, pace).T, factors)
            drifting = (factors != 0).any(1) | (np.abs(v[0]) > chance).any(0)
        weights = np.where(moving, _moved(model.weights, w[0], w[1], noise, pace), model.weights)
        moving = (weights != 0) | (np.abs(w[0]) > noise)
        model = Model(model.keys, model.intercept + pace * residual / (curvature + RIDGE), weights, factors)
    return best[1]


def fit(sample: DataFrame, scratch: Scratch, documents: int, toxic: int) -> Model:
    """The machine from (toxic, text) rows.

    Sums over all terms are taken twice, at the start and after the weights; only terms that are beyond chance come out of them, and the
    rounds go over those.
    """
    rate = (toxic + 0.5) / (documents + 1)
    spread = NOISE * math.sqrt(rate * (1 - rate))

    def beyond(model: Model) -> Model:
        """The model with all terms that are beyond chance where it stands."""
        schema = ", ".join(["term long", *[f"{c} double" for c in _TOTALS]])
        totals = sample.mapInArrow(_totals(model), schema).groupBy("term").agg(*[F.sum(c).alias(c) for c in _TOTALS])
        odd = [F.abs("gradient") > spread * F.sqrt("n"), *[F.abs(f"g{k}") > spread * F.sqrt(f"s{k}") for k in range(FACTORS)]]
        found = totals.where((F.col("n") >= LEAST_SEEN) & functools.reduce(Column.__or__, odd)).select("term").toArrow()
        keys = np.union1d(found["term"].to_numpy().astype(np.int64).view(np.uint64), model.keys)
        weights, factors, place = np.zeros(len(keys)), np.zeros((len(keys), model.factors.shape[1])), np.searchsorted(keys, model.keys)
        weights[place], factors[place] = model.weights, model.factors
        return Model(keys, model.intercept, weights, factors)

    def descended(model: Model, rounds: int, name: str, held: float = 1.0) -> Model:
        few = scratch.keep(sample.mapInArrow(_known(model.keys), "toxic int, terms binary"), name)
        return _descended(few, model, held * spread, rounds)

    model = beyond(Model(np.zeros(0, np.uint64), math.log(rate / (1 - rate)), np.zeros(0), np.zeros((0, 0))))
    model = descended(model, LINEAR_ROUNDS, "weights").used()
    # Factors begin at the terms with weights, apart from each other by their hashes.
    start = np.stack([mix(model.keys + np.uint64(j + 1)).astype(float) / 2**63 - 1 for j in range(FACTORS)], axis=1)
    model = descended(beyond(Model(model.keys, model.intercept, model.weights, SPREAD * start)), ROUNDS, "factors").used()
    # What chance can't explain is known now: its size is fitted without thresholds.
    return descended(model, RELAXED, "sizes", held=0.0).used()


def _fold(name: Column, folds: int) -> Column:
    return F.crc32(F.coalesce(name.cast("string"), F.lit("")).cast("binary")) % folds


def train(docs: DataFrame, labels: DataFrame, scratch: Scratch, *, learn: Column | None = None, id_column: str = "doc_id",
          text_column: str = "text") -> Model | None:
    """The machine of the labelled documents that ``learn`` (a condition on the id) allows; None without any."""
    allowed = labels.where(F.col(id_column).isNotNull() & F.col("toxic").isNotNull()).where(F.lit(True) if learn is None else learn)
    picked = scratch.keep(allowed.groupBy(id_column).agg((F.max("toxic") == 1).cast("int").alias("toxic"))
                          .orderBy(F.xxhash64(id_column), id_column).limit(MAX_LABELLED), "picked")
    sample = docs.select(id_column, F.coalesce(text_column, F.lit("")).alias("text")).join(F.broadcast(picked), id_column)
    sample = scratch.keep(sample.dropDuplicates(["toxic", "text"]).select("toxic", "text").repartition(SHARDS, F.xxhash64("text")), "sample")
    size = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic")).first()
    return fit(sample, scratch, size["n"], size["toxic"]) if size["n"] else None


def _scored(model: Model | None, id_column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = _heads(model.keys)
        for batch in batches:
            for first, texts in slices(text_batch(batch)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(model.scores(texts, heads))],
                                                 names=[id_column, "score"])
    return run


def score(docs: DataFrame, model: Model | None, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, score, predicted) of every document: its probability of being toxic, and whether that is at least a half."""
    if model is None:
        found = docs.select(id_column, F.lit(0.0).alias("score"))
    else:
        kind = docs.schema[id_column].dataType.simpleString()
        found = docs.select(id_column, F.col(text_column).alias("text")).mapInArrow(_scored(model, id_column), f"`{id_column}` {kind}, score double")
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out_scores(docs: DataFrame, labels: DataFrame, *, folds: int = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, held_out, score, predicted): ids whose crc32 leaves 0 on division by ``folds`` are held out of training."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    model = train(docs, labels, scratch, learn=_fold(F.col(id_column), folds) != 0, id_column=id_column, text_column=text_column)
    scratch.drop()
    scored = score(docs, model, id_column=id_column, text_column=text_column)
    return scored.select(id_column, (_fold(F.col(id_column), folds) == 0).alias("held_out"), "score", "predicted")
