"""Quality classifier: document evidence combined with site priors by hierarchical empirical Bayes.

Evidence. For each label (low quality, toxic) every feature of a document has a log-odds weight, shrunk toward zero
by ``SHRINK`` imagined documents of the average rate. Features are the document's distinct words and a few binned
statistics. A document's evidence is the sum of its positive weights from ``WEAKEST`` on, and a logistic curve, fitted
on documents that the weights weren't counted on, turns it into a probability.

Sites. The mean probability of a host is shrunk toward the global mean, that of a path toward its host's; the strength
(as a number of documents) comes from the spread of the means beyond what chance gives. Sparse sites take their
parent's rate. A document's posterior log odds are its own plus what its path's rate differs from the global one.

Training uses at most ``MAX_LABELLED`` labelled documents (smallest hashes of ids) and keeps at most ``MAX_FEATURES``
weights; sites are counted over all documents. Null or empty texts have no features; a null host or path is a site
of its own. Without labels nothing is rejected. Columns of the input are carried along, whatever their names, except that
columns with the names of the results are replaced. Repeated and null ids are rows of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kohorte.llm.textops import flat, hashed, released, slices, text_batch

MAX_LABELLED = 20_000
MAX_FEATURES = 20_000
SHRINK, LEAST_SEEN, WEAKEST, MOST = 10.0, 15, 3.0, 12.0
HEADS = ("low", "toxic")

_CAPITAL = np.zeros(256, bool)
_CAPITAL[0x41:0x5B] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?.,;:")] = True


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of the texts one after the other (words as often as they occur), and where each text's begin."""
    raw, at = flat(texts)
    h, offsets = hashed(raw, at)
    n_words, n_bytes = np.diff(offsets), np.maximum(np.diff(at), 1)

    def share(table: np.ndarray, of: np.ndarray) -> np.ndarray:
        # Places of the table's bytes, not running sums over all bytes, which take 16 bytes each.
        return np.diff(np.searchsorted(np.flatnonzero(table[raw]), at)) / of

    words = np.maximum(n_words, 1)
    shapes = np.stack([
        np.minimum(15, np.log2(words)).astype(int),
        (20 * share(_CAPITAL, n_bytes)).astype(int),
        np.minimum(20, 10 * share(_SYMBOL, words)).astype(int),
        np.minimum(20, 10 * share(_MARK, words)).astype(int),
        np.minimum(30, n_bytes / words).astype(int),
        [int(20 * len(np.unique(h[a:b])) / max(b - a, 1)) for a, b in zip(offsets[:-1], offsets[1:])],
    ], axis=1) + 100 * np.arange(6)
    out = np.insert(h, np.repeat(offsets[1:], 6), shapes.astype(np.uint64).ravel())
    return out, offsets + 6 * np.arange(len(offsets))


@dataclass
class Model:
    """Sorted features, their weights for each head, and the curve of each head."""
    keys: np.ndarray
    weights: dict[str, np.ndarray]
    curve: dict[str, tuple[float, float]]

    def evidence(self, texts: pa.Array) -> dict[str, np.ndarray]:
        h, at = features(texts)
        out = {head: np.zeros(len(texts)) for head in HEADS}
        if not len(self.keys) or not len(h):
            return out
        seen = np.zeros(1 << 16, bool)
        seen[self.keys >> np.uint64(48)] = True
        maybe = np.flatnonzero(seen[h >> np.uint64(48)])
        found = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
        same = self.keys[found] == h[maybe]
        row = np.searchsorted(at, maybe[same], side="right") - 1
        once = np.unique(row * len(self.keys) + found[same])
        row, found = once // len(self.keys), once % len(self.keys)
        for head in HEADS:
            out[head] = np.minimum(MOST, np.bincount(row, self.weights[head][found], minlength=len(texts)))
        return out


def _counts(fold: int | None):
    """Of each feature the documents that have it, and those with each label, added up by Arrow batch."""
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(text_batch(batch)):
                low, toxic, part = (batch.column(i).slice(first, len(texts)).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
                h, at = features(texts)
                used = [np.unique(h[a:b]) if part[i] != fold else h[:0] for i, (a, b) in enumerate(zip(at[:-1], at[1:]))]
                owner = np.repeat(np.arange(len(texts)), [len(u) for u in used])
                keys, place = np.unique(np.concatenate(used), return_inverse=True)
                n = np.bincount(place, minlength=len(keys))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64))] + [pa.array(x.astype(np.int64)) for x in (
                        n, np.bincount(place, low[owner], minlength=len(keys)), np.bincount(place, toxic[owner], minlength=len(keys)))],
                    names=["feature", "n", "low", "toxic"])
    return run


def _weights(sample: DataFrame, fold: int | None, rates: dict[str, float]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    shrink, least = SHRINK, LEAST_SEEN
    counted = sample.select("text", "low", "toxic", "part").mapInArrow(_counts(fold), "feature long, n long, low long, toxic long")
    totals = counted.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("n", "low", "toxic")]).where(F.col("n") >= least)

    def weight(head: str) -> Column:
        rate = rates[head]
        odds = (F.col(head) + shrink * rate) / (F.col("n") - F.col(head) + shrink * (1 - rate))
        return F.log(odds) - math.log(rate / (1 - rate))

    weighed = totals.select("feature", *[F.when(weight(h) >= WEAKEST, weight(h)).otherwise(0.0).alias(h) for h in HEADS])
    best = weighed.withColumn("most", F.greatest(*HEADS)).where("most > 0").orderBy(F.desc("most"), "feature").limit(MAX_FEATURES)
    rows = best.collect()       # at most MAX_FEATURES
    keys = np.array([r["feature"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], {h: np.array([r[h] for r in rows], float)[order] for h in HEADS}


def _scores(model: Model):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(text_batch(batch)):
                found = model.evidence(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(first, len(texts)), batch.column(2).slice(first, len(texts)),
                     *[pa.array(found[h]) for h in HEADS]], names=["low", "toxic", "e_low", "e_toxic"])
    return run


def _logistic(x: np.ndarray, n: np.ndarray, bad: np.ndarray, rate: float) -> tuple[float, float]:
    """Intercept and slope by Newton steps, with a weak pull of the slope toward 1."""
    a, b = math.log(rate / (1 - rate)) - 1.0, 1.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-(a + b * x)))
        g = np.array([(bad - n * p).sum(), (x * (bad - n * p)).sum() - (b - 1)])
        w = n * p * (1 - p)
        hess = np.array([[w.sum() + 1e-6, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1]])
        step = np.clip(np.linalg.solve(hess, g), -2, 2)
        a, b = a + step[0], b + step[1]
    return float(a), float(b)


def train(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> Model | None:
    """Weights and curves from labelled documents (quality 0 is low); None without labels."""
    picked = labels.where(F.col(id_column).isNotNull()).groupBy(id_column).agg(F.min("quality").alias("q"), F.max("toxic").alias("t")) \
        .where("q is not null and t is not null").orderBy(F.xxhash64(id_column), id_column).limit(MAX_LABELLED)
    sample = docs.select(id_column, F.col(text_column).alias("text")).join(F.broadcast(picked), id_column).select(
        F.coalesce("text", F.lit("")).alias("text"), (F.col("q") == 0).cast("int").alias("low"), (F.col("t") == 1).cast("int").alias("toxic"),
        F.pmod(F.xxhash64(id_column, F.lit(3)), F.lit(2)).cast("int").alias("part"))
    total = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("low").alias("low"), F.sum("toxic").alias("toxic")).first()
    if not total["n"]:
        return None
    rates = {h: (total[h] + 0.5) / (total["n"] + 1) for h in HEADS}
    # The curve: weights from one half, evidence on the other.
    half = Model(*_weights(sample, 1, rates), curve={})
    scored = sample.where("part = 1").select("text", "low", "toxic").mapInArrow(_scores(half), "low int, toxic int, e_low double, e_toxic double")
    curve = {}
    for head in HEADS:
        bins = scored.groupBy(F.round(F.col(f"e_{head}") * 4).alias("x")).agg(F.count(F.lit(1)).alias("n"), F.sum(head).alias("bad")).collect()
        curve[head] = _logistic(*(np.array([float(r[c]) for r in bins]) / (4 if c == "x" else 1) for c in ("x", "n", "bad")), rates[head])
    return Model(*_weights(sample, None, rates), curve)


def _logits(model: Model, names: list[str], text_column: str):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(text_batch(batch, text_column)):
                found = model.evidence(texts)
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index(n)) for n in names]
                    + [pa.array(model.curve[h][0] + model.curve[h][1] * found[h]) for h in HEADS],
                    names=names + [f"logit_{h}" for h in HEADS])
    return run


def with_logits(docs: DataFrame, model: Model, *, keep: list[str], text_column: str = "text") -> DataFrame:
    """``keep`` columns of every document and its log odds by text alone, for each head."""
    used = docs.select(*dict.fromkeys([*keep, text_column]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in used.select(*keep).schema.fields)
    return used.mapInArrow(_logits(model, keep, text_column), ", ".join([schema, *[f"logit_{h} double" for h in HEADS]]))


def _probability(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(head: str, parent: Column) -> Column:
    """Documents that a site's parent counts as, from the spread of the sites' means (method of moments)."""
    n, mean = F.col("n"), F.col(f"sum_{head}") / F.col("n")
    inner = F.sum(F.when(n > 1, F.col(f"sq_{head}") - n * mean * mean).otherwise(0)) / F.greatest(F.sum(n - 1), F.lit(1))
    outer = F.greatest(F.sum(n * (mean - parent) ** 2) / F.sum("n") - inner * F.count(F.lit(1)) / F.sum("n"), F.lit(1e-9))
    return F.least(F.greatest(inner / outer, F.lit(1.0)), F.lit(1e9)).alias(f"k_{head}")


def site_rates(logits: DataFrame, host: str, path: str) -> DataFrame:
    """(host, path, n, and for each head global_, host_ and path_ rates) of every host and path."""
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(_probability(F.col(f"logit_{h}"))).alias(f"sum_{h}") for h in HEADS],
            *[F.sum(_probability(F.col(f"logit_{h}")) ** 2).alias(f"sq_{h}") for h in HEADS]]
    paths = logits.groupBy(F.col(host).alias("host"), F.col(path).alias("path")).agg(*sums)
    columns = ["n", *[f"{x}_{h}" for x in ("sum", "sq") for h in HEADS]]
    hosts = paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in columns])
    world = hosts.agg(*[F.sum(c).alias(c) for c in columns]).select(
        *[(F.col(f"sum_{h}") / F.col("n")).alias(f"global_{h}") for h in HEADS])
    at_host = hosts.crossJoin(F.broadcast(world))       # one row
    k = at_host.agg(*[_strength(h, F.col(f"global_{h}")) for h in HEADS])
    shrunk = at_host.crossJoin(F.broadcast(k)).select(
        "host", *[f"global_{h}" for h in HEADS],
        *[((F.col(f"sum_{h}") + F.col(f"k_{h}") * F.col(f"global_{h}")) / (F.col("n") + F.col(f"k_{h}"))).alias(f"host_{h}") for h in HEADS])
    at_path = paths.withColumnRenamed("host", "__host").join(shrunk, F.col("__host").eqNullSafe(F.col("host"))).drop("__host")
    k = at_path.agg(*[_strength(h, F.col(f"host_{h}")) for h in HEADS])
    return at_path.crossJoin(F.broadcast(k)).select(
        "host", "path", F.col("n").alias("n_site"), *[f"global_{h}" for h in HEADS], *[f"host_{h}" for h in HEADS],
        *[((F.col(f"sum_{h}") + F.col(f"k_{h}") * F.col(f"host_{h}")) / (F.col("n") + F.col(f"k_{h}"))).alias(f"path_{h}") for h in HEADS])


def judged(docs: DataFrame, labels: DataFrame, *, host: str = "source", path: str = "lang", id_column: str = "doc_id",
           text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all, if not named) of every document with p_low, p_toxic, site_low, site_toxic and kept."""
    results = [*[f"{x}_{h}" for x in ("p", "site") for h in HEADS], "kept"]
    docs = docs.drop(*results)
    keep = [c for c in keep or docs.columns if c not in results]
    model = train(docs, labels, id_column=id_column, text_column=text_column)
    if model is None:
        return docs.select(*keep, *[F.lit(None).cast("double").alias(c) for c in results[:-1]], F.lit(True).alias("kept"))
    # Numbered names inside, so that no column of the input clashes with one of the working columns.
    inner = {f"keep{i}": c for i, c in enumerate(keep)}
    # A text that is kept goes through the workers once.
    text = next((n for n, c in inner.items() if c == text_column), "own_text")
    alone = [F.col(text_column).alias(text)] if text not in inner else []
    own = docs.select(*[F.col(c).alias(n) for n, c in inner.items()], F.col(host).alias("own_host"), F.col(path).alias("own_path"), *alone)
    sites = site_rates(with_logits(own, model, keep=["own_host", "own_path"], text_column=text), "own_host", "own_path")
    scored = with_logits(own, model, keep=[*inner, "own_host", "own_path"], text_column=text)
    both = scored.join(sites, F.col("own_host").eqNullSafe(F.col("host")) & F.col("own_path").eqNullSafe(F.col("path")), "left")
    clamp = lambda c: F.least(F.greatest(F.col(c), F.lit(1e-6)), F.lit(1 - 1e-6))
    out = both.select(*[F.col(n).alias(c) for n, c in inner.items()],
                      *[_probability(F.col(f"logit_{h}") + _logit(clamp(f"path_{h}")) - _logit(clamp(f"global_{h}"))).alias(f"p_{h}") for h in HEADS],
                      *[F.col(f"path_{h}").alias(f"site_{h}") for h in HEADS])
    return out.withColumn("kept", (F.col("p_low") <= 0.5) & (F.col("p_toxic") <= 0.5))
