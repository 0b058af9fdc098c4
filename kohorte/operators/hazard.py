"""Segment hazard model: churn probability by segment and month of tenure.

logit p = segment effect + month effect, segment effects ~ N(0, 1.5), month effects a random walk with step 0.2
from a flat start, events binomial in the number at risk. :func:`segment_hazard` gives the posterior mode by Newton steps,
:func:`segment_posterior` means and intervals.

Given the month effects each segment's own effect is a problem in one number, solved where the segment's rows are. What
is left is a system in the months alone: a tridiagonal matrix (the walk and the summed curvatures) less one outer
product for each segment. The outer products stay in factored form, of at most ``RANK`` columns, in the tasks, where they are
merged, and on the driver. What a longer product would have beyond that is left out of the matrix, not out of the gradient: steps get
shorter, the mode stays the same. Nothing is months x months, and the driver never sees a list of segments.

Means. Month effects are drawn from the normal distribution at the mode; each segment adds the log of the ratio of its true
likelihood, its own effect integrated out, to a draw's weight, summed over segments in Spark. Weighted draws have the true
posterior, so skewed segments are right as well. Given a draw, a segment's effect has a distribution in one number, whose mean is
integrated and from which one value a draw is taken, seeded by the segment's name.

These functions run jobs while they build their result, as they iterate; they store the life table once (``session.cut_lineage``).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohorte.session import cut_lineage

INNER_STEPS = 60
RANK = 32       # columns of a factor
NODES = 25      # of the integral over a segment's effect


@dataclass(frozen=True)
class HazardFit:
    """Month effects (0 to the last observed month) of a fit over segments with prior deviation ``segment_sd``."""
    months: np.ndarray
    segment_sd: float
    by_segment: DataFrame
    matrix: Walk
    step_sd: float


def _own_effect(v: np.ndarray, n: np.ndarray, y: np.ndarray, precision: float) -> tuple[float, np.ndarray]:
    """A segment's effect given the month effects ``v``, and its churn probabilities."""
    effect = 0.0
    for _ in range(INNER_STEPS):
        p = 1 / (1 + np.exp(-(effect + v)))
        step = ((y - n * p).sum() - precision * effect) / ((n * p * (1 - p)).sum() + precision)
        effect += float(np.clip(step, -2, 2))
        if abs(step) < 1e-12:
            break
    return effect, 1 / (1 + np.exp(-(effect + v)))


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for cells in batch.column(batch.schema.get_field_index("cells")):
        at, n, y = (np.array([c[name] for c in cells.as_py()], float) for name in ("month", "n_risk", "n_event"))
        yield at.astype(int), n, y


def _narrowed(columns: np.ndarray) -> np.ndarray:
    """At most ``RANK`` columns (as many as rows) with the most of ``columns @ columns.T``; never more than it."""
    most = min(RANK, len(columns))
    if columns.shape[1] <= most:
        return columns
    size, turn = np.linalg.eigh(columns.T @ columns)
    return columns @ turn[:, np.argsort(size)[-most:]]


def _sums(months: np.ndarray, precision: float):
    """A task's sums: gradient, curvatures, and the factor of its segments' outer products, their own effects eliminated."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(months)
        gradient, curvature, factor, held = np.zeros(size), np.zeros(size), np.zeros((size, 0)), []
        for batch in batches:
            for at, n, y in _rows(batch):
                _, p = _own_effect(months[at], n, y, precision)
                w = n * p * (1 - p)
                gradient[at] += y - n * p
                curvature[at] += w
                column = np.zeros(size)
                column[at] = w / np.sqrt(w.sum() + precision)
                held.append(column)
                if len(held) >= RANK:
                    factor, held = _narrowed(np.column_stack([factor, *held])), []
        factor = _narrowed(np.column_stack([factor, *held]))
        yield _packed(gradient, curvature, factor)
    return run


_PACKED = "gradient binary, curvature binary, factor binary"


def _packed(gradient: np.ndarray, curvature: np.ndarray, factor: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in (gradient, curvature, factor)],
                                      names=["gradient", "curvature", "factor"])


def _unpacked(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of the gradients and curvatures of some rows, and their factors merged."""
    gradient, curvature, factor = 0.0, 0.0, None
    for r in rows:
        own = np.frombuffer(r["gradient"])
        columns = np.frombuffer(r["factor"]).reshape(len(own), -1)
        gradient, curvature = gradient + own, curvature + np.frombuffer(r["curvature"])
        factor = columns if factor is None else _narrowed(np.column_stack([factor, columns]))
    return gradient, curvature, factor


def _merged(table: pa.Table) -> pa.Table:
    return pa.Table.from_batches([_packed(*_unpacked(table.to_pylist()))])


class Walk:
    """The months' matrix: tridiagonal less ``factor @ factor.T``, through the tridiagonal part's Cholesky factor."""

    def __init__(self, curvature: np.ndarray, factor: np.ndarray, step_sd: float):
        size, link = len(curvature), step_sd ** -2
        diagonal = curvature + link * (np.minimum(np.arange(size), 1) + np.minimum(np.arange(size)[::-1], 1))
        self.below, self.own = np.zeros(size), np.zeros(size)       # of the factor: left of the diagonal, and on it
        for m in range(size):
            self.below[m] = -link / self.own[m - 1] if m else 0.0
            self.own[m] = np.sqrt(max(diagonal[m] - self.below[m] ** 2, 1e-12))
        self.turn, scale, _ = np.linalg.svd(self._down(factor), full_matrices=False)
        self.left = np.maximum(1 - scale ** 2, 1e-12)

    def _down(self, x: np.ndarray) -> np.ndarray:
        x = np.array(x, float)
        for m in range(len(x)):
            x[m] = (x[m] - (self.below[m] * x[m - 1] if m else 0.0)) / self.own[m]
        return x

    def _up(self, x: np.ndarray) -> np.ndarray:
        x = np.array(x, float)
        for m in range(len(x) - 1, -1, -1):
            x[m] = (x[m] - (self.below[m + 1] * x[m + 1] if m + 1 < len(x) else 0.0)) / self.own[m]
        return x

    def solve(self, x: np.ndarray) -> np.ndarray:
        y = self._down(x)
        return self._up(y + self.turn @ ((1 / self.left - 1) * (self.turn.T @ y)))

    def square(self, x: np.ndarray) -> np.ndarray:
        """x.T @ matrix @ x of each column, through its parts."""
        y = self.own[:, None] * x
        y[:-1] += self.below[1:, None] * x[1:]
        return (y * y).sum(0) - ((1 - self.left)[:, None] * (self.turn.T @ y) ** 2).sum(0)

    def spread(self, z: np.ndarray) -> np.ndarray:
        """Standard normal columns turned into columns whose precision is the matrix."""
        return self._up(z + self.turn @ ((self.left ** -0.5 - 1)[:, None] * (self.turn.T @ z)))


def _bent(months: np.ndarray, step_sd: float) -> np.ndarray:
    """The walk's matrix times the months."""
    steps = np.diff(months) / step_sd ** 2
    return np.concatenate([[0.0], steps]) - np.concatenate([steps, [0.0]])


def fit_segment_hazard(life_table: DataFrame, segment: str = "user_segment", *, segment_sd: float = 1.5,
                       step_sd: float = 0.2, most_steps: int = 100) -> HazardFit:
    """Posterior mode from a life table (segment, month, n_risk, n_event), which is written once."""
    cells = F.struct("month", "n_risk", "n_event")
    by_segment = cut_lineage(life_table.where(F.col("n_risk") > 0).groupBy(segment).agg(F.collect_list(cells).alias("cells")))
    last = by_segment.select(F.max(F.array_max("cells.month"))).first()[0]
    if last is None:
        raise ValueError("the life table is empty")
    total = by_segment.select(F.explode("cells").alias("c")).agg(F.sum("c.n_event"), F.sum("c.n_risk")).first()
    share = (total[0] + 0.5) / (total[1] + 1)
    months = np.full(int(last) + 1, float(np.log(share / (1 - share))))
    for _ in range(most_steps):
        given = by_segment.select("cells").mapInArrow(_sums(months, segment_sd ** -2), _PACKED)
        # Merged in tasks first, so that few factors reach the driver.
        some = given.withColumn("group", F.expr("spark_partition_id() div 16")).groupBy("group").applyInArrow(_merged, _PACKED)
        gradient, curvature, factor = _unpacked(r.asDict() for r in some.toLocalIterator())
        matrix = Walk(curvature, factor, step_sd)
        step = matrix.solve(gradient - _bent(months, step_sd))
        months = months + step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-300))
        if np.abs(step).max() < 1e-9:
            break
    return HazardFit(months, segment_sd, by_segment, matrix, step_sd)


def segment_hazard(life_table: DataFrame, segment: str = "user_segment", **fit_options) -> DataFrame:
    """(segment, month 0..longest tenure of all segments) -> modelled churn probability ``hazard``."""
    fit = fit_segment_hazard(life_table, segment, **fit_options)
    months, precision = fit.months, fit.segment_sd ** -2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            curves = []
            for at, n, y in _rows(batch):
                effect, _ = _own_effect(months[at], n, y, precision)
                curves.append(1 / (1 + np.exp(-(effect + months))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(curves, pa.list_(pa.float64()))], names=["segment", "curve"])

    kind = fit.by_segment.schema[segment].dataType.simpleString()
    curves = fit.by_segment.select(F.col(segment).alias("segment"), "cells").mapInArrow(run, f"segment {kind}, curve array<double>")
    return curves.select(F.col("segment").alias(segment), F.posexplode("curve").alias("month", "hazard")) \
        .withColumn("month", F.col("month").cast("bigint"))


def _integrated(draws: np.ndarray, n: np.ndarray, y: np.ndarray, precision: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each draw (column) of a segment's months: the log likelihood with the segment's effect integrated out, and nodes and weights
    of the effect's distribution."""
    effect = np.zeros(draws.shape[1])
    for _ in range(INNER_STEPS):
        p = 1 / (1 + np.exp(-(effect + draws)))
        bend = (n[:, None] * p * (1 - p)).sum(0) + precision
        step = ((y[:, None] - n[:, None] * p).sum(0) - precision * effect) / bend
        effect = effect + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-10:
            break
    t, w = np.polynomial.hermite_e.hermegauss(NODES)
    scale = bend ** -0.5
    nodes = effect + scale * t[:, None]                                      # nodes x draws
    logit = nodes[:, None, :] + draws[None, :, :]
    log = (y[:, None] * logit - n[:, None] * np.logaddexp(0, logit)).sum(1) - precision * nodes ** 2 / 2
    log = log + t[:, None] ** 2 / 2 + np.log(w)[:, None]
    top = log.max(0)
    weight = np.exp(log - top)
    total = weight.sum(0)
    return np.log(total) + top + np.log(scale), nodes, weight / total


def _likelihood(draws: np.ndarray, precision: float):
    """The sum over a task's segments of each draw's log likelihood."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(draws.shape[1])
        for batch in batches:
            for at, n, y in _rows(batch):
                total += _integrated(draws[at], n, y, precision)[0]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["draw", "log"])
    return run


def segment_posterior(life_table: DataFrame, segment: str = "user_segment", *, draws: int = 2000, seed: int = 7, **fit_options) -> DataFrame:
    """(segment, month 0..longest tenure of all segments) -> ``hazard`` at the posterior mean of the logit, and the bounds ``low`` and ``high`` of the
    95 % interval of the churn probability. Tasks and the driver hold ``draws`` values a month."""
    fit = fit_segment_hazard(life_table, segment, **fit_options)
    precision, size = fit.segment_sd ** -2, len(fit.months)
    away = fit.matrix.spread(np.random.default_rng(seed).normal(size=(size, draws)))
    months = fit.months[:, None] + away
    found = fit.by_segment.select("cells").mapInArrow(_likelihood(months, precision), "draw int, log double").groupBy("draw").agg(
        F.sum("log").alias("log")).collect()        # a number a draw
    log = np.zeros(draws)
    log[[r["draw"] for r in found]] = [r["log"] for r in found]
    # Less the density they were drawn from, in which the walk's part is the matrix's tridiagonal one less the factor.
    log += -0.5 * (np.diff(months, axis=0) ** 2).sum(0) / fit.step_sd ** 2 + 0.5 * fit.matrix.square(away)
    share = np.exp(log - log.max())
    share = share / share.sum()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], []]
            names = batch.column(0).to_pylist()
            for name, (at, n, y) in zip(names, _rows(batch)):
                _, nodes, weight = _integrated(months[at], n, y, precision)
                mean = (share * (nodes * weight).sum(0)).sum() + months @ share
                random = np.random.default_rng([seed, zlib.crc32(repr(name).encode())])
                # Between the nodes the effect's distribution is taken as normal with its own mean and spread.
                centre = (nodes * weight).sum(0)
                spread = np.sqrt(np.maximum((nodes ** 2 * weight).sum(0) - centre ** 2, 0))
                effect = centre + spread * random.normal(size=len(share))
                order = np.argsort(months + effect, axis=1)
                sums = share[order].cumsum(axis=1)
                logits = np.take_along_axis(months + effect, order, axis=1)
                bounds = [logits[np.arange(size), np.minimum((sums < q).sum(1), len(share) - 1)] for q in (0.025, 0.975)]
                for column, logit in zip(columns, (mean, *bounds)):
                    column.append(1 / (1 + np.exp(-logit)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.list_(pa.float64())) for c in columns]],
                                             names=["segment", "hazard", "low", "high"])

    kind = fit.by_segment.schema[segment].dataType.simpleString()
    curves = fit.by_segment.select(F.col(segment).alias("segment"), "cells").mapInArrow(
        run, f"segment {kind}, hazard array<double>, low array<double>, high array<double>")
    return curves.select(F.col("segment").alias(segment), F.posexplode(F.arrays_zip("hazard", "low", "high")).alias("month", "at")).select(
        segment, F.col("month").cast("bigint").alias("month"), "at.hazard", "at.low", "at.high")
