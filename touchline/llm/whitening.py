"""Operator 13: embedding whitening by TSQR.

Vectors are counted in whole steps (``x = floor(64 * c) + 1000000``), so that
their sums per dimension are exact whatever the order in which partitions add
them up. Each partition centres its rows with these sums and keeps the factor R
of their QR decomposition; the factors are stacked and decomposed again, ``FAN``
at a time, up a tree until one is left. Its singular values and right vectors
are those of the whole centred table, and the right vectors whiten it; the
covariance is never formed. A last pass whitens the table once more and merges
means and co-moments up the same tree, to prove that the result is white.

A task holds one block of rows and one factor (dimensions squared), the driver
one factor; a lost task is computed again from its rows and gives the same.

Defined results: a vector that is null or holds null, NaN or infinite entries
takes no part; neither do vectors whose length is not the most frequent one (of
equally frequent ones the longer), as no covariance spans lengths. A null vec_id
stays null; rows that repeat are rows of their own. Entries beyond 2^61 steps
count as that many. A direction without variance has the values 0 and stays out
of ``identity_error``; a deviation beyond a long is null. A table without usable
vectors gives no rows, and so do vectors of length 0; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.arrow import map_batches

STEPS, SHIFT, MOST = 64.0, 1_000_000, float(1 << 61)  # steps to a unit, what is added to a count of steps, and the largest count
COMPONENTS = 32
FAN = 8  # factors that one task merges
BLOCK_ROWS = 2048  # rows that a partition stacks on its factor at a time


@dataclass
class Whitening:
    n: int
    sums: list[int]  # exact, by dimension
    variances: np.ndarray  # of the components, falling
    components: np.ndarray  # (components, dimensions), unit rows
    total: float  # variance of all dimensions together

    @property
    def weights(self) -> np.ndarray:
        """(dimensions, components); zero for components without variance."""
        some = self.variances > 0
        return np.where(some, self.components.T / np.sqrt(np.where(some, self.variances, 1.0)), 0.0)

    @property
    def explained(self) -> list[float]:
        return [float(e / self.total) if self.total > 0 else 0.0 for e in self.variances]


def usable(table: DataFrame, vec: str = "embedding") -> DataFrame:
    """``vec_id, v``: the vectors that take part, but for their length."""
    v = F.col(vec).cast("array<double>")
    return table.select("vec_id", v.alias("v")).filter(F.col("v").isNotNull() & ~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))


def counted(column: pa.Array, d: int) -> np.ndarray:
    """Vectors of one length as whole steps."""
    c = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(STEPS * c), -MOST, MOST).astype(np.int64) + SHIFT


def split_mean(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Means as whole steps and what is left of the sum."""
    return np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)


def merged_up(parts: DataFrame, n_parts: int, schema: str, merge: Callable[[list[dict]], dict]) -> dict | None:
    """One row of ``parts`` (with their number ``at``) after merging up to ``FAN`` at a time; the driver sees the last row only."""

    def step(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["at"])
        return pa.Table.from_pylist([{**merge(rows), "at": rows[0]["at"] // FAN}], schema=table.schema.remove_metadata())

    while n_parts > 1:
        parts = parts.groupBy(F.floor(F.col("at") / FAN)).applyInArrow(step, schema)
        n_parts = -(-n_parts // FAN)
    rows = [r.asDict() for r in parts.orderBy("at").collect()]  # one row, or a few where the table was dealt anew meanwhile
    return merge(rows) if len(rows) > 1 else (rows[0] if rows else None)


def exact_sums(vectors: DataFrame, d: int) -> tuple[int, list[int]]:
    """Rows and sums by dimension; a partition sends two halves of each sum, so that neither can overflow."""

    def step(batches):
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            x = counted(batch.column(1), d)
            n += len(x)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(np.full(d, n)), pa.array(high), pa.array(low)], ["dim", "n", "high", "low"])

    parts = map_batches(vectors, step, "dim long, n long, high long, low long")
    exact = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    rows = parts.groupBy("dim").agg(F.sum("n").alias("n"), exact("high"), exact("low")).orderBy("dim").collect()
    return (int(rows[0].n) if rows else 0), [(int(r.high) << 32) + int(r.low) for r in rows]


def stacked_factor(factor: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.vstack([factor, *rows]), mode="r")


def factor_of(vectors: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """R of the whole centred table, at most (dimensions, dimensions)."""
    d, (mean, rest) = len(sums), split_mean(n, sums)

    def step(batches):
        factor, held = np.zeros((0, d)), []
        for batch in batches:
            held.append((counted(batch.column(1), d) - mean) - rest / n)
            if sum(map(len, held)) >= BLOCK_ROWS:
                factor, held = stacked_factor(factor, held), []
        if held or len(factor):
            yield pa.RecordBatch.from_pylist([{"at": TaskContext.get().partitionId(), "r": stacked_factor(factor, held).ravel()}], pa.schema([("at", pa.int64()), ("r", pa.list_(pa.float64()))]))

    def merge(rows: list[dict]) -> dict:
        return {"r": stacked_factor(np.zeros((0, d)), [np.reshape(r["r"], (-1, d)) for r in rows]).ravel()}

    schema = "at long, r array<double>"
    return np.reshape(merged_up(map_batches(vectors, step, schema), vectors.rdd.getNumPartitions(), schema, merge)["r"], (-1, d))


def prevailing(table: DataFrame, vec: str = "embedding") -> tuple[DataFrame, int]:
    """The vectors of the most frequent length, and that length."""
    vectors = usable(table, vec)
    top = vectors.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = top.d if top else 0
    return vectors.filter(F.size("v") == d), d


def fit(vectors: DataFrame, d: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of ``vec_id, v`` of length ``d``; none without rows or dimensions."""
    if d == 0:
        return None
    n, sums = exact_sums(vectors, d)
    if n == 0:
        return None
    _, s, right = np.linalg.svd(factor_of(vectors, n, sums), full_matrices=True)
    s = np.concatenate([s, np.zeros(d - len(s))])
    s[s <= s[0] * d * np.finfo(float).eps] = 0.0
    variances = s * s / n
    right = right * np.where(np.take_along_axis(right, np.abs(right).argmax(axis=1)[:, None], axis=1) < 0, -1.0, 1.0)  # one of both signs, the same in every run
    k = min(components, d)
    return Whitening(n, sums, variances[:k], right[:k], float(variances.sum()))


def deviations(steps: np.ndarray, rest: np.ndarray, n: int) -> list[int | None]:
    """Sums over dimensions of (n*x - S)^2 from x less the whole mean; in Python integers where a long could overflow."""
    most = n * int(np.abs(steps).max(initial=0)) + int(rest.max())
    wide = steps if most * most * steps.shape[1] < 1 << 63 else steps.astype(object)
    return [int(v) if v < 1 << 63 else None for v in ((wide * n - rest) ** 2).sum(axis=1).tolist()]


def whitened(vectors: DataFrame, model: Whitening) -> DataFrame:
    """``vec_id, deviation, values``: one row a vector, with its coordinates along all components."""
    d, n, weights, (mean, rest) = len(model.sums), model.n, model.weights, split_mean(model.n, model.sums)
    names = ["vec_id", "deviation", "values"]

    def step(batches):
        for batch in batches:
            steps = counted(batch.column(1), d) - mean
            w = (steps - rest / n) @ weights
            bounds = np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviations(steps, rest, n), pa.int64()), pa.ListArray.from_arrays(pa.array(bounds), pa.array(w.ravel()))], names)

    return map_batches(vectors, step, "vec_id long, deviation long, values array<double>")


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the covariance of whitened rows less the identity, over components with variance."""
    k = len(model.variances)

    def moments(w: np.ndarray) -> dict:
        mean = w.mean(axis=0)
        return {"n": len(w), "mean": mean, "co": (w - mean).T @ (w - mean)}

    def merge(rows: list[dict]) -> dict:
        """Co-moments of a union, from those of its parts about their own means."""
        n = sum(r["n"] for r in rows)
        mean = sum(np.asarray(r["mean"]) * (r["n"] / n) for r in rows)
        off = [np.asarray(r["mean"]) - mean for r in rows]
        return {"n": n, "mean": mean, "co": sum(np.reshape(r["co"], (k, k)) + r["n"] * np.outer(o, o) for r, o in zip(rows, off)).ravel()}

    def step(batches):
        own = None
        for batch in batches:
            if batch.num_rows:
                new = moments(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k))
                own = new if own is None else merge([own, new])
        if own:
            yield pa.RecordBatch.from_pylist([{"at": TaskContext.get().partitionId(), "n": own["n"], "mean": own["mean"], "co": own["co"].ravel()}], pa.schema([("at", pa.int64()), ("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("co", pa.list_(pa.float64()))]))

    schema = "at long, n long, mean array<double>, co array<double>"
    whole = merged_up(map_batches(rows.select("values"), step, schema), rows.rdd.getNumPartitions(), schema, merge)
    some = model.variances > 0
    return float(np.abs(np.reshape(whole["co"], (k, k)) / whole["n"] - np.eye(k))[some][:, some].max(initial=0.0))


def whiten(table: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every usable vector and component."""
    vectors, d = prevailing(table)
    model = fit(vectors, d, components)
    if model is None:
        return table.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    rows = whitened(vectors, model)
    error = identity_error(rows, model)
    each = rows.select("vec_id", "deviation", F.posexplode("values").alias("at", "whitened"))
    explained = F.get(F.array(*map(F.lit, model.explained)), F.col("at"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))
