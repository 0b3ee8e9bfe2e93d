"""Whitening of embeddings by shifted Cholesky QR over distributed Gram passes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideloom.llm.registry import register, table
from tideloom.session import settle

#: Entries beyond this, once scaled, are taken for non-finite: whole numbers are exact below it.
LARGEST = float(1 << 52)
#: Gram passes at most, the first two of them shifted, and how close to orthonormal rows suffice.
PASSES = 6
CLOSE = 1e-13
#: Components with less of the largest variance than this have none to double precision.
NEGLIGIBLE = 1e-14
_LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Centre:
    """The mean ``sums / n`` of whole vectors, kept exact as a whole part and a rest below ``n``."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    @classmethod
    def of(cls, n: int, sums: list[int]) -> Centre:
        return cls(n, np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64))

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """``x - sums / n``; the subtraction of whole parts is exact."""
        return (x - self.whole).astype(np.float64) - self.rest / self.n

    def squared(self, x: np.ndarray) -> list[int | None]:
        """The exact sum of ``(n * x - sums) ** 2`` per row, or None where a long cannot hold it."""
        y = x - self.whole
        largest = int(np.abs(y).max(initial=0)) * self.n + self.n
        if largest**2 * max(x.shape[1], 1) <= _LONG:
            return np.square(y * self.n - self.rest).sum(axis=1).tolist()
        exact = np.square(y.astype(object) * self.n - self.rest.astype(object)).sum(axis=1)
        return [int(v) if v <= _LONG else None for v in exact]


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int, offset: int) -> DataFrame:
    """``vec_id, x``: sound vectors as arrays of ``floor(scale * entry) + offset``.

    Null, NaN and entries beyond ``LARGEST`` become null, and vectors that hold one are left out.
    """
    def entry(c: Column) -> Column:
        scaled = F.lit(float(scale)) * c.cast("double")
        return F.when(F.abs(scaled) < LARGEST, F.floor(scaled) + F.lit(offset).cast("long"))

    whole = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, entry).alias("x"))
    return whole.where(F.col("x").isNotNull() & F.forall("x", lambda c: c.isNotNull()))


def gram(fit: DataFrame, centre: Centre, transform: np.ndarray) -> np.ndarray:
    """``Q'Q`` of the centred rows times ``transform``, over ``sqrt(n)``: one pass, one matrix per task.

    The rows of the tasks' matrices are added by Spark; the sum has as many cells as the square
    of the number of dimensions, whatever the number of rows.
    """
    width, out = transform.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((out, out))
        for batch in batches:
            q = centre.deviations(_matrix(batch, width)) @ transform
            total += q.T @ q
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(out), pa.int32()), "cells": pa.array(total.tolist(), pa.list_(pa.float64()))})

    parts = fit.mapInArrow(run, "i int, cells array<double>")
    cells = parts.select("i", F.posexplode("cells").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    found = np.zeros((out, out))
    for row in cells.collect():
        found[row["i"], row["j"]] = row["v"]
    return (found + found.T) / (2 * centre.n)


def triangular(fit: DataFrame, centre: Centre) -> tuple[np.ndarray, float]:
    """``(R, trace)``: a factor with ``R'R`` the covariance of the rows, and the covariance's trace.

    Shifted CholeskyQR. A pass takes the Gram matrix of the rows ``Q = A R^-1`` found so far, the
    triangular solve being part of the pass, and multiplies its Cholesky factor onto ``R``. The
    shift keeps the factor regular for rows of any condition, at the price of rows that are not
    yet orthonormal; the passes that follow make them so. Directions without variance stay so in
    every pass; the last Gram matrix enters through its eigenvectors, which lets them vanish.
    """
    width = len(centre.whole)
    factor, trace = np.eye(width), 0.0
    for k in range(PASSES):
        g = gram(fit, centre, np.linalg.inv(factor))
        if k == 0:
            trace = float(np.trace(g))
            if trace <= 0:
                return np.zeros((width, width)), 0.0
        values, vectors = np.linalg.eigh(g)
        alive = values > 0.5
        settled = np.abs(values[alive] - 1).max(initial=0) <= CLOSE * width and values[~alive].max(initial=0) <= NEGLIGIBLE
        if k and (settled or k == PASSES - 1):
            return (np.sqrt(np.maximum(values, 0))[:, None] * vectors.T) @ factor, trace
        shift = np.finfo(float).eps * width * float(np.trace(g)) * (10 if k == 0 else 1)
        while True:
            try:
                step = np.linalg.cholesky(g + shift * np.eye(width)).T
                break
            except np.linalg.LinAlgError:
                shift *= 10
        factor = step @ factor
    raise AssertionError("unreachable")


def principal(factor: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """``(variances, components)`` by falling variance; a component's largest entry is positive."""
    _, sizes, rows = np.linalg.svd(factor)
    variances = sizes**2
    live = variances > NEGLIGIBLE * variances[0] if len(variances) and variances[0] > 0 else np.zeros(len(variances), bool)
    rows, variances = rows[live][:count], variances[live][:count]
    signs = np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(axis=1)]) if len(rows) else np.ones(0)
    return variances, rows * signs[:, None]


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(
    rows: DataFrame,
    components: int = 16,
    scale: int = 64,
    offset: int = 1_000_000,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """One row per sound vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Vectors become whole numbers (``whole_vectors``). The fit counts each distinct one once: ``n``
    vectors, their sums exact. ``triangular`` finds the R factor of the centred rows in a few
    distributed passes, the singular vectors of R are the components, numbered from 1 by falling
    variance. ``deviation`` is the exact sum of ``(n * x - sums) ** 2`` (null beyond a long),
    ``whitened`` the projection of the centred vector in units of the component's standard
    deviation, ``explained`` the component's share of the whole variance, and ``identity_error`` the
    largest entry by which the whitened fit's covariance, measured in a pass of its own, differs
    from the identity.

    Vectors that are null, hold null, NaN, infinite or (scaled) entries beyond 2**52, or are empty
    give no rows, nor do those of another length than most (of equally common lengths the longest
    counts). Repeated rows each give their rows. Directions without variance are no components, so
    a table of one distinct vector, like an empty one, gives an empty result. A null id is handed
    through; other columns are not read. Sums of doubles depend on the order of partial sums in
    their last bits.
    """
    spark = rows.sparkSession
    sound = whole_vectors(rows, id_col, vector_col, scale, offset).where(F.size("x") > 0)
    common = sound.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    if common is None:
        return spark.createDataFrame([], SCHEMA)
    width = common["width"]
    sound = sound.where(F.size("x") == width)
    fit = settle(sound.select("x").distinct())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(width, np.int64)
        for batch in batches:
            n += batch.num_rows
            sums += _matrix(batch, width).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"j": pa.array(range(width + 1), pa.int32()), "v": pa.array([*sums.tolist(), n], pa.int64())})

    totals = fit.mapInArrow(add, "j int, v long").groupBy("j").agg(F.sum("v").alias("v")).orderBy("j").collect()
    totals = [r["v"] for r in totals]
    centre = Centre.of(totals[-1], totals[:-1])
    factor, trace = triangular(fit, centre)
    variances, directions = principal(factor, components)
    if not len(variances):
        return spark.createDataFrame([], SCHEMA)
    projection = directions.T / np.sqrt(variances)
    error = float(np.abs(gram(fit, centre, projection) - np.eye(len(variances))).max())
    explained = variances / trace
    count = len(variances)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, width)
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": batch["vec_id"].take(pa.array(np.repeat(np.arange(len(x)), count))),
                    "component": pa.array(np.tile(np.arange(1, count + 1), len(x)), pa.int32()),
                    "n": pa.array(np.full(len(x) * count, centre.n), pa.int64()),
                    "deviation": pa.array(centre.squared(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), count))),
                    "whitened": pa.array((centre.deviations(x) @ projection).ravel(), pa.float64()),
                    "explained": pa.array(np.tile(explained, len(x)), pa.float64()),
                    "identity_error": pa.array(np.full(len(x) * count, error), pa.float64()),
                }
            )

    return sound.mapInArrow(project, SCHEMA)


@register("op13_whitening")
def op13_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))
