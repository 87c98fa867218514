"""Least squares over the simplex from a Gram matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nearest_mixture(h: np.ndarray, start: np.ndarray | None = None, tol: float = 1e-12) -> np.ndarray:
    """Weights w >= 0, sum 1, least w'Hw: the point of least norm in the hull of vectors with Gram matrix h (Wolfe's method).

    h is scaled by its greatest entry first. Ties between vertices go to the lowest index. start: weights to begin from.
    """
    p = len(h)
    if p == 1:
        return np.ones(1)
    top = np.abs(h).max()
    h = h / top if top > 0 else h
    if start is None:
        support = [int(np.argmin(np.diag(h)))]
        w = np.zeros(p)
        w[support[0]] = 1.0
    else:
        w = np.maximum(start, 0.0)
        w /= w.sum()
        support = [int(i) for i in np.flatnonzero(w > 0)]
    fresh = start is not None
    for _ in range(20 * p):
        if not fresh:
            g = h @ w
            j = int(np.argmin(g))
            if w @ g - g[j] <= tol or j in support:
                break
            support.append(j)
        fresh = False
        while True:
            s = np.array(support)
            k = np.zeros((s.size + 1, s.size + 1))
            k[:-1, :-1] = h[np.ix_(s, s)]
            k[-1, :-1] = k[:-1, -1] = 1.0
            rhs = np.zeros(s.size + 1)
            rhs[-1] = 1.0
            try:
                v = np.linalg.solve(k, rhs)[:-1]
                if not np.isfinite(v).all() or abs(v.sum() - 1) > 1e-6:
                    raise np.linalg.LinAlgError
            except np.linalg.LinAlgError:
                v = np.linalg.lstsq(k, rhs, rcond=None)[0][:-1]
            old = w[s]
            if (v >= -1e-14).all():
                w[:] = 0.0
                w[s] = np.maximum(v, 0.0)
                break
            falls = v < 0
            theta = np.min(old[falls] / np.maximum(old[falls] - v[falls], 1e-300))
            new = np.maximum(old + theta * (v - old), 0.0)
            zero = (new <= 1e-15) & falls
            if not zero.any():
                zero = falls & (new == new[falls].min())
            w[:] = 0.0
            w[s[~zero]] = new[~zero]
            w /= w.sum()
            support = [int(i) for i in s[~zero]]
        support = [i for i in support if w[i] > 0]
    return w / w.sum()


def duality_gap(h: np.ndarray, w: np.ndarray) -> float:
    """How far w is from optimal, relative to the greatest entry of h; 0 at the optimum."""
    g = h @ w
    return float((w @ g - g.min()) / max(np.abs(h).max(), 1e-300))


def mixture_weights(gram: np.ndarray, target: int, kept: list[int], start: np.ndarray | None = None) -> np.ndarray:
    """Weights over kept (ascending) that come nearest to the target column, from the Gram matrix of all columns."""
    k = np.array(kept)
    h = gram[np.ix_(k, k)] - gram[k, target][:, None] - gram[k, target][None, :] + gram[target, target]
    return nearest_mixture(h, start)


def wide(responses: DataFrame, split: str) -> DataFrame:
    """(query_id, ys array<double>): one row a query, models in order of their index."""
    return responses.where(F.col("split") == split).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("model_idx", "y"))), lambda x: x["y"]).alias("ys"))


def matrix(batch: pa.RecordBatch, name: str, n: int) -> np.ndarray:
    col = batch.column(batch.schema.get_field_index(name))
    return np.asarray(col.flatten()).reshape(-1, n)


def gram(rows: DataFrame, n: int) -> np.ndarray:
    """Sum over rows of ys ys'. Each task returns n * n sums, which Spark adds up; no rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n))
        for b in batches:
            y = matrix(b, "ys", n)
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n * n)), pa.array(total.ravel())], names=["i", "v"])

    out = np.zeros(n * n)
    for r in rows.select("ys").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r.i] = r.v
    return out.reshape(n, n)
