"""How well kept models stand in for all others: certificates, coverage, bottleneck."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.simplex import gram, matrix, mixture_weights, wide

METRICS = ("mean_abs", "rmse", "max")
FEW, PART_BYTES = 32, 8 << 20
LOCAL_BYTES = 8 << 20
CERTIFICATE = "model_idx int, model_name string, kept array<int>, weights array<double>, uniqueness double, fit_distance double"


@dataclass(frozen=True)
class Certificate:
    """weights belong to the kept models in ascending order."""

    model_idx: int
    model_name: str
    kept: tuple[int, ...]
    weights: tuple[float, ...]
    uniqueness: float
    fit_distance: float  # Euclidean length of what is left over on the fit rows


def check_responses(responses: DataFrame) -> list[str]:
    """Names of the models by index; ValueError unless every query of both splits has every model once, with a finite y. A model without a name is called model_<index>."""
    per = (
        responses.groupBy("model_idx")
        .agg(
            F.min("model_name").alias("name"),
            F.max("model_name").alias("other"),
            *(F.count_if(F.col("split") == s).alias(s) for s in ("fit", "eval")),
            F.count_if(F.col("y").isNull() | F.isnan("y") | (F.abs("y") == float("inf")) | F.col("query_id").isNull()).alias("bad"),
        )
        .orderBy("model_idx")
        .collect()
    )
    if not per or any(r.fit < 1 or r.eval < 1 for r in per):
        raise ValueError("each model needs a row of fit and of eval")
    if any(r.bad for r in per):
        raise ValueError("responses hold null, NaN or infinite values")
    if [r.model_idx for r in per] != list(range(len(per))) or any(r.name != r.other for r in per):
        raise ValueError("model_idx must run from 0 without gaps, one name each")
    queries = responses.groupBy("split", "query_id").agg(F.count("*").alias("n"), F.count_distinct("model_idx").alias("m")).where((F.col("n") != len(per)) | (F.col("m") != len(per)))
    if queries.limit(1).count():
        raise ValueError("not every query has every model exactly once")
    return [r.name if r.name is not None else f"model_{r.model_idx}" for r in per]


class Coverage:
    """Evaluates sets of kept models over a response relation (split, query_id, model_idx, model_name, y).

    The Gram matrix of the fit rows is aggregated once. Weights are solved from it on the driver, whose state is bounded by the number of models. All sets asked for in one call are
    scored by one job over the eval rows, each task returning three numbers a set and model; eval rows of at most LOCAL_BYTES are scored by the same function without a job. What was scored is kept by set, and serves every tolerance.
    solved counts the mixtures that were asked for, of models outside their sets.
    """

    def __init__(self, responses: DataFrame, metric: str = "mean_abs", names: list[str] | None = None) -> None:
        if metric not in METRICS:
            raise ValueError(f"metric must be one of {METRICS}")
        found = check_responses(responses)
        if names and len(names) != len(found):
            raise ValueError(f"{len(names)} names for {len(found)} models")
        self.names = list(names) if names else found
        self.metric, self.n = metric, len(found)
        self.spark = responses.sparkSession
        self.gram = gram(wide(responses, "fit"), self.n)
        self.eval = wide(responses, "eval").select("ys").persist()
        rows = self.eval.count()
        self.local: list[pa.RecordBatch] | None = None
        self.parts, self.solved = self.eval.rdd.getNumPartitions(), 0
        enough = 1 + rows * self.n * 8 // PART_BYTES
        if rows * self.n * 8 <= LOCAL_BYTES:
            self.local = self.eval.toArrow().to_batches()
        elif enough < self.parts:  # every task costs more than a few rows do
            spread, self.eval, self.parts = self.eval, self.eval.coalesce(enough).persist(), enough
            self.eval.count()
            spread.unpersist()
        self._u: dict[frozenset[int], np.ndarray] = {}
        self._w: dict[frozenset[int], np.ndarray] = {}
        self._kin: dict[frozenset[int], tuple[frozenset[int], np.ndarray]] = {}

    def close(self) -> None:
        self.eval.unpersist()

    def _relative(self, kept: frozenset[int]) -> frozenset[int] | None:
        """A set with known weights that has one model more or less."""
        near = itertools.chain((kept - {j} for j in kept if len(kept) > 1), (kept | {j} for j in range(self.n) if j not in kept))
        return next((s for s in near if s in self._w), None)

    def weights(self, kept: frozenset[int]) -> np.ndarray:
        """n x n: row i holds the weights that stand for model i, zero outside kept.

        Next to a set that differs by one model, most targets need no solving: a dropped model of weight zero changes nothing, nor
        does an added one to which the gradient doesn't point. The others start from the weights known there.
        """
        if kept in self._w:
            return self._w[kept]
        w, order = np.zeros((self.n, self.n)), np.array(sorted(kept), int)
        near = self._relative(kept)
        same = np.zeros(self.n, bool)
        for i in range(self.n):
            if i in kept:
                w[i, i] = 1.0
                continue
            if not order.size:
                continue
            start = None
            if near is not None and i not in near:
                old = self._w[near][i]
                g = self.gram
                if near > kept:
                    same[i] = old[order].sum() > 1 - 1e-15
                else:
                    j = next(iter(kept - near))
                    # Gradient of the squared residual at the old weights, seen along each kept model's direction.
                    slope = g[order] @ old - g[order, i]
                    now = old @ g @ old - old @ g[:, i]
                    same[i] = slope[order == j][0] >= now - 1e-13 * abs(g[i, i])
                start = old[order] if old[order].sum() > 0.5 else None
            w[i, order] = self._w[near][i, order] if same[i] else mixture_weights(self.gram, i, order.tolist(), start)
        self._w[kept] = w
        if near is not None and same.any():
            self._kin[kept] = (near, same)
        return w

    def batch(self, sets: Iterable[Iterable[int]]) -> None:
        """Scores all sets not known yet, in one job."""
        new = list(dict.fromkeys(frozenset(s) for s in sets if frozenset(s) not in self._u))
        for s in new:
            if not s:
                self._u[s] = np.full(self.n, np.inf)
            elif len(s) == self.n:
                self._u[s] = np.zeros(self.n)
        new = [s for s in new if s not in self._u]
        if not new:
            return
        for s in new:
            self.weights(s)
            self.solved += self.n - len(s)
            self._u[s] = np.zeros(self.n)
        # Only models outside the set have a residual, and where the weights are those of a scored set, it is known. Column c of the residuals is ys @ mix[:, c].
        asked, pending = [], set(new)
        for s in new:
            near, same = self._kin.get(s, (None, None))
            for i in range(self.n):
                if i not in s and near is not None and near not in pending and near in self._u and same[i]:
                    self._u[s][i] = self._u[near][i]
                elif i not in s:
                    asked.append((s, i))
        if not asked:
            return
        mix = np.stack([self.weights(s)[i] - np.eye(self.n)[i] for s, i in asked], 1)
        n = self.n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = mix.shape[1]
            count, sums, squares, most = 0, np.zeros(m), np.zeros(m), np.zeros(m)
            for b in batches:
                y = matrix(b, "ys", n)
                for lo in range(0, len(y), 2048):
                    r = np.abs(y[lo : lo + 2048] @ mix)
                    count += len(r)
                    sums += r.sum(0)
                    squares += (r * r).sum(0)
                    most = np.maximum(most, r.max(0))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(m)), pa.array(np.full(m, count)), pa.array(sums), pa.array(squares), pa.array(most)], names=["c", "n", "s", "q", "m"])

        if self.local is not None:
            pdf = pa.Table.from_batches(run(iter(self.local))).to_pandas()
        else:
            got = self.eval.mapInArrow(run, "c long, n long, s double, q double, m double")
            if self.parts > FEW:  # many tasks' numbers are added up by Spark, those of a few here
                got = got.groupBy("c").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.max("m").alias("m"))
            pdf = got.toPandas()
        added = pdf.groupby("c").agg({"n": "sum", "s": "sum", "q": "sum", "m": "max"}).sort_index()
        value = {"mean_abs": added.s / added.n, "rmse": np.sqrt(added.q / added.n), "max": added.m}[self.metric]
        for c, v in value.items():
            s, i = asked[c]
            self._u[s][i] = v

    def uniqueness(self, kept: Iterable[int]) -> np.ndarray:
        s = frozenset(kept)
        if s not in self._u:
            self.batch([s])
        return self._u[s]

    def coverage(self, kept: Iterable[int]) -> float:
        """The greatest uniqueness over all models; infinite for the empty set."""
        return float(self.uniqueness(kept).max())

    def total(self, kept: Iterable[int]) -> float:
        return float(self.uniqueness(kept).sum())

    def certificates(self, kept: Iterable[int]) -> list[Certificate]:
        s = frozenset(kept)
        order = sorted(s)
        u, w = self.uniqueness(s), self.weights(s)
        return [Certificate(i, self.names[i], tuple(order), tuple(float(x) for x in w[i, order]), float(u[i]), self.fit_distance(s, i)) for i in range(self.n)]

    def fit_distance(self, kept: Iterable[int], model: int) -> float:
        """Euclidean distance on the fit rows between a model and its best mixture of kept ones; infinite for the empty set."""
        s = frozenset(kept)
        if not s:
            return float("inf")
        d = self.weights(s)[model] - np.eye(self.n)[model]
        return float(np.sqrt(max(d @ self.gram @ d, 0.0)))

    def certificate_rows(self, kept: Iterable[int]) -> DataFrame:
        return self.spark.createDataFrame([(c.model_idx, c.model_name, list(c.kept), list(c.weights), c.uniqueness, c.fit_distance) for c in self.certificates(kept)], CERTIFICATE)

    def bottleneck(self, kept: Iterable[int]) -> Certificate:
        """The certificate of greatest uniqueness, the lowest index on a tie."""
        return self.certificates(kept)[int(np.argmax(self.uniqueness(kept)))]
