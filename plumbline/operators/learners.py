"""Regressors per group: linear ones from sufficient statistics, boosted trees on bounded samples."""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import dot


SALTS = 32


def _joined(a: tuple, b: tuple) -> tuple:
    """Count, means and centred products of two portions put together; no digits are lost to large means."""
    n = a[0] + b[0]
    d = b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)


def linear_models(rows: DataFrame, names: list[str], group: str = "city", target: str = "y", ridge: float = 1e-6) -> DataFrame:
    """(group, n, weights array, intercept, train_rmse): least squares per group, from counts, means and centred products only, in one pass.

    Each task returns (p + 1) * (p + 2) numbers and a count for each group, which are put together in two rounds (by group and salt, then by group); the normal equations are solved from those, so a group's rows never come together. Features and target must not be null.
    """
    p = len(names)
    held = rows.select(group, *(F.col(c).cast("double").alias(f"z{i}") for i, c in enumerate((*names, target))))
    kind = dict(rows.dtypes)[group]
    stats = f"grp {kind}, salt int, s array<double>"

    def packed(total: dict, grp_type: pa.DataType, salt: int) -> pa.RecordBatch:
        flat = [np.r_[n, mean, prod.ravel()] for n, mean, prod in total.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(total), grp_type), pa.array(np.full(len(flat), salt, np.int32)), pa.array(flat, pa.list_(pa.float64()))], names=["grp", "salt", "s"])

    def sums(batches):
        total: dict[object, tuple] = {}
        grp_type = None
        for b in batches:
            key = pc.dictionary_encode(b.column(0), null_encoding="encode")
            grp_type, code = key.dictionary.type, np.asarray(key.indices)
            z = np.column_stack([b.column(i + 1).to_numpy(zero_copy_only=False) for i in range(p + 1)])
            for k in np.unique(code):
                part = z[code == k]
                mean = part.mean(0)
                own = (len(part), mean, (part - mean).T @ (part - mean))
                name = key.dictionary[int(k)].as_py()
                total[name] = _joined(total[name], own) if name in total else own
        if total:
            task = TaskContext.get()  # the same salt if the task runs again
            yield packed(total, grp_type, task.partitionId() % SALTS if task else 0)

    def met(batches):
        total: dict[object, tuple] = {}
        grp_type = None
        for b in batches:
            grp_type = b.schema.field(0).type
            for name, s in zip(b.column(0).to_pylist(), b.column(2)):
                s = s.values.to_numpy(zero_copy_only=False)
                own = (s[0], s[1 : p + 2], s[p + 2 :].reshape(p + 1, p + 1))
                total[name] = _joined(total[name], own) if name in total else own
        if total:
            yield packed(total, grp_type, 0)

    def solve(batches):
        out = []
        for b in met(batches):
            for name, s in zip(b.column(0).to_pylist(), b.column(2)):
                s = s.values.to_numpy(zero_copy_only=False)
                n, centre, c = s[0], s[1 : p + 2], s[p + 2 :].reshape(p + 1, p + 1)
                own = np.sqrt(np.maximum(np.diag(c)[:p], 1e-300))
                w = np.linalg.lstsq(c[:p, :p] / np.outer(own, own) + ridge * np.eye(p), c[:p, p] / own, rcond=None)[0] / own
                error = max(c[p, p] - 2 * w @ c[:p, p] + w @ c[:p, :p] @ w, 0.0)
                out.append((name, int(n), w.tolist(), float(centre[p] - w @ centre[:p]), float(np.sqrt(error / n))))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], b.schema.field(0).type), *(pa.array([o[i] for o in out], t) for i, t in ((1, pa.int64()), (2, pa.list_(pa.float64())), (3, pa.float64()), (4, pa.float64())))], names=["grp", "n", "weights", "intercept", "train_rmse"])
            out = []

    salted = held.mapInArrow(sums, stats).repartition("grp", "salt").mapInArrow(met, stats)
    return salted.repartition("grp").mapInArrow(solve, f"grp {kind}, n long, weights array<double>, intercept double, train_rmse double").withColumnRenamed("grp", group)


def score_linear(queries: DataFrame, names: list[str], models: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, model_name, y): every linear model on every query row, where the rows are. models: model_name, weights, intercept; one row a model, put beside each row as one value."""
    x = F.array(*(F.col(c).cast("double") for c in names))
    every = models.agg(F.collect_list(F.struct("model_name", "weights", "intercept")).alias("m")).select("m").scalar()
    asked = queries.select(key, x.alias("__x"), F.explode(every).alias("m"))
    return asked.select(key, "m.model_name", (dot(F.col("m.weights"), F.col("__x")) + F.col("m.intercept")).alias("y"))


@dataclass(frozen=True)
class BoostConfig:
    """rounds, learning_rate, depth, leaves, min_leaf, l2 as usual; bins per feature; at most max_rows training rows a group (a seeded sample beyond; None: all rows)."""

    rounds: int = 300
    learning_rate: float = 0.05
    depth: int = 6
    leaves: int = 31
    min_leaf: int = 40
    l2: float = 0.0
    bins: int = 64
    max_rows: int | None = 200_000
    seed: int = 0


class BoostedTrees:
    """Gradient boosting of squared error on binned features; trees grow by the best gain next."""

    def __init__(self, config: BoostConfig) -> None:
        self.c = config
        self.trees: list[tuple[np.ndarray, ...]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        c = self.c
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, c.bins + 1)[1:-1])) for f in range(x.shape[1])]
        b = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(self.edges)], 1)
        self.base = float(y.mean())
        at = np.full(y.size, self.base)
        for _ in range(c.rounds):
            leaf, tree = self._grow(b, y - at)
            at += c.learning_rate * tree[4][leaf]
            self.trees.append(tree)
        return self

    def _best(self, b: np.ndarray, g: np.ndarray) -> tuple[float, int, int]:
        c, n, total = self.c, g.size, g.sum()
        best = (1e-12, -1, -1)
        for f in range(b.shape[1]):
            count = np.cumsum(np.bincount(b[:, f], minlength=c.bins))[:-1]
            sums = np.cumsum(np.bincount(b[:, f], g, c.bins))[:-1]
            ok = (count >= c.min_leaf) & (n - count >= c.min_leaf)
            if ok.any():
                gain = np.where(ok, sums**2 / np.maximum(count + c.l2, 1e-9) + (total - sums) ** 2 / np.maximum(n - count + c.l2, 1e-9) - total**2 / (n + c.l2), -np.inf)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k)
        return best

    def _grow(self, b: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        feature, cut, left, right, value = [-1], [0], [0], [0], [g.sum() / (g.size + self.c.l2)]
        node = np.zeros(g.size, np.int64)
        open_ = {0: (self._best(b, g), 0, np.arange(g.size))}
        leaves = 1
        while open_ and leaves < self.c.leaves:
            at = max(open_, key=lambda k: open_[k][0][0])
            (gain, f, k), deep, rows = open_.pop(at)
            if f < 0:
                break
            go = b[rows, f] <= k
            feature[at], cut[at] = f, k
            for side, part in ((left, rows[go]), (right, rows[~go])):
                new = len(feature)
                side[at] = new
                for xs, v in ((feature, -1), (cut, 0), (left, 0), (right, 0), (value, g[part].sum() / (part.size + self.c.l2))):
                    xs.append(v)
                node[part] = new
                if deep + 1 < self.c.depth:
                    open_[new] = (self._best(b[part], g[part]), deep + 1, part)
            leaves += 1
        return node, tuple(np.array(a) for a in (feature, cut, left, right, value))

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, len(self.edges)), int)
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.c.depth):
                f = feature[at]
                inner = f >= 0
                at = np.where(inner, np.where(b[rows, np.maximum(f, 0)] <= cut[at], left[at], right[at]), at)
            out += self.c.learning_rate * value[at]
        return out


def boosted_models(rows: DataFrame, names: list[str], group: str = "city", target: str = "y", config: BoostConfig = BoostConfig(), row_id: str = "obs_id") -> DataFrame:
    """(group, n, train_rmse, model binary): boosted trees per group. A group above max_rows is sampled by a seeded hash before the shuffle, so no task holds more; with max_rows=None a task holds a group."""
    if config.max_rows is not None:
        n = rows.groupBy(group).agg(F.count("*").alias("__n")).withColumnRenamed(group, "__g")
        part = F.pmod(F.xxhash64(F.lit(config.seed), F.col(row_id)), F.lit(1_000_000)) / 1e6
        rows = rows.join(n, F.col(group) == F.col("__g")).where(part < config.max_rows / F.col("__n"))
    held = rows.select(group, *(F.col(c).cast("double").alias(c) for c in names), F.col(target).cast("double").alias("__y"))
    kind = dict(rows.dtypes)[group]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[names].to_numpy(float), pdf["__y"].to_numpy(float)
        m = BoostedTrees(config).fit(x, y)
        return pd.DataFrame({"grp": [pdf[group].iat[0]], "n": [len(y)], "train_rmse": [float(np.sqrt(np.mean((m.predict(x) - y) ** 2)))], "model": [pickle.dumps(m)]})

    return held.groupBy(group).applyInPandas(fit, f"grp {kind}, n long, train_rmse double, model binary").withColumnRenamed("grp", group)


def score_boosted(queries: DataFrame, names: list[str], models: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, model_name, y): every boosted model on every query row. models: model_name, model; one row a model, put beside the query rows once a task by the driver."""
    return _with_trees(queries, names, models, key, None)


def predict(rows: DataFrame, names: list[str], models: DataFrame, key: str = "obs_id", group: str = "city") -> DataFrame:
    """(key, group, y_hat): each row answered by the model of its own group, linear (weights, intercept) or boosted (model), where the rows are. Rows of groups without a model are left out.

    models: group and the model's columns, one row a model; they must be as few as a driver can hold.
    """
    if "model" in models.columns:
        return _with_trees(rows, names, models.withColumnRenamed(group, "model_name"), key, group).select(key, F.col("model_name").alias(group), F.col("y").alias("y_hat"))
    held = models.agg(F.map_from_entries(F.collect_list(F.struct(group, F.struct("weights", "intercept")))).alias("m")).select("m").scalar()
    x = F.array(*(F.col(c).cast("double") for c in names))
    own = rows.where(F.col(group).isNotNull()).select(key, group, x.alias("__x"), F.try_element_at(held, F.col(group)).alias("__m")).where("__m is not null")
    return own.select(key, group, (dot(F.col("__m.weights"), F.col("__x")) + F.col("__m.intercept")).alias("y_hat"))


def _with_trees(rows: DataFrame, names: list[str], models: DataFrame, key: str, group: str | None) -> DataFrame:
    kept = {r.model_name: bytes(r.model) for r in models.select("model_name", "model").collect()}
    sent = rows.sparkSession.sparkContext.broadcast(kept)
    kinds = dict(rows.dtypes)
    named = dict(models.dtypes)["model_name"]

    def run(batches):
        trees = {name: pickle.loads(m) for name, m in sent.value.items()}
        for b in batches:
            x = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(len(names))]) if names else np.zeros((b.num_rows, 0))
            own = b.column(len(names) + 1).to_pylist() if group else None
            for name, m in trees.items():
                at = np.arange(b.num_rows) if own is None else np.array([i for i, g in enumerate(own) if g == name], np.int64)
                if at.size:
                    yield pa.RecordBatch.from_arrays([b.column(len(names)).take(pa.array(at)), pa.array([name] * at.size), pa.array(m.predict(x[at]))], names=["key", "model_name", "y"])

    cells = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)]
    asked = rows.select(*cells, F.col(key).alias("key"), *([F.col(group).alias("grp")] if group else []))
    kind = rows.select(key).schema[0].dataType.simpleString() if key in kinds else "string"
    return asked.mapInArrow(run, f"key {kind}, model_name {named}, y double").withColumnRenamed("key", key)


def train_rmse(scored: DataFrame, group: str = "city", y: str = "y", fitted: str = "y_hat") -> DataFrame:
    return scored.groupBy(group).agg(F.sqrt(F.avg(F.pow(F.col(fitted) - F.col(y), 2))).alias("train_rmse"))
