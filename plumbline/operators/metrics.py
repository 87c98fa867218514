"""Descriptive statistics of search steps and of responses."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.coverage import Coverage

STEP_MODELS = "step int, gamma double, model_idx int, model_name string, kept boolean, u double, weights array<double>"
USED, LOGGED = 1e-6, 1e-12


def step_models(cov: Coverage, sets: Iterable[Iterable[int]], gamma: float) -> DataFrame:
    """(step, gamma, model_idx, model_name, kept, u, weights): one row a step and model; as many rows as steps times models."""
    rows = []
    kept_sets = [frozenset(s) for s in sets]
    cov.batch(kept_sets)
    for k, s in enumerate(kept_sets):
        u, w, order = cov.uniqueness(s), cov.weights(s), sorted(s)
        rows += [(k, float(gamma), i, cov.names[i], i in s, float(u[i]), [float(x) for x in w[i, order]]) for i in range(cov.n)]
    return cov.spark.createDataFrame(rows, STEP_MODELS)


def step_metrics(models: DataFrame) -> DataFrame:
    """One row a step with all measures of it, for all steps in one aggregation.

    Percentiles interpolate; u_std is the population's. Routing measures average over the models outside the kept set, of weights clipped at 0 and brought to sum 1. An empty
    kept set has infinite coverage, sums and percentiles and an undefined (NaN) u_std. Without outside models those measures are 0.
    """
    clipped = F.transform("weights", lambda x: F.greatest(x, F.lit(0.0)))
    total = F.aggregate(clipped, F.lit(0.0), lambda a, x: a + x)
    models = models.withColumn("__w", F.when((total > 0) & ~F.col("kept"), F.transform(clipped, lambda x: x / total)))
    models = models.withColumns(
        {
            "__used": F.size(F.filter("__w", lambda x: x > USED)),
            "__most": F.array_max("__w"),
            "__entropy": F.aggregate(F.filter("__w", lambda x: x > LOGGED), F.lit(0.0), lambda a, x: a - x * F.ln(x)),
        }
    )
    ordered = F.sort_array(F.collect_list(F.struct("model_idx", "model_name", "kept", "u")))
    pick = lambda keep, f: F.transform(F.filter("__all", lambda x: x["kept"] if keep else ~x["kept"]), lambda x: x[f])
    outside = lambda agg, c: F.coalesce(agg(F.when(~F.col("kept"), F.col(c))), F.lit(0.0))
    weighed = lambda c: F.coalesce(F.avg(F.when(F.col("__w").isNotNull(), F.col(c))), F.lit(0.0))
    quart = lambda p: F.percentile("u", F.lit(p))
    worst = F.min(F.struct((-F.col("u")).alias("v"), F.col("model_idx").alias("i"), F.col("model_name").alias("n")))
    out = models.groupBy("step").agg(
        F.first("gamma").alias("gamma"),
        ordered.alias("__all"),
        F.max("u").alias("coverage_e_s"),
        F.sum("u").alias("sum_uniqueness_u"),
        F.avg("u").alias("u_mean"),
        quart(0.5).alias("u_median"),
        F.stddev_pop("u").alias("u_std"),
        F.min("u").alias("u_min"),
        F.max("u").alias("u_max"),
        *(quart(p / 100).alias(f"u_p{p}") for p in (25, 75, 90, 95)),
        outside(F.avg, "u").alias("u_ext_mean"),
        outside(F.max, "u").alias("u_ext_max"),
        outside(F.sum, "u").alias("u_ext_sum"),
        F.count_if(F.col("u") > F.col("gamma")).cast("int").alias("n_models_violating_gamma"),
        worst.alias("__worst"),
        weighed("__used").alias("routing_avg_n_nonzero_weights"),
        weighed("__most").alias("routing_max_weight_mean"),
        weighed("__entropy").alias("routing_weight_entropy_mean"),
    )
    plain = [c for c in out.columns if not c.startswith("__") and c not in ("step", "gamma")]
    return out.select(
        "step",
        pick(True, "model_idx").alias("kept_set_idx"),
        pick(True, "model_name").alias("kept_set_names"),
        F.size(pick(True, "model_idx")).alias("kept_set_size"),
        pick(False, "model_idx").alias("removed_set_idx"),
        pick(False, "model_name").alias("removed_set_names"),
        F.size(pick(False, "model_idx")).alias("removed_set_size"),
        (F.col("coverage_e_s") <= F.col("gamma")).alias("satisfies_gamma"),
        *plain,
        F.col("__worst.i").alias("bottleneck_model_idx"),
        F.col("__worst.n").alias("bottleneck_model_name"),
        (-F.col("__worst.v")).alias("bottleneck_uniqueness"),
        F.map_from_entries(F.transform("__all", lambda x: F.struct(x["model_name"], x["u"]))).alias("per_model_uniqueness"),
    )


def model_stats(responses: DataFrame, split: str = "eval") -> DataFrame:
    """(model_idx, model_name, mean, std, min, max) of each model's responses; std is the population's."""
    y = responses.where(F.col("split") == split)
    return y.groupBy("model_idx", "model_name").agg(F.avg("y").alias("mean"), F.stddev_pop("y").alias("std"), F.min("y").alias("min"), F.max("y").alias("max"))


def overall_stats(responses: DataFrame, split: str = "eval") -> DataFrame:
    return responses.where(F.col("split") == split).agg(F.avg("y").alias("mean"), F.stddev_pop("y").alias("std"), F.avg(F.abs("y")).alias("abs_mean"))


def pairwise_differences(responses: DataFrame, split: str = "eval") -> DataFrame:
    """(model_i, model_j, diff): mean absolute difference of the responses of each two different models, both ways round.

    Packed by query first: a query's row meets itself, so the shuffle carries each response once, and pairs are combined before the second one.
    """
    packed = responses.where(F.col("split") == split).groupBy("query_id").agg(F.collect_list(F.struct("model_idx", "y")).alias("__m"))
    each = packed.select(F.explode("__m").alias("a"), "__m").select("a", F.explode("__m").alias("b")).where(F.col("a.model_idx") != F.col("b.model_idx"))
    return each.groupBy(F.col("a.model_idx").alias("model_i"), F.col("b.model_idx").alias("model_j")).agg(F.avg(F.abs(F.col("a.y") - F.col("b.y"))).alias("diff"))


def pairwise_stats(responses: DataFrame, split: str = "eval") -> DataFrame:
    return pairwise_differences(responses, split).agg(F.avg("diff").alias("mean"), F.percentile("diff", F.lit(0.5)).alias("median"), F.min("diff").alias("min"), F.max("diff").alias("max"))


def gram_table(responses: DataFrame, split: str = "fit") -> DataFrame:
    """(model_i, model_j, g) for i <= j: sums of products over the queries of a split."""
    packed = responses.where(F.col("split") == split).groupBy("query_id").agg(F.collect_list(F.struct("model_idx", "y")).alias("__m"))
    each = packed.select(F.explode("__m").alias("a"), "__m").select("a", F.explode("__m").alias("b")).where(F.col("a.model_idx") <= F.col("b.model_idx"))
    return each.groupBy(F.col("a.model_idx").alias("model_i"), F.col("b.model_idx").alias("model_j")).agg(F.sum(F.col("a.y") * F.col("b.y")).alias("g"))


def finite_json(value: object) -> object:
    """The value with infinities and NaN as strings, as strict JSON has none."""
    if isinstance(value, float) and not math.isfinite(value):
        return "NaN" if math.isnan(value) else "Infinity" if value > 0 else "-Infinity"
    if isinstance(value, dict):
        return {str(k): finite_json(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set, frozenset)):
        return [finite_json(v) for v in value]
    return value
