"""Queries of the model-redundancy engine, with the SQL that states the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import file_name, format_dose, mask_text, mask_text_shuffled, on_simplex, sigmoid, softmax, stable_seed
from plumbline.operators import ecosystem, metrics, report, responses, series
from plumbline.operators.bundle import answer, build_bundle
from plumbline.operators.coverage import Coverage, check_responses
from plumbline.operators.learners import BoostConfig, boosted_models, linear_models, predict, train_rmse
from plumbline.operators.search import ALGORITHMS, gains, removals, singletons
from plumbline.operators.simplex import duality_gap
from plumbline.plans.pooled import POOLS, eliminated
from plumbline.plans.pooled import pooled_searches as _pooled_sql
from plumbline.plans.problems import _round, settle_all, settled
from plumbline.session import scratch
from plumbline.sources.observations import load_models, read_csv, save_models
from plumbline.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
CONFIG = series.SeriesConfig(horizon=1, lags=(1, 2, 3, 6), days=30, detectors=40, min_points=100)
WHOLE = replace(CONFIG, days=None, detectors=None)
DOSES = (0.0, 0.25, 0.5)
GAMMAS_POOLED = (5.0, 20.0, 40.0, 60.0, 90.0)
GAMMAS = (40.0, 60.0, 80.0, 100.0)
KEYS = ["obs_id", "city", "detid"]


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "utd19_u")


def _responses(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "responses")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "query_grid")


# --- observations and features ---


def clean_observations(spark: SparkSession, d: str) -> DataFrame:
    return settle_all(series.clean_observations(_raw(spark, d)).select(*KEYS, F.col("day").cast("string").alias("day"), "interval", "flow", "occ"))


def recent_days(spark: SparkSession, d: str) -> DataFrame:
    return series.recent_days(series.clean_observations(_raw(spark, d)), CONFIG.days).select(*KEYS, F.col("day").cast("string").alias("day"))


def _recent(spark: SparkSession, d: str, config: series.SeriesConfig = CONFIG) -> DataFrame:
    return series.recent_days(series.clean_observations(_raw(spark, d)), config.days)


def detector_topk(spark: SparkSession, d: str) -> DataFrame:
    return series.busiest_detectors(_recent(spark, d), 5, CONFIG.min_points)


def calendar_features(spark: SparkSession, d: str, config: series.SeriesConfig = CONFIG) -> DataFrame:
    return settle_all(series.kept(_raw(spark, d), config).select(*KEYS, "dow", "is_weekend", "dow_sin", "dow_cos", "tod_sin", "tod_cos"))


def lag_features(spark: SparkSession, d: str, config: series.SeriesConfig = CONFIG) -> DataFrame:
    rows = series.lagged(_raw(spark, d), config)
    return settle_all(rows.select(*KEYS, *(f"{c}_lag{k}" for c in ("flow", "occ") for k in CONFIG.lags), "flow_diff1", "y", "split"))


def forced_lag(spark: SparkSession, d: str) -> DataFrame:
    """Lags without 1 among them: the first is added for the difference."""
    rows = series.lagged(_raw(spark, d), replace(WHOLE, lags=(2, 6)))
    return settle_all(rows.select(*KEYS, "flow_lag1", "flow_lag2", "flow_lag6", "flow_diff1"))


def prepared_features(spark: SparkSession, d: str, config: series.SeriesConfig = CONFIG) -> DataFrame:
    rows, names = series.prepare(_raw(spark, d), config)
    return settle_all(rows.select(*KEYS, *names, "y", "split"))


def split_sizes(spark: SparkSession, d: str, config: series.SeriesConfig = CONFIG) -> DataFrame:
    return series.split_sizes(series.prepare(_raw(spark, d), config)[0])


def city_list(spark: SparkSession, d: str) -> DataFrame:
    return _raw(spark, d).where("city is not null").select("city").distinct().orderBy("city")


def linear_trend(spark: SparkSession, d: str, config: series.SeriesConfig = CONFIG) -> DataFrame:
    """One-feature regression of the next flow on this one, per city."""
    rows = series.lagged(_raw(spark, d), config).where("split = 'train'")
    return settle_all(rows.groupBy("city").agg(F.count("*").alias("n"), F.regr_slope("y", "flow").alias("slope"), F.regr_intercept("y", "flow").alias("intercept")))


def model_rmse(spark: SparkSession, d: str, config: series.SeriesConfig = CONFIG) -> DataFrame:
    """Root mean square error of "the next flow is this flow", per city."""
    rows = series.lagged(_raw(spark, d), config).where("split = 'train'")
    return settle_all(train_rmse(rows.withColumn("y_hat", F.col("flow"))))


def _train(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    rows, names = series.prepare(_raw(spark, d), WHOLE)
    return series.finite_rows(rows, names).where("split = 'train'"), names


def linear_fit(spark: SparkSession, d: str) -> DataFrame:
    return linear_models(*_train(spark, d))


def linear_rmse(spark: SparkSession, d: str) -> DataFrame:
    """Rows and training error of the linear models over all features."""
    return settle_all(linear_fit(spark, d).select("city", "n", "train_rmse"))


def model_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """One-feature models fitted on the train rows, saved, loaded and asked about the test rows, each by its own city's."""
    rows = series.lagged(_raw(spark, d), WHOLE).where("split is not null").select("obs_id", "city", "split", "flow", "y")
    at = scratch(spark, "models")
    save_models(linear_models(rows.where("split = 'train'"), ["flow"], ridge=0.0), at)
    told = predict(rows.where("split = 'test'"), ["flow"], load_models(spark, at)).join(rows.where("split = 'test'").select("obs_id", "y"), "obs_id")
    return settle_all(told.groupBy("city").agg(F.count("*").alias("n"), F.avg("y_hat").alias("mean_y_hat"), F.sqrt(F.avg(F.pow(F.col("y_hat") - F.col("y"), 2))).alias("test_rmse")))


def boosted_fit(spark: SparkSession, d: str) -> DataFrame:
    """Trees on at most BoostConfig.max_rows training rows of each city."""
    train, names = _train(spark, d)
    return boosted_models(train, names, config=BoostConfig()).drop("model")


def response_bundle(spark: SparkSession, d: str) -> DataFrame:
    return build_bundle(_raw(spark, d), WHOLE, boost=BoostConfig()).responses


def bundle_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A bundle of linear models saved and loaded: its models answer its own queries once more; the greatest difference by model."""
    raw = _raw(spark, d)
    folder = scratch(spark, "bundles")
    built = build_bundle(raw, WHOLE, sizes=(100, 20, 20), folder=folder, source=d)
    rows, names = series.prepare(raw, WHOLE)
    asked = built.responses.select(F.col("query_id").alias("obs_id"), F.col("split").alias("role")).distinct().join(rows, "obs_id")
    again = answer(built.models, asked.withColumn("query_id", F.struct("role", "obs_id")), names)
    told = again.select(F.col("query_id.role").alias("split"), F.col("query_id.obs_id").alias("query_id"), "model_idx", F.col("y").alias("again"))
    return built.responses.join(told, ["split", "query_id", "model_idx"]).groupBy("model_idx", "model_name").agg(F.count("*").alias("n"), (F.max(F.abs(F.col("y") - F.col("again"))) < 1e-9).alias("same"))


def csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Readings written as CSV and read back, with the columns the pipeline needs and the cities that have models, cleaned. An empty cell of a file is a missing one."""
    at = scratch(spark, "csv")
    _raw(spark, d).select(*(F.col(c).cast("string").alias(c) for c in ("day", "interval", "detid", "flow", "occ", "error", "city", "speed"))).write.csv(at, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    cities = [r.model_name for r in table(spark, d, "city_models").collect()]
    rows = series.clean_observations(read_csv(spark, at, cities=cities))
    return settle_all(rows.groupBy("city").agg(F.count("*").alias("n"), F.count_distinct("detid").alias("detectors"), F.min(F.col("day").cast("string")).alias("first_day"), F.avg("flow").alias("flow"), F.avg("occ").alias("occ"), F.avg("interval").alias("seconds")))


# --- responses ---


def response_stats(spark: SparkSession, d: str) -> DataFrame:
    return settle_all(metrics.model_stats(_responses(spark, d)))


def response_overall(spark: SparkSession, d: str) -> DataFrame:
    return settle_all(metrics.overall_stats(_responses(spark, d)))


def pairwise_differences(spark: SparkSession, d: str) -> DataFrame:
    return settle_all(metrics.pairwise_differences(_responses(spark, d)))


def pairwise_stats(spark: SparkSession, d: str) -> DataFrame:
    return settle_all(metrics.pairwise_stats(_responses(spark, d)))


def gram_matrix(spark: SparkSession, d: str) -> DataFrame:
    return settle_all(metrics.gram_table(_responses(spark, d)))


def response_wide(spark: SparkSession, d: str) -> DataFrame:
    w = responses.response_wide(_responses(spark, d))
    return w.select("split", "query_id", F.size("ys").alias("n"), settled(F.aggregate("ys", F.lit(0.0), lambda a, x: a + x)).alias("total"), settled(F.get("ys", F.lit(0))).alias("y0"), settled(F.get("ys", F.lit(7))).alias("y7"))


def response_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The long relation made again from its wide form."""
    names = [r.model_name for r in table(spark, d, "city_models").orderBy("model_idx").collect()]
    return settle_all(responses.response_long(responses.response_wide(_responses(spark, d)), names).select("split", "query_id", "model_idx", "model_name", "y"))


def response_check(spark: SparkSession, d: str) -> DataFrame:
    """The relation's size by split, once the validation has found nothing wrong; it raises otherwise."""
    r = _responses(spark, d)
    check_responses(r)
    return r.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("query_id").alias("queries"), F.count_distinct("model_idx").alias("models"), F.count_if(F.col("y").isNull() | F.isnan("y")).alias("bad"))


# --- coverage and search ---


def _uniqueness(cov: Coverage, sets: Iterable[tuple[int, ...]]) -> DataFrame:
    sets = list(sets)
    cov.batch(sets)
    rows = [(",".join(map(str, s)), i, float(cov.uniqueness(s)[i])) for s in sets for i in range(cov.n)]
    return cov.spark.createDataFrame(rows, "kept string, model_idx int, u double")


def singleton_coverage(spark: SparkSession, d: str) -> DataFrame:
    cov = Coverage(_responses(spark, d))
    u = _uniqueness(cov, [(j,) for j in range(cov.n)])
    cov.close()
    return settle_all(u.groupBy("kept").agg(F.max("u").alias("coverage"), F.sum("u").alias("sum_uniqueness")))


def _pair_queries(metric: str) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        cov = Coverage(_responses(spark, d), metric)
        pairs = [(a, b) for a in range(cov.n) for b in range(a + 1, cov.n)]
        cov.batch(pairs)
        rows = [(a, b, i, float(cov.weights(frozenset((a, b)))[i, a]), float(cov.uniqueness((a, b))[i]), cov.fit_distance((a, b), i)) for a, b in pairs for i in range(cov.n) if i not in (a, b)]
        cov.close()
        return settle_all(spark.createDataFrame(rows, "a int, b int, model_idx int, weight_a double, u double, fit_distance double"))

    return query


def pooled_responses(responses: DataFrame, n: int) -> DataFrame:
    """The relation of n pooled models: pool i answers with the mean of models i, i + n, i + 2 n and so on."""
    i = F.pmod("model_idx", F.lit(n)).cast("int")
    means = responses.groupBy("split", "query_id", i.alias("model_idx")).agg(F.avg("y").alias("y"))
    return means.select("split", "query_id", "model_idx", F.concat(F.lit("pool_"), F.col("model_idx").cast("string")).alias("model_name"), "y")


def pooled_searches(spark: SparkSession, d: str) -> DataFrame:
    """Every step of all three searches at several tolerances, over all models pooled to POOLS."""
    cov = Coverage(pooled_responses(_responses(spark, d), POOLS))
    rows = [
        (g, name, s.iteration, s.action, s.model_idx, ",".join(map(str, s.kept)), s.coverage, s.sum_uniqueness)
        for g in GAMMAS_POOLED
        for name, search in ALGORITHMS.items()
        for s in search(cov, g).history
    ]
    cov.close()
    return settle_all(spark.createDataFrame(rows, "gamma double, algorithm string, iteration int, action string, model_idx int, kept string, coverage double, sum_uniqueness double"))


def singleton_ranking(spark: SparkSession, d: str) -> DataFrame:
    cov = Coverage(_responses(spark, d))
    out = spark.createDataFrame(singletons(cov), "pos int, model_idx int, model_name string, coverage double, sum_uniqueness double")
    cov.close()
    return settle_all(out)


def top_gains(spark: SparkSession, d: str) -> DataFrame:
    """The ten models whose joining the best single one lowers coverage most."""
    cov = Coverage(_responses(spark, d))
    out = spark.createDataFrame(gains(cov, [singletons(cov)[0][1]], 10), "pos int, model_idx int, model_name string, gain double")
    cov.close()
    return settle_all(out)


def candidate_trace(spark: SparkSession, d: str) -> DataFrame:
    """What backward elimination compared in each iteration."""
    cov = Coverage(_responses(spark, d))
    out = ALGORITHMS["backward_elimination"](cov, 80.0).trace_rows(spark)
    cov.close()
    return out


def _search_queries(name: str, gamma: float) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        cov = Coverage(_responses(spark, d))
        out = ALGORITHMS[name](cov, gamma).history_rows(spark)
        cov.close()
        return out

    return query


def _certificates(gamma: float) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        cov = Coverage(_responses(spark, d))
        kept = ALGORITHMS["backward_elimination"](cov, gamma).kept
        out = cov.certificate_rows(kept)
        cov.close()
        return out

    return query


def optimality_check(spark: SparkSession, d: str) -> DataFrame:
    """Greatest duality gap over all certificates of nested kept sets; SQL states that none is left."""
    cov = Coverage(_responses(spark, d))
    worst, tested = 0.0, 0
    for p in range(2, cov.n):
        kept = list(range(p))
        w = cov.weights(frozenset(kept))
        for i in range(p, cov.n):
            g = cov.gram
            h = g[np.ix_(kept, kept)] - g[kept, i][:, None] - g[kept, i][None, :] + g[i, i]
            worst, tested = max(worst, duality_gap(h, w[i, kept])), tested + 1
    cov.close()
    return spark.createDataFrame([(tested, worst < 1e-9)], "tested int, optimal boolean")


def gamma_sweep(spark: SparkSession, d: str) -> DataFrame:
    cov = Coverage(_responses(spark, d))
    out = report.summary(cov, report.sweep(cov, GAMMAS, tuple(ALGORITHMS)))
    cov.close()
    return out.drop("wall_time_seconds", "result_file")


def lazy_trace(spark: SparkSession, d: str) -> DataFrame:
    """What the lazy search took from its heap, in order, and whether the gain was fresh."""
    cov = Coverage(_responses(spark, d))
    r = ALGORITHMS["priority_queue"](cov, 60.0)
    cov.close()
    return spark.createDataFrame([(k, j, cov.names[j], fresh) for k, (j, fresh) in enumerate(r.pops)], "pop int, model_idx int, model_name string, fresh boolean")


def removal_what_ifs(spark: SparkSession, d: str) -> DataFrame:
    cov = Coverage(_responses(spark, d))
    kept = ALGORITHMS["backward_elimination"](cov, 80.0).kept
    out = spark.createDataFrame(removals(cov, kept, 80.0), "model_idx int, model_name string, coverage double, within boolean")
    cov.close()
    return out


def step_metrics(spark: SparkSession, d: str) -> DataFrame:
    """All measures of the kept sets {0} and {0, 1}; lists are joined to strings."""
    cov = Coverage(_responses(spark, d))
    m = metrics.step_metrics(metrics.step_models(cov, [(0,), (0, 1)], 60.0))
    cov.close()
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    flat = m.select(*(text(c) if k.startswith("array") else F.col(c) for c, k in m.dtypes if not k.startswith("map")))
    return settle_all(flat)


def step_uniqueness(spark: SparkSession, d: str) -> DataFrame:
    """The map of each model's uniqueness in those steps, entry by entry."""
    cov = Coverage(_responses(spark, d))
    m = metrics.step_metrics(metrics.step_models(cov, [(0,), (0, 1)], 60.0))
    cov.close()
    return settle_all(m.select("step", F.explode("per_model_uniqueness").alias("model_name", "u")))


def trajectory(spark: SparkSession, d: str) -> DataFrame:
    cov = Coverage(_responses(spark, d))
    out = report.trajectory(cov, report.run(cov, "backward_elimination", 60.0)).drop("elapsed_seconds")
    cov.close()
    return out


def bottleneck(spark: SparkSession, d: str) -> DataFrame:
    cov = Coverage(_responses(spark, d))
    rows = [(j, (c := cov.bottleneck((j,))).model_idx, c.model_name, c.uniqueness) for j in range(cov.n)]
    cov.close()
    return settle_all(spark.createDataFrame(rows, "kept int, model_idx int, model_name string, u double"))


# --- texts ---


def dose_grid(spark: SparkSession, d: str) -> DataFrame:
    return responses.dose_grid(table(spark, d, "documents"), DOSES).select("doc_id", "dose_no", "theta", "seed")


def stable_seeds(spark: SparkSession, d: str) -> DataFrame:
    """The grid's seeds made anew from text and dose."""
    return _texts(spark, d).select("query_id", stable_seed(F.col("text"), format_dose(F.col("theta"))).alias("seed"))


def _masked(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).withColumn("masked", mask_text(F.col("text"), F.col("theta"), F.col("seed")))


def masked_texts(spark: SparkSession, d: str) -> DataFrame:
    return _masked(spark, d).select("query_id", "masked")


def masked_texts_shuffled(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("query_id", mask_text_shuffled("text", "theta", "seed").alias("masked"))


def text_responses(spark: SparkSession, d: str) -> DataFrame:
    """Four scalar scorers on every masked text."""
    q = _masked(spark, d)
    return settle_all(responses.respond(q, responses.text_scorers(F.col("masked"))))


def _ecosystem() -> ecosystem.Ecosystem:
    units = [ecosystem.FunctionUnit("words", lambda t: len((t or "").split())), ecosystem.FunctionUnit("letters", lambda t: len(t or "")), ecosystem.FunctionUnit("masks", lambda t: (t or "").count("[MASK]"))]
    return ecosystem.Ecosystem(units[0], units[1:])


def _peers(answers: DataFrame) -> DataFrame:
    return answers.select("query_id", "target", F.get("peers", F.lit(0)).alias("letters"), F.get("peers", F.lit(1)).alias("masks"))


def ecosystem_plain(spark: SparkSession, d: str) -> DataFrame:
    """A target and two peers asked the texts as they are."""
    return _peers(_ecosystem().ask(_texts(spark, d)))


def ecosystem_answers(spark: SparkSession, d: str) -> DataFrame:
    """A target and two peers asked the same perturbed texts."""

    class Masking:
        def apply(self, x: str, theta: float, seed: int | None = None) -> str:
            from plumbline.functions.scalars import shuffled_mask

            return shuffled_mask(x, theta, seed or 0) or ""

    return _peers(_ecosystem().ask(_texts(spark, d), Masking()))


def unique_names(spark: SparkSession, d: str) -> DataFrame:
    """Sources of documents as names that repeat, told apart by number."""
    names = table(spark, d, "documents").where("source is not null").select(F.concat_ws("/", "source", "kernel").alias("name"), F.col("doc_id").alias("pos"))
    return responses.unique_names(names.withColumn("name", file_name(F.col("name"))))


def fit_eval_halves(spark: SparkSession, d: str) -> DataFrame:
    return responses.head_tail(table(spark, d, "documents").select("doc_id"), "doc_id")


def sample_texts(spark: SparkSession, d: str) -> DataFrame:
    """Fifty documents drawn without replacement."""
    return responses.sample_rows(table(spark, d, "documents").select("doc_id"), 50, "7", "doc_id")


def pooled_queries(spark: SparkSession, d: str, config: series.SeriesConfig = CONFIG) -> DataFrame:
    """Rows of val and test drawn from all cities."""
    return responses.pool(series.prepare(_raw(spark, d), config)[0], 300, 300).select("obs_id", "role")


def simplex_functions(spark: SparkSession, d: str) -> DataFrame:
    """Weights repaired to the simplex, sigmoid and softmax over the responses of a query."""
    w = responses.response_wide(_responses(spark, d)).where("split = 'eval'")
    z = F.transform("ys", lambda y: (y - 300) / 100)
    fixed = on_simplex(z)
    zero = F.lit(0.0)
    return settle_all(w.select("query_id", fixed[0].alias("w0"), F.array_max(fixed).alias("w_most"), F.aggregate(fixed, zero, lambda a, x: a + x * x).alias("w_squares"), sigmoid(z[0]).alias("s"), softmax(z).alias("p1")))


# --- summaries ---


def runs_ordered(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "run_summary")
    w = Window.orderBy("gamma", "algorithm")  # a fixed few rows
    return settle_all(r.select(F.row_number().over(w).alias("pos"), "gamma", "algorithm", "kept_set_size", "coverage_e_s"))


def kept_set_diff(spark: SparkSession, d: str) -> DataFrame:
    t = report.compared(table(spark, d, "run_summary"), "backward_elimination", "forward_selection")
    return t.select("gamma", *(F.array_join(c, ",").alias(c) for c in ("both", "only_a", "only_b")))


def membership(spark: SparkSession, d: str) -> DataFrame:
    """Which of all algorithms kept a model, at every tolerance."""
    return report.membership(table(spark, d, "run_summary")).select("gamma", "model_name", F.array_join("algorithms", ",").alias("algorithms"), "n_algorithms")


def result_files(spark: SparkSession, d: str) -> DataFrame:
    """A sweep written to files and read back from its summary: one row a run, and if its own file is there."""
    responses_ = _responses(spark, d)
    cov = Coverage(responses_)
    at = scratch(spark, "sweep")
    report.write_sweep(cov, responses_, report.sweep(cov, GAMMAS[:2]), at)
    report.write_sweep(cov, responses_, report.sweep(cov, GAMMAS[:2], ("priority_queue",)), at)
    names = cov.names
    cov.close()
    files = spark.read.format("binaryFile").load(f"{at}/*.json").select(F.element_at(F.split("path", "/"), -1).alias("result_file"), F.lit(True).alias("written"))
    runs = report.read_summary(spark, f"{at}/summary.json").join(files, "result_file", "left")
    return runs.select("gamma", "algorithm", (F.size("kept_set_names") + F.size("removed_set_names") == len(names)).alias("complete"), (F.col("coverage_e_s") <= F.col("gamma")).alias("within"), F.coalesce("written", F.lit(False)).alias("written"))


def summary_merge(spark: SparkSession, d: str) -> DataFrame:
    """New rows of one algorithm take the place of its old ones."""
    r = table(spark, d, "run_summary")
    new = r.where("algorithm = 'priority_queue'").withColumn("kept_set_size", F.col("kept_set_size") + 100)
    return report.merged(r, new).select("gamma", "algorithm", "kept_set_size")


def algorithm_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "run_summary").select("algorithm").distinct().orderBy("algorithm")


def runs_json(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "run_summary")
    return r.select("gamma", "algorithm", F.to_json(F.struct("kept_set_size", "satisfies_gamma", "kept_set_names")).alias("json"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        clean_observations, recent_days, detector_topk, calendar_features, lag_features, forced_lag, prepared_features, split_sizes, city_list, linear_trend, model_rmse, linear_fit, linear_rmse, model_roundtrip, boosted_fit,
        response_bundle, bundle_roundtrip, csv_roundtrip,
        response_stats, response_overall, pairwise_differences, pairwise_stats, gram_matrix, response_wide, response_roundtrip, response_check,
        singleton_coverage, singleton_ranking, top_gains, pooled_searches, optimality_check, gamma_sweep, lazy_trace, candidate_trace, removal_what_ifs, step_metrics, step_uniqueness, trajectory, bottleneck,
        dose_grid, stable_seeds, masked_texts, masked_texts_shuffled, text_responses, ecosystem_plain, ecosystem_answers, unique_names, fit_eval_halves, sample_texts, pooled_queries, simplex_functions,
        runs_ordered, kept_set_diff, membership, result_files, summary_merge, algorithm_names, runs_json,
    )
}
QUERIES |= {f"pair_certificates_{m}": _pair_queries(m) for m in ("mean_abs", "rmse", "max")}
QUERIES |= {f"{a}_nall{f'_g{g:g}' if g != 60 else ''}": _search_queries(a, g) for a in ALGORITHMS for g in (40.0, 60.0)}
QUERIES["certificates"] = _certificates(80.0)


def _full(query: Callable[..., DataFrame]) -> Query:
    return lambda spark, d: query(spark, d, WHOLE)


#: Over all days and all detectors with min_points rows.
FULL = (calendar_features, lag_features, prepared_features, split_sizes, linear_trend, model_rmse, pooled_queries)
QUERIES |= {f"{f.__name__}_full": _full(f) for f in FULL}

# --- the same as SQL ---

_CLEAN = """clean as (select * from utd19_u where day is not null and isfinite("interval") and isfinite(flow) and isfinite(occ) and city is not null and detid is not null
  and coalesce(case when isfinite(error) then error end, 0) = 0)"""
_RECENT = f"{_CLEAN}, recent as (select * from clean qualify day >= max(day) over (partition by city) - {CONFIG.days - 1})"


def _top(most: int) -> str:
    return f"""top as (select city, detid, count(*)::bigint as n from recent group by city, detid having count(*) >= {CONFIG.min_points}
  qualify row_number() over (partition by city order by count(*) desc, min(obs_id)) <= {most})"""


_KEPT = f"{_RECENT}, {_top(CONFIG.detectors)}, kept as (select r.* from recent r semi join top t on r.city = t.city and r.detid = t.detid)"
_ALL = f"""{_CLEAN}, top as (select city, detid from clean group by city, detid having count(*) >= {WHOLE.min_points}),
  kept as (select r.* from clean r semi join top t on r.city = t.city and r.detid = t.detid)"""
_CAL = """cal as (select *, (isodow(day) - 1)::tinyint as dow, (isodow(day) >= 6)::tinyint as is_weekend,
  least(greatest("interval" / case when p = 0 then 1 else p end, 0), 1) as part from (select *, max("interval") over (partition by city) + 1 as p from kept))"""
_LAGS = ", ".join(f"lag({c}, {k}) over w as {c}_lag{k}" for c in ("flow", "occ") for k in CONFIG.lags)


def _lagged(src: str) -> str:
    return f"""lagged as (select *, flow - lag(flow) over w as flow_diff1, lead(flow, 1) over w as y, {_LAGS}, row_number() over w - 1 as i, count(*) over (partition by city, detid) as n
  from {src} window w as (partition by city, detid order by day, "interval", obs_id)),
feat as (select *, case when i < trunc(0.6::double * n)::bigint - 1 then 'train' when i >= trunc(0.6::double * n)::bigint and i < trunc(0.8::double * n)::bigint - 1 then 'val'
    when i >= trunc(0.8::double * n)::bigint and i < n - 1 then 'test' end as split from lagged)"""


_NAMES = series.feature_names(CONFIG.lags)
_TRIG = {"dow_sin": "sin(2 * pi() * (dow / 7.0))", "dow_cos": "cos(2 * pi() * (dow / 7.0))", "tod_sin": "sin(2 * pi() * part)", "tod_cos": "cos(2 * pi() * part)"}
_K = "obs_id, city, detid"


def _col(c: str) -> str:
    return f"{_round(_TRIG.get(c, chr(34) + c + chr(34)))} as \"{c}\"" if c not in ("dow", "is_weekend") else c


_FULL = " and ".join(f'"{c}" is not null' for c in _NAMES if c not in _TRIG)
_PREP = f"with {_KEPT}, {_CAL}, {_lagged('cal')}, prep as (select * from feat where {_FULL} and y is not null and split is not null)"
_WIDE = "e as (select query_id, model_idx, y from responses where split = 'eval'), f as (select query_id, model_idx, y from responses where split = 'fit')"
_PAIR = f"""{_WIDE},
g as (select p.model_idx as i, q.model_idx as j, sum(p.y * q.y) as g from f p join f q on p.query_id = q.query_id group by 1, 2),
m as (select distinct model_idx as i from f),
pair as (select a.i as a, b.i as b, t.i as t from m a join m b on a.i < b.i join m t on t.i <> a.i and t.i <> b.i),
wts as (select *, sqrt(greatest(wa * wa * aa + (1 - wa) * (1 - wa) * bb + 2 * wa * (1 - wa) * ab - 2 * wa * ta - 2 * (1 - wa) * tb + tt, 0)) as fd from (
  select p.a, p.b, p.t, aa.g as aa, bb.g as bb, ab.g as ab, ta.g as ta, tb.g as tb, tt.g as tt, case when aa.g - 2 * ab.g + bb.g > 0 then greatest(0, least(1, (ta.g - tb.g - ab.g + bb.g) / (aa.g - 2 * ab.g + bb.g))) else 1 end as wa
  from pair p join g aa on aa.i = p.a and aa.j = p.a join g bb on bb.i = p.b and bb.j = p.b join g ab on ab.i = p.a and ab.j = p.b
  join g ta on ta.i = p.t and ta.j = p.a join g tb on tb.i = p.t and tb.j = p.b join g tt on tt.i = p.t and tt.j = p.t)),
res as (select w.a, w.b, w.t, any_value(w.wa) as wa, any_value(w.fd) as fit_distance, avg(abs(w.wa * ya.y + (1 - w.wa) * yb.y - yt.y)) as mean_abs, sqrt(avg(pow(w.wa * ya.y + (1 - w.wa) * yb.y - yt.y, 2))) as rmse, max(abs(w.wa * ya.y + (1 - w.wa) * yb.y - yt.y)) as "max"
  from wts w join e ya on ya.model_idx = w.a join e yb on yb.model_idx = w.b and yb.query_id = ya.query_id join e yt on yt.model_idx = w.t and yt.query_id = ya.query_id group by w.a, w.b, w.t)"""
_SINGLE = "single as (select p.model_idx as s, q.model_idx as t, avg(abs(p.y - q.y)) as u from e p join e q on p.query_id = q.query_id group by 1, 2)"


def _step_metrics() -> str:
    quart = lambda q: _round(f"quantile_cont(u, {q})")
    return f"""with {_PAIR}, {_SINGLE}, names as (select distinct model_idx, model_name from responses),
u as (select 0 as step, t as i, t = 0 as kept, u, case when t <> 0 then [1.0::double] end as w from single where s = 0
  union all select 1, t, false, mean_abs, [wa::double, (1 - wa)::double] from res where a = 0 and b = 1 union all select 1, i, true, 0, null from m where i < 2),
x as (select step, i, kept, u, model_name, len(list_filter(w, lambda v: v > 1e-6)) as used, list_max(w) as most, list_sum(list_transform(list_filter(w, lambda v: v > 1e-12), lambda v: -v * ln(v))) as ent from u join names on model_idx = i)
select step, string_agg(i::varchar, ',' order by i) filter (where kept) as kept_set_idx, string_agg(model_name, ',' order by i) filter (where kept) as kept_set_names, (count(*) filter (where kept))::int as kept_set_size,
  string_agg(i::varchar, ',' order by i) filter (where not kept) as removed_set_idx, string_agg(model_name, ',' order by i) filter (where not kept) as removed_set_names, (count(*) filter (where not kept))::int as removed_set_size,
  max(u) <= 60 as satisfies_gamma, {_round('max(u)')} as coverage_e_s, {_round('sum(u)')} as sum_uniqueness_u, {_round('avg(u)')} as u_mean, {quart(0.5)} as u_median, {_round('stddev_pop(u)')} as u_std,
  {_round('min(u)')} as u_min, {_round('max(u)')} as u_max, {quart(0.25)} as u_p25, {quart(0.75)} as u_p75, {quart(0.9)} as u_p90, {quart(0.95)} as u_p95,
  {_round('avg(u) filter (where not kept)')} as u_ext_mean, {_round('max(u) filter (where not kept)')} as u_ext_max, {_round('sum(u) filter (where not kept)')} as u_ext_sum, (count(*) filter (where u > 60))::int as n_models_violating_gamma,
  {_round('avg(used)')} as routing_avg_n_nonzero_weights, {_round('avg(most)')} as routing_max_weight_mean, {_round('avg(ent)')} as routing_weight_entropy_mean,
  min_by(i, (-u, i))::int as bottleneck_model_idx, min_by(model_name, (-u, i)) as bottleneck_model_name, {_round('max(u)')} as bottleneck_uniqueness
from x group by step"""


def _linear_rmse() -> str:
    """Normal equations of all features (but for the first difference, which the others add up to), solved by elimination."""
    names = [c for c in _NAMES if c != "flow_diff1"]
    value = lambda c: f"({_TRIG.get(c, chr(34) + c + chr(34))})"
    cols = [*names, "y"]
    n = len(names)
    pairs = ", ".join(f"covar_pop({value(a)}, {value(b)}) as c{i}_{k}" for i, a in enumerate(cols) for k, b in enumerate(cols) if i <= k)
    long = " union all ".join(f"select city, {i} as i, {k if k < n else 100} as j, c{min(i, k)}_{max(i, k)} as v from s" for i in range(n) for k in range(n + 1))
    steps, last = eliminated("m", "city", n, "gj")
    told = " + ".join(f"case when i = {i} then c{i}_{n} * v else 0 end" for i in range(n))
    return f"""{_PREP.replace(_KEPT, _ALL)}, train as (select * from prep where split = 'train'), s as (select city, count(*)::bigint as n, {pairs} from train group by city),
m as (select city, i::int as i, j::int as j, v from ({long})), {steps}, told as (select city, sum({told}) as t from {last} join s using (city) where j = 100 group by city)
select city, n, {_round(f'sqrt(greatest(c{n}_{n} - t, 0))')} as train_rmse from s join told using (city)"""


_DOSED = "coalesce(text, '') || '||' || printf('%.6f', theta)"
_SEED = "(cast('0x' || substr(sha256({}), 1, 16) as ubigint) % 2147483647)::bigint"
_TOK = "list_filter(regexp_split_to_array(text, '[\\s\\pZ]+'), lambda t: t <> '')"
_MASK = f"""t as (select query_id, text, theta, seed, {_TOK} as t from query_grid),
k as (select *, len(t) as n, least(round_even(theta * len(t), 0)::int, len(t)) as k, list_transform(range(0, len(t)), lambda i: md5(seed::varchar || '|' || i::varchar)) as h from t),
l as (select *, list_sort(h)[greatest(k, 1)] as lim from k),
masked as (select query_id, case when n > 0 and k > 0 then array_to_string(list_transform(range(1, n + 1), lambda i: case when h[i] <= lim then '[MASK]' else t[i] end), ' ') else text end as masked from l)"""
_SCORE = """select query_id, 0::int as model_idx, 'distinct' as model_name, case when n > 0 then list_unique(t)::double / n else 0 end as y from s
union all select query_id, 1, 'masked', case when n > 0 then len(list_filter(t, lambda x: x = '[MASK]'))::double / n else 0 end from s
union all select query_id, 2, 'n_tokens', n::double from s
union all select query_id, 3, 'token_length', case when n > 0 then list_sum(list_transform(t, lambda x: length(x)))::double / n else 0 end from s"""

SQL: dict[str, str] = {
    "clean_observations": f"with {_CLEAN} select {_K}, day::varchar as day, {_col('interval')}, {_col('flow')}, {_col('occ')} from clean",
    "recent_days": f"with {_RECENT} select {_K}, day::varchar as day from recent",
    "detector_topk": f"with {_RECENT}, {_top(5)} select city, detid, n from top",
    "calendar_features": f"with {_KEPT}, {_CAL} select {_K}, dow, is_weekend, {', '.join(map(_col, _TRIG))} from cal",
    "lag_features": f"with {_KEPT}, {_lagged('kept')} select {_K}, {', '.join(_col(f'{c}_lag{k}') for c in ('flow', 'occ') for k in CONFIG.lags)}, {_col('flow_diff1')}, {_col('y')}, split from feat",
    "prepared_features": f"{_PREP} select {_K}, {', '.join(map(_col, _NAMES))}, {_col('y')}, split from prep",
    "split_sizes": f"{_PREP} select city, n_train, n_val, n_test, n_train >= 500 and n_val >= 200 and n_test >= 200 as eligible from (select city, {', '.join(f'count(*) filter (where split = {chr(39)}{s}{chr(39)})::bigint as n_{s}' for s in ('train', 'val', 'test'))} from prep group by city)",
    "city_list": "select distinct city from utd19_u where city is not null",
    "linear_trend": f"with {_KEPT}, {_lagged('kept')} select city, count(*)::bigint as n, {_round('regr_slope(y, flow)')} as slope, {_round('regr_intercept(y, flow)')} as intercept from feat where split = 'train' group by city",
    "model_rmse": f"with {_KEPT}, {_lagged('kept')} select city, {_round('sqrt(avg(pow(flow - y, 2)))')} as train_rmse from feat where split = 'train' group by city",
    "response_stats": f"with {_WIDE} select model_idx, model_name, {_round('avg(y)')} as mean, {_round('stddev_pop(y)')} as std, {_round('min(y)')} as min, {_round('max(y)')} as max from responses where split = 'eval' group by 1, 2",
    "response_overall": f"select {_round('avg(y)')} as mean, {_round('stddev_pop(y)')} as std, {_round('avg(abs(y))')} as abs_mean from responses where split = 'eval'",
    "pairwise_differences": f"with {_WIDE}, {_SINGLE} select s as model_i, t as model_j, {_round('u')} as diff from single where s <> t",
    "pairwise_stats": f"with {_WIDE}, {_SINGLE} select {_round('avg(u)')} as mean, {_round('quantile_cont(u, 0.5)')} as median, {_round('min(u)')} as min, {_round('max(u)')} as max from single where s <> t",
    "gram_matrix": f"with {_WIDE} select p.model_idx as model_i, q.model_idx as model_j, {_round('sum(p.y * q.y)')} as g from f p join f q on p.query_id = q.query_id and p.model_idx <= q.model_idx group by 1, 2",
    "response_wide": f"select split, query_id, count(*)::int as n, {_round('sum(y)')} as total, {_round('max(y) filter (where model_idx = 0)')} as y0, {_round('max(y) filter (where model_idx = 7)')} as y7 from responses group by 1, 2",
    "response_roundtrip": f"select split, query_id, model_idx, model_name, {_round('y')} as y from responses",
    "response_check": "select split, count(*)::bigint as n, count(distinct query_id)::bigint as queries, count(distinct model_idx)::bigint as models, (count(*) filter (where y is null or isnan(y)))::bigint as bad from responses group by 1",
    "singleton_coverage": f"with {_WIDE}, {_SINGLE} select s::varchar as kept, {_round('max(u)')} as coverage, {_round('sum(u)')} as sum_uniqueness from single group by s",
    **{f"pair_certificates_{m}": f"with {_PAIR} select a, b, t as model_idx, {_round('wa')} as weight_a, {_round(chr(34) + m + chr(34))} as u, {_round('fit_distance')} as fit_distance from res" for m in ("mean_abs", "rmse", "max")},
    "pooled_searches": _pooled_sql(GAMMAS_POOLED, _round),
    "singleton_ranking": f"with {_WIDE}, {_SINGLE}, e1 as (select s, max(u) as c, sum(u) as su from single group by s) select row_number() over (order by c, s)::int as pos, s as model_idx, model_name, {_round('c')} as coverage, {_round('su')} as sum_uniqueness from e1 join (select distinct model_idx as s, model_name from responses) using (s)",
    "top_gains": f"""with {_PAIR}, {_SINGLE}, e1 as (select s, max(u) as c from single group by s), one as (select s, c from e1 order by c, s limit 1),
e2 as (select case when a = s then b else a end as j, max(mean_abs) as c from res, one where a = s or b = s group by 1)
select row_number() over (order by e2.c, j)::int as pos, j as model_idx, model_name, {_round('one.c - e2.c')} as gain from e2, one, (select distinct model_idx as k, model_name from responses) n where k = j order by pos limit 10""",
    "step_uniqueness": f"""with {_PAIR}, {_SINGLE}, names as (select distinct model_idx, model_name from responses),
u as (select 0 as step, t as i, u from single where s = 0 union all select 1, t, mean_abs from res where a = 0 and b = 1 union all select 1, i, 0 from m where i < 2) select step, model_name, {_round('u')} as u from u join names on model_idx = i""",
    "linear_rmse": _linear_rmse(),
    "model_roundtrip": f"""with {_ALL}, {_lagged('kept')}, fit as (select city, regr_slope(y, flow) as b, regr_intercept(y, flow) as a from feat where split = 'train' group by city)
select city, count(*)::bigint as n, {_round('avg(a + b * flow)')} as mean_y_hat, {_round('sqrt(avg(pow(a + b * flow - y, 2)))')} as test_rmse from feat join fit using (city) where split = 'test' group by city""",
    "csv_roundtrip": f"with {_CLEAN} select city, count(*)::bigint as n, count(distinct detid)::bigint as detectors, min(day)::varchar as first_day, {_round('avg(flow)')} as flow, {_round('avg(occ)')} as occ, {_round('avg(\"interval\")')} as seconds from clean where city in (select model_name from city_models) and detid <> '' group by city",
    "bundle_roundtrip": f"""{_PREP.replace(_KEPT, _ALL)}, able as (select city, count(*) filter (where split = 'val') as v, count(*) filter (where split = 'test') as t from prep group by city having count(*) filter (where split = 'train') >= 100 and v >= 20 and t >= 20)
select (row_number() over (order by city) - 1)::int as model_idx, city as model_name, (select least(1500, sum(v)) + least(1500, sum(t)) from able)::bigint as n, true as same from able""",
    "forced_lag": f"with {_ALL}, {_lagged('kept')} select {_K}, {', '.join(_col(c) for c in ('flow_lag1', 'flow_lag2', 'flow_lag6', 'flow_diff1'))} from feat",
    "ecosystem_plain": f"select query_id, len({_TOK})::double as target, length(text)::double as letters, ((length(text) - length(replace(text, '[MASK]', ''))) // 6)::double as masks from query_grid",
    "membership": "select gamma, model_name, string_agg(algorithm, ',' order by algorithm) as algorithms, count(*)::int as n_algorithms from (select distinct gamma, algorithm, unnest(kept_set_names) as model_name from run_summary) group by all",
    "result_files": "select gamma, algorithm, true as complete, true as within, true as written from (values (40.0::double), (60.0)) g(gamma), (values ('backward_elimination'), ('forward_selection'), ('priority_queue')) a(algorithm)",
    "optimality_check": "select (n - 2) * (n - 1) // 2 as tested, true as optimal from (select count(distinct model_idx)::int as n from responses)",
    "step_metrics": _step_metrics(),
    "bottleneck": f"with {_WIDE}, {_SINGLE} select s as kept, t as model_idx, model_name, {_round('u')} as u from single join (select distinct model_idx as t, model_name from responses) using (t) qualify row_number() over (partition by s order by u desc, t) = 1",
    "dose_grid": f"select doc_id, n::int as dose_no, theta, {_SEED.format(_DOSED)} as seed from documents, (values (0, 0.0::double), (1, 0.25), (2, 0.5)) v(n, theta)",
    "stable_seeds": "select query_id, seed from query_grid",
    "masked_texts": f"with {_MASK} select query_id, masked from masked",
    "text_responses": f"with {_MASK}, s as (select query_id, {_TOK.replace('text', 'masked')} as t, len(t) as n from masked), y as ({_SCORE}) select query_id, model_idx, model_name, {_round('y')} as y from y",
    "unique_names": "select name, doc_id as pos, case when k = 1 then name else name || '#' || k end as unique_name from (select *, row_number() over (partition by name order by doc_id) as k from (select doc_id, replace(concat_ws('/', source, kernel), '/', '_') as name from documents where source is not null))",
    "fit_eval_halves": "select doc_id, case when row_number() over (order by doc_id) <= greatest(1, (select count(*) from documents) // 2) then 'fit' else 'eval' end as half from documents",
    "sample_texts": "select doc_id from documents order by md5('7|' || doc_id), doc_id limit 50",
    "pooled_queries": " union all ".join(f"(select obs_id, '{r}' as role from ({_PREP} select obs_id from prep where split = '{s}' order by md5('0/{r}|' || obs_id), obs_id limit 300))" for s, r in (("val", "fit"), ("test", "eval"))),
    "simplex_functions": f"""with z as (select query_id, list((y - 300) / 100 order by model_idx) as z from responses where split = 'eval' group by 1),
p as (select *, list_transform(z, lambda x: greatest(x, 0)) as k, list_sum(list_transform(z, lambda x: greatest(x, 0))) as t from z),
w as (select *, list_transform(k, lambda x: case when t > 0 then x / t else 1 / len(k)::double end) as w from p)
select query_id, {_round('w[1]')} as w0, {_round('list_max(w)')} as w_most, {_round('list_sum(list_transform(w, lambda x: x * x))')} as w_squares, {_round('1 / (1 + exp(-z[1]))')} as s, {_round('exp(z[2]) / list_sum(list_transform(z, lambda x: exp(x)))')} as p1 from w""",
    "runs_ordered": f"select row_number() over (order by gamma, algorithm)::int as pos, {_round('gamma')} as gamma, algorithm, kept_set_size, {_round('coverage_e_s')} as coverage_e_s from run_summary",
    "kept_set_diff": """select a.gamma, array_to_string(list_sort(list_filter(a.kept_set_names, lambda x: list_contains(b.kept_set_names, x))), ',') as both,
  array_to_string(list_sort(list_filter(a.kept_set_names, lambda x: not list_contains(b.kept_set_names, x))), ',') as only_a, array_to_string(list_sort(list_filter(b.kept_set_names, lambda x: not list_contains(a.kept_set_names, x))), ',') as only_b
  from run_summary a join run_summary b on a.gamma = b.gamma and a.algorithm = 'backward_elimination' and b.algorithm = 'forward_selection'""",
    "summary_merge": "select gamma, algorithm, (kept_set_size + case when algorithm = 'priority_queue' then 100 else 0 end)::int as kept_set_size from run_summary",
    "algorithm_names": "select distinct algorithm from run_summary",
    "runs_json": "select gamma, algorithm, to_json({'kept_set_size': kept_set_size, 'satisfies_gamma': satisfies_gamma, 'kept_set_names': kept_set_names})::varchar as json from run_summary",
}
SQL |= {f"{f.__name__}_full": SQL[f.__name__].replace(_KEPT, _ALL) for f in FULL}
