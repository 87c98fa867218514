"""Feature series, learners, text functions and bundles on small tables."""

from __future__ import annotations

import datetime as dt
import math
import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.scalars import mask_text, on_simplex, shuffled_mask, sigmoid, softmax, stable_seed, stable_seed_of
from plumbline.operators import series as series_module
from plumbline.operators.bundle import build_bundle
from plumbline.operators.ecosystem import ClassifierUnit, Ecosystem, FunctionUnit, class_one, load_classifier, loaded
from plumbline.operators.learners import BoostConfig, BoostedTrees, boosted_models, linear_models, predict, score_linear
from plumbline.operators.metrics import gram_table
from plumbline.operators.responses import dose_grid, head_tail, response_long, response_wide, sample_rows, unique_names
from plumbline.operators.series import SeriesConfig, busiest_detectors, clean_observations, feature_names, finite_rows, lag_features, prepare, recent_days
from plumbline.sources.observations import load_models, read_csv, save_models
from plumbline.streaming.gram import gram_stream


def test_clean_text_input(spark, tmp_path):
    (tmp_path / "a.csv").write_text("day,interval,detid,flow,occ,error,city,speed\n2020-01-01,0,a,1,0.1,0,x,\nbad,0,a,1,0.1,0,x,\n2020-01-01,z,a,1,0.1,0,x,\n2020-01-01,1,a,inf,0.1,0,x,\n2020-01-01,2,a,2,0.1,q,x,5\n2020-01-01,3,a,2,0.1,1,x,5\n2020-01-01,4,,2,0.1,,x,5\n2020-01-01,5,b,2,NaN,,x,5\n2020-01-01,6,b,2,0.2,,y,5\n")
    raw = read_csv(spark, f"file://{tmp_path}/a.csv")
    assert "speed" not in raw.columns and "speed" in read_csv(spark, f"file://{tmp_path}/a.csv", whole=True).columns
    assert sorted(r.interval for r in clean_observations(raw).collect()) == [0.0, 2.0, 6.0]
    assert clean_observations(raw.drop("error")).count() == 4
    assert read_csv(spark, f"file://{tmp_path}/a.csv", cities=["y"]).count() == 1


def obs(spark, rows):
    return spark.createDataFrame([(i, dt.date(2020, 1, 1) + dt.timedelta(d), float(s), det, float(f), 0.1 * f, 0.0, c) for i, (c, det, d, s, f) in enumerate(rows)], "obs_id long, day date, interval double, detid string, flow double, occ double, error double, city string")


def test_recent_and_top(spark):
    t = obs(spark, [("x", "a", 0, 0, 1), ("x", "a", 9, 0, 1), ("x", "b", 9, 0, 1), ("x", "b", 8, 0, 1), ("y", "a", 3, 0, 1), ("x", "c", 9, 1, 1), ("x", "c", 9, 2, 1)])
    assert recent_days(t, 2).count() == 6 and recent_days(t, None).count() == 7
    top = busiest_detectors(t, 2, 2).collect()
    assert sorted((r.city, r.detid) for r in top) == [("x", "a"), ("x", "b")]  # three ties, the first seen stay
    assert recent_days(t.limit(0), 3).count() == 0 and busiest_detectors(t.limit(0), 2, 1).count() == 0


def test_lags_and_split(spark):
    t = obs(spark, [("x", "a", i // 4, i % 4, i * 10) for i in range(20)])
    rows = lag_features(t, (2,), 1).orderBy("day", "interval").collect()
    assert rows[5].flow_lag2 == 30 and rows[5].flow_lag1 == 40 and rows[5].occ_lag1 == pytest.approx(4) and rows[5].y == 60 and rows[5].flow_diff1 == 10
    assert [r.split for r in rows] == ["train"] * 11 + [None] + ["val"] * 3 + [None] + ["test"] * 3 + [None]
    assert feature_names((2,))[-4:] == ["flow_lag1", "flow_lag2", "occ_lag1", "occ_lag2"]


def test_linear_models_are_least_squares(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3)) * [1, 100, 0.01] + [5, 1000, 0]
    y = x @ [2.0, -0.5, 30.0] + 7 + rng.normal(size=200)
    rows = spark.createDataFrame([("g" if i % 2 else "h", *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "city string, a double, b double, c double, y double")
    m = {r.city: r for r in linear_models(rows, ["a", "b", "c"]).collect()}
    for k, part in (("g", slice(1, None, 2)), ("h", slice(0, None, 2))):
        a = np.c_[x[part], np.ones(100)]
        w = np.linalg.lstsq(a, y[part], rcond=None)[0]
        assert m[k].weights == pytest.approx(w[:3], rel=1e-3) and m[k].train_rmse == pytest.approx(np.sqrt(np.mean((a @ w - y[part]) ** 2)), rel=1e-4)
    models = linear_models(rows, ["a", "b", "c"]).withColumnRenamed("city", "model_name")
    scored = score_linear(rows.withColumn("query_id", F.monotonically_increasing_id()), ["a", "b", "c"], models)
    assert scored.count() == 400


def test_boosting_learns():
    rng = np.random.default_rng(2)
    x = rng.uniform(-2, 2, size=(3000, 3))
    y = np.where(x[:, 0] > 0, 3, -1) * x[:, 1] + 0.05 * rng.normal(size=3000)
    m = BoostedTrees(BoostConfig(rounds=60, learning_rate=0.2, min_leaf=10)).fit(x[:2000], y[:2000])
    assert np.sqrt(np.mean((m.predict(x[2000:]) - y[2000:]) ** 2)) < 0.35 * y.std()


def test_boosted_models_per_group(spark):
    rows = spark.createDataFrame([(i, "p" if i % 3 else "q", float(i % 17), float((i % 17) ** 2)) for i in range(600)], "obs_id long, city string, a double, y double")
    got = boosted_models(rows, ["a"], config=BoostConfig(rounds=30, learning_rate=0.3, min_leaf=5, max_rows=300)).collect()
    assert sorted(r.city for r in got) == ["p", "q"] and all(0 < r.n <= 360 and r.train_rmse < 20 for r in got)


def test_bundle(spark, data, tmp_path):
    raw = spark.read.parquet(f"{data}/utd19_u.parquet")
    c = SeriesConfig(days=None, detectors=None, min_points=30, lags=(1, 2))
    b = build_bundle(raw, c, (60, 10, 10), (50, 40), folder=f"file://{tmp_path}")
    n = b.models.count()
    per = {(r.split, r.model_idx): r["count"] for r in b.responses.groupBy("split", "model_idx").count().collect()}
    assert n >= 3 and set(per.values()) == {50, 40} and len(per) == 2 * n
    again = build_bundle(raw.limit(0), c, (60, 10, 10), (50, 40), folder=f"file://{tmp_path}")
    assert again.responses.count() == b.responses.count()
    with pytest.raises(RuntimeError):
        build_bundle(raw, c, (10**6, 1, 1))
    rows, names = prepare(raw.limit(0), c)
    assert rows.count() == 0 and len(names) == 13


def test_boosted_bundle_answers_with_its_models(spark, data):
    raw = spark.read.parquet(f"{data}/utd19_u.parquet")
    c, boost = SeriesConfig(days=None, detectors=None, min_points=30, lags=(1, 2)), BoostConfig(rounds=5, min_leaf=5, max_rows=None)
    b = build_bundle(raw, c, (60, 10, 10), (50, 40), boost=boost)
    got = {(r.split, r.query_id, r.model_name): r.y for r in b.responses.collect()}
    rows, names = prepare(raw, c)
    rows = finite_rows(rows, names)
    at = {r.obs_id: [float(r[k]) for k in names] for r in rows.where("split in ('val', 'test')").collect()}
    train = rows.where("split = 'train'")
    n = {r.city: r["count"] for r in train.groupBy("city").count().collect()}
    models = {r.city: r for r in boosted_models(train, names, config=boost).collect()}
    assert len(got) == 90 * b.models.count() and all(models[k].n == n[k] for k in models)
    for name in {k[2] for k in got}:
        keys = [k for k in got if k[2] == name]
        assert pickle.loads(models[name].model).predict(np.array([at[k[1]] for k in keys])) == pytest.approx([got[k] for k in keys], abs=1e-6)


def test_seed_and_mask(spark):
    t = spark.createDataFrame([(0, "a b c d e", 0.5, 3), (1, "", 0.5, 3), (2, None, 0.5, 3), (3, "x  y", 0.0, 1), (4, "x y", 2.0, 1), (5, "u v", 0.25, 1)], "k int, t string, theta double, seed long")
    got = {r.k: r for r in t.select("k", mask_text(F.col("t"), F.col("theta"), F.col("seed")).alias("m"), stable_seed(F.col("t"), F.lit("z")).alias("s")).collect()}
    assert got[0].m.split().count("[MASK]") == 2 and got[1].m == "" and got[2].m is None and got[3].m == "x  y" and got[4].m == "[MASK] [MASK]" and got[5].m == "u v"
    assert got[0].s == stable_seed_of("a b c d e", "z")
    assert shuffled_mask("a b c d", 0.5, 1) == shuffled_mask("a b c d", 0.5, 1) and shuffled_mask("a b c d", 0.5, 1).count("[MASK]") == 2 and shuffled_mask("a  b", 0, 1) == "a  b"


def test_text_operators(spark):
    t = spark.createDataFrame([(i, f"t{i % 3}") for i in range(7)], "doc_id long, text string")
    assert [r.half for r in head_tail(t, "doc_id").orderBy("doc_id").collect()] == ["fit"] * 3 + ["eval"] * 4
    assert sorted(r.half for r in head_tail(t.limit(1), "doc_id").collect()) == ["eval", "fit"] and head_tail(t.limit(0), "doc_id").count() == 0
    g = dose_grid(t, (0.0, 0.5)).collect()
    assert len(g) == 14 and len({r.seed for r in g}) == 6
    assert sample_rows(t, 3, "1", "doc_id").count() == 3 == sample_rows(t.repartition(5), 3, "1", "doc_id").intersect(sample_rows(t, 3, "1", "doc_id")).count()
    assert [r.unique_name for r in unique_names(t.select(F.col("text").alias("name"), F.col("doc_id").alias("pos"))).orderBy("pos").collect()] == ["t0", "t1", "t2", "t0#2", "t1#2", "t2#2", "t0#3"]


def test_responses_and_stream(spark, tmp_path):
    r = spark.createDataFrame([(s, q, i, f"m{i}", float(q * 3 + i)) for s in ("fit", "eval") for q in range(4) for i in range(3)], "split string, query_id long, model_idx int, model_name string, y double")
    w = response_wide(r)
    assert response_long(w, ["m0", "m1", "m2"]).select(*r.columns).exceptAll(r).count() == 0
    want = {(x.model_i, x.model_j): x.g for x in gram_table(r).collect()}
    w.where("split = 'fit'").repartition(3).write.parquet(f"{tmp_path}/in")
    q = gram_stream(spark.readStream.schema(w.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")).writeStream.outputMode("complete").format("memory").queryName("gram_test").start()
    q.processAllAvailable()
    q.stop()
    assert {(x.model_i, x.model_j): x.g for x in spark.table("gram_test").collect()} == want


def test_ecosystem(spark):
    class Shift:
        def apply(self, x, theta):
            return x + "!" * int(theta)

    q = spark.createDataFrame([(1, "ab", 1.0, 5), (2, "", 0.0, None)], "query_id long, text string, theta double, seed long")
    e = Ecosystem(FunctionUnit("n", len), [FunctionUnit("twice", lambda t: 2 * len(t))])
    assert [(r.target, r.peers) for r in e.ask(q, Shift()).orderBy("query_id").collect()] == [(3.0, [6.0]), (0.0, [0.0])]
    assert FunctionUnit("n", len).query("abc", 2.0, Shift()) == 5

    def load(n):
        if n == "bad":
            raise OSError("no file")
        return FunctionUnit(n, len)

    said = []
    assert [u.name for u in loaded(["a", "bad", "b"], load, said.append)] == ["a", "b"] and len(said) == 1
    with pytest.raises(RuntimeError):
        loaded(["a", "bad"], load, said.append)


def test_scalar_functions(spark):
    r = spark.range(1).select(on_simplex(F.array(F.lit(-1.0), F.lit(1.0), F.lit(3.0))).alias("w"), on_simplex(F.array(F.lit(-1.0), F.lit(0.0))).alias("z"), sigmoid(F.lit(0.0)).alias("s"), softmax(F.array(F.lit(1000.0), F.lit(1000.0))).alias("p")).first()
    assert r.w == [0, 0.25, 0.75] and r.z == [0.5, 0.5] and r.s == 0.5 and r.p == 0.5


def test_long_series_are_cut(spark, data, monkeypatch):
    """Pieces of any length give the lags, targets and splits of the whole series."""
    raw = spark.read.parquet(f"{data}/utd19_u.parquet")
    config = SeriesConfig(horizon=2, lags=(1, 3, 7), days=None, detectors=None, min_points=50)
    show = lambda: sorted(map(repr, series_module.lagged(raw, config).drop("loaded_at").collect()))
    monkeypatch.setattr(series_module, "PIECE_ROWS", 10**9)
    whole = show()
    for n in (1, 9, 100):
        monkeypatch.setattr(series_module, "PIECE_ROWS", n)
        assert show() == whole
    obs = clean_observations(raw)
    cut = lag_features(obs, (1, 3, 7), 2)
    assert cut.count() == obs.count() and cut.columns[: len(obs.columns)] == obs.columns


def test_features_read_the_table_twice(spark, data):
    """Once for the counts, in a job of its own; once in the plan of the rows, without a window over raw rows by detector alone."""
    import contextlib
    import io

    rows, _ = prepare(spark.read.parquet(f"{data}/utd19_u.parquet"), SeriesConfig(min_points=50))
    with contextlib.redirect_stdout(io.StringIO()) as out:
        rows.explain("formatted")
    assert out.getvalue().count(f"{data}/utd19_u.parquet") == 1


def test_predict_by_own_model(spark):
    rows = spark.createDataFrame([(i, g, float(i), float(i * k + 1)) for i in range(40) for g, k in (("a", 2), ("b", -3), (None, 5))] + [(99, "none", 1.0, 1.0)], "obs_id long, city string, x double, y double")
    models = linear_models(rows.where("city in ('a', 'b')"), ["x"], ridge=0.0)
    got = predict(rows, ["x"], models).collect()
    assert {(r.city, round(r.y_hat, 6)) for r in got if r.obs_id == 7} == {("a", 15.0), ("b", -20.0)} and len(got) == 80
    trees = boosted_models(rows.where("city in ('a', 'b')"), ["x"], config=BoostConfig(rounds=40, min_leaf=2, learning_rate=0.3))
    told = predict(rows, ["x"], trees).join(rows, ["obs_id", "city"]).collect()
    assert len(told) == 80 and max(abs(r.y_hat - r.y) for r in told) < 8


def test_models_saved_and_loaded(spark, tmp_path):
    models = spark.createDataFrame([("a/b", [1.0], 2.0), ("c", [3.0], 4.0)], "city string, weights array<double>, intercept double")
    at = save_models(models, f"file://{tmp_path}/m")
    assert sorted(map(repr, load_models(spark, at).select(*models.columns).collect())) == sorted(map(repr, models.collect()))
    assert [r.city for r in load_models(spark, at, ["a/b"]).collect()] == ["a/b"]


def test_numbers_of_frequent_names(spark):
    names = spark.createDataFrame([(("x" if i % 3 else None), None if i in (5, 11) else i) for i in range(60)], "name string, pos int")
    got = unique_names(names).collect()
    assert len(got) == 60
    mine = sorted((r.pos, r.unique_name) for r in got if r.name == "x" and r.pos is not None)
    assert [u for _, u in mine] == [f"x#{k}" for k in range(3, 41)]  # the two without a place come first
    halves = head_tail(names.withColumn("i", F.lit(1)), "pos").collect()
    assert len(halves) == 60 and sum(r.half == "fit" for r in halves) == 30 and all(r.half == "fit" for r in halves if r.pos is None)


def test_classifier_in_batches():
    seen = []

    def logits(batch):
        seen.append([len(b) for b in batch])
        return [[0.0, float(len(b)) - 3] if b and b[0] == "two" else [float(len(b))] for b in batch]

    unit = ClassifierUnit("c", str.split, logits, max_tokens=4, batch_size=2)
    got = unit.answer(["two b", "a b c d e f", None, "x"])
    assert seen == [[2, 4], [0, 1]]
    assert got == pytest.approx([1 / (1 + math.exp(1)), 1 / (1 + math.exp(-4)), 0.5, 1 / (1 + math.exp(-1))])
    warned = []

    def broken(name):
        raise OSError("none")

    assert load_classifier("n", lambda _: logits, broken, lambda _: str.split, warned.append).answer(["x"]) and warned
    assert class_one([-800.0]) == 0.0 and class_one([1000.0, 1000.0]) == 0.5
