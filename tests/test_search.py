"""Solver, coverage and searches against brute force."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest

from plumbline.operators import coverage
from plumbline.operators.coverage import Coverage
from plumbline.operators.metrics import step_metrics, step_models
from plumbline.operators.report import compared, markdown, membership, merged, read_summary, run, summary, sweep, trajectory_json, write_summary, write_sweep
from plumbline.operators.search import ALGORITHMS, backward, forward, gains, lazy, singletons
from plumbline.operators.simplex import duality_gap, nearest_mixture

SCHEMA = "split string, query_id long, model_idx int, model_name string, y double"


def relation(spark, fit, ev, names=None):
    rows = [(s, q, i, (names or [f"m{k}" for k in range(len(r))])[i], float(y)) for s, m in (("fit", fit), ("eval", ev)) for q, r in enumerate(m) for i, y in enumerate(r)]
    return spark.createDataFrame(rows, SCHEMA)


def test_solver_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(300):
        p, n = int(rng.integers(1, 15)), int(rng.integers(1, 30))
        a = rng.normal(size=(n, p)) * rng.choice([1e-3, 1, 1e4])
        h = a.T @ a
        w = nearest_mixture(h)
        assert (w >= 0).all() and abs(w.sum() - 1) < 1e-9 and duality_gap(h, w) < 1e-10
        u = np.full(p, 1 / p)
        assert w @ h @ w <= u @ h @ u * (1 + 1e-9) + 1e-12


def test_solver_degenerate():
    assert nearest_mixture(np.zeros((3, 3))).sum() == pytest.approx(1)
    assert nearest_mixture(np.ones((3, 3))).sum() == pytest.approx(1)
    assert nearest_mixture(np.array([[5.0]])).tolist() == [1.0]


def brute(fit, ev, kept, metric):
    """Uniqueness by a fine search of the simplex's faces with the solver left out: least squares on every support."""
    n = fit.shape[1]
    u = np.zeros(n)
    order = sorted(kept)
    for i in range(n):
        if i in kept:
            continue
        if not order:
            u[i] = math.inf
            continue
        best = None
        for k in range(1, len(order) + 1):
            for s in itertools.combinations(order, k):
                p = fit[:, s] - fit[:, [i]]
                m = np.block([[p.T @ p, np.ones((k, 1))], [np.ones((1, k)), np.zeros((1, 1))]])
                w = np.linalg.lstsq(m, np.r_[np.zeros(k), 1.0], rcond=None)[0][:-1]
                if (w >= -1e-9).all() and abs(w.sum() - 1) < 1e-6:
                    v = ((p @ w) ** 2).sum()
                    if best is None or v < best[0] - 1e-12:
                        best = (v, s, w)
        r = ev[:, best[1]] @ best[2] - ev[:, i]
        u[i] = {"mean_abs": np.abs(r).mean(), "rmse": np.sqrt((r**2).mean()), "max": np.abs(r).max()}[metric]
    return u


@pytest.fixture(scope="module")
def small():
    rng = np.random.default_rng(5)
    return rng.normal(size=(40, 5)).cumsum(1) * 10, rng.normal(size=(30, 5)).cumsum(1) * 10


@pytest.mark.parametrize("metric", ["mean_abs", "rmse", "max"])
@pytest.mark.parametrize("local", [True, False])
def test_coverage_of_all_sets(spark, small, metric, local, monkeypatch):
    monkeypatch.setattr(coverage, "LOCAL_BYTES", (1 << 20) * local)
    cov = Coverage(relation(spark, *small), metric)
    assert (cov.local is not None) == local
    sets = [s for k in range(6) for s in itertools.combinations(range(5), k)]
    cov.batch(sets)
    for s in sets:
        assert np.allclose(cov.uniqueness(s), brute(*small, s, metric), rtol=1e-6)
    assert cov.coverage(()) == math.inf and cov.coverage(range(5)) == 0
    c = cov.certificates((1, 3))
    assert c[1].uniqueness == 0 and c[1].weights == (1.0, 0.0) and c[0].kept == (1, 3)
    for s, i in (((1, 3), 0), ((0, 2, 4), 3), ((2,), 4)):
        left = small[0][:, sorted(s)] @ cov.weights(frozenset(s))[i, sorted(s)] - small[0][:, i]
        assert cov.fit_distance(s, i) == pytest.approx(np.sqrt((left**2).sum())) == cov.certificates(s)[i].fit_distance
    assert cov.fit_distance((), 0) == math.inf and cov.fit_distance((1,), 1) == 0
    assert cov.bottleneck((1,)).model_idx == int(np.argmax(cov.uniqueness((1,))))
    cov.close()


def test_searches_replayed(spark, small):
    cov = Coverage(relation(spark, *small))
    e = {frozenset(s): round(brute(*small, s, "mean_abs").max(), 9) for k in range(6) for s in itertools.combinations(range(5), k)}
    for gamma in (0.0, 3.0, 6.0, 9.0, 15.0, 100.0):
        kept = set()
        while not kept or (e[frozenset(kept)] > gamma and len(kept) < 5):
            kept.add(min((e[frozenset(kept | {j})], j) for j in range(5) if j not in kept)[1])
        f = forward(cov, gamma)
        assert f.kept == kept and f.history[-1].action == "stop" and len(f.history) == len(kept) + 1
        kept = set(range(5))
        while True:
            c = min((e[frozenset(kept - {j})], j) for j in kept)
            if c[0] > gamma or c[0] == math.inf:
                break
            kept.remove(c[1])
        assert backward(cov, gamma).kept == kept
        z = lazy(cov, gamma)
        assert z.coverage <= gamma and all(e[z.kept - {j}] > gamma for j in z.kept)
        for r in (f, z):
            sizes = [set(s.kept) for s in r.history]
            assert all(len(a ^ b) <= 1 for a, b in zip(sizes, sizes[1:]))
    # No tolerance at all, none that can be met, and one that all meet.
    assert forward(cov, -1.0).kept == frozenset(range(5))
    assert backward(cov, math.inf).kept and len(backward(cov, math.inf).kept) == 1
    assert lazy(cov, math.inf).kept == frozenset()
    cov.close()


def test_ties_and_copies(spark):
    y = np.array([[1.0, 1.0, 0.0], [2.0, 2.0, 0.0], [3.0, 3.0, 0.0]])
    cov = Coverage(relation(spark, y, y))
    assert cov.coverage((0,)) == cov.coverage((1,)) and forward(cov, 2.5).history[0].model_idx == 0
    assert cov.coverage((0, 2)) == pytest.approx(0, abs=1e-12)
    cov.close()


def test_bad_responses(spark, small):
    good = relation(spark, *small)
    for wrong in (good.where("split = 'fit'"), good.where("not (query_id = 0 and model_idx = 1)"), good.selectExpr("split", "query_id", "model_idx", "model_name", "case when query_id = 3 then double('NaN') else y end as y"), good.unionByName(good.limit(1)), good.limit(0), good.where("model_idx <> 2")):
        with pytest.raises(ValueError):
            Coverage(wrong)
    with pytest.raises(ValueError):
        Coverage(good, "median")
    with pytest.raises(ValueError):
        Coverage(good, names=["a"])


def test_one_and_two_models(spark):
    y = np.array([[1.0], [2.0]])
    cov = Coverage(relation(spark, y, y))
    assert forward(cov, 0.0).kept == {0} == lazy(cov, 0.0).kept and backward(cov, 5.0).kept == {0}
    cov.close()
    y = np.array([[1.0, 4.0], [2.0, 6.0]])
    cov = Coverage(relation(spark, y, y))
    assert cov.coverage((0,)) == 3.5 and forward(cov, 3.5).kept == {0}
    cov.close()


def test_step_metrics(spark, small):
    cov = Coverage(relation(spark, *small))
    sets = [(), (0,), (0, 2, 4), tuple(range(5))]
    got = {r.step: r for r in step_metrics(step_models(cov, sets, 6.0)).collect()}
    for k, s in enumerate(sets[1:], 1):
        u, r = cov.uniqueness(s), got[k]
        ext = [u[i] for i in range(5) if i not in s] or [0.0]
        assert r.coverage_e_s == u.max() and r.u_mean == pytest.approx(u.mean()) and r.u_std == pytest.approx(u.std()) and r.u_median == pytest.approx(np.median(u))
        assert [r.u_p25, r.u_p75, r.u_p90, r.u_p95] == pytest.approx(list(np.percentile(u, [25, 75, 90, 95])))
        assert [r.u_ext_mean, r.u_ext_max, r.u_ext_sum] == pytest.approx([np.mean(ext), max(ext), sum(ext)])
        assert r.n_models_violating_gamma == (u > 6).sum() and r.bottleneck_model_idx == int(u.argmax()) and r.per_model_uniqueness == {f"m{i}": u[i] for i in range(5)}
        w = [cov.weights(frozenset(s))[i] for i in range(5) if i not in s]
        assert r.routing_avg_n_nonzero_weights == pytest.approx(np.mean([(x > 1e-6).sum() for x in w]) if w else 0)
        assert r.routing_weight_entropy_mean == pytest.approx(np.mean([-(x[x > 1e-12] * np.log(x[x > 1e-12])).sum() for x in w]) if w else 0, abs=1e-12)
    assert got[0].coverage_e_s == math.inf and got[0].sum_uniqueness_u == math.inf and math.isnan(got[0].u_std) and got[0].kept_set_size == 0
    cov.close()


def test_reports(spark, small, tmp_path):
    cov = Coverage(relation(spark, *small))
    runs = sweep(cov, (3.0, 9.0), tuple(ALGORITHMS))
    s = summary(cov, runs).persist()
    assert s.count() == 6 and "gamma 9" in markdown(s)
    assert compared(s, "forward_selection", "backward_elimination").count() == 2
    new = s.where("algorithm = 'priority_queue'").selectExpr("gamma", "algorithm", "99 as kept_set_size", *s.columns[3:])
    m = merged(s, new).collect()
    assert len(m) == 6 and [r.kept_set_size == 99 for r in m].count(True) == 2 and [(r.gamma, r.algorithm) for r in m] == sorted((r.gamma, r.algorithm) for r in m)
    path = f"file://{tmp_path}/summary.json"
    assert read_summary(spark, path).count() == 0
    write_summary(s, path)
    assert sorted(map(repr, read_summary(spark, path).select("gamma", "algorithm", "kept_set_names").collect())) == sorted(map(repr, s.select("gamma", "algorithm", "kept_set_names").collect()))
    import json

    j = json.loads(trajectory_json(cov, run(cov, "forward_selection", 9.0), {"metric": "mean_abs"}))
    assert j["steps"][0]["action"] == "init" and j["steps"][0]["coverage_e_s"] == "Infinity" and len(j["certificates"]) == 5
    cov.close()


def test_sweep_files(spark, small, tmp_path):
    import json

    responses = relation(spark, *small)
    cov = Coverage(responses)
    at = f"file://{tmp_path}/sweep"
    rows = write_sweep(cov, responses, sweep(cov, (3.0, 9.0)), at, {"source": "here"})
    assert rows.count() == 4
    both = write_sweep(cov, responses, sweep(cov, (3.0, 9.0), ("priority_queue",)), at)
    assert both.count() == 6 and {(r.gamma, r.algorithm) for r in both.collect()} == {(g, a) for g in (3.0, 9.0) for a in ALGORITHMS}
    whole = json.loads((tmp_path / "sweep/summary.json").read_text())
    assert whole["gammas"] == [3.0, 9.0] and whole["algorithms"] == sorted(ALGORITHMS) and whole["Y_eval_shape"] == [30, 5] and whole["n_models"] == 5
    assert whole["Y_eval_stats"]["global"]["mean"] == pytest.approx(small[1].mean()) and set(whole["Y_eval_stats"]["per_model"]) == {f"m{i}" for i in range(5)}
    for r in whole["runs"]:
        one = json.loads((tmp_path / "sweep" / r["result_file"]).read_text())
        assert one["algorithm"] == r["algorithm"] and one["final"]["kept_set_names"] == r["kept_set_names"] and one["steps"][0]["action"] == "init"
        assert set(one["steps"][-1]["per_model_uniqueness"]) == set(cov.names)
    text = (tmp_path / "sweep/README.md").read_text()
    assert "Scale of the responses" in text and "backward_elimination, not forward_selection" in text and "forward_selection_gamma9.json" in text
    three = membership(both, 9.0).collect()
    kept = {r.algorithm: set(r.kept_set_names) for r in both.where("gamma = 9").collect()}
    assert {r.model_name: set(r.algorithms) for r in three} == {m: {a for a, s in kept.items() if m in s} for m in set().union(*kept.values())}
    only = json.loads(trajectory_json(cov, run(cov, "forward_selection", 9.0), {}, kept_only=True))
    assert {c["model"] for c in only["certificates"]} == set(only["final"]["kept_set_names"])
    cov.close()


def test_candidates_are_traced(spark, small, caplog):
    cov = Coverage(relation(spark, *small))
    with caplog.at_level("DEBUG", "plumbline.search"):
        r = forward(cov, 3.0)
    assert any("candidate" in m for m in caplog.messages)
    trace = r.trace_rows(spark).collect()
    first = {t.candidate_idx: t.coverage for t in trace if t.iteration == 1}
    assert first == {j: cov.coverage((j,)) for j in range(5)}
    assert [(t.iteration, t.candidate_idx) for t in trace if t.chosen] == [(s.iteration, s.model_idx) for s in r.history if s.action == "add"]
    assert [s[1] for s in singletons(cov)] == sorted(range(5), key=lambda j: (cov.coverage((j,)), j)) and singletons(cov)[0][3] == min(first.values())
    g = gains(cov, [0], 3)
    assert len(g) == 3 and all(x[3] == cov.coverage((0,)) - cov.coverage((0, x[1])) for x in g) and [x[3] for x in g] == sorted((x[3] for x in g), reverse=True)
    cov.close()


def test_models_without_a_name(spark, small):
    cov = Coverage(relation(spark, *small, names=["a", None, "c", None, "e"]), names=[])
    assert cov.names == ["a", "model_1", "c", "model_3", "e"]
    cov.close()
