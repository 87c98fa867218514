"""Runs of the searches over tolerances, their summaries, comparisons and reports."""

from __future__ import annotations

import json
import time
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.coverage import Coverage
from plumbline.operators.metrics import finite_json, model_stats, overall_stats, pairwise_stats, step_metrics, step_models
from plumbline.operators.search import ALGORITHMS, Result

SUMMARY = (
    "gamma double, algorithm string, kept_set_size int, coverage_e_s double, sum_uniqueness_u double, satisfies_gamma boolean, "
    "kept_set_names array<string>, removed_set_names array<string>, wall_time_seconds double, result_file string"
)


@dataclass
class Run:
    algorithm: str
    gamma: float
    seconds: float  # the search alone
    result: Result


def run(cov: Coverage, algorithm: str, gamma: float) -> Run:
    began = time.perf_counter()
    found = ALGORITHMS[algorithm](cov, gamma)
    return Run(algorithm, float(gamma), time.perf_counter() - began, found)


def sweep(cov: Coverage, gammas: Sequence[float], algorithms: Sequence[str] = ("backward_elimination", "forward_selection")) -> list[Run]:
    """All algorithms at all tolerances. Uniqueness doesn't depend on the tolerance, so sets scored for one serve the others."""
    return [run(cov, a, g) for g in gammas for a in algorithms]


def trajectory(cov: Coverage, r: Run) -> DataFrame:
    """step_metrics of each step, led by the algorithm's own start set (iteration 0), with iteration, action and the changed model."""
    start = () if r.algorithm != "backward_elimination" else tuple(range(cov.n))
    steps = [(0, "init", None, None, start), *((s.iteration, s.action, s.model_idx, s.model_name, s.kept) for s in r.result.history)]
    of = step_metrics(step_models(cov, [s[4] for s in steps], r.gamma))
    head = cov.spark.createDataFrame([(i, s[0], s[1], s[2], s[3], round(r.seconds, 4)) for i, s in enumerate(steps)], "step int, iteration int, action string, changed_model_idx int, changed_model_name string, elapsed_seconds double")
    return head.join(of, "step").drop("step").orderBy("iteration")


def result_file(r: Run) -> str:
    return f"{r.algorithm}_gamma{r.gamma:g}.json"


def summary(cov: Coverage, runs: Iterable[Run], folder: str | None = None) -> DataFrame:
    rows = []
    for r in runs:
        k = r.result
        names = lambda keep: [cov.names[i] for i in range(cov.n) if (i in k.kept) == keep]  # noqa: B023, E731
        file = f"{folder}/{result_file(r)}" if folder else result_file(r)
        rows.append((r.gamma, r.algorithm, len(k.kept), k.coverage, k.sum_uniqueness, k.coverage <= r.gamma, names(True), names(False), round(r.seconds, 4), file))
    return cov.spark.createDataFrame(rows, SUMMARY)


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of old whose algorithm isn't in new, and all of new, by tolerance and algorithm."""
    kept = old.join(new.select("algorithm").distinct(), "algorithm", "left_anti").select(*new.columns)
    return kept.unionByName(new).orderBy("gamma", "algorithm")


def compared(runs: DataFrame, a: str, b: str) -> DataFrame:
    """(gamma, both, only_a, only_b): how the kept sets of two algorithms differ at each tolerance."""
    side = lambda x, n: runs.where(F.col("algorithm") == x).select("gamma", F.col("kept_set_names").alias(n))
    met = side(a, "__a").join(side(b, "__b"), "gamma")
    sets = {"both": F.array_intersect("__a", "__b"), "only_a": F.array_except("__a", "__b"), "only_b": F.array_except("__b", "__a")}
    return met.select("gamma", *(F.array_sort(c).alias(n) for n, c in sets.items()))


def membership(runs: DataFrame, gamma: float | None = None) -> DataFrame:
    """(gamma, model_name, algorithms, n_algorithms): which of any number of algorithms kept a model, their names in order; with a gamma, at that tolerance only."""
    own = runs if gamma is None else runs.where(F.col("gamma") == gamma)
    each = own.select("gamma", "algorithm", F.explode("kept_set_names").alias("model_name"))
    return each.groupBy("gamma", "model_name").agg(F.array_sort(F.collect_set("algorithm")).alias("algorithms")).withColumn("n_algorithms", F.size("algorithms"))


def trajectory_json(cov: Coverage, r: Run, config: dict[str, object], kept_only: bool = False) -> str:
    """The run with its steps and certificates (of the kept models alone, if asked) as strict JSON."""
    steps = [row.asDict(recursive=True) for row in trajectory(cov, r).collect()]
    k = r.result
    certs = [{"model": c.model_name, "kept": list(c.kept), "weights": list(c.weights), "uniqueness": c.uniqueness, "fit_distance": c.fit_distance} for c in k.certificates if c.model_idx in k.kept or not kept_only]
    names = lambda keep: [cov.names[i] for i in range(cov.n) if (i in k.kept) == keep]
    final = {"kept_set_size": len(k.kept), "kept_set_idx": sorted(k.kept), "kept_set_names": names(True), "removed_set_names": names(False), "coverage_E_S": k.coverage, "sum_uniqueness_U": k.sum_uniqueness, "satisfies_gamma": k.coverage <= r.gamma}
    config = {"gamma": r.gamma, "metric": cov.metric, "n_models": cov.n, "model_names": cov.names, **config}
    return _json({"algorithm": r.algorithm, "config": config, "wall_time_seconds": round(r.seconds, 4), "final": final, "certificates": certs, "steps": steps})


def _json(value: object) -> str:
    return json.dumps(finite_json(value), indent=2, default=str)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file of the driver's, wherever Hadoop can write."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).create(hadoop, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def response_scale(responses: DataFrame, split: str = "eval") -> dict[str, object]:
    """Statistics of a split's responses by which tolerances can be read: of all, of each model, of pairwise differences."""
    first = lambda t: t.first().asDict()
    return {
        "global": first(overall_stats(responses, split)),
        "per_model": {r.model_name: {k: r[k] for k in ("mean", "std", "min", "max")} for r in model_stats(responses, split).orderBy("model_idx").collect()},
        "pairwise_abs_diff": first(pairwise_stats(responses, split)),
    }


def write_sweep(cov: Coverage, responses: DataFrame, runs: Sequence[Run], folder: str, config: dict[str, object] | None = None) -> DataFrame:
    """Files of a sweep: one JSON a run with its trajectory, summary.json and README.md; returns the summary's rows.

    If the folder holds a summary already, its runs of other algorithms are kept in it.
    """
    spark, folder, config = cov.spark, folder.rstrip("/"), config or {}
    for r in runs:
        write_text(spark, f"{folder}/{result_file(r)}", trajectory_json(cov, r, config))
    rows = merged(read_summary(spark, f"{folder}/summary.json"), summary(cov, runs))
    rows = spark.createDataFrame(rows.collect(), SUMMARY)  # as few as tolerances times algorithms; the file they came from is written anew
    n = {r.split: r.n for r in responses.groupBy("split").agg(F.count_distinct("query_id").alias("n")).collect()}
    scale = response_scale(responses)
    about = {"metric": cov.metric, "n_models": cov.n, "model_names": cov.names, **{f"Y_{s}_shape": [n.get(s, 0), cov.n] for s in ("fit", "eval")}, "Y_eval_stats": scale, **config}
    write_summary(rows, f"{folder}/summary.json", about)
    write_text(spark, f"{folder}/README.md", markdown(rows, scale))
    return rows


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """The runs of a summary file; none if there is no such file."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], SUMMARY)
    return spark.read.schema(f"runs array<struct<{SUMMARY.replace(' ', ':').replace(',:', ',')}>>").json(path, multiLine=True).select(F.inline("runs"))


def write_summary(runs: DataFrame, path: str, about: dict[str, object] | None = None) -> None:
    """One JSON document: what the sweep is about, its tolerances and algorithms, and its runs, as few as tolerances times algorithms."""
    rows = [r.asDict() for r in runs.orderBy("gamma", "algorithm").collect()]
    lists = {"gammas": sorted({r["gamma"] for r in rows}), "algorithms": sorted({r["algorithm"] for r in rows})}
    write_text(runs.sparkSession, path, _json({**lists, **(about or {}), "runs": rows}))


def markdown(runs: DataFrame, scale: dict[str, object] | None = None) -> str:
    """The scale of the responses, a table of the runs, what the algorithms kept at each tolerance and by what they differ, and the files."""
    rows = runs.orderBy("gamma", "algorithm").collect()
    lines = ["# Sweep over tolerances", ""]
    if scale:
        whole, pairs = scale["global"], scale["pairwise_abs_diff"]
        lines += [
            "## Scale of the responses",
            "",
            f"- all responses: mean {whole['mean']:.2f}, standard deviation {whole['std']:.2f}",
            f"- mean absolute difference of two models: mean {pairs['mean']:.2f}, median {pairs['median']:.2f}, from {pairs['min']:.2f} to {pairs['max']:.2f}",
            "",
        ]
    lines += ["## Runs", "", "| gamma | algorithm | kept | coverage | sum of uniqueness | within | seconds |", "|---|---|---|---|---|---|---|"]
    lines += [f"| {r.gamma:g} | {r.algorithm} | {r.kept_set_size} | {r.coverage_e_s:.3f} | {r.sum_uniqueness_u:.3f} | {'yes' if r.satisfies_gamma else 'no'} | {'' if r.wall_time_seconds is None else f'{r.wall_time_seconds:.3f}'} |" for r in rows]
    for g in sorted({r.gamma for r in rows}):
        own = [(r.algorithm, set(r.kept_set_names)) for r in rows if r.gamma == g]
        lines += ["", f"### gamma {g:g}", "", *(f"- {a} kept {len(s)}: {', '.join(sorted(s)) or 'none'}" for a, s in own)]
        lines += [f"- {a}, not {b}: {', '.join(sorted(s - z)) or 'none'}" for a, s in own for b, z in own if a != b]
    lines += ["", "## Files", "", "- summary.json: the runs, the scale, the settings", *(f"- {r.result_file}: the steps of {r.algorithm} at {r.gamma:g}" for r in rows)]
    return "\n".join(lines) + "\n"
