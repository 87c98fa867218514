"""Greedy searches for a small set of kept models whose coverage stays within a tolerance."""

from __future__ import annotations

import heapq
import logging
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from plumbline.operators.coverage import Certificate, Coverage

LOG = logging.getLogger("plumbline.search")
HISTORY = "iteration int, action string, model_idx int, model_name string, kept array<int>, coverage double, sum_uniqueness double"
TRACE = "iteration int, candidate_idx int, candidate_name string, coverage double, chosen boolean"


@dataclass(frozen=True)
class Step:
    iteration: int
    action: str  # add, remove or stop
    model_idx: int | None
    model_name: str | None
    kept: tuple[int, ...]
    coverage: float
    sum_uniqueness: float


@dataclass
class Result:
    kept: frozenset[int]
    coverage: float
    sum_uniqueness: float
    history: list[Step]
    certificates: list[Certificate]
    pops: list[tuple[int, bool]] = field(default_factory=list)  # lazy search: model taken from the heap, and if its gain was fresh
    trace: list[tuple[int, int, str, float, bool]] = field(default_factory=list)  # candidates compared in each iteration

    def history_rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(s.iteration, s.action, s.model_idx, s.model_name, list(s.kept), s.coverage, s.sum_uniqueness) for s in self.history], HISTORY)

    def trace_rows(self, spark: SparkSession) -> DataFrame:
        """Every candidate that forward or backward search compared, with the coverage it would have led to."""
        return spark.createDataFrame(self.trace, TRACE)


class _Walk:
    """The kept set and what was done to it."""

    def __init__(self, cov: Coverage, kept: Iterable[int]) -> None:
        self.cov, self.kept, self.steps = cov, frozenset(kept), []
        self.trace: list[tuple[int, int, str, float, bool]] = []

    def note(self, action: str, model: int | None) -> None:
        name = None if model is None else self.cov.names[model]
        LOG.debug("%s %s: kept %s", action, name, sorted(self.kept))
        self.steps.append(Step(len(self.steps) + 1, action, model, name, tuple(sorted(self.kept)), self.cov.coverage(self.kept), self.cov.total(self.kept)))

    def add(self, model: int) -> None:
        self.kept |= {model}
        self.note("add", model)

    def remove(self, model: int) -> None:
        self.kept -= {model}
        self.note("remove", model)

    def best(self, candidates: list[int], change: Callable[[int], frozenset[int]]) -> tuple[float, int]:
        """Least coverage after the change, the lowest index on a tie; all candidates in one job."""
        self.cov.batch(change(j) for j in candidates)
        found = [(self.cov.coverage(change(j)), j) for j in candidates]
        best = min(found)
        for e, j in found:
            LOG.debug("candidate %s: coverage %.6f%s", self.cov.names[j], e, " *" if j == best[1] else "")
        self.trace += [(len(self.steps) + 1, j, self.cov.names[j], e, j == best[1]) for e, j in found]
        return best

    def result(self) -> Result:
        self.note("stop", None)
        s = self.steps[-1]
        return Result(self.kept, s.coverage, s.sum_uniqueness, self.steps, self.cov.certificates(self.kept), trace=self.trace)


def forward(cov: Coverage, gamma: float) -> Result:
    """From nothing, adds the model that leaves the least coverage, even if it rises, until it is within gamma or no model is left."""
    walk = _Walk(cov, ())
    while (rest := [j for j in range(cov.n) if j not in walk.kept]) and not (walk.kept and cov.coverage(walk.kept) <= gamma):
        walk.add(walk.best(rest, lambda j: walk.kept | {j})[1])
    return walk.result()


def backward(cov: Coverage, gamma: float) -> Result:
    """From all models, removes the one that leaves the least coverage as long as it stays within gamma and finite."""
    walk = _Walk(cov, range(cov.n))
    while walk.kept:
        e, j = walk.best(sorted(walk.kept), lambda j: walk.kept - {j})
        if not (e <= gamma and e < float("inf")):
            break
        walk.remove(j)
    return walk.result()


def lazy(cov: Coverage, gamma: float) -> Result:
    """Adds from a heap of gains that are brought up to date only when they come up, then drops what is not needed.

    Coverage is no monotone function of the set, so an old gain bounds nothing and the order of the heap matters: pops are
    replayed one by one. Only the scoring runs ahead, all models still in the heap in one job after each addition.
    """
    walk = _Walk(cov, ())
    walk.add(walk.best(list(range(cov.n)), lambda j: frozenset({j}))[1])
    pops: list[tuple[int, bool]] = []
    if cov.coverage(walk.kept) > gamma:
        gain = lambda j: cov.coverage(walk.kept) - cov.coverage(walk.kept | {j})
        rest = [j for j in range(cov.n) if j not in walk.kept]
        cov.batch(walk.kept | {j} for j in rest)
        heap = [(-gain(j), t, j, 0) for t, j in enumerate(rest)]
        heapq.heapify(heap)
        tick, round_ = len(heap), 0
        while heap:
            _, _, j, stamp = heapq.heappop(heap)
            pops.append((j, stamp == round_))
            if stamp != round_:
                heapq.heappush(heap, (-gain(j), tick, j, round_))
                tick += 1
                continue
            walk.add(j)
            round_ += 1
            if cov.coverage(walk.kept) <= gamma:
                break
            cov.batch(walk.kept | {k} for _, _, k, _ in heap)
    # The first model in order that can go is dropped, then the search starts over.
    while walk.kept:
        cov.batch(walk.kept - {j} for j in walk.kept)
        j = next((j for j in sorted(walk.kept) if cov.coverage(walk.kept - {j}) <= gamma), None)
        if j is None:
            break
        walk.remove(j)
    out = walk.result()
    out.pops = pops
    return out


ALGORITHMS: dict[str, Callable[[Coverage, float], Result]] = {"backward_elimination": backward, "forward_selection": forward, "priority_queue": lazy}


def removals(cov: Coverage, kept: Iterable[int], gamma: float) -> list[tuple[int, str, float, bool]]:
    """What-if table of a final set: model, name, coverage without it, and if that is within gamma."""
    s = frozenset(kept)
    cov.batch(s - {j} for j in s)
    return [(j, cov.names[j], cov.coverage(s - {j}), cov.coverage(s - {j}) <= gamma) for j in sorted(s)]


def singletons(cov: Coverage) -> list[tuple[int, int, str, float, float]]:
    """(rank, model, name, coverage, sum of uniqueness) of every model kept alone, the least coverage first."""
    cov.batch((j,) for j in range(cov.n))
    ranked = sorted((cov.coverage((j,)), j) for j in range(cov.n))
    return [(k + 1, j, cov.names[j], e, cov.total((j,))) for k, (e, j) in enumerate(ranked)]


def gains(cov: Coverage, kept: Iterable[int], most: int = 10) -> list[tuple[int, int, str, float]]:
    """(rank, model, name, gain): by how much coverage falls if a model joins the kept set; the `most` greatest gains."""
    s = frozenset(kept)
    rest = [j for j in range(cov.n) if j not in s]
    cov.batch([s, *(s | {j} for j in rest)])
    ranked = sorted((-(cov.coverage(s) - cov.coverage(s | {j})), j) for j in rest)[:most]
    return [(k + 1, j, cov.names[j], -g) for k, (g, j) in enumerate(ranked)]
