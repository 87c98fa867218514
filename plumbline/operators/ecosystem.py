"""Models asked matched, perturbed queries: protocols for models, perturbations and scalars, and one distributed pass over all of them."""

from __future__ import annotations

import inspect
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame


class Perturbation(Protocol):
    def apply(self, x: Any, theta: float, seed: int | None = None) -> Any: ...


class Unit(Protocol):
    """A model: a name, and answers to a batch of inputs."""

    name: str

    def answer(self, inputs: Sequence[Any]) -> Sequence[Any]: ...


def perturbed(how: Perturbation | None, x: Any, theta: float, seed: int | None) -> Any:
    """Passes the seed on only to a perturbation that takes one."""
    if how is None:
        return x
    takes = inspect.signature(how.apply).parameters
    if "seed" in takes or any(p.kind is p.VAR_KEYWORD for p in takes.values()):
        return how.apply(x, theta, seed=seed)
    return how.apply(x, theta)


@dataclass
class FunctionUnit:
    """A unit made of a plain function of one input; scalar turns its answer into a number (float by default)."""

    name: str
    forward: Callable[[Any], Any]
    scalar: Callable[[Any], float] = float

    def answer(self, inputs: Sequence[Any]) -> Sequence[float]:
        return [self.scalar(self.forward(x)) for x in inputs]

    def query(self, x: Any, theta: float = 0.0, how: Perturbation | None = None, seed: int | None = None) -> float:
        return self.scalar(self.forward(perturbed(how, x, theta, seed)))


@dataclass
class ClassifierUnit:
    """A text classifier in batches: tokens are cut at max_tokens, and the answer is the probability of class 1.

    tokenize gives the tokens of a text; logits gives, for a batch of token lists, a list of numbers each: one (its sigmoid is the probability) or several (their softmax's second).
    """

    name: str
    tokenize: Callable[[str], Sequence[Any]]
    logits: Callable[[Sequence[Sequence[Any]]], Sequence[Sequence[float]]]
    max_tokens: int = 256
    batch_size: int = 16

    def answer(self, inputs: Sequence[Any]) -> list[float]:
        out: list[float] = []
        for at in range(0, len(inputs), self.batch_size):
            batch = [list(self.tokenize(x if x is not None else ""))[: self.max_tokens] for x in inputs[at : at + self.batch_size]]
            out += [class_one(row) for row in self.logits(batch)]
        return out


def class_one(logits: Sequence[float]) -> float:
    """Probability of class 1: the sigmoid of a single logit, else the softmax's second entry."""
    if len(logits) == 1:
        x = float(logits[0])
        return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))
    top = max(logits)
    return math.exp(logits[1] - top) / sum(math.exp(x - top) for x in logits)


def load_classifier(name: str, logits: Callable[[str], Callable], fast: Callable[[str], Callable], slow: Callable[[str], Callable], warn: Callable[[str], None] = print, **settings: int) -> ClassifierUnit:
    """A classifier by name from loaders of its parts; the slow tokenizer stands in where the fast one can't be loaded, with a warning."""
    try:
        tokenize = fast(name)
    except Exception as e:  # noqa: BLE001
        warn(f"{name}: no fast tokenizer ({e}); the slow one is used")
        tokenize = slow(name)
    return ClassifierUnit(name, tokenize, logits(name), **settings)


@dataclass
class Ecosystem:
    """A target and its peers, which all see the same perturbed input."""

    target: Unit
    peers: list[Unit] = field(default_factory=list)

    def ask(self, queries: DataFrame, how: Perturbation | None = None, key: str = "query_id", x: str = "text") -> DataFrame:
        """(key, target, peers array<double>): each query (key, x, theta, seed) is perturbed once and given to all models, in Arrow batches; no shuffle."""
        kind = dict(queries.dtypes)[key]
        target, peers = self.target, list(self.peers)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                inputs = [perturbed(how, v, t, None if pd.isna(s) else int(s)) for v, t, s in zip(b[x], b["theta"], b["seed"])]
                told = [[float(v) for v in p.answer(inputs)] for p in peers]
                yield pd.DataFrame({key: b[key], "target": [float(v) for v in target.answer(inputs)], "peers": list(map(list, zip(*told))) if told else [[] for _ in inputs]})

        return queries.select(key, x, "theta", "seed").mapInPandas(run, f"{key} {kind}, target double, peers array<double>")


def loaded(names: Sequence[str], load: Callable[[str], Unit], warn: Callable[[str], None] = print, least: int = 2) -> list[Unit]:
    """The units that can be loaded; those that can't are passed over with a warning. RuntimeError if fewer than `least` are left."""
    out: list[Unit] = []
    for n in names:
        try:
            out.append(load(n))
        except Exception as e:  # noqa: BLE001
            warn(f"{n} was left out: {e}")
    if len(out) < least:
        raise RuntimeError(f"{len(out)} models could be loaded; {least} are needed")
    return out
