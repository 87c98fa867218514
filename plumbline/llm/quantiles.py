"""Mergeable quantile sketches: randomised compactor hierarchies.

A sketch of a group is a set of levels; an item at level h stands for 2^h values. A level that outgrows its capacity k is sorted and every
second item, from a random start, moves one level up. Two sketches are merged by putting their levels together
and compacting what has outgrown. Weights always add up to the exact count.

Error. A compaction at level h shifts any rank by at most 2^h, up or down with equal chance, and n / (k 2^h) of them happen there at most, so with
probability 1 - delta a rank is off by at most n * sqrt(8 ln(2 / delta)) / k however the data were split and in whatever order sketches
were merged. A sketch with no item above level 0 is exact.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ITEMS = 400_000


def rank_bound(k: int, delta: float = 0.01) -> float:
    """Share of n by which a rank may be off, with probability 1 - delta."""
    return math.sqrt(8 * math.log(2 / delta)) / k


def _group_codes(cols: list[pa.Array]) -> tuple[np.ndarray, list[pa.Array], np.ndarray]:
    """A number for each row's tuple of keys; the keys of each number; the first row of each."""
    code = np.zeros(len(cols[0]), np.int64)
    for c in cols:
        d = pc.dictionary_encode(c, null_encoding="encode")
        d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
        code = code * (len(d.dictionary) + 1) + np.asarray(d.indices.to_numpy(zero_copy_only=False), np.int64)
        _, code = np.unique(code, return_inverse=True)
    _, first = np.unique(code, return_index=True)
    return code, [c.take(pa.array(first)) for c in cols], first


def _compacted(codes: np.ndarray, levels: np.ndarray, items: np.ndarray, k: int, salts: list[int], block: tuple[int, int] = (0, 0)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by group, level and value, with no level above its capacity. block: the task and its block, so that blocks alike draw coins of their own."""
    order = np.lexsort((items, levels, codes))
    codes, levels, items = codes[order], levels[order], items[order]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (levels[1:] != levels[:-1])]) if codes.size else np.zeros(0, int)
    n = np.diff(np.r_[at, codes.size])
    full = np.unique(codes[at[n > k]])
    stay = ~np.isin(codes, full)
    out.append((codes[stay], levels[stay], items[stay]))
    for g in full:  # groups that outgrow a level are few: each has more than k items here
        here = slice(np.searchsorted(codes, g), np.searchsorted(codes, g, "right"))
        lv, it = levels[here], items[here]
        held = {int(h): it[lv == h] for h in np.unique(lv)}
        h = min(held)
        while h <= max(held):
            x = held.get(h, np.zeros(0))
            if x.size > k:
                even = x.size - x.size % 2
                # The odd one out stays; which end it comes from, and where the choice starts, is drawn anew each time.
                rng = np.random.default_rng([salts[g], *block, h, x.size, int(np.abs(np.float64(x[x.size // 2]).view(np.int64)) % (1 << 31))])
                skip, start = int(rng.integers(0, 2)) * (x.size % 2), int(rng.integers(0, 2))
                core = x[skip : skip + even]
                held[h] = np.r_[x[:skip], x[skip + even :]]
                held[h + 1] = np.sort(np.r_[held.get(h + 1, np.zeros(0)), core[start::2]])
            h += 1
        for h, x in held.items():
            if x.size:
                out.append((np.full(x.size, g), np.full(x.size, h), x))
    codes, levels, items = (np.concatenate(c) for c in zip(*out))
    order = np.lexsort((items, levels, codes))
    return codes[order], levels[order], items[order]


def _sketcher(keys: int, k: int, seed: int, raw: bool):
    """Rows (keys..., value) or (keys..., level, items) to rows (keys..., level, items), a sketch for each group of a block.

    Raw blocks of any order are sketched one by one. Sketch rows come sorted by keys: whole groups are gathered, so each group comes out once.
    """

    def sketch(cols: list[pa.Array], block: tuple[int, int]) -> pa.RecordBatch:
        codes, names, _ = _group_codes(cols[:keys])
        if raw:
            levels, items = np.zeros(codes.size, np.int64), np.asarray(cols[keys].to_numpy(zero_copy_only=False), float)
        else:
            size = np.asarray(pc.list_value_length(cols[keys + 1]).to_numpy(zero_copy_only=False), np.int64)
            levels, items = np.repeat(np.asarray(cols[keys].to_numpy(zero_copy_only=False), np.int64), size), np.asarray(pc.list_flatten(cols[keys + 1]).to_numpy(zero_copy_only=False), float)
            codes = np.repeat(codes, size)
        salts = [zlib.crc32(repr((seed, *t)).encode()) for t in zip(*(c.to_pylist() for c in names))] if codes.size > k else []
        codes, levels, items = _compacted(codes, levels, items, k, salts, block)
        at = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (levels[1:] != levels[:-1])]) if codes.size else np.zeros(0, int)
        owner = pa.array(codes[at])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[at, codes.size].astype(np.int32)), pa.array(items))
        return pa.RecordBatch.from_arrays([*(c.take(owner) for c in names), pa.array(levels[at].astype(np.int32)), lists], names=[*(f"k{i}" for i in range(keys)), "level", "items"])

    def whole(parts: list[pa.RecordBatch]) -> list[pa.Array]:
        t = pa.Table.from_batches(parts).combine_chunks()
        return [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in t.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        size = 0
        context = TaskContext.get()
        task, blocks = context.partitionId() if context else 0, itertools.count()  # the same if the task runs again
        for b in batches:
            if not b.num_rows:
                continue
            waiting.append(b)
            size += b.num_rows if raw else len(pc.list_flatten(b.column(keys + 1)))
            if size < BLOCK_ITEMS:
                continue
            cols = whole(waiting)
            n = len(cols[0])
            cut = n
            if not raw:  # the last group may go on in the next batch
                codes, _, _ = _group_codes(cols[:keys])
                other = np.flatnonzero(codes != codes[-1])
                cut = int(other[-1]) + 1 if other.size else 0
            if cut:
                yield sketch([c.slice(0, cut) for c in cols], (task, next(blocks)))
            elif not raw:  # one group alone: what is there is compacted, and gathering goes on
                cols = sketch(cols, (task, next(blocks))).columns
                n = len(cols[0])
            waiting = [pa.RecordBatch.from_arrays([c.slice(cut) for c in cols], names=waiting[0].schema.names)] if cut < n else []
            size = sum(len(pc.list_flatten(w.column(keys + 1))) for w in waiting) if not raw else 0
        if waiting:
            yield sketch(whole(waiting), (task, next(blocks)))

    return run


def _fields(df: DataFrame, keys: tuple[str, ...]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"k{i} {kinds[k]}" for i, k in enumerate(keys))


def _named(sketches: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return sketches.select(*(F.col(f"k{i}").alias(k) for i, k in enumerate(keys)), "level", "items")


def merge(sketches: DataFrame, keys: tuple[str, ...], k: int = 1024, seed: int = 0) -> DataFrame:
    """Sketches (keys..., level, items) with the same keys put together, and rows of finer keys made one by leaving keys out.

    Each task first merges what it has, so a group with most of the data sends every reducer input of bounded size.
    """
    rows = sketches.select(*keys, "level", "items")
    kinds = f"{_fields(rows, keys)}, level int, items array<double>"
    local = rows.sortWithinPartitions(*keys).mapInArrow(_sketcher(len(keys), k, seed + 1, False), kinds)
    names = [f"k{i}" for i in range(len(keys))]
    met = local.repartition(*names).sortWithinPartitions(*names)
    return _named(met.mapInArrow(_sketcher(len(keys), k, seed + 2, False), kinds), keys)


def sketch(rows: DataFrame, keys: tuple[str, ...], value: str, k: int = 1024, seed: int = 0) -> DataFrame:
    """Sketches (keys..., level, items) of a numeric column, one group for each tuple of keys (null is a key like others).

    Null and NaN values are left out; a group without values has no sketch. Empty input: empty output. Portions
    may be sketched apart and put together by merge().
    """
    clean = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, F.col(value).cast("double").alias("__v"))
    kinds = f"{_fields(clean, keys)}, level int, items array<double>"
    local = clean.mapInArrow(_sketcher(len(keys), k, seed, True), kinds)
    names = [f"k{i}" for i in range(len(keys))]
    met = local.repartition(*names).sortWithinPartitions(*names)
    return _named(met.mapInArrow(_sketcher(len(keys), k, seed + 2, False), kinds), keys)


def quantiles(sketches: DataFrame, keys: tuple[str, ...], probs: tuple[float, ...], k: int = 1024, delta: float = 0.01) -> DataFrame:
    """(keys..., n, q_<percent>..., rank_bound): the smallest item at or above each share of the weight.

    rank_bound is the share of n by which a rank may be off with probability 1 - delta; 0 for a sketch that was never compacted. Each group's sketch must be whole (from
    sketch() or merge()); its size is bounded, so it is put together in one row.
    """
    held = sketches.groupBy(*keys).agg(
        F.sum(F.size("items") * F.pow(F.lit(2.0), F.col("level"))).cast("long").alias("n"),
        F.max("level").alias("__top"),
        F.sort_array(F.flatten(F.collect_list(F.transform("items", lambda x: F.struct(x.alias("v"), F.pow(F.lit(2.0), F.col("level")).alias("w")))))).alias("__items"),
    )
    zero = F.lit(0.0)
    # Running weights first, then for each share the first item that reaches it.
    one = lambda p: F.aggregate(
        "__items",
        F.struct(zero.alias("w"), F.lit(None).cast("double").alias("v")),
        lambda acc, x: F.struct((acc["w"] + x["w"]).alias("w"), F.when(acc["v"].isNull() & (acc["w"] + x["w"] >= F.greatest(F.ceil(F.lit(p) * F.col("n")), F.lit(1))), x["v"]).otherwise(acc["v"]).alias("v")),
        lambda acc: acc["v"],
    )
    return held.select(*keys, "n", *(one(p).alias(f"q_{100 * p:g}".replace(".", "_")) for p in probs), F.when(F.col("__top") > 0, rank_bound(k, delta)).otherwise(0.0).alias("rank_bound"))


def within_bounds(rows: DataFrame, answers: DataFrame, keys: tuple[str, ...], value: str, probs: tuple[float, ...]) -> DataFrame:
    """(keys..., n, rank_bound, within): if the true rank of every percentile of quantiles() is as near as rank_bound says, by counting all values on either side of it. Groups with a null key are left out."""
    own = answers.select(*(F.col(k).alias(f"__{k}") for k in keys), "rank_bound", F.col("n").alias("__n"), *(F.col(f"q_{100 * p:g}".replace(".", "_")).alias(f"__q{i}") for i, p in enumerate(probs)))
    met = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).join(own, [F.col(k) == F.col(f"__{k}") for k in keys])
    sides = {f"{s}{i}": F.count_if(F.col(value) < F.col(f"__q{i}")) if s == "low" else F.count_if(F.col(value) <= F.col(f"__q{i}")) for i in range(len(probs)) for s in ("low", "high")}
    counts = met.groupBy(*keys).agg(F.count("*").alias("n"), F.max("__n").alias("__n"), F.max("rank_bound").alias("rank_bound"), *(c.alias(f"__{k}") for k, c in sides.items()))
    good = F.col("n") == F.col("__n")
    for i, p in enumerate(probs):  # an answer stands for the ranks of all values equal to it; one rank is lost to rounding
        slack = F.col("rank_bound") * F.col("n") + 1
        good = good & (F.col(f"__low{i}") <= p * F.col("n") + slack) & (F.col(f"__high{i}") >= p * F.col("n") - slack)
    return counts.select(*keys, "n", "rank_bound", good.alias("within"))
