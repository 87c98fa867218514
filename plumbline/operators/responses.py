"""Query pools, text grids and response relations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import format_dose, stable_seed

RANGES = 4096


def sample_rows(rows: DataFrame, n: int, seed: str, key: str) -> DataFrame:
    """At most n rows without replacement: those whose seeded digests come first. The same rows whatever the partitions.

    The limit is the operator: Spark takes the first n of each task and then of all, without a full sort.
    """
    return rows.withColumn("__d", F.md5(F.concat(F.lit(seed + "|"), F.col(key).cast("string")))).orderBy("__d", key).limit(n).drop("__d")


def pool(rows: DataFrame, fit: int, evaluate: int, seed: str = "0", key: str = "obs_id") -> DataFrame:
    """Rows of the val split sampled for fit and of the test split for eval, marked by role."""
    part = lambda s, n, role: sample_rows(rows.where(F.col("split") == s), n, f"{seed}/{role}", key).withColumn("role", F.lit(role))
    return part("val", fit, "fit").unionByName(part("test", evaluate, "eval"))


def _numbered(rows: DataFrame, order: str, by: str | None = None) -> DataFrame:
    """Adds __i: the row's number in the order, from 1, within each value of `by`; null first.

    It comes from the counts of a fixed number of ranges of the order, joined back: one task sorts one range of one value, never all rows of a frequent one.
    """
    at = F.col(order).cast("double")
    low, high = (rows.agg(a.alias("v")).select("v").scalar() for a in (F.min(at), F.max(at)))
    ranged = rows.withColumn("__r", F.coalesce(F.floor((at - low) / ((high - low) / RANGES + 1e-9)), F.lit(-1)))
    keys = ["__r"] if by is None else ["__k", "__r"]
    ranged = ranged if by is None else ranged.withColumn("__k", F.struct(F.col(by)))  # a struct is never null, so null joins null
    per = ranged.groupBy(*keys).agg(F.count("*").alias("__c"))
    # At most RANGES + 2 rows a value in this window.
    w = (Window.orderBy("__r") if by is None else Window.partitionBy("__k").orderBy("__r")).rowsBetween(Window.unboundedPreceding, -1)
    before = per.withColumn("__b", F.sum("__c").over(w)).drop("__c")
    return ranged.join(before, keys).withColumn("__i", F.coalesce("__b", F.lit(0)) + F.row_number().over(Window.partitionBy(*keys).orderBy(order))).drop("__r", "__b", "__k")


def head_tail(texts: DataFrame, order: str) -> DataFrame:
    """Adds half: the first max(1, n div 2) rows are fit, the others eval; a single row is both. A null order comes first."""
    n = texts.agg(F.count("*").alias("v")).select("v").scalar()
    placed = _numbered(texts, order).withColumn("__n", n)
    first = F.col("__i") <= F.greatest(F.lit(1), F.floor(F.col("__n") / 2))
    halves = F.when(F.col("__n") == 1, F.array(F.lit("fit"), F.lit("eval"))).when(first, F.array(F.lit("fit"))).otherwise(F.array(F.lit("eval")))
    return placed.withColumn("half", F.explode(halves)).drop("__i", "__n")


def dose_grid(texts: DataFrame, doses: Sequence[float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, dose_no, text, theta, seed): every text at every dose; equal text and dose have equal seeds."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("dose_no"), F.lit(float(d)).alias("theta")) for i, d in enumerate(doses))))
    grid = texts.select(key, F.col(text).alias("text"), each.alias("__d")).select(key, "__d.dose_no", "text", "__d.theta")
    return grid.withColumn("seed", stable_seed(F.col("text"), format_dose(F.col("theta"))))


def unique_names(names: DataFrame, name: str = "name", order: str = "pos") -> DataFrame:
    """Adds unique_name: the second and later rows of a name, in order, get #2, #3 and so on."""
    k = F.col("__i")
    return _numbered(names, order, name).withColumn("unique_name", F.when(k == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("#"), k.cast("string")))).drop("__i")


def text_scorers(text: Column) -> dict[str, Column]:
    """Numbers of a text that stand in for models: tokens, masked share, mean length of tokens, share of distinct ones."""
    tokens = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\s\p{Z}]+"), lambda t: t != "")
    n = F.size(tokens)
    share = lambda x: F.when(n > 0, x / n).otherwise(0.0)
    return {
        "n_tokens": n.cast("double"),
        "masked": share(F.size(F.filter(tokens, lambda t: t == "[MASK]"))),
        "token_length": share(F.aggregate(tokens, F.lit(0), lambda a, t: a + F.char_length(t))),
        "distinct": share(F.size(F.array_distinct(tokens))),
    }


def respond(queries: DataFrame, scorers: dict[str, Column], key: str = "query_id") -> DataFrame:
    """(key, model_idx, model_name, y): every scorer on every query row, models by name; one pass, no join."""
    each = [F.struct(F.lit(i).alias("model_idx"), F.lit(n).alias("model_name"), scorers[n].alias("y")) for i, n in enumerate(sorted(scorers))]
    return queries.select(key, F.explode(F.array(*each)).alias("__m")).select(key, "__m.*")


def response_wide(responses: DataFrame) -> DataFrame:
    """(split, query_id, ys array<double>), models in order of their index."""
    return responses.groupBy("split", "query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("model_idx", "y"))), lambda x: x["y"]).alias("ys"))


def response_long(wide: DataFrame, names: Sequence[str]) -> DataFrame:
    """The relation back from its wide form."""
    named = F.array(*(F.lit(n) for n in names))
    return wide.select("split", "query_id", F.posexplode("ys").alias("model_idx", "y")).withColumn("model_name", named[F.col("model_idx")])
