"""Results per key where a few keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.values import has_word, number_or_null


def key_totals(raw: DataFrame, keys: tuple[str, ...] = ("city", "detid"), values: tuple[str, ...] = ("flow", "occ")) -> DataFrame:
    """Per value of each key, taken alone: n_rows, and for each value v_n, v_sum, v_avg, v_min, v_max; all_rows is the table's size.

    Columns field and key_value name the key. All aggregates are algebraic: each task combines its rows by the
    tuple of keys before the shuffle, and the combined rows once more by each key, so however many rows a key has, only
    one compact partial row a task and tuple moves. One scan serves all keys and the grand total.

    A key's null or blank values and its words for "no value" have no row of their own; their rows count in all_rows.
    A value without a usable number counts in n_rows only (v_sum 0, the others null). Empty input: empty output.
    """
    held = raw.select(*(F.when(has_word(F.col(k)), F.col(k)).alias(k) for k in keys), *(number_or_null(F.col(v)).alias(v) for v in values))
    first = held.groupBy(*keys).agg(F.count("*").alias("__n"), *(f(v).alias(f"__{v}_{a}") for v in values for a, f in (("n", F.count), ("sum", F.sum), ("min", F.min), ("max", F.max))))
    names = [F.struct(F.lit(k).alias("field"), F.col(k).alias("key_value")) for k in keys]
    everything = F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("key_value"))
    spread = first.withColumn("__key", F.explode(F.array(*names, everything))).where(F.col("__key.key_value").isNotNull() | F.col("__key.field").isNull())
    totals = spread.groupBy("__key.field", "__key.key_value").agg(
        F.sum("__n").alias("n_rows"),
        *(x for v in values for x in (F.sum(f"__{v}_n").alias(f"{v}_n"), F.coalesce(F.sum(f"__{v}_sum"), F.lit(0.0)).alias(f"{v}_sum"), F.min(f"__{v}_min").alias(f"{v}_min"), F.max(f"__{v}_max").alias(f"{v}_max"))),
    )
    grand = totals.where(F.col("field").isNull()).select(F.col("n_rows").alias("all_rows"))
    out = totals.where(F.col("field").isNotNull())
    cols = [x for v in values for x in (F.col(f"{v}_n"), F.col(f"{v}_sum"), F.when(F.col(f"{v}_n") > 0, F.col(f"{v}_sum") / F.col(f"{v}_n")).alias(f"{v}_avg"), F.col(f"{v}_min"), F.col(f"{v}_max"))]
    return out.select("field", "key_value", "n_rows", grand.scalar().alias("all_rows"), *cols)


def heavy_keys(raw: DataFrame, keys: tuple[str, ...] = ("city", "detid"), share: int = 20) -> DataFrame:
    """(field, key_value) of each key value on at least one in `share` of all rows."""
    return key_totals(raw, keys, ()).where(F.col("n_rows") * share >= F.col("all_rows")).select("field", "key_value")
