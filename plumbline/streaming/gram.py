"""Gram sums kept up to date as responses arrive. Sums of products are associative, so a stream needs no more than an ordinary aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gram_stream(wide: DataFrame) -> DataFrame:
    """(model_i, model_j, g) for i <= j from (streaming) rows with ys array<double>; write it in complete or update mode."""
    pairs = wide.select(F.posexplode("ys").alias("model_i", "a"), "ys").select("model_i", "a", F.posexplode("ys").alias("model_j", "b")).where("model_i <= model_j")
    return pairs.groupBy("model_i", "model_j").agg(F.sum(F.col("a") * F.col("b")).alias("g"))
