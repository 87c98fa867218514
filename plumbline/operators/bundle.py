"""From raw observations to a response bundle: features, one model a city, pooled queries, every model on every query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.learners import BoostConfig, boosted_models, linear_models, score_boosted, score_linear
from plumbline.operators.responses import pool
from plumbline.operators.series import SeriesConfig, finite_rows, prepare, split_sizes
from plumbline.session import drop, scratch
from plumbline.sources.observations import Bundle, bundle_key, load_bundle, save_bundle


def build_bundle(raw: DataFrame, config: SeriesConfig = SeriesConfig(), sizes: tuple[int, int, int] = (500, 200, 200), pooled: tuple[int, int] = (1500, 1500), seed: str = "0", least: int = 3, folder: str | None = None, source: str = "", boost: BoostConfig | None = None) -> Bundle:
    """Cities with enough rows in each split get a model; queries are pooled over them; RuntimeError if fewer than `least` qualify.

    Models are linear, or boosted trees with a BoostConfig; the bundle holds them, so that it can answer new queries (answer()). The features are written once, in the shared folder, for the sizes, the
    fit and the pools. With a folder the bundle is kept there under a key of its settings and source, and read again next time.
    """
    spark = raw.sparkSession
    key = bundle_key(config, sizes, pooled, seed, source if boost is None else f"{source}|{boost}")
    if folder and (held := load_bundle(spark, folder, key)):
        return held
    rows, names = prepare(raw, config)
    at = scratch(spark, "features")
    finite_rows(rows, names).select(config.row_id, "city", "split", "y", *names).write.parquet(at)
    rows = spark.read.parquet(at)
    able = split_sizes(rows, *sizes).where("eligible").select("city")
    kept = rows.join(able, "city", "left_semi")
    train = kept.where("split = 'train'")
    fitted = linear_models(train, names) if boost is None else boosted_models(train, names, config=boost, row_id=config.row_id)
    w = Window.orderBy("city")  # one row a city
    models_at = scratch(spark, "models")
    fitted.withColumn("model_idx", (F.row_number().over(w) - 1).cast("int")).withColumnRenamed("city", "model_name").write.parquet(models_at)
    models = spark.read.parquet(models_at)
    n = models.count()
    if n < least:
        raise RuntimeError(f"{n} cities have enough rows; {least} are needed")
    asked = pool(kept, *pooled, seed=seed, key=config.row_id)
    scored = answer(models, asked.withColumn("query_id", F.struct("role", config.row_id)), names)
    out = Bundle(scored.select(F.col("query_id.role").alias("split"), F.col(f"query_id.{config.row_id}").alias("query_id"), "model_idx", "model_name", "y"), models)
    if folder:
        save_bundle(out, folder, key)
        drop(spark, at)
        drop(spark, models_at)
        return load_bundle(spark, folder, key) or out
    return out


def answer(models: DataFrame, queries: DataFrame, names: list[str], key: str = "query_id") -> DataFrame:
    """(key, model_idx, model_name, y): every model of a bundle, linear or boosted, on every query row."""
    scored = (score_boosted if "model" in models.columns else score_linear)(queries, names, models, key)
    return scored.join(models.select("model_idx", "model_name"), "model_name").select(key, "model_idx", "model_name", "y")
