"""Observation files, response bundles and model files."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.scalars import file_name

COLUMNS = ("day", "interval", "detid", "flow", "occ", "error", "city")
HEADER = "day string, interval string, detid string, flow string, occ string, error string, city string, speed string"


def read_csv(spark: SparkSession, path: str, whole: bool = False, cities: Sequence[str] | None = None) -> DataFrame:
    """Observations of CSV files with a header, as text; clean_observations() makes them numbers.

    The schema is given, not inferred, so files are read once and in splits. whole keeps speed too. Columns left out are never parsed.
    """
    rows = spark.read.schema(HEADER).csv(path, header=True, enforceSchema=False)
    rows = rows if whole else rows.select(*COLUMNS)
    return rows if cities is None else rows.where(F.col("city").isin(*cities))


@dataclass(frozen=True)
class Bundle:
    """responses: split, query_id, model_idx, model_name, y. models: model_idx, model_name, n, train_rmse, and the model itself: weights and intercept, or the trees (model)."""

    responses: DataFrame
    models: DataFrame


def bundle_key(*configs: object) -> str:
    """Names a bundle by everything it depends on."""
    plain = [asdict(c) if hasattr(c, "__dataclass_fields__") else c for c in configs]
    return hashlib.sha256(json.dumps(plain, sort_keys=True, default=str).encode()).hexdigest()[:16]


def save_bundle(b: Bundle, folder: str, key: str) -> str:
    at = f"{folder.rstrip('/')}/{key}"
    b.responses.write.mode("overwrite").parquet(f"{at}/responses")
    b.models.write.mode("overwrite").parquet(f"{at}/models")
    return at


def load_bundle(spark: SparkSession, folder: str, key: str) -> Bundle | None:
    """The bundle of that key, or None."""
    at = f"{folder.rstrip('/')}/{key}"
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/models/_SUCCESS")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    return Bundle(spark.read.parquet(f"{at}/responses"), spark.read.parquet(f"{at}/models"))


def save_models(models: DataFrame, folder: str, name: str = "city") -> str:
    """Fitted models, linear or boosted, as one folder a model: <folder>/<name with / as _>."""
    models.withColumn("file", file_name(F.col(name))).write.mode("overwrite").partitionBy("file").parquet(folder)
    return folder


def load_models(spark: SparkSession, folder: str, names: Sequence[str] | None = None) -> DataFrame:
    """The models of a folder, or those of the given names only; the folders of others are not opened."""
    models = spark.read.option("recursiveFileLookup", "false").parquet(folder)
    if names is not None:
        models = models.where(F.col("file").isin(*(n.replace("/", "_") for n in names)))
    return models.drop("file")
