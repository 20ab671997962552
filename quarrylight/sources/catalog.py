"""Sources and sinks: product catalogs and sessions as JSON lines, index tables, results."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators.dense import encode
from ..operators.fusion import places
from ..storage import stored

PRODUCT = T.StructType([
    T.StructField("parent_asin", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("features", T.ArrayType(T.StringType())), T.StructField("description", T.ArrayType(T.StringType())),
    T.StructField("price", T.StringType()), T.StructField("categories", T.ArrayType(T.StringType())),
    T.StructField("details", T.MapType(T.StringType(), T.StringType())), T.StructField("average_rating", T.DoubleType()),
    T.StructField("rating_number", T.LongType()), T.StructField("store", T.StringType()),
])
SAMPLE = T.StructType([
    T.StructField("sample_id", T.StringType()), T.StructField("scenario_type", T.StringType()),
    T.StructField("user_profile", T.StructType([
        T.StructField("purchase_frequency", T.StringType()), T.StructField("average_prior_rating", T.DoubleType()),
        T.StructField("rating_style", T.StringType()), T.StructField("preference_tags", T.ArrayType(T.StringType())), T.StructField("summary", T.StringType()),
    ])),
    T.StructField("ground_truth", T.StructType([T.StructField("parent_asin", T.StringType())])),
])
FIELDS = ["title", "categories", "features", "details", "store", "description"]
_cache: dict[tuple, DataFrame] = {}


def resolve(path: str, root: str | None = None) -> str:
    """A local path as given, else below ``root``; a URL or a path found in neither place comes back as it is."""
    if "://" in path or Path(path).exists():
        return path
    below = Path(root or Path(__file__).resolve().parents[2]) / path
    return str(below) if below.exists() else path


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with a fixed schema; blank lines are skipped."""
    return spark.read.schema(schema).json(resolve(path))


def read_raw_products(spark: SparkSession, path: str) -> DataFrame:
    """Products as they stand in the files, with doc_id, 0 to n-1 by file name and place in it; rows without an id are dropped.

    The scan is stored once with each row's file and split, since splits are
    read in any order, and numbered by a range shuffle.
    """
    raw = read_jsonl(spark, path, PRODUCT).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    rows = stored(raw.filter("parent_asin is not null").withColumns({"at": F.monotonically_increasing_id(), "all": F.lit(0)}), "catalog")
    rows = places(rows, ["all"], ["file", "split", "at"], "place")
    return rows.select((F.col("place") - 1).alias("doc_id"), *[f.name for f in PRODUCT.fields])


def read_products(spark: SparkSession, path: str) -> DataFrame:
    """Products with doc_id in file order and normalised fields."""
    return read_raw_products(spark, path).select("doc_id", *product_columns())


def evaluator_index(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of raw products: (parent_asin), (parent_asin, categories) and (parent_asin, product), the last of repeated ids."""
    last = raw.groupBy("parent_asin").agg(F.max_by(F.struct(*[f.name for f in PRODUCT.fields]), "doc_id").alias("product"))
    none = F.array().cast("array<string>")
    return last.select("parent_asin"), last.select("parent_asin", F.coalesce("product.categories", none).alias("categories")), last


def customer_products(raw: DataFrame) -> DataFrame:
    """Raw products as the simulator takes them: arrays and maps unflattened, and the text that it searches for materials and colours."""
    flat = [X.flatten_scalar(F.col("title")), X.flatten_array(F.col("features")), X.flatten_map(F.col("details")), X.flatten_array(F.col("description")), X.flatten_array(F.col("categories")), X.flatten_scalar(F.col("store"))]
    return raw.select("doc_id", X.category_path(F.col("categories")).alias("path"), "title", "features", "details", "price", X.searchable_text(*flat).alias("text"))


def read_samples(spark: SparkSession, path: str, products: DataFrame) -> DataFrame:
    """(sample_id, scenario_type, target) of evaluation samples whose product the catalog has."""
    rows = read_jsonl(spark, path, SAMPLE).select("sample_id", "scenario_type", F.col("ground_truth.parent_asin").alias("parent_asin"))
    return rows.join(last_of_each_id(products), "parent_asin").select("sample_id", "scenario_type", F.col("doc_id").alias("target"))


def product_columns() -> list:
    """Normalised fields of a raw product, its category path and its price."""
    flat = {
        "title": X.flatten_scalar(F.col("title")), "categories": X.flatten_array(F.col("categories")), "features": X.flatten_array(F.col("features")),
        "details": X.flatten_map(F.col("details")), "store": X.flatten_scalar(F.col("store")), "description": X.flatten_array(F.col("description")),
    }
    cols = ["parent_asin", X.category_path(F.col("categories")).alias("path"), X.parse_price(F.col("price")).alias("price")]
    return [*cols, *[X.normalise(c).alias(n) for n, c in flat.items()]]


def document_text(products: DataFrame) -> DataFrame:
    """doc_id and the combined text of the normalised fields."""
    return products.select("doc_id", X.document_text(*[F.col(f) for f in FIELDS]).alias("text"))


def last_of_each_id(products: DataFrame) -> DataFrame:
    """(parent_asin, doc_id): the last of repeated ids."""
    return products.groupBy("parent_asin").agg(F.max("doc_id").alias("doc_id"))


def index_tables(spark: SparkSession, key: str, build, folder: str, use_cache: bool = True) -> DataFrame:
    """An index table built once per key and kept as Parquet in a shared folder."""
    at = (spark.sparkContext.applicationId, folder, key)
    if use_cache and at in _cache:
        return _cache[at]
    path = f"{folder.rstrip('/')}/{hashlib.sha256(key.encode()).hexdigest()[:16]}"
    build().write.mode("overwrite").parquet(path)
    _cache[at] = spark.read.parquet(path)
    return _cache[at]


def embedding_path(folder: str, model: str, size: int, limit: int = 512) -> str:
    """Where vectors of a model and a corpus of this size are kept."""
    return f"{folder.rstrip('/')}/{hashlib.sha256(f'{model}|{size}|{limit}'.encode()).hexdigest()[:16]}"


def embeddings(docs: DataFrame, folder: str, model: str, encoder: Callable[[list[str]], np.ndarray], limit: int = 512) -> DataFrame:
    """(doc_id, vector) of (doc_id, text) by a named model, encoded once and then read from the folder.

    A table counts as there when its writer has committed it.
    """
    spark = docs.sparkSession
    path = embedding_path(folder, model, docs.count(), limit)
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        encode(docs.select("doc_id", F.substring("text", 1, limit).alias("text")), encoder).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_results(df: DataFrame, path: str) -> None:
    """Results as JSON lines, in one folder."""
    df.write.mode("overwrite").json(path)


def write_summary(df: DataFrame, path: str) -> None:
    """A summary of one row as one indented JSON object and a line end, in a local file."""
    rows = df.toJSON().take(2)
    if len(rows) != 1:
        raise ValueError("a summary has one row")
    Path(path).write_text(json.dumps(json.loads(rows[0]), indent=2) + "\n", encoding="utf-8")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Earlier results, from one indented JSON object or JSON lines."""
    return spark.read.option("multiLine", not path.rstrip("/").endswith(("jsonl", "lines"))).json(path)
