"""Catalog profiling: completeness of fields, keys of details, leaves of the category tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THIN_LEAF = 30


def completeness(df: DataFrame) -> DataFrame:
    """(field, filled, share) for every column; empty strings count as missing. One pass, one row per column."""
    is_text = {f.name: f.dataType.typeName() == "string" for f in df.schema}
    filled = [F.count(F.when((F.col(c) != "") if is_text[c] else F.col(c).isNotNull(), 1)).alias(c) for c in df.columns]
    row = df.agg(F.count("*").alias("n_"), *filled)
    each = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("filled")) for c in df.columns])
    return row.select("n_", F.explode(each).alias("f")).select("f.field", "f.filled", F.round(F.when(F.col("n_") > 0, F.col("f.filled") / F.col("n_")), 6).alias("share"))


def detail_keys(df: DataFrame, json_column: str) -> DataFrame:
    """(key, n): how many JSON objects have each key."""
    keys = df.select(F.explode(F.array_distinct(F.json_object_keys(json_column))).alias("key"))
    return keys.groupBy("key").agg(F.count("*").alias("n"))


def leaf_counts(docs: DataFrame, k: int | None = 20) -> DataFrame:
    """(leaf, n): documents per last segment, the k most common if k is given."""
    counts = docs.filter(F.size("path") > 0).groupBy(F.element_at("path", -1).alias("leaf")).agg(F.count("*").alias("n"))
    return counts if k is None else counts.orderBy(F.desc("n"), "leaf").limit(k)


def thin_leaves(docs: DataFrame, below: int = THIN_LEAF) -> DataFrame:
    """One row: number of leaves, of thin ones, and of documents in those."""
    counts = leaf_counts(docs, None)
    thin = F.col("n") < below
    return counts.agg(F.count("*").alias("n_leaves"), F.count(F.when(thin, 1)).alias("n_thin"), F.coalesce(F.sum(F.when(thin, F.col("n"))), F.lit(0)).alias("docs_affected"))


def department_counts(docs: DataFrame) -> DataFrame:
    """(department, n): documents per second segment of their path; shorter paths have none."""
    return docs.filter("size(path) > 1 and path[1] is not null").groupBy(F.get("path", F.lit(1)).alias("department")).agg(F.count("*").alias("n"))
