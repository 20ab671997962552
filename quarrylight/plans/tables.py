"""The driver's tables in the shape the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalise
from ..storage import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, lang, source and the category path [lang, source]."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return spread(docs).withColumn("path", F.array("lang", "source"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as products: title, store, category path [type, brand], price."""
    raw = table(spark, sf_dir, "part")
    return raw.select(
        F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("store"), F.concat_ws(" ", "p_type", "p_brand").alias("categories"),
        F.array("p_type", "p_brand").alias("path"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as queries."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def product_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One opening message per part: a third by template, a third in other words, a third naming only the type."""
    p = spread(products(spark, sf_dir))
    label = F.concat_ws(" ", F.element_at("path", 1), F.element_at("path", 2))
    third = F.col("doc_id") % 3
    said = (
        F.when(third == 0, F.concat(F.lit("I'm looking for "), label, F.lit(". A key requirement is: "), F.col("title"), F.lit(".")))
        .when(third == 1, F.concat(F.lit("Hey, any "), label, F.lit(" with a "), F.col("title"), F.lit("?")))
        .otherwise(F.concat(F.lit("Some "), F.lower(F.element_at("path", 1)), F.lit(" brand things, really "), F.col("title")))
    )
    return p.select(F.col("doc_id").alias("query_id"), said.alias("message"))


def session_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns of conversations; every fifth revokes something, the first names a type and brand."""
    c = spread(table(spark, sf_dir, "conversations").filter("role = 'user'"))
    key = F.col("conv_id") * 7 + F.col("turn")
    kind = F.element_at(F.array(*[F.lit(x) for x in TYPES]), (F.col("conv_id") % 6 + 1).cast("int"))
    named = F.concat(kind, F.lit(" brand#"), (F.col("conv_id") % 25 + 1).cast("string"))
    text = F.coalesce("text", F.lit(""))
    said = F.when(F.col("turn") <= 1, F.concat(F.lit("I'm looking for "), named, F.lit(". "), text)).when(key % 5 == 0, F.concat(F.lit("Actually, change to "), named, F.lit("; "), text)).otherwise(text)
    label = F.when((F.col("turn") <= 1) | (key % 5 == 0), normalise(named))
    return c.select(F.col("conv_id").alias("session"), "turn", said.alias("message"), label.alias("label_any"), label.alias("label_verbatim"))


TYPES = ["standard", "economy", "medium", "promo", "large", "small"]
