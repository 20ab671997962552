"""A training corpus from documents: quality, exact and near dedup, PII, packing.

Each stage takes (spark, docs, sf_dir) and works on every row that the stage
before kept; all but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.common import keep_rows, stored
from quarrylight.llm.op2_quality import quality
from quarrylight.llm.op4_exact_dedup import exact_dedup
from quarrylight.llm.op7_pii import find_pii
from quarrylight.llm.op9_packing import pack
from quarrylight.llm.op10_jaccard_join import jaccard_join
from quarrylight.ship import ship
from quarrylight.storage import spread


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    ship(spark)
    return quality(docs, carry=True).filter("kept").select("row_.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of equal texts."""
    ship(spark)
    return keep_rows(docs, exact_dedup(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class tied by Jaccard similarity."""
    ship(spark)
    return keep_rows(docs, jaccard_join(docs))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by its kind in brackets."""
    ship(spark)
    found = find_pii(docs, carry=True)
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return found.select([new[c].alias(c) if c in new else F.col(f"row_.`{c}`").alias(c) for c in docs.columns])


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 1024 tokens, with their ids."""
    import public_tokenizers

    ship(spark)
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("PII", redact_pii),
    ("packing", pack_windows),
]

# Suffix arrays, MinHash and tokenizers are not SQL; tests/llm holds every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stored before the next."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
