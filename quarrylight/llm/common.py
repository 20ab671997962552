"""Shared pieces of the corpus operators."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.storage import dropped, shared_dir, spread, stored  # noqa: F401

# White space of the contracts: U+0020 and U+0009 to U+000D.
WS = " \t\n\x0b\x0c\r"
LAST_ID = (1 << 63) - 1  # rank of a null id: after every other id
BATCH_BYTES = 1 << 20  # of an Arrow batch between the JVM and Python, but for a single longer row
PIECE_ROWS, PIECE_BYTES = 256, 4 << 20  # of a batch that Python works on at once


def bounded(spark: SparkSession) -> None:
    """Have Spark send Arrow batches of at most ``BATCH_BYTES``, for all operators alike; a smaller setting stays.

    This is a setting of the session.  It bounds what the JVM and a Python
    worker hold of a batch; limits on rows are not touched.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", spark.conf.get(key))
    if not now or int(now[1]) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def give_back() -> None:
    """At a task's end: return what Python and Arrow have freed to the machine, since a worker stays for tasks of other operators."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def pieces(batches: Iterator[pa.RecordBatch], text: int, rows: int = PIECE_ROWS, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to at most ``rows`` rows and ``size`` bytes of the text column, but for a single longer text.

    Spark bounds the batches it sends by bytes only, and what Python makes of
    many short texts is many times their size.  Cuts copy nothing.
    """
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < b.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
            stop = min(stop, start + rows, b.num_rows)
            yield b.slice(start, stop - start)
            start = stop


def scan(spark: SparkSession, sf_dir: str, *names: str, table: str = "documents") -> DataFrame:
    """The named columns of a table, over all cores."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spread(df.select(*names) if names else df)


def columns(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the columns an operator reads, under the operator's own names."""
    return df.select(*[F.col(f"`{c}`").alias(name) for name, c in wanted.items()])


def whole_row(df: DataFrame) -> Column:
    """All columns of a row in one struct, so that no name can clash."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row_")


def text_hash(text: Column) -> Column:
    """Tells rows with the same id apart; rows alike in both are repeated rows."""
    return F.xxhash64(text)


def keep_rows(docs: DataFrame, decisions: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 500_000) -> DataFrame:
    """The rows of ``docs`` that ``decisions`` (doc_id, text_hash, kept; a row for each) keeps.

    Ids of rows that go (16 bytes each) are broadcast up to ``broadcast_rows``
    and joined by shuffle beyond.  Of repeated rows of which some were kept and
    some not, one stays.
    """
    by = decisions.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("long")).alias("stay"))
    by = stored(by.filter("stay < n"), "decisions")
    named = docs.select(whole_row(docs), F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_hash(text_of(text_col)).alias("text_hash"))
    few = by.count() <= broadcast_rows
    gone = by.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"), "stay")
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("text_hash") == F.col("gone_hash"))
    rest = named.join(F.broadcast(gone) if few else gone, same, "left_anti")
    repeated = gone.filter("stay > 0")
    if repeated.head(1):
        # Rows alike in id and text are decided alike, or are copies of which one stays.
        some = named.join(F.broadcast(repeated) if few else repeated, same).dropDuplicates(["doc_id", "text_hash"])
        rest = rest.select("row_").unionByName(some.select("row_"))
    return rest.select("row_.*")


def text_of(name: str = "text") -> Column:
    """The text, a null one counted as empty."""
    return F.coalesce(F.col(f"`{name}`"), F.lit(""))


def squeezed(text: Column) -> Column:
    """Each run of white space replaced by one space."""
    return F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " ")
