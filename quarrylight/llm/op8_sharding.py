"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0 to n-1 in the order of the given columns.  A keyed Feistel
network permutes the smallest power of four that holds n; a value that lands
outside 0 to n-1 is fed in again until it lands inside, which keeps the map a
permutation of 0 to n-1.  Row number, count and seed alone give shard and slot:
shard = p mod shards, slot = p div shards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scan, stored, text_of, whole_row

PRIME = (1 << 31) - 1
ROUNDS = 6
SEED = 20240229
SHARDS = 24


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    return [int.from_bytes(hashlib.sha256(f"{seed}/{i}".encode()).digest()[:8], "big") % PRIME for i in range(rounds)]


def half_bits(n: int) -> int:
    """Bits of one half of the permuted domain, the smallest 4**b that is >= n."""
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def permute(rows: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """The place of each row number under the permutation of 0 to n-1; n up to 4**31."""
    bits, keys = half_bits(n), round_keys(seed)
    mask, prime = np.uint64((1 << bits) - 1), np.uint64(PRIME)
    out = rows.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> np.uint64(bits), out[walking] & mask
        for key in keys:
            t = (right + np.uint64(key)) % prime
            left, right = right, left ^ ((t * t % prime * t % prime) & mask)
        out[walking] = (left << np.uint64(bits)) | right
        walking = walking[out[walking] >= n]
    return out.astype(np.int64)


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """(row, number): each row as a struct and its number, 0 to n-1 in the order of ``order``, by one range shuffle.

    The sorted rows are stored with their partition and place; a prefix sum
    over one count per partition makes the places global.  Input columns lie in
    the struct, so no name of theirs can clash.
    """
    keys = [f"key{i}" for i in range(len(order))]
    rows = df.select(whole_row(df).alias("row"), *[F.col(f"`{c}`").alias(k) for c, k in zip(order, keys, strict=True)])
    kept = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("row", F.monotonically_increasing_id().alias("at")), "numbered")
    part = F.shiftrightunsigned("at", 33)
    kept = kept.select("row", part.alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    counts = kept.groupBy("part").agg(F.count("*").alias("rows"))
    # One row per partition of the range shuffle: its size is that setting's, not the data's.
    starts = counts.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("start"))
    return kept.join(F.broadcast(starts), "part").select("row", (F.col("start") + F.col("at")).alias("number"))


def shard(df: DataFrame, order: list[str], n_shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Add shard (0 to n_shards-1) and slot (gapless from 0 in each shard) to every row.

    Counts of shards differ by one at most.  Rows equal on all of ``order`` are
    numbered in any order among themselves; nulls come first.  An empty table
    stays empty.  Input columns named shard or slot are replaced; all others
    are carried along, whatever their names, and long texts stay whole.
    """
    df = df.drop("shard", "slot")
    rows = numbered(df, order)
    n = rows.count()
    schema = rows.select("row", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).schema

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = permute(b.column(1).to_numpy(zero_copy_only=False), n, seed)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((p % n_shards).astype(np.int32)), pa.array(p // n_shards)], names=["row", "shard", "slot"])

    return rows.mapInArrow(place, schema).select("row.*", "shard", "slot")


def write_shards(df: DataFrame, path: str, order: list[str], n_shards: int = SHARDS, seed: int = SEED) -> None:
    """Write the rows as one folder per shard, files within it in the order of slots."""
    placed = shard(df, order, n_shards, seed)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    text = text_of()
    docs = scan(spark, sf_dir, "doc_id", "text").select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    out = shard(docs, ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


ORACLE = None  # DuckDB has no crc32; tests/llm holds shard and slot of every row against a plain walk
