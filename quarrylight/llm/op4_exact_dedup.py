"""Exact dedup by an exchange of Golomb-coded fingerprints.

1. Every source takes 56-bit fingerprints of its normalised texts, deals them
   to owners by their top bits, sorts each owner's share and codes the gaps with
   a Golomb-Rice code (some 45 bits a document at 10**6 of them).  A source is
   as many partitions together as give a share ``SHARE`` fingerprints, so there
   are n / SHARE messages at any size: 10**10 documents have 4,000 owners and
   10,000 sources of 10**6 fingerprints.
2. Each owner decodes the shares of all sources, finds the fingerprints that
   occur twice, and answers each source with one bit per hash.
3. Sources turn the bits into suspects' fingerprints.  Only suspects' whole
   texts are grouped and compared byte by byte, and only suspects' rows are
   joined with their groups; all others are alone in theirs.

Owners hold hashes of a fixed slice of the fingerprint space, which a group of
copies fills with one value of its own: sources send a value once, with a mark
if they hold it twice, so no group is large on the wire.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, bounded, columns, dropped, scan, squeezed, stored, text_hash, text_of

OWNER_ROWS = 2_500_000  # fingerprints an owner should get at most, for the choice of their number
SHARE = 256  # fingerprints that a source should send to an owner
BROADCAST_ROWS = 500_000  # suspects' fingerprints (8 bytes each) that may be broadcast; beyond it they are joined by shuffle


def rice_bits(n: int, top: int) -> int:
    """The Rice parameter for n sorted values below ``top``: log2 of the mean gap."""
    return max(0, (top // max(n, 1)).bit_length() - 1)


def rice_encode(values: np.ndarray, top: int) -> bytes:
    """Sorted distinct uint64 values below ``top`` (at most 2**56): count, then gaps' quotients in unary and remainders in k bits."""
    n = len(values)
    k = rice_bits(n, top)
    gaps = np.diff(values.astype(np.int64), prepend=0)
    quotients = gaps >> k
    ends = np.cumsum(quotients + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if n else 0, np.uint8)
    unary[ends] = 1
    rest = ((gaps[:, None] >> np.arange(k - 1, -1, -1)) & 1).astype(np.uint8) if k else np.zeros((n, 0), np.uint8)
    head = np.array([n, len(unary)], "<u4").tobytes()
    return head + np.packbits(unary).tobytes() + np.packbits(rest.ravel()).tobytes()


def rice_decode(blob: bytes, top: int) -> np.ndarray:
    n, bits = np.frombuffer(blob, "<u4", 2).tolist()
    k = rice_bits(n, top)
    at = 8 + (bits + 7) // 8
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, at - 8, 8), count=bits))
    gaps = np.diff(ends, prepend=-1) - 1
    gaps = gaps.astype(np.int64) << k
    if k:
        rest = np.unpackbits(np.frombuffer(blob, np.uint8, offset=at), count=n * k).reshape(n, k)
        gaps |= rest.astype(np.int64) @ (1 << np.arange(k - 1, -1, -1, dtype=np.int64))
    return np.cumsum(gaps)


FP_BITS = 56


def exchange_size(n: int, tasks: int) -> tuple[int, int]:
    """How many owners and how many sources share n fingerprints: as many owners as tasks while the data is small."""
    owners = max(1, -(-n // OWNER_ROWS), min(64, tasks, -(-n // (16 * SHARE))))
    return owners, max(1, n // (SHARE * owners))


def shares(rows: DataFrame, owners: int) -> DataFrame:
    """(source, owner, blob, twice): each source partition's coded share for each owner.

    ``rows`` has fp, the fingerprint as a long below 2**56.
    """
    top = -(-(1 << FP_BITS) // owners)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        source = TaskContext.get().partitionId()
        got = [b.column(0).to_numpy(zero_copy_only=False) for b in batches]
        fps, counts = np.unique(np.concatenate(got), return_counts=True) if got else (np.zeros(0, np.int64), np.zeros(0, int))
        cuts = np.searchsorted(fps, np.arange(owners + 1, dtype=np.int64) * top)
        for owner in range(owners):
            own = fps[cuts[owner] : cuts[owner + 1]]
            if len(own):
                twice = counts[cuts[owner] : cuts[owner + 1]] > 1
                yield pa.RecordBatch.from_pydict(
                    {"source": pa.array([source], pa.int32()), "owner": pa.array([owner], pa.int32()), "blob": [rice_encode(own - owner * top, top)], "twice": [np.packbits(twice).tobytes()]}
                )

    return rows.select("fp").mapInArrow(run, "source int, owner int, blob binary, twice binary")


def bitmaps(sent: DataFrame, owners: int) -> DataFrame:
    """(source, owner, bits): what each owner answers, a bit for each hash it was sent."""
    top = -(-(1 << FP_BITS) // owners)

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        each = [rice_decode(b, top) for b in pdf["blob"]]
        sizes = [len(x) for x in each]
        every = np.concatenate(each)
        _, place, counts = np.unique(every, return_inverse=True, return_counts=True)
        twice = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=n) for t, n in zip(pdf["twice"], sizes, strict=True)])
        many = (counts > 1) | (np.bincount(place, twice, len(counts)) > 0)
        bits = np.split(many[place], np.cumsum(sizes)[:-1])
        return pd.DataFrame({"source": pdf["source"], "owner": pdf["owner"], "bits": [np.packbits(b).tobytes() for b in bits]})

    return sent.groupBy("owner").applyInPandas(answer, "source int, owner int, bits binary")


def suspects(sent: DataFrame, answers: DataFrame, owners: int) -> DataFrame:
    """The fingerprints that owners have marked, each once."""
    top = -(-(1 << FP_BITS) // owners)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.zeros(0, np.int64)]
            for owner, blob, bits in zip(*(b.column(c).to_pylist() for c in ("owner", "blob", "bits")), strict=True):
                values = rice_decode(blob, top)
                found.append(values[np.unpackbits(np.frombuffer(bits, np.uint8), count=len(values)) > 0] + owner * top)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)))], names=["fp"])

    both = sent.join(answers, ["source", "owner"]).select("owner", "blob", "bits")
    return both.mapInArrow(run, "fp long").distinct()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, text_hash.

    Texts are equal when they are after each run of white space (U+0020, U+0009
    to U+000D) became one space; null counts as empty.  Of equal texts the
    smallest id stays, a null id ranking after all others.  Of repeated rows
    with the smallest id one stays.  Whole texts are hashed in the JVM, however
    long; those of suspects alone are compared.  An empty table gives no rows.
    Other input columns are ignored.
    """
    spark = docs.sparkSession
    bounded(spark)
    text = squeezed(text_of()).cast("binary")
    docs = columns(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    digest = F.sha2(text, 256)
    # 56 bits of a second, cheap hash; the digest is for grouping and output only.
    fp = F.shiftrightunsigned(F.xxhash64(text), 64 - FP_BITS)
    # The number of a row, fixed by storing it, tells repeated rows apart.
    rows = stored(docs.select("doc_id", fp.alias("fp"), digest.alias("sha"), text_hash(text_of()).alias("text_hash"), F.monotonically_increasing_id().alias("row")), "dedup-rows")
    owners, sources = exchange_size(rows.count(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    sent = stored(shares(rows.select("fp").coalesce(sources), owners), "dedup-shares")
    doubtful = stored(suspects(sent, bitmaps(sent, owners), owners), "dedup-suspects")
    dropped(sent)
    few = doubtful.count() <= BROADCAST_ROWS
    if few:
        doubtful = F.broadcast(doubtful)
    marked = rows.join(doubtful.withColumn("suspect", F.lit(True)), "fp", "left")
    if not few:  # one shuffle of rows without texts
        marked = stored(marked, "dedup-marked")
        dropped(rows)
    suspected = marked.filter("suspect")
    # Byte verification: the smallest and the largest text of a digest are the same bytes.
    texts = docs.select(text.alias("raw")).withColumn("fp", F.shiftrightunsigned(F.xxhash64("raw"), 64 - FP_BITS))
    texts = texts.join(doubtful, "fp", "left_semi").withColumn("sha", F.sha2("raw", 256))
    checked = texts.groupBy("sha").agg(F.count("*").alias("size"), F.min("raw").alias("low"), F.max("raw").alias("high")).filter("size > 1")
    same = F.when(F.col("low") == F.col("high"), F.col("size")).otherwise(F.raise_error(F.lit("two texts share a digest")).cast("long"))
    # One row of the smallest id stays.
    best = suspected.groupBy("sha").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(LAST_ID)).alias("rank"), "row", "doc_id")).alias("best"))
    groups = stored(checked.select("sha", same.alias("size")).join(best, "sha"), "dedup-groups")
    # Only suspects meet the table of groups; rows of a large group are spread by adaptive execution.
    unique = F.col("size").isNull()
    tied = suspected.join(groups, "sha", "left").select(
        "doc_id",
        F.when(unique, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (unique | (F.col("row") == F.col("best.row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
        "text_hash",
    )
    alone = marked.filter("suspect is null")
    return alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"), "text_hash").unionByName(tied)


def query(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(scan(spark, sf_dir, "doc_id", "text")).drop("text_hash")


ORACLE = r"""
WITH keyed AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS sha FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY sha) AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size,
       row_number() OVER (PARTITION BY sha ORDER BY doc_id) = 1 AS kept, sha AS text_sha256
FROM keyed
"""
