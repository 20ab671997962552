"""Token-ID files: frequency-ranked ids in a byte-aligned code with control bytes apart.

1. Every whole text is encoded once and its ids are stored.
2. Ids are counted over the whole corpus; the rank of an id by falling count is
   what the file holds, so that frequent ids take one byte.
3. Rows are range-sorted by id and written in segments.  In a segment each
   value has a two-bit length (1 to 4 bytes), four to a control byte; control
   bytes stand before the data bytes.
4. Reading looks up lengths of four values per control byte in a table and
   gathers bytes by offset, all in numpy.

A token file is a folder with two Parquet tables: ``segments``, a row each
(Spark's committer makes it safe against lost executors), and ``ranks``, the id
that each rank stands for.  The folder alone is enough to read it back.

Segment: ``QLTF``, version, number of documents, number of ids (unsigned
32-bit), ids of documents (int64), flags of null ids (packed), then two coded
streams, each with its length: ids per document, ranks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.storage import app_folder

from .common import bounded, columns, dropped, give_back, scan, stored
from .encoding import encoder, gathered

MAGIC = np.array([int.from_bytes(b"QLTF", "little"), 1], "<u4").tobytes()
SEGMENT_IDS = 1 << 18
END_ID = 2
# Lengths of the four values of each control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def pack(values: np.ndarray) -> bytes:
    """Count, size of data, control bytes, data bytes of unsigned 32-bit values."""
    v = values.astype(np.uint32)
    n = len(v)
    size = (1 + (v > 0xFF) + (v > 0xFFFF) + (v > 0xFFFFFF)).astype(np.uint8)
    codes = np.zeros(-(-n // 4) * 4, np.uint8)
    codes[:n] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    at = np.cumsum(size, dtype=np.int64) - size
    data = np.zeros(int(size.sum(dtype=np.int64)), np.uint8)
    data[at] = v & 0xFF
    for byte in (1, 2, 3):
        longer = np.flatnonzero(size > byte)
        if not len(longer):
            break
        data[at[longer] + byte] = (v[longer] >> np.uint32(8 * byte)) & 0xFF
    return np.array([n, len(data)], "<u4").tobytes() + control.tobytes() + data.tobytes()


def unpack(blob: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """The values of a coded stream and where it ends."""
    n, size = np.frombuffer(blob, "<u4", 2, at).tolist()
    control = np.frombuffer(blob, np.uint8, -(-n // 4), at + 8)
    data = np.frombuffer(blob, np.uint8, size, at + 8 + len(control))
    lengths = LENGTHS[control].ravel()[:n]
    start = np.cumsum(lengths, dtype=np.int64) - lengths
    v = data[start].astype(np.uint32)
    for byte in (1, 2, 3):
        longer = np.flatnonzero(lengths > byte)
        if not len(longer):
            break
        v[longer] |= data[start[longer] + byte].astype(np.uint32) << np.uint32(8 * byte)
    return v, at + 8 + len(control) + size


def write_segment(doc_ids: list[int | None], counts: list[int], ranks: np.ndarray) -> bytes:
    head = np.array([len(doc_ids), len(ranks)], "<u4").tobytes()
    ids = np.array([d or 0 for d in doc_ids], "<i8").tobytes()
    null = np.packbits(np.array([d is None for d in doc_ids], np.uint8)).tobytes()
    return MAGIC + head + ids + null + pack(np.array(counts, np.uint32)) + pack(ranks)


def read_segment(blob: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, ids per document, ranks."""
    if blob[:8] != MAGIC:
        raise ValueError("not a segment of a token file")
    n = int(np.frombuffer(blob, "<u4", 1, 8)[0])
    ids = np.frombuffer(blob, "<i8", n, 16).tolist()
    null = np.unpackbits(np.frombuffer(blob, np.uint8, -(-n // 8), 16 + 8 * n), count=n)
    counts, at = unpack(blob, 16 + 8 * n + -(-n // 8))
    ranks, _ = unpack(blob, at)
    return [None if x else i for i, x in zip(ids, null, strict=True)], counts, ranks


def encoded(docs: DataFrame, tokenizer: str, kind: str | None, end_id: int) -> DataFrame:
    """(doc_id, ids): each whole text's ids and the end id, as little-endian bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, kind)
        end = np.array([end_id], enc.dtype).tobytes()
        for b in gathered(batches):
            ids = [x + end for x in enc.encode(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "ids"])
        give_back()

    bounded(docs.sparkSession)
    return docs.mapInArrow(run, "doc_id long, ids binary")


def write_tokens(
    docs: DataFrame, tokenizer: str, out: str | None = None, id_col: str = "doc_id", text_col: str = "text", kind: str | None = None, end_id: int = END_ID,
) -> str:
    """Encode all rows and write the token file in ascending order of ids; returns its folder.

    ``out`` is a folder that driver and executors share and that does not exist
    yet; without it the file goes to this application's own tables.  ``kind``
    may name the tokenizer's shape (see ``encoding.SHAPES``), which the file
    must then have.

    A null or empty text has only the end id.  A null id comes first; rows with
    the same id stand next to each other, by their ids' checksum.  Ids of equal
    frequency rank by rising id.  A segment holds whole documents and ends after
    ``SEGMENT_IDS`` ids, so one very long text is one segment.  An empty table
    gives no segments.  Other columns are ignored.
    """
    spark = docs.sparkSession
    out = out or f"{app_folder(spark)}/token-file-{uuid.uuid4().hex}"
    dtype = encoder(tokenizer, kind).dtype
    ids = stored(encoded(columns(docs, doc_id=id_col, text=text_col), tokenizer, kind, end_id), "token-ids")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            n = np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), dtype), minlength=len(total))
            n[: len(total)] += total
            total = n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    # One row per id of the vocabulary comes to the driver.
    counts = ids.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    found = sorted((-r.n, r.id) for r in counts.collect())
    id_of_rank = np.array([i for _, i in found], np.uint32)
    rank_of_id = np.zeros(int(id_of_rank.max()) + 1 if found else 1, np.uint32)
    rank_of_id[id_of_rank] = np.arange(len(found))
    ranks = spark.createDataFrame([(rank, i) for rank, (_, i) in enumerate(found)], "rank long, id long")
    ranks.coalesce(1).write.parquet(f"{out}/ranks")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seg, start = TaskContext.get().partitionId(), 0, 0
        doc_ids, blobs, waiting = [], [], 0

        def segment() -> pa.RecordBatch:
            values = np.frombuffer(b"".join(blobs), dtype)
            blob = write_segment(doc_ids, [len(x) // dtype.itemsize for x in blobs], rank_of_id[values])
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "seg": pa.array([seg], pa.int32()), "start_in_part": [start], "n_ids": [len(values)], "segment": [blob],
            })

        for b in batches:
            for doc_id, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                doc_ids.append(doc_id)
                blobs.append(own)
                waiting += len(own) // dtype.itemsize
                if waiting >= SEGMENT_IDS:
                    yield segment()
                    seg, start = seg + 1, start + waiting
                    doc_ids, blobs, waiting = [], [], 0
        if doc_ids:
            yield segment()

    order = ["doc_id", F.crc32("ids")]
    ranged = ids.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.mapInArrow(write, "part int, seg int, start_in_part long, n_ids long, segment binary").write.parquet(f"{out}/segments")
    dropped(ids)
    return out


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (unsigned 32-bit, little-endian) of every document in the token file at ``path``."""
    seg = spark.read.parquet(f"{path}/segments")
    parts = seg.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # A row for each partition that wrote the file.
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    # A row for each id that occurs: bounded by the vocabulary.
    id_of_rank = np.array([r.id for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, before, blob in zip(*(b.column(c).to_pylist() for c in ("start_in_part", "before", "segment")), strict=True):
                doc_ids, counts, ranks = read_segment(blob)
                ids = id_of_rank[ranks].astype("<u4")
                ends = np.cumsum(counts, dtype=np.int64)
                own = np.split(ids, ends[:-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(ends - counts + start + before), pa.array(counts.astype(np.int64)), pa.array([x.tobytes() for x in own], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    placed = seg.join(F.broadcast(before), "part").select("start_in_part", "before", "segment")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = write_tokens(scan(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


ORACLE = None  # a tokenizer is not SQL: whole texts through the library in tests/llm
