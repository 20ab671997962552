"""Packing by bounded-space online best fit.

Every partition encodes its texts and keeps a fixed number of open windows.  A
document first fills whole windows; its rest goes to the open window it fits
most tightly.  When none fits and no window may be opened, the fullest is
emitted.  At the end of a partition its open windows are left over; groups of
partitions merge theirs, the longest first, by best fit again.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, columns, give_back, scan, stored
from .encoding import encoder, gathered

WINDOW = 1024
OPEN = 64  # open windows of a partition; more hardly lower the padding
END_ID = 0
MERGED_PARTS = 64  # partitions whose leftovers one task merges: at most MERGED_PARTS * OPEN lengths
MERGED = 1 << 28  # where the numbers of merging groups begin, above those of partitions


class Windows:
    """Open windows of one partition, by free room."""

    def __init__(self, window: int, most: int):
        self.window, self.most = window, most
        self.free: list[tuple[int, int]] = []  # (room, number), sorted
        self.pieces: dict[int, list[tuple]] = {}
        self.next = 0

    def open(self) -> int:
        self.next += 1
        self.pieces[self.next - 1] = []
        return self.next - 1

    def whole(self, piece: tuple) -> int:
        """A piece that fills a window by itself."""
        number = self.open()
        self.pieces[number].append((0, *piece))
        return number

    def place(self, length: int, piece: tuple) -> list[int]:
        """Put a piece of at most a window; returns windows that are done."""
        at = bisect_left(self.free, (length, -1))
        done = []
        if at < len(self.free):
            room, number = self.free.pop(at)
        else:
            if len(self.free) >= self.most:
                done.append(self.free.pop(0)[1])
            room, number = self.window, self.open()
        self.pieces[number].append((self.window - room, *piece))
        if room == length:
            done.append(number)
        else:
            insort(self.free, (room - length, number))
        return done


SCHEMA = pa.schema([
    ("part", pa.int32()), ("seq", pa.int64()), ("open", pa.bool_()), ("offset", pa.int64()), ("doc_id", pa.int64()),
    ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()),
])
TYPES = "part int, seq long, open boolean, offset long, doc_id long, start long, length long, doc_tokens long, ids binary"


def packed(docs: DataFrame, path: str, kind: str | None, end_id: int, window: int, most: int) -> DataFrame:
    """Pieces as each partition places them; those of windows still open at its end are marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc = encoder(path, kind)
        end = np.array([end_id], enc.dtype).tobytes()
        windows = Windows(window, most)
        rows: list[tuple] = []

        def emit(number: int, still_open: bool) -> None:
            for offset, doc_id, start, length, total, raw in windows.pieces.pop(number):
                ids = np.frombuffer(raw, enc.dtype).astype("<u4").tobytes()
                rows.append((part, number, still_open, offset, doc_id, start, length, total, ids))

        def batch() -> pa.RecordBatch:
            cols = zip(*rows, strict=True)
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, SCHEMA.types, strict=True)], schema=SCHEMA)
            rows.clear()
            return out

        width = enc.dtype.itemsize
        for b in gathered(batches):
            for doc_id, raw in zip(b.column(0).to_pylist(), enc.encode(b.column(1)), strict=True):
                raw += end
                total = len(raw) // width
                for start in range(0, total, window):
                    length = min(window, total - start)
                    piece = (doc_id, start, length, total, raw[start * width : (start + length) * width])
                    for number in windows.place(length, piece) if length < window else [windows.whole(piece)]:
                        emit(number, False)
                if len(rows) >= 512:
                    yield batch()
        for number in list(windows.pieces):
            emit(number, True)
        if rows:
            yield batch()
        give_back()

    bounded(docs.sparkSession)
    return docs.mapInArrow(run, TYPES)


def merged(left: DataFrame, window: int) -> DataFrame:
    """(part, seq, sequence_id, base): the new window of each leftover one and its place there."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["used", "part", "seq"], ascending=[False, True, True], ignore_index=True)
        free: list[tuple[int, int]] = []
        number, base, made = [], [], 0
        for used in pdf["used"]:
            at = bisect_left(free, (used, -1))
            if at < len(free):
                room, n = free.pop(at)
            else:
                room, n, made = window, made, made + 1
            number.append(n)
            base.append(window - room)
            insort(free, (room - used, n))
        ids = ((MERGED + int(key[0])) << 32) + np.array(number, np.int64)
        return pd.DataFrame({"part": pdf["part"], "seq": pdf["seq"], "sequence_id": ids, "base": np.array(base, np.int64)})

    group = F.floor(F.col("part") / MERGED_PARTS).cast("int").alias("group")
    return left.groupBy(group).applyInPandas(run, "part int, seq long, sequence_id long, base long")


def pack(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", kind: str | None = None, end_id: int = END_ID, window: int = WINDOW, most: int = OPEN,
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (unsigned 32-bit, little-endian).

    A null or empty text has only the end id.  Null and repeated ids are
    carried along.  Documents are cut only where they fill a window, so a very
    long text takes whole windows and one place for its rest.  Of open windows
    with equal room the one opened first is taken, or emitted.  An empty table
    gives no pieces.  Other columns are ignored.  ``kind`` may name the
    tokenizer's shape, which the file must then have.
    """
    pieces = stored(packed(columns(docs, doc_id=id_col, text=text_col), path, kind, end_id, window, most), "packed")
    wanted = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    done = pieces.filter("not open").withColumn("sequence_id", F.shiftleft(F.col("part").cast("long"), 32) + F.col("seq"))
    left = pieces.filter("open")
    # At most OPEN rows for each partition of the input.
    places = merged(left.groupBy("part", "seq").agg(F.sum("length").alias("used")), window)
    moved = left.join(places, ["part", "seq"]).withColumn("offset", F.col("offset") + F.col("base"))
    return done.select(wanted).unionByName(moved.select(wanted))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pack(scan(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


ORACLE = None  # a tokenizer is not SQL: ids and places are checked in tests/llm
