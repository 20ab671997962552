"""Byte-level BPE by corpus-level merge replay.

Distinct pieces of a block of texts are laid out as one array of byte tokens.
An inverted index leads from a pair (by the rank of the token it merges into)
to the positions of its left parts.  Ranks are taken in rising order; all
positions of a rank merge at once, and only the two touched neighbours of each
get a new pair and a new entry in the index.

A worker keeps what it has learnt of chunks up to a bound in bytes, and a block
ends when enough new pieces have come together, so a replay's cost is shared.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from sys import getsizeof

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import bounded, columns, pieces, scan
from .encoding import byte_chunks, chunk_text

NONE = np.int32(2**31 - 1)  # no merge
BLOCK_CHUNKS = 150_000  # new chunks that end a block
BLOCK_NEW = 8 << 20  # bytes of new chunks that end it, a replay's memory being some 30 times that
BLOCK_TEXT = 24 << 20  # characters that end it in any case
KEPT_BYTES = 160 << 20  # of chunks, their ids and decimals that a worker keeps
ENTRY = 150  # bytes of a chunk's entries beside its own and its ids'


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class MergeReplay:
    """Encodes many pieces at once by the ranks of a vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = rank
        keys = np.array(sorted(pairs), np.int64)
        self.keys = np.append(keys, np.iinfo(np.int64).max)
        self.merges_into = np.array([*map(pairs.get, keys.tolist()), NONE], np.int32)
        by_id = sorted((rank, token) for token, rank in ranks.items())
        self.token_start = np.zeros(self.size + 1, np.int64)
        for rank, token in by_id:
            self.token_start[rank + 1] = len(token)
        self.token_size = self.token_start[1:].copy()
        self.token_start = np.cumsum(self.token_start)
        self.token_bytes = np.frombuffer(b"".join(t for _, t in by_id), np.uint8)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that each pair merges into, NONE if there is no such merge."""
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.merges_into[at], NONE)

    def one(self, piece: bytes) -> list[int]:
        """A single piece, its least rank first, leftmost among equals."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], int(NONE)), i) for i in range(len(parts) - 1))
            if rank == NONE:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def encode(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of distinct non-empty pieces; one that is a token itself is that token."""
        out: list = [self.ranks.get(p) for p in pieces]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in enumerate(out):
            if x is not None:
                out[i] = np.array([x], np.int32)
        if rest:
            sym, alive, word, redo = self.replay([pieces[i] for i in rest])
            cuts = np.flatnonzero(np.diff(word[alive])) + 1
            for i, ids in zip(rest, np.split(sym[alive], cuts), strict=True):
                out[i] = ids
            for w in redo:
                out[rest[w]] = np.array(self.one(pieces[rest[w]]), np.int32)
        return out

    def replay(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, set[int]]:
        sizes = np.array([len(p) for p in pieces])
        word = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
        sym = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(sym)
        after = np.arange(1, n + 1, dtype=np.int32)
        before = np.arange(-1, n - 1, dtype=np.int32)
        ends = np.cumsum(sizes)
        after[ends - 1] = -1
        before[ends - sizes] = -1
        now = np.full(n, NONE, np.int32)  # what the pair that starts at a position merges into
        inner = np.flatnonzero(after >= 0)
        now[inner] = self.pair(sym[inner], sym[inner + 1])
        found = np.flatnonzero(now != NONE)
        order = found[np.argsort(now[found], kind="stable")]
        present, first = np.unique(now[order], return_index=True)
        index: dict[int, list] = {r: [p] for r, p in zip(present.tolist(), np.split(order, first[1:]), strict=True)} if len(order) else {}
        later: dict[int, list[int]] = {}
        heap = present.tolist()
        redo: set[int] = set()
        while heap:
            rank = heapq.heappop(heap)
            at = [*index.pop(rank, ())]
            if rank in later:
                at.append(np.array(later.pop(rank), np.int64))
            if not at:
                continue
            pos = np.concatenate(at) if len(at) > 1 else at[0]
            pos = pos[now[pos] == rank]
            if len(at) > 1 or len(pos) > 1:
                pos = np.unique(pos)
            if not len(pos):
                continue
            gone = after[pos]
            if len(pos) > 1:
                over = now[gone] == rank
                if over.any():  # a run of one token: every second pair from the left
                    taken, keep = set(), []
                    for p, g in zip(pos.tolist(), gone.tolist(), strict=True):
                        if p not in taken:
                            keep.append(p)
                            taken.add(g)
                    pos = np.array(keep)
                    gone = after[pos]
            sym[pos] = rank
            beyond = after[gone]
            after[pos] = beyond
            right = beyond >= 0
            before[beyond[right]] = pos[right]
            now[gone] = NONE
            after[gone] = -2
            now[pos] = NONE
            p = pos[right]
            now[p] = self.pair(sym[p], sym[beyond[right]])
            left = before[pos]
            q = left[left >= 0]
            now[q] = self.pair(sym[q], sym[after[q]])
            touched = np.concatenate([p, q])
            ranks = now[touched]
            good = ranks != NONE
            for r, t in zip(ranks[good].tolist(), touched[good].tolist(), strict=True):
                if r in later:
                    later[r].append(t)
                else:
                    later[r] = [t]
                    heapq.heappush(heap, r)
                if r < rank:  # its turn is over; such a piece is encoded by itself
                    redo.add(int(word[t]))
        return sym, after != -2, word, redo

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of tokens, gathered from one table."""
        start, size = self.token_start[ids], self.token_size[ids]
        ends = np.cumsum(size)
        if not len(ids):
            return b""
        at = np.repeat(start - (ends - size), size) + np.arange(ends[-1])
        return self.token_bytes[at].tobytes()


class BlockEncoder:
    """A worker's chunks: their ids in one flat array."""

    def __init__(self, path: str, pattern: str):
        self.replay = MergeReplay(read_ranks(path))
        self.pieces = regex.compile(pattern).findall
        self.clear()

    def clear(self) -> None:
        self.number: dict = {}
        self.flat = np.zeros(0, np.int32)
        self.start = np.zeros(1, np.int64)
        self.decimal: list[str] = []
        self.held = self.fresh = 0  # bytes of all chunks with what is known of them, and of the chunks not learnt yet

    def places(self, text: str) -> np.ndarray:
        """The numbers of the text's chunks; new chunks get new numbers."""
        chunks = byte_chunks(text)
        number = self.number
        for c in set(chunks).difference(number):  # a dict is probed, not read through
            number[c] = len(number)
            self.fresh += getsizeof(c)
        return np.fromiter(map(number.__getitem__, chunks), np.int32, len(chunks))

    def full(self) -> bool:
        return len(self.number) - len(self.decimal) >= BLOCK_CHUNKS or self.fresh >= BLOCK_NEW + 50 * (len(self.number) - len(self.decimal))

    def learn(self) -> None:
        """Replay the merges over the pieces of all chunks not learnt yet."""
        fresh = list(self.number)[len(self.decimal) :]
        split = [self.pieces(chunk_text(c)) for c in fresh]
        distinct = list(dict.fromkeys(p for own in split for p in own))
        ids = dict(zip(distinct, self.replay.encode([p.encode() for p in distinct]), strict=True))
        each = [ids[own[0]] if len(own) == 1 else np.concatenate([ids[p] for p in own]) for own in split]
        self.flat = np.concatenate([self.flat, *each])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum([len(x) for x in each], dtype=np.int64)])
        self.decimal += [",".join(map(str, x.tolist())) for x in each]
        self.held += self.fresh + sum(map(getsizeof, self.decimal[len(self.decimal) - len(each) :])) + sum(x.nbytes for x in each) + ENTRY * len(each)
        self.fresh = 0

    def ids(self, places: np.ndarray) -> np.ndarray:
        size = self.start[places + 1] - self.start[places]
        ends = np.cumsum(size)
        if not len(places):
            return np.zeros(0, np.int32)
        return self.flat[np.repeat(self.start[places] - (ends - size), size) + np.arange(ends[-1])]


@lru_cache(maxsize=2)
def block_encoder(path: str, pattern: str) -> BlockEncoder:
    return BlockEncoder(path, pattern)


def blocks(batches: Iterator[pa.RecordBatch], enc: BlockEncoder) -> Iterator[list[tuple[int | None, np.ndarray]]]:
    """(doc_id, numbers of its chunks) of a block of texts, after its replay."""
    waiting, chars = [], 0
    for b in pieces(batches, 1):
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            waiting.append((doc_id, enc.places(text or "")))
            chars += len(text or "")
            if enc.full() or chars >= BLOCK_TEXT:
                enc.learn()
                yield waiting
                waiting, chars = [], 0
                if enc.held > KEPT_BYTES:
                    enc.clear()
    enc.learn()
    yield waiting
    if enc.held > KEPT_BYTES:
        enc.clear()


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (unsigned 32-bit, little-endian) of each whole text, without special tokens.

    A null or empty text has no ids.  Ids of documents may be null or repeat.
    A very long text is a block of its own.  An empty table gives no rows.
    Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = block_encoder(path, pattern)
        for block in blocks(batches, enc):
            for i in range(0, len(block), 256):
                part = block[i : i + 256]
                ids = [enc.ids(places).astype("<u4").tobytes() for _, places in part]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in part], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    bounded(docs.sparkSession)
    return columns(docs, doc_id=id_col, text=text_col).mapInArrow(run, "doc_id long, ids binary")


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the decoded bytes of rows of ``encode``; null ids decode to no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = block_encoder(path, pattern).replay
        for b in batches:
            raw = [replay.decode(np.frombuffer(x or b"", "<u4")) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(raw, pa.binary())], names=["doc_id", "decoded"])

    bounded(tokens.sparkSession)
    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode in one pass over (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = block_encoder(path, pattern)
        for block in blocks(batches, enc):
            decimal = enc.decimal.__getitem__
            rows = []
            for doc_id, places in block:
                ids = enc.ids(places)
                text = ",".join(map(decimal, places.tolist()))
                rows.append((doc_id, len(ids), hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(enc.replay.decode(ids)).hexdigest()))
            cols = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.string(), pa.string()], strict=True)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    bounded(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = scan(spark, sf_dir, "doc_id", "text")
    return digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


ORACLE = None  # held against the tiktoken library and a round trip in tests/llm
