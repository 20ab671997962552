"""N-gram Jaccard join with Bayesian candidate pruning.

1. Each text's set of five-word shingles gets MinHash values; texts with equal
   sets are one class from here on.
2. Classes that agree on all values of a band meet in a bucket.  In it, pairs
   are compared a few MinHash values at a time and dropped as soon as the
   posterior probability of reaching the threshold is below the tolerance.
   What stays ties classes into families; only a spanning forest is written.
   In a large bucket every member is first compared with one leader, row by
   row; members that stay are tied by it and need no comparison among
   themselves.  Only the rest meets all members, in blocks, so a bucket of near
   copies costs rows in proportion to its size.
3. Members of a family, with their sets, meet.  Pairs are pruned the same way
   and the rest verified exactly.  Each member gets its number of links and one
   way to its component, never a row per pair.

Families are cut into blocks, and every pair of blocks is a group of its own,
so no task holds more than two blocks and no pair is left out.  A member is
copied once for each block: at most ``MOST_BLOCKS`` times up to a family of
130,000 different sets, once for 4,096 members beyond, or for 16 MB of sets.
With 32 bands of 4 values a pair at Jaccard 0.8 shares no bucket with
probability 5e-8; that and the tolerance are all that can lose a link.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb
from sys import getsizeof

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, bounded, columns, dropped, give_back, pieces, scan, stored, text_hash, text_of
from .components import components

SHINGLE = 5
THRESHOLD = 0.8
TOLERANCE = 1e-6
HASHES, BANDS = 128, 32
STEP = 16  # MinHash values compared at a time
SMALL_BLOCK = 112  # members of a block, while there are not too many blocks
MOST_BLOCKS = 32  # blocks up to which blocks are kept small
LARGE_BLOCK = 4096  # members of a block at most
BLOCK_BYTES = 16 << 20  # bytes of sets of a block, about
TILE = 256  # members of either side of the pairs compared at once
PAIRS = 200_000  # pairs compared at once
CELLS = 4_000_000  # cells of a membership matrix at once
BROADCAST_ROWS = 500_000  # text hashes (8 bytes each) that may be broadcast; beyond it they are joined by shuffle
WORD_BYTES = 48 << 20  # of words and their hashes that a worker keeps

_RNG = np.random.default_rng(20240229)
A = (_RNG.integers(0, 1 << 31, HASHES, dtype=np.uint64) * 2 + 1).astype(np.uint32)[:, None]
B = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)[:, None]
_words: dict[bytes, int] = {}
_held = 0  # bytes of it, about


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the lower-cased five-word shingles.

    Words lie between white space (U+0020, U+0009 to U+000D).  A text of one to
    four words has one shingle, one without words none.
    """
    words = text.lower().encode().split()
    if not words:
        return np.zeros(0, np.uint64)
    global _held
    new = set(words).difference(_words)
    if new:
        if _held > WORD_BYTES:
            forget()
            new = set(words)
        _words.update((w, xxhash.xxh3_64_intdigest(w)) for w in new)
        _held += sum(map(getsizeof, new)) + 140 * len(new)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(h))
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


def forget() -> None:
    """Give the words' memory back, for what the worker does next."""
    global _held
    _words.clear()
    _held = 0
    give_back()


def set_hashes(s: np.ndarray) -> tuple[int, int]:
    raw = s.tobytes()
    return xxhash.xxh3_64_intdigest(raw) - (1 << 63), xxhash.xxh3_64_intdigest(raw, 1) - (1 << 63)


def minhash(s: np.ndarray) -> np.ndarray:
    """MinHash values (unsigned 32-bit) of a non-empty set."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 4096):
        np.minimum(low, (x[None, at : at + 4096] * A + B).min(1), out=low)
    return low


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For 16, 32, ... values compared, the fewest matches that are not pruned.

    With a uniform prior, P(similarity >= t | m of n) is the probability that a
    binomial of n + 1 trials at t is at most m.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        below, m = 0.0, -1
        while below < tolerance:
            m += 1
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def prune(sigs: np.ndarray, a: np.ndarray, b: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that no step drops."""
    matches = np.zeros(len(a), np.int32)
    for i, m in enumerate(least):
        part = sigs[:, i * STEP : (i + 1) * STEP]
        matches += (part[a] == part[b]).sum(1)
        ok = matches >= m
        a, b, matches = a[ok], b[ok], matches[ok]
        if not len(a):
            break
    return a, b


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each of n nodes' component."""
    root = np.arange(n)
    while len(a):
        m = np.minimum(root[a], root[b])
        old = root.copy()
        np.minimum.at(root, a, m)
        np.minimum.at(root, b, m)
        np.minimum.at(root, old[a], m)
        np.minimum.at(root, old[b], m)
        root = root[root]
        if (old == root).all():
            break
    return root


def tiles(left: np.ndarray, right: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of two sides, or within one, at most TILE members of either at once."""
    for s in range(0, len(left), TILE):
        a = left[s : s + TILE]
        for t in range(s if right is None else 0, len(left if right is None else right), TILE):
            x, y = np.meshgrid(a, (left if right is None else right)[t : t + TILE], indexing="ij")
            if right is None and s == t:
                x, y = x[np.triu_indices(len(a), 1)], y[np.triu_indices(len(a), 1)]
            yield x.ravel(), y.ravel()


def n_blocks(members: Column | int, shingles: Column | int = 0) -> Column:
    """Into how many blocks a group of so many members with so many shingles is cut."""
    n = F.lit(members) if isinstance(members, int) else members
    size = F.lit(shingles) if isinstance(shingles, int) else shingles
    return F.greatest(F.least(F.ceil(n / SMALL_BLOCK), F.lit(MOST_BLOCKS)), F.ceil(n / LARGE_BLOCK), F.ceil(size * 8 / BLOCK_BYTES)).cast("int")


def block_of(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("row"), blocks).cast("int")


def blocked(rows: DataFrame) -> DataFrame:
    """Give each row its block of ``blocks`` and a copy for every pair of blocks (i, j) it belongs to; one where the group is small."""
    rows = rows.select("*", block_of(F.col("blocks")).alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "blocks")


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Whole groups (rows equal on the first three columns, which stand together), several at a time."""
    rest: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        if rest is not None:
            t = pa.concat_tables([rest, t])
        keys = [t.column(c).to_numpy() for c in range(3)]
        n = t.num_rows
        if not n:
            continue
        new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        if not len(new):
            rest = t
            continue
        yield t.slice(0, int(new[-1])), np.concatenate([[0], new])
        rest = t.slice(int(new[-1]))
    if rest is not None and rest.num_rows:
        yield rest, np.array([0, rest.num_rows])


def clustered(rows: DataFrame, run: Callable, schema: str) -> DataFrame:
    """Rows of a group (key, i, j) next to each other in one task.

    Ranges of groups hold about as many rows each, which hashes of a few
    hundred groups would not.  ``rows`` is read twice for that, so it should
    start at stored tables.
    """
    return rows.repartitionByRange("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, schema)


def signatures_of(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, HASHES)


def forest(row: np.ndarray, kept: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """(u, v): a spanning forest of pairs of places in ``row``; a class in several buckets is one node."""
    names, node = np.unique(row, return_inverse=True)
    root = roots(len(names), node[np.concatenate([a for a, _ in kept])], node[np.concatenate([b for _, b in kept])])
    at = np.flatnonzero(root != np.arange(len(names)))
    return pa.RecordBatch.from_arrays([pa.array(names[at]), pa.array(names[root[at]])], names=["u", "v"])


def bucket_links(members: DataFrame, least: list[int]) -> DataFrame:
    """(u, v): a spanning forest of the pairs of each small bucket that pruning leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cuts in groups(batches):
            sigs = signatures_of(t.column("sig"))
            sizes, starts = np.diff(cuts), cuts[:-1]
            kept: list[tuple[np.ndarray, np.ndarray]] = []
            for m in np.unique(sizes).tolist():  # buckets of one size in one go
                x, y = np.triu_indices(m, 1)
                own = starts[sizes == m]
                step = max(1, PAIRS // max(1, len(x)))
                for at in range(0, len(own), step):
                    s = own[at : at + step, None]
                    kept.append(prune(sigs, (s + x).ravel(), (s + y).ravel(), least))
            yield forest(t.column("row").to_numpy(), kept)

    zero = F.lit(0)
    rows = members.select("key", zero.alias("i"), zero.alias("j"), "row", "sig")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "u long, v long")  # many small groups


def led(large: DataFrame, least: list[int]) -> DataFrame:
    """(key, row, sig, lead): members of large buckets that their leader does not tie, with their sig; those it ties without."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            sigs = np.concatenate([signatures_of(b.column("sig")), signatures_of(b.column("lead_sig"))])
            tied = np.zeros(n, bool)
            tied[prune(sigs, np.arange(n), np.arange(n) + n, least)[0]] = True
            rest = pc.if_else(pa.array(tied), pa.scalar(None, pa.binary()), b.column("sig"))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("row"), rest, b.column("lead")], names=["key", "row", "sig", "lead"])

    rows = large.filter("row <> lead").select("key", "row", "sig", "lead", "lead_sig")
    return rows.mapInArrow(run, "key long, row long, sig binary, lead long")


def cross_links(rest: DataFrame, large: DataFrame, least: list[int]) -> DataFrame:
    """(u, v): a spanning forest of what pruning leaves of the pairs of untied members with all members of their bucket."""
    sizes = rest.groupBy("key").agg(F.count("*").alias("n_rest"))
    left = rest.join(sizes.join(large.select("key", "size").distinct(), "key"), "key")
    i, j = n_blocks(F.col("n_rest")), n_blocks(F.col("size"))
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = left.select("key", block_of(i).alias("i"), each(j).alias("j"), "row", "sig", F.lit(True).alias("untied"))
    right = large.join(sizes, "key").select("key", each(i).alias("i"), block_of(j).alias("j"), "row", "sig", F.lit(False).alias("untied"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cuts in groups(batches):
            row, untied = t.column("row").to_numpy(), t.column("untied").to_numpy()
            sigs = signatures_of(t.column("sig"))
            kept: list[tuple[np.ndarray, np.ndarray]] = []
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                at = np.arange(s, e)
                kept += [prune(sigs, a, b, least) for a, b in tiles(at[untied[s:e]], at[~untied[s:e]])]
            if kept:
                yield forest(row, kept)

    return clustered(left.unionByName(right), run, "u long, v long")


def intersections(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of pairs of sets."""
    if len(a) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
    member = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = held[place] > 1
    member, place = member[shared], place[shared]
    _, place = np.unique(place, return_inverse=True)
    both = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(place, kind="stable")
    member, place = member[order], place[order]
    width = max(1, CELLS // len(sets))
    for at in range(0, int(place[-1]) + 1 if len(place) else 0, width):
        lo, hi = np.searchsorted(place, [at, at + width])
        x = np.zeros((len(sets), min(width, int(place[-1]) + 1 - at)), np.float32)
        x[member[lo:hi], place[lo:hi] - at] = 1
        both += x @ x.T  # whole numbers below 2**24 in each slice
    return np.rint(both[a, b]).astype(np.int64)


def family_links(members: DataFrame, least: list[int], threshold: float) -> DataFrame:
    """(row, root, links): verified links of each member in a pair of blocks, counting copies, and a way to its component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cuts in groups(batches):
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                g = t.slice(s, e - s)
                row, block, copies = (g.column(c).to_numpy() for c in ("row", "block", "copies"))
                i, j = g.column("i")[0].as_py(), g.column("j")[0].as_py()
                sigs = signatures_of(g.column("sig"))
                sets = [np.frombuffer(x, np.uint64) for x in g.column("shingles").to_pylist()]
                sizes = np.array([len(x) for x in sets])
                linked: list[tuple[np.ndarray, np.ndarray]] = []
                for a, b in tiles(np.arange(len(row))) if i == j else tiles(np.flatnonzero(block == i), np.flatnonzero(block == j)):
                    a, b = prune(sigs, a, b, least)
                    if not len(a):
                        continue
                    own, at = np.unique(np.concatenate([a, b]), return_inverse=True)
                    common = intersections([sets[x] for x in own.tolist()], at[: len(a)], at[len(a) :])
                    # In whole tenths of a thousand, so that a pair at the threshold is kept.
                    ok = common * 10_000 >= round(threshold * 10_000) * (sizes[a] + sizes[b] - common)
                    linked.append((a[ok], b[ok]))
                if not linked:
                    continue
                a, b = (np.concatenate([x[c] for x in linked]) for c in (0, 1))
                links = np.bincount(a, copies[b], len(row)) + np.bincount(b, copies[a], len(row))
                root = roots(len(row), a, b)
                at = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(row[at]), pa.array(row[root[at]]), pa.array(links[at].astype(np.int64))], names=["row", "root", "links"])
        give_back()

    return clustered(members, run, "row long, root long, links long")


def sketched(docs: DataFrame) -> DataFrame:
    """(row, doc_id, tx, s1, s2, n, sig, keys): two hashes of the set, its size, a byte of each MinHash value, a key for each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 3):
            s1, s2, size, sig, keys = [], [], [], [], []
            for text in b.column(3).to_pylist():
                s = shingles(text)
                if not len(s):
                    for c in (s1, s2, size, sig, keys):
                        c.append(None)
                    continue
                low = minhash(s)
                one, two = set_hashes(s)
                s1.append(one)
                s2.append(two)
                size.append(len(s))
                sig.append(low.astype(np.uint8).tobytes())
                band = low.astype(np.uint64).reshape(BANDS, -1)
                key = np.arange(1, BANDS + 1, dtype=np.uint64)
                for c in range(band.shape[1]):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + band[:, c])
                keys.append(key.astype(np.int64))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *[pa.array(c, t) for c, t in zip((s1, s2, size, sig, keys), types, strict=True)]], names=names)
        forget()

    names = ["row", "doc_id", "tx", "s1", "s2", "n", "sig", "keys"]
    return docs.mapInArrow(run, "row long, doc_id long, tx long, s1 long, s2 long, n long, sig binary, keys array<long>")


def with_shingles(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 0):
            sets = [shingles(t) for t in b.column(0).to_pylist()]
            s1, s2 = zip(*map(set_hashes, sets), strict=True) if sets else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["s1", "s2", "shingles"])
        forget()

    return texts.select("text").mapInArrow(run, "s1 long, s2 long, shingles binary")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per input row: doc_id, class_id, n_links, kept, text_hash.

    class_id is the smallest doc_id among all rows tied to this one by links, a
    link being a Jaccard similarity of at least ``threshold``; n_links is the
    number of other rows linked to this one.  One row of each class is kept,
    the first with its class_id.  Null and empty texts have no shingles: each
    is a class of its own with no links.  A null id ranks after all others.
    Repeated rows are copies of each other.  Texts are read whole, however long;
    a set has at most as many shingles as its text has words.  An empty table
    gives no rows.  Other columns are ignored.
    """
    bounded(docs.sparkSession)
    least = least_matches(threshold, tolerance)
    docs = columns(docs, doc_id=id_col, text=text_col)
    docs = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), text_hash(text_of()).alias("tx"), text_of().alias("text"))
    rows = stored(sketched(docs), "jaccard-rows")
    rank = F.coalesce("doc_id", F.lit(LAST_ID))
    classes = rows.filter("s1 is not null").groupBy("s1", "s2")
    classes = stored(classes.agg(F.min(F.struct(rank.alias("rank"), "row", "doc_id", "tx")).alias("best"), F.count("*").alias("copies")), "jaccard-classes")
    heads = classes.select(F.col("best.row").alias("row"), F.col("best.rank").alias("rank"), F.col("best.tx").alias("tx"), "copies")
    sketch = stored(rows.join(heads, ["row", "tx"]).select("row", "tx", "s1", "s2", "n", "copies", "sig", "keys"), "jaccard-heads")

    keys = sketch.select("row", F.explode("keys").alias("key"))
    sigs = sketch.select("row", "sig")
    shared = stored(keys.groupBy("key").agg(F.count("*").alias("size"), F.min("row").alias("lead")).filter("size > 1"), "jaccard-keys")
    many = F.col("size") > SMALL_BLOCK
    small = keys.join(shared.filter(~many).select("key"), "key").join(sigs, "row")
    leads = stored(shared.filter(many).join(sigs.withColumnsRenamed({"row": "lead", "sig": "lead_sig"}), "lead"), "jaccard-leads")
    large = stored(keys.join(leads, "key").join(sigs, "row"), "jaccard-large")
    after = stored(led(large, least), "jaccard-led")
    untied = after.filter("sig is not null").select("key", "row", "sig")
    by_lead = after.filter("sig is null").select(F.col("row").alias("u"), F.col("lead").alias("v"))
    pairs = bucket_links(small, least).unionByName(by_lead).unionByName(cross_links(untied, large.select("key", "size", "row", "sig"), least))
    tied = components(pairs)
    dropped(shared, leads, large, after)

    roots_too = tied.select(F.col("root").alias("row"), "root").unionByName(tied.select(F.col("u").alias("row"), "root")).distinct()
    family = stored(roots_too.join(sketch.drop("keys"), "row").withColumnRenamed("root", "key"), "jaccard-families")
    sizes = family.groupBy("key").agg(n_blocks(F.count("*"), F.sum("n")).alias("blocks"))
    wanted = family.select("tx").distinct()
    if family.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    # Of copies of a text one is read; texts that only share its hash have other sets and find no member.
    texts = docs.join(wanted, "tx", "left_semi").groupBy("tx", F.xxhash64(F.lit("second"), "text")).agg(F.first("text").alias("text"))
    members = stored(family.join(sizes, "key").join(with_shingles(texts), ["s1", "s2"]), "jaccard-members")
    placed = blocked(members).select("key", "i", "j", "row", "block", "copies", "sig", "shingles")
    found = stored(family_links(placed, least, threshold), "jaccard-links")
    dropped(family, members, tied)
    linked = components(found.select(F.col("row").alias("u"), F.col("root").alias("v")))
    counts = found.groupBy("row").agg(F.sum("links").alias("links"))

    named = heads.join(linked.withColumnRenamed("u", "row"), "row", "left").join(counts, "row", "left")
    named = named.withColumn("root", F.coalesce("root", "row"))
    first = named.groupBy("root").agg(F.min(F.struct("rank", "row")).alias("first"))
    named = named.join(first, "root").select("row", F.coalesce("links", F.lit(0)).alias("links"), "first")
    info = classes.select("s1", "s2", "copies", F.col("best.row").alias("row")).join(named, "row")
    info = stored(info.select("s1", "s2", "copies", "links", "first"), "jaccard-info")
    dropped(classes, sketch, found, linked)
    out = rows.select("row", "doc_id", "tx", "s1", "s2").join(info, ["s1", "s2"], "left")
    alone = F.col("first").isNull()
    class_id = F.when(F.col("first.rank") == LAST_ID, F.lit(None)).otherwise(F.col("first.rank"))
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(class_id).alias("class_id"),
        F.coalesce(F.col("copies") - 1 + F.col("links"), F.lit(0)).cast("long").alias("n_links"),
        (alone | (F.col("row") == F.col("first.row"))).alias("kept"),
        F.col("tx").alias("text_hash"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(scan(spark, sf_dir, "doc_id", "text")).drop("text_hash")


ORACLE = None  # MinHash and posterior pruning: held against all pairs in tests/llm
