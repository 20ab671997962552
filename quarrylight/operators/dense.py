"""Dense vectors: TF-IDF with singular value decomposition, or any encoder in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..storage import dropped, stored

# The axes are a matrix of features x dims on the driver and in each worker: 40 MB at these limits, which are parameters.
MIN_DF, MAX_FEATURES, DIMS = 2, 20_000, 256
EXTRA, ROUNDS = 10, 4  # further columns of the random basis, and its multiplications
ENTRIES = 20_000  # entries of the sparse matrix worked on at once
FEATURES = 1024  # features of a block of the product


def grams(text: Column) -> Column:
    """Words and pairs of neighbouring words, accents stripped by the tokeniser's own split."""
    words = tokens(text)
    n = F.size(words)
    # Shifted copies, since a lambda over places would find the words anew for each.
    pairs = F.zip_with(F.slice(words, F.lit(1), n - 1), F.slice(words, F.lit(2), n - 1), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, F.when(n > 1, pairs).otherwise(F.array().cast("array<string>")))


@dataclass(frozen=True)
class Space:
    """terms: (term, at, idf), at most ``features`` rows; axes: features x dims on the driver, bounded by both limits."""

    terms: DataFrame
    axes: np.ndarray


def weighted(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, at, w): sublinear tf times idf of the terms that the space knows."""
    counts = docs.select("doc_id", F.explode(grams(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    return counts.join(terms, "term").select("doc_id", "at", ((1 + F.log("n")) * F.col("idf")).alias("w"))


def rows_of(weights: DataFrame) -> DataFrame:
    """(doc_id, items): a document's weights, sorted by place."""
    return weights.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("at", "w"))).alias("items"))


def gram_times(rows: DataFrame, q: np.ndarray) -> np.ndarray:
    """AᵀA q for the sparse rows A: executors add up what they read, in blocks of features; the driver gets one matrix of q's size."""
    width, cols = q.shape
    shared = rows.sparkSession.sparkContext.broadcast(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, basis = np.zeros((width, cols)), shared.value
        for b in batches:
            items = b.column(0)
            ends = np.cumsum(pc.list_value_length(items).to_numpy(zero_copy_only=False), dtype=np.int64)
            flat = items.flatten()
            at, w = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            first = 0
            while first < len(ends):
                lo = int(ends[first - 1]) if first else 0
                last = max(first + 1, int(np.searchsorted(ends, lo + ENTRIES, "right")))
                hi = int(ends[last - 1])
                a, x = at[lo:hi], w[lo:hi, None]
                sizes = np.diff(ends[first:last], prepend=lo)
                row = np.repeat(np.arange(len(sizes)), sizes)
                projected = np.zeros((len(sizes), cols))
                full = np.flatnonzero(sizes)
                if len(full):
                    projected[full] = np.add.reduceat(basis[a] * x, (np.cumsum(sizes) - sizes)[full])
                    order = np.argsort(a, kind="stable")
                    names, starts = np.unique(a[order], return_index=True)
                    total[names] += np.add.reduceat((x * projected[row])[order], starts)
                first = last
        for s in range(0, width, FEATURES):
            yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([total[s : s + FEATURES].tobytes()])], names=["start", "part"])

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x) for x in pdf["part"])
        return pd.DataFrame({"start": [pdf["start"].iloc[0]], "part": [total.tobytes()]})

    parts = rows.select("items").mapInArrow(run, "start long, part binary").groupBy("start").applyInPandas(added, "start long, part binary")
    got = sorted(parts.collect(), key=lambda r: r.start)
    shared.destroy()
    return np.concatenate([np.frombuffer(r.part).reshape(-1, cols) for r in got]) if got else np.zeros((width, cols))


def fit(docs: DataFrame, dims: int = DIMS, min_df: int = MIN_DF, features: int = MAX_FEATURES, rounds: int = ROUNDS, seed: int = 0) -> Space:
    """The space of (doc_id, text): terms in at least ``min_df`` documents, the most frequent first, and their singular axes.

    A randomised decomposition: a random basis is multiplied by AᵀA ``rounds``
    times in blocks, one job each, and turned to the axes at the end.
    """
    n = docs.count()
    df = docs.select("doc_id", F.explode(F.array_distinct(grams(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    best = df.filter(F.col("df") >= min_df).orderBy(F.desc("df"), "term").limit(features)
    place = F.row_number().over(Window.orderBy(F.desc("df"), "term")) - 1  # at most ``features`` rows
    terms = stored(best.select("term", place.alias("at"), (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf")), "dense-terms")
    width = terms.count()
    if not width:
        return Space(terms, np.zeros((0, dims)))
    rows = stored(rows_of(weighted(docs, terms)), "dense-rows")
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, min(dims + EXTRA, width))))[0]
    for _ in range(rounds):
        basis = np.linalg.qr(gram_times(rows, basis))[0]
    values, turn = np.linalg.eigh(basis.T @ gram_times(rows, basis))
    dropped(rows)
    axes = basis @ turn[:, np.argsort(-values)[: min(dims, width)]]
    # The sign of an axis is arbitrary; its largest entry is made positive.
    axes *= np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    return Space(terms, axes)


def project(docs: DataFrame, space: Space) -> DataFrame:
    """(doc_id, vector): unit rows; a text without known terms has a zero vector, which scores zero everywhere."""
    axes = docs.sparkSession.sparkContext.broadcast(space.axes)
    dims = space.axes.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for items in pdf["items"]:
                v = np.zeros(dims)
                if items is not None and len(items):
                    v = np.array([x["w"] for x in items]) @ axes.value[[x["at"] for x in items]]
                size = np.linalg.norm(v)
                out.append(v / size if size > 0 else v)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "vector": out})

    rows = docs.select("doc_id").join(rows_of(weighted(docs, space.terms)), "doc_id", "left")
    return rows.mapInPandas(run, "doc_id long, vector array<double>")


def encode(docs: DataFrame, encoder: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """(doc_id, vector) from an encoder of texts, its rows scaled to length one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            v = np.asarray(encoder(pdf["text"].fillna("").tolist()), float)
            size = np.linalg.norm(v, axis=1, keepdims=True)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "vector": list(np.divide(v, size, out=np.zeros_like(v), where=size > 0))})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, vector array<double>")
