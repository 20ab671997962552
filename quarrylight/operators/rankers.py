"""Rankers. Each gives (query_id, doc_id, score); a pool restricts what is scored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, normalise, tokens
from ..functions.turns import phrase_eligible
from ..storage import stored
from . import index
from .sizes import small

BLOCK = 4096  # vectors of a block


def query_terms(queries: DataFrame, text: str = "text", weight: Column | None = None) -> DataFrame:
    """(query_id, term, weight): repeated terms add up; unknown and weightless ones go when joined."""
    rows = queries.select("query_id", F.explode(tokens(F.col(text))).alias("term"), (weight if weight is not None else F.lit(1.0)).alias("w"))
    return rows.groupBy("query_id", "term").agg(F.sum("w").alias("weight")).filter("weight > 0")


def bm25(terms: DataFrame, corpus: index.Corpus, pool: DataFrame | None = None, same: str | None = None) -> DataFrame:
    """BM25 of documents for weighted query terms, rounded to 6 decimals.

    The pool (query_id, doc_id), if given, is applied before scores are summed.
    With ``same``, a column of the terms and postings, only equal values meet.
    """
    by = ["term", *([same] if same else [])]
    asked = terms.join(corpus.idf, "term").select("query_id", *by, (F.col("weight") * F.col("idf")).alias("factor"))
    rows = corpus.postings.join(small(asked), by)
    if pool is not None:
        rows = rows.join(pool.select("query_id", "doc_id"), ["query_id", "doc_id"])
    rows = rows.crossJoin(F.broadcast(corpus.stats.select("avg_len")))  # one row
    part = index.bm25_term(F.col("factor"), F.col("tf"), F.col("len"), F.col("avg_len"))
    return rows.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))


def category_affinity(terms: DataFrame, term_idf: DataFrame, pool: DataFrame) -> DataFrame:
    """Sum of idf over distinct query terms that occur anywhere in the document's category text.

    ``pool`` has query_id, doc_id and category_text.  A text is scored once for
    a query, however many documents have it.
    """
    known = terms.select("query_id", "term").distinct().join(term_idf, "term")
    texts = pool.select("query_id", "category_text").distinct()
    hits = texts.join(small(known), "query_id").filter(F.contains("category_text", "term"))
    scores = stored(hits.groupBy("query_id", "category_text").agg(F.round(F.sum("idf"), 6).alias("score")), "affinity")
    rows = pool.join(small(scores), ["query_id", "category_text"], "left")
    return rows.select("query_id", "doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def phrase_rarity(phrases: DataFrame, term_idf: DataFrame) -> DataFrame:
    """(query_id, phrase, rarity): mean idf of the phrase's tokens over 10, between 0.05 and 1; ineligible phrases go."""
    rows = phrases.select("query_id", normalise(F.col("phrase")).alias("phrase")).distinct().filter(phrase_eligible(F.col("phrase")))
    each = rows.select("query_id", "phrase", F.explode(tokens(F.col("phrase"))).alias("term"))
    scored = each.join(term_idf, "term", "left").groupBy("query_id", "phrase").agg(F.avg(F.coalesce("idf", F.lit(0.0))).alias("mean"))
    return scored.select("query_id", "phrase", F.least(F.greatest(F.col("mean") / 10, F.lit(0.05)), F.lit(1.0)).alias("rarity"))


def phrase_keys(rarity: DataFrame, term_idf: DataFrame) -> DataFrame:
    """Add key: the rarest token with other characters on both sides in the phrase, null if there is none.

    Such a token is a whole token of any document that contains the phrase, so
    its postings name all of them.  One that the corpus lacks is the rarest.
    """
    inner = F.regexp_extract_all("phrase", F.lit("(?<=[^a-z0-9])[a-z0-9]{2,}(?=[^a-z0-9])"), F.lit(0))
    each = rarity.select("query_id", "phrase", F.explode(inner).alias("term")).filter(~F.col("term").isin(STOPWORDS))
    rank = F.struct(F.coalesce("idf", F.lit(1e9)), "term")
    best = each.join(term_idf, "term", "left").groupBy("query_id", "phrase").agg(F.max_by("term", rank).alias("key"))
    return rarity.join(best, ["query_id", "phrase"], "left")


def phrase_evidence(rarity: DataFrame, corpus: index.Corpus, docs: DataFrame, text: str = "text", pool: DataFrame | None = None) -> DataFrame:
    """Sum of rarity over the phrases that a document contains; only documents with one appear.

    Postings of a phrase's rarest inner token name the documents to look into,
    and a document's text is read once for all phrases it may contain.  Phrases
    without an inner token are looked for in every document of their pool.
    """
    keyed = stored(phrase_keys(rarity, corpus.idf), "phrases")
    named = corpus.postings.select(F.col("term").alias("key"), "doc_id").join(small(keyed.filter("key is not null")), "key")
    if pool is not None:
        named = named.join(pool.select("query_id", "doc_id"), ["query_id", "doc_id"])
    named = stored(named.select("doc_id", "query_id", "phrase", "rarity"), "phrase-candidates")
    own = docs.select("doc_id", text).join(small(named.select("doc_id").distinct()), "doc_id", "left_semi")
    body = own.select("doc_id", normalise(F.col(text)).alias("body"))
    hits = body.join(small(named, 20_000), "doc_id").filter(F.contains("body", "phrase")).select("query_id", "doc_id", "rarity")
    bare = keyed.filter("key is null").drop("key")
    if bare.head(1):
        body = docs.select("doc_id", normalise(F.col(text)).alias("body"))
        if pool is None:
            rest = body.join(small(bare), F.contains("body", "phrase"))
        else:
            rest = pool.select("query_id", "doc_id").join(small(bare), "query_id").join(body, "doc_id").filter(F.contains("body", "phrase"))
        hits = hits.unionByName(rest.select("query_id", "doc_id", "rarity"))
    return hits.groupBy("query_id", "doc_id").agg(F.round(F.sum("rarity"), 6).alias("score"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; zero where one is null, empty or all zeros."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when(norm > 0, dot(a, b) / norm), F.lit(0.0))


def dense(queries: DataFrame, pool: DataFrame) -> DataFrame:
    """Cosine of each query's vector with the vectors of its pool (query_id, doc_id, vector); none of its own: zero."""
    rows = pool.join(queries.select("query_id", F.col("vector").alias("own")), "query_id", "left")
    return rows.select("query_id", "doc_id", F.round(cosine(F.col("own"), F.col("vector")), 6).alias("score"))


def vector_blocks(df: DataFrame, id_col: str, same: str | None = None) -> DataFrame:
    """(same, dims, ids, unit): up to BLOCK vectors of one length and one ``same`` value as a matrix of unit rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors, ids = b.column(1), b.column(0).to_numpy()
            dims = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
            key = b.column(2).dictionary_encode() if b.num_columns > 2 else None
            group = np.zeros(len(ids), np.int64) if key is None else pc.fill_null(key.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            for g, d in sorted(set(zip(group.tolist(), dims.tolist(), strict=True))):
                at = np.flatnonzero((group == g) & (dims == d))
                for s in range(0, len(at), BLOCK):
                    part = at[s : s + BLOCK]
                    flat = pc.list_flatten(vectors.take(pa.array(part))).to_numpy(zero_copy_only=False).astype(np.float64)
                    m = flat.reshape(len(part), d)
                    m = np.where(np.isnan(m).any(1, keepdims=True), 0.0, m)
                    norm = np.sqrt((m * m).sum(1, keepdims=True))
                    m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
                    value = [None if g < 0 else key.dictionary[g].as_py()] if key is not None else []
                    cols = [pa.array([int(d)], pa.int32()), pa.array([ids[part].astype("<i8").tobytes()]), pa.array([m.tobytes()])]
                    yield pa.RecordBatch.from_arrays([*[pa.array(value, b.column(2).type) for _ in value], *cols], names=names)

    rows = df.select(F.col(id_col).cast("long").alias("id"), "vector", *([same] if same else [])).filter("id is not null")
    names = [*([same] if same else []), "dims", "ids", "unit"]
    head = f"{same} {rows.schema[same].dataType.simpleString()}, " if same else ""
    return rows.mapInArrow(run, f"{head}dims int, ids binary, unit binary")


def dense_topk(queries: DataFrame, docs: DataFrame, k: int, same: str | None = None) -> DataFrame:
    """Cosines of the k nearest of each query (query_id, vector) in each block of documents (doc_id, vector), a superset of its k nearest.

    A stated set of queries against all rows, in blocks: a task multiplies a
    block of queries with a block of documents and keeps k for each query, ties
    by rising doc_id.  With ``same``, only blocks of an equal value meet.
    Vectors of other lengths, null and zero ones score zero.
    """
    left = vector_blocks(docs, "doc_id", same).withColumnsRenamed({"dims": "d", "ids": "doc_ids", "unit": "docs"})
    right = stored(vector_blocks(queries, "query_id", same).withColumnsRenamed({"dims": "q", "ids": "query_ids", "unit": "queries"}), "query-blocks")
    few = right.count() * BLOCK * 8 * 1024 <= 1 << 28  # blocks of queries that may be broadcast, at 1,024 dimensions
    right = F.broadcast(right) if few else right
    pairs = left.join(right, same) if same else left.crossJoin(right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, q, doc_ids, query_ids, x, y in zip(*(b.column(c).to_pylist() for c in range(6)), strict=True):
                doc, query = np.frombuffer(doc_ids, "<i8"), np.frombuffer(query_ids, "<i8")
                x, y = np.frombuffer(x).reshape(len(doc), d), np.frombuffer(y).reshape(len(query), q)
                for s in range(0, len(query), 512):
                    score = np.round(y[s : s + 512] @ x.T, 6) + 0.0 if d == q else np.zeros((len(query[s : s + 512]), len(doc)))
                    least = np.partition(score, max(0, len(doc) - k), axis=1)[:, max(0, len(doc) - k)]
                    row, col = np.nonzero(score >= least[:, None])
                    value = score[row, col]
                    by = np.lexsort((doc[col], -value, row))
                    row, col, value = row[by], col[by], value[by]
                    first = np.searchsorted(row, row)  # where each query's rows begin
                    keep = np.arange(len(row)) - first < k
                    yield pa.RecordBatch.from_arrays([pa.array(query[s : s + 512][row[keep]]), pa.array(doc[col[keep]]), pa.array(value[keep])], names=["query_id", "doc_id", "score"])

    return pairs.select("d", "q", "doc_ids", "query_ids", "docs", "queries").mapInArrow(run, "query_id long, doc_id long, score double")


def decayed(weight: Column, age: Column, revoked: Column, slot_decay: float = 1.0, override_penalty: float = 1.0) -> Column:
    """A constraint's weight by its age in turns and whether it was revoked."""
    return weight * F.pow(F.lit(float(slot_decay)), F.greatest(age, F.lit(0))) * F.when(revoked, float(override_penalty)).otherwise(1.0)
