"""Field-weighted inverted index: postings, term, document and corpus statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_token, tokens, words
from ..storage import dropped, stored
from .sizes import small

# Field weights and BM25 parameters.
FIELD_WEIGHTS = {"title": 3.0, "categories": 2.0, "features": 2.5, "details": 2.5, "store": 1.5, "description": 1.0}
K1, B = 1.2, 0.6


def field_words(docs: DataFrame, fields: dict[str, float], doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, term, w): a row for each word of each field; term is null and w 0 where it does not count, and each document has a row."""
    if len(fields) == 1:
        (name, weight), = fields.items()
        rows = docs.select(F.col(doc_id).alias("doc_id"), F.explode_outer(words(F.col(name))).alias("term"), F.lit(float(weight)).alias("w"))
    else:
        each = F.array(*[F.struct(F.col(f).alias("text"), F.lit(float(w)).alias("w")) for f, w in fields.items()])
        rows = docs.select(F.col(doc_id).alias("doc_id"), F.explode(each).alias("f"))
        rows = rows.select("doc_id", F.explode_outer(words(F.col("f.text"))).alias("term"), F.col("f.w").alias("w"))
    good = F.coalesce(is_token(F.col("term")), F.lit(False))
    return rows.select("doc_id", F.when(good, F.col("term")).alias("term"), F.when(good, F.col("w")).otherwise(0.0).alias("w"))


def field_terms(docs: DataFrame, fields: dict[str, float], doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, term, w): a row for each token of each field."""
    return field_words(docs, fields, doc_id).filter("term is not null")


def postings(terms: DataFrame) -> DataFrame:
    """(term, doc_id, tf): weights summed, partly before the shuffle."""
    return terms.groupBy("term", "doc_id").agg(F.sum("w").alias("tf"))


@dataclass(frozen=True)
class Corpus:
    """What one pass over a corpus leaves, stored; all rankers read it."""

    postings: DataFrame  # term, doc_id, tf, len, and the column that was asked for
    stats: DataFrame  # one row
    idf: DataFrame  # term, idf: at most the vocabulary asked for


def corpus(docs: DataFrame, fields: dict[str, float], vocabulary: DataFrame | None = None, same: str | None = None) -> Corpus:
    """Index a corpus in one pass, for the terms of ``vocabulary`` (term) or for all; ``same`` names a column that postings carry.

    Words that nobody asks for count towards a document's length and are summed
    up where they are read, so what is shuffled has a row for each document and
    asked term, and one more for each document.
    """
    rows = field_words(docs, fields)
    if vocabulary is not None:
        asked = small(vocabulary.select("term").distinct().withColumn("asked", F.lit(True)))
        rows = rows.join(asked, "term", "left").select("doc_id", F.when(F.col("asked"), F.col("term")).alias("term"), "w")
    counted = stored(rows.groupBy("doc_id", "term").agg(F.sum("w").alias("tf")), "corpus-counts")
    lengths = stored(counted.groupBy("doc_id").agg(F.sum("tf").alias("len")), "corpus-lengths")
    stats = stored(corpus_stats(lengths), "corpus-stats")
    post = counted.filter("term is not null")
    idf_ = stored(term_stats(post, stats).select("term", "idf"), "corpus-idf")
    carried = lengths.join(docs.select("doc_id", same).distinct(), "doc_id") if same else lengths
    post = stored(post.join(carried, "doc_id").select("term", "doc_id", "tf", "len", *([same] if same else [])), "corpus-postings")
    dropped(counted, lengths)
    return Corpus(post, stats, idf_)


def doc_length(fields: dict[str, float]) -> Column:
    """The weighted number of tokens; no shuffle."""
    total = F.lit(0.0)
    for f, w in fields.items():
        total = total + F.coalesce(F.size(tokens(F.coalesce(F.col(f), F.lit("")))), F.lit(0)) * w
    return total


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: number of documents, mean length over all of them, 1 if that is zero."""
    mean = F.avg("len")
    return lengths.agg(F.count("*").alias("n_docs"), F.when(mean > 0, mean).otherwise(1.0).alias("avg_len"))


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def term_stats(post: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df, idf)."""
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    # stats has one row.
    return df.crossJoin(F.broadcast(stats.select("n_docs"))).select("term", "df", idf(F.col("n_docs"), F.col("df")).alias("idf"))


def bm25_term(factor: Column, tf: Column, length: Column, mean: Column) -> Column:
    """One term's share of a score; ``factor`` is its weight times its idf."""
    return factor * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
