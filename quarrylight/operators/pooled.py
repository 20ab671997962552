"""Fused rankings of whole pools, a query at a time inside tasks: scores of a pool are arrays there, never rows.

Only what a caller asks for leaves a task, the first k of each query or all.
A task holds one query's pool (``fused``) or the pool of one label (``ranked``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fusion import RRF_K, WEIGHTS
from .index import Corpus, bm25_term

CHUNK = 1_000  # queries of one label that a task ranks together
LAST = (1 << 63) - 1  # stands for a null id, which comes last
RRF_ROWS = ["lexical", "phrase"]  # rankers whose scores come as rows


def places(score: np.ndarray) -> np.ndarray:
    """1 to n by falling score; equal ones keep their order, which is that of ids."""
    rank = np.empty(len(score), np.int64)
    rank[np.argsort(-score, kind="stable")] = np.arange(1, len(score) + 1)
    return rank


def reciprocal(scores: dict[str, np.ndarray], weights: dict[str, float], ranks: dict[str, np.ndarray], k: float = RRF_K) -> np.ndarray:
    """The fused score of each document; ``ranks`` keeps a query's ranks for further weights."""
    total = np.zeros(len(next(iter(scores.values()))))
    for ranker, score in scores.items():
        if weights.get(ranker) and len(score) and np.abs(score).max() > 0:
            if ranker not in ranks:
                ranks[ranker] = places(score)
            total += weights[ranker] / (k + ranks[ranker])
    return total


def first(ids: np.ndarray, total: np.ndarray, k: int | None, decimals: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores, the k best in order or all; rows of one id, which are neighbours, count together."""
    starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, np.int64)
    if len(starts) < len(ids):
        ids, total = ids[starts], np.add.reduceat(total, starts)
    total = np.round(total, decimals)
    order = np.argsort(-total, kind="stable")[:k]
    return ids[order], total[order]


def ids_of(column: pa.ChunkedArray) -> np.ndarray:
    return pc.fill_null(column.cast(pa.int64()), LAST).to_numpy()


def table(names: list[str], kinds: pa.Schema, keys: list, found: list[tuple[str, np.ndarray, np.ndarray]]) -> pa.Table:
    """A row for each ranked document of (query, point)."""
    n = [len(ids) for _, ids, _ in found]
    at = pa.array(np.repeat(np.arange(len(n)), n))
    ids = np.concatenate([ids for _, ids, _ in found]) if found else np.zeros(0, np.int64)
    rank = np.concatenate([np.arange(1, m + 1) for m in n]) if found else np.zeros(0, np.int64)
    score = np.concatenate([s for *_, s in found]) if found else np.zeros(0)
    cols = [pa.array([p for p, *_ in found], pa.string()).take(at), pa.array(keys, kinds.field("query_id").type).take(at), pa.array(ids, mask=ids == LAST), pa.array(score), pa.array(rank)]
    return pa.Table.from_arrays(cols, names=names)


def shape(queries: DataFrame) -> str:
    return f"point string, query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id long, score double, rank long"


NAMES = ["point", "query_id", "doc_id", "score", "rank"]


def fused(pool: DataFrame, found: DataFrame, points: dict[str, dict[str, float]] | None = None, k: int | None = None) -> DataFrame:
    """(point, query_id, doc_id, score, rank) of every named point of weights: reciprocal rank fusion over each query's pool.

    ``pool`` has query_id, doc_id and the category ranker's score, a row for
    each document of the pool; ``found`` has query_id, ranker, doc_id and the
    score of other rankers, zero where a row is missing; rows from outside of the
    pool do not count.  Scores have 12 decimals, ties go to the smaller id.
    """
    points = points or {"": WEIGHTS}

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        key = left.column("query_id")[:1] if left.num_rows else right.column("query_id")[:1]
        ids, category = ids_of(left.column("doc_id")), left.column("score").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, category = ids[order], category[order]
        scores = {r: np.zeros(len(ids)) for r in RRF_ROWS}
        names, docs, values = right.column("ranker"), ids_of(right.column("doc_id")), right.column("score").to_numpy()
        for ranker, score in scores.items():
            own = pc.fill_null(pc.equal(names, ranker), False).to_numpy()
            doc, value = docs[own], values[own]
            by = np.argsort(doc, kind="stable")
            doc, value = doc[by], value[by]
            if len(doc):
                at = np.minimum(np.searchsorted(doc, ids), len(doc) - 1)
                hit = (doc[at] == ids) & (ids != LAST)
                score[hit] = value[at[hit]]
        scores["category"] = category
        ranks: dict[str, np.ndarray] = {}
        out = [(name, *first(ids, reciprocal(scores, w, ranks), k, 12)) for name, w in points.items()]
        return table(NAMES, left.schema, key.to_pylist() * len(out), out)

    rows = pool.select("query_id", "doc_id", "score").groupBy("query_id").cogroup(found.select("query_id", "ranker", "doc_id", "score").groupBy("query_id"))
    return rows.applyInArrow(run, shape(pool))



def cards(docs: DataFrame, corpus: Corpus) -> DataFrame:
    """(doc_id, terms, parts, category_text, body): documents with the BM25 parts of their terms, which a query's factors multiply."""
    part = bm25_term(F.lit(1.0), F.col("tf"), F.col("len"), F.col("avg_len"))
    # One row of statistics.
    rows = corpus.postings.crossJoin(F.broadcast(corpus.stats.select("avg_len"))).select("doc_id", F.struct("term", part.alias("part")).alias("t"))
    terms = rows.groupBy("doc_id").agg(F.collect_list("t").alias("t"))
    out = docs.select("doc_id", "category_text", "body").join(terms, "doc_id", "left")
    return out.select("doc_id", F.col("t.term").alias("terms"), F.col("t.part").alias("parts"), "category_text", "body")


class Pool:
    """The documents of one pool as arrays, in the order of ids."""

    def __init__(self, rows: pa.Table):
        ids = ids_of(rows.column("doc_id"))
        order = np.argsort(ids, kind="stable")
        rows, self.ids = rows.take(pa.array(order)).combine_chunks(), ids[order]
        n = len(ids)
        lengths = pc.fill_null(pc.list_value_length(rows.column("terms")), 0).to_numpy()
        flat = pc.list_flatten(rows.column("terms")).combine_chunks().dictionary_encode()
        code, part = flat.indices.to_numpy(), pc.list_flatten(rows.column("parts")).to_numpy()
        by = np.argsort(code, kind="stable")
        self.rows, self.part = np.repeat(np.arange(n), lengths)[by], part[by]
        cuts = np.searchsorted(code[by], np.arange(len(flat.dictionary) + 1))
        self.terms = {t: slice(a, b) for t, a, b in zip(flat.dictionary.to_pylist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)}
        texts = pc.fill_null(rows.column("category_text"), "").combine_chunks().dictionary_encode()
        self.text_of, self.texts = texts.indices.to_numpy(), texts.dictionary.to_pylist()
        bodies = [b or "" for b in rows.column("body").to_pylist()]
        self.body = "\n".join(bodies)  # normalised texts hold no line end
        self.starts = np.cumsum([0, *(len(b) + 1 for b in bodies)])[:-1]
        self.in_texts: dict[str, np.ndarray] = {}
        self.in_bodies: dict[str, np.ndarray] = {}

    def holding(self, phrase: str) -> np.ndarray:
        """Places of documents that contain the phrase."""
        if phrase not in self.in_bodies:
            hits, at = [], self.body.find(phrase) if "\n" not in phrase else -1
            while at >= 0:
                hits.append(row := int(np.searchsorted(self.starts, at, "right")) - 1)
                at = self.body.find(phrase, int(self.starts[row + 1])) if row + 1 < len(self.starts) else -1
            self.in_bodies[phrase] = np.array(hits, np.int64)
        return self.in_bodies[phrase]

    def scores(self, terms: list[dict], phrases: list[dict]) -> dict[str, np.ndarray]:
        n = len(self.ids)
        lexical, phrase, text = np.zeros(n), np.zeros(n), np.zeros(len(self.texts))
        for t in terms:
            own = self.terms.get(t["term"])
            if own is not None:
                lexical[self.rows[own]] += t["factor"] * self.part[own]
            if t["term"] not in self.in_texts:
                self.in_texts[t["term"]] = np.array([t["term"] in x for x in self.texts], float)
            text += t["idf"] * self.in_texts[t["term"]]
        for p in phrases:
            phrase[self.holding(p["phrase"])] += p["rarity"]
        return {"lexical": np.round(lexical, 6), "phrase": np.round(phrase, 6), "category": np.round(text, 6)[self.text_of]}


def ranked(queries: DataFrame, pools: DataFrame, points: dict[str, dict[str, float]], k: int, phrase_weight: float | None = None) -> DataFrame:
    """(point, query_id, doc_id, score, rank): the first k of each query over the pool of its label, for every named point of weights.

    ``queries`` has pool, chunk, query_id, terms (term, factor, idf) and phrases
    (phrase, rarity); ``pools`` has pool, chunk and the columns of ``cards``.
    With ``phrase_weight`` scores are lexical ones plus weighted phrase
    evidence, without fusion.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        pool, out, keys = Pool(right), [], []
        for query_id, terms, phrases in zip(*(left.column(c).to_pylist() for c in ("query_id", "terms", "phrases")), strict=True):
            scores, ranks = pool.scores(terms or [], phrases or []), {}
            for name, weights in points.items():
                if phrase_weight is None:
                    best = first(pool.ids, reciprocal(scores, weights, ranks), k, 12)
                else:
                    best = first(pool.ids, scores["lexical"] + phrase_weight * scores["phrase"], k, 6)
                out.append((name, *best))
                keys.append(query_id)
        return table(NAMES, left.schema, keys, out)

    rows = queries.select("pool", "chunk", "query_id", "terms", "phrases").groupBy("pool", "chunk")
    return rows.cogroup(pools.select("pool", "chunk", "doc_id", "terms", "parts", "category_text", "body").groupBy("pool", "chunk")).applyInArrow(run, shape(queries))


def pool_name(label: Column) -> Column:
    """A label's pool; no label has one, too."""
    return F.coalesce(F.concat(F.lit("="), label), F.lit(""))
