"""Ranks, reciprocal rank fusion and top-k over long (query_id, ranker, doc_id, score) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from .sizes import small

# The constant of reciprocal rank fusion and the rankers' weights.
RRF_K = 60.0
WEIGHTS = {"lexical": 1.0, "category": 0.4, "phrase": 1.0, "dense": 0.0}


def places(df: DataFrame, by: list[str], order: list[Column | str], name: str = "rank", **largest: Column) -> DataFrame:
    """Add ``name``, 1 to n in the order of ``order`` within each group of equal ``by`` columns, however large a group is.

    One range shuffle by group and order deals a large group to many tasks.
    The sorted rows are stored; what a partition holds of a group is a segment,
    and sums over the segments before it (groups and partitions in number) make
    places global.  ``largest`` adds the maximum of expressions over each group.
    """
    kept = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("at_", F.monotonically_increasing_id())
    kept = stored(kept, "places").withColumn("part_", F.shiftrightunsigned("at_", 33))
    own = {f"by{i}_": F.col(c) for i, c in enumerate(by)}
    segments = kept.groupBy(*[c.alias(n) for n, c in own.items()], F.col("part_").alias("segment_"))
    segments = segments.agg(F.min("at_").alias("first_"), F.count("*").alias("n_"), *[F.max(c).alias(n) for n, c in largest.items()])
    group = Window.partitionBy(*own)
    before = F.sum("n_").over(group.orderBy("segment_").rowsBetween(Window.unboundedPreceding, -1))
    segments = segments.withColumns({"before_": F.coalesce(before, F.lit(0)), **{n: F.max(n).over(group) for n in largest}})
    segments = stored(segments.drop("n_"), "segments")
    same = F.col("part_") == F.col("segment_")
    for n, c in own.items():
        same = same & c.eqNullSafe(F.col(n))
    out = kept.join(small(segments), same)
    return out.withColumn(name, F.col("before_") + F.col("at_") - F.col("first_") + 1).drop("at_", "part_", "segment_", "first_", "before_", *own)


def rank_positions(scores: DataFrame) -> DataFrame:
    """Add rank, 1 to n by falling score, ties by rising doc_id, for every row of every query."""
    return places(scores, ["query_id"], [F.desc("score"), F.asc("doc_id")])


def over_pool(pool: DataFrame, scores: DataFrame, ranker: str) -> DataFrame:
    """A score for every document of the pool, zero where the ranker has none: those have ranks, too."""
    rows = pool.select("query_id", "doc_id").join(scores, ["query_id", "doc_id"], "left")
    return rows.select("query_id", F.lit(ranker).alias("ranker"), "doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def ranks(scores: DataFrame) -> DataFrame:
    """Add rank, the place within query and ranker, and signal, the largest absolute score there."""
    return places(scores, ["query_id", "ranker"], [F.desc("score"), F.asc("doc_id")], signal=F.abs("score"))


def fused(ranked: DataFrame, weights: dict[str, float] | Column | None = None, k: float = RRF_K, by: list[str] | None = None) -> DataFrame:
    """(query_id, doc_id, score), to 12 decimals, from ranked rows; ``by`` names further columns to fuse apart.

    A ranker of weight 0 and one whose scores are all zero for a query are
    skipped; if all are, every document of the query has score 0.  ``weights``
    may be a column.
    """
    weights = WEIGHTS if weights is None else weights
    if isinstance(weights, dict):
        weight: Column = F.lit(0.0)
        for r, w in weights.items():
            weight = F.when(F.col("ranker") == r, float(w)).otherwise(weight)
    else:
        weight = weights
    part = F.when((F.col("signal") > 0) & (weight != 0), weight / (k + F.col("rank"))).otherwise(0.0)
    return ranked.groupBy(*(by or []), "query_id", "doc_id").agg(F.round(F.sum(part), 12).alias("score"))


def rrf(scores: DataFrame, weights: dict[str, float] | None = None, k: float = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of long (query_id, ranker, doc_id, score) rows."""
    used = [r for r, w in (WEIGHTS if weights is None else weights).items() if w != 0]
    if not used:
        return scores.select("query_id", "doc_id", F.lit(0.0).alias("score")).distinct()
    return fused(ranks(scores.filter(F.col("ranker").isin(used))), weights, k)


def top_k(scores: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """The first k of each query, with their rank; Spark keeps k per task before the shuffle."""
    w = Window.partitionBy(*(by or []), "query_id").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def tiered(primary: DataFrame, fallback: DataFrame, k: int, demotion: float = 0.5) -> DataFrame:
    """The primary top k, topped up from the first 2k of the fallback at a demoted score, in order of (tier, rank)."""
    first = top_k(primary, k).select("query_id", "doc_id", "score", F.lit(0).alias("tier"), "rank")
    short = fallback.join(first.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").filter(F.coalesce("n", F.lit(0)) < k)
    more = top_k(short.drop("n"), 2 * k).join(first.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    more = more.select("query_id", "doc_id", (F.col("score") * demotion).alias("score"), F.lit(1).alias("tier"), "rank")
    w = Window.partitionBy("query_id").orderBy("tier", "rank")
    return first.unionByName(more).withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k).drop("rank")


def additive(lexical: DataFrame, phrase: DataFrame, phrase_weight: float = 1.6) -> DataFrame:
    """The path without fusion: lexical plus weighted phrase evidence."""
    both = lexical.withColumnRenamed("score", "a").join(phrase.withColumnRenamed("score", "b"), ["query_id", "doc_id"], "full")
    return both.select("query_id", "doc_id", F.round(F.coalesce("a", F.lit(0.0)) + phrase_weight * F.coalesce("b", F.lit(0.0)), 6).alias("score"))
