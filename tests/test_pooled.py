"""Fused rankings of pools against the same rankers as rows."""

import os

import pytest
from pyspark.sql import functions as F

from quarrylight.operators import fusion, pooled
from quarrylight.plans import queries as Q

SF = "/root/testdata/sf0.001"


def test_fused_pools_match_rows(spark):
    """Ties, zero scores, rows outside of the pool, a ranker without signal and one without weight, all rows or the first."""
    pool = [(q, d, s) for q, s0 in ((1, 0.5), (2, 0.0)) for d, s in ((7, s0), (3, s0), (5, 0.0), (9, 0.25 * (q == 1)))]
    found = [(1, "lexical", 5, 2.0), (1, "lexical", 9, 2.0), (1, "lexical", 100, 9.0), (1, "phrase", 3, 0.1), (2, "lexical", 7, -1.0), (3, "lexical", 7, 1.0)]
    pools, rows = spark.createDataFrame(pool, "query_id long, doc_id long, score double"), spark.createDataFrame(found, "query_id long, ranker string, doc_id long, score double")
    points = {"even": {"lexical": 1.0, "phrase": 1.0, "category": 1.0}, "plain": {"lexical": 1.0, "phrase": 0.0, "category": 0.4}}
    got = {(r.point, r.query_id, r.doc_id): (r.score, r["rank"]) for r in pooled.fused(pools, rows, points).collect()}
    wanted = {}
    for name, weights in points.items():
        long = pools.withColumn("ranker", F.lit("category"))
        for ranker in ("lexical", "phrase"):
            long = long.unionByName(fusion.over_pool(pools.drop("score"), rows.filter(F.col("ranker") == ranker).drop("ranker"), ranker))
        for r in fusion.top_k(fusion.rrf(long, weights), 9).collect():
            wanted[name, r.query_id, r.doc_id] = (r.score, r["rank"])
    assert got == wanted and len(got) == 16
    some = pooled.fused(pools, rows, points, 2).collect()
    assert {(r.point, r.query_id, r.doc_id): (r.score, r["rank"]) for r in some} == {k: v for k, v in wanted.items() if v[1] <= 2}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["fused_topk", "rrf_fusion", "grid_summary"])
def test_no_rows_for_each_ranker_and_document_of_a_pool(spark, monkeypatch, name):
    """The rankers' scores over whole pools are neither written out nor numbered by a range shuffle."""
    def refused(*args, **more):
        raise AssertionError("a pool as rows")

    monkeypatch.setattr(fusion, "places", refused)
    monkeypatch.setattr(fusion, "over_pool", refused)
    assert Q.QUERIES[name](spark, SF).count() > 0
