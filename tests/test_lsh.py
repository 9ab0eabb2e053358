"""Approximate search over random-projection tables: recall on the given tables, probes, pruning, odd rows."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import lsh, retrieval as S
from folioscope.plans import inputs as I

VECTORS = "chunk_id long, vector array<double>"


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_recall_on_the_given_vectors(spark, scale):
    folder = f"/root/testdata/{scale}"
    chunks, queries = I.vector_chunks(spark, folder), I.label_queries(spark, folder)
    exact = {(r.query_id, r.chunk_id): (r.score, r["rank"]) for r in S.vector_topk(chunks, queries, min_score=0.1).collect()}
    found = lsh.lsh_topk(chunks, queries, min_score=0.1).collect()
    both = [r for r in found if (r.query_id, r.chunk_id) in exact]
    assert len(both) >= 0.9 * len(exact)
    assert max(r.pairs_scored for r in found) < 0.3 * chunks.count()
    assert all(r.score == exact[r.query_id, r.chunk_id][0] and r["rank"] <= exact[r.query_id, r.chunk_id][1] for r in both)


def test_probes_are_the_cheapest_buckets():
    rng = np.random.default_rng(3)
    for count in (1, 5, 40, 64):
        margin = rng.standard_normal(6)
        own = sum(1 << i for i in range(6) if margin[i] > 0)
        all_costs = sorted(sum(abs(margin[i]) for i in flips) for n in range(7) for flips in itertools.combinations(range(6), n))
        bucket, cost = lsh.nearest_buckets(margin, count)
        assert len(set(bucket.tolist())) == count and bucket[0] == own
        assert np.allclose(cost, all_costs[:count])
        for b, c in zip(bucket.tolist(), cost, strict=True):
            assert np.isclose(c, sum(abs(margin[i]) for i in range(6) if (b ^ own) >> i & 1))


def test_a_written_index_is_pruned_to_the_probed_folders(spark, tmp_path):
    rng = np.random.default_rng(4)
    m = rng.standard_normal((300, 8))
    chunks = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], VECTORS)
    asked = chunks.filter("chunk_id < 6").withColumnRenamed("chunk_id", "query_id")
    index = lsh.write_index(lsh.lsh_index(chunks, 3, 4), f"{tmp_path}/index")
    assert index.count() == 900
    one = index.filter((F.col("table_no") == 1) & (F.col("bucket") == 3))
    assert 0 < len(one.inputFiles()) or "PartitionFilters: [isnotnull(table_no" in one._jdf.queryExecution().toString()
    assert {r.chunk_id for r in one.collect()} == {i for i, x in enumerate(m) if (
        (x @ lsh.directions(8, 1, 4, 7) > 0) @ (1 << np.arange(4))) == 3}
    options = {"k": 4, "min_score": None, "tables": 3, "bits": 4, "count": 8}
    kept = lsh.lsh_topk(chunks, asked, index=index, **options).collect()
    made = lsh.lsh_topk(chunks, asked, **options).collect()
    assert sorted(kept) == sorted(made) and all(r.chunk_id == r.query_id for r in kept if r["rank"] == 1)


def test_odd_vectors(spark):
    inf = float("inf")
    chunks = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, []), (4, [None, 1.0]), (5, [inf, 1.0]),
                                    (6, [1.0, 0.0, 0.0]), (7, [0.0, 0.0])], VECTORS)
    queries = spark.createDataFrame([(0, [2.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [0.0, 1.0, 1.0, 1.0]), (4, [inf, 0.0])],
                                    "query_id long, vector array<double>")
    found = lsh.lsh_topk(chunks, queries, 5, None, tables=2, bits=2, count=4, share=1.0).collect()
    assert {(r.query_id, r.chunk_id) for r in found} == {(0, 1), (0, 7)} and max(r.score for r in found) == 1.0
    assert lsh.lsh_topk(chunks.limit(0), queries).count() == 0 and lsh.lsh_topk(chunks, queries.limit(0)).count() == 0
