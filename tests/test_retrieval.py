import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import indexing as X
from folioscope.operators import ranking as R
from folioscope.operators import retrieval as S
from folioscope.plans.retrieve import retrieve_batch
from folioscope.operators.indexing import embed_chunks, l2_normalize


def vectors(spark, n, d, seed, name):
    m = np.random.default_rng(seed).standard_normal((n, d)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(m)], f"{name} long, vector array<float>")
    return m.astype(np.float64), df


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclid"])
@pytest.mark.parametrize("bound", [8 * 1024 * 1024, 8 * 8 * 5])
def test_topk_is_exact_in_one_and_many_blocks(spark, monkeypatch, metric, bound):
    monkeypatch.setattr(S, "BLOCK_BYTES", bound)
    m, chunks = vectors(spark, 300, 8, 1, "chunk_id")
    q, queries = vectors(spark, 17, 8, 2, "query_id")
    m[7] = m[3]
    chunks = chunks.withColumn("vector", F.when(F.col("chunk_id") == 7, F.array(
        *[F.lit(float(x)).cast("float") for x in m[3]])).otherwise(F.col("vector")))
    got = {}
    for r in S.vector_topk(chunks.repartition(5), queries, 4, None, metric).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.chunk_id))
    scores = {"dot": q @ m.T, "euclid": -np.linalg.norm(q[:, None] - m[None], axis=2),
              "cosine": (q @ m.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(m, axis=1)[None]}[metric]
    for i in range(17):
        order = sorted(range(300), key=lambda j: (-round(scores[i, j], 6), j))[:4]
        assert [c for _, c in sorted(got[i])] == order


def test_no_vector_is_shuffled_for_the_pairs_of_blocks(spark, monkeypatch):
    """Many blocks on both sides, ids that repeat: vectors are read per pair of blocks and never exchanged."""
    monkeypatch.setattr(S, "QUERY_ROWS", 3)
    monkeypatch.setattr(S, "HELD_BYTES", 1)
    m, chunks = vectors(spark, 60, 8, 1, "chunk_id")
    q, queries = vectors(spark, 17, 8, 2, "query_id")
    named = chunks.withColumn("chunk_id", F.concat(F.lit("c"), F.lpad(F.col("chunk_id").cast("string"), 3, "0")))
    found = S.vector_topk(named, queries.unionByName(queries.filter("query_id = 4")), 4, None)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "FlatMapCoGroups" not in plan
    scores = np.round((q @ m.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(m, axis=1)[None], 6)
    for i in range(17):
        order = sorted((-scores[i, j], f"c{j:03d}") for j in range(60) for _ in range(2 if i == 4 else 1))[:4]
        assert [r.chunk_id for r in found.filter(F.col("query_id") == i).orderBy("rank").collect()] == [c for _, c in order]


def test_unusable_vectors_are_listed_and_never_shift_scores(spark, rows):
    inf = float("inf")
    chunks = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0]), (4, [0.0, 1.0, 0.0]), (5, [1.0]),
                                    (6, [None, 1.0]), (7, [float("nan"), 1.0]), (8, [inf, 1.0])],
                                   "chunk_id long, vector array<float>")
    queries = spark.createDataFrame([(0, [0.0, 1.0])], "query_id long, vector array<float>")
    assert rows(S.vector_topk(chunks, queries, 5, None), "chunk_id", "score") == [(1, 0.0), (3, 1.0)]
    assert [r[0] for r in rows(S.vector_rejects(chunks, 2), "chunk_id")] == [2, 4, 5, 6, 7, 8]


def test_an_odd_query_leaves_the_others_their_hits(spark):
    chunks = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 1.0, 0.0]), (4, [None, 1.0])],
                                   "chunk_id long, vector array<float>")
    queries = spark.createDataFrame([(0, [0.0, 1.0]), (1, [0.0, 1.0, 0.0]), (2, [1.0] * 9), (3, [float("nan")] * 4),
                                     (4, None), (5, [])], "query_id long, vector array<float>")
    for bits in (0, 2):
        found = S.vector_topk(chunks, queries, 5, 0.5, probe_bits=bits).collect()
        assert sorted((r.query_id, r.chunk_id) for r in found) == [(0, 2), (1, 3)]
    assert not S.vector_topk(chunks, queries.filter("query_id > 1"), 5, None).collect()


def test_approximate_search_has_bounded_recall(spark):
    """Unit vectors around ten centres: nearly all true neighbours differ from the query in one bit at most."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((10, 16))
    m = (centres[np.arange(400) % 10] + 0.15 * rng.standard_normal((400, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "chunk_id long, vector array<float>")
    asked = df.filter("chunk_id < 40").withColumnRenamed("chunk_id", "query_id")
    exact = {tuple(r) for r in S.vector_topk(df, asked, 10, None).select("query_id", "chunk_id").collect()}
    near = {tuple(r) for r in S.vector_topk(df, asked, 10, None, probe_bits=4).select("query_id", "chunk_id").collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_approximate_search_finds_the_query_itself(spark):
    _, chunks = vectors(spark, 200, 8, 4, "chunk_id")
    found = S.vector_topk(chunks, chunks.withColumnRenamed("chunk_id", "query_id"), 1, 0.5, probe_bits=4).collect()
    assert len(found) == 200 and all(r.query_id == r.chunk_id for r in found)


def hits(spark, data):
    return spark.createDataFrame(data, "query_id string, subquery_pos int, rank int, chunk_id string, "
                                       "document_name string, page_numbers array<int>, score double, content string")


def test_merge_caps_documents_and_second_pass_does_not(spark, rows):
    first = hits(spark, [("q", 0, r, f"c{r}", "d", [r], 0.9 - r / 100, "x") for r in range(1, 6)]
                 + [("q", 1, 1, "c1", "d", [1], 0.99, "x"), ("q", 1, 2, "e1", "e", [1], 0.5, "x")])
    merged = S.merge_candidates(first)
    assert rows(merged, "chunk_id", "score") == [("c1", 0.89), ("c2", 0.88), ("c3", 0.87), ("e1", 0.5)]
    again = S.second_pass_merge(merged, hits(spark, [("q", 0, 1, "c4", "d", [4], 0.8, "x"), ("q", 0, 2, "c1", "d", [1], 0.7, "x")]))
    assert rows(again.filter("pass_no = 2"), "chunk_id") == [("c4",)]


def test_coverage_without_candidates(spark):
    need = spark.createDataFrame([("q", ["revenue", "net_profit"]), ("e", [])], "query_id string, required_metrics array<string>")
    none = hits(spark, [("q", 0, 1, "c", "d", [1], 0.9, "x")]).filter("rank > 1")
    got = {r.query_id: r for r in S.fallback_queries(S.check_coverage(none, need)).collect()}
    assert not got["q"].is_sufficient and len(got["q"].fallback) == 4
    assert not got["e"].is_sufficient and got["e"].fallback == []
    some = hits(spark, [("q", 0, 1, "c", "d", [1], 0.9, "Turnover was 5 crore")])
    r = {r.query_id: r for r in S.check_coverage(some, need).collect()}["q"]
    assert r.found_metrics == ["revenue"] and r.missing_metrics == ["net_profit"] and r.is_sufficient


def test_diversity_equals_greedy(spark):
    rng = np.random.default_rng(9)
    data = [(f"q{q}", i, f"d{rng.integers(0, 3)}", float(rng.integers(0, 6)) / 10, f"c{i}")
            for q in range(30) for i in range(int(rng.integers(1, 14)))]
    df = spark.createDataFrame(data, "query_id string, rank int, document_name string, rerank double, chunk_id string")
    got = {}
    for r in R.diversity_select(df, 5, arrival=["rank"]).collect():
        got.setdefault(r.query_id, []).append((r.final_rank, r.chunk_id))
    for q in {d[0] for d in data}:
        ranked = sorted((d for d in data if d[0] == q), key=lambda d: (-d[3], d[1]))
        chosen, counts = [], {}
        for d in ranked:
            if len(chosen) < 5 and (counts.get(d[2], 0) < 2 or len(chosen) < 2):
                chosen.append(d)
                counts[d[2]] = counts.get(d[2], 0) + 1
        chosen += [d for d in ranked if d not in chosen][:5 - len(chosen)]
        assert [c for _, c in sorted(got[q])] == [d[4] for d in chosen]


def ranked(spark):
    data = [("q", 1, "a", "x.pdf", [1, 2], "S", "alpha", 30, "company", "user_visible", 0.9),
            ("q", 2, "a", "x.pdf", [1, 2], "S", "alpha", 30, "company", "user_visible", 0.8),
            ("q", 3, "b", "y.pdf", [], "T", "beta", 60, "company", "user_visible", 0.7),
            ("q", 4, "c", "z.pdf", [3], "U", "gamma", 20, "instruction", "internal", 0.6)]
    return spark.createDataFrame(data, "query_id string, final_rank int, chunk_id string, document_name string, "
                                       "page_numbers array<int>, section_title string, content string, "
                                       "estimated_tokens int, document_type string, visibility string, rerank double")


def test_context_budget_sources_and_confidence(spark, rows):
    r = R.build_context(ranked(spark), 100).first()
    assert r.chunks_used == 2 and r.sources == ["x.pdf Page 1, 2", "y.pdf Page 1"]
    assert r.context_text.startswith("--- Source [1]: x.pdf | Page 1, 2 | Section: S ---\nalpha")
    assert "--- Source [3]: y.pdf | Page  | Section: T ---" in r.context_text
    assert R.build_context(ranked(spark), 10).first().chunks_used == 1
    found = rows(R.extract_sources(ranked(spark)), "position", "document")
    assert found == [(1, "x.pdf"), (2, "x.pdf"), (3, "y.pdf")]
    refused = spark.createDataFrame([("q", "The available company documents do not contain sufficient evidence to")],
                                    "query_id string, answer string")
    assert R.extract_sources(ranked(spark), refused).count() == 0
    assert R.confidence(ranked(spark)).first().confidence == 0.9
    questions = spark.createDataFrame([("q", " Ask? ", "ANALYTICAL", "D")], "query_id string, query_text string, archetype string, depth string")
    prompt = R.build_prompts(questions, ranked(spark)).first().prompt
    assert "gamma" not in prompt and "Chunk 2" in prompt and prompt.endswith("User Question\nAsk?")


def test_filters_and_boundary(spark, rows):
    df = ranked(spark).withColumn("section_type", F.lit("list")).withColumn("document_id", F.col("document_name"))
    assert S.search_filter(df).count() == 4
    assert rows(S.search_filter(df, document_type="company", page_numbers=[2, 9]), "final_rank") == [(1,), (2,)]
    assert rows(S.search_filter(df, document_id=["y.pdf", "z.pdf"], visibility="internal"), "final_rank") == [(4,)]
    assert S.evidence_boundary(df).count() == 3 and S.boundary_audit(df).first().leaks == 1


def test_retrieval_never_shows_internal_chunks(spark):
    data = [(f"c{i}", f"doc{i % 3}", f"revenue table {i} net profit 2025 page number {i}", "company") for i in range(12)]
    data += [(f"i{i}", "guide", "net profit revenue guidance gross profit", "instruction") for i in range(3)]
    base = spark.createDataFrame(data, "chunk_id string, document_name string, content string, document_type string").select(
        "*", F.col("document_name").alias("document_id"), F.array(F.lit(1)).alias("page_numbers"), F.lit("T").alias("section_title"),
        F.lit("paragraph").alias("section_type"), F.lit(3).alias("hierarchy_level"), F.lit(20).alias("estimated_tokens"),
        F.when(F.col("document_type") == "company", "user_visible").otherwise("internal").alias("visibility"))
    rows_ = base.join(l2_normalize(embed_chunks(base)).select("chunk_id", "vector"), "chunk_id")
    asked = spark.createDataFrame([(1, "net profit revenue 2025"), (2, " net profit  revenue 2025"), (3, "")], "query_id int, text string")
    out = retrieve_batch(asked, rows_)
    plan = out.plans.collect()
    assert len(plan) == 1 and plan[0].guidance_chunks == 3
    got = out.ranked.collect()
    assert got and all(r.document_type == "company" for r in got)
    assert out.contexts.first().chunks_used == len({r.chunk_id for r in got})


def test_near_scores_keep_their_order(spark):
    """Scores that differ by a few millionths, which single precision alone would mix up."""
    base = np.random.default_rng(3).standard_normal(32)
    m = np.array([base + 1e-3 * np.random.default_rng(i).standard_normal(32) for i in range(400)]).astype(np.float32)
    chunks = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "chunk_id long, vector array<float>")
    queries = spark.createDataFrame([(0, [float(x) for x in base])], "query_id long, vector array<double>")
    m, q = m.astype(np.float64), base
    scores = np.round((m @ q) / np.linalg.norm(m, axis=1) / np.linalg.norm(q), 6)
    got = [r.chunk_id for r in S.vector_topk(chunks, queries, 20, None).orderBy("rank").collect()]
    assert got == sorted(range(400), key=lambda j: (-scores[j], j))[:20]


def test_rows_without_text_give_the_same_results(spark, rows):
    """Ids repeat with other texts, and a text is null."""
    data = [("q", 1, 1, "a revenue 2025\n| revenue 7 |"), ("q", 2, 1, "other"), ("q", 3, 2, None), ("p", 1, 3, "profit 3")]
    full = spark.createDataFrame(data, "query_id string, final_rank int, chunk_id int, content string").select(
        "*", F.lit("T revenue").alias("section_title"), F.lit("list").alias("section_type"), F.lit(3).alias("hierarchy_level"),
        F.lit("d").alias("document_name"), F.array(F.lit(1)).alias("page_numbers"), F.lit(0).alias("estimated_tokens"),
        F.lit("company").alias("document_type"), F.lit("user_visible").alias("visibility"), F.lit(0.5).alias("score"),
        F.col("query_id").alias("query_text"), F.col("final_rank").alias("rank"))
    slim, texts = S.without_text(full), S.text_store(full)
    assert "content" not in slim.columns
    assert rows(R.build_context(slim, texts=texts), "query_id", "context_text", "chunks_used") == rows(
        R.build_context(full), "query_id", "context_text", "chunks_used")
    asked = spark.createDataFrame([("q", "x", "A", "D")], "query_id string, query_text string, archetype string, depth string")
    assert rows(R.build_prompts(asked, slim, texts=texts)) == rows(R.build_prompts(asked, full))
    required = spark.createDataFrame([("q", ["revenue", "net_profit"]), ("p", ["profit"])], "query_id string, required_metrics array<string>")
    assert rows(S.check_coverage(slim, required, texts), "query_id", "found_metrics", "has_numbers") == rows(
        S.check_coverage(full, required), "query_id", "found_metrics", "has_numbers")
    once = full.filter("final_rank = 1")
    assert rows(R.rerank_score(S.without_text(once), texts), "query_id", "rerank") == rows(
        R.rerank_score(once), "query_id", "rerank")
    assert rows(S.evidence_flags(slim, ["profit"], ["revenue"], texts), "query_id", "ownership_found", "marketing_found") == rows(
        S.evidence_flags(full, ["profit"], ["revenue"]), "query_id", "ownership_found", "marketing_found")


def test_encoder_memory_does_not_grow_with_a_batch(monkeypatch):
    import tracemalloc
    import pandas as pd
    texts = pd.Series([" ".join(f"w{i}x{j}" for j in range(2000)) for i in range(150)])
    monkeypatch.setattr(X, "SLICE_CHARS", 1 << 40)
    whole = next(X.hashing_encoder()(iter([texts])))
    monkeypatch.setattr(X, "SLICE_CHARS", 1 << 16)
    tracemalloc.start()
    parts = next(X.hashing_encoder()(iter([texts])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True))
    # the bucket cache takes at most 200,000 words; the batch itself has 300,000 words
    assert peak < 45e6


def test_texts_are_encoded_once_when_their_vectors_are_filtered(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "")], "chunk_id int, content string").repartition(3, "chunk_id")
    searched = X.with_vectors(docs).select("chunk_id", "vector").filter(S.finite(F.col("vector")))
    assert [r.chunk_id for r in searched.orderBy("chunk_id").collect()] == [1, 2]
    assert searched._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
