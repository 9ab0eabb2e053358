"""Two-stage retrieval for a whole table of questions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import vocab as V
from folioscope.functions.text import squash
from folioscope.operators import questions as Q
from folioscope.operators import ranking as R
from folioscope.operators import retrieval as S
from folioscope.operators.indexing import Encoder, encode_text, l2_normalize
from folioscope.session import materialize


def embed_queries(texts: DataFrame, encoder: Encoder | None = None, text: str = "subquery"
                  ) -> DataFrame:
    """Unit vector per distinct normalised text: (query_id = text, vector)."""
    distinct = texts.select(squash(F.col(text)).alias("query_id")).filter("query_id <> ''").distinct()
    # few bytes of texts would be one task, but an encoder costs more than their move
    distinct = distinct.repartition(2 * texts.sparkSession.sparkContext.defaultParallelism, "query_id")
    return l2_normalize(distinct.withColumn("vector", encode_text(F.col("query_id"), encoder))
                        ).select("query_id", "vector")


def search_texts(subqueries: DataFrame, collection: DataFrame, k: int, min_score: float,
                 encoder: Encoder | None = None, probe_bits: int = 0) -> DataFrame:
    """Hits per (query_id, subquery_pos); a text asked many times is searched once."""
    vectors = embed_queries(subqueries, encoder)
    hits = S.vector_topk(collection, vectors, k, min_score, probe_bits=probe_bits)
    keyed = subqueries.withColumn("__text", squash(F.col("subquery")))
    return (keyed.join(hits.withColumnRenamed("query_id", "__text"), "__text")
            .select("query_id", "subquery_pos", "rank", "chunk_id", "score"))


def with_payload(hits: DataFrame, collection: DataFrame) -> DataFrame:
    """Payload columns of the hit chunks only; vectors stay behind."""
    return hits.join(collection.drop("vector", "dimension", "normalized"), "chunk_id")


@dataclass
class Retrieval:
    """Tables of one retrieval run, keyed by the normalised question."""

    plans: DataFrame
    candidates: DataFrame
    coverage: DataFrame
    ranked: DataFrame
    contexts: DataFrame


def retrieve_batch(questions: DataFrame, collection: DataFrame, encoder: Encoder | None = None,
                   filters: dict | None = None, top_k: int = V.TOP_K, top_n: int = V.TOP_N,
                   min_score: float = V.MIN_SIMILARITY, budget: int = V.CONTEXT_TOKEN_BUDGET
                   ) -> Retrieval:
    """Guidance, plan, search, coverage, second pass, re-rank and context.

    ``questions(query_id, text)``; equal questions are answered once, so ``query_id`` of the
    result tables is the normalised question and joins back to ``process_queries``.
    The number of joins is fixed, whatever the number of questions.
    """
    asked = (Q.process_queries(questions).filter("is_valid")
             .select(F.col("normalized_query").alias("query_id")).distinct()
             .withColumn("normalized_query", F.col("query_id")))
    internal = S.search_filter(collection, document_type=V.INSTRUCTION, visibility=V.INTERNAL)
    company = S.search_filter(collection, **{**(filters or {}), "document_type": V.COMPANY,
                                             "visibility": V.USER_VISIBLE})
    first = asked.select("query_id", F.lit(0).alias("subquery_pos"), F.col("query_id").alias("subquery"))
    guidance = with_payload(search_texts(first, internal, V.GUIDANCE_TOP_K,
                                         V.GUIDANCE_MIN_SIMILARITY, encoder), internal)
    plans = materialize(R.effective_top_n(Q.question_plans(asked, guidance), top_n), "plans")

    hits = search_texts(Q.combine_queries(plans), company, top_k, min_score, encoder)
    payload, texts = S.without_text(company), S.text_store(company)
    evidence = S.evidence_boundary(with_payload(hits, payload))
    # feeds coverage, the second pass and the union
    accepted = materialize(S.merge_candidates(evidence), "candidates")
    coverage = materialize(S.fallback_queries(S.check_coverage(
        accepted, plans.select("query_id", "required_metrics"), texts)), "coverage")

    again = coverage.filter("not is_sufficient").select(
        "query_id", F.posexplode("fallback").alias("subquery_pos", "subquery"))
    more = S.evidence_boundary(with_payload(
        search_texts(again, company, top_k, min_score, encoder), payload))
    candidates = materialize(S.second_pass_merge(accepted, more), "all-candidates")

    scored = R.rerank_score(candidates.join(
        plans.select("query_id", F.col("normalized_query").alias("query_text"), "effective_top_n"),
        "query_id"), texts)
    ranked = R.diversity_select(scored, F.col("effective_top_n"))
    contexts = R.build_context(ranked, budget, questions=plans, texts=texts)

    def whole(rows: DataFrame) -> DataFrame:
        return S.with_text(rows, texts).drop("content_key", "content_tokens")

    return Retrieval(plans, whole(candidates), coverage, whole(ranked), contexts)
