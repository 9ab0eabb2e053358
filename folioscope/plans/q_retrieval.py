"""Registered queries: vector search, merging, coverage, ranking, context, prompts, sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import vocab as V
from folioscope.functions.text import half_even
from folioscope.operators import lsh as L
from folioscope.operators import questions as Q
from folioscope.operators import ranking as R
from folioscope.operators import retrieval as S
from folioscope.operators.indexing import with_vectors
from folioscope.plans import duck as D, inputs as I
from folioscope.plans import q_questions as QQ
from folioscope.plans.q_corpus import DOCS
from folioscope.plans.retrieve import embed_queries as embed_texts, retrieve_batch as retrieve
from folioscope.plans.retrieve import search_texts, with_payload
from folioscope.session import materialize

LOW = 0.1   # the centroids' best cosine in the embeddings table is below the default threshold


def pages_text():
    return F.array_join(F.transform("page_numbers", lambda p: p.cast("string")), ",").alias("page_numbers")


# ---- on the embeddings table ---------------------------------------------------------------
def vector_topk(spark, sf):
    return S.vector_topk(I.vector_chunks(spark, sf), I.label_queries(spark, sf), min_score=LOW)


def vector_topk_holes(spark, sf):
    """Vectors with holes: some null, some shorter, some with a null or an infinite component."""
    chunks = I.vector_chunks(spark, sf)
    kind, v = F.pmod("chunk_id", F.lit(7)), F.col("vector")
    broken = F.when(kind == 0, F.lit(None)).when(kind == 1, F.slice(v, 1, 10)).when(
        kind == 2, F.concat(F.slice(v, 2, F.size(v)), F.array(F.lit(None).cast("float")))).when(
        kind == 3, F.concat(F.slice(v, 2, F.size(v)), F.array(F.lit(float("inf")).cast("float")))).otherwise(v)
    return S.vector_topk(chunks.withColumn("vector", broken), I.label_queries(spark, sf), min_score=LOW)


def vector_topk_euclid(spark, sf):
    return S.vector_topk(I.vector_chunks(spark, sf), I.label_queries(spark, sf), min_score=None, metric="euclid")


def vector_topk_lsh(spark, sf):
    return L.lsh_topk(I.vector_chunks(spark, sf), I.label_queries(spark, sf), min_score=LOW)


def vector_topk_lsh_recall(spark, sf):
    """Per query: its exact hits, whether found ones have exact scores, and the work; and the recall over all queries."""
    exact = materialize(vector_topk(spark, sf), "exact").select("query_id", "chunk_id", F.col("score").alias("exact_score"))
    found = materialize(vector_topk_lsh(spark, sf), "found")
    hits = exact.join(found.select("query_id", "chunk_id", "score"), ["query_id", "chunk_id"], "left")
    recall = hits.agg(F.count("score") / F.count("*")).first()[0]
    chunks = I.vector_chunks(spark, sf).count()
    work = found.groupBy("query_id").agg((F.max("pairs_scored") < 0.3 * chunks).alias("few_scored"))
    per_query = hits.groupBy("query_id").agg(F.count("*").alias("exact_hits"), F.coalesce(
        F.bool_and(F.col("score") == F.col("exact_score")), F.lit(False)).alias("scores_exact"))
    return per_query.join(work, "query_id", "left").withColumn("recall_reached", F.lit(recall is not None and recall >= 0.9))


def _label_hits(spark, sf):
    return with_payload(vector_topk(spark, sf), I.vector_chunks(spark, sf))


def evidence_boundary(spark, sf):
    return S.evidence_boundary(_label_hits(spark, sf)).select("query_id", "chunk_id", "rank", "document_name")


def boundary_audit(spark, sf):
    return S.boundary_audit(S.evidence_boundary(_label_hits(spark, sf)))


def diversity_select(spark, sf):
    """Flagship: top-k, boundary, merge and diversity over the embeddings table."""
    hits = S.evidence_boundary(_label_hits(spark, sf)).withColumn("subquery_pos", F.lit(0)).withColumn(
        "page_numbers", F.array(F.col("chunk_id").cast("int")))
    merged = S.merge_candidates(hits).withColumn("rerank", F.col("score"))
    return R.diversity_select(merged, arrival=["rank"]).select("query_id", "final_rank", "chunk_id",
                                                               "document_name", "score")


# ---- on documents and questions ------------------------------------------------------------
def collection(spark, sf):
    return with_vectors(I.document_chunks(spark, sf))


def embed_queries(spark, sf):
    asked = QQ.valid(spark, sf).withColumnRenamed("normalized_query", "subquery")
    return embed_texts(asked).select("query_id", F.posexplode("vector").alias("pos", "x")).filter("x <> 0").select(
        "query_id", "pos", half_even(F.col("x").cast("double"), 6).alias("x"))


def search_filter(spark, sf):
    return S.search_filter(I.document_chunks(spark, sf), document_type="company", section_type=["heading", "title"],
                           visibility="user_visible").select("chunk_id", "document_id", pages_text())


def payload_defaults(spark, sf):
    docs = I.document_chunks(spark, sf)
    sparse = F.col("hierarchy_level") == 2
    holed = docs.withColumn("filename", F.concat("document_id", F.lit(".pdf"))).select(
        "chunk_id", F.when(sparse, "").otherwise(F.col("document_id")).alias("document_id"),
        F.when(~sparse, F.col("document_name")).alias("document_name"),
        F.when(F.col("section_type") == "heading", F.col("filename")).alias("filename"), "content",
        F.when(~sparse, F.col("page_numbers")).alias("page_numbers"),
        F.when(~sparse, F.col("section_title")).alias("section_title"),
        F.when(~sparse, F.col("section_type")).alias("section_type"),
        F.when(~sparse, F.col("hierarchy_level")).alias("hierarchy_level"),
        F.when(sparse, F.col("chunk_order")).alias("reading_order"),
        F.when(sparse, F.col("estimated_tokens")).alias("estimated_tokens"),
        F.when(~sparse, F.col("document_type")).alias("document_type"),
        F.when(sparse & (F.col("section_type") == "heading"), "internal").alias("visibility"))
    return S.payload_defaults(holed).select(
        "chunk_id", "document_id", "document_name", pages_text(), "section_title", "section_type",
        "hierarchy_level", "reading_order", "estimated_tokens", "document_type", "visibility")


def _asked(spark, sf):
    """Distinct valid questions; the question text is the id."""
    return QQ.valid(spark, sf).select(F.col("normalized_query").alias("query_id")).distinct().withColumn(
        "normalized_query", F.col("query_id"))


def _company(spark, sf):
    return S.search_filter(I.document_chunks(spark, sf), document_type=V.COMPANY, visibility=V.USER_VISIBLE)


def _texts(spark, sf):
    return S.text_store(_company(spark, sf))


def _hits(spark, sf):
    """Hits of the decomposed sub-questions among company documents, with payload but for their texts."""
    company = _company(spark, sf)
    vectors = with_vectors(company).select("chunk_id", "vector")
    parts = materialize(Q.decompose_queries(_asked(spark, sf)).select(
        "query_id", F.posexplode("subqueries").alias("subquery_pos", "subquery")), "parts")
    return with_payload(search_texts(parts, vectors, V.TOP_K, V.MIN_SIMILARITY), S.without_text(company))


def _merged(spark, sf):
    return materialize(S.merge_candidates(_hits(spark, sf)), "candidates")


def retrieve_guidance(spark, sf):
    internal = S.search_filter(collection(spark, sf), document_type=V.INSTRUCTION, visibility=V.INTERNAL)
    first = _asked(spark, sf).select("query_id", F.lit(0).alias("subquery_pos"), F.col("query_id").alias("subquery"))
    return search_texts(first, internal, V.GUIDANCE_TOP_K, V.GUIDANCE_MIN_SIMILARITY).drop("subquery_pos")


def merge_candidates(spark, sf):
    return S.merge_candidates(_hits(spark, sf)).select(
        "query_id", "subquery_pos", "rank", "chunk_id", "document_name", "page_key", "score")


def candidate_counts(spark, sf):
    return S.candidate_counts(S.merge_candidates(_hits(spark, sf)))


def check_coverage(spark, sf):
    required = Q.plan_intent(_asked(spark, sf)).select("query_id", "required_metrics")
    found = S.check_coverage(_merged(spark, sf), required, _texts(spark, sf))
    return found.select("query_id", QQ.flat("found_metrics"), QQ.flat("missing_metrics"), "has_numbers", "is_sufficient")


def second_pass_merge(spark, sf):
    """The first sub-question is the first pass, later ones the second."""
    hits = materialize(_hits(spark, sf), "hits")
    first = S.merge_candidates(hits.filter("subquery_pos = 0"))
    return S.second_pass_merge(first, hits.filter("subquery_pos > 0")).select(
        "query_id", "pass_no", "subquery_pos", "rank", "chunk_id")


def _scored(spark, sf):
    merged = _merged(spark, sf).withColumn("pass_no", F.lit(1))
    return R.rerank_score(merged.withColumn("query_text", F.col("query_id")), _texts(spark, sf))


def rerank_score(spark, sf):
    return _scored(spark, sf).select("query_id", "chunk_id", "score", "rerank")


def _ranked(spark, sf):
    return R.diversity_select(_scored(spark, sf))


def diversity_documents(spark, sf):
    return _ranked(spark, sf).select("query_id", "final_rank", "chunk_id", "rerank")


def build_context(spark, sf):
    packed = R.build_context(_ranked(spark, sf), questions=_asked(spark, sf), texts=_texts(spark, sf))
    return packed.select("query_id", F.md5("context_text").alias("context_md5"), "chunks_used", "estimated_tokens",
                         "token_utilization", QQ.flat("sources"))


def format_citation(spark, sf):
    docs = I.document_chunks(spark, sf).withColumn("page_numbers", F.when(
        F.col("hierarchy_level") == 2, F.array(F.col("chunk_id").cast("int"), (F.col("chunk_id") + 1).cast("int")))
        .otherwise(F.array().cast("array<int>")))
    return docs.select("chunk_id", R.format_citation(F.col("document_name"), F.col("page_numbers")).alias("citation"))


def build_prompts(spark, sf):
    questions = Q.classify_archetype(_asked(spark, sf)).withColumn("query_text", F.col("query_id"))
    return R.build_prompts(questions, _ranked(spark, sf), texts=_texts(spark, sf)).select("query_id", F.md5("prompt").alias("prompt_md5"))


def extract_sources(spark, sf):
    """Questions about owners were refused."""
    answers = _asked(spark, sf).select("query_id", F.when(
        F.contains("query_id", F.lit("owner")), "The available company documents do not contain sufficient evidence.")
        .otherwise("See the table.").alias("answer"))
    return R.extract_sources(_ranked(spark, sf), answers)


def confidence(spark, sf):
    return R.confidence(_ranked(spark, sf))


def evidence_flags(spark, sf):
    flags = S.evidence_flags(_ranked(spark, sf).withColumn("rank", F.col("final_rank")).withColumn(
        "score", F.col("rerank")), ownership=["est", "ownership"], marketing=["que ", "marketing"], texts=_texts(spark, sf))
    return flags.select("query_id", "ownership_found", "marketing_found",
                        F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"),
                        F.size("scores").alias("n_scores"))


def retrieve_batch(spark, sf):
    result = retrieve(I.questions(spark, sf), materialize(collection(spark, sf), "collection"))
    return result.contexts.select("query_id", F.md5("context_text").alias("context_md5"), "chunks_used",
                                  "estimated_tokens", "token_utilization", QQ.flat("sources"))


QUERIES = {
    "vector_topk": vector_topk, "vector_topk_holes": vector_topk_holes, "vector_topk_euclid": vector_topk_euclid, "vector_topk_lsh": vector_topk_lsh,
    "vector_topk_lsh_recall": vector_topk_lsh_recall,
    "evidence_boundary": evidence_boundary, "boundary_audit": boundary_audit, "diversity_select": diversity_select,
    "embed_queries": embed_queries, "search_filter": search_filter, "payload_defaults": payload_defaults,
    "retrieve_guidance": retrieve_guidance, "merge_candidates": merge_candidates,
    "candidate_counts": candidate_counts, "check_coverage": check_coverage, "second_pass_merge": second_pass_merge,
    "rerank_score": rerank_score, "diversity_documents": diversity_documents, "build_context": build_context,
    "format_citation": format_citation, "build_prompts": build_prompts, "extract_sources": extract_sources,
    "confidence": confidence, "evidence_flags": evidence_flags, "retrieve_batch": retrieve_batch,
}

# ---- SQL -----------------------------------------------------------------------------------
LABEL = """flat AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
means AS (SELECT label, pos, round_even(CAST(avg_x AS DOUBLE) * 1000000.0::DOUBLE, 0) / 1000000.0::DOUBLE AS x FROM (
  SELECT label, pos, CAST(sum(CAST(x AS DECIMAL(20, 12))) AS DOUBLE) / count(*) AS avg_x FROM flat GROUP BY 1, 2)),
centers AS (SELECT label AS query_id, list(x ORDER BY pos) AS q FROM means GROUP BY 1),
vecs AS (SELECT vec_id AS chunk_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, 'label-' || label AS document_name,
  label FROM embeddings)"""


def label_top(score, where, name="label_hits"):
    return f"""{name}_scored AS (SELECT query_id, chunk_id, document_name, label, {D.half_even(score, 6)} AS score
  FROM centers, vecs),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM {name}_scored {where}) WHERE rank <= 10)"""


LABEL_HITS = D.with_(LABEL, label_top("list_dot_product(q, v) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(v, v)))",
                                      f"WHERE score >= {LOW}"))
UNIT = "[\\p{L}\\p{N}_]+"


def sparse(name, source, key, text):
    return f"""{name}_words AS (SELECT {key} AS id, CAST(('0x' || substr(md5(w), 1, 8)) AS BIGINT) % 384 AS b
  FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '{UNIT}')) AS w FROM {source})),
{name}_counts AS (SELECT id, b, count(*) AS n FROM {name}_words GROUP BY 1, 2),
{name}_norms AS (SELECT id, sqrt(sum(CAST(n * n AS DOUBLE))) AS norm FROM {name}_counts GROUP BY 1),
{name} AS (SELECT id, b, CAST(CAST(CAST(n AS DOUBLE) / norm AS FLOAT) AS DOUBLE) AS w
  FROM {name}_counts JOIN {name}_norms USING (id)),
{name}_unit AS (SELECT id, sqrt(sum(w * w)) AS norm FROM {name} GROUP BY 1)"""


def text_hits(name, texts, chunks, k, low):
    """Top-k of distinct ``texts(t)`` among ``chunks(chunk_id, content)``."""
    return ",\n".join([
        sparse(f"{name}_q", texts, "t", "t"), sparse(f"{name}_d", chunks, "chunk_id", "content"),
        f"""{name}_scores AS (SELECT q.id AS t, d.id AS chunk_id, sum(q.w * d.w) AS dot
  FROM {name}_q q JOIN {name}_d d USING (b) GROUP BY 1, 2),
{name}_rounded AS (SELECT t, chunk_id, {D.half_even('dot / (a.norm * c.norm)', 6)} AS score FROM {name}_scores s
  JOIN {name}_q_unit a ON a.id = s.t JOIN {name}_d_unit c ON c.id = s.chunk_id),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY score DESC, chunk_id) AS rank
  FROM {name}_rounded WHERE score >= {low}) WHERE rank <= {k})"""])


ASKED = "asked_texts AS (SELECT DISTINCT nq AS t FROM valid)"
# everything below keys questions by their text
BY_TEXT = "valid_rows AS (SELECT * FROM valid)"
COMPANY = "company AS (SELECT * FROM docs WHERE document_type = 'company' AND visibility = 'user_visible')"
INTERNAL = "internal AS (SELECT * FROM docs WHERE document_type = 'instruction' AND visibility = 'internal')"
PARTS = """parts AS (SELECT query_id, generate_subscripts(subqueries, 1) - 1 AS subquery_pos, unnest(subqueries) AS subquery
  FROM (SELECT DISTINCT v.nq AS query_id, d.subqueries FROM decomposed d JOIN valid v USING (query_id))),
part_texts AS (SELECT DISTINCT {squash} AS t FROM parts)""".replace("{squash}", D.squash("subquery"))


def expand(name, hits, parts):
    return f"""{name} AS (SELECT p.query_id, p.subquery_pos, h.rank, h.score, c.*
  FROM {parts} p JOIN {hits} h ON h.t = {D.squash('p.subquery')} JOIN company c USING (chunk_id))"""


def merge(name, hits):
    return f"""{name}_seen AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY subquery_pos, rank) AS n
  FROM {hits}),
{name} AS (SELECT * EXCLUDE (n, d) FROM (SELECT *, row_number() OVER (PARTITION BY query_id, document_name
    ORDER BY subquery_pos, rank) AS d FROM {name}_seen WHERE n = 1) WHERE d <= 3)"""


BASE = [D.QUESTIONS, QQ.DECOMPOSED, DOCS, COMPANY, PARTS, text_hits("th", "part_texts", "company", 10, 0.3),
        expand("hits", "th", "parts")]
MERGED = [*BASE, merge("merged", "hits")]


def rerank(name, source):
    """Re-rank ``source`` whose query_id is the question text."""
    table = " OR ".join(f"contains(x, '{w}')" for w in V.TABLE_WORDS)
    return f"""{name}_words AS (SELECT *, list_distinct(regexp_extract_all(lower(query_id), '{UNIT}')) AS asked_words,
  list_distinct(regexp_extract_all(lower(content), '{UNIT}')) AS found_words,
  list_distinct(regexp_extract_all(lower(section_title), '{UNIT}')) AS title_words,
  len(list_filter(string_split(lower(content), chr(10)), lambda x: ({table}) AND regexp_matches(x, '[\\p{{Nd}}²³¹⁰⁴-⁹₀-₉]')))
    AS table_rows FROM {source}),
{name} AS (SELECT *, CASE WHEN len(asked_words) = 0 THEN score ELSE {D.half_even(f'''
    (score * 0.75::DOUBLE + (CAST(len(list_intersect(asked_words, found_words)) AS DOUBLE) / len(asked_words)) * 0.15::DOUBLE
     + CASE WHEN list_has_any(asked_words, title_words) THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END
     + CASE WHEN section_type IN ('heading', 'title') OR hierarchy_level <= 2 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END
     + CASE WHEN list_has_any(asked_words, {D.qlist(V.NUMBER_TRIGGERS)}) THEN least(0.15::DOUBLE,
         CAST(len(regexp_extract_all(lower(content), '{V.NUMBER_PATTERN}')) AS DOUBLE) * 0.025::DOUBLE) ELSE 0.0::DOUBLE END
     + CASE WHEN table_rows >= 2 THEN 0.18::DOUBLE WHEN table_rows = 1 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END)''', 4)}
  END AS rerank FROM {name}_words)"""


def diversity(name, source, n="5", arrival="pass_no, subquery_pos, rank"):
    return f"""{name}_r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, {arrival}) AS r,
  row_number() OVER (PARTITION BY query_id, document_name ORDER BY rerank DESC, {arrival}) AS d FROM {source}),
{name} AS (SELECT * EXCLUDE (r, d) FROM (SELECT *, row_number() OVER (PARTITION BY query_id
  ORDER BY CASE WHEN r <= {n} // 2 OR d <= 2 THEN 0 ELSE 1 END, r) AS final_rank FROM {name}_r) WHERE final_rank <= {n})"""


RANKED = [*MERGED, "one_pass AS (SELECT *, 1 AS pass_no FROM merged)", rerank("scored", "one_pass"),
          diversity("ranked", "scored")]
PAGE_TEXT = "array_to_string(page_numbers, ', ')"
CITE = (f"document_name || ' Page ' || CASE WHEN len(page_numbers) > 0 THEN {PAGE_TEXT} ELSE '1' END")


def context(name, source, asked):
    text = D.strip("array_to_string(blocks, chr(10))")
    return f"""{name}_taken AS (SELECT *, sum(estimated_tokens) OVER (PARTITION BY query_id ORDER BY final_rank) AS total,
  row_number() OVER (PARTITION BY query_id ORDER BY final_rank) AS place FROM {source}),
{name}_lists AS (SELECT query_id, count(*) AS chunks_used, list('--- Source [' || final_rank || ']: ' || document_name ||
    ' | Page ' || {PAGE_TEXT} || ' | Section: ' || section_title || ' ---' || chr(10) || content || chr(10)
    ORDER BY final_rank) AS blocks, list({CITE} ORDER BY final_rank) AS cites
  FROM {name}_taken WHERE total <= 2000 OR place = 1 GROUP BY 1),
{name}_text AS (SELECT a.t AS query_id, coalesce({text}, '') AS context_text, coalesce(chunks_used, 0) AS chunks_used,
  coalesce({QQ.distinct('cites')}, []::VARCHAR[]) AS sources FROM {asked} a LEFT JOIN {name}_lists l ON l.query_id = a.t),
{name} AS (SELECT *, CASE WHEN context_text = '' THEN 0 ELSE {D.tokens('length(context_text)')} END AS estimated_tokens
  FROM {name}_text)"""


def context_select(name):
    return f"""SELECT query_id, md5(context_text) AS context_md5, chunks_used, estimated_tokens,
{D.half_even('CAST(estimated_tokens AS DOUBLE) / 2000.0::DOUBLE * 100.0::DOUBLE', 2)} AS token_utilization,
{QQ.joined('sources')} FROM {name}"""


def coverage(name, candidates, required):
    proofs = " ".join(f"WHEN '{m}' THEN {D.qlist(t)}" for m, t in V.METRIC_SYNONYMS.items())
    return f"""{name}_need AS (SELECT query_id, unnest(required_metrics) AS m, generate_subscripts(required_metrics, 1) AS i
  FROM {required}),
{name}_proof AS (SELECT *, CASE m {proofs} ELSE [m] END AS terms FROM {name}_need),
{name}_metric AS (SELECT p.query_id, p.m, p.i, coalesce(bool_or(len(list_filter(terms, lambda s: contains(lower(c.content), s))) > 0),
    false) AS ok FROM {name}_proof p LEFT JOIN {candidates} c USING (query_id) GROUP BY 1, 2, 3),
{name}_lists AS (SELECT query_id, list(m ORDER BY m) FILTER (ok) AS found, list(m ORDER BY i) FILTER (NOT ok) AS missing
  FROM {name}_metric GROUP BY 1),
{name}_numbers AS (SELECT query_id, bool_or(regexp_matches(lower(content), '{V.NUMBER_EVIDENCE}')) AS numbers
  FROM {candidates} GROUP BY 1),
{name} AS (SELECT r.query_id, r.required_metrics, coalesce(l.found, []::VARCHAR[]) AS found_metrics,
    coalesce(l.missing, []::VARCHAR[]) AS missing_metrics, coalesce(n.numbers, false) AS has_numbers,
    len(coalesce(l.found, []::VARCHAR[])) >= greatest(1, len(r.required_metrics) // 2) AND coalesce(n.numbers, false)
      AS is_sufficient
  FROM {required} r LEFT JOIN {name}_lists l USING (query_id) LEFT JOIN {name}_numbers n USING (query_id))"""


REQUIRED = ("required AS (SELECT DISTINCT v.nq AS query_id, i.required_metrics FROM intents i JOIN valid v USING (query_id))")
LAST = ["Critical", "Short", "Synthesize"]
PROMPT_TAIL = "\n".join(V.DIRECTIVE_RULES)

# ---- the whole retrieval -------------------------------------------------------------------
# distinct questions take the place of the question table, so every rule table is keyed by text
TEXT_QUESTIONS = D.QUESTIONS.replace("valid AS (", "valid_all AS (") + """,
valid AS (SELECT DISTINCT nq AS query_id, nq, lq FROM valid_all)"""
GUIDED_CONCEPTS = QQ.CONCEPTS.replace(
    f"flatten([{QQ.TAXONOMY}])", f"list_concat(flatten([{QQ.TAXONOMY}]), guide_terms)").replace(
    "FROM concept)", "FROM concept LEFT JOIN guide USING (query_id))")
FULL = D.with_(
    TEXT_QUESTIONS, DOCS, COMPANY, INTERNAL, ASKED, text_hits("gh", "asked_texts", "internal", 4, 0.15),
    f"""guide AS (SELECT t AS query_id, flatten(list(list_transform(regexp_extract_all(content, '{V.GUIDANCE_PATTERN}'),
  lambda t: lower(t)) ORDER BY rank)) AS guide_terms FROM gh JOIN internal USING (chunk_id) GROUP BY 1)""",
    QQ.TEMPORAL, GUIDED_CONCEPTS, QQ.ARCHETYPE, QQ.INTENT, QQ.DECOMPOSED, QQ.PLANNED, QQ.COMBINED,
    f"combined_texts AS (SELECT DISTINCT {D.squash('subquery')} AS t FROM combined)",
    text_hits("th", "combined_texts", "company", 10, 0.3), expand("hits", "th", "combined"), merge("merged", "hits"),
    "required AS (SELECT query_id, required_metrics FROM intents)", coverage("cov", "merged", "required"),
    f"""filled AS (SELECT query_id, {QQ.fallback_sql('CASE WHEN len(missing_metrics) > 0 THEN missing_metrics ELSE required_metrics END')}
  AS l FROM cov WHERE NOT is_sufficient),
again AS (SELECT query_id, generate_subscripts(u, 1) - 1 AS subquery_pos, unnest(u) AS subquery
  FROM (SELECT query_id, {QQ.distinct('l')} AS u FROM filled)),
again_texts AS (SELECT DISTINCT {D.squash('subquery')} AS t FROM again)""",
    text_hits("fh", "again_texts", "company", 10, 0.3), expand("more", "fh", "again"),
    """fresh AS (SELECT * EXCLUDE (n) FROM (SELECT m.*, row_number() OVER (PARTITION BY m.query_id, m.chunk_id
    ORDER BY m.subquery_pos, m.rank) AS n FROM more m ANTI JOIN merged a USING (query_id, chunk_id)) WHERE n = 1),
passes AS (SELECT *, 1 AS pass_no FROM merged UNION ALL SELECT *, 2 FROM fresh),
tops AS (SELECT query_id, greatest(5, """ + QQ.pick(2) + """) AS top_n FROM archetypes),
topped AS (SELECT p.*, t.top_n FROM passes p JOIN tops t USING (query_id))""",
    rerank("scored", "topped"), diversity("ranked", "scored", "top_n"), context("ctx", "ranked", "asked_texts"))

ORACLES = {
    "vector_topk": LABEL_HITS + "SELECT query_id, chunk_id, score, rank FROM label_hits",
    "vector_topk_lsh_recall": LABEL_HITS + """SELECT query_id, count(*) AS exact_hits, true AS scores_exact, true AS few_scored,
true AS recall_reached FROM label_hits GROUP BY query_id""",
    "vector_topk_holes": D.with_(LABEL, label_top(
        "list_dot_product(q, v) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(v, v)))",
        f"WHERE score >= {LOW} AND chunk_id % 7 > 3")) + "SELECT query_id, chunk_id, score, rank FROM label_hits",
    "vector_topk_euclid": D.with_(LABEL, label_top("-list_distance(q, v)", "")) +
    "SELECT query_id, chunk_id, score, rank FROM label_hits",
    "evidence_boundary": LABEL_HITS + "SELECT query_id, chunk_id, rank, document_name FROM label_hits WHERE label <> 0",
    "boundary_audit": LABEL_HITS + "SELECT count(*) AS checked, 0 AS leaks FROM label_hits WHERE label <> 0",
    "diversity_select": D.with_(LABEL, label_top(
        "list_dot_product(q, v) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(v, v)))",
        f"WHERE score >= {LOW}"), """capped AS (SELECT * FROM (SELECT *, row_number() OVER (
  PARTITION BY query_id, document_name ORDER BY rank) AS c FROM label_hits WHERE label <> 0) WHERE c <= 3),
scored AS (SELECT *, score AS rerank FROM capped)""", diversity("ranked", "scored", arrival="rank"))
    + "SELECT query_id, final_rank, chunk_id, document_name, score FROM ranked",
    "embed_queries": D.with_(D.QUESTIONS, ASKED, sparse("qv", "asked_texts", "t", "t"))
    + f"SELECT id AS query_id, b AS pos, {D.half_even('w', 6)} AS x FROM qv",
    "search_filter": D.with_(DOCS) + """SELECT chunk_id, document_id, array_to_string(page_numbers, ',') AS page_numbers
FROM docs WHERE document_type = 'company' AND section_type = 'heading' AND visibility = 'user_visible'""",
    "payload_defaults": D.with_(DOCS, """h AS (SELECT chunk_id, CASE WHEN hierarchy_level = 2 THEN NULL ELSE document_id END AS di,
  CASE WHEN hierarchy_level <> 2 THEN document_name END AS dn,
  CASE WHEN section_type = 'heading' THEN document_id || '.pdf' END AS fn, hierarchy_level = 2 AS sp, * FROM docs)""")
    + """SELECT chunk_id, coalesce(di, 'unknown_doc') AS document_id, coalesce(dn, fn, di, 'unknown_doc') AS document_name,
CASE WHEN sp THEN '' ELSE array_to_string(page_numbers, ',') END AS page_numbers,
CASE WHEN sp THEN 'Untitled Section' ELSE section_title END AS section_title,
CASE WHEN sp THEN 'composite' ELSE section_type END AS section_type,
CASE WHEN sp THEN 2 ELSE hierarchy_level END AS hierarchy_level, CASE WHEN sp THEN chunk_id ELSE 0 END AS reading_order,
CASE WHEN sp THEN estimated_tokens ELSE 0 END AS estimated_tokens,
CASE WHEN sp THEN 'company' ELSE document_type END AS document_type,
CASE WHEN sp AND section_type = 'heading' THEN 'internal' WHEN sp OR document_type = 'company' THEN 'user_visible'
  ELSE 'internal' END AS visibility FROM h""",
    "retrieve_guidance": D.with_(D.QUESTIONS, DOCS, INTERNAL, ASKED, text_hits("gh", "asked_texts", "internal", 4, 0.15))
    + "SELECT t AS query_id, rank, chunk_id, score FROM gh",
    "merge_candidates": D.with_(*MERGED) + """SELECT query_id, subquery_pos, rank, chunk_id, document_name,
array_to_string(page_numbers, ',') AS page_key, score FROM merged""",
    "candidate_counts": D.with_(*MERGED) + "SELECT query_id, document_name, count(*) AS candidates FROM merged GROUP BY 1, 2",
    "check_coverage": D.with_(*MERGED, QQ.INTENT, REQUIRED, coverage("cov", "merged", "required"))
    + f"SELECT query_id, {QQ.joined('found_metrics')}, {QQ.joined('missing_metrics')}, has_numbers, is_sufficient FROM cov",
    "second_pass_merge": D.with_(*BASE, "first_hits AS (SELECT * FROM hits WHERE subquery_pos = 0)",
                                 merge("merged", "first_hits"))
    + """SELECT query_id, 1 AS pass_no, subquery_pos, rank, chunk_id FROM merged UNION ALL
SELECT query_id, 2, subquery_pos, rank, chunk_id FROM (SELECT h.*, row_number() OVER (PARTITION BY h.query_id, h.chunk_id
  ORDER BY h.subquery_pos, h.rank) AS n FROM hits h ANTI JOIN merged m USING (query_id, chunk_id) WHERE h.subquery_pos > 0)
WHERE n = 1""",
    "rerank_score": D.with_(*RANKED) + "SELECT query_id, chunk_id, score, rerank FROM scored",
    "diversity_documents": D.with_(*RANKED) + "SELECT query_id, final_rank, chunk_id, rerank FROM ranked",
    "build_context": D.with_(*RANKED, ASKED, context("ctx", "ranked", "asked_texts")) + context_select("ctx"),
    "format_citation": D.with_(DOCS) + """SELECT chunk_id, document_name || ' Page ' || CASE WHEN hierarchy_level = 2
THEN chunk_id || ', ' || (chunk_id + 1) ELSE '1' END AS citation FROM docs""",
    "build_prompts": D.with_(*RANKED, ASKED, QQ.ARCHETYPE, f"""blocks AS (SELECT query_id, string_agg('Chunk ' || n || chr(10) || 'Doc: ' ||
  document_name || ' | Page(s): ' || {PAGE_TEXT} || ' | Section: ' || section_title || chr(10) || {D.strip('content')},
  chr(10) || chr(10) ORDER BY n) AS body FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_rank) AS n
  FROM ranked) GROUP BY 1),
kinds AS (SELECT DISTINCT v.nq AS query_id, a.archetype FROM archetypes a JOIN valid v USING (query_id))""")
    + f"""SELECT k.query_id, md5(array_to_string([{D.q(R.SYSTEM_TEXT)}, '', '{R.RULE_LINE}',
'Retrieved Context (Company Documents ONLY)', '', coalesce(body, {D.q(V.NO_CONTEXT)}), '', '{R.RULE_LINE}',
{D.q(V.DIRECTIVE_TITLE)}, '- Question Archetype: ' || archetype || ' | Response Profile: ' || {QQ.pick(0)},
{D.q(PROMPT_TAIL)}, '', '{R.RULE_LINE}', 'User Question', k.query_id], chr(10))) AS prompt_md5
FROM kinds k LEFT JOIN blocks b USING (query_id)""",
    "extract_sources": D.with_(*RANKED) + """SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY final_rank)
  AS position, document_name AS document, page_numbers[1] AS page FROM ranked WHERE NOT contains(query_id, 'owner')""",
    "confidence": D.with_(*RANKED) + "SELECT query_id, rerank AS confidence FROM ranked WHERE final_rank = 1",
    "evidence_flags": D.with_(*RANKED) + """SELECT query_id,
bool_or(contains(lower(content), 'est') OR contains(lower(content), 'ownership')) AS ownership_found,
bool_or(contains(lower(content), 'que ') OR contains(lower(content), 'marketing')) AS marketing_found,
array_to_string(list_sort(list_distinct(flatten(list(page_numbers)))), ',') AS pages, count(*) AS n_scores
FROM ranked GROUP BY 1""",
    "retrieve_batch": FULL + context_select("ctx"),
}
