"""Registered queries: sources of pages, cleaning, structure, chunking, indexing."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions.text import estimate_tokens, half_even
from folioscope.operators import chunking, cleaning, indexing, structure
from folioscope.plans import corpus, duck as D, inputs as I
from folioscope.session import materialize
from folioscope.sources import pages as P

WHEN = "2026-01-01T00:00:00+00:00"


def pages_text(column="page_numbers"):
    return F.array_join(F.transform(column, lambda p: p.cast("string")), ",").alias(column)


def load_pages(spark, sf):
    """Web pages whose footer stands on a page of its own, behind a form feed."""
    split = F.replace("html", F.lit("<footer"), F.lit("\f<footer"))
    html = P.html_pages(I.text_table(spark, sf, "pages").withColumn("html", split), "page_id", "html")
    return html.select("document_id", "page_number", "raw_char_count", F.md5("text").alias("text_md5"))


def normalize_chars(spark, sf):
    return cleaning.normalize_chars(I.corpus_pages(spark, sf)).select(
        "document_id", "page_number", F.md5("text").alias("text_md5"))


def detect_header_footer(spark, sf):
    return cleaning.detect_header_footer(I.with_banners(I.corpus_pages(spark, sf)))


def strip_header_footer(spark, sf):
    return cleaning.strip_header_footer(I.with_banners(I.corpus_pages(spark, sf))).select(
        "document_id", "page_number", F.md5("text").alias("text_md5"))


def collapse_whitespace(spark, sf):
    return cleaning.collapse_whitespace(I.corpus_pages(spark, sf)).select(
        "document_id", "page_number", F.md5("text").alias("text_md5"))


def clean_pages(spark, sf):
    return cleaning.clean_pages(I.with_banners(I.corpus_pages(spark, sf))).select(
        "document_id", "page_number", "raw_chars", "clean_chars", F.md5("text").alias("text_md5"))


def cleaning_stats(spark, sf):
    return cleaning.cleaning_stats(cleaning.clean_pages(I.with_banners(I.corpus_pages(spark, sf))))


def detect_heading(spark, sf):
    lines = structure.page_lines(I.rendered_pages(spark, sf))
    return structure.detect_heading(lines).filter("is_heading").select(
        "document_id", "page_number", "line_no", "heading_title", "heading_level")


def classify_lines(spark, sf):
    lines = structure.page_lines(I.corpus_pages(spark, sf))
    return structure.classify_lines(lines).select(
        "document_id", "page_number", "line_no", "line_type", "heading_level", F.md5("line").alias("line_md5"))


def sections(spark, sf):
    return structure.segment_sections(I.rendered_pages(spark, sf))


def segment_sections(spark, sf):
    return sections(spark, sf).select("document_id", "page_number", "reading_order", "section_type", "title",
                                      "level", "char_count", F.md5("content").alias("content_md5"))


def build_hierarchy(spark, sf):
    return structure.build_hierarchy(sections(spark, sf)).select(
        "document_id", "reading_order", "level", F.coalesce("parent_order", F.lit(-1)).alias("parent_order"))


def children_and_roots(spark, sf):
    return structure.children_and_roots(structure.build_hierarchy(sections(spark, sf)))


def section_metadata(spark, sf):
    tree = materialize(structure.build_hierarchy(sections(spark, sf)), "tree")
    return structure.section_metadata(tree).withColumn("parent_order", F.coalesce("parent_order", F.lit(-1)))


def document_statistics(spark, sf):
    return structure.document_statistics(I.rendered_pages(spark, sf), sections(spark, sf))


def estimate_tokens_query(spark, sf):
    return I.text_table(spark, sf, "documents").select("doc_id", estimate_tokens(F.col("text")).alias("tokens"))


def semantic_chunks(spark, sf):
    paged = materialize(structure.page_sections(I.rendered_pages(spark, sf)), "page-sections")
    index = materialize(structure.number_sections(paged).drop("content"), "section-index")
    found = chunking.semantic_chunks(index, pages=paged)
    return found.select("document_id", "chunk_order", pages_text(), "section_title", "section_type",
                        "hierarchy_level", "estimated_tokens", "section_count", F.md5("content").alias("content_md5"))


def _document_chunks(spark, sf):
    return I.document_chunks(spark, sf).select(
        F.col("chunk_id").cast("string").alias("document_id"), F.lit(0).alias("chunk_order"), "page_numbers",
        "section_title", "section_type", "hierarchy_level", "content", estimate_tokens(F.col("content")).alias(
            "estimated_tokens"))


def split_oversized(spark, sf):
    return chunking.split_oversized(_document_chunks(spark, sf)).select(
        "document_id", "piece", "split_chunk", "estimated_tokens", F.md5("content").alias("content_md5"))


def _turn_chunks(spark, sf):
    turns = I.table(spark, sf, "conversations")
    return turns.select(
        F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_order"),
        F.array(F.col("turn").cast("int")).alias("page_numbers"), F.col("role").alias("section_title"),
        F.col("role").alias("section_type"), F.length("role").alias("hierarchy_level"),
        F.col("text").alias("content"), estimate_tokens(F.col("text")).alias("estimated_tokens"))


def merge_tiny(spark, sf):
    return chunking.merge_tiny(_turn_chunks(spark, sf)).select(
        "document_id", "chunk_order", pages_text(), "section_title", "section_type", "hierarchy_level",
        "merged", "estimated_tokens", F.md5("content").alias("content_md5"))


def reindex_chunks(spark, sf):
    merged = chunking.merge_tiny(_turn_chunks(spark, sf)).withColumnRenamed("chunk_order", "pair")
    return chunking.reindex_chunks(merged, ["pair"]).select("document_id", "chunk_order", "estimated_tokens")


def validate_chunks(spark, sf):
    checked = chunking.validate_chunks(_document_chunks(spark, sf).withColumn(
        "page_numbers", F.when(F.col("section_type") == "paragraph", F.col("page_numbers")).otherwise(
            F.array().cast("array<int>"))))
    return checked.select("document_id", "reject_reason", "estimated_tokens")


def chunk_statistics(spark, sf):
    chunks = I.document_chunks(spark, sf).withColumn("char_count", F.length("content"))
    return chunking.chunk_statistics(chunks, ["document_id"])


def chunk_corpus(spark, sf):
    return corpus.chunk_pages(I.rendered_pages(spark, sf), clean=False).select(
        "document_id", "chunk_order", pages_text(), "section_title", "section_type", "hierarchy_level",
        "estimated_tokens", "reject_reason", F.md5("content").alias("content_md5"))


def chunk_documents(spark, sf):
    """The whole pipeline, from pages with headers and footers."""
    return corpus.chunk_pages(I.with_banners(I.rendered_pages(spark, sf))).select(
        "document_id", "chunk_order", pages_text(), "section_title", "section_type", "hierarchy_level",
        "estimated_tokens", "reject_reason", F.md5("content").alias("content_md5"))


def embed_chunks(spark, sf):
    vectors = indexing.embed_chunks(I.document_chunks(spark, sf))
    return vectors.select("chunk_id", "dimension", "normalized", F.array_join(F.transform(
        "vector", lambda x: x.cast("int").cast("string")), ",").alias("vector"))


def batch_ids(spark, sf):
    return indexing.batch_ids(I.table(spark, sf, "embeddings").select("vec_id"), 32)


def l2_normalize(spark, sf):
    raw = I.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.transform(
            "embedding", lambda x: (x * (F.col("label") + 1)).cast("float")).alias("vector"))
    unit = indexing.l2_normalize(raw)
    return unit.select("chunk_id", F.posexplode("vector").alias("pos", "x")).select(
        "chunk_id", "pos", half_even(F.col("x").cast("double"), 6).alias("x"))


def build_payload(spark, sf):
    chunks = I.document_chunks(spark, sf).withColumn("document_type", F.when(
        F.col("hierarchy_level") == 2, F.col("document_type")).otherwise("")).withColumn(
        "document_name", F.when(F.col("section_type") == "heading", F.concat("document_id", F.lit("_Guide.pdf"))))
    return indexing.build_payload(chunks, created_at=WHEN).select(
        "chunk_id", "document_id", "document_name", "document_type", "visibility", "source_type", "page_start",
        "page_end", "section_type", "hierarchy_level", "reading_order", "estimated_tokens", "character_count",
        "version", "created_at")


def _pairing(spark, sf):
    payload = indexing.build_payload(I.document_chunks(spark, sf), created_at=WHEN)
    vectors = I.vector_chunks(spark, sf).select("chunk_id", "vector")
    return payload, vectors


def pair_chunks_vectors(spark, sf):
    payload, vectors = _pairing(spark, sf)
    return indexing.pair_chunks_vectors(payload, vectors).select("chunk_id", "document_name", "dimension")


def pairing_audit(spark, sf):
    return indexing.pairing_audit(*_pairing(spark, sf))


def index_summary(spark, sf):
    return indexing.index_summary(indexing.pair_chunks_vectors(*_pairing(spark, sf)))


def tag_dataset(spark, sf):
    return indexing.tag_dataset(I.document_chunks(spark, sf), F.col("document_type")).groupBy(
        "document_type", "visibility").agg(F.count("*").alias("chunks"))


def index_corpus(spark, sf):
    rows = corpus.index_pages(I.with_banners(I.rendered_pages(spark, sf)), "company", created_at=WHEN)
    return rows.select("document_name", "document_type", "visibility", "reading_order", "page_start", "page_end",
                       "section_type", "estimated_tokens", "character_count", "dimension",
                       F.md5("content").alias("content_md5"))


QUERIES = {
    "load_pages": load_pages, "normalize_chars": normalize_chars, "detect_header_footer": detect_header_footer,
    "strip_header_footer": strip_header_footer, "collapse_whitespace": collapse_whitespace,
    "clean_pages": clean_pages, "cleaning_stats": cleaning_stats, "detect_heading": detect_heading,
    "classify_lines": classify_lines, "segment_sections": segment_sections, "build_hierarchy": build_hierarchy,
    "children_and_roots": children_and_roots, "section_metadata": section_metadata,
    "document_statistics": document_statistics, "estimate_tokens": estimate_tokens_query,
    "semantic_chunks": semantic_chunks, "split_oversized": split_oversized, "merge_tiny": merge_tiny,
    "reindex_chunks": reindex_chunks, "validate_chunks": validate_chunks, "chunk_statistics": chunk_statistics,
    "chunk_corpus": chunk_corpus, "chunk_documents": chunk_documents, "embed_chunks": embed_chunks,
    "batch_ids": batch_ids, "l2_normalize": l2_normalize, "build_payload": build_payload,
    "pair_chunks_vectors": pair_chunks_vectors, "pairing_audit": pairing_audit, "index_summary": index_summary,
    "tag_dataset": tag_dataset, "index_corpus": index_corpus,
}

PT = "array_to_string(page_numbers, ',') AS page_numbers"
DOCS = f"""docs AS (
  SELECT doc_id AS chunk_id, source AS document_id, source AS document_name, [doc_id] AS page_numbers,
    string_split(text, {D.NL})[1] AS section_title,
    CASE WHEN length(text) < 400 THEN 'heading' ELSE 'paragraph' END AS section_type,
    CASE WHEN lang = 'en' THEN 2 ELSE 4 END AS hierarchy_level, text AS content,
    {D.tokens('length(text)')} AS estimated_tokens,
    CASE WHEN lang = 'de' THEN 'instruction' ELSE 'company' END AS document_type,
    CASE WHEN lang = 'de' THEN 'internal' ELSE 'user_visible' END AS visibility
  FROM documents)"""
DOC_CHUNKS = DOCS + f""",
doc_chunks AS (
  SELECT CAST(chunk_id AS VARCHAR) AS document_id, 0 AS chunk_order, page_numbers, section_title, section_type,
    hierarchy_level, content, {D.estimate('content')} AS estimated_tokens FROM docs)"""
TURNS = f"""turns AS (
  SELECT conv_id AS document_id, turn AS n, [turn] AS page_numbers, role AS section_title, role AS section_type,
    length(role) AS hierarchy_level, text AS content, {D.estimate('text')} AS tok FROM conversations)"""
CLEAN = D.with_(D.BANNER_CORPUS, D.HEADERS, D.CLEANED)

HTML = "replace(html, '<footer', chr(12) || '<footer')"
for pattern, to in ((r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>", "''"), (r"(?s)<!--.*?-->", "''"),
                    (r"(?i)<br\s*/?>|</(p|div|h[1-6]|li|tr)>", D.NL), (r"<[^>]*>", "''")):
    HTML = f"regexp_replace({HTML}, '{pattern}', {to}, 'g')"
for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
    HTML = f"replace({HTML}, '{entity}', '{char}')"

ORACLES = {
    "load_pages": f"""SELECT page_id AS document_id, i AS page_number, length(t) AS raw_char_count, md5(t) AS text_md5
FROM (SELECT page_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS i
      FROM (SELECT page_id, string_split({HTML}, chr(12)) AS ts FROM pages))""",
    "normalize_chars": D.with_(D.CORPUS) + f"""SELECT document_id, page_number,
md5(array_to_string({D.unix_lines('text')}, {D.NL})) AS text_md5 FROM corpus""",
    "detect_header_footer": D.with_(D.BANNER_CORPUS, D.HEADERS)
    + "SELECT document_id, kind, line, occurrences, pages FROM repeated",
    "strip_header_footer": D.with_(D.BANNER_CORPUS, D.HEADERS, "rep AS (SELECT document_id, list(DISTINCT line) AS rep "
                                   "FROM repeated GROUP BY 1)") + f"""SELECT document_id, page_number,
md5(array_to_string(list_filter(string_split(text, {D.NL}), lambda x: NOT list_contains(
  coalesce(rep, []::VARCHAR[]), {D.squash('x')})), {D.NL})) AS text_md5 FROM corpus LEFT JOIN rep USING (document_id)""",
    "collapse_whitespace": D.with_(D.CORPUS) + f"""SELECT document_id, page_number,
md5({D.collapse("regexp_replace(text, '[ \\t]+', ' ', 'g')")}) AS text_md5 FROM corpus""",
    "clean_pages": CLEAN + "SELECT document_id, page_number, raw_chars, length(text) AS clean_chars, "
    "md5(text) AS text_md5 FROM cleaned",
    "cleaning_stats": CLEAN + """SELECT document_id, CAST(sum(raw_chars) AS BIGINT) AS raw_chars,
CAST(sum(length(text)) AS BIGINT) AS clean_chars, CAST(sum(raw_chars) - sum(length(text)) AS BIGINT) AS chars_removed,
CASE WHEN sum(raw_chars) > 0 THEN
  round_even(CAST(sum(raw_chars) - sum(length(text)) AS DOUBLE) / CAST(sum(raw_chars) AS DOUBLE) * 100.0::DOUBLE
             * 100.0::DOUBLE, 0) / 100.0::DOUBLE
ELSE 0.0 END AS removed_pct FROM cleaned GROUP BY 1""",
    "detect_heading": D.STRUCTURE + "SELECT document_id, page_number, line_no, heading_title, heading_level "
    "FROM typed WHERE is_heading",
    "classify_lines": D.with_(D.CORPUS, D.lines_of("corpus"), D.TYPED) + "SELECT document_id, page_number, line_no, "
    "line_type, heading_level, md5(line) AS line_md5 FROM typed",
    "segment_sections": D.STRUCTURE + """SELECT document_id, page_number, reading_order, section_type, title, level,
length(content) AS char_count, md5(content) AS content_md5 FROM sections""",
    "build_hierarchy": D.STRUCTURE + "SELECT document_id, reading_order, level, coalesce(parent_order, -1) "
    "AS parent_order FROM tree",
    "children_and_roots": D.STRUCTURE + """SELECT document_id, coalesce(parent_order, -1) AS parent_order,
reading_order AS child_order, row_number() OVER (PARTITION BY document_id, parent_order ORDER BY reading_order) - 1
  AS child_position, parent_order IS NULL AS is_root FROM tree""",
    "section_metadata": D.STRUCTURE + """SELECT t.document_id, t.page_number, t.title AS section_title, t.section_type,
t.level AS hierarchy_level, t.reading_order, length(t.content) AS character_count,
coalesce(t.parent_order, -1) AS parent_order, t.parent_order IS NOT NULL AS has_parent,
coalesce(c.n, 0) AS child_count FROM tree t LEFT JOIN
(SELECT document_id, parent_order, count(*) AS n FROM tree GROUP BY 1, 2) c
ON c.document_id = t.document_id AND c.parent_order = t.reading_order""",
    "document_statistics": D.STRUCTURE + f"""SELECT p.document_id, p.total_pages,
count(s.reading_order) AS total_sections,
count(*) FILTER (s.section_type = 'heading') AS total_headings,
count(*) FILTER (s.section_type = 'paragraph') AS total_paragraphs,
count(*) FILTER (s.section_type = 'list') AS total_lists,
count(*) FILTER (s.section_type = 'table') AS total_tables,
CAST(coalesce(sum(length(s.content)), 0) AS BIGINT) AS total_characters,
CASE WHEN count(s.reading_order) > 0 THEN
  {D.half_even('CAST(sum(length(s.content)) AS DOUBLE) / count(s.reading_order)', 2)} ELSE 0.0 END
  AS average_section_length
FROM (SELECT document_id, count(*) AS total_pages FROM rendered GROUP BY 1) p
LEFT JOIN sections s USING (document_id) GROUP BY 1, 2""",
    "estimate_tokens": f"SELECT doc_id, {D.estimate('text')} AS tokens FROM documents",
    "semantic_chunks": D.with_(D.RENDERED, D.lines_of("rendered"), D.TYPED, D.SECTIONS, D.PACK)
    + f"""SELECT document_id, chunk_order, {PT}, section_title, section_type, hierarchy_level, estimated_tokens,
section_count, md5(content) AS content_md5 FROM semantic""",
    "split_oversized": D.with_(DOC_CHUNKS, D.split_ctes("doc_chunks")) + f"""SELECT document_id, piece, split_chunk,
{D.estimate('content')} AS estimated_tokens, md5(content) AS content_md5 FROM pieces""",
    "merge_tiny": D.with_(TURNS, D.merge_ctes("turns")) + f"""SELECT document_id, n AS chunk_order, {PT},
section_title, section_type, hierarchy_level, merged, {D.estimate('content')} AS estimated_tokens,
md5(content) AS content_md5 FROM merged""",
    "reindex_chunks": D.with_(TURNS, D.merge_ctes("turns"), D.FINAL_CHUNKS)
    + "SELECT document_id, chunk_order, estimated_tokens FROM final",
    "validate_chunks": D.with_(DOC_CHUNKS) + f"""SELECT document_id, CASE
WHEN NOT regexp_matches(content, '{D.NWS}') THEN 'empty_content' WHEN document_id = '' THEN 'missing_document_id'
WHEN section_type <> 'paragraph' THEN 'missing_page_numbers' WHEN section_title = '' THEN 'missing_section_title'
WHEN estimated_tokens > 512 THEN 'too_many_tokens' END AS reject_reason, estimated_tokens FROM doc_chunks""",
    "chunk_statistics": D.with_(DOCS) + f"""SELECT document_id, count(*) AS total_chunks,
{D.half_even('CAST(sum(length(content)) AS DOUBLE) / count(*)', 2)} AS average_chunk_size,
max(length(content)) AS largest_chunk, min(length(content)) AS smallest_chunk,
{D.half_even('CAST(sum(estimated_tokens) AS DOUBLE) / count(*)', 2)} AS average_tokens,
CAST(sum(estimated_tokens) AS BIGINT) AS total_tokens FROM docs GROUP BY 1""",
    "chunk_corpus": D.CHUNK_CTES + f"""SELECT document_id, chunk_order, {PT}, section_title, section_type,
hierarchy_level, estimated_tokens, CASE WHEN estimated_tokens > 512 THEN 'too_many_tokens' END AS reject_reason,
md5(content) AS content_md5 FROM final""",
    "chunk_documents": D.CLEAN_CHUNK_CTES + f"""SELECT document_id, chunk_order, {PT}, section_title, section_type,
hierarchy_level, estimated_tokens, CASE WHEN estimated_tokens > 512 THEN 'too_many_tokens' END AS reject_reason,
md5(content) AS content_md5 FROM final""",
    "index_corpus": D.CLEAN_CHUNK_CTES + """SELECT document_id AS document_name, 'company' AS document_type,
'user_visible' AS visibility, chunk_order AS reading_order, list_min(page_numbers) AS page_start,
list_max(page_numbers) AS page_end, section_type, estimated_tokens, char_count AS character_count, 384 AS dimension,
md5(content) AS content_md5 FROM final WHERE estimated_tokens <= 512""",
    "embed_chunks": """WITH hashed AS (
  SELECT doc_id, CAST(('0x' || substr(md5(w), 1, 8)) AS BIGINT) % 384 AS b
  FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM documents)),
counted AS (SELECT doc_id, b, count(*) AS n FROM hashed GROUP BY 1, 2)
SELECT d.doc_id AS chunk_id, 384 AS dimension, false AS normalized,
  string_agg(CAST(coalesce(n, 0) AS VARCHAR), ',' ORDER BY r.i) AS vector
FROM documents d CROSS JOIN range(384) r(i) LEFT JOIN counted c ON c.doc_id = d.doc_id AND c.b = r.i GROUP BY 1""",
    "batch_ids": "SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1) // 32 AS batch_id FROM embeddings",
    "l2_normalize": f"""WITH raw AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x * (label + 1)::FLOAT AS FLOAT)) AS v FROM embeddings),
normed AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM raw)
SELECT chunk_id, pos, {D.half_even('x', 6)} AS x FROM (
  SELECT vec_id AS chunk_id, generate_subscripts(v, 1) - 1 AS pos,
    unnest(list_transform(v, lambda x: (x::DOUBLE / n)::FLOAT)) AS x FROM normed)""",
    "build_payload": D.with_(DOCS) + f"""SELECT chunk_id, document_id, name AS document_name, kind AS document_type,
CASE WHEN kind = 'company' THEN 'user_visible' ELSE 'internal' END AS visibility,
CASE WHEN kind = 'company' THEN 'official_company_document' ELSE 'analytical_instruction' END AS source_type,
chunk_id AS page_start, chunk_id AS page_end, section_type, hierarchy_level, chunk_id AS reading_order,
estimated_tokens, length(content) AS character_count, '1.0' AS version, '{WHEN}' AS created_at
FROM (SELECT *, CASE WHEN hierarchy_level = 2 THEN document_type
        WHEN contains(lower(name), 'instruction') OR contains(lower(name), 'guide') THEN 'instruction'
        ELSE 'company' END AS kind
      FROM (SELECT *, CASE WHEN section_type = 'heading' THEN document_id || '_Guide.pdf'
                      ELSE 'Document_' || substr(document_id, 1, 8) END AS name FROM docs))""",
    "pair_chunks_vectors": "SELECT d.doc_id AS chunk_id, d.source AS document_name, len(e.embedding) AS dimension "
    "FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id",
    "pairing_audit": "SELECT coalesce(d.doc_id, e.vec_id) AS chunk_id, CASE WHEN e.vec_id IS NULL THEN 'no_vector' "
    "ELSE 'no_chunk' END AS problem FROM documents d FULL JOIN embeddings e ON e.vec_id = d.doc_id "
    "WHERE d.doc_id IS NULL OR e.vec_id IS NULL",
    "index_summary": "SELECT count(DISTINCT d.source) AS documents_indexed, count(*) AS chunks_indexed, "
    "count(e.embedding) AS vectors_uploaded, max(len(e.embedding)) AS embedding_dimension "
    "FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id",
    "tag_dataset": D.with_(DOCS) + "SELECT document_type, visibility, count(*) AS chunks FROM docs GROUP BY 1, 2",
}
