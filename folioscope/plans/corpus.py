"""Pages to chunks to vectors, as one lazy plan per corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.vocab import MAX_TOKENS, MIN_TOKENS, OVERLAP_TOKENS
from folioscope.operators import chunking, indexing
from folioscope.operators.cleaning import clean_pages
from folioscope.operators.structure import SECTION_BLOCK, number_sections, page_sections
from folioscope.operators.scans import row_numbers, running, width_block
from folioscope.session import materialize


def optimize_chunks(chunks: DataFrame, min_tokens: int = MIN_TOKENS,
                    max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Split oversized chunks, merge tiny neighbours, renumber.

    Pieces are written once; numbering and pairing run on sizes only, and the texts are
    joined to the finished numbers.
    """
    pieces = materialize(chunking.split_oversized(chunks, max_tokens).drop("split_chunk"), "pieces", "zstd")
    key = ["document_id", "chunk_order", "piece"]
    dense = materialize(row_numbers(
        pieces.select(*key, "estimated_tokens"), ["document_id"], ["chunk_order", "piece"],
        width_block(F.col("chunk_order"), SECTION_BLOCK), "__n").withColumn(
        "place", F.col("__n") - 1).drop("__n"), "piece-numbers")
    pairs = chunking.merge_pairs(dense.select(
        "document_id", F.col("place").alias("chunk_order"), "estimated_tokens"), min_tokens, max_tokens)
    # a pair is named by its first place, so counting first places renumbers the pairs
    ranked = running(pairs, ["document_id"], ["chunk_order"], width_block(F.col("chunk_order"), SECTION_BLOCK),
                     {"__rank": ("sum", (F.col("chunk_order") == F.col("pair")).cast("long"))})
    named = materialize(dense.select(*key, "place").join(
        ranked.select("document_id", F.col("chunk_order").alias("place"),
                      "pair", (F.col("__rank") - 1).alias("number")), ["document_id", "place"]), "piece-pairs")
    return chunking.join_heads(pieces, named, key, min_tokens).drop("merged")


def chunk_pages(pages: DataFrame, titles: DataFrame | None = None, max_tokens: int = MAX_TOKENS,
                overlap: int = OVERLAP_TOKENS, clean: bool = True, stored: bool = False) -> DataFrame:
    """Raw pages to validated chunks (``reject_reason`` is null for good ones)."""
    # the section pass refers to a page's text once, so cleaning runs in the same pass
    cleaned = clean_pages(pages, stored=stored) if clean else pages
    # page sections feed the packing, the headings and the chunk texts: computed once
    paged = materialize(page_sections(cleaned), "page-sections", "zstd")
    # the section index holds no text
    index = materialize(number_sections(paged).drop("content"), "section-index")
    packed = chunking.semantic_chunks(index, titles, max_tokens, overlap, pages=paged)
    best = optimize_chunks(packed.drop("section_count"), max_tokens=max_tokens)
    return chunking.chunk_ids(chunking.validate_chunks(best, max_tokens))


def payload_pages(pages: DataFrame, document_type: str, created_at: str = "", titles: DataFrame | None = None,
                  stored: bool = False) -> DataFrame:
    """Raw pages to collection rows without vectors.  ``stored`` pages lie in files as they are."""
    chunks = chunking.valid_only(chunk_pages(pages, titles, stored=stored))
    tagged = indexing.tag_dataset(chunks, document_type)
    return indexing.build_payload(
        tagged.withColumn("document_name", F.col("document_id").cast("string")), created_at=created_at)


def index_pages(pages: DataFrame, document_type: str, encoder=None, created_at: str = "",
                titles: DataFrame | None = None) -> DataFrame:
    """Raw pages to collection rows: chunk payload plus unit vector."""
    return indexing.with_vectors(payload_pages(pages, document_type, created_at, titles), encoder)
