"""Vectors and payload rows of chunks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import vocab as V
from folioscope.functions.text import let
from folioscope.operators.scans import row_numbers, width_block

# An encoder maps batches of texts to batches of vectors.  It is a generator function, so
# a model is loaded once per Python worker, before the first batch.
Encoder = Callable[[Iterator[pd.Series]], Iterator[pd.Series]]
SLICE_CHARS = 1 << 20   # characters of the texts (and components of the vectors) encoded at once


def hashing_encoder(dimension: int = V.EMBEDDING_DIMENSION) -> Encoder:
    """Word counts hashed into ``dimension`` buckets; needs no model weights.

    A batch is taken in slices of about ``SLICE_CHARS`` characters, so that a task's memory does not grow with its
    texts; a slice hashes each of its distinct words once and counts all buckets at once.
    """
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        @lru_cache(maxsize=200_000)
        def bucket(word: str) -> int:
            return int(hashlib.md5(word.encode("utf-8")).hexdigest()[:8], 16) % dimension

        word = re.compile(r"\w+")

        def slices(batch: pd.Series) -> Iterator[list]:
            held, size = [], 0
            for text in batch:
                held.append(text or "")
                size += len(held[-1]) + dimension
                if size >= SLICE_CHARS:
                    yield held
                    held, size = [], 0
            if held:
                yield held

        def counted(own: list) -> np.ndarray:
            words = [word.findall(text.lower()) for text in own]
            row = np.repeat(np.arange(len(words)), [len(w) for w in words])
            flat = np.empty(len(row), dtype=object)
            flat[:] = [w for own in words for w in own]
            codes, names = pd.factorize(flat)
            place = np.fromiter(map(bucket, names), dtype=np.int64, count=len(names))
            counts = np.bincount(row * dimension + place[codes] if len(row) else row, minlength=len(words) * dimension)
            return counts.reshape(len(words), dimension).astype(np.float32)

        for batch in texts:
            yield pd.Series([vector for own in slices(batch) for vector in counted(own)], dtype=object)

    return encode


def encode_text(text: Column, encoder: Encoder | None = None) -> Column:
    """Vector of a text column through an iterator pandas UDF.

    It is marked as not deterministic, which keeps a filter on the vector above it: moved below, it would encode every text twice.
    """
    run = encoder or hashing_encoder()

    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from run(batches)

    return F.pandas_udf(encode, "array<float>").asNondeterministic()(text)


def embed_chunks(chunks: DataFrame, encoder: Encoder | None = None, chunk_id: str = "chunk_id",
                 text: str = "content") -> DataFrame:
    """(chunk_id, vector, dimension, normalized=false) per chunk."""
    return (chunks.select(chunk_id, encode_text(F.col(text), encoder).alias("vector"))
            .select(chunk_id, "vector", F.size("vector").alias("dimension"),
                    F.lit(False).alias("normalized")))


def with_vectors(chunks: DataFrame, encoder: Encoder | None = None, text: str = "content") -> DataFrame:
    """Chunks with their unit ``vector`` and its ``dimension`` in the same row: nothing is joined or shuffled."""
    raw = chunks.withColumn("vector", encode_text(F.col(text), encoder)).withColumn("dimension", F.size("vector"))
    return l2_normalize(raw).drop("normalized")


def batch_ids(chunks: DataFrame, size: int, order: str = "vec_id", width: int = 100_000) -> DataFrame:
    """Consecutive groups of ``size`` rows along an integer key, numbered without a global sort."""
    if size <= 0:
        raise ValueError("batch size must be positive")
    numbered = row_numbers(chunks, [], [order], width_block(F.col(order), width), "__n")
    return numbered.withColumn("batch_id", F.floor((F.col("__n") - 1) / F.lit(size)).cast("long")
                               ).drop("__n")


def vector_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def l2_normalize(vectors: DataFrame, vector: str = "vector") -> DataFrame:
    """Unit vectors; a zero vector is divided by 1e-12."""
    norm = vector_norm(F.col(vector))
    length = F.when(norm == 0, F.lit(1e-12)).otherwise(norm)
    unit = let(length, lambda n: F.transform(vector, lambda x: (x.cast("double") / n).cast("float")))
    return vectors.withColumn(vector, unit).withColumn("normalized", F.lit(True))


def document_type_of(name: Column) -> Column:
    lower = F.lower(name)
    return F.when(F.contains(lower, F.lit("instruction")) | F.contains(lower, F.lit("guide")),
                  V.INSTRUCTION).otherwise(V.COMPANY)


def visibility_of(document_type: Column) -> Column:
    return F.when(document_type == V.COMPANY, V.USER_VISIBLE).otherwise(V.INTERNAL)


def build_payload(chunks: DataFrame, created_at: str = "", version: str = V.PAYLOAD_VERSION
                  ) -> DataFrame:
    """Payload columns of a collection row.

    ``document_name``, ``filename`` and ``document_type`` columns are used when present.
    ``created_at`` is a job argument, so a re-run writes identical rows.
    """
    def given(name):
        value = F.col(name) if name in chunks.columns else F.lit(None).cast("string")
        return F.when(value != "", value)

    pages = F.when(F.size("page_numbers") > 0, F.col("page_numbers"))
    name = F.coalesce(given("document_name"), given("filename"), F.concat(
        F.lit("Document_"), F.substring(F.col("document_id").cast("string"), 1, 8)))
    named = chunks.withColumn("__name", name)
    kind = F.coalesce(given("document_type"), document_type_of(F.col("__name")))
    typed = named.withColumn("__type", kind)
    return typed.select(
        "chunk_id", "document_id", F.col("__name").alias("document_name"),
        F.col("__type").alias("document_type"), visibility_of(F.col("__type")).alias("visibility"),
        F.when(F.col("__type") == V.COMPANY, V.SOURCE_TYPES[V.COMPANY])
        .otherwise(V.SOURCE_TYPES[V.INSTRUCTION]).alias("source_type"),
        F.coalesce(F.array_min(pages), F.lit(1)).alias("page_start"),
        F.coalesce(F.array_max(pages), F.lit(1)).alias("page_end"),
        "page_numbers", "section_title", "section_type", "hierarchy_level",
        F.col("chunk_order").alias("reading_order"), "estimated_tokens",
        F.length("content").alias("character_count"), "content",
        F.lit(version).alias("version"), F.lit(created_at).alias("created_at"))


def pair_chunks_vectors(payload: DataFrame, vectors: DataFrame) -> DataFrame:
    """Payload rows with vectors made elsewhere, joined by chunk id; ``pairing_audit`` lists what finds no partner."""
    return payload.join(vectors.select("chunk_id", "vector", F.size("vector").alias("dimension")),
                        "chunk_id")


def pairing_audit(payload: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks without a vector and vectors without a chunk."""
    left = payload.select("chunk_id", F.lit(True).alias("__p"))
    right = vectors.select("chunk_id", F.lit(True).alias("__v"))
    return (left.join(right, "chunk_id", "full").filter("__p is null or __v is null")
            .select("chunk_id", F.when(F.col("__v").isNull(), "no_vector").otherwise("no_chunk")
                    .alias("problem")))


def index_summary(collection: DataFrame) -> DataFrame:
    """Documents, chunks, vectors and dimension of indexed rows."""
    return collection.agg(
        F.countDistinct("document_id").alias("documents_indexed"),
        F.count("*").alias("chunks_indexed"), F.count("vector").alias("vectors_uploaded"),
        F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("embedding_dimension"))


def tag_dataset(chunks: DataFrame, document_type: str | Column) -> DataFrame:
    """Stamp document type and visibility."""
    kind = F.lit(document_type) if isinstance(document_type, str) else document_type
    return chunks.withColumn("document_type", kind).withColumn(
        "visibility", visibility_of(F.col("document_type")))
