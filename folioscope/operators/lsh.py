"""Approximate top-k search over hash tables of random projections.

Index.  A random rotation of the vector space gives the directions of a table; the signs of a vector along them are its
bucket.  ``lsh_index`` holds one row per vector and table, (length, table_no, bucket, chunk_id), and ``write_index`` lays it
out in folders by table and bucket, so that a search reads the folders it probes only.

Search.  A query probes the buckets of each table in the order of what they cost: a bucket that differs in sign along
some directions is as far off as the query's own components there, so buckets across weak directions come first.  A probed
bucket votes for its vectors with what it agrees; votes of all tables are added per (query, vector) before and after
one shuffle.  Per query the vectors with most votes, ``share`` of all, are scored exactly.  The limit comes from
a histogram of the votes, which are whole numbers of a bounded range.

Vectors and queries that are null, empty or not finite are left out, as are zero queries; a query meets vectors of its
own length.  Results have the columns of ``retrieval.vector_topk`` and the same scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import vocab as V
from folioscope.operators.retrieval import SCORE_DIGITS, finite
from folioscope.session import materialize

TABLES = 24
BITS = 8
PROBES = 128
SHARE = 0.25
VOTE_STEPS = 256  # votes of one table are whole numbers up to this
_ENTRIES = "length int, table_no int, bucket int, chunk_id {kind}"


def directions(dimension: int, table_no: int, bits: int, seed: int) -> np.ndarray:
    """(dimension, bits): orthonormal random directions of a table, more than ``dimension`` of them in several draws."""
    rng = np.random.default_rng([seed, table_no, dimension])
    drawn, have = [], 0
    while have < bits:
        q, _ = np.linalg.qr(rng.standard_normal((dimension, dimension)))
        drawn.append(q)
        have += dimension
    return np.concatenate(drawn, axis=1)[:, :bits]


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=np.float64)


def lsh_index(chunks: DataFrame, tables: int = TABLES, bits: int = BITS, seed: int = 7) -> DataFrame:
    """(length, table_no, bucket, chunk_id) of every usable vector of ``chunks`` in every table."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for length, own in frame.groupby(frame["vector"].map(len)):
                v = _matrix(own["vector"])
                for t in range(tables):
                    code = (v @ directions(int(length), t, bits, seed) > 0) @ (1 << np.arange(bits))
                    yield pd.DataFrame({"length": np.int32(length), "table_no": np.int32(t),
                                        "bucket": code.astype(np.int32), "chunk_id": own["chunk_id"].to_numpy()})

    kind = chunks.schema["chunk_id"].dataType.simpleString()
    return chunks.select("chunk_id", "vector").filter(finite(F.col("vector"))).mapInPandas(run, _ENTRIES.format(kind=kind))


def write_index(index: DataFrame, path: str) -> DataFrame:
    """The index as Parquet in folders by length, table and bucket; it reads back with partition pruning.

    Rows of one folder are spread by their id, so a crowded bucket is written by several tasks.
    """
    (index.withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.lit(8))).repartition("length", "table_no", "bucket", "part")
     .drop("part").write.mode("overwrite").partitionBy("length", "table_no", "bucket").parquet(path))
    return index.sparkSession.read.schema(index.schema).parquet(path)


def probes(queries: DataFrame, tables: int = TABLES, bits: int = BITS, count: int = PROBES, seed: int = 7) -> DataFrame:
    """(query_id, length, table_no, bucket, votes): the ``count`` nearest buckets of each query in each table."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for length, own in frame.groupby(frame["vector"].map(len)):
                v = _matrix(own["vector"])
                v = v / np.linalg.norm(v, axis=1, keepdims=True)
                for t in range(tables):
                    margin = v @ directions(int(length), t, bits, seed)
                    for query, m in zip(own["query_id"], margin, strict=True):
                        bucket, off = nearest_buckets(m, count)
                        # of a unit vector, components along orthonormal directions add up to sqrt(bits) at most
                        votes = np.rint(VOTE_STEPS * (np.abs(m).sum() - off) / np.sqrt(bits))
                        yield pd.DataFrame({"query_id": query, "length": np.int32(length), "table_no": np.int32(t),
                                            "bucket": bucket.astype(np.int32), "votes": votes.astype(np.int32)})

    kind = queries.schema["query_id"].dataType.simpleString()
    return queries.mapInPandas(run, f"query_id {kind}, length int, table_no int, bucket int, votes int")


def nearest_buckets(margin: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` buckets of least cost and their costs, the sum of |margin| where signs differ.

    Bits enter one by one, weakest first, and only the ``count`` best sets of flips are kept, so the work is
    bits * count: a set beyond them stays beyond them when another bit is flipped too.
    """
    own = int((margin > 0) @ (1 << np.arange(len(margin))))
    flips, cost = np.zeros(1, dtype=np.int64), np.zeros(1)
    for b in np.argsort(np.abs(margin), kind="stable"):
        flips = np.concatenate([flips, flips | (1 << int(b))])
        cost = np.concatenate([cost, cost + abs(margin[b])])
        best = np.argsort(cost, kind="stable")[:count]
        flips, cost = flips[best], cost[best]
    return own ^ flips, cost


def candidates(index: DataFrame, asked: DataFrame, sizes: dict[int, int], share: float) -> DataFrame:
    """(query_id, chunk_id): per query the vectors with most votes, at most ``share`` of those of its length."""
    votes = index.join(asked, ["length", "table_no", "bucket"]).groupBy("query_id", "length", "chunk_id").agg(
        F.sum("votes").alias("votes"))
    votes = materialize(votes, "votes")
    # one row per number of votes that occurs, so a query's histogram is bounded by tables * VOTE_STEPS
    level = votes.groupBy("query_id", "length", "votes").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("query_id", "length").orderBy(F.desc("votes"))
    most = F.element_at(F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(max(1, int(share * n))))]),
                        F.col("length"))
    limits = level.withColumn("reached", F.sum("n").over(upto)).filter(F.col("reached") <= most).groupBy(
        "query_id").agg(F.min("votes").alias("least"))
    return votes.join(limits, "query_id").filter(F.col("votes") >= F.col("least")).select("query_id", "chunk_id")


def scored(pairs: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Exact cosine of every pair."""
    sides = pairs.join(chunks.select("chunk_id", "vector"), "chunk_id").join(
        queries.select("query_id", F.col("vector").alias("wanted")), "query_id")
    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in ("query_id", "chunk_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for length in pa.compute.unique(pa.compute.list_value_length(batch.column("vector"))).to_pylist():
                own = table.filter(pa.compute.equal(pa.compute.list_value_length(table["vector"]), length)).combine_chunks()
                a, b = (own[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(
                    own.num_rows, length) for c in ("wanted", "vector"))
                norm = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
                score = (a * b).sum(axis=1) / np.where(norm == 0, 1e-12, norm)
                score = np.rint(score * 10 ** SCORE_DIGITS) / 10 ** SCORE_DIGITS
                for part in own.select(["query_id", "chunk_id"]).append_column("score", pa.array(score)).to_batches():
                    yield part

    return sides.select("query_id", "chunk_id", "wanted", "vector").mapInArrow(run, f"{kinds}, score double")


def lsh_topk(chunks: DataFrame, queries: DataFrame, k: int = V.TOP_K, min_score: float | None = V.MIN_SIMILARITY,
             tables: int = TABLES, bits: int = BITS, count: int = PROBES, share: float = SHARE, seed: int = 7,
             index: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank and pairs_scored (exact scores taken for the query) of the best ``k`` found.

    ``index`` is one made with the same tables, bits and seed, such as ``write_index`` returns; else it is made here.
    """
    nonzero = F.exists("vector", lambda x: x != 0)
    held = chunks.select("chunk_id", "vector").filter(finite(F.col("vector")))
    asked = materialize(queries.select("query_id", "vector").filter(finite(F.col("vector")) & nonzero), "queries")
    made = materialize(lsh_index(held, tables, bits, seed), "lsh-index") if index is None else index
    # lengths are those of the encoders in use: a few rows
    sizes = {r["length"]: r["n"] for r in made.filter("table_no = 0").groupBy("length").agg(F.count("*").alias("n")).collect()}
    kinds = [f"{c} {d.schema[c].dataType.simpleString()}" for c, d in (("query_id", asked), ("chunk_id", chunks))]
    if not sizes:
        return chunks.sparkSession.createDataFrame([], ", ".join([*kinds, "score double, rank int, pairs_scored long"]))
    found = materialize(scored(candidates(made, probes(asked, tables, bits, count, seed), sizes, share), held, asked), "scored")
    work = found.groupBy("query_id").agg(F.count("*").alias("pairs_scored"))
    best = found if min_score is None else found.filter(F.col("score") >= min_score)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.join(work, "query_id").select("query_id", "chunk_id", "score", "rank", "pairs_scored")
