"""Helpers shared by the training-data operators.

The contracts' words are maximal runs of anything but blank, tab, line feed, vertical tab, form feed and return.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
CHUNK_CHARS = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(modulus: int, remainder: int, doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus)) == remainder,
                      F.lit(False))


def schema_of(df: DataFrame, *columns: str) -> T.StructType:
    return T.StructType([df.schema[c] for c in columns])


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch whose texts stay near ``limit`` bytes, so that memory does not depend on text lengths."""
    sizes = np.array([0 if v is None else v for v in
                      pa.compute.binary_length(batch.column(column)).to_pylist()], dtype=np.int64)
    cut = np.cumsum(sizes) // limit
    edges = np.flatnonzero(np.diff(cut)) + 1
    for start, stop in zip([0, *edges], [*edges, batch.num_rows], strict=True):
        if stop > start:
            yield batch.slice(start, stop - start)


def map_texts(df: DataFrame, fn: Callable, schema: T.StructType, column: str = "text") -> DataFrame:
    """Run ``fn(batch) -> batch or None`` over bounded pieces of ``df`` in every task."""
    def run(batches):
        for batch in batches:
            for piece in slices(batch, column):
                out = fn(piece)
                if out is not None and out.num_rows:
                    yield out
    return df.mapInArrow(run, schema)


def ranked(df: DataFrame, keys: list[str], order: list[str], weights: list[str], name: str = "ranks") -> DataFrame:
    """Add ``before_<w>`` for every integer column w of ``weights``: its sum over the rows that precede in ``order``.

    Sums start anew for every value of ``keys``.  Rows are cut into ranges of (keys, order), so a key that holds most
    rows is spread over many tasks; a task sums its own range, one total per (range, key) gives the offsets.  The
    ranges are written once: they come from a sample and must not be drawn twice.  Rows equal in ``order`` are taken
    in any order.
    """
    ranges = df.withColumn("_tie", F.monotonically_increasing_id())
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    by = [*keys, *order, "_tie"]
    ranges = ranges.repartitionByRange(n, *by).sortWithinPartitions(*by).drop("_tie")
    ranges = ranges.withColumn("_range", F.spark_partition_id())
    schema = T.StructType([*ranges.schema.fields, *[T.StructField(f"before_{w}", T.LongType()) for w in weights]])

    def walk(batches):
        last, totals = object(), [0] * len(weights)
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in keys]
            values = [batch.column(w).to_numpy(zero_copy_only=False).astype(np.int64) for w in weights]
            here = list(zip(*columns, strict=True)) if columns else [()] * batch.num_rows
            starts = [i for i in range(len(here)) if i == 0 or here[i] != here[i - 1]]
            local = [np.empty(len(here), dtype=np.int64) for _ in weights]
            for a, b in zip(starts, [*starts[1:], len(here)], strict=True):
                if here[a] != last:
                    last, totals = here[a], [0] * len(weights)
                for j, v in enumerate(values):
                    sums = np.cumsum(v[a:b])
                    local[j][a:b] = totals[j] + sums - v[a:b]
                    totals[j] += int(sums[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, local)],
                                             names=[*batch.schema.names, *[f"before_{w}" for w in weights]])

    local = materialize(ranges.mapInArrow(walk, schema), name)
    totals = local.groupBy("_range", *keys).agg(*[F.sum(w).alias(f"_sum_{w}") for w in weights])
    window = Window.partitionBy(*[F.col(k) for k in keys]).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("_range").alias("_r"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                            *[F.coalesce(F.sum(f"_sum_{w}").over(window), F.lit(0)).alias(f"_from_{w}")
                              for w in weights])
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return local.join(offsets, same).select(
        *df.columns, *[(F.col(f"before_{w}") + F.col(f"_from_{w}")).alias(f"before_{w}") for w in weights])


def row_keys(df: DataFrame) -> DataFrame:
    """``_values``, the row as a struct, with non-null ``_id`` and ``_row``, which are equal for equal rows only.

    Packing the row keeps its own columns apart from those that an operator adds, whatever their names.
    """
    return df.select(F.coalesce(df["doc_id"].cast("long"), F.lit(0)).alias("_id"),
                     F.xxhash64(*[df[c] for c in df.columns]).alias("_row"),
                     F.struct(*[df[c] for c in df.columns]).alias("_values"))


def distinct_rows(marked: DataFrame) -> DataFrame:
    """One row per (_id, _row); equal rows are combined before the shuffle."""
    return marked.groupBy("_id", "_row").agg(F.first("_values").alias("_values"))


def keep_texts(df: DataFrame, keep: Callable[[list], list[bool]]) -> DataFrame:
    """The rows whose text passes ``keep``, judged where they lie."""
    return map_texts(df, lambda batch: batch.filter(pa.array(keep(batch.column("text").to_pylist()), pa.bool_())),
                     df.schema)
