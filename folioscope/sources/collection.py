"""The vector collection: table operations and a Parquet store on shared storage.

The functions work on any two DataFrames.  :class:`CollectionStore` keeps the points as Parquet
in folders by document type and document bucket and replaces the folders that a change touches.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions import vocab as V

METRICS = {"cosine": "Cosine", "euclid": "Euclid", "dot": "Dot"}


def collection_metric(name: Column) -> Column:
    """Canonical metric name; unknown names mean cosine."""
    lower = F.lower(name)
    out = F.lit(METRICS["cosine"])
    for key, value in METRICS.items():
        out = F.when(lower == key, value).otherwise(out)
    return out


def collection_upsert(base: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Insert or replace by key; later rows of ``new`` are expected to be unique by key."""
    return base.join(new.select(key), key, "left_anti").unionByName(new.select(*base.columns))


def collection_delete_document(base: DataFrame, documents: DataFrame) -> DataFrame:
    """Remove every row of the listed document ids."""
    return base.join(documents.select("document_id").distinct(), "document_id", "left_anti")


def collection_reset(base: DataFrame, new: DataFrame, document_type: str) -> DataFrame:
    """Replace one document type and keep the others."""
    return base.filter(F.col("document_type") != document_type).unionByName(
        new.filter(F.col("document_type") == document_type).select(*base.columns))


def collection_info(collection: DataFrame, expected: list[str] | None = None,
                    existing: list[str] | None = None) -> DataFrame:
    """Status and point count per document type.

    ``expected`` types without rows are NOT_FOUND unless listed in ``existing``.
    """
    counts = collection.groupBy("document_type").agg(F.count("*").alias("points_count"))
    if expected:
        names = collection.sparkSession.createDataFrame([(n,) for n in expected], "document_type string")
        counts = names.join(counts, "document_type", "full")
    points = F.coalesce("points_count", F.lit(0))
    there = (points > 0) | F.col("document_type").isin(existing or [])
    return counts.select("document_type", points.alias("points_count"),
                         F.when(there, "green").otherwise("NOT_FOUND").alias("status"))


def shown_name() -> Column:
    def text(name):
        return F.when(F.col(name) != "", F.col(name))
    return F.coalesce(text("document_name"), text("filename"), text("document_id"))


def indexed_documents(collection: DataFrame) -> DataFrame:
    """Distinct document names (name, else file name, else id)."""
    return collection.select(shown_name().alias("document_name")).filter("document_name is not null").distinct()


def sample_points(collection: DataFrame, limit: int = 10) -> DataFrame:
    """First points by id (a sampling report)."""
    def text(name):
        return F.when(F.col(name) != "", F.col(name))
    return collection.orderBy("chunk_id").limit(limit).select(
        "chunk_id", F.coalesce(text("document_name"), text("document_id"), F.lit("Unknown")).alias("document_name"),
        F.coalesce("section_title", F.lit("Untitled")).alias("section_title"), "page_numbers")


def collection_inspect(collection: DataFrame) -> DataFrame:
    """Points, documents and the first point of each document type."""
    first = F.min(F.struct("chunk_id", "document_name", "visibility"))
    return collection.groupBy("document_type").agg(
        F.count("*").alias("points"), F.countDistinct("document_name").alias("documents"),
        first.alias("f")).select(
        "document_type", "points", "documents", F.col("f.chunk_id").alias("sample_chunk"),
        F.col("f.document_name").alias("sample_document"), F.col("f.visibility").alias("sample_visibility"))


def index_verification(expected: DataFrame, indexed: DataFrame, key: str = "document_name") -> DataFrame:
    """Documents that are missing from the index or unexpected in it."""
    want = expected.select(key).distinct()
    have = indexed.select(key).distinct()
    return (want.join(have, key, "left_anti").withColumn("problem", F.lit("missing"))
            .unionByName(have.join(want, key, "left_anti").withColumn("problem", F.lit("unexpected"))))


BUCKETS = 64


class CollectionStore:
    """Two plain Parquet tables below ``root``: ``collections``, one row per document type, and ``points``.

    Points lie in folders by document type and bucket; a bucket holds the documents whose hash falls into it.  A change
    reads the buckets of the documents that it touches and replaces these folders by dynamic partition overwrite, which
    writes all new files before it drops an old one, so a change may read what it replaces; rows move and are written once.
    Its cost follows the documents touched and a repeated change gives the same table.  A
    replaced bucket always gets one row without chunk id, so that a bucket left without points is replaced too; chunk
    ids are never null otherwise.  Writers of one document type take turns.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark = spark
        self.root = root.rstrip("/")
        self.buckets = buckets

    def bucket_of(self, document_id: str = "document_id") -> Column:
        return F.pmod(F.xxhash64(F.col(document_id).cast("string")), F.lit(self.buckets)).cast("int")

    def overwrite(self, rows: DataFrame, path: str, keys: list[str]) -> None:
        """Replace the folders of ``path`` that ``rows`` has rows for; large ones are written by several tasks."""
        self._write(rows.hint("rebalance", *keys), path, keys)

    def _write(self, rows: DataFrame, path: str, keys: list[str]) -> None:
        (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
         .partitionBy(*keys).parquet(path))

    def read_folder(self, path: str, schema: T.StructType) -> DataFrame:
        """The rows of a table that may not have been written yet."""
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], schema)

    def registered(self) -> dict[str, T.StructType]:
        """The schema of each document type's points; there are a few types."""
        rows = self.read_folder(f"{self.root}/collections", T.StructType([
            T.StructField("points_schema", T.StringType()), T.StructField("document_type", T.StringType())]))
        return {r["document_type"]: T.StructType.fromJson(json.loads(r["points_schema"])) for r in rows.collect()}

    def create(self, schema_of: DataFrame, document_type: str, dimension: int,
               metric: str = "cosine", recreate: bool = False) -> bool:
        """Create an empty collection if absent; ``recreate`` empties an existing one."""
        if dimension <= 0:
            raise ValueError("dimension must be positive")
        known = document_type in self.registered()
        if known and not recreate:
            return False
        if known:  # every bucket is replaced by its empty form
            self._replace(self.read(document_type).limit(0), document_type, list(range(self.buckets)))
        empty = schema_of.drop("document_type").limit(0)
        if "vector" in empty.columns:
            empty = empty.withMetadata("vector", {
                "dimension": dimension, "metric": METRICS.get(metric.lower(), METRICS["cosine"])})
        self.overwrite(self.spark.createDataFrame([(json.dumps(empty.schema.jsonValue()), document_type)],
                                                  "points_schema string, document_type string"),
                       f"{self.root}/collections", ["document_type"])
        return True

    def reset(self, schema_of: DataFrame, document_type: str, dimension: int) -> bool:
        return self.create(schema_of, document_type, dimension, recreate=True)

    def exists(self, document_type: str) -> bool:
        return document_type in self.registered()

    def read(self, document_type: str, buckets: list[int] | None = None) -> DataFrame:
        """The points of a type, of some buckets only if they are named."""
        schema = self.registered().get(document_type)
        if schema is None:
            raise ValueError(f"no collection {document_type!r}")
        full = T.StructType([*schema.fields, T.StructField("document_type", T.StringType()),
                             T.StructField("bucket", T.IntegerType())])
        rows = self.read_folder(f"{self.root}/points", full).filter(F.col("document_type") == document_type)
        if buckets is not None:
            rows = rows.filter(F.col("bucket").isin(buckets))
        return rows.filter("chunk_id is not null").drop("bucket")

    def touched(self, documents: DataFrame) -> list[int]:
        """The buckets of some documents: numbers below ``buckets``."""
        return sorted(r[0] for r in documents.select(self.bucket_of()).distinct().collect())

    def _replace(self, rows: DataFrame, document_type: str, buckets: list[int], fresh: DataFrame | None = None,
                 finish: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Make ``rows`` the points of the named buckets, with ``finish`` of ``fresh``, which is made where it is written."""
        if not buckets:
            return
        path, keys = f"{self.root}/points", ["document_type", "bucket"]

        def placed(points):
            # a row of another bucket would replace that bucket's points
            bucket = F.when(self.bucket_of().isin(buckets), self.bucket_of()).otherwise(
                F.raise_error(F.lit("a row of a document that is not replaced")).cast("int"))
            return points.withColumn("document_type", F.lit(document_type)).withColumn("bucket", bucket)

        full = placed(rows)
        if fresh is not None:
            full = full.hint("rebalance", *keys).unionByName(finish(placed(fresh).hint("rebalance", *keys)).select(*full.columns))
        marks = self.spark.createDataFrame([(document_type, b) for b in buckets], "document_type string, bucket int")
        full = full.unionByName(marks, allowMissingColumns=True)
        self._write(full, path, keys) if fresh is not None else self.overwrite(full, path, keys)

    def upsert(self, rows: DataFrame, document_type: str) -> None:
        """Insert or replace by chunk id, within the document that a chunk belongs to."""
        buckets = self.touched(rows)
        base = self.read(document_type, buckets)
        self._replace(collection_upsert(base, rows.withColumn("document_type", F.lit(document_type))), document_type, buckets)

    def replace_documents(self, rows: DataFrame, document_type: str, documents: DataFrame | None = None,
                          finish: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Replace every document of ``documents`` (by default those in ``rows``) by its new rows.

        ``rows`` holds rows of these documents only.  ``finish`` adds the columns that are made from a row alone, after
        the rows have moved to their folders.
        """
        changed = rows.select("document_id").distinct() if documents is None else documents.select("document_id").distinct()
        buckets = self.touched(changed)
        kept = collection_delete_document(self.read(document_type, buckets), changed)
        fresh = rows.withColumn("document_type", F.lit(document_type))
        if finish is not None:
            self._replace(kept, document_type, buckets, fresh, finish)
        else:
            self._replace(kept.unionByName(fresh.select(*kept.columns)), document_type, buckets)

    def delete_documents(self, documents: DataFrame, document_type: str) -> None:
        buckets = self.touched(documents)
        self._replace(collection_delete_document(self.read(document_type, buckets), documents), document_type, buckets)

    def info(self) -> DataFrame:
        known = self.registered()
        kinds = [k for k in (V.COMPANY, V.INSTRUCTION) if k in known]
        rows = self.spark.createDataFrame([], "document_type string")
        for kind in kinds:
            rows = rows.unionByName(self.read(kind).select("document_type"))
        return collection_info(rows, [V.COMPANY, V.INSTRUCTION], kinds)
