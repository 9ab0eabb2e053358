"""Document catalogue, headers and access decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import strip, title_case

SUFFIX = r"(?s)^(.+)\.([^.]+)$"
SUPPORTED = ["pdf"]


def suffix(name: Column) -> Column:
    return F.regexp_extract(name, SUFFIX, 2)


def stem(name: Column) -> Column:
    return F.when(suffix(name) != "", F.regexp_extract(name, SUFFIX, 1)).otherwise(name)


def document_catalog(files: DataFrame, internal: DataFrame) -> DataFrame:
    """Public documents (filename, file_type, size_bytes, pages, status).

    ``files(filename, size_bytes, pages, position)``; of names equal up to case the first
    ``position`` stays.  ``internal(filename)`` lists restricted names.
    """
    lower = F.lower("filename")
    shown = (files.filter(~F.startswith(F.col("filename"), F.lit(".")))
             .filter(~F.contains(lower, F.lit("instruction"))).withColumn("__key", lower))
    hidden = internal.select(lower.alias("__key")).distinct()
    kept = (shown.join(hidden, "__key", "left_anti").groupBy("__key")
            .agg(F.min(F.struct("position", "filename", "size_bytes", "pages")).alias("f")))
    kind = F.when(suffix(F.col("f.filename")) != "", F.upper(suffix(F.col("f.filename")))).otherwise("PDF")
    return kept.select("f.filename", kind.alias("file_type"), "f.size_bytes",
                       F.greatest(F.lit(1), F.coalesce("f.pages", F.lit(1))).alias("pages"),
                       F.lit("Available").alias("status"))


def sorted_catalog(catalog: DataFrame) -> DataFrame:
    return catalog.orderBy(F.lower("filename"))


def document_header(files: DataFrame) -> DataFrame:
    """Title, type and support flag of files; unsupported types carry ``reject_reason``."""
    kind = F.when(suffix(F.col("filename")) != "", F.lower(suffix(F.col("filename")))).otherwise("pdf")
    title = title_case(F.translate(stem(F.col("filename")), "_-", "  "))
    return (files.withColumn("file_type", kind).withColumn("title", title)
            .withColumn("reject_reason", F.when(~F.col("file_type").isin(SUPPORTED), "unsupported_format")))


def access_audit(requests: DataFrame, catalog: DataFrame, internal: DataFrame) -> DataFrame:
    """Status of every requested document id: 400, 403, 404 or 200."""
    decoded = strip(F.try_url_decode(F.regexp_replace("document_id", r"\+", "%2B")))
    staged = requests.withColumn("__name", F.coalesce(decoded, F.lit("")))
    name = F.col("__name")
    bad = (name == "") | F.contains(name, F.lit("..")) | F.contains(name, F.lit("/")) | F.contains(name, F.lit("\\"))
    hidden = internal.select(F.lower("filename").alias("__low")).distinct().withColumn("__hidden", F.lit(True))
    known = catalog.select(F.col("filename").alias("__name")).distinct().withColumn("__known", F.lit(True))
    joined = (staged.withColumn("__low", F.lower("__name")).join(hidden, "__low", "left")
              .join(known, "__name", "left"))
    restricted = (F.coalesce("__hidden", F.lit(False)) | F.contains(F.col("__low"), F.lit("instruction"))
                  | F.contains(F.col("__low"), F.lit("blueprint")))
    status = F.when(bad, 400).when(restricted, 403).when(F.col("__known").isNull(), 404).otherwise(200)
    return joined.select(*requests.columns, status.alias("status_code"))
