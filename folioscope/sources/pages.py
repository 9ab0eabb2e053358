"""Page sources: page-separated text, HTML rows, files on shared storage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def text_pages(rows: DataFrame, document_id: str, text: str) -> DataFrame:
    """1-indexed pages of form-feed separated text."""
    return rows.select(F.col(document_id).alias("document_id"),
                       F.posexplode(F.split(text, "\f")).alias("__i", "text")).select(
        "document_id", (F.col("__i") + 1).alias("page_number"), "text",
        F.length("text").alias("raw_char_count"))


def html_text(html: Column) -> Column:
    """Visible text of HTML: scripts, styles, comments and tags removed, blocks on own lines."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>", "")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", "")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</(p|div|h[1-6]|li|tr)>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def html_pages(rows: DataFrame, document_id: str, html: str) -> DataFrame:
    """Pages of HTML rows; a form feed in the text separates pages."""
    return text_pages(rows.withColumn("__text", html_text(F.col(html))), document_id, "__text")


def discover_files(spark: SparkSession, directory: str, pattern: str = "*.pdf") -> DataFrame:
    """Sorted listing of matching files; file contents are not read."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(directory)
            .select("path", F.col("length").alias("size_bytes"),
                    F.element_at(F.split("path", "/"), -1).alias("filename")).orderBy("path"))


def decoded_pages(spark: SparkSession, directory: str, pattern: str,
                  decode: Callable[[bytes], list[str]]) -> DataFrame:
    """Pages of binary files through a caller's decoder (bytes -> page texts)."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(directory)
             .select(F.element_at(F.split("path", "/"), -1).alias("document_id"), "content"))

    def run(batches: Iterator):
        for batch in batches:
            exploded = batch.assign(text=[decode(bytes(b)) for b in batch["content"]]).explode("text")
            exploded["page_number"] = exploded.groupby("document_id").cumcount() + 1
            exploded["text"] = exploded["text"].fillna("")
            yield exploded[["document_id", "page_number", "text"]]

    return files.mapInPandas(run, "document_id string, page_number int, text string").withColumn(
        "raw_char_count", F.length("text"))
