"""Page cleaning: character normalisation, repeated header/footer removal.

A page is one row, so line work stays inside the row and no page text is shuffled by line.  Only short candidate lines are aggregated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioscope.functions.columns import RE2_ODD, RE2_WS, stripped_lines, text_slices
from folioscope.functions.text import squash, strip
from folioscope.session import materialize

MIN_PAGES = 3


def _plain(text: Column) -> Column:
    unix = F.regexp_replace(text, r"\r\n|\r", "\n")
    plain = F.replace(F.translate(unix, "\u00a0", " "), F.lit("\u200b"), F.lit(""))
    # most texts have none of these, which a plain search tells faster
    odd = F.contains(text, F.lit("\r")) | F.contains(text, F.lit("\u00a0")) | F.contains(text, F.lit("\u200b"))
    return F.when(odd, plain).otherwise(text)


def normalized_lines(text: Column) -> Column:
    """Stripped lines after line-break, no-break-space and zero-width normalisation."""
    return F.transform(F.split(_plain(text), "\n"), strip)


def normalize_chars(pages: DataFrame, text: str = "text") -> DataFrame:
    """Line breaks to LF, no-break spaces to spaces, zero-width spaces gone, lines stripped."""
    return pages.withColumn(text, F.array_join(normalized_lines(F.col(text)), "\n"))


def _collapse(joined: Column) -> Column:
    return strip(F.regexp_replace(joined, "\n{3,}", "\n\n"))


def collapse_whitespace(pages: DataFrame, text: str = "text") -> DataFrame:
    """Runs of spaces and tabs to one space, three or more newlines to two, outer strip."""
    return pages.withColumn(text, _collapse(F.regexp_replace(F.col(text), "[ \t]+", " ")))


def _lines_of(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """Stripped lines of texts and the row of each."""
    split = pc.split_pattern(texts, "\n")
    counts = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False)
    return stripped_lines(split.flatten()), np.repeat(np.arange(len(texts)), counts)


def _where(texts: pa.StringArray, test: pa.BooleanArray, change: Callable[[pa.StringArray], pa.StringArray]) -> pa.StringArray:
    """``texts`` with ``change`` applied to those that pass the test."""
    test = pc.fill_null(test, False)
    return pc.replace_with_mask(texts, test, change(texts.filter(test))) if pc.any(test).as_py() else texts


def _squashed(lines: pa.StringArray) -> pa.StringArray:
    """``squash`` of stripped lines; most have nothing to replace."""
    return _where(lines, pc.match_substring_regex(lines, rf"  |[{RE2_ODD}]"),
                  lambda x: pc.replace_substring_regex(x, rf"[{RE2_WS}]+", " "))


def _edge_lines(pages: DataFrame) -> DataFrame:
    """(document_id, kind, line): collapsed lines that can be a header or footer, two of each edge of a page.

    The single line of a one-line page is both first and last.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            lines, page = _lines_of(part.column("text"))
            filled = np.flatnonzero(pc.binary_length(lines).to_numpy() > 0)
            own = page[filled]
            rows = np.unique(own)
            low, high = np.searchsorted(own, rows), np.searchsorted(own, rows, side="right")
            two = high - low > 1
            for kind, at in (("header", [low, low[two] + 1]), ("footer", [high - 1, high[two] - 2])):
                at = filled[np.concatenate(at)]
                line = _squashed(lines.take(pa.array(at)))
                fits = pc.and_(pc.greater(pc.utf8_length(line), 3), pc.invert(pc.match_substring_regex(line, r"^\p{Nd}+$")))
                names = part.column("document_id").take(pa.array(page[at])).filter(fits)
                yield pa.RecordBatch.from_arrays([names, pa.array([kind] * len(names), pa.string()), line.filter(fits)],
                                                 ["document_id", "kind", "line"])

    kind = pages.schema["document_id"].dataType.simpleString()
    texts = pages.select("document_id", F.make_valid_utf8("text").alias("text"))
    return texts.mapInArrow(run, f"document_id {kind}, kind string, line string")


def detect_header_footer(pages: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Lines that repeat at the top or bottom of a document's pages.

    Two candidate lines per page edge leave each page; counts are combined map-side,
    so a document holding a third of all pages does not load one task.
    """
    sizes = materialize(pages.groupBy("document_id").agg(F.count("*").alias("pages")).filter(
        F.col("pages") >= MIN_PAGES), "page-counts")
    # written first, so Spark knows how many documents have enough pages before any line moves
    long = pages.select("document_id", "text").join(sizes, "document_id", "left_semi")
    counts = (_edge_lines(long).groupBy("document_id", "kind", "line").agg(F.count("*").alias("occurrences"))
              .filter("occurrences >= 2"))
    need = F.greatest(F.lit(2), F.floor(F.col("pages") * F.lit(threshold)).cast("long"))
    return counts.join(sizes, "document_id").filter(F.col("occurrences") >= need)


def _repeated(pages: DataFrame, threshold: float) -> DataFrame:
    # at most six lines per document can pass the threshold, so the set is small
    return (detect_header_footer(pages, threshold).groupBy("document_id")
            .agg(F.collect_set("line").alias("__repeated")))


def _with_repeated(pages: DataFrame, threshold: float) -> DataFrame:
    # plain equi-join: the set is written first, so Spark knows its size before pages move; it broadcasts a small
    # set and splits a skewed document otherwise
    return pages.join(materialize(_repeated(pages, threshold), "repeated"), "document_id", "left").withColumn(
        "__repeated", F.coalesce("__repeated", F.array().cast("array<string>")))


def _without_repeated(lines: Column) -> Column:
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col("__repeated"), squash(x)))
    return F.when(F.size("__repeated") > 0, kept).otherwise(lines)


def strip_header_footer(pages: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Drop every line equal to a repeated header or footer of its document."""
    marked = _with_repeated(pages, threshold)
    kept = _without_repeated(F.split("text", "\n"))
    return marked.withColumn("text", F.array_join(kept, "\n")).drop("__repeated")


def _cleaned(texts: pa.StringArray, repeated: pa.ListArray) -> pa.StringArray:
    """Page texts without their repeated lines, collapsed; a null text is empty."""
    lines, page = _lines_of(texts)
    stay = np.ones(len(lines), bool)
    pool = pc.unique(repeated.flatten())
    if len(pool):
        place = pc.index_in(_squashed(lines), pool)
        known = np.flatnonzero(place.is_valid().to_numpy(zero_copy_only=False))
        # a line goes when its own page lists it
        own = page[known] * len(pool) + place.take(pa.array(known)).to_numpy()
        of_page = np.repeat(np.arange(len(texts)), pc.list_value_length(repeated).to_numpy(zero_copy_only=False))
        listed = of_page * len(pool) + pc.index_in(repeated.flatten(), pool).to_numpy()
        stay[known[np.isin(own, listed)]] = False
    counts = np.bincount(page[stay], minlength=len(texts))
    kept = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), lines.filter(pa.array(stay)))
    joined = pc.binary_join(kept, "\n")
    gaps = pc.or_(pc.match_substring(joined, "  "), pc.match_substring(joined, "\t"))
    spaced = _where(joined, gaps, lambda x: pc.replace_substring_regex(x, "[ \t]{2,}|\t", " "))
    closed = _where(spaced, pc.match_substring(spaced, "\n\n\n"), lambda x: pc.replace_substring_regex(x, "\n{3,}", "\n\n"))
    return stripped_lines(closed)


def clean_pages(pages: DataFrame, threshold: float = 0.75, stored: bool = False) -> DataFrame:
    """All cleaning rules; one row per page with ``raw_chars`` and ``clean_chars``.

    The pages are written once: their edges, their numbers and their texts are three readers.  ``stored`` says that
    they lie in files as they are.
    """
    if not stored:
        pages = materialize(pages, "raw-pages")
    others = [c for c in pages.columns if c != "text"]
    marked = _with_repeated(pages, threshold).select(
        *others, _plain(F.make_valid_utf8("text")).alias("text"), F.coalesce(F.length("text"), F.lit(0)).alias("raw_chars"),
        "__repeated")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            columns = [_cleaned(part.column("text"), part.column("__repeated")) if c == "text" else part.column(c)
                       for c in cleaned.names]
            yield pa.RecordBatch.from_arrays(columns, cleaned.names)

    cleaned = StructType([marked.schema[c] for c in [*others, "text", "raw_chars"]])
    return marked.mapInArrow(run, cleaned).withColumn("clean_chars", F.length("text"))


def cleaning_stats(cleaned: DataFrame) -> DataFrame:
    """Characters before and after cleaning per document, and the share removed."""
    sums = cleaned.groupBy("document_id").agg(
        F.sum("raw_chars").alias("raw_chars"), F.sum("clean_chars").alias("clean_chars"))
    removed = F.col("raw_chars") - F.col("clean_chars")
    return sums.select(
        "document_id", "raw_chars", "clean_chars", removed.alias("chars_removed"),
        F.when(F.col("raw_chars") > 0, F.rint(removed / F.col("raw_chars") * 100.0 * 100.0) / 100.0)
        .otherwise(F.lit(0.0)).alias("removed_pct"))

