"""Token-bounded chunks: packing sections, splitting, merging, numbering, validation.

Chunk rows: document_id, chunk_order, page_numbers, section_title, section_type,
hierarchy_level, content, estimated_tokens, char_count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from folioscope.functions.columns import stripped_lines, text_slices
from folioscope.functions.text import estimate_tokens, half_even, not_blank
from folioscope.functions.vocab import MAX_TOKENS, MIN_TOKENS, OVERLAP_TOKENS
from folioscope.operators import orbits
from folioscope.operators.scans import row_numbers, running, width_block
from folioscope.operators.structure import SECTION_BLOCK
from folioscope.session import materialize

GAP = 2  # characters of the blank line between joined parts


def _tokens(chars: int) -> int:
    return max(1, round(chars / 4))


def _packing_step(group: pd.DataFrame, max_tokens: int, overlap: int) -> orbits.Step:
    """Next break after a break at item i: a small previous section is carried over."""
    # plain numbers: a step looks at one item at a time
    p = group["reading_order"].tolist()
    chars = group["chars"].tolist()
    tok = [_tokens(c) for c in chars]
    n = len(p)

    def step(i: int) -> int:
        held = chars[i]
        if i > 0 and tok[i - 1] <= overlap:
            held += GAP + chars[i - 1]
        for j in range(i + 1, n):
            if _tokens(held) + tok[j] > max_tokens:
                return p[j]
            held += GAP + chars[j]
        return int(orbits.OPEN)

    return step


def assign_sections(sections: DataFrame, max_tokens: int = MAX_TOKENS,
                    overlap: int = OVERLAP_TOKENS, block: int = SECTION_BLOCK) -> DataFrame:
    """(document_id, reading_order, chunk_end, is_overlap) for greedy section packing.

    ``chunk_end`` is the order of the section that closes the chunk.  Only section
    lengths travel through Python, in blocks of ``block`` sections.
    """
    items = sections.select("document_id", "reading_order", F.col("char_count").alias("chars"))
    # a section takes at least one character and the gap, which bounds a chunk's reach
    reach = (4 * max_tokens + 4) // (GAP + 1) + 2
    if reach >= block:
        raise ValueError("block must exceed the largest number of sections in one chunk")

    def make_step(group):
        return _packing_step(group, max_tokens, overlap)

    entered = orbits.entries(items, ["document_id"], "reading_order", ["reading_order"], block,
                             reach, make_step, halo=True)

    def emit(group: pd.DataFrame) -> dict[str, np.ndarray]:
        number = int(group[orbits.BLOCK].iloc[0])
        p = group["reading_order"].to_numpy()
        chars = group["chars"].to_numpy()
        carry = int(group[orbits.CARRY].iloc[0])
        first, last = np.searchsorted(p, [number * block, (number + 1) * block])
        step = make_step(group)
        i = max(first, int(np.searchsorted(p, carry)))
        ends = np.full(max(0, min(i, last) - first), carry, dtype=np.int64)
        parts, repeats = [ends], []
        while i < last:
            end = step(i)
            j = int(np.searchsorted(p, end))
            parts.append(np.full(min(j, last) - i, end, dtype=np.int64))
            if i > 0 and 0 < _tokens(chars[i - 1]) <= overlap:
                repeats.append((int(p[i - 1]), end))
            i = j
        again = np.array(repeats, dtype=np.int64).reshape(-1, 2)
        n = last - first + len(again)
        names = np.repeat(group["document_id"].to_numpy()[:1], n)
        return {"document_id": names, "reading_order": np.concatenate([p[first:last], again[:, 0]]),
                "chunk_end": np.concatenate([*parts, again[:, 1]]), "is_overlap": np.arange(n) >= last - first}

    kind = items.schema["document_id"].dataType.simpleString()
    return orbits.walk(entered, ["document_id"], ["reading_order"],
                       f"document_id {kind}, reading_order long, chunk_end long, is_overlap boolean",
                       emit)


def semantic_chunks(sections: DataFrame, titles: DataFrame | None = None,
                    max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS,
                    block: int = SECTION_BLOCK, pages: DataFrame | None = None) -> DataFrame:
    """Greedy packing of sections into chunks.

    ``pages(document_id, page_number, contents)`` holds the section texts of every page; with it ``sections`` needs no
    ``content``, and a page moves its texts to their chunks once.

    The governing heading is the last heading up to and including the section that
    closes the chunk.  ``titles(document_id, title)`` gives the title before any heading.
    """
    assigned = assign_sections(sections, max_tokens, overlap, block)
    place = ["reading_order"] if pages is None else ["page_number", "section_no"]
    # numbering, headings and types need no text: it joins the finished chunks, moved once to its chunk
    members = materialize(assigned.join(sections.select("document_id", *dict.fromkeys(
        ["reading_order", "page_number", *place, "section_type"])), ["document_id", "reading_order"]), "members")
    kinds = F.collect_set("section_type")
    packed = members.groupBy("document_id", "chunk_end").agg(
        F.min(F.when(~F.col("is_overlap"), F.col("reading_order"))).alias("__first"),
        F.max("reading_order").alias("__last"),
        F.array_sort(F.collect_set("page_number")).alias("page_numbers"),
        F.when(F.size(kinds) == 1, kinds[0]).otherwise("composite").alias("section_type"),
        F.count("*").alias("section_count"))
    if pages is None:
        own = members.select("document_id", "chunk_end", "reading_order").join(
            sections.select("document_id", "reading_order", "content"), ["document_id", "reading_order"])
        held = own.select("document_id", "chunk_end", F.array(F.struct("reading_order", "content")).alias("__texts"))
    else:
        # a page gives a chunk all its texts in one row
        own = members.groupBy("document_id", "page_number", "chunk_end").agg(
            F.collect_list(F.struct("reading_order", "section_no")).alias("__own")).join(
            pages.select("document_id", "page_number", "contents"), ["document_id", "page_number"])
        found = F.transform("__own", lambda x: F.struct(x["reading_order"].alias("reading_order"),
                                                        F.get("contents", x["section_no"]).alias("content")))
        held = own.select("document_id", "chunk_end", F.filter(found, lambda x: x["content"].isNotNull()).alias("__texts"))
    contents = held.groupBy("document_id", "chunk_end").agg(F.array_join(F.transform(
        F.array_sort(F.flatten(F.collect_list("__texts"))), lambda x: x["content"]), "\n\n").alias("content"))
    heading = F.when(F.col("section_type") == "heading", F.struct("reading_order", "title", "level"))
    governing = running(sections.select("document_id", "reading_order", heading.alias("__h")),
                        ["document_id"], ["reading_order"],
                        width_block(F.col("reading_order"), block),
                        {"__g": ("max", F.col("__h"))}).drop("__h")
    close = F.when(F.col("chunk_end") == int(orbits.OPEN), F.col("__last")).otherwise(F.col("chunk_end"))
    titled = packed.withColumn("reading_order", close).join(
        governing, ["document_id", "reading_order"], "left").drop("reading_order")
    if titles is not None:
        titled = titled.join(titles.select("document_id", F.col("title").alias("__title")),
                             "document_id", "left")
    else:
        titled = titled.withColumn("__title", F.lit(None).cast("string"))
    fallback = F.when(F.coalesce(F.col("__title"), F.lit("")) != "", F.col("__title")).otherwise("General")
    numbered = row_numbers(titled, ["document_id"], ["__first"],
                           width_block(F.col("__first"), block), "__n")
    return contents.join(numbered, ["document_id", "chunk_end"]).select(
        "document_id", (F.col("__n") - 1).alias("chunk_order"), "page_numbers",
        F.coalesce(F.col("__g.title"), fallback).alias("section_title"), "section_type",
        F.coalesce(F.col("__g.level"), F.lit(1)).alias("hierarchy_level"), "content",
        estimate_tokens(F.col("content")).alias("estimated_tokens"),
        F.length("content").alias("char_count"), "section_count")


def _pieces(texts: pa.StringArray, large: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, piece, text) of chunk texts; ``large`` ones are cut into parts and packed again up to ``limit`` characters.

    A round finds the next piece of every large text at once, by search in the summed lengths of all parts.
    """
    whole = np.flatnonzero(~large)
    big = np.flatnonzero(large & texts.is_valid().to_numpy(zero_copy_only=False))
    own = texts.take(pa.array(big))
    blank_line = pc.match_substring(own, "\n\n")
    split = pa.concat_arrays([pc.split_pattern(own.filter(blank_line), "\n\n"), pc.split_pattern(own.filter(pc.invert(blank_line)), "\n")])
    row = np.concatenate([big[blank_line.to_numpy(zero_copy_only=False)], big[~blank_line.to_numpy(zero_copy_only=False)]])
    parts = stripped_lines(split.flatten())
    row = np.repeat(row, pc.list_value_length(split).to_numpy(zero_copy_only=False))
    lengths = pc.utf8_length(parts).to_numpy(zero_copy_only=False)
    parts, row, lengths = parts.filter(pa.array(lengths > 0)), row[lengths > 0], lengths[lengths > 0].astype(np.int64)
    upto = np.cumsum(lengths + GAP)
    at = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    ends = np.append(at[1:], len(row)) if len(row) else at
    found = []
    while len(at):
        found.append(at)
        held = upto[at] - lengths[at]
        at = np.maximum(at + 1, np.searchsorted(upto, held + limit, side="right"))
        at, ends = at[at < ends], ends[at < ends]
    starts = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
    cuts = pa.array(np.append(starts, len(row)).astype(np.int32))
    packed = pc.binary_join(pa.ListArray.from_arrays(cuts, parts), "\n\n")
    owner = row[starts]
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else owner
    piece = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
    # a large text of white space keeps its row, without a text
    void = np.setdiff1d(big, owner)
    return (np.concatenate([whole, owner, void]), np.concatenate([np.zeros(len(whole)), piece, np.zeros(len(void))]).astype(np.int32),
            pa.concat_arrays([pc.fill_null(texts.take(pa.array(whole)), ""), packed, pa.nulls(len(void), pa.string())]))


def split_oversized(chunks: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Split chunks above ``max_tokens`` on blank lines (or single newlines) and re-pack.

    Pieces keep the chunk's pages and titles.  Adds ``piece`` (0-based) and
    ``split_chunk``.  Texts are cut and packed some MB at a time.
    """
    kept = [c for c in chunks.columns if c not in {"content", "estimated_tokens", "char_count"}]
    rows = chunks.select(*kept, (F.col("estimated_tokens") > max_tokens).alias("split_chunk"),
                         F.make_valid_utf8("content").alias("content"))
    # the longest text within the limit, as tokens are rounded half to even
    limit = max((n for n in range(4 * max_tokens, 4 * max_tokens + 4) if _tokens(n) <= max_tokens), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "content"):
            large = pc.fill_null(part.column("split_chunk"), False).to_numpy(zero_copy_only=False)
            source, piece, content = _pieces(part.column("content"), large, limit)
            same = [part.column(c).take(pa.array(source)) for c in [*kept, "split_chunk"]]
            yield pa.RecordBatch.from_arrays([*same, pa.array(piece), content], [*kept, "split_chunk", "piece", "content"])

    schema = StructType([*[rows.schema[c] for c in [*kept, "split_chunk"]], StructField("piece", IntegerType()),
                         StructField("content", StringType())])
    split = rows.mapInArrow(run, schema).withColumn("estimated_tokens", estimate_tokens(F.col("content")))
    return split.withColumn("char_count", F.length("content")) if "char_count" in chunks.columns else split


def merge_pairs(sizes: DataFrame, min_tokens: int = MIN_TOKENS, max_tokens: int = MAX_TOKENS,
                block: int = SECTION_BLOCK) -> DataFrame:
    """(document_id, chunk_order, pair) of one left-to-right merging pass.

    ``sizes(document_id, chunk_order, estimated_tokens)`` has dense 0-based orders.  Whether
    a chunk *may* merge with its successor depends on the two alone; inside a run of such
    chunks every second one starts a pair, so the pass is a running maximum and a parity,
    not a loop.
    """
    nxt = sizes.select("document_id", (F.col("chunk_order") - 1).alias("chunk_order"),
                       F.col("estimated_tokens").alias("__next"))
    tok = F.col("estimated_tokens")
    may = (tok < min_tokens) & F.coalesce(tok + F.col("__next") <= max_tokens, F.lit(False))
    flagged = sizes.join(nxt, ["document_id", "chunk_order"], "left").select(
        "document_id", "chunk_order", may.alias("__may"))
    flags = running(flagged, ["document_id"], ["chunk_order"], width_block(F.col("chunk_order"), block),
                    {"__stop": ("max", F.when(~F.col("__may"), F.col("chunk_order")))}, inclusive=False)
    offset = F.col("chunk_order") - F.coalesce("__stop", F.lit(-1)) - 1
    return flags.select("document_id", "chunk_order", (F.col("chunk_order") - offset % 2).alias("pair"))


def join_pairs(members: DataFrame, order: list[str]) -> DataFrame:
    """Merge the one or two chunks of every (document_id, pair), sorted by ``order``."""
    member = F.array_sort(F.collect_list(F.struct(
        *order, "page_numbers", "section_title", "section_type", "hierarchy_level", "content")))
    pairs = members.groupBy("document_id", "pair").agg(member.alias("m"))
    both = F.size("m") == 2
    first, second = F.col("m")[0], F.try_element_at("m", F.lit(2))
    content = F.array_join(F.transform("m", lambda x: x["content"]), "\n\n")
    return pairs.select(
        "document_id", F.col("pair").alias("chunk_order"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("m", lambda x: x["page_numbers"])))
                     ).alias("page_numbers"),
        first["section_title"].alias("section_title"),
        F.when(both & (first["section_type"] != second["section_type"]), "composite")
        .otherwise(first["section_type"]).alias("section_type"),
        F.array_min(F.transform("m", lambda x: x["hierarchy_level"])).alias("hierarchy_level"),
        content.alias("content"), both.alias("merged")
    ).withColumn("estimated_tokens", estimate_tokens(F.col("content"))
                 ).withColumn("char_count", F.length("content"))


def join_heads(pieces: DataFrame, named: DataFrame, key: list[str], min_tokens: int = MIN_TOKENS) -> DataFrame:
    """Merged pairs of ``pieces``; ``named(*key, place, pair, number)`` holds every piece's place, its pair's first
    place and its pair's number.

    The first piece of a pair of two is below ``min_tokens``, so it travels to the second: long texts move once.
    """
    second = named.filter("place > pair").select(*key, "pair")
    of_first = named.filter("place = pair").select(*key, F.col("place").alias("pair"))
    columns = ["page_numbers", "section_title", "section_type", "hierarchy_level", "content"]
    tiny = pieces.filter(F.col("estimated_tokens") < min_tokens).join(of_first, key)
    heads = tiny.select("document_id", "pair", F.struct(*columns).alias("__head")).join(
        second, ["document_id", "pair"])
    gone = heads.select("document_id", "pair", F.lit(True).alias("__gone"))
    slim = (named.join(heads.select(*key, "__head"), key, "left")
            .join(gone.withColumnRenamed("pair", "place"), ["document_id", "place"], "left").filter("__gone is null"))
    head, both = F.col("__head"), F.col("__head").isNotNull()
    merged = pieces.join(slim.select(*key, "number", "__head"), key)
    return merged.select(
        "document_id", F.col("number").alias("chunk_order"),
        F.array_sort(F.array_distinct(F.when(both, F.concat(head["page_numbers"], "page_numbers")).otherwise(
            F.col("page_numbers")))).alias("page_numbers"),
        F.when(both, head["section_title"]).otherwise(F.col("section_title")).alias("section_title"),
        F.when(both & (head["section_type"] != F.col("section_type")), "composite")
        .otherwise(F.when(both, head["section_type"]).otherwise(F.col("section_type"))).alias("section_type"),
        F.least(head["hierarchy_level"], "hierarchy_level").alias("hierarchy_level"),
        F.concat_ws("\n\n", head["content"], "content").alias("content"), both.alias("merged")
    ).withColumn("estimated_tokens", estimate_tokens(F.col("content"))
                 ).withColumn("char_count", F.length("content"))


def merge_tiny(chunks: DataFrame, min_tokens: int = MIN_TOKENS, max_tokens: int = MAX_TOKENS,
               block: int = SECTION_BLOCK) -> DataFrame:
    """Merge every chunk below ``min_tokens`` with its successor where both fit.

    ``chunk_order`` must be a dense 0-based number per document.
    """
    pairs = merge_pairs(chunks.select("document_id", "chunk_order", "estimated_tokens"),
                        min_tokens, max_tokens, block)
    return join_pairs(chunks.join(pairs, ["document_id", "chunk_order"]), ["chunk_order"])


def reindex_chunks(chunks: DataFrame, order: list[str], block: int = SECTION_BLOCK) -> DataFrame:
    """Dense 0-based ``chunk_order`` per document along ``order``; tokens recomputed."""
    keep = [c for c in chunks.columns if c not in ("chunk_order", "estimated_tokens", *order)]
    numbered = row_numbers(chunks, ["document_id"], order, width_block(F.col(order[0]), block), "__n")
    return numbered.select(*keep, (F.col("__n") - 1).alias("chunk_order"),
                           estimate_tokens(F.col("content")).alias("estimated_tokens"))


def validate_chunks(chunks: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Add ``reject_reason``: the first failing check, null for a valid chunk."""
    def empty(name):
        return F.coalesce(F.col(name).cast("string"), F.lit("")) == ""

    tests = [(~not_blank(F.col("content")), "empty_content"),
             (empty("document_id"), "missing_document_id"),
             (F.coalesce(F.size("page_numbers"), F.lit(0)) <= 0, "missing_page_numbers"),
             (empty("section_title"), "missing_section_title")]
    if "metadata" in chunks.columns:
        tests.append((F.coalesce(F.size("metadata"), F.lit(0)) <= 0, "missing_metadata"))
    tests.append((F.col("estimated_tokens") > max_tokens, "too_many_tokens"))
    reason = F.lit(None).cast("string")
    for test, name in reversed(tests):
        reason = F.when(test, name).otherwise(reason)
    return chunks.withColumn("reject_reason", reason)


def valid_only(validated: DataFrame) -> DataFrame:
    return validated.filter("reject_reason is null").drop("reject_reason")


def rejects(validated: DataFrame) -> DataFrame:
    return validated.filter("reject_reason is not null")


def chunk_statistics(chunks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Chunk counts and sizes per ``keys`` or over all rows (zeros when empty)."""
    n = F.count("*")

    def mean(column):
        return F.when(n > 0, half_even(F.sum(column) / n, 2)).otherwise(0.0)

    return chunks.groupBy(*(keys or [])).agg(
        n.alias("total_chunks"), mean("char_count").alias("average_chunk_size"),
        F.coalesce(F.max("char_count"), F.lit(0)).alias("largest_chunk"),
        F.coalesce(F.min("char_count"), F.lit(0)).alias("smallest_chunk"),
        mean("estimated_tokens").alias("average_tokens"),
        F.coalesce(F.sum("estimated_tokens"), F.lit(0)).alias("total_tokens"))


def chunk_ids(chunks: DataFrame) -> DataFrame:
    """Deterministic chunk id, so a retried or repeated job writes the same keys."""
    return chunks.withColumn("chunk_id", F.sha2(F.concat_ws(
        "|", F.col("document_id").cast("string"), F.col("chunk_order").cast("string")), 256))
