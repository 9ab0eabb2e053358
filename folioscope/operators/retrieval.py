"""Filtered top-k vector search, candidate merging and coverage."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import vocab as V
from folioscope.functions.text import contains_any, estimate_tokens, let
from folioscope.operators.indexing import visibility_of
from folioscope.session import materialize

BLOCK_BYTES = 64 * 1024 * 1024    # vectors of one side in a pair of blocks
QUERY_ROWS = 8192                 # queries of a block; its best rows stay in memory while it meets chunk blocks
HELD_BYTES = 64 * 1024 * 1024     # packed chunk blocks that a task holds
SCORE_BYTES = 32 * 1024 * 1024    # scores of one multiplication
SCORE_ROWS = 2048                 # queries of one multiplication
PAIR_ROWS = 16_384                # pairs scored at a time
SCORE_DIGITS = 6


def search_filter(rows: DataFrame, document_type=None, visibility=None, document_id=None,
                  page_numbers=None, section_type=None, metadata: dict | None = None) -> DataFrame:
    """AND of equality or any-of tests; nothing set keeps every row.

    The tests are plain column predicates, so partition pruning and Parquet pushdown apply.
    """
    def one(column: Column, value) -> Column:
        return column.isin(list(value)) if isinstance(value, (list, tuple)) else column == value

    tests = [one(F.col(name), value) for name, value in
             (("document_type", document_type), ("visibility", visibility),
              ("document_id", document_id), ("section_type", section_type)) if value is not None]
    if page_numbers is not None:
        wanted = page_numbers if isinstance(page_numbers, (list, tuple)) else [page_numbers]
        element = rows.schema["page_numbers"].dataType.elementType
        tests.append(F.arrays_overlap("page_numbers", F.array(*[F.lit(p).cast(element) for p in wanted])))
    tests += [one(F.col("metadata")[key], value) for key, value in (metadata or {}).items()]
    return reduce(lambda df, test: df.filter(test), tests, rows)


class _TopK:
    """Running top-k per query inside one task."""

    def __init__(self, k: int):
        self.k = k
        self.held: list[pd.DataFrame] = []
        self.rows = 0

    def add(self, part: pd.DataFrame) -> None:
        self.held.append(part)
        self.rows += len(part)
        if self.rows > 2_000_000:
            self.shrink()

    def shrink(self) -> pd.DataFrame:
        if not self.held:
            return pd.DataFrame({"q": [], "id": [], "score": []})
        best = pd.concat(self.held, ignore_index=True).sort_values(
            ["q", "score", "id"], ascending=[True, False, True], kind="stable")
        best = best[best.groupby("q").cumcount() < self.k]
        self.held, self.rows = [best], len(best)
        return best


def _rounded(scores: np.ndarray) -> np.ndarray:
    scale = 10.0 ** SCORE_DIGITS
    return np.rint(scores * scale) / scale


def _pair_scores(metric: str, q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Score of every row of ``q`` with the same row of ``m``."""
    dot = np.einsum("ij,ij->i", q, m)
    if metric == "dot":
        return _rounded(dot)
    if metric == "euclid":
        return _rounded(-np.sqrt(np.maximum((q * q).sum(1) + (m * m).sum(1) - 2 * dot, 0)))
    norms = np.linalg.norm(q, axis=1) * np.linalg.norm(m, axis=1)
    return _rounded(dot / np.where(norms == 0, 1e-12, norms))


def _scores(metric: str, q: np.ndarray, m: np.ndarray) -> np.ndarray:
    dot = q @ m.T
    if metric == "dot":
        return _rounded(dot)
    return _rounded(-np.sqrt(np.maximum((q * q).sum(1)[:, None] + (m * m).sum(1)[None, :] - 2 * dot, 0)))


def _unit(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1)[:, None]
    return (m / np.where(norms == 0, 1.0, norms)).astype(np.float32)


def _codes(m: np.ndarray, bits: int) -> np.ndarray:
    planes = np.random.default_rng(7).standard_normal((m.shape[1], bits))
    return ((m @ planes) > 0) @ (1 << np.arange(bits))


def finite(vector: Column) -> Column:
    """Whether a vector has components, all of them finite."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                     & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & whole, F.lit(False))


def usable(vector: Column, dimension: int) -> Column:
    """Whether a vector has ``dimension`` finite components."""
    return finite(vector) & F.coalesce(F.size(vector) == dimension, F.lit(False))


def vector_rejects(rows: DataFrame, dimension: int, key: str = "chunk_id") -> DataFrame:
    """Rows that no search scores: (key, problem), for null vectors, other lengths and unusable components."""
    return rows.filter(~usable(F.col("vector"), dimension)).select(
        key, F.when(F.col("vector").isNull(), "no vector").when(F.size("vector") != dimension, "other length")
        .otherwise("null or not finite").alias("problem"))


def _with_cells(rows: DataFrame, key: str, bits: int, near: bool) -> DataFrame:
    """Add ``length`` and the sign-code ``cell``; with ``near``, also a row for each code that differs in one bit."""
    rows = rows.withColumn("length", F.size("vector"))
    if not bits:
        return rows.withColumn("cell", F.lit(0))

    def code(vectors: pd.Series) -> pd.Series:
        out = pd.Series(0, index=vectors.index, dtype="int32")
        for _, same in vectors.groupby(vectors.map(len)):  # lengths of one batch may differ
            out[same.index] = _codes(np.stack(same.to_numpy()).astype(np.float64), bits).astype("int32")
        return out

    cells = rows.withColumn("cell", F.pandas_udf(code, "int")("vector"))
    if not near:
        return cells
    flips = F.array(F.col("cell"), *[F.col("cell").bitwiseXOR(F.lit(1 << b)) for b in range(bits)])
    return cells.withColumn("cell", F.explode(flips))


class _Search:
    """The best k rows of one block of queries over the chunk blocks that it meets."""

    def __init__(self, numbers: np.ndarray, q: np.ndarray, k: int, min_score: float | None, metric: str):
        self.numbers, self.q, self.k, self.min_score, self.metric = numbers, q, k, min_score, metric
        self.best = _TopK(k)
        self.cosine = metric == "cosine"
        # single precision finds the pairs that can be among the best, double precision scores them
        self.margin = 1e-6 + 2.4e-7 * (q.shape[1] + 4) if self.cosine else 0.0
        self.near = _unit(q) if self.cosine else q
        self.floor = np.full(len(q), -np.inf if min_score is None else min_score - self.margin)

    def meet(self, names: np.ndarray, m: np.ndarray) -> None:
        far = _unit(m) if self.cosine else m
        for top in range(0, len(self.q), SCORE_ROWS):
            rows, floor = self.near[top:top + SCORE_ROWS], self.floor[top:top + SCORE_ROWS]
            step = max(1, SCORE_BYTES // (8 * len(rows)))
            for at in range(0, len(m), step):
                s = rows @ far[at:at + step].T if self.cosine else _scores(self.metric, rows, far[at:at + step])
                keep = s >= floor[:, None]
                many = np.flatnonzero(keep.sum(axis=1) > self.k)
                if len(many):
                    floor[many] = np.maximum(floor[many], np.partition(s[many], -self.k, axis=1)[:, -self.k] - self.margin)
                    keep[many] = s[many] >= floor[many][:, None]
                qi, ci = np.nonzero(keep)
                for part in range(0, len(qi), PAIR_ROWS):
                    qp, cp = qi[part:part + PAIR_ROWS] + top, ci[part:part + PAIR_ROWS] + at
                    score = _pair_scores(self.metric, self.q[qp], m[cp]) if self.cosine else s[qp - top, cp - at]
                    fits = slice(None) if self.min_score is None else score >= self.min_score
                    self.best.add(pd.DataFrame({"q": qp[fits], "id": names[cp[fits]], "score": score[fits]}))

    def found(self, names: pa.DataType) -> pa.RecordBatch:
        top = self.best.shrink()
        return pa.RecordBatch.from_arrays(
            [pa.array(self.numbers[top["q"].to_numpy(dtype=np.int64)], pa.int64()), pa.array(list(top["id"]), names),
             pa.array(top["score"], pa.float64())], ["q", "chunk_id", "score"])


def _packed(side: DataFrame, key: str, rows: int, names: tuple[str, str]) -> DataFrame:
    """Rows (key, vector, length, cell) as blocks of one length and cell: (length, cell, keys, compressed vectors).

    Blocks hold at most ``rows`` rows and about BLOCK_BYTES; they are cut within a task's rows, so no vector is shuffled.
    """
    kind = side.schema["vector"].dataType.elementType.simpleString()
    number = "f4" if kind == "float" else "f8"
    schema = (f"length int, cell int, {names[0]} array<{side.schema[key].dataType.simpleString()}>, {names[1]} binary")

    def blocks(held: list) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        shape = np.stack([table.column(c).to_numpy() for c in ("length", "cell")], axis=1)
        for length, cell in np.unique(shape, axis=0):
            own = table.take(pa.array(np.flatnonzero((shape == (length, cell)).all(axis=1))))
            step = min(rows, max(1, BLOCK_BYTES // (8 * int(length))))
            for at in range(0, own.num_rows, step):
                part = own.slice(at, step)
                flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in part.column("vector").chunks])
                keys = part.column(key).combine_chunks()
                listed = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
                data = pa.compress(flat.astype(number).tobytes(), codec="zstd", asbytes=True)
                yield pa.RecordBatch.from_arrays([pa.array([int(length)], pa.int32()), pa.array([int(cell)], pa.int32()), listed,
                                                  pa.array([data], pa.binary())], ["length", "cell", *names])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += 8 * len(batch.column(batch.schema.get_field_index("vector")).flatten())
            if size >= BLOCK_BYTES:
                yield from blocks(held)
                held, size = [], 0
        if held:
            yield from blocks(held)

    return side.select("length", "cell", key, "vector").mapInArrow(pack, schema)


def _spread(rows: DataFrame, key: str) -> DataFrame:
    """Written rows in at least twice as many partitions as there are cores, as a small table would give one block."""
    parts = 2 * rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= parts // 2 else rows.repartition(parts, key)


def vector_topk(chunks: DataFrame, queries: DataFrame, k: int = V.TOP_K,
                min_score: float | None = V.MIN_SIMILARITY, metric: str = "cosine",
                probe_bits: int = 0) -> DataFrame:
    """Best ``k`` chunks per query: (query_id, chunk_id, score, rank).

    Both sides are packed into rows that hold a block of vectors and are written once.  The search is the Cartesian
    product of the block rows: a task reads its query blocks and its chunk blocks (about HELD_BYTES of them) from the
    written files, so no vector is shuffled or passes through the driver, whatever the number of blocks.  It multiplies in
    steps of SCORE_BYTES of scores and keeps the best ``k`` of a query over all its chunk blocks, under the query's number;
    the query's id joins the few rows that are left.  The search is exact.  ``probe_bits`` > 0 keys the blocks by sign code
    and joins only blocks whose code differs from the query's in at most one bit; that search is approximate.  Ties go
    to the smaller id.

    A query meets the chunks whose vectors are as long as its own.  Vectors that are null, empty, or have components
    that are null or not finite are not searched; ``vector_rejects`` lists them for one length.
    """
    fit = finite(F.col("vector"))
    # vectors come from an encoder: computed once, then packed
    asked = materialize(queries.select("query_id", "vector").filter(fit).withColumn(
        "q", F.monotonically_increasing_id()), "queries")
    held = materialize(chunks.select("chunk_id", "vector").filter(fit), "chunk-vectors")
    wanted = materialize(_packed(_with_cells(_spread(asked, "q"), "q", probe_bits, True), "q", QUERY_ROWS,
                                 ("numbers", "asked")), "query-blocks")
    searched = materialize(_packed(_with_cells(_spread(held, "chunk_id"), "chunk_id", probe_bits, False), "chunk_id",
                                   BLOCK_BYTES, ("names", "held")), "chunk-blocks")
    dtypes = ["f4" if side.schema["vector"].dataType.elementType.simpleString() == "float" else "f8" for side in (asked, held)]
    id_type = chunks.schema["chunk_id"].dataType.simpleString()

    if probe_bits:
        pairs = wanted.join(searched, ["length", "cell"])
    else:
        # as few parts of the chunks as memory allows, since each gives its own best rows, but work for all cores
        size = searched.agg(F.sum(F.length("held"))).first()[0] or 0
        tasks = 2 * chunks.sparkSession.sparkContext.defaultParallelism
        parts = max(-(-size // HELD_BYTES), -(-tasks // max(1, wanted.rdd.getNumPartitions())), 1)
        pairs = wanted.join(searched.coalesce(parts).hint("shuffle_replicate_nl"), ["length", "cell"])

    def matrix(data: pa.Scalar, rows: int, length: int, number: str) -> np.ndarray:
        size = rows * length * int(number[1])
        flat = np.frombuffer(pa.decompress(data.as_buffer(), size, codec="zstd", asbytes=True), dtype=number)
        return flat.astype(np.float64).reshape(rows, length)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, search, names = None, None, None
        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns, strict=True))
            for i in range(batch.num_rows):
                length = column["length"][i].as_py()
                numbers = column["numbers"][i].values.to_numpy(zero_copy_only=False)
                ids = column["names"][i].values
                # rows of one query block follow each other
                block = (length, column["cell"][i].as_py(), len(numbers), numbers[0])
                if block != own:
                    if search is not None:
                        yield search.found(names)
                    own, names = block, ids.type
                    search = _Search(numbers.copy(), matrix(column["asked"][i], len(numbers), length, dtypes[0]), k, min_score, metric)
                search.meet(np.asarray(ids.to_pylist(), dtype=object), matrix(column["held"][i], len(ids), length, dtypes[1]))
        if search is not None:
            yield search.found(names)

    partial = pairs.mapInArrow(solve, f"q long, chunk_id {id_type}, score double")

    def best(rows: DataFrame, key: str) -> DataFrame:
        w = Window.partitionBy(key).orderBy(F.desc("score"), "chunk_id")
        return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    # a query id may repeat, so its rows are ranked once more
    named = best(partial, "q").drop("rank").join(asked.select("q", "query_id"), "q")
    return best(named.select("query_id", "chunk_id", "score"), "query_id")


def payload_defaults(rows: DataFrame) -> DataFrame:
    """Defaults for missing payload fields of search hits."""
    def text(name):
        return F.when(F.col(name) != "", F.col(name))

    document_id = F.coalesce(text("document_id"), F.lit("unknown_doc"))
    kind = F.coalesce(text("document_type"), F.lit(V.COMPANY))
    return rows.select(
        "chunk_id", document_id.alias("document_id"),
        F.coalesce(text("document_name"), text("filename"), document_id).alias("document_name"),
        F.coalesce("content", F.lit("")).alias("content"),
        F.coalesce("page_numbers", F.array().cast("array<int>")).alias("page_numbers"),
        F.coalesce("section_title", F.lit("Untitled Section")).alias("section_title"),
        F.coalesce("section_type", F.lit("composite")).alias("section_type"),
        F.coalesce("hierarchy_level", F.lit(2)).alias("hierarchy_level"),
        F.coalesce("reading_order", F.lit(0)).alias("reading_order"),
        F.coalesce("estimated_tokens", F.lit(0)).alias("estimated_tokens"),
        kind.alias("document_type"),
        F.coalesce(text("visibility"), visibility_of(kind)).alias("visibility"))


TEXT_KEYS = ["chunk_id", "content_key"]


def _content_key() -> Column:
    return F.coalesce(F.md5("content"), F.lit(""))


def without_text(chunks: DataFrame) -> DataFrame:
    """Chunks whose text is left in the text store: its key and its token estimate stay.

    A text that answers many questions is then moved once and not once per hit.
    """
    return chunks.withColumn("content_key", _content_key()).withColumn(
        "content_tokens", estimate_tokens(F.col("content"))).drop("content")


def text_store(chunks: DataFrame) -> DataFrame:
    """(chunk_id, content_key, content) of chunks; a repeated id keeps each of its texts."""
    return chunks.select("chunk_id", _content_key().alias("content_key"), "content").dropDuplicates(TEXT_KEYS)


def with_text(rows: DataFrame, texts: DataFrame | None) -> DataFrame:
    """Rows with their text from the store; without a store they have it."""
    return rows if texts is None else rows.join(texts, TEXT_KEYS)


def evidence_boundary(hits: DataFrame) -> DataFrame:
    """Rows that may be shown as evidence: neither instruction nor internal."""
    return hits.filter((F.col("document_type") != V.INSTRUCTION) & (F.col("visibility") != V.INTERNAL))


def boundary_audit(rows: DataFrame) -> DataFrame:
    """Number of rows that break the evidence boundary; must be 0 behind it."""
    leak = (F.col("document_type") == V.INSTRUCTION) | (F.col("visibility") == V.INTERNAL)
    return rows.agg(F.count("*").alias("checked"), F.count_if(leak).alias("leaks"))


def merge_candidates(hits: DataFrame, cap: int = V.PER_DOCUMENT_CAP) -> DataFrame:
    """First occurrence of every hit over a question's sub-queries, at most ``cap`` per document.

    A question has at most k hits per sub-query, so its group is small.
    """
    arrival = ["subquery_pos", "rank"]
    seen = Window.partitionBy("query_id", "document_name", "page_key", "chunk_id").orderBy(*arrival)
    per_document = Window.partitionBy("query_id", "document_name").orderBy(*arrival)
    keyed = hits.withColumn("page_key", F.array_join(F.array_sort("page_numbers"), ","))
    return (keyed.withColumn("__seen", F.row_number().over(seen)).filter("__seen = 1")
            .withColumn("__doc", F.row_number().over(per_document)).filter(F.col("__doc") <= cap)
            .drop("__seen", "__doc"))


def check_coverage(candidates: DataFrame, required: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Which required metrics the candidates of a question prove.

    ``required(query_id, required_metrics)``; one row per question, also without candidates.  ``texts`` is the text
    store of candidates without text (see ``without_text``).
    """
    pairs = [x for metric, terms in V.METRIC_SYNONYMS.items()
             for x in (F.lit(metric), F.array(*[F.lit(t) for t in terms]))]
    synonyms = F.create_map(*pairs)

    def proofs(metric: Column) -> Column:
        key = F.lower(metric)
        return F.coalesce(F.try_element_at(synonyms, key), F.array(key))

    text = F.lower("content")
    found = let(text, lambda t: F.filter(
        "required_metrics", lambda m: F.exists(proofs(m), lambda s: F.contains(t, s))))
    kept = ["content"] if texts is None else TEXT_KEYS
    asked = with_text(candidates.select("query_id", *kept).join(required, "query_id"), texts)
    per_question = (asked.groupBy("query_id").agg(
                        F.array_sort(F.array_distinct(F.flatten(F.collect_set(found)))).alias("__found"),
                        F.bool_or(text.rlike("(?U)" + V.NUMBER_EVIDENCE)).alias("__numbers")))
    joined = required.join(per_question, "query_id", "left")
    found = F.coalesce("__found", F.array().cast("array<string>"))
    numbers = F.coalesce("__numbers", F.lit(False))
    half = F.greatest(F.lit(1), F.floor(F.size("required_metrics") / 2))
    checked = joined.select(
        *required.columns, found.alias("found_metrics"),
        F.array_except("required_metrics", found).alias("missing_metrics"),
        numbers.alias("has_numbers"), ((F.size(found) >= half) & numbers).alias("is_sufficient"))
    return checked


def fallback_queries(coverage: DataFrame) -> DataFrame:
    """Add ``fallback``: distinct search lines for missing metrics, in order."""
    def lines(metric: Column) -> Column:
        words = F.lower(F.regexp_replace(metric, "_", " "))
        out = None
        for keys, templates in reversed(V.FALLBACK_RULES):
            filled = F.array(*[F.concat(F.lit(t.split("{}")[0]), words, F.lit(t.split("{}")[1]))
                               if "{}" in t else F.lit(t) for t in templates])
            out = filled if out is None else F.when(contains_any(words, keys), filled).otherwise(out)
        return out

    gaps = F.when(F.size("missing_metrics") > 0, F.col("missing_metrics")).otherwise(F.col("required_metrics"))
    needed = (F.size("missing_metrics") > 0) | ~F.col("is_sufficient")
    built = F.array_distinct(F.flatten(F.transform(gaps, lines)))
    return coverage.withColumn("fallback", F.when(needed, built).otherwise(
        F.array().cast("array<string>")))


def second_pass_merge(accepted: DataFrame, hits: DataFrame) -> DataFrame:
    """New second-pass hits after the accepted ones, without the per-document cap."""
    key = ["query_id", "document_name", "page_key", "chunk_id"]
    keyed = hits.withColumn("page_key", F.array_join(F.array_sort("page_numbers"), ","))
    first = Window.partitionBy(*key).orderBy("subquery_pos", "rank")
    fresh = (keyed.join(accepted.select(*key), key, "left_anti")
             .withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n"))
    return accepted.withColumn("pass_no", F.lit(1)).unionByName(
        fresh.select(*accepted.columns).withColumn("pass_no", F.lit(2)))


def candidate_counts(candidates: DataFrame) -> DataFrame:
    """Candidates per question and document."""
    return candidates.groupBy("query_id", "document_name").agg(F.count("*").alias("candidates"))


def evidence_flags(ranked: DataFrame, ownership: list[str] = V.OWNERSHIP_TERMS,
                   marketing: list[str] = V.MARKETING_TERMS, texts: DataFrame | None = None) -> DataFrame:
    """Whether retrieved chunks mention two term groups, with pages and scores."""
    text = F.lower("content")
    return with_text(ranked, texts).groupBy("query_id").agg(
        F.bool_or(contains_any(text, ownership)).alias("ownership_found"),
        F.bool_or(contains_any(text, marketing)).alias("marketing_found"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("page_numbers")))).alias("pages"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))),
                    lambda x: x["score"]).alias("scores"))
