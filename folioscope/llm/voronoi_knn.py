"""Exact top-k by inner product as a Voronoi join.

Vectors are grouped by their nearest pivot; there are about as many pivots as blocks of ``BLOCK_ROWS`` rows, within
``PIVOTS`` and ``MOST_PIVOTS``.  A query first meets one group only, whose pivot has the largest product with it; the k-th
score that it finds there is a score that its results reach for certain.  A summary of each other group bounds the inner
product of the query q with any member c: with u the direction of the pivot p, c lies between the least and the largest
c.u of the group, at most a distance s off that direction and at most r from the pivot, so
q.c <= max(q.u * c.u) + |q - (q.u)u| s and q.c <= q.p + |q| r.  The query is copied only to groups whose bound reaches
its k-th score.  Groups are cut into blocks of about ``BLOCK_ROWS`` rows, on the side of the data and of the queries, and
each pair of blocks is solved by one task of bounded size; the best k per query are merged by a window.

Components are floor(256 * x) with x as double.  Products are exact: by float64 matrix products while all sums stay
below 2**53, else by whole numbers of any length; a score beyond a long is cut to the largest or smallest long.

Results for odd input: null vectors, and vectors with null, NaN or infinite components, take no part; vectors of
different lengths do not meet (each length is a table of its own, and has summaries of its own); a query meets every
row but itself, also rows with its id; null ids are candidates after all others and never queries; fewer than k
candidates give all; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.session import materialize

PIVOTS = 32
MOST_PIVOTS = 1024
BLOCK_ROWS = 1024
SCALE = 256.0
TOP = 5
QUERY_EVERY = 50
_EXACT = 2.0 ** 53
_LONGEST = 2 ** 63 - 1


def quantised(df: DataFrame) -> DataFrame:
    """row_id, vec_id, dim, v of the vectors that take part."""
    rows = df.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("double")).alias("v"),
                     "embedding")
    whole = F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))) & ~F.isnan(x.cast("double")))
    return rows.filter(whole).select(F.monotonically_increasing_id().alias("row_id"), "vec_id",
                                     F.size("v").alias("dim"), "v")


def choose_pivots(rows: DataFrame, k: int = PIVOTS) -> dict[int, np.ndarray]:
    """At most ``k`` vectors by length, those whose ids hash smallest."""
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("dim", "v").limit(k).collect()
    out: dict[int, list] = {}
    for r in picked:
        out.setdefault(r["dim"], []).append(r["v"])
    return {d: np.unique(np.array(v, dtype=np.float64).reshape(len(v), d), axis=0) for d, v in out.items()}


def pivots_of(pivots: dict[int, np.ndarray], dim: int) -> np.ndarray:
    return pivots.get(dim, np.zeros((1, dim)))


def _matrix(column: pa.Array | pd.Series, dim: int) -> np.ndarray:
    return np.array(list(column), dtype=np.float64).reshape(len(column), dim)


class Cells:
    """Pivots of one length, with what is known of the rows of their cells."""

    def __init__(self, pivots: np.ndarray) -> None:
        n = len(pivots)
        norms = np.sqrt((pivots ** 2).sum(axis=1))
        self.pivots, self.directions = pivots, pivots / np.where(norms > 0, norms, 1.0)[:, None]
        self.counts = np.zeros(n, dtype=np.int64)
        self.low, self.high, self.off, self.far = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)


def assign_cells(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Add the cell (place of a nearest pivot), the distance to the pivot, and the length along and off its direction."""
    def run(frames):
        for frame in frames:
            cell, far, along, off = np.zeros(len(frame), dtype=np.int32), *np.zeros((3, len(frame)))
            for dim, place in frame.groupby("dim").indices.items():
                v, known = _matrix(frame["v"].iloc[place], dim), Cells(pivots_of(pivots, dim))
                with np.errstate(all="ignore"):
                    own = ((known.pivots ** 2).sum(axis=1)[None] - 2 * (v @ known.pivots.T)).argmin(axis=1)
                    u = known.directions[own]
                    cell[place], along[place] = own, (v * u).sum(axis=1)
                    far[place] = np.sqrt(((v - known.pivots[own]) ** 2).sum(axis=1))
                    off[place] = np.sqrt(((v - along[place][:, None] * u) ** 2).sum(axis=1))
            yield frame.assign(cell=cell, far=far, along=along, off=off)

    return rows.mapInPandas(run, "row_id long, vec_id long, dim int, v array<double>, cell int, far double, along double, "
                                 "off double")


def home(v: np.ndarray, cells: Cells, k: int) -> np.ndarray:
    """The cell that each query meets first: the nearest by inner product of those with more than k rows, if any."""
    middle = v @ cells.pivots.T
    middle[:, cells.counts == 0] = -np.inf
    full = cells.counts > k
    return np.where(full[None, :], middle, -np.inf).argmax(axis=1) if full.any() else middle.argmax(axis=1)


def reached(v: np.ndarray, cells: Cells, least: np.ndarray) -> np.ndarray:
    """Boolean (query, cell): whether the cell can hold a score of ``least`` or more; unknown bounds reach all."""
    with np.errstate(all="ignore"):
        norms = np.sqrt((v ** 2).sum(axis=1))[:, None]
        along = v @ cells.directions.T
        rest = np.sqrt(np.maximum(0.0, norms ** 2 - along ** 2) + 1e-9 * norms ** 2)
        by_direction = np.maximum(along * cells.low, along * cells.high) + rest * cells.off
        by_radius = v @ cells.pivots.T + norms * cells.far
        room = 1e-9 * (1 + norms * (np.maximum(abs(cells.low), abs(cells.high)) + cells.off + cells.far))
        # scores are cut to longs, so no bound is below the smallest
        upper = np.maximum(np.minimum(by_direction, by_radius) + room, -float(_LONGEST))
        return ~(upper < least[:, None]) & (cells.counts > 0)[None, :]


def products(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Exact inner products: float64 where exact, else Python integers."""
    if not queries.size or not data.size:
        return np.zeros((len(queries), len(data)))
    if np.abs(queries).max() * np.abs(data).max() * max(1, queries.shape[1]) < _EXACT:
        return queries @ data.T
    whole = [[int(x) for x in row] for row in data]
    out = np.empty((len(queries), len(data)), dtype=object)
    for i, row in enumerate(queries):
        q = [int(x) for x in row]
        for j, d in enumerate(whole):
            out[i, j] = max(-_LONGEST - 1, min(_LONGEST, sum(a * b for a, b in zip(q, d, strict=True))))
    return out


def solve(queries: pd.DataFrame, data: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best k of one block of data for every query of one block."""
    found: list[tuple] = []
    if len(queries) and len(data):
        dim = int(data["dim"].iloc[0])
        data = data.assign(last=data["vec_id"].isna()).sort_values(["last", "vec_id"], kind="stable")
        scores = products(_matrix(queries["v"], dim), _matrix(data["v"], dim))
        rows, ids = data["row_id"].to_numpy(), [None if pd.isna(x) else int(x) for x in data["vec_id"]]
        for i, (row, query) in enumerate(zip(queries["row_id"], queries["vec_id"], strict=True)):
            best = np.argsort(-scores[i], kind="stable")[:k + 1]
            best = best[rows[best] != row][:k]
            found += [(int(row), int(query), ids[j], int(scores[i][j])) for j in best]
    columns = list(zip(*found, strict=True)) or [()] * 4
    return pd.DataFrame({name: pd.array(values, dtype="Int64") for name, values in zip(
        ("query_row", "query_id", "vec_id", "score"), columns, strict=True)})


def summaries(placed: DataFrame, centres: dict[int, np.ndarray]) -> dict[int, Cells]:
    """What is known of each cell, by length; the size follows the pivots, not the rows."""
    found: dict[int, Cells] = {}
    for r in placed.groupBy("dim", "cell").agg(
            F.count("*").alias("n"), F.min("along").alias("low"), F.max("along").alias("high"),
            F.max("off").alias("off"), F.max("far").alias("far")).collect():
        cells = found.setdefault(r["dim"], Cells(pivots_of(centres, r["dim"])))
        cells.counts[r["cell"]] = r["n"]
        cells.low[r["cell"]], cells.high[r["cell"]] = r["low"], r["high"]
        cells.off[r["cell"]], cells.far[r["cell"]] = r["off"], r["far"]
    return found


def meet(copies: DataFrame, placed: DataFrame, summary: dict[int, Cells], k: int, block_rows: int) -> DataFrame:
    """query_row, query_id, vec_id, score: the best k of each block of data for the queries copied to its cell."""
    load = {(r["dim"], r["cell"]): r["n"] for r in copies.groupBy("dim", "cell").agg(F.count("*").alias("n")).collect()}
    blocks = [(dim, c, max(1, -(-int(n) // block_rows)), -(-load[dim, c] // block_rows))
              for dim, cells in summary.items() for c, n in enumerate(cells.counts) if (dim, c) in load]
    shape = copies.sparkSession.createDataFrame(
        blocks or [(-1, -1, 1, 1)], "dim int, cell int, data_blocks int, query_blocks int")
    turn = F.xxhash64("row_id")

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        """Rows of one side in their own block, once for every block of the other side."""
        parts = df.join(F.broadcast(shape), ["dim", "cell"])
        parts = parts.withColumn(own[:-1], F.pmod(turn, F.col(own)).cast("int"))
        return parts.withColumn(other[:-1], F.explode(F.sequence(F.lit(0), F.col(other) - 1))).select(
            "row_id", "vec_id", "dim", "v", "cell", "data_block", "query_block")

    keys = ["dim", "cell", "data_block", "query_block"]
    left = dealt(copies, "query_blocks", "data_blocks").groupBy(*keys)
    right = dealt(placed, "data_blocks", "query_blocks").groupBy(*keys)
    return left.cogroup(right).applyInPandas(
        lambda a, b: solve(a, b, k), "query_row long, query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, k: int = TOP, every: int = QUERY_EVERY, pivots: int | None = None,
          block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of every row whose vec_id is divisible by ``every``."""
    rows = materialize(quantised(vectors), "vectors")
    if pivots is None:
        pivots = min(MOST_PIVOTS, max(PIVOTS, rows.count() // block_rows))
    centres = choose_pivots(rows, pivots)
    placed = materialize(assign_cells(rows, centres), "cells")
    summary = summaries(placed, centres)
    schema = "row_id long, vec_id long, dim int, v array<double>, cell int"

    def first(frames):
        for frame in frames:
            for dim, place in frame.groupby("dim").indices.items():
                own = frame.iloc[place]
                yield own.assign(cell=home(_matrix(own["v"], dim), summary[dim], k).astype(np.int32))

    def others(frames):
        for frame in frames:
            for dim, place in frame.groupby("dim").indices.items():
                own = frame.iloc[place]
                least = own["least"].to_numpy(dtype=np.float64, na_value=-np.inf)
                hit = reached(_matrix(own["v"], dim), summary[dim], np.where(np.isnan(least), -np.inf, least))
                hit[np.arange(len(own)), own["cell"]] = False  # met before
                query, cell = np.nonzero(hit)
                yield own.iloc[query][["row_id", "vec_id", "dim", "v"]].assign(cell=cell.astype(np.int32))

    queries = placed.filter(F.col("vec_id") % every == 0).select("row_id", "vec_id", "dim", "v")
    placed = placed.select("row_id", "vec_id", "dim", "v", "cell")
    queries = materialize(queries.mapInPandas(first, schema), "queries")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    near = materialize(meet(queries, placed, summary, k, block_rows).withColumn("rank", F.row_number().over(order))
                       .filter(F.col("rank") <= k), "near")
    sure = near.filter(F.col("rank") == k).select(F.col("query_row").alias("row_id"), F.col("score").cast("double").alias("least"))
    copies = materialize(queries.join(sure, "row_id", "left").mapInPandas(others, schema), "copies")
    both = near.drop("rank").unionByName(meet(copies, placed, summary, k, block_rows))
    ranked = both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
