"""Near copies among vectors of one label, by a forest of random projection trees with spill.

Trees.  All vectors of one label and length start in the root of each of ``TREES`` trees.  A node with more than about
``LEAF`` vectors is split: of a few random directions (numbers drawn from a hash of the node) the one along which a
sample spreads most is cut where the sample is thinnest between its 30th and 70th percentile.  Vectors within ``SPILL``
of the cut go to both sides, so a pair is parted only if its projections lie further apart than twice that and on
both sides of the cut; many trees make it unlikely that one pair is parted in all.  A node is one dense group and stays
whole where the halves, with what spills over, would need more than ``MOST_WORK`` of its comparisons.  Samples are bounded for each node, rows are routed where they lie, and a round of
samples grows trees by up to ``LEVELS`` levels; rounds go on until no splittable node is too large.

Leaves.  Every leaf compares all its pairs by cosine in double precision, in blocks of at most ``BLOCK`` vectors: a
leaf of b blocks is b * (b + 1) / 2 tasks, whatever the leaf's size.  A pair that shares several leaves counts in the
least of them only (both vectors carry the list of their leaves), so numbers of links are those of distinct partners
without a table of pairs.  Each task returns one row per vector that it links: its number of new partners and the
least vector of its group there.  These are the edges of the union by large-star and small-star steps.

Equal vectors of one label are one class with a weight; they are combined before anything moves.  A pair below the
threshold is never linked.  A pair above it can be missed, if all trees part it; labels with at most ``LEAF`` distinct
vectors are one leaf and exact.  Dense groups cost the square of their number of different vectors, spread over tasks.

Results for odd input: vectors that are null, empty, zero, or hold null or non-finite components, and rows without
label, link with nothing and are their own component; vectors of different lengths never link; rows with equal ids are
rows of their own; a null id counts as no id: its row is never kept, and a component of null ids only has a null id;
an empty table gives none.  Columns other than vec_id, label and embedding are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.jaccard_join import components
from folioscope.session import materialize

LEAST_COSINE = 0.93
TREES = 4
LEAF = 256
BLOCK = 1024
SAMPLE = 4096
LEVELS = 6
DIRECTIONS = 6
SPILL = 0.75
MOST_WORK = 0.7
LEAST_SAMPLE = 24


def classes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with the key of their class, classes: rid, grp, v, weight, low) of the usable vectors; others have no key."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double"))
                      & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    zero = F.forall("embedding", lambda c: c.cast("double") == 0)
    usable = F.col("embedding").isNotNull() & F.col("label").isNotNull() & finite & ~zero
    key = F.when(F.coalesce(usable, F.lit(False)), F.struct(
        F.xxhash64("label", x).alias("one"), F.xxhash64(F.lit(1), "label", x).alias("two")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding", key.alias("key"))
    made = rows.filter("key is not null").groupBy("key").agg(
        F.first("label").alias("label"), F.first("embedding").alias("v"), F.count("*").alias("weight"),
        F.min("vec_id").alias("low"))
    made = made.select("key", F.monotonically_increasing_id().alias("rid"),
                       F.xxhash64("label", F.size("v")).alias("grp"), "v", "weight", "low")
    return rows.select("vec_id", "key"), materialize(made, "classes")


def mixed(x: int) -> int:
    """A well-mixed 64-bit number."""
    x &= (1 << 64) - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    x = (x ^ x >> 27) * 0x94D049BB133111EB & (1 << 64) - 1
    return x ^ x >> 31


def child(leaf: int, node: int) -> int:
    """The id, a signed long, of a node below ``leaf``."""
    x = mixed(mixed(leaf) + node * 0x9E3779B97F4A7C15)
    return x - (1 << 64) if x >> 63 else x


def direction(leaf: int, node: int, turn: int, dim: int) -> np.ndarray:
    """A random unit vector that leaf, node and turn decide."""
    made = np.random.Generator(np.random.Philox(key=[leaf & (1 << 64) - 1, node << 8 | turn])).standard_normal(dim)
    return made / np.linalg.norm(made)


def units(vectors: pd.Series) -> np.ndarray:
    v = np.array(vectors.tolist(), dtype=np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)  # squares stay in range
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def margin(dim: int, cosine: float, spill: float) -> float:
    """Half the overlap: ``spill`` times what the projections of a pair at the threshold differ by on average."""
    return spill * math.sqrt(max(0.0, 2 - 2 * cosine) / dim) / 2


def best_split(v: np.ndarray, leaf: int, node: int, tau: float) -> tuple[int, float] | None:
    """(turn, cut) of the split of a sample, or None where so much spills over that it would hardly save comparisons."""
    best = None
    for turn in range(DIRECTIONS):
        p = np.sort(v @ direction(leaf, node, turn, v.shape[1]))
        if best is None or p.std() > best[0]:
            best = p.std(), turn, p
    _, turn, p = best
    cuts = p[int(0.3 * len(p)):max(int(0.7 * len(p)), int(0.3 * len(p)) + 1)]
    held = np.searchsorted(p, cuts + tau, "right") - np.searchsorted(p, cuts - tau, "left")
    at = int(held.argmin())
    cut = float(cuts[at])
    left, right = (p <= cut + tau).mean(), (p >= cut - tau).mean()
    return None if left ** 2 + right ** 2 > MOST_WORK else (turn, cut)


def fit(frame: pd.DataFrame, cosine: float, leaf_rows: int, spill: float, levels: int) -> pd.DataFrame:
    """The splits below one node from its sample: heap-ordered turns (-1: a leaf, -2: to go on) and cuts."""
    leaf, n = int(frame["leaf"].iloc[0]), int(frame["n"].iloc[0])
    v = units(frame.sort_values("rid")["v"])
    tau, rate = margin(v.shape[1], cosine, spill), len(v) / n
    turns, cuts = [-1] * (2 ** (levels + 1)), [0.0] * (2 ** (levels + 1))

    def grow(node: int, at: np.ndarray, level: int) -> None:
        if len(at) / rate <= leaf_rows:
            return
        if level == levels or len(at) < LEAST_SAMPLE and rate < 1:
            turns[node] = -2
            return
        found = best_split(v[at], leaf, node, tau)
        if found is None:
            return
        turns[node], cuts[node] = found
        p = v[at] @ direction(leaf, node, found[0], v.shape[1])
        grow(2 * node, at[p <= found[1] + tau], level + 1)
        grow(2 * node + 1, at[p >= found[1] - tau], level + 1)

    grow(1, np.arange(len(v)), 0)
    if turns[1] == -2:
        turns[1] = -1
    return pd.DataFrame({"leaf": [leaf], "turns": [turns], "cuts": [cuts]})


def route(v: np.ndarray, leaf: int, turns: list[int], cuts: list[float], tau: float) -> Iterator[tuple[np.ndarray, int, bool]]:
    """(places, leaf, whether it may be split further) of the vectors of one node."""
    todo = [(1, np.arange(len(v)))]
    while todo:
        node, at = todo.pop()
        if not len(at):
            continue
        if turns[node] < 0:
            yield at, (leaf if node == 1 else child(leaf, node)), turns[node] == -2
            continue
        p = v[at] @ direction(leaf, node, turns[node], v.shape[1])
        todo += [(2 * node, at[p <= cuts[node] + tau]), (2 * node + 1, at[p >= cuts[node] - tau])]


def grow_forest(classes: DataFrame, cosine: float, trees: int, leaf_rows: int, spill: float,
                sample: int, levels: int) -> DataFrame:
    """(rid, leaf) of every class in every leaf that it is routed to."""
    sizes = classes.groupBy("grp").agg(F.count("*").alias("n")).withColumnRenamed("grp", "g")
    rooted = classes.join(sizes, F.col("grp") == F.col("g"))
    small = rooted.filter(F.col("n") <= leaf_rows).select("rid", F.col("grp").alias("leaf"))
    closed = [small]
    big = rooted.filter(F.col("n") > leaf_rows).withColumn("tree", F.explode(F.sequence(F.lit(1), F.lit(trees))))
    opened = materialize(big.select("rid", F.xxhash64("grp", "tree").alias("leaf"), "v", "n"), "roots")
    while not opened.isEmpty():
        # about ``sample`` rows of every node, those whose hash is small
        turn = F.pmod(F.xxhash64("rid", "leaf"), F.lit(1 << 30)) * F.col("n") < F.lit(sample << 30)
        splits = opened.filter(turn).groupBy("leaf").applyInPandas(
            lambda frame: fit(frame, cosine, leaf_rows, spill, levels), "leaf long, turns array<int>, cuts array<double>")
        splits = materialize(splits, "splits")

        def routed(frames):
            for frame in frames:
                out = []
                for leaf, own in frame.groupby("leaf"):
                    v = units(own["v"])
                    tau = margin(v.shape[1], cosine, spill)
                    first = own.iloc[0]
                    if first["turns"] is None:
                        turns, cuts = [-1, -1], [0.0, 0.0]
                    else:
                        turns, cuts = list(first["turns"]), list(first["cuts"])
                    for at, below, more in route(v, int(leaf), turns, cuts, tau):
                        some = own.iloc[at][["rid", "v"]].assign(leaf=below, more=more)
                        out.append(some if more else some.assign(v=None))
                if out:
                    yield pd.concat(out)[["rid", "leaf", "more", "v"]]

        kind = classes.schema["v"].dataType.simpleString()
        # a node without a sample, which chance can leave out, is a leaf
        placed = materialize(opened.join(splits, "leaf", "left").select("leaf", "rid", "v", "turns", "cuts").mapInPandas(
            routed, f"rid long, leaf long, more boolean, v {kind}"), "placed")
        counts = placed.filter("more").groupBy("leaf").agg(F.count("*").alias("n"))
        opened = placed.filter("more").join(counts.filter(F.col("n") > leaf_rows), "leaf").select("rid", "leaf", "v", "n")
        closed.append(placed.filter("not more").select("rid", "leaf"))
        closed.append(placed.filter("more").join(counts.filter(F.col("n") <= leaf_rows), "leaf").select("rid", "leaf"))
    out = closed[0]
    for part in closed[1:]:
        out = out.unionByName(part)
    return out


def compare(frame: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """rid, links, least of the vectors of one unit (a block, or two blocks) that link with others there."""
    frame = frame.sort_values(["block", "rid"], kind="stable")
    leaf, low, high = (int(frame[c].iloc[0]) for c in ("leaf", "low", "high"))
    v, rid = units(frame["v"]), frame["rid"].to_numpy()
    weight = frame["weight"].to_numpy().astype(np.int64)
    one = frame["block"].to_numpy() == low
    rows, columns = (np.flatnonzero(one), np.flatnonzero(~one)) if low != high else (np.arange(len(v)),) * 2
    near = v[rows] @ v[columns].T >= cosine
    if low == high:
        np.fill_diagonal(near, False)
    # pairs that meet in a lesser leaf count there
    lists = [[x for x in leaves if x < leaf] for leaves in frame["leaves"]]
    names = {x: i for i, x in enumerate(sorted({x for leaves in lists for x in leaves}))}
    if names and near.any():
        marks = np.zeros((len(v), len(names)), dtype=np.float32)
        for i, leaves in enumerate(lists):
            marks[i, [names[x] for x in leaves]] = 1
        near &= marks[rows] @ marks[columns].T == 0
    links = np.zeros(len(v), dtype=np.int64)
    links[rows] += near @ weight[columns]
    if low != high:
        links[columns] += weight[rows] @ near
    # the least vector of each group, handed on along links until nothing changes
    group = np.arange(len(v))
    r, c = np.nonzero(near)
    a, b = rows[r], columns[c]
    while len(a):
        least = np.minimum(group[a], group[b])
        before = group.copy()
        np.minimum.at(group, a, least)
        np.minimum.at(group, b, least)
        group = group[group]
        if (group == before).all():
            break
    least = pd.Series(rid).groupby(group).transform("min").to_numpy() if len(v) else rid
    some = links > 0
    return pd.DataFrame({"rid": rid[some], "links": links[some], "least": least[some]})


def link(classes: DataFrame, places: DataFrame, cosine: float, block: int) -> DataFrame:
    """rid, links, least of every class in every unit where it links with others."""
    places = materialize(places, "leaves")
    sizes = places.groupBy("leaf").agg(F.count("*").alias("n")).filter("n > 1").select(
        "leaf", F.ceil(F.col("n") / F.lit(block)).cast("int").alias("blocks"))
    lists = places.groupBy("rid").agg(F.sort_array(F.collect_set("leaf")).alias("leaves"))
    rows = classes.select("rid", "v", "weight").join(lists, "rid").withColumn("leaf", F.explode("leaves"))
    rows = rows.join(sizes, "leaf").withColumn("block", F.pmod(F.xxhash64("rid", "leaf"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units_of = rows.select("leaf", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
                           "rid", "block", "weight", "leaves", "v")
    return units_of.groupBy("leaf", "low", "high").applyInPandas(
        lambda frame: compare(frame, cosine), "rid long, links long, least long")


def near_copies(vectors: DataFrame, cosine: float = LEAST_COSINE, trees: int = TREES, leaf_rows: int = LEAF,
                spill: float = SPILL, block: int = BLOCK, sample: int = SAMPLE, levels: int = LEVELS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    rows, classes = classes_of(vectors)
    places = grow_forest(classes, cosine, trees, leaf_rows, spill, sample, levels)
    found = materialize(link(classes, places, cosine, block), "links")
    roots = components(found.select(F.col("rid").alias("a"), F.col("least").alias("b")))
    links = found.groupBy("rid").agg(F.sum("links").alias("links"))
    known = classes.select("key", "rid", "weight", "low").join(links, "rid", "left").join(
        roots.withColumnRenamed("key", "rid"), "rid", "left")
    known = materialize(known.select(
        "key", "low", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("root", "rid").alias("root")), "known")
    least = known.groupBy("root").agg(F.min("low").alias("least"))
    known = known.join(least, "root").select("key", "n_links", "least")
    own = rows.filter("key is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = own.unionByName(rows.filter("key is not null").join(known, "key").select(
        "vec_id", "n_links", F.col("least").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
