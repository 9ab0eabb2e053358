"""Resharding by minimum-cost flow.

The old layout and the new capacities make a flow network: source -> block (its rows) -> the old shard itself (cost 0)
or the transfer pool (cost: mean bytes of a row of the block) -> new shard -> sink (its capacity).  A block is the rows
of one old shard within one power of two of bytes, so the network has a bounded number of nodes whatever the table
holds, and only block totals reach the driver.  The flow of least cost says how many rows of each block move and where;
within a block the smallest rows move first.  Capacities are row counts at most one apart (law ``rows``).

Rows find their place by running counts over ranges of rows (``common.ranked``), so a shard that holds most rows is no
single task.  ``rewrite`` writes only shards that gain or lose rows.

Results for odd input: a null text has no bytes, size 16, and null crc32; null or repeated ids share an old shard and
are moved apart as any rows; an empty table gives none; fewer rows than shards leave shards with one row or none.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import distinct_rows, ranked, row_keys
from folioscope.session import materialize

OLD_SHARDS = 32
NEW_SHARDS = 40
ROW_BYTES = 16


def size_of(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + ROW_BYTES).cast("long")


def old_shard(shards: int = OLD_SHARDS, doc_id: str = "doc_id") -> Column:
    """The layout before: by hash of the id."""
    return F.pmod(F.xxhash64(doc_id), F.lit(shards)).cast("int")


def band_of(size: Column) -> Column:
    return F.floor(F.log2(size)).cast("int")


class Network:
    """Flow of least cost by cheapest augmenting paths (Dijkstra with potentials)."""

    def __init__(self) -> None:
        self.edges: list[list] = []  # to, room, cost
        self.out: dict[object, list[int]] = {}

    def add(self, a, b, room: int, cost: float) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out.setdefault(x, []).append(len(self.edges))
            self.out.setdefault(y, [])
            self.edges.append([y, r, c])
        return len(self.edges) - 2

    def send(self, source, sink) -> None:
        height = dict.fromkeys(self.out, 0.0)
        while True:
            far, via, heap, n = {source: 0.0}, {}, [(0.0, 0, source)], 0
            while heap:
                d, _, x = heapq.heappop(heap)
                if d > far[x]:
                    continue
                for e in self.out[x]:
                    y, room, cost = self.edges[e]
                    step = d + max(0.0, cost + height[x] - height[y])
                    if room > 0 and step < far.get(y, float("inf")) - 1e-12:
                        far[y], via[y], n = step, e, n + 1
                        heapq.heappush(heap, (step, n, y))
            if sink not in far:
                return
            for x in height:
                height[x] += min(far.get(x, far[sink]), far[sink])
            path, x = [], sink
            while x != source:
                path.append(via[x])
                x = self.edges[via[x] ^ 1][0]
            amount = min(self.edges[e][1] for e in path)
            for e in path:
                self.edges[e][1] -= amount
                self.edges[e ^ 1][1] += amount

    def flow(self, edge: int) -> int:
        return self.edges[edge ^ 1][1]


def transfers(blocks: list[tuple[int, int, int, int]], new_shards: int) -> list[tuple[int, int, int, int, int]]:
    """(old shard, band, first, after, new shard): places in the block, smallest rows first, that leave their shard.

    ``blocks`` has (old shard, band, rows, bytes).
    """
    total = sum(rows for _, _, rows, _ in blocks)
    if not total:
        return []
    capacity = [total // new_shards] * new_shards
    held = dict.fromkeys(range(new_shards), 0)
    for shard, _, rows, _ in blocks:
        if shard < new_shards:
            held[shard] += rows
    # the fullest shards get the odd rows, which saves most moves
    for shard in sorted(held, key=lambda s: (-held[s], s))[:total % new_shards]:
        capacity[shard] += 1
    net, leave, arrive = Network(), {}, {}
    for shard, band, rows, size in blocks:
        block = ("block", shard, band)
        net.add("source", block, rows, 0.0)
        if shard < new_shards:
            net.add(block, ("shard", shard), rows, 0.0)
        leave[shard, band] = net.add(block, "pool", rows, size / max(rows, 1))
    for shard, room in enumerate(capacity):
        arrive[shard] = net.add("pool", ("shard", shard), room, 0.0)
        net.add(("shard", shard), "sink", room, 0.0)
    net.send("source", "sink")
    wanted = [[shard, net.flow(e)] for shard, e in arrive.items() if net.flow(e)]
    out = []
    for (shard, band), e in sorted(leave.items()):
        first, rest = 0, net.flow(e)
        while rest:
            take = min(rest, wanted[-1][1])
            out.append((shard, band, first, first + take, wanted[-1][0]))
            first, rest = first + take, rest - take
            wanted[-1][1] -= take
            if not wanted[-1][1]:
                wanted.pop()
    return out


def assign(docs: DataFrame, keep: list[str], old: Column | None = None, old_shards: int = OLD_SHARDS,
           new_shards: int = NEW_SHARDS) -> DataFrame:
    """Columns ``keep``, size, text_crc32, old_shard, shard and slot; one row per row of ``docs``."""
    spark = docs.sparkSession
    rows = docs.select(*keep, size_of().alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
                       (old_shard(old_shards) if old is None else old).alias("old_shard"))
    rows = rows.withColumn("band", band_of(F.col("size"))).withColumn("one", F.lit(1).cast("long"))
    rows = materialize(rows, "rows")  # ranges are drawn from a sample first: texts are read once only
    placed = materialize(ranked(rows, ["old_shard", "band"], ["size", "text_crc32", *keep], ["one"], "blocks"), "placed")
    blocks = placed.groupBy("old_shard", "band").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")).collect()
    moves = transfers([tuple(b) for b in blocks], new_shards)
    # blocks and new shards bound the moves, not the table
    table = spark.createDataFrame(moves or [(-1, -1, 0, 0, 0)], "m_old int, m_band int, m_first long, m_after long, m_new int")
    moved = placed.join(table, (F.col("old_shard") == F.col("m_old")) & (F.col("band") == F.col("m_band"))
                        & (F.col("before_one") >= F.col("m_first")) & (F.col("before_one") < F.col("m_after")), "left")
    moved = moved.withColumn("shard", F.coalesce("m_new", "old_shard"))
    moved = moved.select(*keep, "size", "text_crc32", "old_shard", "shard", "one")
    slots = ranked(moved, ["shard"], ["old_shard", "size", "text_crc32", *keep], ["one"], "slots")
    return slots.withColumnRenamed("before_one", "slot").drop("one")


def attach(docs: DataFrame, old_shards: int = OLD_SHARDS, new_shards: int = NEW_SHARDS) -> DataFrame:
    """All columns of ``docs`` with shard, slot and shard_bytes; texts move once, to join their rows' places.

    Columns of these names that ``docs`` has are replaced.
    """
    marked = row_keys(docs)
    slim = marked.select("_id", "_row", F.col("_values.text").alias("text"))
    plan = assign(slim, ["_id", "_row"], old=old_shard(old_shards, "_id"), new_shards=new_shards)
    places = plan.select("_id", "_row", "shard", "slot", F.col("size").alias("shard_bytes"))
    own = [c for c in docs.columns if c.lower() not in ("shard", "slot", "shard_bytes")]
    return distinct_rows(marked).join(places, ["_id", "_row"]).select(
        *[F.col("_values")[c].alias(c) for c in own], "shard", "slot", "shard_bytes")


def rewrite(placed: DataFrame, moved: DataFrame, path: str) -> list[int]:
    """Write the files of shards that gained or lost rows below ``path``, replacing only those folders.

    ``placed`` has the table's columns and shard, ``moved`` has old_shard and shard of every row.  Returns the shards.
    """
    changed = moved.filter("old_shard <> shard").select(F.explode(F.array("old_shard", "shard")).alias("s"))
    shards = sorted(r["s"] for r in changed.distinct().collect())
    some = placed.filter(F.col("shard").isin(shards)) if shards else placed.limit(0)
    some.repartition("shard", F.pmod(F.xxhash64("slot"), F.lit(8))).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    return shards
