"""Greedy left-to-right walks (token packing, time-to-live) split into blocks.

Both walks have the same shape: from a mark at item ``i`` the next mark is the first
item at or after a threshold that depends only on nearby items.  One key may be very
large, so its items are cut into blocks of fixed width:

1. every block but the last gives a transfer map "entering threshold -> leaving
   threshold", run-length coded over the few items that can be entered first;
2. the maps of a key are chained in block order (one small row per block, streamed);
3. every block is walked again from its known entry.

Keys with a single block skip steps 1 and 2.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = "__block"
CARRY = "__carry"
OPEN = np.int64(2 ** 62)       # no further mark
START = np.int64(-2 ** 62)     # nothing seen yet

# A step takes the sorted columns of one block and an item index and returns the
# threshold of the mark that follows a mark at that item.
Step = Callable[[dict, int], int]


def segments(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Cut a sorted stream of batches into complete groups."""
    held = None
    for batch in batches:
        if batch.empty:
            continue
        if held is not None:
            batch = pd.concat([held, batch], ignore_index=True)
        change = np.zeros(len(batch), dtype=bool)
        for key in keys:
            col = batch[key].to_numpy()
            change[1:] |= col[1:] != col[:-1]
        cuts = [0, *np.flatnonzero(change).tolist()]
        for left, right in zip(cuts[:-1], cuts[1:]):
            yield batch.iloc[left:right]
        held = batch.iloc[cuts[-1]:]
    if held is not None and len(held):
        yield held


def _in_blocks(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    cols = [*keys, BLOCK]
    return df.repartition(*[F.col(c) for c in cols]).sortWithinPartitions(*cols, *order)


def _transfer(group: pd.DataFrame, pos: str, width: int, reach: int,
              make_step: Callable[[pd.DataFrame], Step]) -> tuple[list[int], list[int]]:
    block = int(group[BLOCK].iloc[0])
    p = group[pos].to_numpy()
    step = make_step(group)
    first, last = np.searchsorted(p, [block * width, (block + 1) * width])
    limit = np.searchsorted(p, block * width + reach)
    end = (block + 1) * width
    known: dict[int, int] = {}
    ends, exits = [], []
    for i in range(first, min(limit + 1, last)):
        path, j = [], i
        while j < last and j not in known:
            path.append(j)
            threshold = step(j)
            if threshold >= end:
                known[j] = threshold
                break
            j = int(np.searchsorted(p, threshold))
        # a walk may end past the last own item without reaching the block end
        out = known[j] if j in known else step(path[-1])
        for k in path:
            known[k] = out
        if exits and exits[-1] == out:
            ends[-1] = int(p[i])
        else:
            ends.append(int(p[i]))
            exits.append(int(out))
    return ends, exits


def entries(items: DataFrame, keys: list[str], pos: str, order: list[str], width: int,
            reach: int, make_step: Callable[[pd.DataFrame], Step], halo: bool) -> DataFrame:
    """Items with their block (and halo copies) and the entry threshold of the block."""
    own = F.floor(F.col(pos) / F.lit(width)).cast("long")
    if halo:
        # the item before a block and the items one reach past it are needed as context
        targets = F.array_compact(F.array(
            own,
            F.when((F.pmod(F.col(pos), F.lit(width)) < reach) & (own > 0), own - 1),
            F.when(F.pmod(F.col(pos), F.lit(width)) == width - 1, own + 1)))
        spread = items.withColumn(BLOCK, F.explode(targets))
    else:
        spread = items.withColumn(BLOCK, own)
    blocks = items.select(*keys, own.alias(BLOCK)).groupBy(*keys, BLOCK).agg(
        F.lit(1).alias("__one"))
    last = blocks.groupBy(*keys).agg(F.max(BLOCK).alias("__last"), F.min(BLOCK).alias("__first")
                                     ).filter("__last > __first")
    inner = spread.join(last, keys).filter(F.col(BLOCK) < F.col("__last")).drop("__last", "__first")
    key_schema = [items.schema[k] for k in keys]
    typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in key_schema)

    def transfers(batches):
        for group in segments(batches, [*keys, BLOCK]):
            ends, exits = _transfer(group, pos, width, reach, make_step)
            row = {k: [group[k].iloc[0]] for k in keys}
            yield pd.DataFrame({**row, BLOCK: [group[BLOCK].iloc[0]],
                                "__ends": [ends], "__exits": [exits]})

    maps = _in_blocks(inner, keys, order).mapInPandas(
        transfers, f"{typed}, `{BLOCK}` long, `__ends` array<long>, `__exits` array<long>")

    def chain(batches):
        previous, carry = None, START
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                key = tuple(row[:len(keys)])
                if key != previous:
                    previous, carry = key, START
                out.append((*key, row[len(keys)], int(carry)))
                ends = row[len(keys) + 1]
                if ends is not None and len(ends):
                    at = int(np.searchsorted(np.asarray(ends), carry))
                    if at < len(ends):
                        carry = row[len(keys) + 2][at]
            yield pd.DataFrame(out, columns=[*keys, BLOCK, CARRY])

    chained = (blocks.drop("__one").join(last.select(*keys), keys)
               .join(maps, [*keys, BLOCK], "left")
               .select(*keys, BLOCK, "__ends", "__exits")
               .repartition(*keys).sortWithinPartitions(*keys, BLOCK)
               .mapInPandas(chain, f"{typed}, `{BLOCK}` long, `{CARRY}` long"))
    return spread.join(chained, [*keys, BLOCK], "left").withColumn(
        CARRY, F.coalesce(F.col(CARRY), F.lit(int(START))))


def walk(entered: DataFrame, keys: list[str], order: list[str], schema: str,
         emit: Callable[[pd.DataFrame], dict[str, np.ndarray]]) -> DataFrame:
    """Run ``emit``, which returns columns, on every (key, block) group of an entered table."""

    def table(ready):
        return pd.DataFrame({name: np.concatenate([part[name] for part in ready]) for name in ready[0]})

    def run(batches):
        ready, size = [], 0
        for group in segments(batches, [*keys, BLOCK]):
            ready.append(emit(group))
            size += len(group)
            if size > 20000:
                yield table(ready)
                ready, size = [], 0
        if ready:
            yield table(ready)

    return _in_blocks(entered, keys, order).mapInPandas(run, schema)
