"""Running aggregates and row numbers that never put a whole group in one task.

A plain window over a hot key (one document, one user) would sort that key's rows
in a single task.  Here the ordering key is cut into blocks of fixed width.  Each
(key, block) is scanned by its own task, one small row per block is aggregated with
map-side combine, and the running total *over blocks* is joined back as a carry.
Sum, count and maximum are associative, so the result equals the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.session import materialize

BLOCK = "__block"
RANGE = "__range"


def running(df: DataFrame, keys: list[str], order: list[str | Column], block: Column,
            specs: dict[str, tuple[str, Column]], inclusive: bool = True) -> DataFrame:
    """Add running aggregates per ``keys`` in ``order``.

    ``block`` must not decrease along ``order``.  ``specs`` maps an output column to
    ``("sum" | "max", expression)``.  Sums start at 0, maxima at null.
    """
    keyed = df.withColumn(BLOCK, block)
    names = list(specs)
    aggs = [(F.sum if how == "sum" else F.max)(expr).alias(f"__t_{name}")
            for name, (how, expr) in specs.items()]
    totals = keyed.groupBy(*keys, BLOCK).agg(*aggs)
    before = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(
        BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, BLOCK, *[
        (F.sum if specs[n][0] == "sum" else F.max)(f"__t_{n}").over(before).alias(f"__c_{n}")
        for n in names])
    inner = Window.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    local = keyed.select("*", *[
        (F.sum if specs[n][0] == "sum" else F.max)(specs[n][1]).over(inner).alias(f"__l_{n}")
        for n in names])
    joined = local.join(carry, keys + [BLOCK], "left")
    out = []
    for name in names:
        carried, here = F.col(f"__c_{name}"), F.col(f"__l_{name}")
        if specs[name][0] == "sum":
            value = F.coalesce(carried, F.lit(0)) + F.coalesce(here, F.lit(0))
        else:
            value = F.greatest(carried, here)
        out.append(value.alias(name))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *out)


def row_numbers(df: DataFrame, keys: list[str], order: list[str | Column], block: Column,
                name: str) -> DataFrame:
    """1-based row number per ``keys`` in ``order``, by blocks."""
    return running(df, keys, order, block, {name: ("sum", F.lit(1).cast("long"))})


def range_blocks(df: DataFrame, keys: list[str], order: list[str], name: str = "ranges") -> DataFrame:
    """``df`` with ``RANGE``, a block for ``running`` that holds about as many rows as any other.

    Ranges of (keys, order) are cut by a sample of the rows, so a key with most rows, or a burst of one key within a
    second, is spread over many of them.  They are written once, as a sample must not be drawn twice; pass slim rows.
    """
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return materialize(df.repartitionByRange(n, *keys, *order).withColumn(RANGE, F.spark_partition_id()), name)


def width_block(c: Column, width: int) -> Column:
    """Block number of an integer ordering key."""
    return F.floor(c / F.lit(width)).cast("long")


def time_block(c: Column, unit: str = "hour") -> Column:
    """Block of a timestamp ordering key."""
    return F.unix_seconds(F.date_trunc(unit, c))
