"""Removal of a whole table of secrets from texts, in one walk per text and block of secrets.

Secrets are put into one automaton per block of at most about ``BLOCK_CHARS`` characters, however many there are; a walk
over a text finds all places of all secrets of the block.  The places found by all blocks are then resolved as if the
longest secret were replaced first, then the next: of overlapping places the longest stays, of equally long ones the
first.  A marker is never searched again.

Secrets of up to ``V.MIN_SECRET_CHARS`` characters without their margins, and null secrets, are left alone, as are
texts without a secret; null and empty texts become the name of an unknown error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions import vocab as V
from folioscope.functions.text import strip
from folioscope.session import materialize

BLOCK_CHARS = 4 << 20
_PLACES = "__places"
_ROW = "__row"


def resolve(text: str, places: list[tuple[int, int]], marker: str) -> str:
    """``text`` with ``marker`` at the (start, length) places that stay."""
    taken: list[tuple[int, int]] = []
    free = bytearray(len(text))
    for start, length in sorted(places, key=lambda p: (-p[1], p[0])):
        if not any(free[start:start + length]):
            free[start:start + length] = b"\x01" * length
            taken.append((start, length))
    out, at = [], 0
    for start, length in sorted(taken):
        out += [text[at:start], marker]
        at = start + length
    return "".join([*out, text[at:]])


def walker(secrets: Broadcast) -> Callable:
    """A function that finds all (start, length) places of the secrets in a column of texts."""
    def walk(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick
        automaton = ahocorasick.Automaton()
        for secret in secrets.value:
            automaton.add_word(secret, len(secret))
        if secrets.value:
            automaton.make_automaton()
        for column in texts:
            yield pd.Series([[] if not t or not secrets.value else
                             [(end - length + 1, length) for end, length in automaton.iter(t)] for t in column])

    return walk


def redact_secret_table(rows: DataFrame, secrets: DataFrame, text: str = "message", marker: str = V.REDACTED,
                        block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``rows`` with every secret of ``secrets(secret)`` replaced in column ``text``.

    The driver holds one block at a time, and a task one automaton: with several blocks the places that each finds are
    written before the next is built, and join their rows by number.  With one block rows stay where they are.
    """
    spark = rows.sparkSession
    known = secrets.select("secret").filter(F.length(strip(F.col("secret"))) > V.MIN_SECRET_CHARS).distinct()
    chars = known.agg(F.coalesce(F.sum(F.length("secret")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // block_chars))
    place = T.ArrayType(T.ArrayType(T.IntegerType()))
    none = F.array().cast(place)
    found = rows.withColumn(_PLACES, none)
    numbered, parts = rows, []
    if blocks > 1:
        numbered = materialize(rows.withColumn(_ROW, F.monotonically_increasing_id()), "redacted-rows")
    for block in range(blocks if chars else 0):
        own = spark.sparkContext.broadcast(
            [r[0] for r in known.filter(F.pmod(F.xxhash64("secret"), F.lit(blocks)) == block).collect()])

        here = F.pandas_udf(walker(own), place)(F.col(text))
        if blocks == 1:
            found = rows.withColumn(_PLACES, here)
        else:
            parts.append(materialize(numbered.select(_ROW, here.alias(_PLACES)).filter(F.size(_PLACES) > 0), "places"))
            own.destroy()
    if parts:
        places = reduce(DataFrame.unionByName, parts).groupBy(_ROW).agg(F.flatten(F.collect_list(_PLACES)).alias(_PLACES))
        found = numbered.join(places, _ROW, "left").withColumn(_PLACES, F.coalesce(_PLACES, none)).drop(_ROW)

    def replaced(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, places in columns:
            yield pd.Series([t if t is None or not len(p) else resolve(t, [tuple(x) for x in p], marker)
                             for t, p in zip(texts, places, strict=True)], dtype=object)

    clean = F.pandas_udf(replaced, "string")(F.col(text), F.col(_PLACES)) if chars else F.col(text)
    out = F.when(F.coalesce(F.col(text), F.lit("")) == "", "UnknownError").otherwise(clean)
    return found.withColumn(text, out).drop(_PLACES)
