"""Benchmark decontamination by pigeonhole edit matching.

An item of n characters may be found with k = n * EDIT_RATE errors.  It is cut into k + 1 pieces: whoever contains the
item with at most k errors contains one piece unchanged.  All pieces are searched at once in every text (one automaton
per block of items); a hit is verified by Myers' bit-parallel distance over the stretch that can hold the whole item.

Letters are lower-cased and white space becomes one blank before matching, on both sides.  Texts are read whole and
stay where they lie; items are the query set and are taken in blocks of bounded size, so that the automaton in a task
is bounded however many items there are.

Results for odd input: null or empty texts match nothing; items that are null or shorter than ``MIN_CHARS`` after
normalising are skipped; equal items match each by its id; repeated rows are reported each; no items: no matches.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import keep_texts, map_texts

EDIT_RATE = 0.06
MIN_CHARS = 24
BLOCK_CHARS = 4 << 20


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(chars: int, rate: float = EDIT_RATE) -> int:
    return int(chars * rate)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(start, piece): errors + 1 pieces of nearly equal length."""
    n = errors + 1
    edges = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def best_match(item: str, peq: dict[str, int], text: str) -> tuple[int, int]:
    """(distance, end): the least edit distance of ``item`` to a substring of ``text`` and its first end."""
    m = len(item)
    full, high = (1 << m) - 1, 1 << m - 1
    plus, minus, score = full, 0, m
    best, end = m, 0
    get = peq.get
    for j, c in enumerate(text, 1):
        eq = get(c, 0)
        x = eq | minus
        d0 = ((((x & plus) + plus) ^ plus) | x) & full
        up = minus | ~(d0 | plus) & full
        down = plus & d0
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up = up << 1 & full  # a match may start anywhere: nothing comes in at the top
        down = down << 1 & full
        plus = down | ~(d0 | up) & full
        minus = up & d0
        if score < best:
            best, end = score, j
            if not best:
                break
    return best, end


class Matcher:
    """Searches a block of items in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float = EDIT_RATE) -> None:
        import ahocorasick
        self.items = [(i, t, budget(len(t), rate), masks(t)) for i, t in items]
        found: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, errors, _) in enumerate(self.items):
            for start, piece in pieces(t, errors):
                found.setdefault(piece, []).append((n, start))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        if found:
            self.automaton.make_automaton()

    def find(self, text: str) -> dict[int, tuple[int, int]]:
        """item number: (distance, end) for items within their budget; the least distance, then the first end."""
        if not self.items:
            return {}
        spans: dict[int, list[list[int]]] = {}
        for end, (length, places) in self.automaton.iter(text):
            for n, start in places:
                _, item, errors, _ = self.items[n]
                first = max(0, end + 1 - length - start - errors)
                last = min(len(text), end + 1 - length - start + len(item) + errors)
                own = spans.setdefault(n, [])
                if own and first <= own[-1][1]:
                    own[-1][0], own[-1][1] = min(own[-1][0], first), max(own[-1][1], last)
                else:
                    own.append([first, last])
        out = {}
        for n, own in spans.items():
            _, item, errors, peq = self.items[n]
            best = None
            for first, last in own:
                distance, end = best_match(item, peq, text[first:last])
                if distance <= errors and (best is None or distance < best[0]):
                    best = (distance, first + end)
            if best:
                out[n] = best
        return out


def item_blocks(items: DataFrame, block_chars: int = BLOCK_CHARS) -> list[list[tuple[int, str]]]:
    """Items (item_id, text) in blocks of about ``block_chars`` characters, read one block after the other."""
    clean = items.select("item_id", F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))).alias("text")).filter(
        F.length("text") >= MIN_CHARS)
    total = clean.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = total // block_chars + 1
    for b in range(n):
        rows = clean.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).select("item_id", "text").collect()
        yield sorted(((r["item_id"], normal(r["text"])) for r in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def _search(items: list[tuple[int, str]], rate: float) -> Callable[[str | None], list]:
    held: list[Matcher] = []

    def find(text):
        if not held:
            held.append(Matcher(items, rate))
        t = normal(text)
        return [(held[0].items[n][0], d, end, held[0].items[n][2]) for n, (d, end) in held[0].find(t).items()]
    return find


def matches(docs: DataFrame, items: DataFrame, rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, distance, edit_budget, found_end (in the normal text): one row per row and item found in it."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("item_id", items.schema["item_id"].dataType),
                           T.StructField("distance", T.IntegerType()), T.StructField("edit_budget", T.IntegerType()),
                           T.StructField("found_end", T.LongType())])
    out = None
    for block in item_blocks(items, block_chars):
        find = _search(block, rate)

        def run(batch, find=find):
            rows = [(i, *hit) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(),
                                              strict=True) if t for hit in find(t)]
            if not rows:
                return None
            ids, item, distance, end, errors = zip(*rows, strict=True)
            arrow = [pa.array(ids, batch.schema.field("doc_id").type), pa.array(item), pa.array(distance, pa.int32()),
                     pa.array(errors, pa.int32()), pa.array(end, pa.int64())]
            return pa.RecordBatch.from_arrays(arrow, names=schema.names)

        part = map_texts(docs.select("doc_id", "text"), run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def remove(docs: DataFrame, items: DataFrame, rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` in which no item is found; rows are dropped where they lie."""
    for block in item_blocks(items, block_chars):
        find = _search(block, rate)
        docs = keep_texts(docs, lambda texts, find=find: [not (t and find(t)) for t in texts])
    return docs
