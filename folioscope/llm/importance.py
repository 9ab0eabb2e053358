"""Importance resampling of documents towards the word distribution of a target.

Texts are read as UTF-8 bytes.  One 256-byte table lower-cases A-Z and blanks every ASCII byte that is no letter or
digit; ``bytes.split`` gives the words.  A feature is a run of 1 to ``NGRAM`` words joined by one space; its bucket is
the crc32 of its bytes modulo ``BUCKETS``, and the crc32 of a longer run goes on from that of the shorter one.  Counters
over the distinct words of a piece are added up per task; Spark sums the tasks' counts by bucket.  Only one number per
bucket and side comes to the driver, and one gain per bucket goes back to the tasks.

A document's weight is the floored mean of its features' gains.  Scores add noise that depends on seed and id only, so
the draw of the highest scores is a draw without replacement in proportion to exp(weight / 1000), alike in every run.
The places of the drawn come from a prefix sum over ranges of scores; no task sees more than its range.

Results for odd input: null texts have no words, so no features, and weight 0, as have texts without words; benchmark
texts that are null count nothing; a null id draws the noise of an empty id and stands behind all other ids; repeated
rows and ids are documents of their own, ties in score and id go to fewer features, then to the lower weight; an empty
benchmark gives gains against a flat target, an empty table no rows.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import map_texts, ranked, slices
from folioscope.session import materialize

NGRAM = 1
BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
HELD_WORDS = 1 << 18
# A-Z lower-cased; bytes below 0x80 other than letters and digits blanked; all others kept
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_OUT = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "n_words", "n_features", "weight", "score")])


class Crcs(dict):
    """crc32 by (seed, word); forgets all once it holds ``HELD_WORDS``, so that memory has a bound."""

    def __missing__(self, key: tuple[int, bytes]) -> int:
        if len(self) >= HELD_WORDS:
            self.clear()
        seed, word = key
        value = self[key] = zlib.crc32(b" " + word, seed) if seed else zlib.crc32(word)
        return value


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(TABLE).split() if text else []


def feature_crcs(words: list[bytes], ngram: int, known: dict) -> Iterator[Iterable[int]]:
    """The crc32 of every run of 1, 2, ... ``ngram`` words, one group for each length."""
    seeds = [known[0, w] for w in words]
    for n in range(1, ngram + 1):
        yield seeds
        if n < ngram:
            # a run whose crc32 is 0 is hashed whole, as 0 stands for no seed
            seeds = [known[s, w] if s else zlib.crc32(b" ".join(words[i:i + n + 1]))
                     for i, (s, w) in enumerate(zip(seeds, words[n:], strict=False))]


def bucket_counts(texts: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all ``texts`` fall into each bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Crcs(), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for piece in slices(batch, "text"):
                found: Counter = Counter()
                for text in piece.column("text").to_pylist():
                    words = words_of(text)
                    if ngram == 1:
                        found.update(words)
                    else:
                        for group in feature_crcs(words, ngram, known):
                            found.update(group)
                for key, n in found.items():
                    total[(zlib.crc32(key) if ngram == 1 else key) % buckets] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=object)
    parts = texts.select("text").mapInArrow(run, "bucket int, n long")
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> list[int]:
    """floor(1000 * ln) of the smoothed target rate over the smoothed source rate of each bucket."""
    buckets, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return [math.floor(1000 * math.log((float(t + 1) * float(s_all + buckets)) / (float(s + 1) * float(t_all + buckets))))
            for s, t in zip(source.tolist(), target.tolist(), strict=True)]


def noise(doc_id: int | None, seed: int) -> int:
    """floor of 1000 times a standard Gumbel number that seed and id decide."""
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: list[int], ngram: int = NGRAM, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    buckets = len(gain)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known, ids, texts = Crcs(), batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        sizes, features, weights = [], [], []
        for text in texts:
            words = words_of(text)
            n = total = 0
            for group in feature_crcs(words, ngram, known):
                group = list(group)
                n += len(group)
                total += sum([gain[c % buckets] for c in group])
            sizes.append(len(words))
            features.append(n)
            weights.append(total // n if n else 0)
        scores = [w + noise(i, seed) for i, w in zip(ids, weights, strict=True)]
        return pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int64()) for x in (ids, sizes, features, weights, scores)], names=_OUT.names)

    return map_texts(rows, run, _OUT)


def resample(docs: DataFrame, target: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS, seed: int = SEED,
             least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of every document.

    Of the documents with ``least_words`` words or more, ``percent`` of a hundred are drawn, rounded down.
    """
    gain = gains(bucket_counts(docs, ngram, buckets), bucket_counts(target, ngram, buckets))
    # the range sort reads its rows twice, to sample and to sort them
    rows = materialize(weigh(docs, gain, ngram, seed), "weights").select(
        "*", (F.col("n_words") >= least_words).cast("long").alias("able"), F.negative("score").alias("down"),
        F.col("doc_id").isNull().alias("last"))
    placed = ranked(rows, [], ["down", "last", "doc_id", "n_features", "weight"], ["able"], "scores")
    # the rows with enough words are counted from the written table, not from the texts
    able = placed.agg(F.coalesce(F.max(F.col("before_able") + F.col("able")), F.lit(0)).alias("able")).first()["able"]
    rank = F.when((F.col("able") == 1) & (F.col("before_able") < able * percent // 100), F.col("before_able") + 1)
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


def selected(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """doc_id, rank of the drawn documents."""
    return resample(docs, target, **options).filter("rank is not null").select("doc_id", "rank")
