"""Language identification with hyperdimensional profiles.

Every letter has a random +1/-1 vector.  A trigram is bound from its letters' vectors, each rotated by its place, and
multiplied; a text is the bundle (sum) of its trigrams; a language is the bundle of its training texts.  A text gets
the language whose prototype has the largest cosine with it.

A bundle is linear in trigram counts, so training counts trigrams per language where the texts lie, adds the counts by
key and binds once per language and trigram.  Only prototypes (DIMENSION numbers per language) reach the driver.

Results for odd input: null text, or text without letters: ``und``, score 0.  Null ids are never held out and are
learned from.  No learned language at all: ``und``.  Ties between languages: the smaller name.  Repeated rows count and
are predicted each.  Texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import held_out, keep_texts, map_texts

DIMENSION = 1024
SEED = 20_240_117
ALPHABET = 64
CODES = ALPHABET ** 3
UNDETERMINED = "und"
LOW_SHARE = 0.001   # of the training texts of a length band
MARGIN = 0.9
LEAST_ROWS = 50     # training texts that a band's quantile takes
CHANCE = 0.1        # cosine that a text of no learned language reaches easily
STEPS = 1000        # of the histogram of cosines
_CACHE: dict[str, np.ndarray] = {}


def letter_codes() -> np.ndarray:
    """Code per code point: 0 for anything but letters, 1 to 26 for a to z, 27 to 63 by the code point for others."""
    if "codes" not in _CACHE:
        points = np.arange(0x110000, dtype=np.uint32)
        codes = (27 + points % 37).astype(np.uint8)
        codes[97:123] = np.arange(1, 27)
        letters = np.zeros(len(points), dtype=bool)
        letters[[i for i in range(0x110000) if chr(i).isalpha()]] = True
        codes[~letters] = 0
        _CACHE["codes"] = codes
    return _CACHE["codes"]


def letter_vectors() -> np.ndarray:
    if "letters" not in _CACHE:
        rng = np.random.default_rng(SEED)
        _CACHE["letters"] = rng.choice(np.array([-1, 1], dtype=np.int8), size=(ALPHABET, DIMENSION))
    return _CACHE["letters"]


def bind(codes: np.ndarray) -> np.ndarray:
    """Vectors of trigram codes, one row each."""
    base = letter_vectors()
    first, second, third = codes // ALPHABET ** 2, codes // ALPHABET % ALPHABET, codes % ALPHABET
    return np.roll(base, 2, axis=1)[first] * np.roll(base, 1, axis=1)[second] * base[third]


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of every trigram with a letter in its middle; texts are padded by a boundary on both sides."""
    lowered = [(t or "").lower() for t in texts]
    joined = "\n" + "\n".join(lowered) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
    codes = letter_codes()[points].astype(np.int32)
    lengths = np.array([len(t) + 1 for t in lowered], dtype=np.int64)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    middle = codes[1:-1]
    keep = np.flatnonzero(middle)
    code = codes[keep] * ALPHABET ** 2 + codes[keep + 1] * ALPHABET + codes[keep + 2]
    return row[keep], code


def _count(batch: pa.RecordBatch) -> pa.RecordBatch:
    langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
    names = sorted(set(langs))
    place = {x: i for i, x in enumerate(names)}
    row, code = trigrams(texts)
    group = np.array([place[x] for x in langs], dtype=np.int64)[row]
    out = []
    for i, name in enumerate(names):
        counts = np.bincount(code[group == i], minlength=CODES)
        seen = np.flatnonzero(counts)
        out.append(pa.RecordBatch.from_arrays(
            [pa.array([name] * len(seen), pa.string()), pa.array(seen.astype(np.int32)),
             pa.array(counts[seen].astype(np.int64))], names=["lang", "code", "n"]))
    return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if any(b.num_rows for b in out) else None


def learn(training: DataFrame) -> dict[str, np.ndarray]:
    """Unit prototypes by language from rows (text, lang); null languages are skipped."""
    rows = training.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    counts = map_texts(rows, _count, T.StructType.fromDDL("lang string, code int, n long"))
    counts = counts.groupBy("lang", "code").agg(F.sum("n").alias("n"))

    def bundle(frame):
        import pandas as pd
        vector = np.zeros(DIMENSION)
        codes, n = frame["code"].to_numpy(), frame["n"].to_numpy(dtype=np.float64)
        for at in range(0, len(codes), 4096):
            vector += n[at:at + 4096] @ bind(codes[at:at + 4096]).astype(np.float64)
        return pd.DataFrame({"lang": [frame["lang"].iloc[0]], "vector": [vector]})

    found = counts.groupBy("lang").applyInPandas(bundle, "lang string, vector array<double>").collect()
    out = {}
    for r in sorted(found, key=lambda r: r["lang"]):
        vector = np.array(r["vector"])
        if norm := np.linalg.norm(vector):
            out[r["lang"]] = vector / norm
    return out


def cosines(texts: list[str | None], prototypes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cosine of every text with every prototype, and the text's number of letters."""
    out, letters = np.zeros((len(texts), len(prototypes))), np.zeros(len(texts), dtype=np.int64)
    for at in range(0, len(texts), 256):
        part = texts[at:at + 256]
        row, code = trigrams(part)
        if not len(code):
            continue
        seen = np.flatnonzero(np.bincount(code, minlength=CODES))
        place = np.zeros(CODES, dtype=np.int32)
        place[seen] = np.arange(len(seen))
        bundles = np.zeros((len(part), DIMENSION), dtype=np.float32)
        width = 8192
        column = place[code]
        counts = np.bincount(row.astype(np.int64) * len(seen) + column, minlength=len(part) * len(seen))
        counts = counts.reshape(len(part), len(seen)).astype(np.float32)
        for a in range(0, len(seen), width):
            bundles += counts[:, a:a + width] @ bind(seen[a:a + width]).astype(np.float32)
        letters[at:at + 256] = np.bincount(row, minlength=len(part))
        norms = np.maximum(np.linalg.norm(bundles, axis=1), 1e-9)
        out[at:at + 256] = (bundles @ prototypes.T.astype(np.float32)) / norms[:, None]
    return out, letters


def judge(texts: list[str | None], names: list[str], matrix: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score (the best cosine, cut to 0..1) of each text."""
    if not names:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    found, letters = cosines(texts, matrix)
    some = letters > 0
    labels = [names[b] if s else UNDETERMINED for b, s in zip(found.argmax(axis=1), some, strict=True)]
    return labels, np.where(some, np.clip(found.max(axis=1), 0.0, 1.0), 0.0)


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """The columns of ``docs`` but the text, with lang_pred and score."""
    names, matrix = list(prototypes), np.array(list(prototypes.values())).reshape(-1, DIMENSION)
    kept = [f for f in docs.schema.fields if f.name != "text"]
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batch):
        labels, scores = judge(batch.column("text").to_pylist(), names, matrix)
        return pa.RecordBatch.from_arrays(
            [*[batch.column(f.name) for f in kept], pa.array(labels, pa.string()), pa.array(scores, pa.float64())],
            names=schema.names)

    return map_texts(docs, run, schema)


def bands(letters: np.ndarray) -> np.ndarray:
    """Length band of each number of letters: the power of two below it."""
    return np.frexp(np.maximum(letters, 1).astype(np.float64))[1] - 1


def learn_limits(training: DataFrame, prototypes: dict[str, np.ndarray]) -> np.ndarray:
    """The least cosine of a text in a learned language by length band; -1 for texts too short to judge.

    A band's limit is MARGIN of the LOW_SHARE quantile of its training texts' own best cosines, together with those of
    the next shorter bands while there are fewer than LEAST_ROWS.  Where shorter ones do not suffice, or the limit is
    not above CHANCE, the length does not allow a judgement.
    """
    limits = np.full(64, -1.0)
    if not prototypes:
        return limits
    matrix = np.array(list(prototypes.values()))
    rows = training.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text")

    def run(batch):
        found, letters = cosines(batch.column("text").to_pylist(), matrix)
        some = letters > 0
        step = np.clip(np.floor(found.max(axis=1)[some] * STEPS), 0, STEPS - 1).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(bands(letters[some]).astype(np.int32)), pa.array(step)],
                                          names=["band", "step"])

    own = map_texts(rows, run, T.StructType.fromDDL("band int, step int")).groupBy("band", "step").count()
    counts = np.zeros((len(limits), STEPS), dtype=np.int64)
    for r in own.collect():  # at most bands times STEPS rows
        counts[r["band"], r["step"]] = r["count"]
    for band in range(len(limits)):
        first = band
        while first and counts[first:band + 1].sum() < LEAST_ROWS:
            first -= 1
        below = counts[first:band + 1].sum(axis=0).cumsum()
        if below[-1] >= LEAST_ROWS:
            limit = MARGIN * np.searchsorted(below, max(1.0, LOW_SHARE * below[-1])) / STEPS
            limits[band] = limit if limit > CHANCE else -1.0
    return limits


def recognised(docs: DataFrame, prototypes: dict[str, np.ndarray], least: float | np.ndarray) -> DataFrame:
    """The rows of ``docs`` with letters whose best cosine is at least ``least``, one limit or one per length band."""
    matrix, limits = np.array(list(prototypes.values())).reshape(-1, DIMENSION), np.broadcast_to(least, 64)

    def keep(texts):
        if not len(matrix):
            return [False] * len(texts)
        found, letters = cosines(texts, matrix)
        return ((letters > 0) & (found.max(axis=1) >= limits[bands(letters)])).tolist()

    return keep_texts(docs, keep)


def identify(docs: DataFrame, modulus: int = 3, remainder: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; learns from rows that are not held out."""
    prototypes = learn(docs.filter(~held_out(modulus, remainder)))
    rows = docs.select("doc_id", "text", held_out(modulus, remainder).alias("held_out"))
    return predict(rows, prototypes)
