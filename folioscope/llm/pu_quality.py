"""Quality by positive-unlabelled learning.

Trusted positives are documents labelled good.  Every row that is not held out and not a trusted positive is unlabelled web
text, whatever its label: labels of bad documents are not used, neither as negatives nor to leave them out.
With the class prior p, logistic loss and a linear score z of bounded text statistics, the non-negative risk is

    p * E+[log(1 + e^-z)] + max(0, Eu[log(1 + e^z)] - p * E+[log(1 + e^z)]).

Newton steps on the unbiased risk (convex, as the logistic loss is linear-odd) are shortened until the non-negative
risk falls, and end where no step lowers it.  The prior is estimated from a first fit: unlabelled text has at least the
share p of what positives have above any threshold, so p is the least ratio of the two tails.

Statistics are taken from whole texts where they lie.  Every step sums gradients and Hessians over all rows on the
executors; only these sums (a fixed number) reach the driver.

Results for odd input: null and empty texts are scored as texts of no words; null ids are not held out and have no
label; an id labelled twice is positive if one label is; without positives or unlabelled rows the weights stay 0 and
every score is 0.5; equal texts get equal scores.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import held_out, map_texts
from folioscope.session import materialize

THRESHOLD = 0.7
RIDGE = 1e-3
STEPS = 12
FIRST_PRIOR = 0.5
BINS = 200
LEAST_TAIL = 0.3
LENGTHS = (1.0, 0.5, 0.2, 0.05)

_DELETE = {name: str.maketrans("", "", chars) for name, chars in (
    ("symbols", "#$%&*@^|<>{}[]~=+_\\/`"), ("shouts", "!?"), ("stops", ".,;:"), ("digits", "0123456789"))}
FEATURES = ("length", "word_chars", "distinct", "common", "doubled", "upper", "symbols", "shouts", "stops", "digits",
            "wordless", "lines", "repeated_lines", "long_words", "upper_words", "marked_words")
_LETTER = re.compile(r"[^\W\d_]")


def cap(value: float, top: float) -> float:
    return min(1.0, value / top)


def statistics(text: str | None) -> list[float]:
    """FEATURES of one text, each between 0 and 1."""
    text = text or ""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    seen = Counter(words)
    lost = {name: len(text) - len(text.translate(t)) for name, t in _DELETE.items()}
    lines = [x for x in text.split("\n") if x.strip()]
    joined = sum(map(len, words))
    upper = sum(map(str.isupper, words))
    doubled = sum(map(str.__eq__, words, words[1:]))
    changed = _uppercase(text)
    marked = sum(not w[-1].isalnum() and w[-1] not in ".,;:" for w in seen) / max(1, len(seen))
    wordless = sum(c for w, c in seen.items() if not _LETTER.search(w))
    return [
        cap(np.log1p(len(words)), 10.0), cap(joined / n, 16.0), len(seen) / n if len(words) > 20 else 0.75,
        cap(max(seen.values(), default=0) / n, 0.5) if len(words) > 20 else 0.2, cap(doubled / n, 0.1),
        cap(changed / chars, 0.2), cap(lost["symbols"] / chars, 0.05), cap(lost["shouts"] / chars, 0.05),
        cap(lost["stops"] / chars, 0.1), cap(lost["digits"] / chars, 0.1), cap(wordless / n, 0.2),
        cap(len(lines) / n, 0.2), 1 - len(set(lines)) / max(1, len(lines)),
        cap(sum(c for w, c in seen.items() if len(w) > 24) / n, 0.1), cap(upper / n, 0.3), cap(marked, 0.3)]


def _uppercase(text: str) -> int:
    points = np.frombuffer(text.encode("utf-16-le", "replace"), dtype=np.uint16)
    return int(np.count_nonzero((points >= 65) & (points <= 90)))


def features(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` but the text, with ``x``: a constant and the statistics."""
    kept = [f for f in docs.schema.fields if f.name != "text"]
    schema = T.StructType([*kept, T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batch):
        x = [[1.0, *map(float, statistics(t))] for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(x, pa.list_(pa.float64()))],
                                          names=schema.names)

    return map_texts(docs, run, schema)


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def total(rows: DataFrame, fn) -> np.ndarray:
    """Sum over all rows of ``fn(x, positive)``, an array of fixed length; x has one row per document."""
    def run(batches):
        part = None
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column("x").to_pylist())
                value = fn(x, batch.column("positive").to_numpy(zero_copy_only=False).astype(bool))
                part = value if part is None else part + value
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(part), dtype=np.int32)), pa.array(part)],
                                             names=["place", "value"])

    sums = rows.mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value"))
    found = {r["place"]: r["value"] for r in sums.collect()}
    return np.array([found[i] for i in range(len(found))])


class Fit:
    """Weights of the score and the class prior."""

    def __init__(self, weights: np.ndarray, prior: float) -> None:
        self.weights, self.prior = weights, prior


def minimise(rows: DataFrame, prior: float, width: int, n: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Weights of least non-negative risk; ``n`` has the numbers of unlabelled and positive rows."""
    w = np.zeros(width) if start is None else start

    def slopes(x, positive, w):
        p, u = x[positive], x[~positive]
        s = sigmoid(u @ w)
        return np.concatenate([p.sum(axis=0), (s[:, None] * u).sum(axis=0), ((s * (1 - s))[:, None] * u).T.dot(u).ravel()])

    def risks(x, positive, many):
        z = x @ many.T
        return np.concatenate([softplus(-z[positive]).sum(axis=0), softplus(z[positive]).sum(axis=0),
                               softplus(z[~positive]).sum(axis=0)])

    def value(many):
        parts = total(rows, lambda x, positive, many=many: risks(x, positive, many)).reshape(3, len(many))
        good, wrong, other = parts[0] / n[1], parts[1] / n[1], parts[2] / n[0]
        return prior * good + np.maximum(0.0, other - prior * wrong) + RIDGE / 2 * (many[:, 1:] ** 2).sum(axis=1)

    ridge = np.full(width, RIDGE)
    ridge[0] = 1e-9
    risk = None
    for _ in range(STEPS):
        sums = total(rows, lambda x, positive, w=w: slopes(x, positive, w))
        slope = -prior * sums[:width] / n[1] + sums[width:2 * width] / n[0] + ridge * w
        bend = sums[2 * width:].reshape(width, width) / n[0] + np.diag(ridge + 1e-9)
        step = np.linalg.solve(bend, slope)
        many = np.array([w, *[w - length * step for length in LENGTHS]])
        values = value(many)
        best = int(values.argmin())
        risk = values[0] if risk is None else risk
        if best == 0 or values[0] - values[best] < 1e-6:
            return many[best]
        w, risk = many[best], values[best]
    return w


def estimate_prior(rows: DataFrame, w: np.ndarray, n: np.ndarray) -> float:
    """The least ratio of the unlabelled to the positive tail of the score."""
    def tails(x, positive):
        place = np.clip((sigmoid(x @ w) * BINS).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(place[~positive], minlength=BINS),
                               np.bincount(place[positive], minlength=BINS)]).astype(float)

    counts = total(rows, tails).reshape(2, BINS)
    unlabelled, positive = np.cumsum(counts[:, ::-1], axis=1) / n[:, None]
    ratios = unlabelled[positive >= LEAST_TAIL] / positive[positive >= LEAST_TAIL]
    return float(np.clip(ratios.min(), 0.02, 0.98))


def fit(rows: DataFrame) -> Fit:
    """``rows`` has x and positive: trusted positives and unlabelled rows."""
    width = len(FEATURES) + 1
    n = np.array([r for r in rows.agg(F.count_if(~F.col("positive")), F.count_if("positive")).first()], dtype=float)
    if not n.all():
        return Fit(np.zeros(width), FIRST_PRIOR)
    first = minimise(rows, FIRST_PRIOR, width, n)
    prior = estimate_prior(rows, first, n)
    return Fit(minimise(rows, prior, width, n, first), prior)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    rows = docs.select("doc_id", "text", held_out(4, 2).alias("held_out"))
    found = materialize(features(rows), "statistics")
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("_id")).agg(
        F.max("quality").alias("quality"))
    training = found.filter("not held_out").join(known, F.col("doc_id") == F.col("_id"), "left")
    training = materialize(training.select("x", F.coalesce(F.col("quality") == 1, F.lit(False)).alias("positive")), "training")
    w = fit(training).weights

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                s = sigmoid(np.array(batch.column("x").to_pylist()) @ w)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s)],
                                                 names=["doc_id", "held_out", "score"])

    scored = found.mapInArrow(run, T.StructType([found.schema["doc_id"], found.schema["held_out"],
                                                 T.StructField("score", T.DoubleType())]))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
