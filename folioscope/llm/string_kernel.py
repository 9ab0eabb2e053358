"""Toxicity by a subsequence string-kernel support vector machine with Nystrom landmarks.

The kernel of two strings sums, over all common subsequences of 2 to ``ORDER`` letters, DECAY to the power of the
stretches that they take in both; so letters put in between, left out or changed cost little.  Characters that are not
letters match nothing but count as gap.  Every order's kernel is divided by the root of both self-kernels; orders add
up by ``SHARES``, and a unit with too few letters for the larger orders is compared by those that it has.

A sentence is compared through its units: its words in lower case, and runs of single letters joined to one ("i d i o t").
Scored texts are also read through neighbouring short pieces joined over blanks ("id iot"), and units with digits or
signs for letters as what they look like ("m0r0n").
Units longer than ``WINDOW`` are read through overlapping windows.  The machine is learned from sentences of labelled
documents: units that many toxic documents share and clean ones hardly have, against units of clean documents; then
the clean units that it takes for toxic are added and it is learned again.  Landmarks are the units, most frequent
first, that resemble no landmark before; the Nystrom map sends a unit to K(unit, landmarks) K(landmarks)^-1/2, in which
the machine is linear.  As the kernel is itself linear in the subsequences, weights of landmarks fold into one weight
per subsequence, and scoring a unit costs one lookup per subsequence and one self-kernel.

A sentence has the decision value of its worst unit, a document that of its worst sentence; a logistic curve fitted on
the training documents turns it into the score.  Every sentence of every text is read.

The machine is fitted on a bounded sample of labelled rows: the ``MOST_TOXIC`` and ``MOST_CLEAN`` documents of either
kind whose ids hash smallest, of those that are not held out.

Results for odd input: null and empty texts, and texts without letters, score as having no unit (the curve's value at
the least decision value); null ids are not held out and have no label; an id labelled twice is toxic if one label is;
without labels of both kinds every score is 0; equal texts get equal scores.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import held_out, map_texts
from folioscope.session import materialize

ORDER = 4
SHARES = {2: 0.2, 3: 0.3, 4: 0.5}   # of the orders in the kernel
DECAY = 0.6
LETTERS = 32
WINDOW = 12
STRIDE = 1
PIECE = 5        # characters of the longest piece that is joined with its neighbours
MOST_TOXIC = 4000
MOST_CLEAN = 8000
MOST_UNITS = 4000
LANDMARKS = 240
THRESHOLD = 0.3
LEAST_SHARE = 0.004
TOXIC_LIFT = 5.0
CLEAN_LIFT = 2.0
COST = 100.0
ROUNDS = 2
NOTHING = -3.0


_CODES: dict[str, np.ndarray] = {}   # a plain value travels with the functions, a cached function only by name


def _codes() -> np.ndarray:
    """Letter code per code point: 0 for no letter, 1 to 26 for a to z, else by the code point."""
    if "codes" not in _CODES:
        points = np.arange(0x110000)
        codes = (27 + points % (LETTERS - 27)).astype(np.int64)
        codes[97:123] = np.arange(1, 27)
        letters = np.zeros(len(points), dtype=bool)
        letters[[i for i in range(0x110000) if chr(i).isalpha()]] = True
        codes[~letters] = 0
        _CODES["codes"] = codes.astype(np.uint8)
    return _CODES["codes"]


def encode(units: list[str]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By window length: (unit number, codes), units stripped of other characters at both ends."""
    codes = _codes()
    lengths = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
    flat = codes[np.frombuffer("".join(units).encode("utf-32-le", "replace"), dtype=np.uint32)].astype(np.int64)
    owner = np.repeat(np.arange(len(units)), lengths)
    letters = np.flatnonzero(flat)
    if not len(letters):
        return {}
    own = owner[letters]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    last = np.concatenate([first[1:], [len(letters)]]) - 1
    unit, start, stop = own[first], letters[first], letters[last] + 1
    size = stop - start
    out: dict[int, list] = {}
    for n in np.unique(size[size <= WINDOW]):
        at = np.flatnonzero(size == n)
        out[int(n)] = [(unit[at], flat[start[at][:, None] + np.arange(n)])]
    long = np.flatnonzero(size > WINDOW)
    if len(long):
        # windows at every STRIDE and one that ends with the unit
        count = (size[long] - WINDOW + STRIDE - 1) // STRIDE + 1
        who = np.repeat(long, count)
        step = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
        begin = start[who] + np.minimum(step * STRIDE, size[who] - WINDOW)
        out.setdefault(WINDOW, []).append((unit[who], flat[begin[:, None] + np.arange(WINDOW)]))
    return {n: (np.concatenate([u for u, _ in parts]), np.concatenate([c for _, c in parts]))
            for n, parts in out.items()}


def self_kernels(codes: np.ndarray) -> dict[int, np.ndarray]:
    """The kernel of each row with itself by order, by the recursion over prefixes of both."""
    rows, n = codes.shape
    same = (codes[:, :, None] == codes[:, None, :]) & (codes[:, :, None] > 0)
    match = np.ascontiguousarray(same.transpose(1, 2, 0)).astype(np.float32) * np.float32(DECAY ** 2)
    inner = match.copy()
    out = {1: inner.sum(axis=(0, 1)).astype(np.float64)}
    for order in range(2, ORDER + 1):
        # common subsequences that end at or before two places, less by DECAY for every place since
        for j in range(1, n):
            inner[:, j] += np.float32(DECAY) * inner[:, j - 1]
        for i in range(1, n):
            inner[i] += np.float32(DECAY) * inner[i - 1]
        longer = np.zeros_like(match)
        np.multiply(match[1:, 1:], inner[:-1, :-1], out=longer[1:, 1:])
        inner = longer
        out[order] = inner.sum(axis=(0, 1)).astype(np.float64)
    return out


def self_kernel(codes: np.ndarray) -> np.ndarray:
    """The kernel of the largest order of each row with itself."""
    return self_kernels(codes)[ORDER]


def subsequences(codes: np.ndarray, order: int = ORDER):
    """(number of the subsequence, weight) for every choice of places; 0 where a place holds no letter.

    No letter has code 0, so numbers of different orders differ.
    """
    for places in itertools.combinations(range(codes.shape[1]), order):
        weight = DECAY ** (places[-1] - places[0] + 1)
        number, whole = codes[:, places[0]], codes[:, places[0]] > 0
        for p in places[1:]:
            number = number * LETTERS + codes[:, p]
            whole = whole & (codes[:, p] > 0)
        yield np.where(whole, number, 0), weight


def table_of(unit: str) -> np.ndarray:
    """The unit's weight by subsequence, of length 1; longer units by their first window."""
    out = np.zeros(LETTERS ** ORDER)
    for _, (_, codes) in encode([unit]).items():
        for order, share in SHARES.items():
            own = np.zeros(LETTERS ** order)
            for number, weight in subsequences(codes[:1], order):
                own[number[0]] += weight
            own[0] = 0
            if norm := np.sqrt((own ** 2).sum()):
                out[:len(own)] += np.sqrt(share) * own / norm
    norm = np.sqrt((out ** 2).sum())
    return out / norm if norm else out


def values(units: list[str], tables: np.ndarray, place: np.ndarray | None = None) -> np.ndarray:
    """(unit, column): normalised kernel with each column of ``tables``; a unit has its largest window's.

    ``place`` gives the row of a subsequence where ``tables`` has not all.
    """
    out = np.full((len(units), tables.shape[1]), -np.inf)
    for _, (owner, codes) in encode(units).items():
        step = max(500, 20_000 // max(1, tables.shape[1] // 8))
        for at in range(0, len(owner), step):
            part = codes[at:at + step]
            total, held = np.zeros((len(part), tables.shape[1])), np.zeros((len(part), 1))
            own = self_kernels(part)
            for order, share in SHARES.items():
                sums = np.zeros_like(total)
                for number, weight in subsequences(part, order):
                    sums += weight * tables[number if place is None else place[number]]
                norm = np.sqrt(own[order])[:, None]
                total += np.sqrt(share) * np.divide(sums, norm, out=np.zeros_like(sums), where=norm > 0)
                held += share * (norm > 0)
            total = np.divide(total, np.sqrt(held), out=np.zeros_like(total), where=held > 0)
            np.maximum.at(out, owner[at:at + step], total)
    return np.where(np.isneginf(out), 0.0, out)


def weighed(codes: np.ndarray, table: np.ndarray, order: int) -> np.ndarray:
    """The weighted sum of ``table`` over each row's subsequences, for all last places of a choice at once.

    A number with a place without letter is below 0 and read as 0, which has no weight.
    """
    n, out = codes.shape[1], np.zeros(len(codes))
    letters = np.ascontiguousarray(np.where(codes > 0, codes, -2 * LETTERS ** ORDER).T)
    for places in itertools.combinations(range(n - 1), order - 1):
        number = letters[places[0]]
        for p in places[1:]:
            number = number * LETTERS + letters[p]
        weights = np.array([DECAY ** (last - places[0] + 1) for last in range(places[-1] + 1, n)], dtype=table.dtype)
        found = table.take(number * LETTERS + letters[places[-1] + 1:], mode="clip")
        found *= weights[:, None]
        out += found.sum(axis=0, dtype=np.float64)
    return out


def decisions(units: list[str], table: np.ndarray, step: int = 6000) -> np.ndarray:
    """``values`` with the one column ``table``, which is 0 for no letter."""
    out = np.full(len(units), -np.inf)
    for _, (owner, codes) in encode(units).items():
        for at in range(0, len(owner), step):
            part = codes[at:at + step]
            total, held = np.zeros(len(part)), np.zeros(len(part))
            own = self_kernels(part)
            for order, share in SHARES.items():
                sums, norm = weighed(part, table, order), np.sqrt(own[order])
                total += np.sqrt(share) * np.divide(sums, norm, out=np.zeros_like(sums), where=norm > 0)
                held += share * (norm > 0)
            total = np.divide(total, np.sqrt(held), out=np.zeros_like(total), where=held > 0)
            np.maximum.at(out, owner[at:at + step], total)
    return np.where(np.isneginf(out), 0.0, out)


def joined(words: list[list[str]]) -> tuple[np.ndarray, list[str]]:
    """(text, unit) of two to four neighbouring short pieces of a text's words read as one word, up to WINDOW characters."""
    flat = list(itertools.chain.from_iterable(words))
    text = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
    size = np.fromiter(map(len, flat), dtype=np.int64, count=len(flat))
    rows, out = [np.zeros(0, dtype=np.int64)], []
    run, total = size <= PIECE, size
    for k in range(1, 4):
        # pieces from a place to the k-th after it: all short, of one text
        run = run[:-1] & (size[k:] <= PIECE) & (text[k:] == text[:len(text) - k])
        total = total[:-1] + size[k:]
        at = np.flatnonzero(run & (total <= WINDOW) & (total > 2)).tolist()
        rows.append(text[at])
        out += ["".join(flat[a:a + k + 1]) for a in at]
    return np.concatenate(rows), out


LOOKS_LIKE = str.maketrans("013457@$!|", "oieastasil")
MASKS = re.compile(r"[013457@$!|]")


def unmasked(units: list[str]) -> tuple[np.ndarray, list[str]]:
    """(number, unit) of the units in which signs or digits stand among letters, read as the letters they look like."""
    at, read = [], []
    for i in [i for i, unit in enumerate(units) if MASKS.search(unit)]:
        plain = units[i].rstrip("!|").translate(LOOKS_LIKE)
        if not units[i].startswith(plain) and any(map(str.isalpha, units[i])):
            at.append(i)
            read.append(plain)
    return np.array(at, dtype=np.int64), read


def words_of(texts: list[str | None]) -> list[list[str]]:
    return [t.lower().split() if t else [] for t in texts]


def units_of(texts: list[str | None], words: list[list[str]] | None = None) -> tuple[np.ndarray, list[str]]:
    """(text, unit) of every unit of the texts' sentences."""
    words = words_of(texts) if words is None else words
    flat = list(itertools.chain.from_iterable(words))
    row = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
    single = np.fromiter(map(len, flat), dtype=np.int64, count=len(flat)) == 1
    if single.any():
        # runs of three or more single letters of one text are read as one word
        own = np.concatenate([[0], np.where(single, row + 1, 0), [0]])
        edge = np.flatnonzero(np.diff(own))
        extra = [(row[a], "".join(flat[a:b])) for a, b in itertools.pairwise(edge) if b - a >= ORDER and single[a]]
        if extra:
            row = np.concatenate([row, [r for r, _ in extra]])
            flat += [u for _, u in extra]
    return row, flat


class Machine:
    """Folded weights: the decision value of a unit is its kernel with ``table`` plus ``bias``."""

    def __init__(self, table: np.ndarray, bias: float, slope: float = 1.0, shift: float = 0.0) -> None:
        self.table, self.bias, self.slope, self.shift = table, bias, slope, shift

    def units(self, units: list[str]) -> np.ndarray:
        own = decisions(units, self.table)
        at, read = unmasked(units)
        if len(read):
            own[at] = np.maximum(own[at], decisions(read, self.table))
        return own + self.bias

    def texts(self, texts: list[str | None]) -> np.ndarray:
        """The worst unit's decision value of each text."""
        words = words_of(texts)
        row, flat = units_of(texts, words)
        more, units = joined(words)
        row, flat = np.concatenate([row, more]), flat + units
        out = np.full(len(texts), NOTHING)
        if len(flat):
            column = np.empty(len(flat), dtype=object)
            column[:] = flat
            codes, names = pd.factorize(column)
            np.maximum.at(out, row, self.units(list(names))[codes])
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.texts(texts) + self.shift, -50, 50)))


def choose_landmarks(units: list[str], number: int, alike: float = 0.6) -> list[str]:
    """The first units, in the given order, that resemble none chosen before; the farthest of a stretch at a time."""
    chosen: list[str] = []
    near = np.zeros(len(units))
    at = 0
    while len(chosen) < number:
        left = np.flatnonzero(near[at:] < alike)
        if not len(left):
            break
        at += int(left[0])
        chosen.append(units[at])
        near = np.maximum(near, values(units, table_of(units[at])[:, None])[:, 0])
        near[at] = 1.0
    return chosen


def squared_hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 40) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine with squared hinge loss, by Newton steps over the rows inside the margin."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = np.eye(len(w))
    keep[-1, -1] = 1e-6
    def loss(v):
        return 0.5 * v @ keep @ v + 0.5 * (cost * np.maximum(0.0, 1 - y * (x @ v)) ** 2).sum()

    for _ in range(steps):
        inside = y * (x @ w) < 1
        a, c = x[inside], cost[inside]
        step = np.linalg.solve(keep + (a * c[:, None]).T @ a, (a * c[:, None]).T @ y[inside]) - w
        length, now = 1.0, loss(w)
        while length > 1e-4 and loss(w + length * step) > now:
            length /= 2
        if length <= 1e-4 or np.abs(length * step).max() < 1e-7:
            break
        w = w + length * step
    return w[:-1], float(w[-1])


def learn(toxic: dict[str, int], clean: list[str], landmarks: int = LANDMARKS) -> Machine:
    """A machine from toxic units, with the number of documents that have them, and clean units.

    Toxic units come in the order of their numbers and weigh by them: a word that copies of one document share by
    chance weighs little beside an insult that many documents use.
    """
    names = list(toxic)
    chosen = choose_landmarks(names, landmarks * 3 // 5) + choose_landmarks(clean, landmarks * 2 // 5)
    # rows of subsequences that some landmark has; the first row is empty
    each = []
    for unit in chosen:
        table = table_of(unit)
        own = np.flatnonzero(table)
        each.append((own, table[own].astype(np.float32)))
    seen = np.unique(np.concatenate([np.zeros(1, dtype=np.int64), *[own for own, _ in each]]))
    tables = np.zeros((len(seen), len(each)), dtype=np.float32)
    for i, (own, weights) in enumerate(each):
        tables[np.searchsorted(seen, own), i] = weights
    place = np.zeros(LETTERS ** ORDER, dtype=np.int32)
    place[seen] = np.arange(len(seen))
    gram = (tables.T @ tables).astype(np.float64)
    eigen, vectors = np.linalg.eigh(gram)
    good = eigen > 1e-6 * eigen.max()
    root = vectors[:, good] / np.sqrt(eigen[good])
    x = values(names + clean, tables, place) @ root
    y = np.concatenate([np.ones(len(names)), -np.ones(len(clean))])
    share = np.array(list(toxic.values()), dtype=float)
    cost = np.concatenate([COST * share / share.max(), np.full(len(clean), COST)])
    w, bias = squared_hinge(x, y, cost)
    folded = np.zeros(LETTERS ** ORDER, dtype=np.float32)
    folded[seen] = tables @ (root @ w)
    return Machine(folded, bias)


def calibrate(decisions: np.ndarray, toxic: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of the logistic curve."""
    x = np.stack([decisions, np.ones(len(decisions))], axis=1)
    w = np.array([1.0, 0.0])
    goal = np.where(toxic, (toxic.sum() + 1) / (toxic.sum() + 2), 1 / ((~toxic).sum() + 2))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - goal) + 1e-3 * w)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and toxic of the labelled rows to fit on."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(~held_out(4, 2)).withColumn("turn", F.xxhash64("doc_id"))
    order = ["turn", "doc_id"]
    picked = known.filter("toxic = 1").orderBy(*order).limit(MOST_TOXIC).unionByName(
        known.filter("toxic = 0").orderBy(*order).limit(MOST_CLEAN))
    picked = picked.select(F.col("doc_id").alias("_id"), (F.col("toxic") == 1).alias("toxic"))
    return docs.join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame) -> Machine | None:
    """None without labels of both kinds."""
    rows = materialize(sample(docs, labels), "labelled")
    found = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(found) < 2:
        return None

    def list_units(batch):
        row, flat = units_of(batch.column("text").to_pylist())
        seen = sorted(set(zip(row.tolist(), flat, strict=True)))
        toxic = batch.column("toxic").to_pylist()
        return pa.RecordBatch.from_arrays([pa.array([u for _, u in seen], pa.string()),
                                           pa.array([toxic[r] for r, _ in seen], pa.bool_())], names=["unit", "toxic"])

    units = map_texts(rows, list_units, T.StructType.fromDDL("unit string, toxic boolean")).groupBy("unit").agg(
        F.count_if("toxic").alias("bad"), F.count_if(~F.col("toxic")).alias("good"))
    units = materialize(units, "units")
    least = max(2, int(found[True] * LEAST_SHARE))
    # how many times as often toxic documents have the unit; labels err, so a few clean ones may have an insult
    lift = (F.col("bad") / F.lit(float(found[True]))) / ((F.col("good") + 1) / F.lit(float(found[False])))
    units = units.withColumn("lift", lift)
    bad = {r["unit"]: r["bad"] for r in units.filter((F.col("lift") >= TOXIC_LIFT) & (F.col("bad") >= least)).orderBy(
        F.desc("bad"), "unit").limit(MOST_UNITS).collect()}
    clean = units.filter((F.col("good") > 0) & (F.col("lift") < CLEAN_LIFT))
    good = [r["unit"] for r in clean.orderBy(F.xxhash64("unit"), "unit").limit(MOST_UNITS).collect()]
    if not bad or not good:
        return None
    machine = learn(bad, good)
    for _ in range(ROUNDS):
        def hard(batch, machine=machine):
            names = batch.column("unit").to_pylist()
            return pa.RecordBatch.from_arrays([batch.column("unit"), pa.array(machine.units(names))], names=["unit", "d"])

        worst = map_texts(clean.select("unit"), hard, T.StructType.fromDDL("unit string, d double"), "unit")
        worst = worst.filter("d > -0.5").orderBy(F.desc("d"), "unit").limit(MOST_UNITS // 2)
        more = [r["unit"] for r in worst.collect()]
        good = list(dict.fromkeys(good + more))
        machine = learn(bad, good)

    def decide(batch):
        return pa.RecordBatch.from_arrays([pa.array(machine.texts(batch.column("text").to_pylist())),
                                           batch.column("toxic")], names=["d", "toxic"])

    # at most MOST_TOXIC + MOST_CLEAN numbers
    judged = map_texts(rows, decide, T.StructType.fromDDL("d double, toxic boolean")).collect()
    machine.slope, machine.shift = calibrate(np.array([r["d"] for r in judged]), np.array([r["toxic"] for r in judged]))
    return machine


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    rows = docs.select("doc_id", "text")
    machine = fit(rows, labels)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def run(batch):
        texts = batch.column("text").to_pylist()
        found = np.zeros(len(texts)) if machine is None else machine.score(texts)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], names=schema.names)

    scored = map_texts(rows, run, schema)
    return scored.select("doc_id", held_out(4, 2).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
