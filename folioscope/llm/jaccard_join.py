"""Jaccard join of n-gram sets by a size-aware heavy-light join.

A text's set holds its distinct shingles of ``WORDS`` words as 64-bit hashes (two different shingles of the whole
corpus collide with a chance of about pairs / 2**64).  Texts with equal sets form one class; the join runs over classes.

Small sets.  Two sets that link have an overlap of at least t * |set| with either of them, so for a set of size s every
subset of a size from ceil(t * s) to s is enumerated, and two small sets link only if they enumerate one subset alike.
A set is small while its subsets cost no more than the list entries it would have as a large one (``enumerated``).

Large sets.  Inverted lists are scanned.  A list of a single shingle would hold everyone who quotes a shared passage,
so a list is kept for a part of a set: sets of one range of sizes differ by at most D shingles if they link, shingles
are dealt into more than D parts by their hash, and so two sets that link have a part alike.  Ranges grow by a fixed
factor; a set that can link with sets of the next range enters its lists as well.

Blocks of entries.  Most list entries are alone in their list.  So an entry moves as 32 bits of its key and 32 bits of
its class, many to a row, by the group that 10 more bits of its key name; where a group's rows meet, entries of one class
only are dropped.  Lists whose keys agree in these 42 bits become one, which adds candidates and loses none; classes that
agree in their 32 bits could hide from each other, so they form a list of their own.

Lists.  Classes that share a key (subset or part) are candidates.  A light list gives all its pairs; in a heavy list
(more than ``LIGHT`` classes) every set is first paired with one pivot only, the class that shares most lists with others.

Sketches.  A set's sketch has the parity of its shingles per bucket, between 2 and 4 buckets a shingle.  A bucket of
different parity holds a shingle that one of two sets has alone, so sketches that differ in more places than linked
sets of these sizes can prove that there is no link.  Shingles themselves are moved only for pairs that sketches pass.

Components, not links, are asked for, so a pair is compared only while its classes are in different components.  Of a
class's pairs the one with the nearest sketch is verified first, then the others, if still apart.  Heavy lists whose
classes are not in one component by then owe the pairs across components: sketches meet in blocks of bounded size, the
classes of the list's largest component only with those of others.  Blocks give all pairs that sketches pass; where these
are many, first a spanning forest of them and, after that is verified, all that are still apart, so no link is lost.

Sets are only built for classes of pairs that sketches pass, before each verification; they are recomputed from their
texts.  Everything that several branches read is written to the shared folder once.  Components grow by large-star and small-star steps.

Results for odd input: null or empty texts, or texts without words, have an empty set and link with nothing; a text
with fewer than WORDS words has its whole word sequence as one shingle; repeated rows and equal ids are rows of their
own, linked if their sets are equal; a component of null ids only has a null component_id; an empty table gives none.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import distinct_rows, map_texts, row_keys
from folioscope.session import materialize

WORDS = 4
PERCENT = 85
LIGHT = 4
BLOCK = 2048
SPARE = 8
CROWD = 64
GROWTH = 1.4
FILTER_BITS = 25
GROUP_BITS = 10
_MIX = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(0x5851F42D4C957F2D)
_SMALL: dict[int, int] = {}
_RANGES: dict[tuple[int, int], tuple[int, int, int]] = {}


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    Splitting and lowering bytes knows only ASCII white space and A to Z, as the contract does.
    """
    tokens = [t.encode("utf-8", "replace").lower().split() if t else [] for t in texts]
    lengths = np.array([len(t) for t in tokens], dtype=np.int64)
    flat = np.empty(int(lengths.sum()), dtype=object)
    flat[:] = list(itertools.chain.from_iterable(tokens))
    if not len(flat):
        return [np.zeros(0, dtype=np.uint64)] * len(texts)
    codes, names = pd.factorize(flat)
    hashed = pd.util.hash_array(np.asarray(names, dtype=object), categorize=False)[codes]
    with np.errstate(over="ignore"):
        value = np.zeros(len(hashed), dtype=np.uint64)
        padded = np.concatenate([hashed, np.zeros(words, dtype=np.uint64)])
        for k in range(words):
            value = scramble(value * _MIX + padded[k:k + len(hashed)] + np.uint64(k))
        out, start = [], 0
        for n in lengths.tolist():
            if n >= words:
                out.append(np.unique(value[start:start + n - words + 1]))
            elif n:
                short = np.full(1, np.uint64(n))
                for k in range(n):
                    short = scramble(short * _MIX + hashed[start + k:start + k + 1])
                out.append(short)
            else:
                out.append(np.zeros(0, dtype=np.uint64))
            start += n
    return out


def class_key(values: np.ndarray) -> int:
    """A 64-bit key of a sorted set."""
    with np.errstate(over="ignore"):
        place = np.arange(1, len(values) + 1, dtype=np.uint64)
        return int(scramble(np.bitwise_xor.reduce(scramble(values + place * _MIX)) + np.uint64(len(values))).view(np.int64))


def least_overlap(size: int, percent: int = PERCENT) -> int:
    """The least overlap of a set of this size with any set that it links to."""
    return -(-percent * size // 100)


def most_apart(size: int, percent: int = PERCENT) -> int:
    """The most shingles that are in one of two linked sets only, if neither is larger than ``size``."""
    return 2 * size - 2 * -(-percent * 2 * size // (100 + percent))


def enumerated(size: int, percent: int = PERCENT) -> bool:
    """Whether a set is small: it has at most ``size`` subsets to enumerate."""
    missing = size - least_overlap(size, percent)
    return sum(math.comb(size, m) for m in range(missing + 1)) <= max(1, size + 1)


def largest_small(percent: int = PERCENT) -> int:
    if percent not in _SMALL:
        size = 1
        while enumerated(size + 1, percent):
            size += 1
        _SMALL[percent] = size
    return _SMALL[percent]


def size_range(c: int, percent: int = PERCENT) -> tuple[int, int, int]:
    """(largest size, most apart, parts) of the c-th range of large sizes.

    A few parts more than needed make up for parts that are empty by chance.
    """
    if (c, percent) not in _RANGES:
        top = int((largest_small(percent) + 1) * GROWTH ** c)
        apart = max(most_apart(top, percent), most_apart(top - 1, percent) + 1)
        _RANGES[c, percent] = top, apart, apart + 3 + apart // 16
    return _RANGES[c, percent]


def ranges_of(size: int, percent: int = PERCENT) -> list[int]:
    """The ranges whose lists a set of this size enters."""
    c, partner = 0, 100 * size // percent
    while size_range(c, percent)[0] < size:
        c += 1
    out = [c] if partner > largest_small(percent) else []
    return [*out, c + 1] if partner > size_range(c, percent)[0] else out


def entry_keys(values: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Keys of the lists that a set enters."""
    size, out = len(values), []
    with np.errstate(over="ignore"):
        marks = scramble(values + _MIX)
        if size <= largest_small(percent):
            total = np.bitwise_xor.reduce(marks)
            for m in range(size - least_overlap(size, percent) + 1):
                for gone in itertools.combinations(range(size), m):
                    out.append([total ^ np.bitwise_xor.reduce(marks[list(gone)]) if gone else total])
        for c in ranges_of(size, percent):
            _, apart, parts = size_range(c, percent)
            part = (scramble(marks + np.uint64(c)) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
            order = np.argsort(part, kind="stable")
            part = part[order]
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            place = part[first] + (np.uint64(c + 1) << np.uint64(32))
            out.append(scramble(np.bitwise_xor.reduceat(marks[order], first) + place * _MIX))
            if len(first) <= apart:  # the part alike could be an empty one
                empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), part[first])
                out.append(scramble(_NONE + (empty + (np.uint64(c + 1) << np.uint64(32))) * _MIX))
    return np.concatenate([np.asarray(x, dtype=np.uint64) for x in out])


def sketch(values: np.ndarray) -> bytes:
    """The parities of a set's shingles over a power of two of buckets, 64 at least."""
    buckets = 64 << max(0, len(values) - 1 >> 5).bit_length()
    with np.errstate(over="ignore"):
        place = scramble(values + _NONE) & np.uint64(buckets - 1)
    counts = np.bincount(place.astype(np.int64), minlength=buckets)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def fold(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) as they were with fewer buckets."""
    while sketches.shape[-1] > words:
        half = sketches.shape[-1] // 2
        sketches = sketches[..., :half] ^ sketches[..., half:]
    return sketches


def may_link(a: list[bytes], an: np.ndarray, b: list[bytes], bn: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
    """(i, j) of the pairs of a[i] and b[j] that sizes and sketches do not rule out."""
    found = []
    widths = [np.array([len(x) for x in side]) // 8 for side in (a, b)]
    for wa in np.unique(widths[0]):
        i = np.flatnonzero(widths[0] == wa)
        one = np.frombuffer(b"".join(a[k] for k in i), dtype=np.uint64).reshape(len(i), wa)
        for wb in np.unique(widths[1]):
            if max(wa, wb) > 4 * min(wa, wb) and percent >= 50:
                continue  # sizes are more than twice apart
            j = np.flatnonzero(widths[1] == wb)
            two = np.frombuffer(b"".join(b[k] for k in j), dtype=np.uint64).reshape(len(j), wb)
            words = int(min(wa, wb))
            left, right = fold(one, words), fold(two, words)
            step = max(1, (1 << 21) // max(1, len(j) * words))
            for start in range(0, len(i), step):
                here = i[start:start + step]
                differ = np.bitwise_count(left[start:start + step, None] ^ right[None]).sum(axis=2, dtype=np.int64)
                total = an[here][:, None] + bn[j][None]
                rows, columns = np.nonzero(differ <= total - 2 * -(-percent * total // (100 + percent)))
                found.append((here[rows], j[columns]))
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate(side) for side in zip(*found, strict=True))


def linked(overlap: Column, a: Column, b: Column, percent: int = PERCENT) -> Column:
    return 100 * overlap >= percent * (a + b - overlap)


def group_entries(entries: list[np.ndarray], keys: list[int]) -> tuple[list[int], list[bytes]]:
    """(group, packed entries) of classes' entries: 32 bits of every entry's key, then 32 bits of every entry's class."""
    if not entries:
        return [], []
    place = np.concatenate(entries) >> np.uint64(32 - GROUP_BITS)
    owner = np.repeat(np.array(keys, dtype=np.int64).view(np.uint64).astype(np.uint32), [len(e) for e in entries])
    group = (place >> np.uint64(32)).astype(np.uint16)
    order = np.argsort(group, kind="stable")
    group, mark, owner = group[order], place[order].astype(np.uint32), owner[order]
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
    return [int(group[a]) for a in cuts[:-1]], [mark[a:b].tobytes() + owner[a:b].tobytes() for a, b in itertools.pairwise(cuts)]


def shared_entries(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(mark, owner) of a group's distinct entries whose mark has two owners or more."""
    both = np.concatenate([np.frombuffer(p, dtype=np.uint32).reshape(2, -1) for p in packed], axis=1)
    joint = both[0].astype(np.uint64)
    joint <<= np.uint64(32)
    joint |= both[1]
    joint.sort()
    joint = joint[np.concatenate([[True], joint[1:] != joint[:-1]])]
    mark = joint >> np.uint64(32)
    same = mark[1:] == mark[:-1]
    keep = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    return mark[keep].astype(np.int64), (joint[keep] & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _features(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The columns of ``docs`` but the text, with n, key and sketch of every row's set; and the packed list entries by group.

    Both are written by one pass over the texts.  Of copies within a piece of a partition, one has sketch and entries.
    """
    kept = [T.StructField(f.name, f.dataType) for f in docs.schema.fields if f.name != "text"]
    schema = T.StructType([*kept, T.StructField("n", T.LongType()), T.StructField("key", T.LongType()),
                           T.StructField("sketch", T.BinaryType()), T.StructField("group", T.IntegerType()),
                           T.StructField("packed", T.BinaryType())])

    def run(batch):
        keys, sketches, entries, seen, sizes = [], [], [], {}, []
        for values in shingle_sets(batch.column("text").to_pylist(), words):
            key = class_key(values) if len(values) else None
            new = key is not None and key not in seen
            sketches.append(sketch(values) if new else None)
            if new:
                seen[key] = None
                entries.append(entry_keys(values, percent))
            keys.append(key)
            sizes.append(len(values))
        groups, packed = group_entries(entries, list(seen))
        def beside(column):
            return pa.concat_arrays([column, pa.nulls(len(groups), column.type)])

        none = len(keys)
        return pa.RecordBatch.from_arrays(
            [*[beside(batch.column(f.name)) for f in kept], beside(pa.array(sizes, pa.int64())),
             beside(pa.array(keys, pa.int64())), beside(pa.array(sketches, pa.binary())),
             pa.concat_arrays([pa.nulls(none, pa.int32()), pa.array(groups, pa.int32())]),
             pa.concat_arrays([pa.nulls(none, pa.binary()), pa.array(packed, pa.binary())])], names=schema.names)

    made = materialize(map_texts(docs, run, schema), "features")
    return (made.filter("group is null").drop("group", "packed"),
            made.filter("group is not null").select("group", "packed"))


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """key, n, tokens of the classes in ``wanted`` (key, rid), from one text of each."""
    some, _ = _split(docs, "rid", _bits(wanted.select(F.col("rid").alias("token"))))
    some = some.join(wanted.select("rid").distinct(), "rid", "left_semi")

    def run(batch):
        full = [v for v in shingle_sets(batch.column("text").to_pylist(), words) if len(v)]
        return pa.RecordBatch.from_arrays(
            [pa.array([class_key(v) for v in full], pa.int64()), pa.array([len(v) for v in full], pa.int64()),
             pa.array([v.view(np.int64) for v in full], pa.list_(pa.int64()))], names=["key", "n", "tokens"])

    made = map_texts(some.select("rid", "text"), run, T.StructType.fromDDL("key long, n long, tokens array<long>"))
    return made.join(wanted.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])


def _bits(tokens: DataFrame) -> np.ndarray:
    """A bitmap of fixed size, as bytes, of the tokens' low bits, to drop most other rows before they are shuffled."""
    place = F.col("token").bitwiseAND((1 << FILTER_BITS) - 1) + 1
    made = tokens.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros((1 << FILTER_BITS) // 32768, dtype="V4096")
    for r in made.collect():  # of fixed size, whatever the tokens
        out[r["bucket"] - 1] = np.frombuffer(r["bits"], dtype="V4096")[0]
    return out.view(np.uint8)


def _split(df: DataFrame, column: str, bits: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``column`` may be one of those in ``bits``, rows that cannot be), told apart where they lie."""
    sent = df.sparkSession.sparkContext.broadcast(bits)

    def may(values: pd.Series) -> pd.Series:
        at = values.to_numpy() & (1 << FILTER_BITS) - 1
        return pd.Series((sent.value[at >> 3] >> (at & 7) & 1).astype(bool))

    marked = F.pandas_udf(may, "boolean")(F.col(column))
    return df.filter(marked), df.filter(~marked)


def _shared_entries(features: DataFrame, blocks: DataFrame) -> DataFrame:
    """Distinct (token, key, n) of the lists that hold two classes or more."""
    def run(batches):
        held, name = [], None  # the entries of one group, 8 bytes each

        def done():
            mark, owner = shared_entries(held)
            return pa.RecordBatch.from_arrays([pa.array(mark + (name << 32)), pa.array(owner)], names=["token", "owner"])

        for batch in batches:
            groups = batch.column("group").to_numpy()
            for group, packed in zip(groups.tolist(), batch.column("packed").to_pylist(), strict=True):
                if held and group != name:
                    yield done()
                    held = []
                name = group
                held.append(packed)
        if held:
            yield done()

    met = blocks.repartition("group").sortWithinPartitions("group").mapInArrow(run, "token long, owner long")
    classes = features.filter("key is not null").select(
        F.col("key").bitwiseAND(0xFFFFFFFF).alias("owner"), "key", "n").distinct()
    # classes that look alike; tokens of the others are not negative
    twins = classes.groupBy("owner").agg(F.count("*").alias("count")).filter("count > 1").select("owner")
    alike = classes.join(twins, "owner").select((-1 - F.col("owner")).alias("token"), "key", "n")
    return materialize(met.join(classes, "owner").select("token", "key", "n").unionByName(alike), "entries")


def _lists(entries: DataFrame) -> DataFrame:
    """Entries (token, key, n) with their list's size and pivot."""
    degrees = entries.groupBy("key").agg(F.count("*").alias("degree"))
    ranked = entries.join(degrees, "key")
    totals = ranked.groupBy("token").agg(
        F.count("*").alias("size"), F.max(F.struct("degree", F.negative("n").alias("less"), "key")).alias("pivot"))
    return entries.join(totals.select("token", "size", F.col("pivot.key").alias("pivot"),
                                      F.negative("pivot.less").alias("pn")), "token")


def _close(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _first_pairs(lists: DataFrame, percent: int, light: int) -> DataFrame:
    """Distinct (a, b) with ``crowd``, the size of the largest list that gave them: light lists whole, heavy ones by pivot."""
    few = lists.filter(F.col("size") <= light)
    left = few.select("token", F.col("key").alias("a"), F.col("n").alias("an"), "size")
    right = few.select("token", F.col("key").alias("b"), F.col("n").alias("bn"))
    pairs = left.join(right, "token").filter((F.col("a") < F.col("b")) & _close(F.col("an"), F.col("bn"), percent))
    many = lists.filter((F.col("size") > light) & (F.col("key") != F.col("pivot")) & _close(F.col("n"), F.col("pn"), percent))
    both = pairs.select("a", "b", "size").unionByName(
        many.select(F.col("key").alias("a"), F.col("pivot").alias("b"), "size"))
    return both.groupBy("a", "b").agg(F.max("size").alias("crowd"))


def _meet(pairs: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """``pairs`` (a, b, crowd, ...) with an, bn and ``column`` of both sides as a_ and b_ columns.

    A class can be the second of many pairs; its value is copied for every ``CROWD`` or so of them.
    """
    parts = F.pow(F.lit(4), F.ceil(F.log(4.0, F.greatest(F.lit(1.0), F.col("crowd") / CROWD)))).cast("long")
    salted = pairs.withColumn("salt", parts + F.pmod(F.xxhash64("a"), parts))
    second = salted.select("b", "salt").distinct().join(
        values.select(F.col("key").alias("b"), F.col("n").alias("bn"), F.col(column).alias(f"b_{column}")), "b")
    first = values.select(F.col("key").alias("a"), F.col("n").alias("an"), F.col(column).alias(f"a_{column}"))
    return salted.join(first, "a").join(second, ["b", "salt"]).drop("salt")


def _passed(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(a, b, crowd, far) of the pairs that sketches do not rule out; ``far`` counts differing buckets."""
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.zeros(len(a), dtype=np.int64)
        for k, (x, y) in enumerate(zip(a, b, strict=True)):
            one, two = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            words = min(len(one), len(two))
            out[k] = np.bitwise_count(fold(one, words) ^ fold(two, words)).sum()
        return pd.Series(out)

    total = F.col("an") + F.col("bn")
    most = total - 2 * F.ceil(percent * total / F.lit(100 + percent) - 1e-9)
    far = F.pandas_udf(distance, "long")("a_sketch", "b_sketch")
    return _meet(pairs, sketches, "sketch").withColumn("far", far).filter(F.col("far") <= most).select(
        "a", "b", "crowd", "far")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b) of the pairs whose sets link; ``classes`` has key and rid of the rows ``docs``."""
    pairs = materialize(pairs.select("a", "b", "crowd"), "verify")
    named = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    wanted = classes.join(named, "key", "left_semi").groupBy("key").agg(F.min("rid").alias("rid"))
    sets = materialize(_sets(docs, materialize(wanted, "wanted"), words), "sets")
    overlap = F.size(F.array_intersect("a_tokens", "b_tokens")).cast("long")
    known = _meet(pairs, sets, "tokens")
    return known.filter(linked(overlap, F.col("an"), F.col("bn"), percent)).select("a", "b")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose classes are not in one component yet."""
    one = roots.select(F.col("key").alias("a"), F.col("root").alias("_ra"))
    two = roots.select(F.col("key").alias("b"), F.col("root").alias("_rb"))
    known = pairs.join(one, "a", "left").join(two, "b", "left")
    return known.filter(F.coalesce("_ra", "a") != F.coalesce("_rb", "b")).drop("_ra", "_rb")


def _open_lists(lists: DataFrame, roots: DataFrame, light: int) -> DataFrame:
    """Entries (token, key, n, size, root, main, mains) of heavy lists with two components or more."""
    many = lists.filter(F.col("size") > light).select("token", "key", "n", "size").join(roots, "key", "left")
    many = many.withColumn("root", F.coalesce("root", "key"))
    ends = many.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
    many = many.join(ends.select("token"), "token", "left_semi")
    main = many.groupBy("token", "root").agg(F.count("*").alias("count")).groupBy("token").agg(
        F.max(F.struct("count", "root")).alias("main"))
    return many.join(main, "token").select(
        "token", "key", "n", "size", "root", (F.col("root") == F.col("main.root")).alias("main"),
        F.col("main.count").alias("mains"))


def _block_pairs(opened: DataFrame, sketches: DataFrame, percent: int, spare: int | None) -> DataFrame:
    """(token, a, b, crowd, cut) of the pairs across components that sketches pass.

    Two blocks with more than ``spare`` such pairs a row give a spanning forest of them, marked as cut.
    """
    def blocks(count):
        return F.ceil(count / BLOCK).cast("int")

    spread = F.xxhash64("key")
    kin, other = blocks(F.col("mains")), blocks(F.col("size") - F.col("mains"))
    # a list that fits in one block moves each row once; 0 and 0 meet in it
    one = F.col("size") <= BLOCK
    own = F.when(one, F.lit(0)).when(F.col("main"), F.pmod(spread, kin)).otherwise(F.pmod(spread, other) + kin).cast("int")
    # blocks of the largest component meet those of others, these meet all
    met = F.when(one, F.array(F.lit(0))).when(F.col("main"), F.sequence(kin, kin + other - 1)).otherwise(
        F.sequence(F.lit(0), kin + other - 1))
    rows = opened.join(sketches.select("key", "sketch"), "key").withColumn("own", own)
    rows = rows.select("token", "key", "n", "size", "root", "main", "sketch", "own", F.explode(met).alias("met"))
    rows = rows.select("token", F.least("own", "met").alias("i"), F.greatest("own", "met").alias("j"), "own", "key", "n",
                       "size", "root", "main", "sketch")
    rows = rows.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "key")

    def compare(i, j, own, keys, sizes, roots, mains, sketched):
        left = np.flatnonzero(own == i)
        # rows of the largest component need not meet each other
        right = left[~mains[left]] if i == j else np.flatnonzero(own == j)
        x, y = may_link([sketched[k] for k in left], sizes[left], [sketched[k] for k in right], sizes[right], percent)
        x, y = left[x], right[y]
        across = (roots[x] != roots[y]) & (((x < y) | mains[x]) if i == j else True)
        x, y = x[across], y[across]
        if spare is None or len(x) <= spare * (len(left) + len(right)):
            return keys[x], keys[y], False
        top: dict[int, int] = {}

        def find(r):
            while top.get(r, r) != r:
                r = top[r]
            return r

        chosen = []
        for k, (p, q) in enumerate(zip(roots[x].tolist(), roots[y].tolist(), strict=True)):
            p, q = find(p), find(q)
            if p != q:
                top[max(p, q)] = min(p, q)
                chosen.append(k)
        return keys[x[chosen]], keys[y[chosen]], True

    def run(batches):
        held, name = [], None  # the rows of one pair of blocks, two blocks at most

        def done():
            own, keys, sizes, roots, mains, size = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held])
                                                    for c in ("own", "key", "n", "root", "main", "size"))
            sketched = [v for b in held for v in b.column("sketch").to_pylist()]
            a, b, cut = compare(name[1], name[2], own, keys, sizes, roots, mains, sketched)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(a), name[0]), pa.int64()), pa.array(np.minimum(a, b), pa.int64()),
                 pa.array(np.maximum(a, b), pa.int64()), pa.array(np.full(len(a), size[0]), pa.int64()),
                 pa.array(np.full(len(a), cut))], names=["token", "a", "b", "crowd", "cut"])

        for batch in batches:
            ids = [batch.column(c).to_numpy() for c in ("token", "i", "j")]
            change = np.flatnonzero(np.any([v[1:] != v[:-1] for v in ids], axis=0)) + 1
            for start, stop in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows], strict=True):
                if start == stop:
                    continue
                here = tuple(int(v[start]) for v in ids)
                if held and here != name:
                    yield done()
                    held = []
                name = here
                held.append(batch.slice(start, stop - start))
        if held:
            yield done()

    return rows.mapInArrow(run, "token long, a long, b long, crowd long, cut boolean")


def _distinct_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a", "b").agg(F.max("crowd").alias("crowd"))


def components(links: DataFrame) -> DataFrame:
    """key, root for all keys in ``links`` (a, b): the least key reachable, by large-star and small-star steps."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                        .filter("u > v").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        star = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = star.unionByName(least.filter("m < u").select("u", F.col("m").alias("v"))).distinct()
        low = star.groupBy("u").agg(F.min("v").alias("m"))
        small = star.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first())
        if now == before:
            break
        before = now
    roots = edges.select(F.col("u").alias("key"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("key"), F.col("v").alias("root")).distinct())


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, light: int = LIGHT,
         spare: int = SPARE, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``carry``, n_shingles, component_id, class_id and root of every row.

    ``class_id`` is the least id with the same set; ``root`` is null for empty sets, else equal within a component.
    """
    rows = docs.select("doc_id", *carry, "text", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("rid"))
    features, blocks = _features(rows, words, percent)
    full = features.filter("key is not null")
    lists = materialize(_lists(_shared_entries(features, blocks)), "lists")
    sketches = features.filter("sketch is not null").select("key", "n", "sketch")
    sketches = materialize(sketches.join(lists.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"]), "sketches")
    pairs = materialize(_passed(_first_pairs(lists, percent, light), sketches, percent), "pairs")
    owners = full.select("key", "rid")
    nearest = pairs.groupBy("a").agg(F.min(F.struct("far", "b", "crowd")).alias("best")).select(
        "a", "best.b", "best.crowd")
    links = materialize(_verified(nearest, rows, owners, words, percent), "links")
    roots = materialize(components(links), "roots")
    opened = materialize(_open_lists(lists, roots, light), "opened")
    # pairs tried before are not tried again
    rest = _apart(pairs.join(nearest, ["a", "b"], "left_anti").select("a", "b", "crowd"), roots)
    met = materialize(_block_pairs(opened, sketches, percent, spare), "blocks")
    rest = _distinct_pairs(rest.unionByName(met.select("a", "b", "crowd")))
    links = materialize(links.unionByName(_verified(rest, rows, owners, words, percent)), "links")
    roots = materialize(components(links), "roots")
    owing = opened.join(met.filter("cut").select("token").distinct(), "token", "left_semi")
    opened = materialize(_open_lists(owing.select("token", "key", "n", "size"), roots, light), "opened")
    if not opened.isEmpty():
        last = _distinct_pairs(_block_pairs(opened, sketches, percent, None))
        links = materialize(links.unionByName(_verified(last, rows, owners, words, percent)), "links")
        roots = materialize(components(links), "roots")
    classes = full.groupBy("key").agg(F.min("doc_id").alias("class_id")).join(roots, "key", "left")
    classes = materialize(classes.select("key", "class_id", F.coalesce("root", "key").alias("root")), "classes")
    least = classes.groupBy("root").agg(F.min("class_id").alias("component_id"))
    classes = classes.join(least, "root")
    named = features.select("doc_id", *carry, F.col("n").alias("n_shingles"), "key").join(classes, "key", "left")
    return named.select("doc_id", *carry, "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
                        F.coalesce("class_id", "doc_id").alias("class_id"), "root")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` less all but one of every component: the one with the smallest id stays.

    Rows with empty sets all stay.  Of rows equal in all columns, one is as good as another.
    """
    marked = row_keys(docs)
    slim = marked.select(F.col("_values.doc_id").alias("doc_id"), "_id", "_row", F.col("_values.text").alias("text"))
    rows = materialize(join(slim, carry=("_id", "_row"), **options).filter("root is not null").groupBy(
        "root", "doc_id", "_id", "_row").agg(F.count("*").alias("copies")), "members")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "_id", "_row")).alias("f"))
    kept = first.select("f._id", "f._row", F.lit(True).alias("kept"))
    judged = rows.join(kept, ["_id", "_row"], "left").filter("kept is null or copies > 1")
    gone = judged.select("_id", "_row")
    # rows that stay for certain are not moved
    inside, outside = _split(marked, "_row", _bits(gone.select(F.col("_row").alias("token"))))
    repeated = judged.filter("kept").select("_id", "_row")
    once = distinct_rows(inside.join(repeated, ["_id", "_row"], "left_semi")).select("_values.*")
    stay = inside.join(gone, ["_id", "_row"], "left_anti").select("_values.*")
    return outside.select("_values.*").unionByName(stay).unionByName(once)
