"""Mixing sources to target weights by systematic sampling.

Every source has a target in words.  A document's expected copies are target / size of its source; the copies are
summed along the source's documents in order of size, one random offset is added, and a document is emitted once for
every whole number that its stretch of the sum crosses.  Ordering by size makes neighbours alike, so the words taken
from a source differ from its target by about one large document at most.

The running sum is kept in whole units of 2**-30 copies, so it does not depend on how rows were dealt and reruns agree.

Results for odd input: null text has size 0; a source without words has target 0 and takes nothing; null is a source
of its own and comes last; rows equal in all columns count each, and share their copies; an empty table gives none.
Extra columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import WORD, distinct_rows, ranked, row_keys
from folioscope.session import materialize

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_COPIES = 2.0
SEED = 41
UNIT = 1 << 30


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
                   max_copies: float = MAX_COPIES) -> DataFrame:
    """source, source_size, target: ``share`` of all sizes by weight, no target above ``max_copies`` sources.

    Sharing the excess again and again ends where every source gets min(cap, level * weight) with one level.  Sources
    reach their caps in the order of cap / weight, so the level follows from sums along that order.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    totals = totals.withColumn("one", F.lit(1).cast("long")).withColumn("last", F.col("source").isNull())
    place = ranked(totals, [], ["last", "source"], ["one"], "sources")
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    weight = F.element_at(pattern, (F.pmod("before_one", F.lit(len(weights))) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(max_copies)
    sums = place.select("source", "source_size", weight.alias("weight"), cap.alias("cap"),
                        (cap / weight).alias("turn"))
    units = sums.select("*", F.rint(F.col("cap") * 1000).cast("long").alias("caps"),
                        F.rint(F.col("weight") * 1000).cast("long").alias("weights"))
    steps = materialize(ranked(units, [], ["turn"], ["caps", "weights"], "turns"), "steps")
    whole = steps.agg(F.coalesce(F.sum("weights"), F.lit(0)).alias("weights"),
                      F.coalesce(F.sum("source_size"), F.lit(0)).alias("size")).first()
    # the first source whose level stays below its turn is where capping ends; sources before it are at their caps
    level = ((F.lit(share * whole["size"] * 1000) - F.col("before_caps"))
             / (F.lit(float(whole["weights"])) - F.col("before_weights")))
    found = steps.filter(level < F.col("turn")).agg(F.min_by(level, F.struct("turn", "before_caps")).alias("level"))
    found = found.first()["level"]
    cut = F.col("cap") if found is None else F.least(F.col("cap"), F.col("weight") * F.lit(found))
    return steps.select("source", "source_size", cut.alias("target"))


def offset(source: Column, seed: int) -> Column:
    """The source's random offset in units, 0 to UNIT - 1: 28 bits of a digest, so that SQL can draw it as well."""
    digest = F.md5(F.concat(F.coalesce(source, F.lit("")), F.lit(f"|{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("long") * F.lit(UNIT >> 28)


def decide(docs: DataFrame, key: list[str], seed: int = SEED, **shares) -> DataFrame:
    """key columns (source among them), size, source_size, target, copies: one row per row of ``docs``."""
    slim = materialize(docs.select(*key, size_of().alias("size")), "sizes")
    targets = source_targets(slim.select("source", "size"), **shares)
    targets = targets.select(F.col("source").alias("_source"), "source_size", "target")
    rows = slim.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    expected = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT)).otherwise(0)
    rows = rows.withColumn("expected", F.least(expected, F.lit(int(MAX_COPIES) * UNIT)).cast("long"))
    order = ["size", *[k for k in key if k != "source"]]
    sums = ranked(rows, ["source"], order, ["expected"], "copies")
    start = F.col("before_expected") + offset(F.col("source"), seed)
    crossed = F.floor((start + F.col("expected")) / UNIT) - F.floor(start / UNIT)
    return sums.withColumn("copies", crossed.cast("long")).drop("before_expected", "expected")


def mix(docs: DataFrame, seed: int = SEED, **shares) -> DataFrame:
    """The rows of the mix with the columns of ``docs``: every row as often as it was drawn.

    Decisions are made on slim rows.  Texts move once: rows equal in all columns are gathered to one (they are
    combined before the shuffle), which joins the sum of its decisions and is repeated.
    """
    marked = row_keys(docs)
    slim = marked.select("_id", "_row", F.col("_values.source").alias("source"), F.col("_values.text").alias("text"))
    drawn = decide(slim, ["_id", "source", "_row"], seed, **shares).groupBy("_id", "_row").agg(
        F.sum("copies").alias("_copies"))
    drawn = drawn.filter("_copies > 0").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return distinct_rows(marked).join(drawn, ["_id", "_row"]).select("_values.*")
