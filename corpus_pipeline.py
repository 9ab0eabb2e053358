"""From raw documents to a sharded training mix: each stage calls one operator of ``folioscope.llm``.

Every stage takes (spark, docs, sf_dir), works on all its predecessor kept, and returns the columns of documents; the
last adds shard, slot and shard_bytes.  Stages are written as Parquet to the shared folder and read again.

Results for odd input, by stage: texts that are null, empty or without letters go with the language stage; near copies keep
the row with the smallest id of a group, a row with an id before one without, and one of rows equal in all columns; an
item of the benchmark that is null, empty or too short to match removes nothing; a null source is a source of its own in
the mix, and of equal rows each counts; shards take rows with null ids as well.  Extra columns stay as they are, whatever
their names, but for those that the last stage adds.  Without documents every stage returns none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm import decontaminate, jaccard_join, language_id, mixing, resharding
from folioscope.llm.common import held_out, table
from folioscope.session import materialize

NEAR_WORDS = 5
NEAR_PERCENT = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters that resemble a learned language as texts of their length do; ``lang`` stays as it was."""
    training = docs.filter(~held_out(3, 1))
    prototypes = language_id.learn(training)
    return language_id.recognised(docs, prototypes, language_id.learn_limits(training, prototypes))


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: texts whose sets of five-word shingles have a Jaccard of 0.8 or more."""
    return jaccard_join.keep_one(docs, words=NEAR_WORDS, percent=NEAR_PERCENT)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents repeated or left out so that sources have their target words."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards with as many rows each, moved from the layout by id hash at the fewest bytes."""
    return resharding.attach(docs)


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", join_near_copies),
    ("decontamination", remove_benchmark),
    ("source_mixing", mix_sources),
    ("resharding", shard),
]

# learned prototypes, links and edit distances are beyond SQL; tests/llm holds the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
