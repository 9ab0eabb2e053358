"""Log appends, idempotent migration and schema evolution."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import strip
from folioscope.operators.scans import RANGE, range_blocks, row_numbers
from folioscope.session import materialize

SOURCES = "array<struct<document:string,page:int>>"


def prompt_log_rows(prompts: DataFrame) -> DataFrame:
    """Rows of the prompt log: stripped team, sources as JSON."""
    return prompts.select(strip(F.col("team_name")).alias("team_name"), "prompt", "response",
                          F.to_json("sources").alias("sources"), "created_at")


def append_prompt_log(prompts: DataFrame, path: str) -> None:
    """Append prompt rows to a Parquet log."""
    prompt_log_rows(prompts).write.mode("append").parquet(path)


def parse_when(c):
    """ISO or plain timestamps, with or without Z; null when unreadable."""
    return F.try_to_timestamp(F.regexp_replace(c.cast("string"), "Z$", "+00:00"))


def converted(source: DataFrame, target: DataFrame) -> DataFrame:
    """``source`` in the target's columns and types: JSON text to arrays, ISO text to times, the rest by cast."""
    fields = []
    for f in target.schema.fields:
        column = F.col(f.name)
        kind = f.dataType.simpleString()
        have = source.schema[f.name].dataType.simpleString()
        if have == kind:
            fields.append(column)
        elif kind.startswith("array") and have == "string":
            fields.append(F.from_json(column, kind).alias(f.name))
        elif kind == "timestamp":
            fields.append(parse_when(column).alias(f.name))
        else:
            fields.append(column.cast(f.dataType).alias(f.name))
    return source.select(*fields)


def migrate_if_absent(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Source rows whose key the target lacks, in the target's columns and types."""
    return converted(source, target).join(target.select(key), key, "left_anti").select(*target.columns)


@dataclass(frozen=True)
class Move:
    """How a table is moved: ``natural`` columns tell whether the target has a row already.

    ``parents`` names the table that a column's keys belong to.  Where the target ``generates`` keys, new rows are
    numbered on from its largest key, in the order of the source's keys.  ``stripped`` text columns lose their margins.
    """

    name: str
    key: str = "id"
    natural: tuple[str, ...] = ("id",)
    parents: dict[str, str] = field(default_factory=dict)
    generates: bool = False
    stripped: tuple[str, ...] = ()


@dataclass(frozen=True)
class Moved:
    """New rows for the target, source rows whose parent is nowhere, and (old_key, new_key) of all rows now there."""

    inserted: DataFrame
    orphans: DataFrame
    keys: DataFrame


def in_parent_order(moves: list[Move]) -> list[Move]:
    """Tables after all tables that their rows refer to."""
    done, out, todo = set(), [], list(moves)
    while todo:
        ready = [m for m in todo if set(m.parents.values()) - {m.name} <= done]
        if not ready:
            raise ValueError(f"tables refer to each other or to unknown ones: {[m.name for m in todo]}")
        out += ready
        done |= {m.name for m in ready}
        todo = [m for m in todo if m.name not in done]
    return out


def migrate_cascade(moves: list[Move], source: dict[str, DataFrame], target: dict[str, DataFrame]) -> dict[str, Moved]:
    """Move every table into the target, parents first, each row at most once however often this runs.

    A child's keys are replaced by those that its parents have in the target; null keys stay null.  Source rows that
    are equal in the natural columns are one row, the one with the least key, and all their keys lead to it.  Rows of
    a table move by joins on keys and one range sort of the new rows; nothing passes through the driver.
    """
    out: dict[str, Moved] = {}
    for move in in_parent_order(moves):
        have = target[move.name]
        rows = converted(source[move.name], have)
        rows = rows.withColumns({c: strip(F.col(c)) for c in move.stripped})
        lost = F.lit(False)
        for column, parent in move.parents.items():
            named = out[parent].keys.select(F.col("old_key").alias("__old"), F.col("new_key").alias("__new"))
            rows = rows.join(named, F.col(column) == F.col("__old"), "left")
            lost = lost | (F.col(column).isNotNull() & F.col("__new").isNull())
            rows = rows.withColumn("__lost", lost).withColumn(
                column, F.when(F.col("__new").isNull(), F.col(column)).otherwise(F.col("__new"))).drop("__old", "__new")
            lost = F.col("__lost")
        rows = materialize(rows.withColumn("__lost", lost), f"moved-{move.name}")
        kept = rows.filter(~F.col("__lost")).drop("__lost")
        others = [c for c in have.columns if c != move.key and c not in move.natural]
        best = F.min(F.struct(move.key, *others)).alias("__r")
        first = kept.groupBy(*move.natural).agg(best).select(
            *[c for c in move.natural if c != move.key], "__r.*")
        absent = first.join(have.select(*move.natural), list(move.natural), "left_anti")
        inserted = absent
        if move.generates:
            most = have.agg(F.coalesce(F.max(move.key), F.lit(0)).alias("__most"))
            ranged = range_blocks(absent, [], [move.key], f"new-{move.name}")
            numbered = row_numbers(ranged, [], [move.key], F.col(RANGE), "__n").drop(RANGE)
            kind = have.schema[move.key].dataType
            # one row with the largest key, read once
            inserted = numbered.withColumn(move.key, (F.col("__n") + F.lit(most.first()["__most"])).cast(kind)).drop("__n")
        inserted = materialize(inserted.select(*have.columns), f"new-rows-{move.name}")
        there = have.select(*have.columns).unionByName(inserted)
        keys = kept.select(F.col(move.key).alias("old_key"), *[F.col(c).alias(f"__n{i}") for i, c in enumerate(move.natural)])
        same = [F.col(f"__n{i}") == F.col(c) for i, c in enumerate(move.natural)]
        keys = keys.join(there.select(*dict.fromkeys([*move.natural, move.key])), reduce(and_, same)).select(
            "old_key", F.col(move.key).alias("new_key"))
        out[move.name] = Moved(inserted, rows.filter("__lost").drop("__lost"), keys)
    return out


def row_text(df: DataFrame, columns: list[str]) -> Column:
    """The columns as one text; times to the microsecond, a mark for null."""
    def text(c: str) -> Column:
        if df.schema[c].dataType.typeName() == "timestamp":
            return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        return F.col(c).cast("string")

    return F.concat_ws("|", *[F.coalesce(text(c), F.lit("<null>")) for c in columns])


CHECK_MODULUS = 2 ** 61


def set_checksum(df: DataFrame, columns: list[str]) -> list[Column]:
    """Count and order-free checksum of the rows: the sum of the first 32 bits of their md5."""
    part = F.conv(F.substring(F.md5(row_text(df, columns)), 1, 8), 16, 10).cast("decimal(38,0)")
    total = F.coalesce(F.sum(part), F.lit(0).cast("decimal(38,0)")) % F.lit(CHECK_MODULUS).cast("decimal(38,0)")
    return [F.count("*").alias("n"), total.cast("long").alias("checksum")]


def reconcile_cascade(moves: list[Move], source: dict[str, DataFrame], target: dict[str, DataFrame],
                      moved: dict[str, Moved]) -> DataFrame:
    """Per table: counts, orphans and set checksums on both sides after the move.

    Keys that the target generates, and columns that hold such keys, are compared by the parent's natural columns.
    """
    by_name, parts = {m.name: m for m in moves}, []

    def comparable(move: Move, tables: dict[str, DataFrame]) -> DataFrame:
        rows = tables[move.name]
        for column, parent in move.parents.items():
            up = by_name[parent]
            named = tables[parent].select(F.col(up.key).alias("__k"), row_text(tables[parent], list(up.natural)).alias("__text"))
            rows = rows.join(named, F.col(column) == F.col("__k"), "left").withColumn(column, F.col("__text")).drop("__k", "__text")
        return rows.drop(move.key) if move.generates else rows

    before = {m.name: converted(source[m.name], target[m.name]).withColumns(
        {c: strip(F.col(c)) for c in m.stripped}) for m in moves}
    after = {m.name: target[m.name].unionByName(moved[m.name].inserted) for m in moves}
    for move in moves:
        for side, tables in (("source", before), ("target", after)):
            rows = comparable(move, tables)
            parts.append(rows.agg(*set_checksum(rows, rows.columns)).select(
                F.lit(move.name).alias("table_name"), F.lit(side).alias("side"), "n", "checksum"))
        parts.append(moved[move.name].orphans.agg(F.count("*").alias("n")).select(
            F.lit(move.name).alias("table_name"), F.lit("orphans").alias("side"), "n", F.lit(0).cast("long").alias("checksum")))
    side = {s: F.col("side") == s for s in ("source", "target", "orphans")}
    counted = reduce(DataFrame.unionByName, parts).groupBy("table_name").agg(
        F.max(F.when(side["source"], F.col("n"))).alias("source_count"),
        F.max(F.when(side["target"], F.col("n"))).alias("target_count"),
        F.max(F.when(side["orphans"], F.col("n"))).alias("orphan_count"),
        F.max(F.when(side["source"], F.col("checksum"))).alias("source_checksum"),
        F.max(F.when(side["target"], F.col("checksum"))).alias("target_checksum"))
    return counted.withColumns({"matches": F.col("source_count") == F.col("target_count"),
                                "contents_match": F.col("source_checksum") == F.col("target_checksum")})


def migration_reconcile(pairs: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Source count, target count and match flag per table, in one job."""
    parts = []
    for name, (source, target) in pairs.items():
        for side, df in (("source", source), ("target", target)):
            parts.append(df.agg(F.count("*").alias("n")).select(
                F.lit(name).alias("table_name"), F.lit(side).alias("side"), "n"))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    counted = rows.groupBy("table_name").agg(
        F.max(F.when(F.col("side") == "source", F.col("n"))).alias("source_count"),
        F.max(F.when(F.col("side") == "target", F.col("n"))).alias("target_count"))
    return counted.withColumn("matches", F.col("source_count") == F.col("target_count"))


def add_sources_column(log: DataFrame) -> DataFrame:
    """Add a null ``sources`` column when it is missing; a second run changes nothing."""
    if "sources" in log.columns:
        return log
    return log.withColumn("sources", F.lit(None).cast(SOURCES))


def union_evolved(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new rows under the wider schema."""
    return old.unionByName(new, allowMissingColumns=True)
