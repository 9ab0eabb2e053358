"""Team registry, quotas, boards and repeated questions over log tables.

Time never comes from the clock: every operator takes an explicit ``as_of``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import vocab as V
from folioscope.functions.text import half_even, normalized_key, strip
from folioscope.functions.time import micros
from folioscope.operators import orbits
from folioscope.operators.scans import RANGE, range_blocks, running
from folioscope.session import materialize

NO_EVENT = -1  # stands for "no event" where a key must not be null
DAY_MICROS = 86_400_000_000


def first_registration(requests: DataFrame) -> DataFrame:
    """First record per stripped team name (team_name, member_names, started_at, request_id)."""
    first = F.min(F.struct("started_at", "request_id", "member_names"))
    return (requests.groupBy(strip(F.col("team_name")).alias("team_name")).agg(first.alias("r"))
            .select("team_name", "r.member_names", "r.started_at", "r.request_id"))


def remaining_seconds(started_at: Column, as_of: Column, duration: int = V.SESSION_SECONDS) -> Column:
    elapsed = ((micros(as_of) - micros(started_at)) / F.lit(1_000_000.0)).cast("long")
    return F.when(started_at.isNull(), F.lit(duration).cast("long")).otherwise(
        F.greatest(F.lit(0).cast("long"), F.lit(duration) - elapsed))


def session_timer(teams: DataFrame, as_of: Column, duration: int = V.SESSION_SECONDS) -> DataFrame:
    """Seconds left in each team's session and whether it is over."""
    return teams.withColumn("remaining_seconds", remaining_seconds(F.col("started_at"), as_of, duration)
                            ).withColumn("is_expired", F.col("remaining_seconds") <= 0)


def quota_defaults(keys: DataFrame, quotas: DataFrame, events: DataFrame,
                   default: int = V.QUESTION_LIMIT) -> DataFrame:
    """Quota per (team_name, event_id): stored values, else the event's limit, else ``default``.

    A null event is a key of its own.
    """
    stored = quotas.select(F.col("team_name").alias("__t"), F.col("event_id").alias("__e"),
                           F.col("questions_used").alias("__used"), F.col("question_limit").alias("__limit"))
    limits = events.select(F.col("event_id").alias("__ev"), F.col("question_limit").alias("__event_limit"))
    joined = (keys.join(stored, (keys["team_name"] == stored["__t"])
                        & keys["event_id"].eqNullSafe(stored["__e"]), "left")
              .join(limits, keys["event_id"] == limits["__ev"], "left"))
    return joined.select(
        "team_name", "event_id", F.coalesce("__used", F.lit(0)).alias("questions_used"),
        F.coalesce("__limit", "__event_limit", F.lit(default)).alias("question_limit"))


def quota_admission(requests: DataFrame, duration: int = V.SESSION_SECONDS) -> DataFrame:
    """Outcome of every request: EXPIRED, QUOTA or ACCEPTED.

    ``requests(request_id, team_name, ts, started_at, question_limit, refunded)``.  Expiry is
    tested first; a refunded request gives its slot back.  The count of earlier consuming
    requests is a running sum over blocks of about equal row counts, so a hot team or a burst is spread.
    """
    expired = remaining_seconds(F.col("started_at"), F.col("ts"), duration) <= 0
    marked = range_blocks(requests, ["team_name"], ["ts", "request_id"], "requests").withColumn("__expired", expired)
    consumes = (~F.col("__expired") & ~F.col("refunded")).cast("long")
    counted = running(marked, ["team_name"], ["ts", "request_id"],
                      F.col(RANGE), {"used_before": ("sum", consumes)}, inclusive=False)
    outcome = (F.when(F.col("__expired"), "EXPIRED")
               .when(F.col("used_before") >= F.col("question_limit"), "QUOTA").otherwise("ACCEPTED"))
    status = F.when(outcome == "EXPIRED", 403).when(outcome == "QUOTA", 429).otherwise(200)
    return counted.withColumn("outcome", outcome).withColumn("status_code", status).drop("__expired", RANGE)


def event_overview(teams: DataFrame, quotas: DataFrame, as_of: Column) -> DataFrame:
    """One row: teams, active teams, questions used and remaining."""
    none = F.lit(0).cast("long")
    timed = session_timer(teams, as_of).select(
        F.lit(1).cast("long").alias("teams"), (~F.col("is_expired")).cast("long").alias("active"),
        none.alias("used"), none.alias("remaining"))
    used = quotas.select(
        none.alias("teams"), none.alias("active"), F.col("questions_used").cast("long").alias("used"),
        F.greatest(F.lit(0), F.col("question_limit") - F.col("questions_used")).cast("long").alias("remaining"))
    return timed.unionByName(used).agg(
        F.coalesce(F.sum("teams"), none).alias("registered_teams"), F.coalesce(F.sum("active"), none).alias("active_teams"),
        F.coalesce(F.sum("used"), none).alias("total_questions_used"),
        F.coalesce(F.sum("remaining"), none).alias("total_questions_remaining"))


def team_board(teams: DataFrame, quotas: DataFrame, prompts: DataFrame, as_of: Column,
               default: int = V.QUESTION_LIMIT) -> DataFrame:
    """Activity, quota and status per team; one aggregate and two joins for all teams."""
    latest = prompts.groupBy("team_name").agg(F.max("created_at").alias("__last"))
    used = quotas.filter("event_id is null").select("team_name", "questions_used", "question_limit")
    joined = (session_timer(teams, as_of).join(used, "team_name", "left")
              .join(latest, "team_name", "left")
              .withColumn("questions_used", F.coalesce("questions_used", F.lit(0)))
              .withColumn("question_limit", F.coalesce("question_limit", F.lit(default)))
              .withColumn("questions_remaining", F.greatest(
                  F.lit(0), F.col("question_limit") - F.col("questions_used"))))
    status = (F.when(F.col("questions_remaining") == 0, "COMPLETED")
              .when(F.col("is_expired"), "TIME_EXPIRED").otherwise("ACTIVE"))
    return joined.select(
        "team_name", "member_names", "started_at",
        F.coalesce("__last", "started_at").alias("last_activity_at"), "questions_used",
        "questions_remaining", "question_limit", status.alias("status"))


def team_detail(board: DataFrame, prompts: DataFrame, team_name: str | None = None) -> DataFrame:
    """Board columns beside the team's prompts; one row per prompt, teams without prompts kept.

    Rows replace a nested prompt list, which would grow without bound.  Sort by
    ``created_at`` descending for display.
    """
    if team_name is not None:
        board = board.filter(F.col("team_name") == team_name.strip())
        prompts = prompts.filter(F.col("team_name") == team_name.strip())
    return board.join(prompts.select("team_name", F.col("id").alias("prompt_id"), "prompt", "created_at"),
                      "team_name", "left")


def prompt_history(prompts: DataFrame, team_name: str | None = None) -> DataFrame:
    """Prompts oldest first, of one team or of every team."""
    if team_name is not None:
        prompts = prompts.filter(F.col("team_name") == team_name.strip())
    return prompts.orderBy("team_name", "created_at", "id")


def team_search(board: DataFrame, term: str = "", status: str = "ALL") -> DataFrame:
    """Teams whose name or any member contains ``term``, with a status filter."""
    needle = F.lit(term.lower())
    hit = F.contains(F.lower("team_name"), needle) | F.exists(
        F.coalesce("member_names", F.array().cast("array<string>")),
        lambda m: F.contains(F.lower(m), needle))
    found = board.filter(hit)
    return found if status == "ALL" else found.filter(F.col("status") == status)


def document_search(catalog: DataFrame, term: str = "") -> DataFrame:
    return catalog.filter(F.contains(F.lower("filename"), F.lit(term.lower())))


def document_totals(catalog: DataFrame) -> DataFrame:
    """Documents and pages of a catalogue; a missing page count is one page."""
    pages = F.when(F.coalesce("pages", F.lit(0)) > 0, F.col("pages")).otherwise(1)
    return catalog.agg(F.count("*").alias("documents"), F.coalesce(F.sum(pages), F.lit(0)).alias("total_pages"))


def recent_activity(prompts: DataFrame, limit: int = 5) -> DataFrame:
    """Latest prompts (top-k report)."""
    return prompts.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def recent_documents(catalog: DataFrame, limit: int = 4) -> DataFrame:
    """First documents of the catalogue (top-k report)."""
    return catalog.orderBy(F.lower("filename")).limit(limit)


def repeat_questions(log: DataFrame, ttl_seconds: int = V.ANSWER_TTL_SECONDS,
                     block_micros: int = DAY_MICROS) -> DataFrame:
    """Mark log rows (id, question, ts) that repeat an answer at most ``ttl_seconds`` old.

    The age counts from the last miss; a hit does not refresh it.  Blank questions are
    never cached.  A hot question is cut into time blocks.
    """
    keyed = log.withColumn("__text", normalized_key(F.col("question"))).filter("__text <> ''")
    # slim rows that several branches read
    items = materialize(keyed.select(F.md5("__text").alias("question_key"), micros("ts").alias("at"), "id"),
                        "questions")
    reach = ttl_seconds * 1_000_000 + 1

    def make_step(group):
        at = group["at"].to_numpy()
        return lambda i: int(at[i]) + reach

    entered = orbits.entries(items, ["question_key"], "at", ["at", "id"], block_micros, reach,
                             make_step, halo=False)

    def emit(group: pd.DataFrame) -> dict[str, np.ndarray]:
        at = group["at"].to_numpy()
        hit = np.ones(len(at), dtype=bool)
        i = int(np.searchsorted(at, group[orbits.CARRY].iloc[0]))
        while i < len(at):
            hit[i] = False
            i = int(np.searchsorted(at, at[i] + reach))
        return {"id": group["id"].to_numpy(), "question_key": group["question_key"].to_numpy(), "is_hit": hit}

    kind = items.schema["id"].dataType.simpleString()
    return orbits.walk(entered, ["question_key"], ["at", "id"],
                       f"id {kind}, question_key string, is_hit boolean", emit)


def cache_hit_rate(marked: DataFrame) -> DataFrame:
    """Hits, misses and the hit rate."""
    n = F.count("*")
    return marked.agg(F.count_if("is_hit").alias("hits"), F.count_if(~F.col("is_hit")).alias("misses"),
                      F.when(n > 0, half_even(F.count_if("is_hit") / n, 4)).otherwise(0.0).alias("hit_rate"))
