"""Provider lane snapshots and attempt logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.vocab import COOLDOWN_SECONDS
from folioscope.functions.time import micros
from folioscope.operators.scans import RANGE, range_blocks

STATES = ["AVAILABLE", "BUSY", "RATE_LIMITED", "DAILY_EXHAUSTED", "DEGRADED", "DISABLED"]
DEGRADED_AFTER = 3


def lane_effective_state(lanes: DataFrame, as_of: Column) -> DataFrame:
    """Add ``effective_state`` and ``eligible`` of every lane at ``as_of``."""
    off = ~F.col("enabled") | (F.col("state") == "DISABLED")
    cooling = F.col("cooldown_until").isNotNull() & (as_of < F.col("cooldown_until"))
    cooled = F.col("cooldown_until").isNotNull() & (as_of >= F.col("cooldown_until"))
    full = F.col("requests_used") >= F.col("daily_limit")
    busy = F.col("active_requests") >= F.col("max_concurrent_requests")
    open_state = F.when(cooled, "AVAILABLE").otherwise(F.col("state"))
    state = (F.when(off | cooling, F.col("state")).when(full, "DAILY_EXHAUSTED")
             .when(busy, "BUSY").otherwise(open_state))
    eligible = ~off & ~cooling & ~full & ~busy & open_state.isin("AVAILABLE", "BUSY")
    return lanes.withColumn("effective_state", state).withColumn("eligible", eligible)


def lane_ranking(lanes: DataFrame, as_of: Column, snapshot: str = "snapshot_id") -> DataFrame:
    """Order in which the eligible lanes of a snapshot would be taken.

    A snapshot holds the configured lanes only, so its group is small.
    """
    order = Window.partitionBy(snapshot).orderBy("priority", "active_requests", "requests_used", "lane_id")
    return lane_effective_state(lanes, as_of).filter("eligible").withColumn(
        "lane_rank", F.row_number().over(order))


def lane_pool_summary(lanes: DataFrame, as_of: Column) -> DataFrame:
    """Lanes by state and request totals per provider."""
    passed = F.col("cooldown_until").isNotNull() & (as_of >= F.col("cooldown_until"))
    state = F.when(passed & (F.col("requests_used") < F.col("daily_limit")), "AVAILABLE").otherwise(F.col("state"))
    known = ["AVAILABLE", "BUSY", "DAILY_EXHAUSTED", "RATE_LIMITED", "DEGRADED"]
    names = ["available", "busy", "exhausted", "rate_limited", "degraded"]
    return lanes.withColumn("__s", state).groupBy("provider").agg(
        F.count("*").alias("total_lanes"),
        *[F.count_if(F.col("__s") == s).alias(f"{n}_lanes") for s, n in zip(known, names)],
        F.count_if(~F.col("__s").isin(known)).alias("disabled_lanes"),
        F.sum("daily_limit").alias("total_limit"), F.sum("requests_used").alias("total_requests_used"),
        F.sum("active_requests").alias("total_active_requests"),
        F.sum(F.greatest(F.lit(0), F.col("daily_limit") - F.col("requests_used"))).alias("total_remaining"))


def lane_reconcile(configured: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored lanes after a sync with the configuration.

    Missing lanes are inserted, changed limits, models and switches updated, counters kept
    from the stored side, and lanes no longer configured disabled.
    """
    c = configured.select("lane_id", F.col("provider").alias("c_provider"), F.col("model").alias("c_model"),
                          F.col("enabled").alias("c_enabled"), F.col("daily_limit").alias("c_limit"))
    s = stored.select("lane_id", F.col("provider").alias("s_provider"), F.col("model").alias("s_model"),
                      F.col("enabled").alias("s_enabled"), F.col("daily_limit").alias("s_limit"),
                      "requests_used", "error_count")
    inserted, dropped = F.col("s_model").isNull(), F.col("c_model").isNull()
    changed = ((F.col("c_enabled") != F.col("s_enabled")) | (F.col("c_model") != F.col("s_model"))
               | (F.col("c_limit") != F.col("s_limit")))
    action = (F.when(inserted, "insert").when(dropped & F.col("s_enabled"), "disable")
              .when(dropped, "keep").when(changed, "update").otherwise("keep"))
    return c.join(s, "lane_id", "full").select(
        "lane_id", F.coalesce("c_provider", "s_provider").alias("provider"),
        F.coalesce("c_model", "s_model").alias("model"),
        F.coalesce("c_enabled", F.lit(False)).alias("enabled"),
        F.coalesce("c_limit", "s_limit").alias("daily_limit"),
        F.coalesce("requests_used", F.lit(0)).alias("requests_used"),
        F.coalesce("error_count", F.lit(0)).alias("error_count"), action.alias("action"))


def rate_limited(status_code: Column, error: Column) -> Column:
    text = F.lower(F.coalesce(error, F.lit("")))
    return (F.coalesce(status_code == 429, F.lit(False)) | F.contains(text, F.lit("429"))
            | F.contains(text, F.lit("rate limit")))


LIMITS = ("requests_used", "daily_limit", "active_requests", "max_concurrent_requests")


def lane_failure_runs(attempts: DataFrame, cooldown: int = COOLDOWN_SECONDS) -> DataFrame:
    """Consecutive errors, resulting state and cooldown end after every attempt.

    ``attempts(attempt_id, lane_id, ts, success, status_code, error)``; with the counters of LIMITS, taken after the
    attempt, a lane can also end up DAILY_EXHAUSTED or BUSY.

    Errors since the last success are counted inside blocks of about equal row counts.  A block hands on its number of
    errors and how many of them came before its last success; the blocks of a lane are few, so their running totals
    give what each block inherits.  Attempts are moved once, within their block.
    """
    ranged = range_blocks(attempts, ["lane_id"], ["ts", "attempt_id"], "attempts")
    inner = Window.partitionBy("lane_id", RANGE).orderBy("ts", "attempt_id").rowsBetween(Window.unboundedPreceding, 0)
    errors = F.sum(F.when(F.col("success"), 0).otherwise(1).cast("long")).over(inner)
    local = ranged.withColumn("__errors", errors).withColumn(
        "__base", F.max(F.when(F.col("success"), F.col("__errors"))).over(inner))
    before = Window.partitionBy("lane_id").orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    blocks = local.groupBy("lane_id", RANGE).agg(F.max("__errors").alias("__n"), F.max("__base").alias("__b"))
    sofar = blocks.withColumn("__sofar", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    done = sofar.withColumn("__done", F.col("__sofar") + F.col("__b"))
    carry = done.select(
        "lane_id", RANGE, (F.col("__sofar") - F.coalesce(F.max("__done").over(before), F.lit(0))).alias("__carry"))
    joined = local.join(carry, ["lane_id", RANGE])
    run = F.when(F.col("success"), F.lit(0).cast("long")).when(
        F.col("__base").isNotNull(), F.col("__errors") - F.col("__base")).otherwise(F.col("__errors") + F.col("__carry"))
    limited = ~F.col("success") & rate_limited(F.col("status_code"), F.col("error"))
    known = all(c in attempts.columns for c in LIMITS)
    spent = F.col("requests_used") >= F.col("daily_limit") if known else F.lit(False)
    full = F.col("active_requests") >= F.col("max_concurrent_requests") if known else F.lit(False)
    state = (F.when(limited, "RATE_LIMITED").when(~F.col("success") & (F.col("error_count") >= DEGRADED_AFTER), "DEGRADED")
             .when(spent, "DAILY_EXHAUSTED").when(F.col("success") & full, "BUSY").otherwise("AVAILABLE"))
    until = F.when(F.col("state_after").isin("RATE_LIMITED", "DEGRADED"),
                   F.timestamp_micros(micros("ts") + cooldown * 1_000_000))
    return (joined.withColumn("error_count", run).withColumn("state_after", state).withColumn("cooldown_until", until)
            .select(*attempts.columns, "error_count", "state_after", "cooldown_until"))


def provider_usage(attempts: DataFrame) -> DataFrame:
    """Request, pool and outcome totals (``is_fallback`` marks the fallback pool)."""
    return attempts.agg(
        F.count("*").alias("total_requests"),
        F.count_if(~F.col("is_fallback")).alias("primary_requests"),
        F.count_if("is_fallback").alias("fallback_requests"),
        F.count_if("success").alias("success_count"),
        F.count_if(~F.col("success")).alias("failure_count"))
