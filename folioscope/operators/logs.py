"""Structured log lines, latencies, request pairs, redaction and answer cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import vocab as V
from folioscope.functions.text import half_even, strip
from folioscope.operators.scans import RANGE, range_blocks, running

LINE = r"\[([A-Z_]+)\] (request_id=.*)$"
PERCENTILES = {"p50": 0.50, "p95": 0.95, "p99": 0.99}


def parse_structured_logs(lines: DataFrame) -> DataFrame:
    """``[EVENT] request_id=.. timestamp=.. duration_ms=.. k=v`` lines to typed columns.

    Lines in another format are left to ``other_lines``.  The first value of a repeated key is kept.
    """
    parsed = lines.withColumn("event", F.regexp_extract("line", LINE, 1)).filter("event <> ''")
    pairs = F.filter(F.split(F.regexp_extract("line", LINE, 2), " "), lambda p: F.contains(p, F.lit("=")))
    staged = parsed.withColumn("__p", pairs).withColumn("__k", F.array_distinct(
        F.transform("__p", lambda p: F.substring_index(p, "=", 1))))

    def value(key):
        pair = F.get(F.filter("__p", lambda p: F.startswith(p, F.concat(key, F.lit("=")))), F.lit(0))
        return F.substring(pair, F.length(key) + 2, F.length(pair))

    fields = F.map_from_arrays("__k", F.transform("__k", value))
    return (staged.withColumn("fields", fields)
            .withColumn("request_id", F.col("fields")["request_id"])
            .withColumn("event_time", F.try_to_timestamp(F.col("fields")["timestamp"]))
            .withColumn("duration_ms", F.col("fields")["duration_ms"].try_cast("double"))
            .drop("__p", "__k"))


def other_lines(lines: DataFrame) -> DataFrame:
    """The lines that ``parse_structured_logs`` does not take."""
    return lines.filter(F.coalesce(F.regexp_extract("line", LINE, 1), F.lit("")) == "")


def latency_summary(parsed: DataFrame, stages: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Stage durations per request; missing stages are 0.

    ``stages`` maps an event to the logged field that holds its duration and to the result column.
    """
    stages = stages or V.STAGE_EVENTS
    wide = parsed.groupBy("request_id").agg(*[
        F.coalesce(F.max(F.when(F.col("event") == event, F.col("fields")[field].try_cast("double"))), F.lit(0.0)).alias(name)
        for event, (field, name) in stages.items()])
    return wide.withColumn("database_ms", half_even(F.col("team_lookup_ms") + F.col("quota_ms"), 2)
                           ).drop("team_lookup_ms", "quota_ms")


def stage_timing(timings: DataFrame, stages: list[str]) -> DataFrame:
    """Stage seconds rounded to 4 digits with their total."""
    total = sum((F.coalesce(F.col(s), F.lit(0.0)) for s in stages), F.lit(0.0))
    kept = [c for c in timings.columns if c not in stages]
    return timings.select(*kept, *[half_even(F.col(s), 4).alias(s) for s in stages],
                          half_even(total, 4).alias("total"))


def latency_percentiles(latencies: DataFrame) -> DataFrame:
    """Exact min, avg, p50, p95, p99, max per ``level`` of ``latency``.

    Percentile p is the sorted value at 0-based position min(int(p * n), n - 1).  Equal
    values are counted before the shuffle; the running count is cut into ranges of about as
    many values each, so no level is sorted in one task, whatever its unit.
    """
    counts = range_blocks(latencies.groupBy("level", "latency").agg(F.count("*").alias("n")), ["level"], ["latency"],
                          "latencies")
    cumulated = running(counts, ["level"], ["latency"], F.col(RANGE), {"__upto": ("sum", F.col("n"))}).drop(RANGE)
    totals = latencies.groupBy("level").agg(
        F.count("*").alias("requests"), F.min("latency").alias("__min"), F.max("latency").alias("__max"),
        F.sum(F.col("latency").cast("decimal(18,6)")).cast("double").alias("__sum"))
    placed = cumulated.join(totals.select("level", "requests"), "level")

    def at(p: float) -> Column:
        index = F.least(F.floor(F.lit(p) * F.col("requests")), F.col("requests") - 1)
        here = (F.col("__upto") > index) & (F.col("__upto") - F.col("n") <= index)
        return half_even(F.max(F.when(here, F.col("latency"))), 3)

    picked = placed.groupBy("level").agg(*[at(p).alias(name) for name, p in PERCENTILES.items()])
    return totals.join(picked, "level").select(
        "level", "requests", half_even(F.col("__min"), 3).alias("min_latency"),
        half_even(F.col("__sum") / F.col("requests"), 3).alias("avg_latency"), *PERCENTILES,
        half_even(F.col("__max"), 3).alias("max_latency"))


def latency_percentiles_approx(latencies: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """One-pass approximate percentiles per level."""
    return latencies.groupBy("level").agg(*[
        F.percentile_approx("latency", p, accuracy).alias(name) for name, p in PERCENTILES.items()])


def throughput_and_status(results: DataFrame, walls: DataFrame) -> DataFrame:
    """Outcome counts and successes per wall second per level (``walls(level, wall_seconds)``)."""
    counted = results.groupBy("level").agg(
        F.count("*").alias("total_requests"), F.count_if("success").alias("successful_requests"),
        F.count_if(~F.col("success")).alias("failed_requests"),
        F.count_if("is_timeout").alias("timeout_count"))
    rate = F.when(F.col("wall_seconds") > 0, half_even(
        F.col("successful_requests") / F.col("wall_seconds"), 3)).otherwise(0.0)
    return counted.join(walls, "level").select(*counted.columns, rate.alias("throughput"))


def status_histogram(results: DataFrame) -> DataFrame:
    """Requests per level and status code; code 0 is TIMEOUT or ERROR."""
    code = F.when(F.col("status_code") > 0, F.col("status_code").cast("string")).otherwise(
        F.when(F.col("is_timeout"), "TIMEOUT").otherwise("ERROR"))
    return results.groupBy("level", code.alias("status")).agg(F.count("*").alias("requests"))


def http_request_log(parsed: DataFrame) -> DataFrame:
    """One row per request: start joined to its completion or failure; open ones in flight.

    Start and end are folded in one aggregate by request id instead of a self join.
    """
    def pick(event, key):
        return F.max(F.when(F.col("event") == event, F.col("fields")[key]))

    starts = F.count_if(F.col("event") == "HTTP_REQUEST_START")
    ends = parsed["event"].isin("HTTP_REQUEST_COMPLETE", "HTTP_REQUEST_FAILED")
    failed = F.count_if(F.col("event") == "HTTP_REQUEST_FAILED")
    done = F.count_if(F.col("event") == "HTTP_REQUEST_COMPLETE")
    return (parsed.filter(F.startswith(F.col("event"), F.lit("HTTP_REQUEST_"))).groupBy("request_id").agg(
        starts.alias("__starts"), pick("HTTP_REQUEST_START", "method").alias("method"),
        pick("HTTP_REQUEST_START", "path").alias("path"),
        pick("HTTP_REQUEST_COMPLETE", "status").alias("status"),
        F.max(F.when(ends, F.col("duration_ms"))).alias("duration_ms"),
        F.when(failed > 0, "failed").when(done > 0, "complete").otherwise("in_flight").alias("outcome"))
        .filter("__starts > 0").drop("__starts"))


def redact_secrets(rows: DataFrame, secrets: list[str], text: str = "message") -> DataFrame:
    """Replace known secrets longer than four characters by a marker; empty text is unknown."""
    c = F.col(text)
    for secret in secrets:
        if secret and len(secret.strip()) > V.MIN_SECRET_CHARS:
            c = F.replace(c, F.lit(secret), F.lit(V.REDACTED))
    return rows.withColumn(text, F.when(F.coalesce(F.col(text), F.lit("")) == "", "UnknownError").otherwise(c))


RESPONSE = ("choices array<struct<message:struct<content:string>,finish_reason:string>>, "
            "usage struct<prompt_tokens:int,completion_tokens:int,total_tokens:int,reasoning_tokens:int,"
            "completion_tokens_details:struct<reasoning_tokens:int>>")


def clean_answers(responses: DataFrame, body: str = "body") -> DataFrame:
    """Final text of provider responses (JSON): reasoning removed, token usage, error reason."""
    parsed = responses.withColumn("__r", F.from_json(body, RESPONSE))
    choice = F.get(F.col("__r.choices"), F.lit(0))
    raw = F.coalesce(choice["message"]["content"], F.lit(""))
    answer = strip(F.regexp_replace(raw, "(?s)<think>.*?</think>", ""))
    usage = F.col("__r.usage")
    no_choice = F.coalesce(F.size(F.col("__r.choices")), F.lit(0)) <= 0
    staged = (parsed.withColumn("answer", F.when(~no_choice, answer))
              .withColumn("finish_reason", F.when(~no_choice, F.coalesce(choice["finish_reason"], F.lit("unknown"))))
              .withColumn("error", F.when(no_choice, "empty_choices").when(F.col("answer") == "", "empty_text")))
    return staged.select(
        *responses.columns, F.when(F.col("error").isNull(), F.col("answer")).alias("answer"), "error",
        "finish_reason", F.coalesce(F.col("finish_reason") == "length", F.lit(False)).alias("truncated"),
        usage["prompt_tokens"].alias("prompt_tokens"), usage["completion_tokens"].alias("completion_tokens"),
        F.coalesce(usage["completion_tokens_details"]["reasoning_tokens"], usage["reasoning_tokens"],
                   F.lit(0)).alias("reasoning_tokens"), usage["total_tokens"].alias("total_tokens"))


