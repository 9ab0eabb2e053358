"""Registered queries: the streaming jobs drained over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioscope.functions import vocab as V
from folioscope.plans import duck as D, inputs as I
from folioscope.session import scratch_root
from folioscope.sources.collection import CollectionStore
from folioscope.streaming import jobs as J


def _stream(spark, sf, name):
    schema = I.table(spark, sf, name).schema
    # a table is one file or a folder of files
    found = spark.readStream.schema(schema).parquet(f"{sf}/{name}.parquet*")
    return found.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in schema.names else found


def _scratch(spark, name):
    root = f"{scratch_root(spark)}/stream-{name}-{uuid.uuid4().hex}"
    return f"{root}/out", f"{root}/checkpoint"


def stream_ingest(spark, sf):
    """Documents as one-page documents, chunked and upserted by micro-batch."""
    pages = _stream(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("document_id"), F.lit(1).cast("long").alias("page_number"), "text")
    root, checkpoint = _scratch(spark, "ingest")
    store = CollectionStore(spark, root)
    J.stream_ingest(pages, store, V.COMPANY, checkpoint).awaitTermination()
    return store.read(V.COMPANY).select("document_id", "reading_order", "section_type", "estimated_tokens", "dimension",
                                        F.md5("content").alias("content_md5"))


def stream_repeat_filter(spark, sf):
    """Every question passes once: all of the table is available at once, so it is one batch."""
    log = _stream(spark, sf, "events").select(F.col("event_id").alias("id"), "ts", F.col("props").alias("question"))
    kept = J.run_to_table(J.stream_repeat_filter(log), *_scratch(spark, "repeat"))
    return kept.groupBy("question_key").agg(F.count("*").alias("times_passed"))


def stream_quota(spark, sf):
    """Every event as a request of its user's team; sessions start with the day."""
    requests = _stream(spark, sf, "events").select(
        F.col("event_id").alias("request_id"), I.team_of().alias("team_name"), "ts",
        F.date_trunc("day", "ts").alias("started_at"), F.lit(QUOTA_LIMIT).alias("question_limit"),
        (F.col("event_type") == "error").alias("refunded"))
    return J.run_to_table(J.stream_quota(requests, QUOTA_SECONDS), *_scratch(spark, "quota"), idle_batches=False).select(
        "request_id", "team_name", "used_before", "outcome", "status_code")


def stream_lane_monitor(spark, sf):
    failed = F.col("event_type") == "error"
    attempts = _stream(spark, sf, "events").select(
        F.col("event_id").alias("attempt_id"), F.col("user_id").cast("string").alias("lane_id"), "ts", (~failed).alias("success"),
        F.when(~failed, 200).when(F.col("value") > 100, 429).otherwise(500).alias("status_code"),
        F.lit(None).cast("string").alias("error")).withWatermark("ts", "1 minute")
    rows = J.run_to_table(J.stream_lane_monitor(attempts), *_scratch(spark, "lanes"), mode="update")
    last = rows.filter("cause = 'attempt'").groupBy("lane_id").agg(
        F.max_by(F.struct("state", "error_count"), "batch_no").alias("r"))
    return last.select("lane_id", "r.state", "r.error_count")


def stream_admin_metrics(spark, sf):
    events = _stream(spark, sf, "events").select("ts", I.team_of().alias("team_name"))
    rows = J.run_to_table(J.stream_admin_metrics(events), *_scratch(spark, "metrics"), mode="update")
    last = rows.groupBy("window_start", "team_name").agg(F.max(F.struct("batch_no", "events")).alias("r"))
    return last.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "team_name", "r.events")


QUOTA_LIMIT, QUOTA_SECONDS = 60, 16 * 3600

QUERIES = {name: globals()[name] for name in (
    "stream_ingest stream_repeat_filter stream_quota stream_lane_monitor stream_admin_metrics").split()}

DOCUMENT_PAGES = "corpus AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, 1 AS page_number, text FROM documents)"

ORACLES = {
    "stream_ingest": D.with_(DOCUMENT_PAGES, D.HEADERS, D.CLEANED, D.lines_of("cleaned"), *D.CHUNKING)
    + """SELECT document_id, chunk_order AS reading_order, section_type, estimated_tokens, 384 AS dimension,
md5(content) AS content_md5 FROM final WHERE estimated_tokens <= 512""",
    "stream_repeat_filter": f"""SELECT {D.squash('lower(props)')} AS question_key, 1 AS times_passed FROM events GROUP BY 1""",
    "stream_quota": f"""WITH r AS (SELECT event_id AS request_id, 'team-' || user_id AS team_name, ts,
  date_diff('second', date_trunc('day', ts), ts) >= {QUOTA_SECONDS} AS expired, event_type = 'error' AS refunded FROM events),
c AS (SELECT *, coalesce(count(*) FILTER (NOT expired AND NOT refunded) OVER (PARTITION BY team_name ORDER BY ts, request_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used_before FROM r),
o AS (SELECT *, CASE WHEN expired THEN 'EXPIRED' WHEN used_before >= {QUOTA_LIMIT} THEN 'QUOTA' ELSE 'ACCEPTED' END AS outcome FROM c)
SELECT request_id, team_name, used_before, outcome,
CASE outcome WHEN 'EXPIRED' THEN 403 WHEN 'QUOTA' THEN 429 ELSE 200 END AS status_code FROM o""",
    "stream_lane_monitor": """WITH a AS (SELECT CAST(user_id AS VARCHAR) AS lane_id, ts, event_type <> 'error' AS ok,
  value > 100 AS limited, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events),
r AS (SELECT lane_id, coalesce(min(back) FILTER (ok), count(*) + 1) - 1 AS error_count FROM a GROUP BY 1)
SELECT lane_id, CASE WHEN ok THEN 'AVAILABLE' WHEN limited THEN 'RATE_LIMITED' WHEN error_count >= 3 THEN 'DEGRADED'
  ELSE 'AVAILABLE' END AS state, error_count FROM r JOIN a USING (lane_id) WHERE back = 1""",
    "stream_admin_metrics": """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start,
'team-' || user_id AS team_name, count(*) AS events FROM events GROUP BY 1, 2""",
}
