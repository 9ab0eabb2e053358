"""Continuous jobs: ingestion, repeat filter, quota, lane monitor, admin metrics.

Every job takes a streaming DataFrame and returns one, or starts a query with a checkpoint
on shared storage, so a lost executor or driver resumes without losing or doubling rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from folioscope.functions import vocab as V
from folioscope.functions.text import normalized_key
from folioscope.operators.indexing import with_vectors
from folioscope.operators.lanes import DEGRADED_AFTER, rate_limited
from folioscope.operators.usage import remaining_seconds
from folioscope.plans.corpus import payload_pages
from folioscope.session import materialize
from folioscope.sources.collection import CollectionStore


def stream_ingest(pages: DataFrame, store: CollectionStore, document_type: str, checkpoint: str,
                  index: Callable[[DataFrame], DataFrame] | None = None, **trigger) -> StreamingQuery:
    """Index every arriving micro-batch of pages: chunks, payload and vectors of the documents that it touches.

    A document's pages may come in several batches; a page that comes again replaces the one before (of two in one
    batch, the greater text stays).  Pages lie beside the
    points in folders by document type and bucket.  A batch reads and replaces only the buckets of its documents, in
    the pages and in the points, so its cost follows the batch and not what came before; a replayed batch gives the
    same tables.  Touched documents are built anew from all their pages and replace what the collection had of them,
    also where nothing is left to index.
    """
    folder, keys = f"{store.root}/pages", ["document_type", "bucket"]
    page = ["document_id", "page_number"]

    def write(batch: DataFrame, number: int) -> None:
        fresh = _latest(batch.withColumn("bucket", store.bucket_of()), page).withColumn("document_type", F.lit(document_type))
        mine = store.read_folder(folder, fresh.schema).filter(F.col("document_type") == document_type)
        first = mine.isEmpty()
        if first:  # nothing to keep: the batch goes straight to its folders
            fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option(
                "compression", "zstd").partitionBy(*keys).parquet(folder)
            mine = store.read_folder(folder, fresh.schema).filter(F.col("document_type") == document_type)
            touched = mine.select("document_id").distinct()
            pages = mine.filter("document_id is not null")
        else:
            fresh = materialize(fresh, "arrived", "zstd")  # read several times below
            touched = fresh.select("document_id").distinct()
        touched = materialize(touched, "touched")
        buckets = store.touched(touched)
        if not buckets:
            return
        if not first:
            here = F.col("bucket").isin(buckets)
            store.overwrite(mine.filter(here).join(fresh.select(*page), page, "left_anti").unionByName(fresh), folder, keys)
            mine = store.read_folder(folder, fresh.schema).filter(F.col("document_type") == document_type)
            pages = mine.filter(here).join(touched, "document_id", "left_semi")
        pages = pages.select(*batch.columns)
        # vectors are made where the rows are written, so they are not moved
        rows = index(pages) if index else payload_pages(pages, document_type, stored=first)
        finish = None if index else with_vectors
        if not store.exists(document_type):
            store.create(finish(rows) if finish else rows, document_type, V.EMBEDDING_DIMENSION)
        store.replace_documents(rows, document_type, touched, finish)

    return (pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def _latest(pages: DataFrame, page: list[str], parts: int = 8) -> DataFrame:
    """One row per page, of several the greatest, dealt out by parts of buckets, so that a task writes few of them."""
    dealt = pages.withColumn("part", F.pmod(F.xxhash64(*page), F.lit(parts))).repartition("bucket", "part")
    last = F.max(F.struct(*[c for c in pages.columns if c not in ["bucket", *page]])).alias("p")
    return dealt.groupBy("bucket", "part", *page).agg(last).select("bucket", *page, "p.*")


def stream_repeat_filter(log: DataFrame, ttl_seconds: int = V.ANSWER_TTL_SECONDS) -> DataFrame:
    """First questions only; repeats inside the time-to-live are dropped."""
    return (log.withColumn("question_key", normalized_key(F.col("question")))
            .withWatermark("ts", f"{ttl_seconds} seconds").dropDuplicatesWithinWatermark(["question_key"]))


def _rocksdb(stream: DataFrame) -> None:
    """Arbitrary state with timers and time-to-live needs this store."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in stream.sparkSession.conf.get(key):
        stream.sparkSession.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Admission(StatefulProcessor):
    """Questions used per team, forgotten once the team's session cannot be open any more."""

    def __init__(self, ttl_seconds: int):
        self.ttl = ttl_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getValueState("used", "used long", ttlDurationMs=self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # only narrow columns are held: the order of a batch is known when all of it is there
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "request_id"], kind="stable")
        used = self.used.get()[0] if self.used.exists() else 0
        consumes = (~batch["expired"] & ~batch["refunded"]).to_numpy().astype(np.int64)
        before = used + np.cumsum(consumes) - consumes
        if consumes.any():
            self.used.update((int(used + consumes.sum()),))
        full = before >= batch["question_limit"].to_numpy()
        outcome = np.where(batch["expired"], "EXPIRED", np.where(full, "QUOTA", "ACCEPTED"))
        status = np.where(batch["expired"], 403, np.where(full, 429, 200)).astype(np.int32)
        for at in range(0, len(batch), OUT_ROWS):
            part = slice(at, at + OUT_ROWS)
            yield pd.DataFrame({"team_name": key[0], "request_id": batch["request_id"].to_numpy()[part],
                                "ts": batch["ts"].to_numpy()[part], "used_before": before[part], "outcome": outcome[part],
                                "status_code": status[part]})

    def close(self) -> None:
        pass


OUT_ROWS = 10_000


def stream_quota(requests: DataFrame, duration: int = V.SESSION_SECONDS, ttl_seconds: int = 2 * V.SESSION_SECONDS) -> DataFrame:
    """Outcome of every request as it comes in: ACCEPTED, QUOTA or EXPIRED (append mode).

    ``requests(request_id, team_name, ts, started_at, question_limit, refunded)``.  Every row is answered in its own
    micro-batch; rows of one batch count in the order of (ts, request_id), so batches in time order give what
    ``quota_admission`` gives for all rows.  A null flag counts as not refunded, a null limit as the default.  A team's
    count lives ``ttl_seconds`` after its last consuming request.  One task holds the narrow columns of a team's rows of
    one micro-batch; the source's trigger limit (files or bytes per trigger) bounds them.  To drain a table, start the
    query without idle batches (see ``run_to_table``).
    """
    _rocksdb(requests)
    expired = F.coalesce(remaining_seconds(F.col("started_at"), F.col("ts"), duration) <= 0, F.lit(False))
    slim = requests.select(
        "team_name", "request_id", "ts", expired.alias("expired"),
        F.coalesce("refunded", F.lit(False)).alias("refunded"),
        F.coalesce(F.col("question_limit").cast("long"), F.lit(V.QUESTION_LIMIT).cast("long")).alias("question_limit"))
    kind = requests.schema["request_id"].dataType.simpleString()
    return slim.groupBy("team_name").transformWithStateInPandas(
        _Admission(ttl_seconds), f"team_name string, request_id {kind}, ts timestamp, used_before long, outcome string, "
        "status_code int", "Append", "ProcessingTime")


LANE_OUTPUT = "lane_id string, state string, error_count long, at timestamp, cause string"


def _that_can_matter(attempts: DataFrame) -> DataFrame:
    """Of a lane's attempts in an Arrow batch, the latest success and the errors after it, dropped where they lie.

    What goes is older than a success that stays, so the watermark drops no success whose errors are still counted.
    The schema's metadata carries the watermark over.
    """
    def run(batches):
        for batch in batches:
            rows = batch.select(["lane_id", "ts", "attempt_id", "success"]).to_pandas()
            rows["place"] = np.arange(len(rows))
            rows = rows.sort_values(["ts", "attempt_id"], kind="stable")
            left = rows["success"].astype(int)[::-1].groupby(rows["lane_id"][::-1], dropna=False).cumsum()
            keep = rows["place"][(left == 0) | ((left == 1) & rows["success"])]
            yield batch.take(pa.array(np.sort(keep.to_numpy())))

    return attempts.mapInArrow(run, attempts.schema)


class _Lane(StatefulProcessor):
    """A lane's latest attempt, its latest success, and the errors after that success.

    Errors that the watermark has passed are a number: any success still to come is later than they are.  Errors that
    a late success may still precede are kept one by one, by (ts, attempt_id), in a list.
    """

    def __init__(self, kind: str, cooldown: int):
        self.kind, self.cooldown = kind, cooldown

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState(
            "head", f"passed long, good_ts long, good_id {self.kind}, end_ts long, end_id {self.kind}, success boolean, "
            "limited boolean")
        self.open = handle.getListState("open", f"ts long, attempt_id {self.kind}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        passed, good, end, success, limited = 0, None, None, True, False
        if self.head.exists():
            passed, good_ts, good_id, end_ts, end_id, success, limited = self.head.get()
            good, end = (None if good_ts is None else (good_ts, good_id)), (end_ts, end_id)
        known = [(r[0], r[1]) for r in self.open.get()] if self.open.exists() else []
        before = good
        for timer in list(self.handle.listTimers()):
            if timer * 1000 <= mark:  # its own call would come after these rows
                yield self._row(key, "AVAILABLE", passed + len(known), timer * 1000, "timer")
            self.handle.deleteTimer(timer)
        for frame in rows:
            ts = frame["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
            for at, name, ok, full in zip(ts.tolist(), frame["attempt_id"].tolist(), frame["success"].tolist(),
                                          frame["limited"].tolist(), strict=True):
                if at < mark:  # too late: what it could change has been counted
                    continue
                one = (at, name)
                if end is None or one >= end:
                    end, success, limited = one, bool(ok), bool(full)
                if not ok and (good is None or one > good):
                    known.append(one)
                elif ok and (good is None or one > good):
                    good = one
            known = known if good is None else [e for e in known if e > good]
        if end is None:
            return
        if good != before:
            passed = 0  # all that the watermark had passed came before this success
        passed += sum(e[0] < mark for e in known)
        known = [e for e in known if e[0] >= mark]
        self.head.update((passed, *(good or (None, None)), *end, success, limited))
        if known:
            self.open.put(known)
        elif self.open.exists():
            self.open.clear()
        errors = passed + len(known)
        state = "AVAILABLE" if success else "RATE_LIMITED" if limited else "DEGRADED" if errors >= DEGRADED_AFTER else "AVAILABLE"
        until = end[0] // 1000 + self.cooldown * 1000
        if state != "AVAILABLE" and until > mark // 1000:
            self.handle.registerTimer(until)
        yield self._row(key, state, errors, end[0], "attempt")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, *_ = self.head.get()
        errors = passed + (len(list(self.open.get())) if self.open.exists() else 0)
        yield self._row(key, "AVAILABLE", errors, expiredTimerInfo.getExpiryTimeInMs() * 1000, "timer")

    @staticmethod
    def _row(key, state: str, errors: int, micros: int, cause: str) -> pd.DataFrame:
        return pd.DataFrame({"lane_id": [key[0]], "state": [state], "error_count": [errors],
                             "at": [pd.Timestamp(micros, unit="us")], "cause": [cause]})

    def close(self) -> None:
        pass


def stream_lane_monitor(attempts: DataFrame, cooldown: int = V.COOLDOWN_SECONDS) -> DataFrame:
    """Lane state after each batch of attempts; a cooled-down lane turns AVAILABLE by a timer.

    ``attempts(attempt_id, lane_id, ts, success, status_code, error)`` with a watermark on ``ts``.  Attempts count in the
    order of (ts, attempt_id), whatever the batches in which they come, as long as the watermark has not passed them;
    later ones are left out.  ``cause`` tells rows after attempts from rows of the timer, whose ``at`` is the end of the
    cooldown.  A lane's state holds the errors after its latest success that the watermark has not passed, two narrow
    columns each; of an Arrow batch only the latest success and the errors after it reach the lane's task.
    """
    _rocksdb(attempts)
    slim = attempts.select("attempt_id", "lane_id", "ts", F.coalesce("success", F.lit(False)).alias("success"),
                           rate_limited(F.col("status_code"), F.col("error")).alias("limited"))
    kind = attempts.schema["attempt_id"].dataType.simpleString()
    return _that_can_matter(slim).groupBy("lane_id").transformWithStateInPandas(
        _Lane(kind, cooldown), LANE_OUTPUT, "Update", "EventTime")


def stream_admin_metrics(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Event counts per team and tumbling window, closed by a watermark."""
    return (events.withWatermark("ts", delay).groupBy(F.window("ts", width), "team_name")
            .agg(F.count("*").alias("events"), F.max("ts").alias("last_activity_at"))
            .select(F.col("window.start").alias("window_start"), "team_name", "events", "last_activity_at"))


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", idle_batches: bool = True) -> DataFrame:
    """Drain the available input into Parquet and return what was written.

    In update mode every batch is appended with its number; the last row per key wins.  Without ``idle_batches`` there
    is no batch without rows: state with a time-to-live would ask for such batches for ever.
    """
    spark = stream.sparkSession
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        # the batch number names the folder, so a replayed batch overwrites itself
        batch.withColumn("batch_no", F.lit(number)).write.mode("overwrite").parquet(f"{path}/b{number:06d}")

    idle = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(idle)
    spark.conf.set(idle, str(idle_batches).lower())  # a query keeps the value that it starts with
    try:
        query = (stream.writeStream.outputMode(mode).foreachBatch(write)
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        spark.conf.set(idle, before)
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    written = T.StructType([*schema.fields, T.StructField("batch_no", T.IntegerType())])
    return spark.read.schema(written).parquet(f"{path}/*")
