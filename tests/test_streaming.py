"""Streaming jobs over several files, one micro-batch per file."""

import pathlib
import random

from pyspark.sql import functions as F

from folioscope.operators.lanes import lane_failure_runs
from folioscope.operators.usage import quota_admission
from folioscope.session import run_folder
from folioscope.sources.collection import CollectionStore
from folioscope.streaming import jobs as J


def files(spark, path, frames):
    for i, df in enumerate(frames):
        df.coalesce(1).write.mode("append").parquet(f"{path}/in/part{i}")
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/part*")


def test_pages_of_a_document_may_come_in_parts(spark, tmp_path):
    schema = "document_id string, page_number long, text string"
    text = "Section 1: Results\n\nThe year was good for all shops, and the sales grew in every month of it. "
    first = spark.createDataFrame([("d", 1, text + "one."), ("e", 1, text + "five.")], schema)
    second = spark.createDataFrame([("d", 2, text + "two."), ("e", 1, "")], schema)
    store = CollectionStore(spark, f"{tmp_path}/store")
    stream = files(spark, tmp_path, [first, second])
    J.stream_ingest(stream, store, "company", f"{tmp_path}/check").awaitTermination()
    rows = store.read("company").collect()
    content = "\n".join(r.content for r in rows)
    assert {r.document_id for r in rows} == {"d"} and "one." in content and "two." in content
    assert all(r.dimension == 384 and len(r.vector) == 384 for r in rows)


def test_lanes_follow_time_over_all_batches(spark, tmp_path):
    schema = "attempt_id long, lane_id string, ts timestamp, success boolean, status_code int, error string"
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("attempt_id"))
    rows = [(i, "a", None, i % 5 == 0, 500, None) for i in range(14)]
    df = spark.createDataFrame(rows, schema).withColumn("ts", at)
    parts = [df.filter("attempt_id < 7").orderBy(F.desc("attempt_id")), df.filter("attempt_id >= 7").orderBy(F.rand(3))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        stream = files(spark, tmp_path, parts).withWatermark("ts", "1 minute")
        out = J.run_to_table(J.stream_lane_monitor(stream), f"{tmp_path}/out", f"{tmp_path}/check", mode="update").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    last = max((r for r in out if r.cause == "attempt"), key=lambda r: r.batch_no)
    assert (last.state, last.error_count) == ("DEGRADED", 3)


def test_a_batch_reads_and_replaces_only_its_buckets(spark, tmp_path):
    """Ten documents in three batches; a replayed batch changes nothing; folders of other documents stay as they are."""
    store = CollectionStore(spark, f"{tmp_path}/store", buckets=16)
    page = "document_id string, page_number long, text string"
    batches = [[(f"d{i}", 1, f"first {i}") for i in range(10)], [("d3", 2, "second 3"), ("d4", 1, "")], [("d3", 1, "new 3")]]

    def index(pages):
        return pages.filter("text <> ''").groupBy("document_id").agg(
            F.array_join(F.array_sort(F.collect_list(F.struct("page_number", "text"))).getField("text"), "|").alias("content")
        ).withColumn("chunk_id", F.col("document_id")).withColumn("vector", F.array(F.lit(1.0)))

    written = []
    for n, rows in enumerate(batches):
        stream = files(spark, f"{tmp_path}/{n}", [spark.createDataFrame(rows, page)])
        J.stream_ingest(stream, store, "company", f"{tmp_path}/check{n}", index).awaitTermination()
        written.append({p.parent.name: p.name for p in (tmp_path / "store/points/document_type=company").glob("bucket=*/*.parquet")})
        if n == 1:  # the same batch again
            before = sorted(tuple(r) for r in store.read("company").collect())
            J.stream_ingest(files(spark, f"{tmp_path}/again", [spark.createDataFrame(rows, page)]), store, "company",
                            f"{tmp_path}/check-again", index).awaitTermination()
            assert sorted(tuple(r) for r in store.read("company").collect()) == before
    content = {r.document_id: r.content for r in store.read("company").collect()}
    assert content == {**{f"d{i}": f"first {i}" for i in range(10) if i != 4}, "d3": "new 3|second 3"}
    mine = {f"bucket={b}" for b in store.touched(spark.createDataFrame([("d3",), ("d4",)], "document_id string"))}
    assert all(written[0][b] == written[2][b] for b in written[0] if b not in mine)
    own = store.touched(spark.createDataFrame([("d3",)], "document_id string"))
    plan = store.read("company", own)._jdf.queryExecution().executedPlan().toString()
    assert "isnotnull(bucket#" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_a_first_batch_writes_its_texts_four_times(spark, tmp_path):
    """As pages, page sections, pieces of chunks and points; of a page that comes twice the greater text stays."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(1500)) for _ in range(800)]
    rows = [(f"d{i}", 1, t) for i, t in enumerate(texts)] + [("d5", 1, ""), (None, 1, "nobody's page")]
    batch = spark.createDataFrame(rows, "document_id string, page_number long, text string")

    def size(*folders):
        return sum(f.stat().st_size for folder in folders for f in pathlib.Path(folder).rglob("*.parquet"))

    store, stream = CollectionStore(spark, f"{tmp_path}/store"), files(spark, tmp_path, [batch])
    before = size(run_folder(spark))
    J.stream_ingest(stream, store, "company", f"{tmp_path}/check").awaitTermination()
    written = size(run_folder(spark), f"{tmp_path}/store") - before
    rows = store.read("company").collect()
    assert {r.document_id: r.content for r in rows} == {f"d{i}": t for i, t in enumerate(texts)}
    assert all(len(r.vector) == 384 for r in rows)
    assert written < 5 * sum(map(len, texts))


ATTEMPTS = "attempt_id long, lane_id string, ts timestamp, success boolean, status_code int, error string"


def test_late_successes_give_what_the_whole_log_gives(spark, tmp_path):
    """Attempts of three batches in any order, as late as the watermark lets them be, against the batch operator."""
    rng = random.Random(9)
    rows = [(i, lane, None, (i, lane) in {(7, "a"), (22, "a"), (40, "b"), (3, "c"), (58, "c")} or lane == "d" and i % 4 == 0,
             429 if lane == "c" and i == 59 else 500, None) for i in range(60) for lane in "abcd"]
    whole = spark.createDataFrame(rows, ATTEMPTS).withColumn("ts", F.timestamp_seconds(1_700_000_000 + F.col("attempt_id")))
    deal = {(i, lane): rng.choice((0, 1, 2)) for i in range(60) for lane in "abcd"}
    deal |= {(7, "a"): 2, (22, "a"): 1, (40, "b"): 2, (58, "c"): 0}
    part = F.element_at(F.create_map(*[x for (i, lane), n in deal.items() for x in (F.lit(f"{i}{lane}"), F.lit(n))]),
                        F.concat(F.col("attempt_id").cast("string"), "lane_id"))
    parts = [whole.filter(part == n).orderBy(F.rand(n)) for n in range(3)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        stream = files(spark, tmp_path, parts).withWatermark("ts", "2 minutes")
        out = J.run_to_table(J.stream_lane_monitor(stream), f"{tmp_path}/out", f"{tmp_path}/check", mode="update").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    last = {}
    for r in sorted((r for r in out if r.cause == "attempt"), key=lambda r: r.batch_no):
        last[r.lane_id] = (r.state, r.error_count)
    runs = lane_failure_runs(whole).filter("attempt_id = 59").collect()
    assert last == {r.lane_id: (r.state_after, r.error_count) for r in runs} and len(last) == 4


def test_a_lane_opens_again_when_the_watermark_passes_its_cooldown(spark, tmp_path):
    at = F.timestamp_seconds(1_700_000_000 + F.col("attempt_id"))
    first = spark.createDataFrame([(i, "a", None, False, 500, None) for i in range(4)], ATTEMPTS).withColumn("ts", at)
    second = spark.createDataFrame([(500, "b", None, True, 200, None)], ATTEMPTS).withColumn("ts", at)
    third = spark.createDataFrame([(520, "a", None, False, 500, None), (2, "a", None, True, 200, None)], ATTEMPTS).withColumn("ts", at)
    stream = files(spark, tmp_path, [first, second, third]).withWatermark("ts", "1 minute")
    out = J.run_to_table(J.stream_lane_monitor(stream, 60), f"{tmp_path}/out", f"{tmp_path}/check", mode="update").collect()
    own = [(r.cause, r.state, r.error_count) for r in sorted(out, key=lambda r: r.batch_no) if r.lane_id == "a"]
    # the success of second 2 comes after the watermark has passed it and changes nothing
    assert own[:3] == [("attempt", "DEGRADED", 4), ("timer", "AVAILABLE", 4), ("attempt", "DEGRADED", 5)]
    opened = next(r["at"] for r in out if r.cause == "timer" and r.lane_id == "a")
    assert opened.timestamp() == 1_700_000_003 + 60


def test_quota_answers_every_request_over_several_batches(spark, tmp_path):
    schema = "request_id long, team_name string, ts timestamp, started_at timestamp, question_limit int, refunded boolean"
    rng = random.Random(4)
    rows = [(i, rng.choice(("hot", "hot", "hot", "x", "y", None)), None, None, 9 if i % 2 else 12, rng.random() < 0.2)
            for i in range(240)]
    start = F.timestamp_seconds(F.lit(1_700_000_000))
    whole = spark.createDataFrame(rows, schema).withColumn("started_at", F.when(F.col("team_name") != "y", start)).withColumn(
        "ts", F.timestamp_seconds(1_700_000_000 + 20 * F.floor(F.col("request_id") / 3)))
    parts = [whole.filter(F.floor(F.col("request_id") / 60) == n).orderBy(F.rand(n)) for n in range(4)]
    stream = J.stream_quota(files(spark, tmp_path, parts), duration=1200)
    out = J.run_to_table(stream, f"{tmp_path}/out", f"{tmp_path}/check", idle_batches=False).collect()
    expected = quota_admission(whole, 1200).collect()
    assert len({r.batch_no for r in out}) == 4 and {r.outcome for r in out} == {"ACCEPTED", "QUOTA", "EXPIRED"}
    assert {r.request_id: (r.team_name, r.used_before, r.outcome, r.status_code) for r in out} == {
        r.request_id: (r.team_name, r.used_before, r.outcome, r.status_code) for r in expected}
    assert len(out) == len(expected)


def test_attempts_before_a_success_of_their_batch_are_not_shuffled(spark):
    schema = "attempt_id long, lane_id string, ts timestamp, success boolean, limited boolean"
    rows = [(i, "a", None, i == 80, False) for i in range(100)]
    df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(F.col("attempt_id"))).coalesce(1)
    assert sorted(r.attempt_id for r in J._that_can_matter(df).collect()) == list(range(80, 100))
