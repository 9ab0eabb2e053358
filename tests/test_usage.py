import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folioscope.operators import catalog as C
from folioscope.operators import lanes as L
from folioscope.operators import logs as G
from folioscope.operators import usage as U
from folioscope.sources import collection as K
from folioscope.sources import tables as T

T0 = datetime(2024, 1, 1)


def requests(spark, marks):
    data = [(i, "t", T0 + timedelta(minutes=i), T0, 3, m == "R") for i, m in enumerate(marks)]
    return spark.createDataFrame(data, "request_id long, team_name string, ts timestamp, started_at timestamp, "
                                       "question_limit int, refunded boolean")


def test_quota_limit_refund_and_expiry(spark):
    def outcomes(df):
        return [r.outcome for r in U.quota_admission(df).orderBy("request_id").collect()]
    assert outcomes(requests(spark, "....")) == ["ACCEPTED"] * 3 + ["QUOTA"]
    assert outcomes(requests(spark, "RR....")) == ["ACCEPTED"] * 5 + ["QUOTA"]
    late = requests(spark, "..").withColumn("ts", F.col("ts") + F.expr("interval 2 hours"))
    assert outcomes(late) == ["EXPIRED", "EXPIRED"]


@pytest.mark.parametrize("block", [U.DAY_MICROS, 40_000_000, 7_000_000])
def test_repeats_equal_a_cache_for_any_block(spark, block):
    rng = random.Random(2)
    data = [(i, " Hot  Question" if rng.random() < 0.6 else f"q{rng.randint(0, 3)}", T0 + timedelta(seconds=rng.randint(0, 600)))
            for i in range(400)] + [(400, "  ", T0)]
    log = spark.createDataFrame(data, "id long, question string, ts timestamp")
    got = {r.id: r.is_hit for r in U.repeat_questions(log, 10, block).collect()}
    cached, want = {}, {}
    for i, q, ts in sorted(data[:-1], key=lambda d: (d[2], d[0])):
        key = " ".join(q.lower().split())
        want[i] = key in cached and (ts - cached[key]).total_seconds() <= 10
        if not want[i]:
            cached[key] = ts
    assert got == want


def test_lane_runs(spark):
    data = [(1, True, 200, None), (2, False, 500, "x"), (3, False, 500, "x"), (4, False, 500, "x"), (5, False, 429, "x"),
            (6, True, 200, None), (7, False, 500, "Rate Limit hit")]
    df = spark.createDataFrame([(i, "a", T0 + timedelta(hours=i), s, c, e) for i, s, c, e in data],
                               "attempt_id int, lane_id string, ts timestamp, success boolean, status_code int, error string")
    got = L.lane_failure_runs(df).orderBy("attempt_id").collect()
    assert [r.error_count for r in got] == [0, 1, 2, 3, 4, 0, 1]
    assert [r.state_after for r in got] == ["AVAILABLE"] * 3 + ["DEGRADED", "RATE_LIMITED", "AVAILABLE", "RATE_LIMITED"]
    assert got[3].cooldown_until == T0 + timedelta(hours=4, seconds=60) and got[2].cooldown_until is None


def test_percentiles_equal_sorted_positions(spark):
    rng = random.Random(4)
    values = {"a": [round(rng.random() * 50, 2) for _ in range(137)], "b": [5.0] * 40, "c": [1.25]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "level string, latency double")
    for r in G.latency_percentiles(df).collect():
        s = sorted(values[r.level])
        for name, p in G.PERCENTILES.items():
            assert r[name] == round(s[min(int(p * len(s)), len(s) - 1)], 3)


def test_logs_redaction_answers(spark):
    lines = spark.createDataFrame([("[HTTP_REQUEST_START] request_id=r1 timestamp=2024-01-01T00:00:00Z method=GET path=/a",),
                                   ("noise",), ("[HTTP_REQUEST_COMPLETE] request_id=r1 timestamp=x duration_ms=5.25 status=200",),
                                   ("[HTTP_REQUEST_START] request_id=r2 timestamp=x method=GET path=/b",)], "line string")
    parsed = G.parse_structured_logs(lines)
    assert parsed.count() == 3
    got = {r.request_id: (r.outcome, r.status, r.duration_ms) for r in G.http_request_log(parsed).collect()}
    assert got == {"r1": ("complete", "200", 5.25), "r2": ("in_flight", None, None)}
    redacted = G.redact_secrets(spark.createDataFrame([("key=abcdef and abc",), ("",)], "message string"), ["abcdef", "abc"])
    assert [r.message for r in redacted.collect()] == ["key=[REDACTED_API_KEY] and abc", "UnknownError"]
    body = '{"choices":[{"message":{"content":"<think>a\\nb</think> Hi "},"finish_reason":"length"}],"usage":{"total_tokens":9}}'
    r = G.clean_answers(spark.createDataFrame([(body,), ('{"choices":[]}',)], "body string")).collect()
    assert (r[0].answer, r[0].truncated, r[0].total_tokens) == ("Hi", True, 9) and r[1].error == "empty_choices"


def test_access_and_catalogue(spark, rows):
    files = spark.createDataFrame([("A.pdf", 1, 0, 0), ("a.PDF", 2, 3, 1), (".h.pdf", 1, 1, 2), ("My Instruction.pdf", 1, 1, 3),
                                   ("6 - revised.pdf", 5, 2, 4)], "filename string, size_bytes long, pages int, position int")
    internal = spark.createDataFrame([("secret.pdf",)], "filename string")
    catalog = C.document_catalog(files, internal)
    assert rows(catalog, "filename", "pages") == [("6 - revised.pdf", 2), ("A.pdf", 1)]
    asked = ["A.pdf", "6%20-%20revised.pdf", "..%2Fetc", "", "Secret.pdf", "blueprint.pdf", "none.pdf", "a/b.pdf"]
    got = C.access_audit(spark.createDataFrame([(i, a) for i, a in enumerate(asked)], "i int, document_id string"), catalog, internal)
    assert [r.status_code for r in got.orderBy("i").collect()] == [200, 200, 400, 400, 403, 403, 404, 400]


def test_collection_store_versions(spark, tmp_path):
    store = K.CollectionStore(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("a", "d1", [1.0]), ("b", "d2", [2.0])], "chunk_id string, document_id string, vector array<double>")
    with pytest.raises(ValueError):
        store.create(rows, "company", 0)
    assert store.create(rows, "company", 1) and not store.create(rows, "company", 1)
    store.upsert(rows, "company")
    store.upsert(spark.createDataFrame([("b", "d2", [3.0])], rows.schema), "company")
    assert sorted((r.chunk_id, r.vector[0]) for r in store.read("company").collect()) == [("a", 1.0), ("b", 3.0)]
    store.delete_documents(spark.createDataFrame([("d1",)], "document_id string"), "company")
    assert store.read("company").count() == 1
    status = {r.document_type: (r.points_count, r.status) for r in store.info().collect()}
    assert status == {"company": (1, "green"), "instruction": (0, "NOT_FOUND")}


def test_migration_is_idempotent(spark):
    target = spark.createDataFrame([("a", ["x"], T0)], "team_name string, members array<string>, started_at timestamp")
    source = spark.createDataFrame([("a", "[]", "bad"), ("b", '["y","z"]', "2024-01-01T00:00:00Z"), ("c", "[]", "nonsense")],
                                   "team_name string, members string, started_at string")
    moved = T.migrate_if_absent(source, target, "team_name")
    got = {r.team_name: r for r in moved.collect()}
    assert set(got) == {"b", "c"} and got["b"].members == ["y", "z"] and got["c"].started_at is None
    assert T.migrate_if_absent(source, target.unionByName(moved), "team_name").count() == 0
    assert T.add_sources_column(T.add_sources_column(target)).columns.count("sources") == 1
