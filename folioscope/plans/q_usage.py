"""Registered queries: usage, quota, lanes and log analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import vocab as V
from folioscope.functions.time import micros
from folioscope.operators import lanes as L
from folioscope.operators import logs as G
from folioscope.operators.redaction import redact_secret_table as redact_table
from folioscope.operators import usage as U
from folioscope.plans import duck as D, inputs as I

AS_OF = "2024-01-01 12:00:00"
LANES_AS_OF = "2024-01-15 00:00:00"
SESSION = 864_000          # ten days, so that sessions of the month-long log expire midway
SECRETS = ['{"k": 69}', '"k"', "error", " 12 "]


def at(text):
    return F.lit(text).cast("timestamp")


def stamp(name):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name)


def first_registration(spark, sf):
    pad = F.when(F.col("event_type") == "view", " ").otherwise("")
    requests = I.table(spark, sf, "events").select(
        F.col("event_id").alias("request_id"), F.concat(pad, I.team_of(), pad, pad).alias("team_name"),
        F.array("event_type", "props").alias("member_names"), F.col("ts").alias("started_at"))
    return U.first_registration(requests).select(
        "team_name", F.array_join("member_names", "|").alias("member_names"), stamp("started_at"), "request_id")


def session_timer(spark, sf):
    return U.session_timer(I.teams(spark, sf), at(AS_OF)).select("team_name", "remaining_seconds", "is_expired")


def quota_defaults(spark, sf):
    event = (F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", 2)
             .when(F.col("event_type") == "error", 3).when(F.col("event_type") == "signup", 7))
    keys = I.table(spark, sf, "events").select(I.team_of().alias("team_name"), event.alias("event_id")).distinct()
    limits = I.table(spark, sf, "region").select(
        F.col("r_regionkey").cast("int").alias("event_id"), (F.col("r_regionkey") * 5 + 5).cast("int").alias("question_limit"))
    return U.quota_defaults(keys, I.quotas(spark, sf), limits).withColumn(
        "event_id", F.coalesce("event_id", F.lit(U.NO_EVENT)))


def quota_admission(spark, sf):
    requests = (I.table(spark, sf, "events").select(
        F.col("event_id").alias("request_id"), I.team_of().alias("team_name"), "ts",
        (F.col("event_type") == "error").alias("refunded"))
        .join(I.teams(spark, sf).select("team_name", "started_at"), "team_name")
        .join(I.quotas(spark, sf).select("team_name", "question_limit"), "team_name"))
    return U.quota_admission(requests, duration=SESSION).select(
        "request_id", "team_name", "used_before", "outcome", "status_code")


def event_overview(spark, sf):
    return U.event_overview(I.teams(spark, sf), I.quotas(spark, sf), at(AS_OF))


def _board(spark, sf):
    return U.team_board(I.teams(spark, sf), I.quotas(spark, sf), I.prompts(spark, sf), at(AS_OF))


def _board_columns(df):
    return df.select("team_name", F.array_join("member_names", "|").alias("member_names"), stamp("started_at"),
                     stamp("last_activity_at"), "questions_used", "questions_remaining", "question_limit", "status")


def team_board(spark, sf):
    return _board_columns(_board(spark, sf))


def team_detail(spark, sf):
    return U.team_detail(_board(spark, sf), I.prompts(spark, sf)).select(
        "team_name", "status", "prompt_id", "prompt", stamp("created_at"))


def prompt_history(spark, sf):
    return U.prompt_history(I.prompts(spark, sf)).select("id", "team_name", "prompt", stamp("created_at"))


def team_search(spark, sf):
    return _board_columns(U.team_search(_board(spark, sf), "R-1", "ACTIVE"))


def recent_activity(spark, sf):
    return U.recent_activity(I.prompts(spark, sf)).select("id", "team_name", stamp("created_at"))


def _repeats(spark, sf):
    log = I.table(spark, sf, "events").select(
        F.col("event_id").alias("id"), "ts", F.concat(F.lit("  What about  "), F.upper("props")).alias("question"))
    return U.repeat_questions(log)


def repeat_questions(spark, sf):
    return _repeats(spark, sf).select("id", "is_hit")


def cache_hit_rate(spark, sf):
    return U.cache_hit_rate(_repeats(spark, sf))


def lane_effective_state(spark, sf):
    return L.lane_effective_state(I.lanes(spark, sf), at(LANES_AS_OF)).select("lane_id", "effective_state", "eligible")


def lane_ranking(spark, sf):
    return L.lane_ranking(I.lanes(spark, sf), at(LANES_AS_OF)).select("snapshot_id", "lane_id", "lane_rank")


def lane_pool_summary(spark, sf):
    return L.lane_pool_summary(I.lanes(spark, sf), at(LANES_AS_OF))


def lane_reconcile(spark, sf):
    lanes = I.lanes(spark, sf)
    limit = F.when(F.col("enabled"), 50).otherwise(60)
    configured = lanes.filter("model <> 'BUILDING'").withColumn("daily_limit", limit)
    return L.lane_reconcile(configured, lanes.filter("model <> 'MACHINERY'"))


def lane_failure_runs(spark, sf):
    runs = L.lane_failure_runs(I.attempts(spark, sf))
    return runs.select("attempt_id", "lane_id", "error_count", "state_after", stamp("cooldown_until"))


def provider_usage(spark, sf):
    values = I.table(spark, sf, "events").select(F.col("event_id").alias("attempt_id"), (F.col("value") > 50).alias("is_fallback"))
    return L.provider_usage(I.attempts(spark, sf).join(values, "attempt_id"))


def _parsed(spark, sf):
    return G.parse_structured_logs(I.log_lines(spark, sf))


def parse_structured_logs(spark, sf):
    return _parsed(spark, sf).select(
        "event_id", "event", "request_id", stamp("event_time"), F.coalesce("duration_ms", F.lit(-1.0)).alias("duration_ms"),
        F.col("fields")["path"].alias("path"), F.size("fields").alias("n_fields"))


def latency_summary(spark, sf):
    return G.latency_summary(G.parse_structured_logs(I.stage_lines(spark, sf)))


def stage_timing(spark, sf):
    timings = I.table(spark, sf, "events").select("event_id", (F.col("value") / 3000.0).alias("search"),
                                                  (F.col("value") / 7000.0).alias("rerank"))
    return G.stage_timing(timings, ["search", "rerank"])


def _latencies(spark, sf):
    return I.table(spark, sf, "events").select(F.col("event_type").alias("level"), F.col("value").alias("latency"))


def latency_percentiles(spark, sf):
    return G.latency_percentiles(_latencies(spark, sf))


def latency_percentiles_approx(spark, sf):
    return G.latency_percentiles_approx(_latencies(spark, sf))


def _results(spark, sf):
    failed = F.col("value") > 100
    return I.table(spark, sf, "events").select(
        F.col("event_type").alias("level"), F.when(~failed, 200).when(F.col("value") > 200, 0).otherwise(500).alias("status_code"),
        (~failed).alias("success"), (F.col("value") > 300).alias("is_timeout"))


def throughput_and_status(spark, sf):
    walls = I.table(spark, sf, "events").groupBy(F.col("event_type").alias("level")).agg(
        ((F.max(micros("ts")) - F.min(micros("ts"))) / 1e6).alias("wall_seconds"))
    return G.throughput_and_status(_results(spark, sf), walls)


def status_histogram(spark, sf):
    return G.status_histogram(_results(spark, sf))


def http_request_log(spark, sf):
    return G.http_request_log(_parsed(spark, sf)).withColumn("duration_ms", F.coalesce("duration_ms", F.lit(-1.0)))


def redact_secrets(spark, sf):
    rows = I.table(spark, sf, "events").select("event_id", F.when(F.col("value") < 1, "").otherwise(
        F.concat_ws(" ", "event_type", "props")).alias("message"))
    return G.redact_secrets(rows, SECRETS)


def redact_secret_table(spark, sf):
    """Customer names as secrets, some with their segment behind, in a message for every order."""
    key, named = F.col("c_custkey"), F.concat("c_name", F.lit("-"), "c_mktsegment")
    customers = I.table(spark, sf, "customer")
    secrets = customers.filter(key % 3 != 0).select(F.col("c_name").alias("secret")).unionByName(
        customers.filter(key % 5 == 0).select(named.alias("secret")))
    orders = I.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    rows = orders.join(customers, "c_custkey").select(
        "o_orderkey", F.concat(F.lit("call of "), named, F.lit(" from "), "c_name").alias("message"))
    return redact_table(rows, secrets)


def clean_answers(spark, sf):
    turns = I.table(spark, sf, "conversations")
    content = F.when(F.col("role") == "system", " \n ").otherwise(
        F.concat(F.lit("<think>plan\n"), F.col("role"), F.lit("</think>  "), F.col("text"), F.lit("\n")))
    choice = F.struct(F.struct(content.alias("content")).alias("message"), F.when(F.col("turn") > 2, "length").otherwise(
        "stop").alias("finish_reason"))
    choices = F.when(F.col("role") == "user", F.array().cast(
        "array<struct<message:struct<content:string>,finish_reason:string>>")).otherwise(F.array(choice))
    usage = F.struct(F.col("turn").alias("prompt_tokens"), F.length("text").alias("completion_tokens"),
                     (F.col("turn") + F.length("text")).alias("total_tokens"))
    bodies = turns.select("conv_id", "turn", F.to_json(F.struct(choices.alias("choices"), usage.alias("usage"))).alias("body"))
    return G.clean_answers(bodies).select("conv_id", "turn", F.md5("answer").alias("answer_md5"), "error", "finish_reason",
                                          "truncated", "prompt_tokens", "completion_tokens", "reasoning_tokens", "total_tokens")


QUERIES = {name: globals()[name] for name in (
    "first_registration session_timer quota_defaults quota_admission event_overview team_board team_detail "
    "prompt_history team_search recent_activity repeat_questions cache_hit_rate lane_effective_state lane_ranking "
    "lane_pool_summary lane_reconcile lane_failure_runs provider_usage parse_structured_logs latency_summary "
    "stage_timing latency_percentiles latency_percentiles_approx throughput_and_status status_histogram "
    "http_request_log redact_secrets redact_secret_table clean_answers").split()}

# ---- SQL -----------------------------------------------------------------------------------
def ts(x, name=None):
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f') AS {name or x}"


TEAMS = """teams AS (SELECT 'team-' || user_id AS team_name, 'member-' || user_id AS member_names, min(ts) AS started_at
  FROM events GROUP BY user_id)"""
QUOTAS = """quotas AS (SELECT 'team-' || user_id AS team_name, CAST(count(*) FILTER (event_type = 'purchase') AS INTEGER)
  AS questions_used, CAST(count(*) FILTER (event_type = 'signup') + 5 AS INTEGER) AS question_limit FROM events GROUP BY user_id)"""
PROMPTS = """prompts AS (SELECT event_id AS id, 'team-' || user_id AS team_name, props AS prompt, ts AS created_at
  FROM events WHERE event_type IN ('view', 'click'))"""
LEFT = ("CAST(greatest(0, {d} - trunc((epoch_us({a}) - epoch_us({s})) / 1000000.0::DOUBLE)) AS BIGINT)")


def left(a, s, d=7200):
    return LEFT.format(a=a, s=s, d=d)


NOW = f"TIMESTAMP '{AS_OF}'"
BOARD = f"""board AS (SELECT t.team_name, t.member_names, t.started_at, coalesce(p.last, t.started_at) AS last_activity_at,
  q.questions_used, greatest(0, q.question_limit - q.questions_used) AS questions_remaining, q.question_limit,
  CASE WHEN q.question_limit <= q.questions_used THEN 'COMPLETED' WHEN {left(NOW, 't.started_at')} <= 0 THEN 'TIME_EXPIRED'
    ELSE 'ACTIVE' END AS status
  FROM teams t JOIN quotas q USING (team_name) LEFT JOIN (SELECT team_name, max(created_at) AS last FROM prompts GROUP BY 1) p
    USING (team_name))"""
BOARD_COLUMNS = f"""team_name, member_names, {ts('started_at')}, {ts('last_activity_at')}, questions_used, questions_remaining,
question_limit, status"""
REPEATS = D.with_("asks AS (SELECT event_id AS id, props AS k, epoch_us(ts) AS us FROM events)",
                  """misses(k, us) AS (SELECT k, min(us) FROM asks GROUP BY 1 UNION ALL
  SELECT m.k, min(a.us) FROM misses m JOIN asks a ON a.k = m.k AND a.us > m.us + 1800000000 GROUP BY m.k)""",
                  "firsts AS (SELECT min(a.id) AS id FROM misses m JOIN asks a ON a.k = m.k AND a.us = m.us GROUP BY m.k, m.us)",
                  "repeats AS (SELECT id, id NOT IN (SELECT id FROM firsts) AS is_hit FROM asks)")
LANES = """raw_lanes AS (SELECT *, CAST(abs(round_even(c_acctbal * 100, 0)) AS BIGINT) AS cents FROM customer),
lanes AS (SELECT c_nationkey AS snapshot_id, c_name AS lane_id,
  CASE WHEN c_mktsegment < 'C' THEN 'primary' ELSE 'fallback' END AS provider, c_mktsegment AS model,
  c_acctbal > 0 AS enabled, CASE WHEN c_mktsegment < 'C' THEN 1 ELSE 2 END AS priority, 50 AS daily_limit,
  CAST((cents // 100) % 60 AS INTEGER) AS requests_used, CAST(cents % 3 AS INTEGER) AS active_requests,
  ['AVAILABLE', 'BUSY', 'RATE_LIMITED', 'DEGRADED', 'DISABLED'][(cents // 7) % 5 + 1] AS state,
  CASE WHEN cents % 4 > 0 THEN TIMESTAMP '2024-01-15 00:00:00' + to_seconds(cents % 1000 - 500) END AS cooldown_until,
  CAST((cents // 11) % 4 AS INTEGER) AS error_count FROM raw_lanes)"""
LNOW = f"TIMESTAMP '{LANES_AS_OF}'"
EFFECTIVE = f"""effective AS (SELECT *,
  CASE WHEN NOT enabled OR state = 'DISABLED' OR (cooldown_until IS NOT NULL AND {LNOW} < cooldown_until) THEN state
    WHEN requests_used >= daily_limit THEN 'DAILY_EXHAUSTED' WHEN active_requests >= 2 THEN 'BUSY'
    WHEN cooldown_until IS NOT NULL THEN 'AVAILABLE' ELSE state END AS effective_state,
  enabled AND state <> 'DISABLED' AND (cooldown_until IS NULL OR {LNOW} >= cooldown_until) AND requests_used < daily_limit
    AND active_requests < 2 AND (cooldown_until IS NOT NULL OR state IN ('AVAILABLE', 'BUSY')) AS eligible FROM lanes)"""
NAMES = {"view": "HTTP_REQUEST_START", "click": "HTTP_REQUEST_COMPLETE", "error": "HTTP_REQUEST_FAILED",
         "purchase": "EMBEDDING_COMPLETE", "signup": "DB_TEAM_LOOKUP_COMPLETE"}
LOG = f"""log AS (SELECT event_id, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in NAMES.items())} END AS event,
  'req_' || (event_id // 3) AS request_id, date_trunc('second', ts) AS event_time,
  CASE WHEN event_type <> 'view' THEN value END AS duration_ms, '/users/' || user_id AS path, event_type FROM events)"""


def stage(i):
    return f"coalesce(max(CAST(CAST(value AS DECIMAL(12, 2)) AS DOUBLE)) FILTER (event_id % 7 = {i}), 0.0::DOUBLE)"


def pct(p):
    return f"list_sort(list(value))[CAST(least(floor({p}::DOUBLE * count(*)), count(*) - 1) AS BIGINT) + 1]"


ORACLES = {
    "first_registration": f"""SELECT team_name, members AS member_names, {ts('started_at')}, request_id FROM (
SELECT 'team-' || user_id AS team_name, event_type || '|' || props AS members, ts AS started_at, event_id AS request_id,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1""",
    "session_timer": D.with_(TEAMS) + f"""SELECT team_name, {left(NOW, 'started_at')} AS remaining_seconds,
{left(NOW, 'started_at')} <= 0 AS is_expired FROM teams""",
    "quota_defaults": D.with_(QUOTAS, """keys AS (SELECT DISTINCT 'team-' || user_id AS team_name, CASE event_type WHEN 'click'
  THEN 1 WHEN 'purchase' THEN 2 WHEN 'error' THEN 3 WHEN 'signup' THEN 7 ELSE -1 END AS event_id FROM events)""")
    + """SELECT k.team_name, k.event_id, CASE WHEN k.event_id = -1 THEN questions_used ELSE 0 END AS questions_used,
CASE WHEN k.event_id = -1 THEN question_limit WHEN r.r_regionkey IS NOT NULL THEN CAST(r_regionkey * 5 + 5 AS INTEGER)
  ELSE 10 END AS question_limit
FROM keys k JOIN quotas USING (team_name) LEFT JOIN region r ON r.r_regionkey = k.event_id""",
    "quota_admission": D.with_(TEAMS, QUOTAS, f"""reqs AS (SELECT event_id AS request_id, 'team-' || e.user_id AS team_name, ts,
  {left('ts', 't.started_at', SESSION)} <= 0 AS expired, event_type = 'error' AS refunded, question_limit
  FROM events e JOIN teams t ON t.team_name = 'team-' || e.user_id JOIN quotas q ON q.team_name = t.team_name),
used AS (SELECT *, CAST(coalesce(sum(CASE WHEN NOT expired AND NOT refunded THEN 1 ELSE 0 END) OVER (PARTITION BY team_name
  ORDER BY ts, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS used_before FROM reqs)""")
    + """SELECT request_id, team_name, used_before, CASE WHEN expired THEN 'EXPIRED' WHEN used_before >= question_limit
THEN 'QUOTA' ELSE 'ACCEPTED' END AS outcome, CASE WHEN expired THEN 403 WHEN used_before >= question_limit THEN 429
ELSE 200 END AS status_code FROM used""",
    "event_overview": D.with_(TEAMS, QUOTAS) + f"""SELECT count(*) AS registered_teams,
count(*) FILTER ({left(NOW, 'started_at')} > 0) AS active_teams, CAST(sum(questions_used) AS BIGINT) AS total_questions_used,
CAST(sum(greatest(0, question_limit - questions_used)) AS BIGINT) AS total_questions_remaining
FROM teams JOIN quotas USING (team_name)""",
    "team_board": D.with_(TEAMS, QUOTAS, PROMPTS, BOARD) + f"SELECT {BOARD_COLUMNS} FROM board",
    "team_detail": D.with_(TEAMS, QUOTAS, PROMPTS, BOARD) + f"""SELECT b.team_name, status, id AS prompt_id, prompt,
{ts('created_at')} FROM board b LEFT JOIN prompts p USING (team_name)""",
    "prompt_history": D.with_(PROMPTS) + f"SELECT id, team_name, prompt, {ts('created_at')} FROM prompts",
    "team_search": D.with_(TEAMS, QUOTAS, PROMPTS, BOARD) + f"""SELECT {BOARD_COLUMNS} FROM board
WHERE (contains(team_name, 'r-1') OR contains(member_names, 'r-1')) AND status = 'ACTIVE'""",
    "recent_activity": D.with_(PROMPTS) + f"""SELECT id, team_name, {ts('created_at')} FROM (
SELECT * FROM prompts ORDER BY created_at DESC, id DESC LIMIT 5)""",
    "repeat_questions": REPEATS + "SELECT id, is_hit FROM repeats",
    "cache_hit_rate": REPEATS + f"""SELECT count(*) FILTER (is_hit) AS hits, count(*) FILTER (NOT is_hit) AS misses,
{D.half_even('CAST(count(*) FILTER (is_hit) AS DOUBLE) / count(*)', 4)} AS hit_rate FROM repeats""",
    "lane_effective_state": D.with_(LANES, EFFECTIVE) + "SELECT lane_id, effective_state, eligible FROM effective",
    "lane_ranking": D.with_(LANES, EFFECTIVE) + """SELECT snapshot_id, lane_id, row_number() OVER (PARTITION BY snapshot_id
ORDER BY priority, active_requests, requests_used, lane_id) AS lane_rank FROM effective WHERE eligible""",
    "lane_pool_summary": D.with_(LANES, f"""states AS (SELECT *, CASE WHEN cooldown_until IS NOT NULL AND {LNOW} >= cooldown_until
  AND requests_used < daily_limit THEN 'AVAILABLE' ELSE state END AS s FROM lanes)""") + """SELECT provider,
count(*) AS total_lanes, count(*) FILTER (s = 'AVAILABLE') AS available_lanes, count(*) FILTER (s = 'BUSY') AS busy_lanes,
count(*) FILTER (s = 'DAILY_EXHAUSTED') AS exhausted_lanes, count(*) FILTER (s = 'RATE_LIMITED') AS rate_limited_lanes,
count(*) FILTER (s = 'DEGRADED') AS degraded_lanes, count(*) FILTER (s = 'DISABLED') AS disabled_lanes,
CAST(sum(daily_limit) AS BIGINT) AS total_limit, CAST(sum(requests_used) AS BIGINT) AS total_requests_used,
CAST(sum(active_requests) AS BIGINT) AS total_active_requests,
CAST(sum(greatest(0, daily_limit - requests_used)) AS BIGINT) AS total_remaining FROM states GROUP BY 1""",
    "lane_reconcile": D.with_(LANES) + """SELECT lane_id, provider, model, CASE WHEN model = 'BUILDING' THEN false ELSE enabled END
AS enabled, CASE WHEN model = 'BUILDING' OR enabled THEN 50 ELSE 60 END AS daily_limit,
CASE WHEN model = 'MACHINERY' THEN 0 ELSE requests_used END AS requests_used,
CASE WHEN model = 'MACHINERY' THEN 0 ELSE error_count END AS error_count,
CASE WHEN model = 'MACHINERY' THEN 'insert' WHEN model = 'BUILDING' AND enabled THEN 'disable' WHEN model = 'BUILDING' THEN 'keep'
  WHEN NOT enabled THEN 'update' ELSE 'keep' END AS action FROM lanes""",
    "lane_failure_runs": f"""WITH a AS (SELECT event_id AS attempt_id, user_id AS lane_id, ts, event_type <> 'error' AS ok,
  event_type = 'error' AND (value > 100 OR value < 1) AS limited, CAST(floor(value) AS BIGINT) % 60 >= 50 AS spent,
  event_id % 3 >= 2 AS busy FROM events),
b AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY lane_id ORDER BY ts, attempt_id) AS run FROM a),
c AS (SELECT *, CASE WHEN ok THEN 0 ELSE CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY lane_id, run
  ORDER BY ts, attempt_id) AS BIGINT) END AS error_count FROM b),
d AS (SELECT *, CASE WHEN limited THEN 'RATE_LIMITED' WHEN NOT ok AND error_count >= 3 THEN 'DEGRADED'
  WHEN spent THEN 'DAILY_EXHAUSTED' WHEN ok AND busy THEN 'BUSY' ELSE 'AVAILABLE' END AS state_after FROM c)
SELECT attempt_id, lane_id, error_count, state_after, {ts(
    "CASE WHEN state_after IN ('RATE_LIMITED', 'DEGRADED') THEN ts + to_seconds(60) END", 'cooldown_until')} FROM d""",
    "provider_usage": """SELECT count(*) AS total_requests, count(*) FILTER (value <= 50) AS primary_requests,
count(*) FILTER (value > 50) AS fallback_requests, count(*) FILTER (event_type <> 'error') AS success_count,
count(*) FILTER (event_type = 'error') AS failure_count FROM events""",
    "parse_structured_logs": D.with_(LOG) + f"""SELECT event_id, event, request_id, {ts('event_time')},
coalesce(duration_ms, -1.0) AS duration_ms, path, CASE event_type WHEN 'view' THEN 4 WHEN 'click' THEN 6 ELSE 5 END AS n_fields
FROM log""",
    "latency_summary": f"""SELECT 'req_' || (event_id // 7) AS request_id, {stage(2)} AS embedding_ms,
{stage(3)} AS search_ms, {stage(4)} AS first_token_ms, {stage(5)} AS generation_ms, {stage(6)} AS total_ms,
{D.half_even(stage(0) + ' + ' + stage(1), 2)} AS database_ms FROM events GROUP BY event_id // 7""",
    "stage_timing": f"""SELECT event_id, {D.half_even('value / 3000.0::DOUBLE', 4)} AS search,
{D.half_even('value / 7000.0::DOUBLE', 4)} AS rerank,
{D.half_even('0.0::DOUBLE + value / 3000.0::DOUBLE + value / 7000.0::DOUBLE', 4)} AS total FROM events""",
    "latency_percentiles": f"""SELECT event_type AS level, count(*) AS requests, {D.half_even('min(value)', 3)} AS min_latency,
{D.half_even('CAST(sum(CAST(value AS DECIMAL(18, 6))) AS DOUBLE) / count(*)', 3)} AS avg_latency,
{D.half_even(pct(0.5), 3)} AS p50, {D.half_even(pct(0.95), 3)} AS p95, {D.half_even(pct(0.99), 3)} AS p99,
{D.half_even('max(value)', 3)} AS max_latency FROM events GROUP BY 1""",
    "throughput_and_status": f"""SELECT event_type AS level, count(*) AS total_requests,
count(*) FILTER (value <= 100) AS successful_requests, count(*) FILTER (value > 100) AS failed_requests,
count(*) FILTER (value > 300) AS timeout_count, {D.half_even(
    "CAST(count(*) FILTER (value <= 100) AS DOUBLE) / ((max(epoch_us(ts)) - min(epoch_us(ts))) / 1000000.0::DOUBLE)", 3)}
AS throughput FROM events GROUP BY 1""",
    "status_histogram": """SELECT event_type AS level, CASE WHEN value <= 100 THEN '200' WHEN value > 300 THEN 'TIMEOUT'
WHEN value > 200 THEN 'ERROR' ELSE '500' END AS status, count(*) AS requests FROM events GROUP BY 1, 2""",
    "http_request_log": D.with_(LOG) + """SELECT request_id, max('GET') AS method, max(path) FILTER (event_type = 'view') AS path,
max(CASE WHEN event_type = 'click' THEN '200' END) AS status,
coalesce(max(duration_ms) FILTER (event_type IN ('click', 'error')), -1.0) AS duration_ms,
CASE WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'failed' WHEN count(*) FILTER (event_type = 'click') > 0
  THEN 'complete' ELSE 'in_flight' END AS outcome FROM log WHERE event_type IN ('view', 'click', 'error') GROUP BY 1
HAVING count(*) FILTER (event_type = 'view') > 0""",
    "redact_secrets": f"""SELECT event_id, CASE WHEN value < 1 THEN 'UnknownError' ELSE
replace(replace(event_type || ' ' || props, {D.q(SECRETS[0])}, '{V.REDACTED}'), 'error', '{V.REDACTED}') END AS message
FROM events""",
    "redact_secret_table": f"""SELECT o_orderkey, 'call of ' || CASE WHEN c_custkey % 5 = 0 THEN '{V.REDACTED}'
  WHEN c_custkey % 3 <> 0 THEN '{V.REDACTED}-' || c_mktsegment ELSE c_name || '-' || c_mktsegment END || ' from '
  || CASE WHEN c_custkey % 3 <> 0 THEN '{V.REDACTED}' ELSE c_name END AS message
FROM orders JOIN customer ON c_custkey = o_custkey""",
    "clean_answers": f"""SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN md5({D.strip('text')}) END AS answer_md5,
CASE role WHEN 'user' THEN 'empty_choices' WHEN 'system' THEN 'empty_text' END AS error,
CASE WHEN role <> 'user' THEN CASE WHEN turn > 2 THEN 'length' ELSE 'stop' END END AS finish_reason,
role <> 'user' AND turn > 2 AS truncated, turn AS prompt_tokens, length(text) AS completion_tokens, 0 AS reasoning_tokens,
turn + length(text) AS total_tokens FROM conversations""",
}
