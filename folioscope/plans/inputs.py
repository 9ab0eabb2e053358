"""Operator inputs derived from the given tables (all rows, no samples)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.scans import row_numbers, width_block
from folioscope.session import materialize

ID_BLOCK = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A text-heavy table.

    Its splits are its tasks; a table of fewer splits than the cluster has cores is spread by its first column, as
    encoders and patterns cost more than the shuffle of a small table.
    """
    rows = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= 2 * cores else rows.repartition(2 * cores, rows.columns[0])


def corpus_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages: one document per source, one page per row."""
    docs = text_table(spark, sf_dir, "documents").select(
        F.col("source").alias("document_id"), "doc_id", "text")
    return row_numbers(docs, ["document_id"], ["doc_id"], width_block(F.col("doc_id"), ID_BLOCK),
                       "page_number").drop("doc_id")


def rendered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report pages rendered from orders: one document per customer, one page per order."""
    orders = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("customer-"), F.col("o_custkey").cast("string")).alias("document_id"),
        "o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice",
        F.to_date("o_orderdate").cast("string").alias("day"))
    numbered = row_numbers(orders, ["document_id"], ["o_orderkey"],
                           width_block(F.col("o_orderkey"), ID_BLOCK), "page_number")
    key, page = F.col("o_orderkey").cast("string"), F.col("page_number").cast("string")
    heading = (F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("## Order File "), key))
               .when(F.col("o_orderstatus") == "O", F.concat(
                   F.lit("Section "), page, F.lit(".1: "), F.col("o_orderpriority")))
               .otherwise(F.concat(F.lit("Overview of order "), key)))
    banner = (F.when(F.col("o_orderpriority") == "5-LOW", "LOW PRIORITY NOTICE")
              .when(F.col("o_orderpriority") == "2-HIGH", "High Priority Order")
              .otherwise("the order follows the usual route."))
    note = F.concat(F.lit("Shipment note "), key, F.lit(" is on file for this order.\n"))
    notes = F.repeat(note, F.floor(F.col("o_totalprice") / 6000.0).cast("int"))
    lines = F.concat_ws(
        "\n", heading, F.lit(""), banner, F.lit(""),
        F.concat(F.lit("The order "), key, F.lit(" was placed on "), F.col("day"), F.lit(".")),
        F.lit(""), F.concat(notes, F.lit("end of notes for this order.")), F.lit(""),
        F.concat(F.lit("key | "), key), F.concat(F.lit("revenue | "), F.col("page_number") * 100),
        F.lit(""), F.concat(F.lit("- status "), F.col("o_orderstatus")),
        F.concat(F.lit("- priority "), F.col("o_orderpriority")))
    return numbered.select("document_id", "page_number", lines.alias("text"))


def with_banners(pages: DataFrame) -> DataFrame:
    """Pages with a first and a last line that name the document, on nine of ten pages."""
    framed = F.concat(F.lit("Records of "), "document_id", F.lit("\n"), "text", F.lit("\nNotice to readers of "), "document_id")
    return pages.withColumn("text", F.when(F.col("page_number") % 10 != 0, framed).otherwise(F.col("text")))


# Question texts, chosen by a customer's nation.
QUESTION_TEXTS = [
    "Who are the current owners of the company and what are its marketing strategies?",
    "Tell me about ownership, marketing strategy and major products.",
    "What was revenue and profit in 2025?",
    "Who are the directors and what are their responsibilities?",
    "What was revenue last year?",
    "How has net profit changed across all available financial years?",
    "  What   are the company's  marketing strategies? ",
    "What is the latest quarter EBITDA?",
    "Which vendor has the best quality score and on-time delivery?",
    "Why did the gross margin fall despite growth in sales volume?",
    "List the inventory days, receivable days and payable days.",
    "What is the name of the company? Who owns it?",
    "One? Two? Three? Four?",
    "Give a strategic assessment of the risks.",
    "Compare customer retention and churn rate this year.",
    "What were monthly sales last month?",
    "",
    "How do ESG emissions and carbon compare year over year?",
    "Show the supplier sla, lead time and procurement expense.",
    "What marketing campaign had the best ROAS by channel?",
    "Tell me the market share, and explain the growth strategy of the board of directors.",
    "Is the balance sheet strong",
    "What about working capital and the cash conversion cycle in Q4?",
    "List the products, who sells them?",
    "Describe the history of the office building in plain words for a new colleague",
]


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns of the conversations and one question per customer.

    They are written once, spread over the cores: rules over a question cost more than its write, and a repartition alone
    would leave them to the tasks that read the tables, as filters move ahead of it.
    """
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'").select(
        F.concat(F.lit("turn-"), F.col("conv_id").cast("string"), F.lit("-"),
                 F.col("turn").cast("string")).alias("query_id"), "text")
    texts = F.array(*[F.lit(t) for t in QUESTION_TEXTS])
    customers = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("customer-"), F.col("c_custkey").cast("string")).alias("query_id"),
        F.element_at(texts, (F.col("c_nationkey") + 1).cast("int")).alias("text"))
    rows = turns.unionByName(customers)
    parts = max(2 * spark.sparkContext.defaultParallelism, rows.rdd.getNumPartitions())
    return materialize(rows.repartition(parts, "query_id"), "questions")


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: German ones are internal guidance, the others company evidence."""
    docs = text_table(spark, sf_dir, "documents")
    kind = F.when(F.col("lang") == "de", "instruction").otherwise("company")
    return docs.select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"),
        F.col("source").alias("document_name"), F.array(F.col("doc_id").cast("int")).alias("page_numbers"),
        F.element_at(F.split("text", "\n"), 1).alias("section_title"),
        F.when(F.length("text") < 400, "heading").otherwise("paragraph").alias("section_type"),
        F.when(F.col("lang") == "en", 2).otherwise(4).alias("hierarchy_level"),
        F.col("doc_id").alias("chunk_order"), F.col("text").alias("content"),
        F.greatest(F.lit(1), F.rint(F.length("text") / 4.0).cast("int")).alias("estimated_tokens"),
        kind.alias("document_type"),
        F.when(kind == "company", "user_visible").otherwise("internal").alias("visibility"))


def vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as a vector table; label 0 is internal guidance."""
    kind = F.when(F.col("label") == 0, "instruction").otherwise("company")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"),
        F.concat(F.lit("label-"), F.col("label").cast("string")).alias("document_name"),
        kind.alias("document_type"),
        F.when(kind == "company", "user_visible").otherwise("internal").alias("visibility"))


def label_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query vector per label: the mean of its embeddings, rounded to 6 digits.

    The mean is taken per dimension with map-side combine.
    """
    flat = table(spark, sf_dir, "embeddings").select(
        "label", F.posexplode("embedding").alias("pos", "x"))
    mean = F.rint(F.avg(F.col("x").cast("decimal(20,12)")).cast("double") * 1e6) / 1e6
    means = flat.groupBy("label", "pos").agg(mean.alias("x"))
    return means.groupBy("label").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("vector")
    ).select(F.col("label").alias("query_id"), "vector")


def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as teams, started at their first event."""
    return (table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("started_at"))
            .select(F.concat(F.lit("team-"), F.col("user_id").cast("string")).alias("team_name"),
                    F.array(F.concat(F.lit("member-"), F.col("user_id").cast("string"))).alias("member_names"),
                    "started_at"))


def team_of(column: str = "user_id"):
    return F.concat(F.lit("team-"), F.col(column).cast("string"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and clicks as prompts."""
    return table(spark, sf_dir, "events").filter(F.col("event_type").isin("view", "click")).select(
        F.col("event_id").alias("id"), team_of().alias("team_name"), F.col("props").alias("prompt"),
        F.col("ts").alias("created_at"))


def quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Used questions per team: purchases, with the limit given by signups plus five."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "purchase").cast("int").alias("questions_used"),
        (F.count_if(F.col("event_type") == "signup") + 5).cast("int").alias("question_limit")
    ).select(team_of().alias("team_name"), F.lit(None).cast("int").alias("event_id"),
             "questions_used", "question_limit")


def lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as lane snapshots: one snapshot per nation."""
    states = F.array(*[F.lit(s) for s in ["AVAILABLE", "BUSY", "RATE_LIMITED", "DEGRADED", "DISABLED"]])
    cents = F.abs(F.rint(F.col("c_acctbal") * 100)).cast("long")
    primary = F.col("c_mktsegment") < "C"
    start = F.lit("2024-01-15 00:00:00").cast("timestamp")
    return table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("snapshot_id"), F.col("c_name").alias("lane_id"),
        F.when(primary, "primary").otherwise("fallback").alias("provider"),
        F.col("c_mktsegment").alias("model"), (F.col("c_acctbal") > 0).alias("enabled"),
        F.when(primary, 1).otherwise(2).alias("priority"), F.lit(50).alias("daily_limit"),
        F.lit(2).alias("max_concurrent_requests"),
        F.pmod(F.floor(cents / 100), F.lit(60)).cast("int").alias("requests_used"),
        F.pmod(cents, F.lit(3)).cast("int").alias("active_requests"),
        F.element_at(states, (F.pmod(F.floor(cents / 7), F.lit(5)) + 1).cast("int")).alias("state"),
        F.when(F.pmod(cents, F.lit(4)) > 0, F.timestamp_micros(
            F.unix_micros(start) + (F.pmod(cents, F.lit(1000)) - 500) * 1_000_000)).alias("cooldown_until"),
        F.pmod(F.floor(cents / 11), F.lit(4)).cast("int").alias("error_count"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lane attempts: the lane is the user, error events fail, high values are 429."""
    failed = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("attempt_id"), F.col("user_id").alias("lane_id"), "ts",
        (~failed).alias("success"),
        F.when(~failed, 200).when(F.col("value") > 100, 429).otherwise(500).alias("status_code"),
        F.when(failed & (F.col("value") < 1), "Rate limit reached").alias("error"),
        F.pmod(F.floor("value").cast("long"), F.lit(60)).alias("requests_used"), F.lit(50).alias("daily_limit"),
        F.pmod("event_id", F.lit(3)).alias("active_requests"), F.lit(2).alias("max_concurrent_requests"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as structured log lines; three consecutive events form one request."""
    names = {"view": "HTTP_REQUEST_START", "click": "HTTP_REQUEST_COMPLETE", "error": "HTTP_REQUEST_FAILED",
             "purchase": "EMBEDDING_COMPLETE", "signup": "DB_TEAM_LOOKUP_COMPLETE"}
    mapping = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    request = F.concat(F.lit("req_"), F.floor(F.col("event_id") / 3).cast("string"))
    line = F.concat(
        F.lit("["), mapping[F.col("event_type")], F.lit("] request_id="), request,
        F.lit(" timestamp="), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"),
        F.when(F.col("event_type") == "view", "").otherwise(
            F.concat(F.lit(" duration_ms="), F.col("value").cast("decimal(12,2)").cast("string"))),
        F.lit(" method=GET path=/users/"), F.col("user_id").cast("string"),
        F.when(F.col("event_type") == "click", " status=200").otherwise(""))
    return table(spark, sf_dir, "events").select("event_id", line.alias("line"))


STAGES = [("DB_TEAM_LOOKUP_COMPLETE", "duration_ms"), ("DB_QUOTA_RESERVATION_COMPLETE", "duration_ms"),
          ("EMBEDDING_COMPLETE", "duration_ms"), ("QDRANT_RETRIEVAL_COMPLETE", "duration_ms"),
          ("LLM_FIRST_TOKEN", "ttft_ms"), ("LLM_GENERATION_COMPLETE", "duration_ms"), ("RAG_LATENCY_SUMMARY", "total_ms")]


def stage_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as stage lines: seven consecutive events are the seven stages of one request."""
    pick = (F.pmod("event_id", F.lit(len(STAGES))) + 1).cast("int")
    event, field = (F.element_at(F.array(*[F.lit(s[i]) for s in STAGES]), pick) for i in (0, 1))
    return table(spark, sf_dir, "events").select(F.concat(
        F.lit("["), event, F.lit("] request_id=req_"), F.floor(F.col("event_id") / len(STAGES)).cast("string"),
        F.lit(" timestamp="), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z "), field, F.lit("="),
        F.col("value").cast("decimal(12,2)").cast("string")).alias("line"))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as files: the name is made from the url's last part and the host."""
    name = F.concat(
        F.when(F.contains("url", F.lit("page=2")), ".").otherwise(""),
        F.regexp_extract("url", r"^https?://([^/]+)", 1), F.lit("_annual-report"),
        F.when(F.contains("url", F.lit("/de/")), " Instruction").otherwise(""),
        F.when(F.contains("url", F.lit("https")), ".pdf").when(F.contains("url", F.lit("#top")), "")
        .otherwise(".Txt"))
    upper = F.when(F.contains("url", F.lit("?")), F.upper(name)).otherwise(name)
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("position"), upper.alias("filename"),
        F.length("html").cast("long").alias("size_bytes"),
        F.floor(F.length("html") / 4000).cast("int").alias("pages"))


def internal_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restricted file names: those whose page mentions 'ref=x' in the url."""
    files = document_files(spark, sf_dir)
    urls = table(spark, sf_dir, "pages").select(F.col("page_id").alias("position"), "url")
    return files.join(urls, "position").filter(F.contains("url", F.lit("ref=x"))).select("filename").distinct()
