import pytest

from folioscope.operators import questions as Q

CASES = {
    "What was revenue and profit in 2025?": 1,
    "Who are the current owners of the company and what are its marketing strategies?": 2,
    "Tell me about ownership, marketing strategy and major products.": 3,
    "Who are the directors and what are their responsibilities?": 1,
    "What is this? Who owns it?": 2,
    "One? Two? Three? Four?": 1,
}


def plan(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id int, text string")
    return Q.process_queries(df)


def test_decomposition(spark):
    got = Q.decompose_queries(plan(spark, list(CASES))).orderBy("query_id").collect()
    assert [len(r.subqueries) for r in got] == list(CASES.values())
    assert got[0].subqueries == ["What was revenue and profit in 2025?"]
    assert got[1].subqueries[1] == "What are its marketing strategies?"


@pytest.mark.parametrize("text, archetype, budget", [
    ("Who owns the company?", "SIMPLE_FACTUAL", 2000),
    ("What are the major working capital concerns here today", "ANALYTICAL", 3500),
    ("Compare revenue of both segments", "COMPARATIVE", 4000),
    ("Give me a risk assessment", "STRATEGIC_DIAGNOSTIC", 4500)])
def test_archetypes(spark, text, archetype, budget):
    r = Q.classify_archetype(plan(spark, [text])).first()
    assert (r.archetype, r.token_budget) == (archetype, budget)


def test_validation_and_time(spark):
    got = plan(spark, ["  What   was revenue last year, in total now?  ", " \n ", "x" * 2049, None]).orderBy("query_id").collect()
    assert [r.error for r in got] == [None, "blank", "too_long", "blank"]
    assert got[0].word_count == 8
    time = Q.resolve_temporal(plan(spark, ["What was revenue last year?", "Show all available financial years", "hi"])
                              ).orderBy("query_id").collect()
    assert time[0].temporal_reference == "last year" and time[0].resolved_periods == ["FY 2024-25"]
    assert time[1].comparison_type == "multi_year" and len(time[1].resolved_periods) >= 3
    assert time[2].temporal_terms == ["reporting period financial year FY25 FY26 revenue profit"]


def test_substring_rules(spark):
    r = Q.plan_intent(plan(spark, ["Why did we read the report"])).first()
    assert "marketing_expenditure" in r.required_metrics      # "ad" inside "read"
    r = Q.classify_archetype(plan(spark, ["please show it to me right now ok"])).first()
    assert r.archetype == "ANALYTICAL"                        # "how" inside "show"


def test_guidance(spark):
    hits = spark.createDataFrame([(1, 1, "Gross Profit and revenue"), (1, 2, " COGS ")], "query_id int, rank int, content string")
    r = Q.guidance_terms(hits).first()
    assert r.guidance_terms == ["gross profit", "revenue", "cogs"]
    assert r.guidance_summary == "[Guidance 1]: Gross Profit and revenue\n[Guidance 2]: COGS"


def test_questions_are_spread_ahead_of_their_rules(spark, tmp_path):
    """Rules over questions run on all cores, also when each table is one small file."""
    from folioscope.plans import q_questions
    spark.createDataFrame([(i, 1, "user", f"What is revenue {i}?") for i in range(200)], "conv_id long, turn int, role string, text string"
                          ).coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    spark.createDataFrame([(i, i % 25) for i in range(200)], "c_custkey long, c_nationkey int").coalesce(1).write.parquet(
        str(tmp_path / "customer.parquet"))
    asked = q_questions.valid(spark, str(tmp_path))
    assert asked.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert asked.count() == 392
