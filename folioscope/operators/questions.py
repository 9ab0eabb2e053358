"""Rule columns over a table of questions: validation, splitting, plan fields.

Every rule is a column expression, so a whole question table is planned in one narrow
stage without shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import vocab as V
from folioscope.functions.text import WS, contains_any, not_blank, squash, strip, word_pattern

TEXTS = "array<string>"


def texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast(TEXTS)


def _when_texts(test: Column, values: list[str]) -> Column:
    return F.when(test, texts(values)).otherwise(texts([]))


def word_count(c: Column) -> Column:
    """Number of white-space separated words."""
    return F.size(F.filter(F.split(c, rf"[{WS}]+"), lambda w: w != ""))


def process_queries(questions: DataFrame, max_chars: int = V.MAX_QUERY_CHARS) -> DataFrame:
    """Normalised text, counts, validity and the reason of a rejection."""
    trimmed = strip(F.coalesce("text", F.lit("")))
    error = (F.when(~not_blank(F.col("text")), "blank")
             .when(F.length(trimmed) > max_chars, "too_long"))
    normalized = F.when(F.col("error").isNull(), squash(F.col("text"))).otherwise("")
    return (questions.withColumn("error", error).withColumn("normalized_query", normalized)
            .withColumn("character_count", F.length("normalized_query"))
            .withColumn("word_count", F.when(F.col("normalized_query") == "", 0)
                        .otherwise(word_count(F.col("normalized_query"))))
            .withColumn("is_valid", F.col("error").isNull()))


def domains_of(text: Column) -> Column:
    """Names of the domains with a whole-word match, in vocabulary order."""
    lower = F.lower(text)
    return F.array_compact(F.array(*[
        F.when(lower.rlike(word_pattern(terms)), F.lit(name)) for name, terms in V.DOMAINS.items()]))


def detect_domains(questions: DataFrame, text: str = "normalized_query") -> DataFrame:
    return questions.withColumn("domains", domains_of(F.col(text)))


def _question_mark(c: Column) -> Column:
    return F.when(c.endswith("?"), c).otherwise(F.concat(c, F.lit("?")))


def decompose_queries(questions: DataFrame, text: str = "normalized_query") -> DataFrame:
    """Add ``subqueries``: 1 to 3 stand-alone questions."""
    clean = strip(F.col(text))
    marks = F.transform(F.filter(F.transform(F.split("__q", r"\?"), strip), lambda p: p != ""),
                        lambda p: F.concat(p, F.lit("?")))
    clause = rf"(?isU)^(.*?)({V.CLAUSE_PATTERN}.*)$"
    head = strip(F.regexp_extract("__q", clause, 1))
    tail = strip(F.regexp_replace(strip(F.regexp_extract("__q", clause, 2)),
                                  rf"(?iU)^(?:and|,)[{WS}]*", ""))
    tail = F.concat(F.upper(F.substring(tail, 1, 1)), F.substring(tail, F.lit(2), F.length(tail)))
    staged = (questions.withColumn("__q", clean).withColumn("__marks", marks)
              .withColumn("__head", F.when(head != "", _question_mark(head)).otherwise(""))
              .withColumn("__tail", F.when(tail != "", _question_mark(tail)).otherwise(""))
              .withColumn("__all", domains_of(F.col("__q")))
              .withColumn("__d1", domains_of(F.col("__head")))
              .withColumn("__d2", domains_of(F.col("__tail"))))
    by_marks = F.size("__marks").between(2, 3)
    split = ((F.col("__head") != "") & (F.col("__tail") != "")
             & ((F.size("__d1") == 0) | (F.size("__d2") == 0) | (F.col("__d1") != F.col("__d2"))))
    subjects = F.create_map(*[F.lit(x) for pair in V.DOMAIN_SUBJECTS.items() for x in pair])
    templated = F.transform(F.slice("__all", 1, 3), lambda d: F.concat(
        F.lit("What are details regarding "), subjects[d], F.lit("?")))
    parts = (F.when(F.col("__q") == "", F.array(F.col(text)))
             .when(by_marks, F.col("__marks")).when(split, F.array("__head", "__tail"))
             .when(F.size("__all") >= 2, templated).otherwise(F.array("__q")))
    return staged.withColumn("subqueries", parts).drop(
        "__q", "__marks", "__head", "__tail", "__all", "__d1", "__d2")


def resolve_temporal(questions: DataFrame, text: str = "normalized_query") -> DataFrame:
    """Reference, periods, comparison and search terms of the first matching time rule."""
    lower = F.lower(F.col(text))
    reference = comparison = F.lit(None).cast("string")
    periods = terms = texts([])
    for pattern, ref, years, compare, search in reversed(V.TEMPORAL_RULES):
        hit = lower.rlike("(?U)" + pattern)
        reference = F.when(hit, ref).otherwise(reference)
        periods = F.when(hit, texts(years)).otherwise(periods)
        comparison = F.when(hit, F.lit(compare)).otherwise(comparison)
        terms = F.when(hit, texts(search)).otherwise(terms)
    growth = contains_any(lower, V.GROWTH_WORDS)
    found = F.array_distinct(F.concat(terms, _when_texts(growth, V.GROWTH_TERMS)))
    return (questions.withColumn("temporal_reference", reference)
            .withColumn("resolved_periods", periods)
            .withColumn("comparison_type", F.coalesce(comparison, F.when(growth, "yoy")))
            .withColumn("temporal_terms", F.when(F.size(found) > 0, found)
                        .otherwise(texts([V.DEFAULT_TEMPORAL_TERM]))))


def expand_concepts(questions: DataFrame, text: str = "normalized_query",
                    guidance: str | None = None) -> DataFrame:
    """Primary concepts, expanded terms and concept search lines.

    Only the first matching term of a concept counts as primary.  ``guidance`` names an
    array column of extra terms.
    """
    lower = F.lower(F.col(text))
    first = {name: F.coalesce(*[F.when(F.contains(lower, F.lit(t.lower())), F.lit(t)) for t in terms])
             for name, terms in V.TAXONOMY.items()}
    staged = questions.withColumn("primary_concepts", F.array_sort(F.array_compact(
        F.array(*first.values()))))
    direct = F.array_compact(F.array(*[F.when(hit.isNotNull(), F.lit(n)) for n, hit in first.items()]))
    spare = F.array_compact(F.array(*[F.when(contains_any(lower, words), F.lit(n))
                                      for n, words in V.CONCEPT_FALLBACK.items()]))
    staged = staged.withColumn("concept_domains", F.when(F.size(direct) > 0, direct).otherwise(spare))
    taxonomy = F.create_map(*[x for n, terms in V.TAXONOMY.items() for x in (F.lit(n), texts(terms))])
    expanded = F.flatten(F.transform("concept_domains", lambda d: taxonomy[d]))
    if guidance:
        expanded = F.concat(expanded, F.transform(
            F.coalesce(guidance, texts([])), lambda t: F.lower(t)))
    lines = F.concat(*[_when_texts(F.arrays_overlap("concept_domains", texts(names)), found)
                       for names, found in V.CONCEPT_QUERIES])
    return (staged.withColumn("expanded_terms", F.array_sort(F.array_distinct(expanded)))
            .withColumn("concept_queries", F.array_distinct(lines)))


def classify_archetype(questions: DataFrame, text: str = "normalized_query") -> DataFrame:
    """Archetype with its response depth, token budget and target top n."""
    lower = F.lower(strip(F.col(text)))
    name = (F.when(contains_any(lower, V.STRATEGIC_WORDS), "STRATEGIC_DIAGNOSTIC")
            .when(contains_any(lower, V.COMPARATIVE_WORDS), "COMPARATIVE")
            .when(contains_any(lower, V.ANALYTICAL_WORDS), "ANALYTICAL")
            .when(word_count(lower) <= V.SIMPLE_MAX_WORDS, "SIMPLE_FACTUAL")
            .otherwise("ANALYTICAL"))

    def pick(i):
        chain = None
        for key, values in V.ARCHETYPES.items():
            test = F.col("archetype") == key
            chain = F.when(test, values[i]) if chain is None else chain.when(test, values[i])
        return chain

    return (questions.withColumn("archetype", name).withColumn("depth", pick(0))
            .withColumn("token_budget", pick(1)).withColumn("target_top_n", pick(2)))


def plan_intent(questions: DataFrame, text: str = "normalized_query") -> DataFrame:
    """Intent and the accumulated lists of the matching keyword families."""
    lower = F.lower(strip(F.col(text)))
    hits = [contains_any(lower, family["words"]) for family in V.FAMILIES]
    intent = F.coalesce(*[F.when(hit, F.lit(f["intent"])) for hit, f in zip(hits, V.FAMILIES)
                          if f["intent"]], F.lit(V.DEFAULT_INTENT))

    def gather(key):
        return F.array_distinct(F.concat(*[_when_texts(hit, f[key]) for hit, f in zip(hits, V.FAMILIES)]))

    cause = hits[0] & contains_any(lower, V.CAUSE_WORDS)
    return (questions.withColumn("intent", intent)
            .withColumn("required_metrics", gather("metrics"))
            .withColumn("preferred_types", gather("types"))
            .withColumn("operations", gather("operations"))
            .withColumn("calculations", _when_texts(hits[0], V.FINANCIAL_CALCULATIONS))
            .withColumn("cross_domain", F.concat(_when_texts(cause, [V.CAUSE_REQUIREMENT]),
                                                 _when_texts(hits[3], [V.MARKETING_REQUIREMENT]))))


def plan_search_queries(plans: DataFrame, text: str = "normalized_query") -> DataFrame:
    """Add ``search_queries`` and ``concepts`` from the temporal and concept columns."""
    periods = F.when(F.size("resolved_periods") > 0, F.array(F.concat(
        F.array_join("resolved_periods", " "), F.lit(V.PERIODS_SUFFIX)))).otherwise(texts([]))
    everything = F.concat(F.array(F.col(text)), F.col("temporal_terms"), F.col("concept_queries"), periods)
    return (plans.withColumn("search_queries", F.array_distinct(F.filter(everything, not_blank)))
            .withColumn("concepts", F.concat("primary_concepts", F.slice("expanded_terms", 1, 10))))


def guidance_terms(guidance: DataFrame) -> DataFrame:
    """Metric names and the summary of a question's guidance chunks (query_id, rank, content)."""
    found = F.transform(F.regexp_extract_all("content", F.lit("(?U)" + V.GUIDANCE_PATTERN), 1),
                        lambda t: F.lower(t))
    line = F.concat(F.lit("[Guidance "), F.col("rank").cast("string"), F.lit("]: "),
                    strip(F.substring("content", 1, V.GUIDANCE_CHARS)))
    gathered = guidance.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(
        "rank", found.alias("terms"), line.alias("line")))).alias("g"))
    return gathered.select(
        "query_id", F.flatten(F.transform("g", lambda x: x["terms"])).alias("guidance_terms"),
        F.array_join(F.transform("g", lambda x: x["line"]), "\n").alias("guidance_summary"),
        F.size("g").alias("guidance_chunks"))


def question_plans(questions: DataFrame, guidance: DataFrame | None = None) -> DataFrame:
    """All plan columns of valid questions (query_id, normalized_query)."""
    base = questions
    if guidance is not None:
        base = base.join(guidance_terms(guidance), "query_id", "left")
    else:
        base = (base.withColumn("guidance_terms", texts([]))
                .withColumn("guidance_summary", F.lit(None).cast("string"))
                .withColumn("guidance_chunks", F.lit(None).cast("int")))
    base = (base.withColumn("guidance_summary", F.coalesce("guidance_summary", F.lit(V.NO_GUIDANCE)))
            .withColumn("guidance_chunks", F.coalesce("guidance_chunks", F.lit(0))))
    steps = [resolve_temporal, lambda d: expand_concepts(d, guidance="guidance_terms"),
             classify_archetype, plan_intent, plan_search_queries, decompose_queries]
    for step in steps:
        base = step(base)
    return base


def combine_queries(plans: DataFrame) -> DataFrame:
    """(query_id, subquery_pos, subquery): decomposed then planned, first occurrence kept."""
    return plans.select("query_id", F.posexplode(F.array_distinct(
        F.concat("subqueries", "search_queries"))).alias("subquery_pos", "subquery"))
