"""Registered queries: question validation, splitting and plan fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import vocab as V
from folioscope.operators import questions as Q
from folioscope.operators import ranking as R
from folioscope.operators import retrieval as S
from folioscope.plans import duck as D, inputs as I

BAR = " ¦ "


def flat(name):
    return F.array_join(name, BAR).alias(name)


def valid(spark, sf):
    return Q.process_queries(I.questions(spark, sf)).filter("is_valid").select("query_id", "normalized_query")


def process_queries(spark, sf):
    return Q.process_queries(I.questions(spark, sf)).drop("text")


def detect_domains(spark, sf):
    return Q.detect_domains(valid(spark, sf)).select("query_id", flat("domains"))


def decompose_queries(spark, sf):
    return Q.decompose_queries(valid(spark, sf)).select(
        "query_id", F.posexplode("subqueries").alias("pos", "subquery"))


def resolve_temporal(spark, sf):
    return Q.resolve_temporal(valid(spark, sf)).select(
        "query_id", "temporal_reference", "comparison_type", flat("resolved_periods"), flat("temporal_terms"))


def expand_concepts(spark, sf):
    return Q.expand_concepts(valid(spark, sf)).select(
        "query_id", flat("primary_concepts"), flat("expanded_terms"), flat("concept_queries"))


def classify_archetype(spark, sf):
    return Q.classify_archetype(valid(spark, sf)).select(
        "query_id", "archetype", "depth", "token_budget", "target_top_n")


def plan_intent(spark, sf):
    return Q.plan_intent(valid(spark, sf)).select(
        "query_id", "intent", flat("required_metrics"), flat("preferred_types"), flat("operations"),
        flat("calculations"), flat("cross_domain"))


def _plans(spark, sf):
    return Q.question_plans(valid(spark, sf))


def plan_search_queries(spark, sf):
    return _plans(spark, sf).select("query_id", flat("search_queries"), flat("concepts"))


def combine_queries(spark, sf):
    return Q.combine_queries(_plans(spark, sf))


def effective_top_n(spark, sf):
    return R.effective_top_n(Q.classify_archetype(valid(spark, sf))).select("query_id", "effective_top_n")


def guidance_terms(spark, sf):
    """Assistant turns as ranked guidance of their conversation's question."""
    turns = I.table(spark, sf, "conversations").filter("role = 'assistant'").select(
        F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"),
        F.concat_ws(" ", F.col("text"), F.when(F.col("turn") % 4 == 1, "Gross Profit and revenue")
                    .otherwise("COGS, on-time delivery")).alias("content"))
    return Q.guidance_terms(turns).withColumn("guidance_terms", F.array_join("guidance_terms", BAR))


def fallback_queries(spark, sf):
    """Search lines when the labelled metrics of a plan are all missing."""
    plans = Q.plan_intent(valid(spark, sf)).select(
        "query_id", "required_metrics", F.col("required_metrics").alias("missing_metrics"),
        F.lit(False).alias("is_sufficient"))
    return S.fallback_queries(plans).select("query_id", F.posexplode("fallback").alias("pos", "line"))


QUERIES = {
    "process_queries": process_queries, "detect_domains": detect_domains, "decompose_queries": decompose_queries,
    "resolve_temporal": resolve_temporal, "expand_concepts": expand_concepts,
    "classify_archetype": classify_archetype, "plan_intent": plan_intent,
    "plan_search_queries": plan_search_queries, "combine_queries": combine_queries,
    "effective_top_n": effective_top_n, "guidance_terms": guidance_terms, "fallback_queries": fallback_queries,
}

W = r"[\p{L}\p{N}_]"
NW = r"[^\p{L}\p{N}_]"


def word_match(x, terms):
    return f"regexp_matches({x}, '(^|{NW})({'|'.join(terms)})($|{NW})')"


def domains(x):
    parts = ", ".join(f"CASE WHEN {word_match(x, terms)} THEN '{name}' END" for name, terms in V.DOMAINS.items())
    return f"list_filter([{parts}], lambda d: d IS NOT NULL)"


def cases(x, pick, default):
    lines = [f"WHEN regexp_matches({x}, '(^|{NW}){rule[0][2:-2]}($|{NW})') THEN {pick(rule)}" for rule in V.TEMPORAL_RULES]
    return "CASE " + " ".join(lines) + f" ELSE {default} END"


def null_or(text):
    return "NULL" if text is None else D.q(text)


GROWTH = D.contains_any("lq", V.GROWTH_WORDS)
TEMPORAL = f"""temporal AS (
  SELECT query_id, {cases('lq', lambda r: D.q(r[1]), 'NULL')} AS temporal_reference,
    {cases('lq', lambda r: D.qlist(r[2]), '[]::VARCHAR[]')} AS resolved_periods,
    coalesce({cases('lq', lambda r: null_or(r[3]), 'NULL')}, CASE WHEN {GROWTH} THEN 'yoy' END) AS comparison_type,
    list_concat({cases('lq', lambda r: D.qlist(r[4]), '[]::VARCHAR[]')},
      CASE WHEN {GROWTH} THEN {D.qlist(V.GROWTH_TERMS)} ELSE []::VARCHAR[] END) AS found FROM valid),
timed AS (SELECT query_id, temporal_reference, resolved_periods, comparison_type,
    CASE WHEN len(found) > 0 THEN found ELSE {D.qlist([V.DEFAULT_TEMPORAL_TERM])} END AS temporal_terms FROM temporal)"""


def _firsts():
    out = []
    for terms in V.TAXONOMY.values():
        out.append("CASE " + " ".join(f"WHEN contains(lq, {D.q(t.lower())}) THEN {D.q(t)}" for t in terms) + " END")
    return ", ".join(out)


DIRECT = ", ".join(f"CASE WHEN {D.contains_any('lq', [t.lower() for t in terms])} THEN '{n}' END"
                   for n, terms in V.TAXONOMY.items())
SPARE = ", ".join(f"CASE WHEN {D.contains_any('lq', words)} THEN '{n}' END" for n, words in V.CONCEPT_FALLBACK.items())
LINES = ", ".join(f"CASE WHEN list_has_any(doms, {D.qlist(names)}) THEN {D.qlist(found)} ELSE []::VARCHAR[] END"
                  for names, found in V.CONCEPT_QUERIES)
TAXONOMY = ", ".join(f"CASE WHEN list_contains(doms, '{n}') THEN {D.qlist(terms)} ELSE []::VARCHAR[] END"
                     for n, terms in V.TAXONOMY.items())
CONCEPTS = f"""matched AS (
  SELECT query_id, lq, list_sort(list_filter([{_firsts()}], lambda t: t IS NOT NULL)) AS primary_concepts,
    list_filter([{DIRECT}], lambda t: t IS NOT NULL) AS direct,
    list_filter([{SPARE}], lambda t: t IS NOT NULL) AS spare FROM valid),
concept AS (SELECT *, CASE WHEN len(direct) > 0 THEN direct ELSE spare END AS doms FROM matched),
concepts AS (SELECT query_id, primary_concepts, list_sort(list_distinct(flatten([{TAXONOMY}]))) AS expanded_terms,
    flatten([{LINES}]) AS concept_queries FROM concept)"""

ARCHETYPE = f"""archetypes AS (
  SELECT query_id, CASE WHEN {D.contains_any('lq', V.STRATEGIC_WORDS)} THEN 'STRATEGIC_DIAGNOSTIC'
    WHEN {D.contains_any('lq', V.COMPARATIVE_WORDS)} THEN 'COMPARATIVE'
    WHEN {D.contains_any('lq', V.ANALYTICAL_WORDS)} THEN 'ANALYTICAL'
    WHEN len(string_split(lq, ' ')) <= 6 THEN 'SIMPLE_FACTUAL' ELSE 'ANALYTICAL' END AS archetype FROM valid)"""
PICK = "CASE archetype " + " ".join(f"WHEN '{k}' THEN {{{i}}}" for i, k in enumerate(V.ARCHETYPES)) + " END"


def pick(i):
    values = [v[i] if not isinstance(v[i], str) else f"'{v[i]}'" for v in V.ARCHETYPES.values()]
    return PICK.format(*values)


HITS = [D.contains_any("lq", f["words"]) for f in V.FAMILIES]


def gather(key):
    parts = ", ".join(f"CASE WHEN {h} THEN {D.qlist(f[key])} ELSE []::VARCHAR[] END" for h, f in zip(HITS, V.FAMILIES))
    return f"flatten([{parts}])"


INTENT = f"""intents AS (
  SELECT query_id, CASE WHEN {HITS[0]} THEN 'financial_analysis' WHEN {HITS[1]} THEN 'vendor_evaluation'
      WHEN {HITS[2]} THEN 'sales_performance' ELSE '{V.DEFAULT_INTENT}' END AS intent,
    {gather('metrics')} AS required_metrics, {gather('types')} AS preferred_types, {gather('operations')} AS operations,
    CASE WHEN {HITS[0]} THEN {D.qlist(V.FINANCIAL_CALCULATIONS)} ELSE []::VARCHAR[] END AS calculations,
    list_concat(CASE WHEN {HITS[0]} AND {D.contains_any('lq', V.CAUSE_WORDS)} THEN {D.qlist([V.CAUSE_REQUIREMENT])}
        ELSE []::VARCHAR[] END,
      CASE WHEN {HITS[3]} THEN {D.qlist([V.MARKETING_REQUIREMENT])} ELSE []::VARCHAR[] END) AS cross_domain
  FROM valid)"""

CLAUSE = rf"(?is)^(.*?)({V.CLAUSE_PATTERN}.*)$"
MARK = "CASE WHEN {0} = '' OR suffix({0}, '?') THEN {0} ELSE {0} || '?' END"
SUBJECT = "CASE d " + " ".join(f"WHEN '{k}' THEN {D.q(v)}" for k, v in V.DOMAIN_SUBJECTS.items()) + " END"
DECOMPOSED = f"""cuts AS (
  SELECT query_id, nq, list_transform(list_filter(list_transform(string_split(nq, '?'), lambda p: {D.strip('p')}),
      lambda p: p <> ''), lambda p: p || '?') AS marks,
    {D.strip(f"regexp_extract(nq, '{CLAUSE}', 1)")} AS head,
    {D.strip(f"regexp_replace({D.strip(f'regexp_extract(nq, {D.q(CLAUSE)}, 2)')}, '(?i)^(and|,)[ ]*', '')")} AS tail
  FROM valid),
halves AS (
  SELECT query_id, nq, marks, {MARK.format('head')} AS h, CASE WHEN tail = '' THEN '' ELSE
    upper(substr(tail, 1, 1)) || substr({MARK.format('tail')}, 2) END AS t FROM cuts),
scoped AS (SELECT *, {domains('lower(nq)')} AS da, {domains('lower(h)')} AS d1, {domains('lower(t)')} AS d2 FROM halves),
decomposed AS (
  SELECT query_id, CASE WHEN len(marks) BETWEEN 2 AND 3 THEN marks
    WHEN h <> '' AND t <> '' AND (len(d1) = 0 OR len(d2) = 0 OR d1 <> d2) THEN [h, t]
    WHEN len(da) >= 2 THEN list_transform(list_slice(da, 1, 3),
      lambda d: 'What are details regarding ' || {SUBJECT} || '?')
    ELSE [nq] END AS subqueries FROM scoped)"""

# order-preserving distinct of a list
def distinct(x):
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


PLANNED = f"""joined AS (
  SELECT v.query_id, list_concat([v.nq], t.temporal_terms, c.concept_queries, CASE WHEN len(t.resolved_periods) > 0
      THEN [array_to_string(t.resolved_periods, ' ') || {D.q(V.PERIODS_SUFFIX)}] ELSE []::VARCHAR[] END) AS everything,
    list_concat(c.primary_concepts, list_slice(c.expanded_terms, 1, 10)) AS concepts
  FROM valid v JOIN timed t USING (query_id) JOIN concepts c USING (query_id)),
planned AS (SELECT query_id, {distinct('everything')} AS search_queries, concepts FROM joined)"""
COMBINED = f"""both_lists AS (SELECT query_id, list_concat(subqueries, search_queries) AS l
  FROM decomposed JOIN planned USING (query_id)),
combined AS (SELECT query_id, generate_subscripts(u, 1) - 1 AS subquery_pos, unnest(u) AS subquery
  FROM (SELECT query_id, {distinct('l')} AS u FROM both_lists))"""


def joined(name):
    return f"array_to_string({name}, '{BAR}') AS {name}"


def fallback_sql(metrics):
    def lines(ts):
        return "[" + ", ".join("replace(" + D.q(t) + ", '{}', w)" for t in ts) + "]"
    rules = " ".join(f"WHEN {D.contains_any('w', keys)} THEN {lines(ts)}" for keys, ts in V.FALLBACK_RULES if keys)
    return f"""flatten(list_transform({metrics}, lambda m: list_extract(list_transform(
      [lower(replace(m, '_', ' '))], lambda w: CASE {rules} ELSE {lines(V.FALLBACK_RULES[-1][1])} END), 1)))"""


GUIDE = V.GUIDANCE_PATTERN
ORACLES = {
    "process_queries": D.with_(D.QUESTIONS) + """SELECT query_id, error, nq AS normalized_query,
length(nq) AS character_count, CASE WHEN nq = '' THEN 0 ELSE len(string_split(nq, ' ')) END AS word_count,
error IS NULL AS is_valid FROM asked""",
    "detect_domains": D.with_(D.QUESTIONS) + f"""SELECT query_id, array_to_string({domains('lq')}, '{BAR}') AS domains
FROM valid""",
    "decompose_queries": D.with_(D.QUESTIONS, DECOMPOSED) + """SELECT query_id,
generate_subscripts(subqueries, 1) - 1 AS pos, unnest(subqueries) AS subquery FROM decomposed""",
    "resolve_temporal": D.with_(D.QUESTIONS, TEMPORAL) + f"""SELECT query_id, temporal_reference, comparison_type,
{joined('resolved_periods')}, {joined('temporal_terms')} FROM timed""",
    "expand_concepts": D.with_(D.QUESTIONS, CONCEPTS) + f"""SELECT query_id, {joined('primary_concepts')},
{joined('expanded_terms')}, {joined('concept_queries')} FROM concepts""",
    "classify_archetype": D.with_(D.QUESTIONS, ARCHETYPE) + f"""SELECT query_id, archetype, {pick(0)} AS depth,
{pick(1)} AS token_budget, {pick(2)} AS target_top_n FROM archetypes""",
    "plan_intent": D.with_(D.QUESTIONS, INTENT) + f"""SELECT query_id, intent, {joined('required_metrics')},
{joined('preferred_types')}, {joined('operations')}, {joined('calculations')}, {joined('cross_domain')} FROM intents""",
    "plan_search_queries": D.with_(D.QUESTIONS, TEMPORAL, CONCEPTS, PLANNED)
    + f"SELECT query_id, {joined('search_queries')}, {joined('concepts')} FROM planned",
    "combine_queries": D.with_(D.QUESTIONS, TEMPORAL, CONCEPTS, PLANNED, DECOMPOSED, COMBINED)
    + "SELECT query_id, subquery_pos, subquery FROM combined",
    "effective_top_n": D.with_(D.QUESTIONS, ARCHETYPE) + f"""SELECT query_id, greatest(5, {pick(2)}) AS effective_top_n
FROM archetypes""",
    "guidance_terms": f"""WITH g AS (SELECT conv_id AS query_id, turn, text || ' ' || CASE WHEN turn % 4 = 1
    THEN 'Gross Profit and revenue' ELSE 'COGS, on-time delivery' END AS content
  FROM conversations WHERE role = 'assistant')
SELECT query_id, array_to_string(flatten(list(list_transform(regexp_extract_all(content, '{GUIDE}'),
    lambda t: lower(t)) ORDER BY turn)), '{BAR}') AS guidance_terms,
  string_agg('[Guidance ' || turn || ']: ' || {D.strip('substr(content, 1, 200)')}, chr(10) ORDER BY turn)
    AS guidance_summary, count(*) AS guidance_chunks
FROM g GROUP BY 1""",
    "fallback_queries": D.with_(D.QUESTIONS, INTENT, f"""filled AS (SELECT query_id,
  {fallback_sql('required_metrics')} AS l FROM intents),
uniq AS (SELECT query_id, {distinct('l')} AS u FROM filled)""")
    + "SELECT query_id, generate_subscripts(u, 1) - 1 AS pos, unnest(u) AS line FROM uniq",
}
