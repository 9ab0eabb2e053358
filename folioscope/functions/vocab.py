"""Word lists, patterns, templates and constants of the rule tables.

They must stay as they are for results to be right.  Every operator takes them as
defaults, so another vocabulary can be passed in.
"""

# Line starts that are always headings.
HEADING_KEYWORDS = [
    "Executive Summary", "Table of Contents", "Introduction", "Background", "Methodology",
    "Results", "Discussion", "Conclusion", "References", "Appendix", "Overview",
    "Financial Performance", "Security Guidelines",
]

# Token budgets.
MAX_TOKENS = 512
OVERLAP_TOKENS = 50
MIN_TOKENS = 30

# Retrieval defaults.
EMBEDDING_DIMENSION = 384
TOP_K = 10
TOP_N = 5
MIN_SIMILARITY = 0.3
GUIDANCE_TOP_K = 4
GUIDANCE_MIN_SIMILARITY = 0.15
CONTEXT_TOKEN_BUDGET = 2000
PER_DOCUMENT_CAP = 3
MAX_QUERY_CHARS = 2048

# Usage defaults.
SESSION_SECONDS = 7200
QUESTION_LIMIT = 10
ANSWER_TTL_SECONDS = 1800
EMBEDDING_TTL_SECONDS = 3600
COOLDOWN_SECONDS = 60

# Question domains (whole words or phrases) in priority order.
DOMAINS = {
    "ownership": ["ownership", "owner", "owners", "shareholding", "promoter", "promoters",
                  "share capital", "equity holding", "shareholders"],
    "marketing": ["marketing", "marketing strategy", "marketing strategies", "sales strategy",
                  "advertising", "distribution channel", "sales promotion"],
    "products": ["product", "products", "major products", "services", "offerings",
                 "business segments"],
    "financials": ["revenue", "profit", "ebitda", "financials", "sales revenue", "income",
                   "margin", "pat", "balance sheet"],
    "governance": ["director", "directors", "board of directors", "responsibilities",
                   "management", "executives", "kmp"],
    "sustainability": ["esg", "sustainability", "emissions", "carbon", "waste management",
                       "renewable energy"],
}

# Sub-question subject per domain.
DOMAIN_SUBJECTS = {
    "ownership": "the company's ownership structure and shareholding details",
    "marketing": "the company's marketing and sales strategies",
    "products": "the company's major products and services",
    "financials": "the company's financial performance and revenue",
    "governance": "the company's board of directors and management",
    "sustainability": "the company's ESG and sustainability practices",
}

# Start of an independent second clause.
CLAUSE_PATTERN = (r"\b(?:and\s+(?:what|who|how|tell\s+me|explain|which)"
                  r"|,\s*(?:tell\s+me|what|who|how|which))\b")

# Time expressions: (pattern, reference, periods, comparison, search terms), first match wins.
TEMPORAL_RULES = [
    (r"\b(last year|previous year|prior year|past year)\b", "last year", ["FY 2024-25"], None,
     ["FY 2024-25", "FY 2024–25", "FY25", "prior year financial"]),
    (r"\b(this year|latest year|current year|current period|recent year)\b", "latest year",
     ["FY 2025-26"], None,
     ["FY 2025-26", "FY 2025–26", "FY26", "latest financial year"]),
    (r"\b(all available financial years|across all years|historical|5-year|five-year|multi-year)\b",
     "all available financial years",
     ["FY 2021-22", "FY 2022-23", "FY 2023-24", "FY 2024-25", "FY 2025-26"], "multi_year",
     ["FY 2021-22 FY 2022-23 FY 2023-24 FY 2024-25 FY 2025-26",
      "five-year revenue net profit history financial year",
      "historical financial performance across reporting periods"]),
    (r"\b(last month|latest month|previous month|recent month|monthly revenue|monthly sales)\b",
     "last month", ["Dec-2025", "Mar-2026", "9M FY26"], "mom",
     ["monthly consumer sales transaction analytics revenue",
      "DS01 Consumer Sales Transaction monthly revenue",
      "DS04 Customer Cohort Performance monthly revenue retention",
      "monthly performance reporting period sales"]),
    (r"\b(latest quarter|recent quarter|9 months|nine months|9m|q4|q3|q2|q1)\b",
     "nine months / quarter", ["9M FY26", "9M FY25"], "period_over_period",
     ["nine months ended 31 December 9M FY26 9M FY25",
      "quarterly revenue gross profit EBIT EBIT margin",
      "Q4 FY25 Q4 L full year budgeted revenue"]),
]
GROWTH_WORDS = ["yoy", "year-over-year", "year over year", "growth", "change", "compared",
                "reporting period"]
GROWTH_TERMS = ["period comparison financial statement YoY growth percentage",
                "revenue net profit margin growth across reporting periods"]
DEFAULT_TEMPORAL_TERM = "reporting period financial year FY25 FY26 revenue profit"

# Business concepts and their terms, in order of test.
TAXONOMY = {
    "profitability": ["net profit", "PAT", "profit after tax", "EBITDA", "EBIT",
                      "operating profit", "gross profit", "gross margin", "net margin",
                      "operating margin", "earnings quality"],
    "revenue": ["annual revenue", "total sales", "net sales", "gross sales", "commercial revenue",
                "D2C revenue", "B2B revenue", "channel revenue", "top-line growth"],
    "cost": ["COGS", "cost of goods sold", "operating expenses", "raw material cost",
             "procurement expense", "personnel expenses", "marketing expenditure",
             "distribution costs"],
    "working_capital": ["inventory days", "receivable days", "payable days",
                        "cash conversion cycle", "working capital cycle",
                        "cash credit utilisation", "inventory turnover", "debtors"],
    "sales_distribution": ["sales volume", "general trade", "modern trade", "e-commerce",
                           "D2C website", "regional distribution", "outlet productivity",
                           "b2b accounts", "order value"],
    "customer_voc": ["customer retention", "cohort performance", "repeat purchase", "churn rate",
                     "nps", "voice of customer", "support tickets", "account fit score", "acv"],
    "operations_supply": ["inventory supply", "production capacity", "fulfilment rate",
                          "on-time delivery", "supplier sla", "quality defect rate",
                          "vendor scorecard", "lead time"],
    "strategy_governance": ["corporate strategy", "leadership objectives",
                            "competitive positioning", "market share", "growth strategy",
                            "risk factors", "strategic priorities"],
}

# Words that select a concept when no term matched.
CONCEPT_FALLBACK = {
    "profitability": ["profit", "margin", "ebitda", "ebit", "loss"],
    "revenue": ["revenue", "sale", "turnover", "top-line", "income"],
    "working_capital": ["working capital", "inventory", "receivable", "credit", "payable"],
    "operations_supply": ["vendor", "supplier", "delivery", "quality"],
    "customer_voc": ["customer", "cohort", "retention", "nps", "voc"],
}

# Search lines per concept, in order; the first group serves two concepts.
CONCEPT_QUERIES = [
    (["profitability", "revenue"],
     ["annual revenue gross profit EBITDA net profit operating margin financial statement",
      "income statement EBIT EBITDA PAT gross margin historical revenue net profit",
      "DS08 Finance Commercial Economics revenue gross margin net profit"]),
    (["working_capital"],
     ["working capital cycle inventory days receivable days payable days cash credit",
      "DS08 Financial Working Capital inventory turnover cash conversion"]),
    (["sales_distribution"],
     ["sales volume regional breakdown general trade modern trade e-commerce revenue",
      "DS01 Consumer Sales Transactions order value product performance"]),
    (["customer_voc"],
     ["customer cohort performance retention churn voice of customer NPS",
      "DS04 Customer Cohort Performance DS09 Customer Experience VoC"]),
    (["operations_supply"],
     ["vendor performance evaluation scorecard delivery quality SLA compliance",
      "DS07 Operations Inventory Supply fulfilment defect rate"]),
]

# Question archetypes: (name, depth, token budget, top n), tested in order.
ARCHETYPES = {
    "STRATEGIC_DIAGNOSTIC": ("MULTI_SECTION_DEEP_DIVE", 4500, 10),
    "COMPARATIVE": ("STRUCTURED_COMPARISON", 4000, 10),
    "ANALYTICAL": ("DETAILED_ANALYSIS", 3500, 8),
    "SIMPLE_FACTUAL": ("CONCISE", 2000, 5),
}
STRATEGIC_WORDS = ["risk assessment", "risks", "achieve", "bottlenecks", "strategic assessment",
                   "overall performance"]
COMPARATIVE_WORDS = ["compare", "changed", "across", "trend", "yoy", "year over year",
                     "growth rate", "period"]
ANALYTICAL_WORDS = ["concern", "concerns", "working capital", "profitability", "issues", "why",
                    "how", "performance", "factors", "drivers", "review"]
SIMPLE_MAX_WORDS = 6

# Keyword families: words, intent, metrics, document types, operations.
FAMILIES = [
    {"words": ["revenue", "profit", "ebitda", "margin", "expense", "financial", "growth", "cost",
               "performance", "period", "earnings", "balance", "working capital",
               "profitability"],
     "intent": "financial_analysis",
     "metrics": ["revenue", "gross_profit", "operating_income", "ebitda", "net_profit",
                 "operating_expenses"],
     "types": ["financial_statement", "annual_report", "balance_sheet", "income_statement"],
     "operations": ["growth_percentage_calculation", "year_over_year_period_comparison",
                    "margin_analysis"]},
    {"words": ["vendor", "supplier", "delivery", "quality", "contract", "compliance", "score",
               "procurement"],
     "intent": "vendor_evaluation",
     "metrics": ["quality_score", "delivery_performance", "pricing_competitiveness",
                 "on_time_delivery"],
     "types": ["vendor_evaluation_report", "procurement_scorecard", "supplier_audit"],
     "operations": ["vendor_scorecard_evaluation", "sla_compliance_check"]},
    {"words": ["sales", "unit", "customer", "region", "segment", "product", "cohort", "month",
               "transaction"],
     "intent": "sales_performance",
     "metrics": ["sales_volume", "regional_revenue", "product_performance", "cohort_retention"],
     "types": ["sales_report", "market_analysis", "cohort_report", "transaction_analytics"],
     "operations": ["regional_distribution_analysis", "cohort_growth_comparison"]},
    {"words": ["marketing", "campaign", "ad", "channel", "cac", "roas"],
     "intent": None,
     "metrics": ["marketing_expenditure", "campaign_roi", "acquisition_cost"],
     "types": ["marketing_campaign_report", "customer_analytics"],
     "operations": []},
    {"words": ["working capital", "inventory", "receivable", "payable", "cash"],
     "intent": None,
     "metrics": ["inventory_days", "receivable_days", "payable_days", "working_capital_cycle"],
     "types": ["finance_commercial_economics", "working_capital_report"],
     "operations": []},
]
DEFAULT_INTENT = "general_analytical_inquiry"
FINANCIAL_CALCULATIONS = ["yoy_growth_percentage", "net_profit_margin", "absolute_change"]
CAUSE_WORDS = ["why", "reason", "despite", "drove", "impact"]
CAUSE_REQUIREMENT = "financial_cost_operations_correlation"
MARKETING_REQUIREMENT = "marketing_sales_attribution"
PERIODS_SUFFIX = " revenue net profit financial performance"

# Metric names looked for in guidance text.
GUIDANCE_PATTERN = (r"(?i)\b(revenue|gross profit|operating income|EBITDA|net profit|COGS"
                    r"|on-time delivery|quality score|defect rate|sales volume|inventory days"
                    r"|receivable days|working capital)\b")
GUIDANCE_CHARS = 200
NO_GUIDANCE = "Standard analytical query decomposition applied."

# Synonyms that prove a metric; a metric not listed proves itself by its own name.
METRIC_SYNONYMS = {
    "revenue": ["revenue", "sales", "turnover", "top-line", "d2c"],
    "net_profit": ["net profit", "pat", "profit after tax", "net income"],
    "gross_profit": ["gross profit", "gross margin", "cogs"],
    "ebitda": ["ebitda", "ebit", "operating profit", "operating margin"],
    "working_capital": ["working capital", "inventory days", "receivable days", "payable days",
                        "cash credit"],
    "customer": ["retention", "cohort", "churn", "nps", "voc", "customer experience"],
    "vendor": ["vendor", "supplier", "scorecard", "delivery performance", "quality score"],
}
NUMBER_EVIDENCE = r"\b\d+(?:\.\d+)?%?|\b(?:lakh|crore|thousand|million|fy2\d)\b"

# Second-pass search lines for missing metrics; {} is the metric in words.
FALLBACK_RULES = [
    (["profit", "net", "revenue"],
     ["1.pdf 3.pdf financial statement {} history reporting period",
      "annual revenue net profit {} FY 2021-22 to FY 2025-26"]),
    (["working", "inventory", "receivable"],
     ["DS08 Financial Commercial Economics inventory days receivable days working capital",
      "1.pdf 3.pdf working capital cycle cash credit utilisation"]),
    (["customer", "retention"],
     ["DS04 Customer Cohort Performance DS09 Customer Experience retention churn NPS"]),
    (["vendor", "supplier"],
     ["vendor evaluation scorecard delivery quality SLA contract compliance"]),
    ([], ["official company document {} evidence reporting period"]),
]

# Re-rank weights and vocabularies.
SEMANTIC_WEIGHT = 0.75
KEYWORD_WEIGHT = 0.15
TITLE_BOOST = 0.10
HEADING_BOOST = 0.05
NUMBER_STEP = 0.025
NUMBER_CAP = 0.15
NUMBER_TRIGGERS = ["financial", "performance", "revenue", "profit", "ebitda", "margin", "growth",
                   "cost", "vendor", "sales", "period", "compare"]
NUMBER_PATTERN = (r"\b\d+(?:\.\d+)?%?|\b(?:revenue|ebitda|profit|margin|income|cogs|growth"
                  r"|operating|lakh|crore|thousand)\b")
TABLE_WORDS = ["revenue", "profit", "margin", "ebit", "operating", "cogs", "expenses", "sales",
               "net"]
TABLE_BOOST_MANY = 0.18
TABLE_BOOST_ONE = 0.10

# Evidence flags of the diagnostic report.
OWNERSHIP_TERMS = ["shareholding", "promoter", "share capital", "equity", "director", "owner"]
MARKETING_TERMS = ["marketing", "sales promotion", "sales strategy", "advertising",
                   "distribution channel"]

# Answer sentence that means "no sources".
REFUSAL = "available company documents do not contain sufficient evidence"
NO_CONTEXT = "No relevant company document context found."

# Prompt directive.
DIRECTIVE_TITLE = "RESPONSE GUIDANCE DIRECTIVE (ADAPTIVE RESPONSE DEPTH):"
DIRECTIVE_RULES = [
    "- Critical Rule: Determine response depth strictly from the user's INFORMATION NEED and"
    " analytical complexity, NOT from the brevity of the question.",
    "- Short analytical, comparative, or diagnostic questions MUST receive complete, multi-point,"
    " structured answers incorporating exact numbers, period trends, business implications, and"
    " management significance.",
    "- Synthesize evidence across ALL retrieved company context chunks. Do not stop after finding"
    " a single metric when a broader analysis is requested.",
]

# Collection payloads.
COMPANY, INSTRUCTION = "company", "instruction"
USER_VISIBLE, INTERNAL = "user_visible", "internal"
SOURCE_TYPES = {COMPANY: "official_company_document", INSTRUCTION: "analytical_instruction"}
PAYLOAD_VERSION = "1.0"

# Redaction.
REDACTED = "[REDACTED_API_KEY]"
MIN_SECRET_CHARS = 4

# Structured log stages -> the field with the duration and the summary column.
STAGE_EVENTS = {
    "DB_TEAM_LOOKUP_COMPLETE": ("duration_ms", "team_lookup_ms"),
    "DB_QUOTA_RESERVATION_COMPLETE": ("duration_ms", "quota_ms"),
    "EMBEDDING_COMPLETE": ("duration_ms", "embedding_ms"),
    "QDRANT_RETRIEVAL_COMPLETE": ("duration_ms", "search_ms"),
    "LLM_FIRST_TOKEN": ("ttft_ms", "first_token_ms"),
    "LLM_GENERATION_COMPLETE": ("duration_ms", "generation_ms"),
    "RAG_LATENCY_SUMMARY": ("total_ms", "total_ms"),
}
