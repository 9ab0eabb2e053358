"""Registered queries at the smallest scale: fast ones are compared with their SQL (tools/check_queries.py runs all)."""

import duckdb
import pytest

import __spark_entry__ as entry
from folioscope.plans import registry
from tools.check_queries import TABLES, normal

SF = "/root/testdata/sf0.001"
COMPARED = ["diversity_select", "vector_topk_holes", "clean_pages", "index_corpus", "segment_sections", "merge_tiny", "split_oversized", "combine_queries",
            "rerank_score", "quota_admission", "lane_failure_runs", "latency_percentiles", "document_catalog",
            "collection_upsert", "stream_quota"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", COMPARED)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    found = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert normal(df.columns, [tuple(r) for r in df.collect()]) == normal(columns, found.fetchall())


def test_every_query_is_known_and_has_sql_or_a_reason():
    rows_only = {"vector_topk_lsh", "latency_percentiles_approx", "pdf_discovery"}
    assert set(registry.queries()) - set(registry.oracle_sql()) == rows_only
