"""Every operator on odd rows, on an empty table and with extra columns of clashing names."""

import re
import zlib

import pytest
from pyspark.sql import functions as F

from folioscope.llm import (decontaminate, jaccard_join, language_id, mixing, pu_quality, resharding, site_style,
                            string_kernel, token_counts, voronoi_knn)

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (5, 0, None), (None, 1, 1), (9, 1, 0)], LABELS)


def clashing(df):
    names = ("_id", "_row", "_values", "size", "key", "n", "rid", "entries", "copies", "before_one", "shard", "score",
             "held_out", "lang_pred", "target", "one", "band", "x", "positive")
    return df.withColumns({c: F.lit("clash") for c in names})


def test_mixing(odd):
    rows = mixing.decide(odd, ["doc_id", "source"]).collect()
    assert len(rows) == odd.count()
    assert sum(r.size for r in rows) == sum(len(WORDS.findall(r.text or "")) for r in odd.collect())
    assert all(0 <= r.copies <= 2 and r.target <= 2 * r.source_size for r in rows)
    assert mixing.decide(odd.limit(0), ["doc_id", "source"]).count() == 0
    mixed = mixing.mix(clashing(odd))
    assert mixed.columns == clashing(odd).columns
    drawn = mixing.decide(clashing(odd), ["doc_id", "source"]).collect()
    assert mixed.count() == sum(r.copies for r in drawn) > 0


def test_resharding(odd):
    rows = resharding.assign(odd, ["doc_id"], new_shards=4).collect()
    counts = [sum(r.shard == s for r in rows) for s in range(4)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == odd.count()
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    crc = {r.doc_id: r.text_crc32 for r in rows}
    assert crc[2] is None and crc[3] == 0 and crc[7] == zlib.crc32(b"12345 !!! ???")
    assert {r.size for r in rows if r.doc_id == 2} == {16}
    assert resharding.assign(odd.limit(0), ["doc_id"]).count() == 0
    placed = resharding.attach(clashing(odd), new_shards=3)
    assert placed.count() == odd.count() and len(set(placed.columns)) == len(placed.columns)


def test_language(odd):
    rows = {(r.doc_id, r.lang_pred, r.score) for r in language_id.identify(odd).collect()}
    assert {x for i, x, _ in rows if i in (2, 3, 4, 7)} == {"und"}
    assert all(0 <= s <= 1 for _, _, s in rows)
    assert language_id.identify(odd.limit(0)).count() == 0
    assert {r.lang_pred for r in language_id.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = language_id.recognised(clashing(odd), language_id.learn(odd), 0.0)
    assert kept.columns == clashing(odd).columns and {r.doc_id for r in kept.collect()} >= {1, 5, 9}


def test_decontamination(odd, spark):
    items = spark.createDataFrame([(1, "Dolor  sit amet consectetur lorem"), (2, None), (3, ""), (1, "short"),
                                   (None, "one two three four FIVE six")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.matches(odd, items).collect()}
    assert found == {(5, 1), (1, None), (None, None), (9, None)}
    assert decontaminate.matches(odd, items.limit(0)).count() == 0 and decontaminate.matches(odd.limit(0), items).count() == 0
    blocks = {(r.doc_id, r.item_id) for r in decontaminate.matches(odd, items, block_chars=20).collect()}
    assert blocks == found
    kept = decontaminate.remove(clashing(odd), items)
    assert kept.columns == clashing(odd).columns and kept.count() == odd.count() - 5


def test_jaccard(odd):
    rows = jaccard_join.join(odd).collect()
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id))
    assert by_id[1] == [(3, 1), (3, 1)] and by_id[9] == [(3, 1)] and by_id[2] == [(0, 2)] and by_id[6] == [(1, 6)]
    assert sorted(by_id[None], key=str) == [(0, None), (3, 1)]
    assert jaccard_join.join(odd.limit(0)).count() == 0
    kept = jaccard_join.keep_one(clashing(odd))
    assert kept.columns == clashing(odd).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(
        str(i) for i in (1, 2, 3, 4, 5, 6, 7, 8, 10, None))


def test_classifiers(odd, labels):
    for score in (pu_quality.score, string_kernel.score):
        rows = score(clashing(odd), labels).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id == 1}) == 1
        assert score(odd.limit(0), labels).count() == 0
        assert len({r.score for r in score(odd, labels.limit(0)).collect()}) == 1


def test_token_counts(odd):
    rows = {r.doc_id: r for r in token_counts.count_tokens(odd.select("doc_id", "text")).collect()}
    assert [rows[i].n_tokens for i in (2, 3, 4)] == [0, 0, 0] and rows[6].n_pretokens == 1 and rows[6].n_tokens > 0
    assert token_counts.count_tokens(odd.select("doc_id", "text").limit(0)).count() == 0


def test_pages(spark):
    pages = spark.createDataFrame([
        (1, "http://h/1", "<p>A &amp; B\n <b>c</b><br>d<p>e</p><script>x()</script>"), (2, None, None), (3, "", ""),
        (4, "http://h/2", "<nav>menu</nav><article><h1>T</h1><p>one</p><div class='comments'>no</div></article><p>out</p>"),
        (None, "http://h/3", "plain &lt;text"), (4, "http://h/2", "<div class=\"cookie-notice\">c</div><main>m</main><foo")],
        "page_id long, url string, html string")
    found = [(r.page_id, r.text, r.n_chars) for r in site_style.extract(pages).collect()]
    assert sorted(found, key=str) == sorted([
        (1, "A & B c d\n\ne", 12), (2, "", 0), (3, "", 0), (4, "T\n\none", 6), (None, "plain <text", 11), (4, "m", 1)], key=str)
    assert site_style.extract(pages.limit(0)).count() == 0


def test_neighbours(spark):
    inf = float("inf")
    rows = [(0, [1.0, 0.0]), (0, [0.5, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [None, 1.0]), (4, [inf, 0.0]), (5, [2.0]),
            (50, [3.0, 1.0]), (None, [9.0, 9.0]), (100, [1e30, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {(r.query_id, r["rank"], r.vec_id, r.score) for r in voronoi_knn.top_k(df, k=2).collect()}
    assert (50, 2, None, (9 * 3 + 9) * 65536) in found and (50, 1, 100, 2 ** 63 - 1) in found
    assert {v for _, _, v, _ in found} & {2, 3, 4, 5} == set()
    assert voronoi_knn.top_k(df.limit(0)).count() == 0
