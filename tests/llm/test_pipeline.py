"""The pipeline over the smallest tables, stage by stage, against plain Python."""

import collections
import itertools

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from folioscope.llm import decontaminate
from folioscope.llm.oracles import ORACLES
from tools.check_queries import normal

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    out, docs = [("documents", spark.read.parquet(f"{SF}/documents.parquet").toPandas())], None
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        frame = docs.toPandas()
        docs = spark.createDataFrame(frame, docs.schema)
        out.append((name, frame))
    return out


def test_stages(stages, spark):
    (_, given), (_, known), (_, single), (_, clean), (_, mixed), (_, placed) = stages
    assert all(list(f.columns) == list(given.columns) for _, f in stages[:-1])
    assert set(known.doc_id) <= set(given.doc_id) and len(known) >= 0.95 * len(given)
    assert single.text.is_unique
    items = [(r.item_id, decontaminate.normal(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holding = {r.doc_id for r in single.itertuples() if any(t in decontaminate.normal(r.text) for _, t in items)}
    assert holding and not holding & set(clean.doc_id) and len(single) - len(clean) <= len(holding) + 2
    assert max(collections.Counter(mixed.doc_id).values()) <= 2 and set(mixed.doc_id) <= set(clean.doc_id)
    counts = placed.groupby("shard").size()
    assert counts.max() - counts.min() <= 1 and len(placed) == len(mixed) and set(counts.index) == set(range(40))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    found = con.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert normal(df.columns, [tuple(r) for r in df.collect()]) == normal(columns, found.fetchall())


def shingles(text, words):
    w = text.lower().split()
    return frozenset(tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def near_copies(texts, words, percent):
    """The place of the first text of every text's group, by all pairs."""
    sets, root = [shingles(t, words) for t in texts], list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]) and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
    return root


def test_near_copies_of_five_words_and_eighty_percent_go(spark, docs):
    given = spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(150).collect()
    texts = [r.text for r in given] + ["a b", "A  b", "a b c", "", "e f g h i", "e f g h i j"]
    for n in (8, 9, 10, 12, 20, 40, 60, 100, 400):
        words = [f"w{n}x{i}" for i in range(n)]
        texts.append(" ".join(words))
        for share in (0.15, 0.18, 0.2, 0.22, 0.25, 0.3):
            texts.append(" ".join(words + [f"y{n}z{share}q{i}" for i in range(round(share * n))]))
            texts.append(" ".join([*words[:n // 2], f"v{share}", *words[n // 2 + 1:]]))
    root = near_copies(texts, 5, 80)
    kept = corpus_pipeline.join_near_copies(spark, docs(list(enumerate(texts))), SF)
    whole = {i for i, r in enumerate(root) if r == i or not texts[i].split()}
    assert {r.doc_id for r in kept.collect()} == whole
    assert whole != {i for i, r in enumerate(near_copies(texts, 4, 85)) if r == i or not texts[i].split()}


def test_clean_short_texts_stay_and_foreign_passages_go(spark, docs):
    given = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    short = [(-1, "Avec.", "fr"), (-2, "A.", "en"), (-3, "A. All rights reserved.", "en"), (-4, "Edrere.", "en")]
    foreign = [
        "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, che la diritta via era smarrita. Ahi quanto a "
        "dir qual era e cosa dura esta selva selvaggia e aspra e forte che nel pensier rinova la paura",
        "Vaka vanha Vainamoinen itse tuon sanoiksi virkki: siita nyt tuli lahto, jonka kaikki maailma muistaa; kun olin "
        "nuorempi, elin paremmin kuin moni muu mies naapurissa ja kylassa"]
    extra = docs([*short, *[(-10 - i, t, None) for i, t in enumerate(foreign)], (-20, "12345 !!!", "en")])
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, given.unionByName(extra), SF).select("doc_id").collect()}
    named = {r.doc_id for r in given.filter("text rlike '[a-zA-Z]'").select("doc_id").collect()}
    assert len(named - kept) <= 0.001 * len(named) and {r for r in kept if r < 0} == {-1, -2, -3, -4}


def test_whole_run_on_odd_rows_and_on_empty_tables(spark, odd, tmp_path):
    names = ("_id", "_row", "_values", "key", "n", "rid", "size", "copies", "score", "root")
    items = spark.createDataFrame([(1, None), (2, ""), (None, "Dolor sit  amet consectetur lorem ipsum dolor")],
                                  "item_id long, text string")
    for name, rows in (("odd", odd), ("empty", odd.limit(0))):
        folder = str(tmp_path / name)
        rows = rows.withColumns({c: F.lit("clash") for c in names})
        rows.write.parquet(f"{folder}/documents.parquet")
        (items if name == "odd" else items.limit(0)).write.parquet(f"{folder}/benchmark.parquet")
        out = corpus_pipeline.run(spark, folder)
        assert set(rows.columns) <= set(out.columns) and len(set(out.columns)) == len(out.columns)
        found = out.collect()
        if name == "odd":  # 2, 3, 4 and 7 have no letters; 5 holds the item; 9 is a copy of 1
            assert found and {r.doc_id for r in found} <= {1, 6, 8, 10, None}
            assert all(r.text is not None and r.size == "clash" for r in found)
        else:
            assert found == []
