import itertools
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.functions import columns
from folioscope.functions.text import strip
from folioscope.operators import chunking as C
from folioscope.operators import cleaning, structure
from folioscope.plans import corpus


def tok(s):
    return max(1, round(len(s) / 4)) if s.strip() else 0


def pack(contents, max_tokens, overlap):
    """Greedy packing with one small section carried over."""
    chunks, held = [], []
    for i, text in enumerate(contents):
        if held and tok("\n\n".join(contents[j] for j in held)) + tok(text) > max_tokens:
            chunks.append(held)
            held = [held[-1], i] if tok(contents[held[-1]]) <= overlap else [i]
        else:
            held = held + [i]
    return chunks + ([held] if held else [])


def section_table(spark, docs):
    data = [(d, 1 + i // 3, i, kinds[i], f"T{i}", levels[i], texts[i], len(texts[i]))
            for d, (texts, kinds, levels) in docs.items() for i in range(len(texts))]
    return spark.createDataFrame(
        data, "document_id string, page_number int, reading_order long, section_type string, title string, "
              "level int, content string, char_count int")


def random_docs(rng, sizes):
    docs = {}
    for n, size in enumerate(sizes):
        kinds = [rng.choice(["heading", "paragraph", "list", "table"]) for _ in range(size)]
        texts = ["x" * rng.choice([1, 3, 9, 20, 33, 60, 90, 200]) for _ in range(size)]
        docs[f"d{n}"] = (texts, kinds, [rng.randint(1, 6) for _ in range(size)])
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_packing_across_blocks_equals_loop(spark, seed):
    docs = random_docs(random.Random(seed), [400, 1, 41, 80, 7, 163])
    got = C.semantic_chunks(section_table(spark, docs), max_tokens=20, overlap=5, block=40).collect()
    for d, (texts, kinds, levels) in docs.items():
        mine = sorted((r for r in got if r.document_id == d), key=lambda r: r.chunk_order)
        want = pack(texts, 20, 5)
        assert [r.content for r in mine] == ["\n\n".join(texts[j] for j in c) for c in want]
        for r, members, after in zip(mine, want, want[1:] + [None]):
            # the section that closes the chunk is the first new one of the next chunk
            close = next(j for j in after if j > members[-1]) if after else len(texts) - 1
            heads = [j for j in range(close + 1) if kinds[j] == "heading"]
            assert r.section_title == (f"T{heads[-1]}" if heads else "General")
            assert r.page_numbers == sorted({1 + j // 3 for j in members})


def split(content, limit):
    parts = content.split("\n\n")
    if len(parts) <= 1:
        parts = content.split("\n")
    out, held = [], []
    for p in (p.strip() for p in parts):
        if p and held and tok("\n\n".join(held + [p])) > limit:
            out.append("\n\n".join(held))
            held = [p]
        elif p:
            held.append(p)
    return out + (["\n\n".join(held)] if held else [])


def merge(texts, low, limit):
    out, i = [], 0
    while i < len(texts):
        if tok(texts[i]) < low and i + 1 < len(texts) and tok(texts[i]) + tok(texts[i + 1]) <= limit:
            out.append(texts[i] + "\n\n" + texts[i + 1])
            i += 2
        else:
            out.append(texts[i])
            i += 1
    return out


def test_optimize_equals_loop(spark):
    rng = random.Random(5)
    docs = {f"d{n}": ["\n".join("y" * rng.randint(0, 50) for _ in range(rng.randint(1, 12))) + "z"
                      for _ in range(rng.randint(1, 40))] for n in range(6)}
    data = [(d, i, [i], "t", rng.choice(["paragraph", "list"]), 2, c, tok(c), len(c))
            for d, cs in docs.items() for i, c in enumerate(cs)]
    chunks = spark.createDataFrame(
        data, "document_id string, chunk_order long, page_numbers array<int>, section_title string, "
              "section_type string, hierarchy_level int, content string, estimated_tokens int, char_count int")
    got = corpus.optimize_chunks(chunks, min_tokens=8, max_tokens=30).collect()
    for d, cs in docs.items():
        pieces = [p for c in cs for p in (split(c, 30) if tok(c) > 30 else [c])]
        mine = [r.content for r in sorted((r for r in got if r.document_id == d), key=lambda r: r.chunk_order)]
        assert mine == merge(pieces, 8, 30)


def test_hierarchy_equals_stack(spark):
    docs = random_docs(random.Random(8), [120, 3])
    tree = structure.build_hierarchy(section_table(spark, docs)).collect()
    for d, (_, _, levels) in docs.items():
        want = []
        for i, level in enumerate(levels):
            want.append(next((j for j in range(i - 1, -1, -1) if levels[j] < level), None))
        got = sorted((r.reading_order, r.parent_order) for r in tree if r.document_id == d)
        assert [p for _, p in got] == want


REPORT = [(1, "Acme Corp Report\n1. Introduction\nText of page one.\n\n- a\n- b\nkey | v\nPage footer line"),
          (2, "Acme Corp Report\n2. Methods\n  Text   of page\ttwo.\nPage footer line"),
          (3, "Acme Corp Report\n# Results\nText of page three.\nPage footer line")]


def report(spark):
    return spark.createDataFrame([("r", n, t) for n, t in REPORT], "document_id string, page_number int, text string")


def test_headers_and_footers_go(spark, rows):
    found = rows(cleaning.detect_header_footer(report(spark)), "kind", "line", "occurrences")
    assert ("header", "Acme Corp Report", 3) in found and ("footer", "Page footer line", 3) in found
    texts = {r.page_number: r.text for r in cleaning.clean_pages(report(spark)).collect()}
    assert texts[2] == "2. Methods\nText of page two."
    assert all("Acme" not in t and "footer" not in t for t in texts.values())


def test_sections_of_the_report(spark):
    got = structure.segment_sections(cleaning.clean_pages(report(spark))).orderBy("reading_order").collect()
    assert [(r.section_type, r.level) for r in got] == [
        ("heading", 1), ("paragraph", 4), ("list", 3), ("table", 3), ("heading", 1), ("paragraph", 4),
        ("heading", 1), ("paragraph", 4)]
    assert got[2].content == "- a\n- b" and got[2].title == "List Block (Page 1)"
    assert got[6].title == "Results"


def test_children_and_statistics(spark, rows):
    table = section_table(spark, {"d": (["a", "b", "c"], ["heading", "heading", "paragraph"], [1, 2, 4])})
    edges = rows(structure.children_and_roots(structure.build_hierarchy(table)), "parent_order", "child_order",
                 "child_position", "is_root")
    assert edges == [(-1, 0, 0, True), (0, 1, 0, False), (1, 2, 0, False)]
    pages = spark.createDataFrame([("d", 1), ("e", 1)], "document_id string, page_number int")
    stats = {r.document_id: r for r in structure.document_statistics(pages, table).collect()}
    assert stats["d"].total_headings == 2 and stats["d"].average_section_length == 1.0
    assert stats["e"].total_sections == 0 and stats["e"].average_section_length == 0.0


def test_validation_reports_the_first_failure(spark):
    data = [("d", [1], "t", {"a": "b"}, "ok", 5), ("d", [1], "t", {"a": "b"}, " ", 5), ("", [1], "t", {"a": "b"}, "x", 5),
            ("d", [], "t", {"a": "b"}, "x", 5), ("d", [1], "", {"a": "b"}, "x", 5), ("d", [1], "t", {}, "x", 5),
            ("d", [1], "t", {"a": "b"}, "x", 513)]
    df = spark.createDataFrame(data, "document_id string, page_numbers array<int>, section_title string, "
                                     "metadata map<string,string>, content string, estimated_tokens int")
    assert [r.reject_reason for r in C.validate_chunks(df).collect()] == [
        None, "empty_content", "missing_document_id", "missing_page_numbers", "missing_section_title",
        "missing_metadata", "too_many_tokens"]
    empty = C.chunk_statistics(df.withColumn("char_count", F.length("content")).limit(0)).first()
    assert empty.total_chunks == 0 and empty.average_tokens == 0.0


def test_texts_of_pairs_are_not_gathered(spark):
    """Numbering finds the pairs; only the short first piece of a pair travels, no text is collected by document."""
    chunks = spark.createDataFrame(
        [("d", i, [i], f"t{i}", kind, level, c, tok(c), len(c))
         for i, (c, kind, level) in enumerate([("a" * 8, "list", 3), ("b" * 60, "list", 2), ("c" * 8, "table", 1), ("e" * 8, "list", 4)])],
        "document_id string, chunk_order long, page_numbers array<int>, section_title string, "
        "section_type string, hierarchy_level int, content string, estimated_tokens int, char_count int")
    out = corpus.optimize_chunks(chunks, min_tokens=8, max_tokens=30)
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = [(r.chunk_order, r.page_numbers, r.section_title, r.section_type, r.hierarchy_level, r.content)
           for r in out.orderBy("chunk_order").collect()]
    assert got == [(0, [0, 1], "t0", "list", 2, "a" * 8 + "\n\n" + "b" * 60), (1, [2, 3], "t2", "composite", 1, "c" * 8 + "\n\n" + "e" * 8)]


def test_line_rules_with_cheap_tests_equal_the_plain_patterns(spark):
    odd = ["", " ", "\t1. tab", " 2) nbsp", "٣ digits", "Section 4", "sECTION 4: x", "part 2 y", "Chapter 1 z", "chair 3", "1.2.3 - a",
           "(a) item", "(A1)  item", "- dash", "*　star", "• dot", "– en", "overview", "Overviews", "OVERVIEW of", "Table of Contents",
           "a | b", "x   y   z", "x\t\t\ty   z", "u\xa0\xa0\xa0v \u2003 w", "a \x1c b \t c", "a\n\n\nb", "UPPER CASE", "Title Case", "ǅtitle", "# Mark", "#Mark", "\x1f7 unit", "word\x85"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(odd)], "n int, line string")
    c = F.col("line")
    got = df.select("n", structure._numbered(c).alias("a"), structure._item(c).alias("b"), (structure._rule(c) == "keyword").alias("k"),
                    structure._wide_gaps(c).alias("g"), c.rlike(structure.WIDE_GAPS).alias("g0"),
                    structure._stripped(c).alias("s"), c.rlike(structure.NUMBERED).alias("a0"),
                    (c.rlike(structure.BULLET) | c.rlike(structure.NUMBERED_ITEM)).alias("b0"), c.rlike(structure.KEYWORD).alias("k0"), strip(c).alias("s0")).collect()
    assert all((r.a, r.b, r.g, r.s) == (r.a0, r.b0, r.g0, r.s0) for r in got)
    assert all(r.k == r.k0 for r in got if not r.a0)


def test_a_filter_on_headings_does_not_strip_lines_again(spark):
    pages = spark.createDataFrame([("d", 1, " # A \nb\n1.2 C ")], "document_id string, page_number int, text string")
    found = structure.detect_heading(structure.page_lines(pages)).filter("is_heading")
    assert [(r.line_no, r.heading_title, r.heading_level) for r in found.orderBy("line_no").collect()] == [(0, "A", 1), (2, "1.2 C", 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "trim(" not in plan[plan.index("Filter"):plan.index("Generate")]


ODD_LINES = ["", " ", "\t1. tab", " 2) nbsp", "٣ digits", "Section 4", "sECTION 4: x", "part 2 y", "chair 3", "1.2.3.4.5.6 deep", "1.2. Two",
             "ſection 4 x", "Part", "(a) item", "(A1)  item", "- dash", "*　star", "• dot", "-x", "overview", "Overviews", "Results_x",
             "INTRODUCTIONé", "a | b", "| x", "x   y   z", "x   y", "u\xa0\xa0\xa0v   w", "a \x1c b \t c", "UPPER CASE", "ÀÉ CAS", "Title Case",
             "Title Case.", "Été Là", "ǅ", "# Mark", "#Mark", "####### seven", "# ", "\x1f7 unit", "word\x85", "日本語   日本   語", "😀 Title",
             "a\rb", "(Z) Title", "1) Title", "A-Title b", "ABC", "ABCD", "x" * 120, "1 " + "x" * 120, "Overview " + "y" * 90]


def test_lines_typed_by_columns_equal_the_line_rules(spark):
    lines = spark.createDataFrame([(i, s) for i, s in enumerate(ODD_LINES)], "n int, line string").withColumn("line", strip("line"))
    want = structure.classify_lines(lines).withColumn("rule", structure._rule(F.col("line"))).orderBy("n").collect()
    kinds, rules = structure.line_kinds(pa.array([r.line for r in want]))
    assert [structure.KINDS[k] for k in kinds] == [r.line_type for r in want]
    assert [structure.RULES[k] for k in rules] == [r.rule for r in want]


def test_page_sections_run_over_columns_of_lines(spark, monkeypatch):
    """A line-by-line pass took most of the time of every query on sections; pages may be cut into several passes."""
    monkeypatch.setattr(columns, "PASS_BYTES", 40)
    rng = random.Random(2)
    texts = ["\n".join(rng.choice(ODD_LINES) for _ in range(rng.randint(1, 9))) for _ in range(60)] + [None, "", "\n\n"]
    pages = spark.createDataFrame([(i % 5 or None, i, t) for i, t in enumerate(texts)], "document_id int, page_number int, text string")
    paged = structure.page_sections(pages)
    assert "MapInArrow" in paged._jdf.queryExecution().optimizedPlan().toString()
    lines = structure.classify_lines(structure.page_lines(pages)).orderBy("page_number", "line_no").collect()
    want = {i: [] for i, t in enumerate(texts)}
    for page, own in itertools.groupby(lines, key=lambda r: r.page_number):
        before = "blank"
        for r in own:
            if r.line_type != "blank" and (r.line_type == "heading" or r.line_type != before):
                title = {"table": "Table", "list": "List Block", "paragraph": "Paragraph"}.get(r.line_type)
                want[page].append([r.line_type, f"{title} (Page {page})" if title else r.heading_title,
                                   {"table": 3, "list": 3, "paragraph": 4}.get(r.line_type, r.heading_level), []])
            if r.line_type != "blank":
                want[page][-1][3].append(r.line)
            before = r.line_type
    got = {r.page_number: r for r in paged.collect()}
    assert got[60].sections is None and got[60].section_count is None
    for page, sections in want.items():
        if page != 60:
            assert [(*s, c) for s, c in zip(got[page].sections, got[page].contents, strict=True)] == [(k, t, n, len("\n".join(c)), "\n".join(c)) for k, t, n, c in sections]
            assert got[page].document_id == (page % 5 or None) and got[page].section_count == len(sections)


def test_a_page_is_numbered_before_its_sections_become_rows(spark):
    paged = structure.page_sections(spark.createDataFrame([("d", 1, "# A\nb"), ("d", 2, "c")], "document_id string, page_number int, text string"))
    found = structure.number_sections(paged)
    assert [(r.reading_order, r.title) for r in found.orderBy("reading_order").collect()] == [
        (0, "A"), (1, "Paragraph (Page 1)"), (2, "Paragraph (Page 2)")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")
    slim = found.drop("content")._jdf.queryExecution().optimizedPlan().toString()
    assert "contents" not in slim[:slim.index("MapInArrow")]


def banner_pages(spark):
    bodies = ["Text of page", "a  b\tc", "", "Head   line", "12345", "é x", "日本語　頁", "x\r\ny"]
    rng = random.Random(4)
    data = [(f"d{d}", n, None if rng.random() < 0.05 else "\n".join(
        ["  Head \t line", *[rng.choice(bodies) for _ in range(rng.randint(0, 6))], "日本語 頁"]))
        for d in range(9) for n in range(1 + d)]
    return spark.createDataFrame(data, "document_id string, page_number int, text string"), data


def clean_text(text):
    return "" if text is None else re.sub("\r\n|\r", "\n", text).replace(" ", " ").replace("​", "")


def test_clean_pages_take_lines_by_columns(spark, monkeypatch):
    """Lines were compared with the repeated ones in a lambda over each page, edges were cut from all its lines."""
    monkeypatch.setattr(columns, "PASS_BYTES", 50)
    pages, data = banner_pages(spark)
    found = {}
    for r in cleaning.detect_header_footer(pages).collect():
        found.setdefault(r.document_id, set()).add(r.line)
    assert found["d8"] >= {"Head line", "日本語 頁"}
    cleaned = cleaning.clean_pages(pages)
    assert "MapInArrow" in cleaned._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.document_id, r.page_number): r for r in cleaned.collect()}
    assert len(got) == len(data)
    for d, n, text in data:
        lines = [x.strip() for x in clean_text(text).split("\n") if " ".join(x.split()) not in found.get(d, ())]
        want = re.sub("\n{3,}", "\n\n", re.sub("[ \t]{2,}|\t", " ", "\n".join(lines))).strip()
        assert (got[d, n].text, got[d, n].raw_chars, got[d, n].clean_chars) == (want, len(text or ""), len(want))


def test_large_chunks_are_split_by_columns(spark, monkeypatch):
    monkeypatch.setattr(columns, "PASS_BYTES", 300)
    rng = random.Random(6)
    texts = [rng.choice(["\n", "\n\n", "\n\n\n"]).join(rng.choice([" ", "", "é"]) + "x" * rng.randint(0, 70) for _ in range(rng.randint(1, 25)))
             for _ in range(80)] + [" \n ", "", "y" * 500]
    chunks = spark.createDataFrame([(i, t, 99 if i == 80 else tok(t)) for i, t in enumerate(texts)],
                                   "document_id int, content string, estimated_tokens int")
    out = C.split_oversized(chunks, 30)
    assert "MapInArrow" in out._jdf.queryExecution().optimizedPlan().toString()
    got = {}
    for r in out.orderBy("document_id", "piece").collect():
        assert r.piece == len(got.setdefault(r.document_id, [])) and r.estimated_tokens == tok(r.content or "")
        got[r.document_id].append(r.content)
    for i, t in enumerate(texts):
        assert got[i] == ([None] if i == 80 else split(t, 30) if tok(t) > 30 else [t])


def test_page_texts_move_to_chunks_once(spark):
    """With the texts of whole pages, packing gives the chunks of packing with a text beside every section."""
    rng = random.Random(9)
    pages = spark.createDataFrame([(f"d{d}", n, "\n\n".join(rng.choice(["# Head", "- a\n- b", "k | v", "text " * rng.randint(1, 30) + "."])
                                                            for _ in range(rng.randint(1, 9)))) for d in range(4) for n in range(1, 8)],
                                  "document_id string, page_number int, text string")
    paged = structure.page_sections(pages)
    numbered = structure.number_sections(paged)
    want = sorted(map(tuple, C.semantic_chunks(numbered, max_tokens=30, overlap=5).collect()))
    found = C.semantic_chunks(numbered.drop("content"), max_tokens=30, overlap=5, pages=paged)
    assert sorted(map(tuple, found.collect())) == want and any(len(r[2]) > 1 for r in want)
