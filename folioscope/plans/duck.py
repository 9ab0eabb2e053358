"""SQL building blocks of the DuckDB checks, written independently of the Spark plans."""

from __future__ import annotations

from folioscope.functions import vocab as V
from folioscope.plans.inputs import QUESTION_TEXTS

WS = (r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
NWS = WS.replace("[", "[^", 1)
CASED = r"\p{Lu}\p{Ll}\p{Lt}"
NL = "chr(10)"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def qlist(values: list[str]) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]::VARCHAR[]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def squash(x: str) -> str:
    return strip(f"regexp_replace({x}, '{WS}+', ' ', 'g')")


def tokens(n: str) -> str:
    return f"greatest(1, CAST(round_even(CAST({n} AS DOUBLE) / 4.0, 0) AS INTEGER))"


def estimate(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '{NWS}') THEN {tokens(f'length({x})')} ELSE 0 END"


def half_even(x: str, digits: int) -> str:
    scale = float(10 ** digits)
    return f"(round_even(CAST({x} AS DOUBLE) * {scale}::DOUBLE, 0) / {scale}::DOUBLE)"


def contains_any(x: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(t)})" for t in terms) + ")"


def with_(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


# ---- corpora -----------------------------------------------------------------------------
CORPUS = """corpus AS (
  SELECT source AS document_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page_number, text
  FROM documents)"""



def with_banners(pages: str) -> str:
    """``corpus``: ``pages`` with a first and a last line on nine of ten pages."""
    return f"""corpus AS (SELECT document_id, page_number, CASE WHEN page_number % 10 <> 0 THEN 'Records of ' || document_id
  || {NL} || text || {NL} || 'Notice to readers of ' || document_id ELSE text END AS text FROM {pages})"""


BANNER_CORPUS = CORPUS.replace("corpus AS", "plain AS", 1) + ",\n" + with_banners("plain")

RENDERED_BASE = """rendered_base AS (
  SELECT 'customer-' || o_custkey AS document_id,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page_number,
         CAST(o_orderkey AS VARCHAR) AS k, o_orderstatus AS st, o_orderpriority AS pr,
         CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day,
         CAST(floor(o_totalprice / 6000.0) AS INTEGER) AS n
  FROM orders)"""
RENDERED = RENDERED_BASE + f""",
rendered AS (
  SELECT document_id, page_number, array_to_string([
    CASE st WHEN 'F' THEN '## Order File ' || k
            WHEN 'O' THEN 'Section ' || page_number || '.1: ' || pr
            ELSE 'Overview of order ' || k END,
    '', CASE pr WHEN '5-LOW' THEN 'LOW PRIORITY NOTICE' WHEN '2-HIGH' THEN 'High Priority Order'
                ELSE 'the order follows the usual route.' END,
    '', 'The order ' || k || ' was placed on ' || day || '.',
    '', repeat('Shipment note ' || k || ' is on file for this order.' || {NL}, n) || 'end of notes for this order.',
    '', 'key | ' || k, 'revenue | ' || (page_number * 100),
    '', '- status ' || st, '- priority ' || pr], {NL}) AS text
  FROM rendered_base)"""

# ---- cleaning ----------------------------------------------------------------------------
HEADERS = f"""page_edges AS (
  SELECT document_id, page_number, list_filter(list_transform(string_split(text, {NL}),
         lambda x: {squash('x')}), lambda x: x <> '') AS ls FROM corpus),
edge_lines AS (
  SELECT document_id, 'header' AS kind, unnest(list_slice(ls, 1, 2)) AS line FROM page_edges
  UNION ALL
  SELECT document_id, 'footer', unnest(list_slice(ls, greatest(len(ls) - 1, 1), len(ls))) FROM page_edges),
doc_sizes AS (SELECT document_id, count(*) AS pages FROM corpus GROUP BY 1),
repeated AS (
  SELECT e.document_id, kind, line, count(*) AS occurrences, any_value(pages) AS pages
  FROM edge_lines e JOIN doc_sizes d USING (document_id)
  WHERE length(line) > 3 AND NOT regexp_matches(line, '^\\p{{Nd}}+$') AND pages >= 3
  GROUP BY 1, 2, 3
  HAVING count(*) >= greatest(2, floor(any_value(pages) * 0.75)))"""


def unix_lines(x: str) -> str:
    plain = f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    plain = f"replace(replace({plain}, chr(160), ' '), chr(8203), '')"
    return f"list_transform(string_split({plain}, {NL}), lambda x: {strip('x')})"


def collapse(x: str) -> str:
    return strip(f"regexp_replace({x}, '\\n{{3,}}', {NL} || {NL}, 'g')")


CLEANED = f"""rep AS (SELECT document_id, list(DISTINCT line) AS rep FROM repeated GROUP BY 1),
cleaned AS (
  SELECT document_id, page_number, length(text) AS raw_chars, {collapse(
    f"array_to_string(list_transform(list_filter({unix_lines('text')}, lambda x: NOT list_contains("
    f"coalesce(rep, []::VARCHAR[]), {squash('x')})), lambda x: regexp_replace(x, '[ \\t]+', ' ', 'g')), {NL})")} AS text
  FROM corpus LEFT JOIN rep USING (document_id))"""

# ---- structure ---------------------------------------------------------------------------
KEYWORDS = "|".join(V.HEADING_KEYWORDS)
MD = rf"^(#{{1,6}}){WS}+(.+)$"
NUM = rf"(?i)^(?:Section|Chapter|Part)?{WS}*(\p{{Nd}}+(?:\.\p{{Nd}}+)*){WS}*[:.-]?{WS}+(.+)$"
KEY = rf"(?i)^(?:{KEYWORDS})\b"
BULLET = rf"^{WS}*[-*•–—]{WS}+(.+)$"
ITEM = rf"(?i)^{WS}*(?:\p{{Nd}}+[.)]|\([a-z0-9]+\)){WS}+(.+)$"
TABLE = rf"\||(?:{WS}{{3,}}{NWS}+){{2,}}"


def lines_of(pages: str) -> str:
    split = f"string_split(text, {NL})"
    return f"""raw_lines AS (
  SELECT document_id, page_number, generate_subscripts({split}, 1) - 1 AS line_no,
         unnest({split}) AS raw FROM {pages}),
lines AS (SELECT document_id, page_number, line_no, {strip('raw')} AS line FROM raw_lines)"""


TYPED = f"""ruled AS (
  SELECT *, CASE
    WHEN regexp_matches(line, '{MD}') THEN 'markdown'
    WHEN regexp_matches(line, '{NUM}') AND length(line) < 100 THEN 'numbered'
    WHEN regexp_matches(line, '{KEY}') AND length(line) < 80 THEN 'keyword'
    WHEN length(line) < 60 AND length(line) > 3 AND NOT suffix(line, '.') AND regexp_matches(line, '\\p{{Lu}}')
         AND NOT regexp_matches(line, '[\\p{{Ll}}\\p{{Lt}}]') THEN 'upper'
    WHEN length(line) < 60 AND length(line) > 3 AND NOT suffix(line, '.')
         AND regexp_matches(line, '[{CASED}]') AND NOT regexp_matches(line, '[{CASED}][\\p{{Lu}}\\p{{Lt}}]')
         AND NOT regexp_matches(line, '(^|[^{CASED}])\\p{{Ll}}')
         AND NOT regexp_matches(line, '{BULLET}') AND NOT regexp_matches(line, '{ITEM}') THEN 'title'
    END AS rule FROM lines),
typed AS (
  SELECT document_id, page_number, line_no, line, rule IS NOT NULL AS is_heading,
    CASE rule WHEN 'markdown' THEN {strip(f"regexp_extract(line, '{MD}', 2)")} ELSE
      CASE WHEN rule IS NULL THEN '' ELSE line END END AS heading_title,
    CASE rule WHEN 'markdown' THEN length(regexp_extract(line, '{MD}', 1))
      WHEN 'numbered' THEN least(4, 1 + length(regexp_replace(regexp_extract(line, '{NUM}', 1), '[^.]', '', 'g')))
      WHEN 'title' THEN 2 ELSE 1 END AS heading_level,
    CASE WHEN line = '' THEN 'blank' WHEN rule IS NOT NULL THEN 'heading'
      WHEN regexp_matches(line, '{TABLE}') THEN 'table'
      WHEN regexp_matches(line, '{BULLET}') OR regexp_matches(line, '{ITEM}') THEN 'list'
      ELSE 'paragraph' END AS line_type
  FROM ruled)"""

SECTIONS = f"""marked AS (
  SELECT *, CASE WHEN line_type <> 'blank' AND (line_type = 'heading' OR line_type IS DISTINCT FROM
       lag(line_type) OVER (PARTITION BY document_id, page_number ORDER BY line_no)) THEN 1 ELSE 0 END AS b
  FROM typed),
islands AS (
  SELECT *, sum(b) OVER (PARTITION BY document_id, page_number ORDER BY line_no) AS g FROM marked),
sections AS (
  SELECT document_id, page_number,
    row_number() OVER (PARTITION BY document_id ORDER BY page_number, g) - 1 AS reading_order,
    any_value(line_type) AS section_type,
    CASE any_value(line_type) WHEN 'heading' THEN any_value(heading_title)
      WHEN 'table' THEN 'Table (Page ' || page_number || ')'
      WHEN 'list' THEN 'List Block (Page ' || page_number || ')'
      ELSE 'Paragraph (Page ' || page_number || ')' END AS title,
    CASE any_value(line_type) WHEN 'heading' THEN any_value(heading_level)
      WHEN 'paragraph' THEN 4 ELSE 3 END AS level,
    string_agg(line, {NL} ORDER BY line_no) AS content
  FROM islands WHERE line_type <> 'blank' GROUP BY document_id, page_number, g)"""

TREE = """tree AS (
  SELECT *, greatest(
      CASE WHEN level > 1 THEN l1 END, CASE WHEN level > 2 THEN l2 END, CASE WHEN level > 3 THEN l3 END,
      CASE WHEN level > 4 THEN l4 END, CASE WHEN level > 5 THEN l5 END) AS parent_order
  FROM (SELECT *, """ + ", ".join(
    f"max(CASE WHEN level = {k} THEN reading_order END) OVER w AS l{k}" for k in range(1, 6)) + """
    FROM sections WINDOW w AS (PARTITION BY document_id ORDER BY reading_order
                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))"""

STRUCTURE = with_(RENDERED, lines_of("rendered"), TYPED, SECTIONS, TREE)

# ---- chunking ----------------------------------------------------------------------------
PACK = f"""sized AS (
  SELECT *, length(content) AS chars, {tokens('length(content)')} AS tok FROM sections),
pack(document_id, reading_order, chunk_no, held, last_chars, last_tok, opened) AS (
  SELECT document_id, reading_order, 0, chars, chars, tok, false FROM sized WHERE reading_order = 0
  UNION ALL
  SELECT s.document_id, s.reading_order,
    CASE WHEN {tokens('p.held')} + s.tok > 512 THEN p.chunk_no + 1 ELSE p.chunk_no END,
    CASE WHEN {tokens('p.held')} + s.tok > 512
         THEN s.chars + CASE WHEN p.last_tok <= 50 THEN p.last_chars + 2 ELSE 0 END
         ELSE p.held + 2 + s.chars END,
    s.chars, s.tok, {tokens('p.held')} + s.tok > 512 AND p.last_tok <= 50
  FROM pack p JOIN sized s ON s.document_id = p.document_id AND s.reading_order = p.reading_order + 1),
members AS (
  SELECT document_id, chunk_no, reading_order FROM pack
  UNION ALL SELECT document_id, chunk_no, reading_order - 1 FROM pack WHERE opened),
governed AS (
  SELECT document_id, reading_order, last_value(CASE WHEN section_type = 'heading' THEN title END IGNORE NULLS)
      OVER w AS gtitle,
    last_value(CASE WHEN section_type = 'heading' THEN level END IGNORE NULLS) OVER w AS glevel
  FROM sections WINDOW w AS (PARTITION BY document_id ORDER BY reading_order)),
closing AS (
  SELECT document_id, chunk_no, coalesce(lead(min(reading_order)) OVER (PARTITION BY document_id ORDER BY chunk_no),
         max(reading_order)) AS reading_order FROM pack GROUP BY 1, 2),
packed AS (
  SELECT m.document_id, m.chunk_no AS chunk_order, list_sort(list(DISTINCT s.page_number)) AS page_numbers,
    CASE WHEN count(DISTINCT s.section_type) = 1 THEN any_value(s.section_type) ELSE 'composite' END AS section_type,
    count(*) AS section_count, string_agg(s.content, {NL} || {NL} ORDER BY m.reading_order) AS content
  FROM members m JOIN sections s USING (document_id, reading_order) GROUP BY 1, 2),
semantic AS (
  SELECT p.document_id, p.chunk_order, p.page_numbers, coalesce(g.gtitle, 'General') AS section_title,
    p.section_type, coalesce(g.glevel, 1) AS hierarchy_level, p.content, {estimate('p.content')} AS estimated_tokens,
    p.section_count
  FROM packed p JOIN closing c ON c.document_id = p.document_id AND c.chunk_no = p.chunk_order
  JOIN governed g ON g.document_id = c.document_id AND g.reading_order = c.reading_order)"""


def split_ctes(source: str) -> str:
    return f"""big AS (
  SELECT *, list_filter(list_transform(CASE WHEN contains(content, {NL} || {NL})
       THEN string_split(content, {NL} || {NL}) ELSE string_split(content, {NL}) END,
       lambda x: {strip('x')}), lambda x: x <> '') AS parts
  FROM {source} WHERE estimated_tokens > 512),
cut(document_id, chunk_order, i, piece, held) AS (
  SELECT document_id, chunk_order, 1, 0, length(parts[1]) FROM big
  UNION ALL
  SELECT b.document_id, b.chunk_order, c.i + 1,
    CASE WHEN {tokens('c.held + 2 + length(b.parts[c.i + 1])')} > 512 THEN c.piece + 1 ELSE c.piece END,
    CASE WHEN {tokens('c.held + 2 + length(b.parts[c.i + 1])')} > 512 THEN length(b.parts[c.i + 1])
         ELSE c.held + 2 + length(b.parts[c.i + 1]) END
  FROM cut c JOIN big b ON b.document_id = c.document_id AND b.chunk_order = c.chunk_order
  WHERE c.i < len(b.parts)),
pieces AS (
  SELECT b.document_id, b.chunk_order, c.piece, any_value(b.page_numbers) AS page_numbers,
    any_value(b.section_title) AS section_title, any_value(b.section_type) AS section_type,
    any_value(b.hierarchy_level) AS hierarchy_level,
    string_agg(b.parts[c.i], {NL} || {NL} ORDER BY c.i) AS content, true AS split_chunk
  FROM cut c JOIN big b ON b.document_id = c.document_id AND b.chunk_order = c.chunk_order
  GROUP BY 1, 2, 3
  UNION ALL
  SELECT document_id, chunk_order, 0, page_numbers, section_title, section_type, hierarchy_level, content, false
  FROM {source} WHERE estimated_tokens <= 512)"""


def merge_ctes(source: str) -> str:
    """``source`` has dense n from 0, tok, and the chunk columns."""
    return f"""walk(document_id, n, takes) AS (
  SELECT a.document_id, a.n, CASE WHEN a.tok < 30 AND a.tok + b.tok <= 512 THEN 2 ELSE 1 END
  FROM {source} a LEFT JOIN {source} b ON b.document_id = a.document_id AND b.n = a.n + 1 WHERE a.n = 0
  UNION ALL
  SELECT a.document_id, a.n, CASE WHEN a.tok < 30 AND a.tok + b.tok <= 512 THEN 2 ELSE 1 END
  FROM walk w JOIN {source} a ON a.document_id = w.document_id AND a.n = w.n + w.takes
  LEFT JOIN {source} b ON b.document_id = a.document_id AND b.n = a.n + 1),
merged AS (
  SELECT w.document_id, w.n, w.takes = 2 AS merged, a.section_title,
    list_sort(CASE WHEN w.takes = 2 THEN list_distinct(list_concat(a.page_numbers, b.page_numbers))
              ELSE a.page_numbers END) AS page_numbers,
    CASE WHEN w.takes = 2 AND a.section_type <> b.section_type THEN 'composite' ELSE a.section_type END AS section_type,
    CASE WHEN w.takes = 2 THEN least(a.hierarchy_level, b.hierarchy_level) ELSE a.hierarchy_level END AS hierarchy_level,
    CASE WHEN w.takes = 2 THEN a.content || {NL} || {NL} || b.content ELSE a.content END AS content
  FROM walk w JOIN {source} a ON a.document_id = w.document_id AND a.n = w.n
  LEFT JOIN {source} b ON b.document_id = w.document_id AND b.n = w.n + 1)"""


NUMBERED_PIECES = f"""numbered AS (
  SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY chunk_order, piece) - 1 AS n,
         {estimate('content')} AS tok FROM pieces)"""

FINAL_CHUNKS = f"""final AS (
  SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY n) - 1 AS chunk_order, page_numbers,
    section_title, section_type, hierarchy_level, content, {estimate('content')} AS estimated_tokens,
    length(content) AS char_count FROM merged)"""

CHUNKING = (TYPED, SECTIONS, PACK, split_ctes("semantic"), NUMBERED_PIECES, merge_ctes("numbered"), FINAL_CHUNKS)
CHUNK_CTES = with_(RENDERED, lines_of("rendered"), *CHUNKING)
# the same from pages that have to be cleaned first
CLEAN_CHUNK_CTES = with_(RENDERED, with_banners("rendered"), HEADERS, CLEANED, lines_of("cleaned"), *CHUNKING)

# ---- questions ---------------------------------------------------------------------------
QUESTIONS = f"""questions AS (
  SELECT 'turn-' || conv_id || '-' || turn AS query_id, text FROM conversations WHERE role = 'user'
  UNION ALL
  SELECT 'customer-' || c_custkey, ({qlist(QUESTION_TEXTS)})[c_nationkey + 1] FROM customer),
asked AS (
  SELECT query_id, text, CASE WHEN NOT regexp_matches(text, '{NWS}') THEN 'blank'
      WHEN length({strip('text')}) > 2048 THEN 'too_long' END AS error,
    CASE WHEN regexp_matches(text, '{NWS}') AND length({strip('text')}) <= 2048 THEN {squash('text')} ELSE '' END AS nq
  FROM questions),
valid AS (SELECT query_id, nq, lower(nq) AS lq FROM asked WHERE error IS NULL)"""
