"""Registered queries: catalogue, collection tables, migration and log appends."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import vocab as V
from folioscope.operators import catalog as C
from folioscope.operators import usage as U
from folioscope.plans import duck as D, inputs as I
from folioscope.plans.q_corpus import DOCS
from folioscope.session import materialize, scratch_root
from folioscope.sources import collection as K
from folioscope.sources import pages as P
from folioscope.sources import tables as T

SLIM = ["chunk_id", "document_id", "document_name", "document_type", "section_type", "visibility"]


def document_catalog(spark, sf):
    return C.sorted_catalog(C.document_catalog(I.document_files(spark, sf), I.internal_names(spark, sf)))


def document_header(spark, sf):
    return C.document_header(I.document_files(spark, sf)).select("position", "file_type", "title", "reject_reason")


def pdf_discovery(spark, sf):
    return P.discover_files(spark, sf, "*.parquet").select("filename", "size_bytes")


def document_search(spark, sf):
    return U.document_totals(U.document_search(document_catalog(spark, sf), "Example.Com"))


def recent_documents(spark, sf):
    return U.recent_documents(document_catalog(spark, sf)).select("filename", "pages")


def access_audit(spark, sf):
    files = I.document_files(spark, sf)
    urls = I.table(spark, sf, "pages").select(F.col("page_id").alias("position"), "url")
    wanted = (F.when(F.contains("url", F.lit("#top")), F.concat(F.lit("..%2F"), "filename"))
              .when(F.contains("url", F.lit("/es/")), F.concat("filename", F.lit(".bak")))
              .otherwise(F.replace("filename", F.lit(" "), F.lit("%20"))))
    requests = files.join(urls, "position").select("position", wanted.alias("document_id"))
    return C.access_audit(requests, files, I.internal_names(spark, sf))


def _base(spark, sf):
    return I.document_chunks(spark, sf).select(*SLIM)


def _labelled(spark, sf):
    """Labelled documents as new rows: quality decides the section type."""
    labels = I.table(spark, sf, "labels").select(F.col("doc_id").alias("chunk_id"), "quality")
    return _base(spark, sf).join(labels, "chunk_id").withColumn("section_type", F.concat(
        F.lit("quality-"), F.col("quality").cast("string"))).select(*SLIM)


def collection_create(spark, sf):
    """Create both collections, fill them, replace labelled rows, delete a toxic source list, reset one."""
    store = K.CollectionStore(spark, f"{scratch_root(spark)}/collection-{uuid.uuid4().hex}")
    base = _base(spark, sf).withColumn("vector", F.array(F.lit(1.0)))
    for kind in (V.COMPANY, V.INSTRUCTION):
        store.create(base, kind, 384)
        store.upsert(base.filter(F.col("document_type") == kind), kind)
    labelled = _labelled(spark, sf).withColumn("vector", F.array(F.lit(1.0)))
    store.upsert(labelled.filter(F.col("document_type") == V.COMPANY), V.COMPANY)
    store.delete_documents(_toxic_sources(spark, sf), V.COMPANY)
    store.reset(base, V.INSTRUCTION, 384)
    return store.info()


def _toxic_sources(spark, sf):
    toxic = I.table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("chunk_id"))
    return _base(spark, sf).join(toxic, "chunk_id").groupBy("document_id").agg(F.count("*").alias("n")).filter("n >= 2")


def collection_metric(spark, sf):
    """Event types stand for metric names; unknown ones mean cosine."""
    name = F.when(F.col("event_type") == "view", "DOT").when(F.col("event_type") == "click", "Euclid").otherwise(F.col("event_type"))
    return I.table(spark, sf, "events").groupBy("event_type", K.collection_metric(name).alias("metric")).agg(
        F.count("*").alias("n"))


def collection_reset(spark, sf):
    return K.collection_reset(_base(spark, sf), _labelled(spark, sf), V.INSTRUCTION)


def collection_upsert(spark, sf):
    return K.collection_upsert(_base(spark, sf), _labelled(spark, sf))


def collection_delete_document(spark, sf):
    return K.collection_delete_document(_base(spark, sf), _toxic_sources(spark, sf)).select(*SLIM)


def collection_info(spark, sf):
    return K.collection_info(_base(spark, sf), ["company", "instruction", "archive"])


def indexed_documents(spark, sf):
    heading = F.col("section_type") == "heading"
    named = _base(spark, sf).withColumn("filename", F.when(heading, F.concat("document_name", F.lit(".pdf")))).withColumn(
        "document_name", F.when(~heading, F.col("document_name")))
    return K.indexed_documents(named)


def sample_points(spark, sf):
    return K.sample_points(I.document_chunks(spark, sf)).withColumn(
        "page_numbers", F.array_join(F.transform("page_numbers", lambda p: p.cast("string")), ","))


def collection_inspect(spark, sf):
    return K.collection_inspect(_base(spark, sf))


def index_verification(spark, sf):
    expected = I.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("document_name"))
    indexed = I.table(spark, sf, "embeddings").select((F.col("vec_id") * 3).cast("string").alias("document_name"))
    return K.index_verification(expected, indexed)


def append_prompt_log(spark, sf):
    """Append the prompts to a new log and read it back."""
    rows = I.prompts(spark, sf).withColumn("response", F.lit("ok")).withColumn(
        "sources", F.array(F.struct(F.col("team_name").alias("document"), F.col("id").cast("int").alias("page"))))
    path = f"{scratch_root(spark)}/prompt-log-{uuid.uuid4().hex}"
    T.append_prompt_log(rows, path)
    return spark.read.parquet(path).select(
        "team_name", "prompt", F.get_json_object("sources", "$[0].page").cast("long").alias("page"),
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("created_at"))


MOVES = [
    T.Move("audit_logs", parents={"team_id": "teams"}),
    T.Move("documents", parents={"team_id": "teams"}),
    T.Move("prompt_logs", stripped=("team_name",)),
    T.Move("events"),
    T.Move("teams", natural=("team_name",), generates=True, stripped=("team_name",)),
]


def _iso(ts):
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))


def _dump(spark, sf):
    """A text dump of five tables: teams, prompts, events (orders), documents and audit rows (events)."""
    log = I.table(spark, sf, "events")
    padded = F.concat(F.lit("  team-"), F.col("user_id").cast("string"), F.lit(" "))
    teams = log.groupBy("user_id").agg(F.min("ts").alias("ts")).select(
        F.col("user_id").cast("string").alias("id"), padded.alias("team_name"),
        F.to_json(F.array(F.concat(F.lit("member-"), F.col("user_id").cast("string")))).alias("member_names"), _iso("ts").alias("started_at"))
    prompts = log.filter(F.col("event_type").isin("view", "click")).select(
        F.col("event_id").cast("string").alias("id"), padded.alias("team_name"), F.col("props").alias("prompt"), _iso("ts").alias("created_at"))
    events = I.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("name"),
        (F.col("o_orderkey") % 20).cast("string").alias("question_limit"),
        F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("created_at"))
    documents = I.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"),
        F.col("n_chars").cast("string").alias("file_size"), (F.col("doc_id") % 170).cast("string").alias("team_id"))
    audit = log.select(F.col("event_id").cast("string").alias("id"), F.when(
        F.col("event_type") != "error", F.col("user_id").cast("string")).alias("team_id"), "event_type", _iso("ts").alias("timestamp"))
    return {"teams": teams, "prompt_logs": prompts, "events": events, "documents": documents, "audit_logs": audit}


TEAM_SHIFT = 5000   # keys that the target gave to its own teams


def _there(spark, sf):
    """What the target holds before the move: teams that bought something, under keys of its own, and some of the rest."""
    rows = {name: T.converted(df, spark.createDataFrame([], TARGETS[name])) for name, df in _dump(spark, sf).items()}
    buyers = materialize(I.table(spark, sf, "events").groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "purchase").alias("n")).filter("n > 10").select(F.col("user_id").alias("team_id")), "buyers")
    teams = rows["teams"].join(buyers, F.col("id") == F.col("team_id"), "left_semi").withColumn("id", F.col("id") + TEAM_SHIFT)
    teams = teams.withColumn("team_name", F.trim("team_name"))
    prompts = rows["prompt_logs"].filter("id % 3 = 0").withColumn("team_name", F.trim("team_name"))
    documents = rows["documents"].filter("id % 4 = 0").join(buyers, "team_id", "left_semi").withColumn("team_id", F.col("team_id") + TEAM_SHIFT)
    audit = rows["audit_logs"].filter("id % 7 = 0 and team_id is null")
    return {"teams": teams, "prompt_logs": prompts, "events": rows["events"].filter("id % 5 = 0"),
            "documents": documents.select(*rows["documents"].columns), "audit_logs": audit}


TARGETS = {
    "teams": "id long, team_name string, member_names array<string>, started_at timestamp",
    "prompt_logs": "id long, team_name string, prompt string, created_at timestamp",
    "events": "id long, name string, question_limit int, created_at timestamp",
    "documents": "id long, filename string, file_size long, team_id long",
    "audit_logs": "id long, team_id long, event_type string, timestamp timestamp",
}


def migrate_if_absent(spark, sf):
    """The new rows of all five tables, as text beside their keys."""
    moved = T.migrate_cascade(MOVES, _dump(spark, sf), _there(spark, sf))
    parts = []
    for name, table in moved.items():
        rows = table.inserted
        team = F.col("team_id") if "team_id" in rows.columns else F.lit(None).cast("long")
        rest = [c for c in rows.columns if c not in ("id", "team_id")]
        parts.append(rows.select(F.lit(name).alias("table_name"), "id", team.alias("team_id"), T.row_text(rows, rest).alias("content")))
    return reduce(DataFrame.unionByName, parts)


def migration_reconcile(spark, sf):
    source, target = _dump(spark, sf), _there(spark, sf)
    return T.reconcile_cascade(MOVES, source, target, T.migrate_cascade(MOVES, source, target))


def add_sources_column(spark, sf):
    prompts = I.prompts(spark, sf)
    old = T.add_sources_column(T.add_sources_column(prompts))
    new = prompts.withColumn("sources", F.array(F.struct(F.lit("a").alias("document"), F.lit(1).alias("page"))))
    rows = T.union_evolved(prompts, new).unionByName(old)
    return rows.groupBy("team_name").agg(F.count("*").alias("rows"), F.count("sources").alias("with_sources"))


QUERIES = {name: globals()[name] for name in (
    "document_catalog document_header pdf_discovery document_search recent_documents access_audit collection_create "
    "collection_metric collection_reset collection_upsert collection_delete_document collection_info indexed_documents "
    "sample_points collection_inspect index_verification append_prompt_log migrate_if_absent migration_reconcile "
    "add_sources_column").split()}

FILES = f"""named AS (SELECT page_id AS position, url, html, CASE WHEN contains(url, 'page=2') THEN '.' ELSE '' END ||
  regexp_extract(url, '^https?://([^/]+)', 1) || '_annual-report' || CASE WHEN contains(url, '/de/') THEN ' Instruction' ELSE '' END ||
  CASE WHEN contains(url, 'https') THEN '.pdf' WHEN contains(url, '#top') THEN '' ELSE '.Txt' END AS name FROM pages),
files AS (SELECT position, url, CASE WHEN contains(url, '?') THEN upper(name) ELSE name END AS filename,
  CAST(length(html) AS BIGINT) AS size_bytes, CAST(length(html) // 4000 AS INTEGER) AS pages FROM named),
parts AS (SELECT *, regexp_extract(filename, '(?s)^(.+)\\.([^.]+)$', 2) AS ext,
  regexp_extract(filename, '(?s)^(.+)\\.([^.]+)$', 1) AS stem FROM files),
hidden AS (SELECT DISTINCT lower(filename) AS low FROM files WHERE contains(url, 'ref=x')),
catalog AS (SELECT filename, CASE WHEN ext = '' THEN 'PDF' ELSE upper(ext) END AS file_type, size_bytes,
  greatest(1, pages) AS pages, 'Available' AS status FROM (
  SELECT *, row_number() OVER (PARTITION BY lower(filename) ORDER BY position) AS n FROM parts
  WHERE NOT starts_with(filename, '.') AND NOT contains(lower(filename), 'instruction')
    AND lower(filename) NOT IN (SELECT low FROM hidden)) WHERE n = 1)"""
SLIM_SQL = ", ".join(SLIM)
NEW = f"""fresh AS (SELECT d.* REPLACE ('quality-' || l.quality AS section_type) FROM docs d JOIN labels l ON l.doc_id = d.chunk_id),
toxic AS (SELECT document_id FROM docs d JOIN labels l ON l.doc_id = d.chunk_id WHERE toxic = 1 GROUP BY 1 HAVING count(*) >= 2)"""
WHEN = "%Y-%m-%d %H:%M:%S.%f"
MIGRATION = f"""teams AS (SELECT user_id AS id, 'team-' || user_id || '|[member-' || user_id || ']|' || strftime(min(ts), '{WHEN}')
  AS content, count(*) FILTER (event_type = 'purchase') AS bought FROM events GROUP BY user_id),
new_teams AS (SELECT (SELECT coalesce(max(id) + {TEAM_SHIFT}, 0) FROM teams WHERE bought > 10)
  + row_number() OVER (ORDER BY id) AS id, id AS old_id, content FROM teams WHERE bought <= 10),
team_keys AS (SELECT t.id, t.bought, coalesce(n.id, t.id + {TEAM_SHIFT}) AS new_id FROM teams t LEFT JOIN new_teams n ON n.old_id = t.id),
prompts AS (SELECT event_id AS id, 'team-' || user_id || '|' || coalesce(props, '<null>') || '|' || strftime(ts, '{WHEN}') AS content
  FROM events WHERE event_type IN ('view', 'click')),
orders_text AS (SELECT o_orderkey AS id, o_orderpriority || '|' || o_orderkey % 20 || '|'
  || strftime(CAST(o_orderdate AS TIMESTAMP), '{WHEN}') AS content FROM orders),
docs_text AS (SELECT doc_id AS id, 'doc-' || doc_id || '.pdf|' || n_chars AS content, doc_id % 170 AS team_id FROM documents),
audit AS (SELECT event_id AS id, CASE WHEN event_type <> 'error' THEN user_id END AS team_id,
  event_type || '|' || strftime(ts, '{WHEN}') AS content FROM events)"""

ORACLES = {
    "document_catalog": D.with_(FILES) + "SELECT * FROM catalog",
    "document_header": D.with_(FILES) + f"""SELECT position, CASE WHEN ext = '' THEN 'pdf' ELSE lower(ext) END AS file_type,
array_to_string(list_transform(regexp_extract_all(lower(replace(replace(CASE WHEN ext = '' THEN filename ELSE stem END, '_', ' '),
  '-', ' ')), '[{D.CASED}]+|[^{D.CASED}]+'), lambda r: upper(r[1]) || r[2:]), '') AS title,
CASE WHEN ext <> '' AND lower(ext) <> 'pdf' THEN 'unsupported_format' END AS reject_reason FROM parts""",
    "document_search": D.with_(FILES) + """SELECT count(*) AS documents, CAST(coalesce(sum(pages), 0) AS BIGINT) AS total_pages
FROM catalog WHERE contains(lower(filename), 'example.com')""",
    "recent_documents": D.with_(FILES) + "SELECT filename, pages FROM catalog ORDER BY lower(filename) LIMIT 4",
    "access_audit": D.with_(FILES) + """SELECT position, CASE WHEN contains(url, '#top') THEN '..%2F' || filename
  WHEN contains(url, '/es/') THEN filename || '.bak' ELSE replace(filename, ' ', '%20') END AS document_id,
CASE WHEN contains(url, '#top') THEN 400
  WHEN contains(lower(filename), 'instruction') THEN 403
  WHEN contains(url, '/es/') THEN 404
  WHEN lower(filename) IN (SELECT low FROM hidden) THEN 403 ELSE 200 END AS status_code FROM files""",
    "collection_create": D.with_(DOCS, NEW) + """SELECT 'company' AS document_type, count(*) AS points_count, 'green' AS status
FROM docs WHERE document_type = 'company' AND document_id NOT IN (SELECT document_id FROM toxic)
UNION ALL SELECT 'instruction', 0, 'green'""",
    "collection_metric": """SELECT event_type, CASE event_type WHEN 'view' THEN 'Dot' WHEN 'click' THEN 'Euclid' ELSE 'Cosine' END
AS metric, count(*) AS n FROM events GROUP BY 1, 2""",
    "collection_reset": D.with_(DOCS, NEW) + f"""SELECT {SLIM_SQL} FROM docs WHERE document_type <> 'instruction'
UNION ALL SELECT {SLIM_SQL} FROM fresh WHERE document_type = 'instruction'""",
    "collection_upsert": D.with_(DOCS, NEW) + f"""SELECT {SLIM_SQL} FROM docs WHERE chunk_id NOT IN (SELECT chunk_id FROM fresh)
UNION ALL SELECT {SLIM_SQL} FROM fresh""",
    "collection_delete_document": D.with_(DOCS, NEW) + f"""SELECT {SLIM_SQL} FROM docs
WHERE document_id NOT IN (SELECT document_id FROM toxic)""",
    "collection_info": D.with_(DOCS) + """SELECT document_type, count(*) AS points_count, 'green' AS status FROM docs GROUP BY 1
UNION ALL SELECT 'archive', 0, 'NOT_FOUND'""",
    "indexed_documents": D.with_(DOCS) + """SELECT DISTINCT CASE WHEN section_type = 'heading' THEN document_name || '.pdf'
ELSE document_name END AS document_name FROM docs""",
    "sample_points": D.with_(DOCS) + """SELECT chunk_id, document_name, section_title, array_to_string(page_numbers, ',')
AS page_numbers FROM docs ORDER BY chunk_id LIMIT 10""",
    "collection_inspect": D.with_(DOCS) + """SELECT document_type, count(*) AS points, count(DISTINCT document_name) AS documents,
min(chunk_id) AS sample_chunk, arg_min(document_name, chunk_id) AS sample_document,
arg_min(visibility, chunk_id) AS sample_visibility FROM docs GROUP BY 1""",
    "index_verification": """WITH e AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS n FROM documents),
i AS (SELECT DISTINCT CAST(vec_id * 3 AS VARCHAR) AS n FROM embeddings)
SELECT n AS document_name, 'missing' AS problem FROM e WHERE n NOT IN (SELECT n FROM i)
UNION ALL SELECT n, 'unexpected' FROM i WHERE n NOT IN (SELECT n FROM e)""",
    "append_prompt_log": """SELECT 'team-' || user_id AS team_name, props AS prompt, event_id AS page,
strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS created_at FROM events WHERE event_type IN ('view', 'click')""",
    "migrate_if_absent": D.with_(MIGRATION) + """SELECT 'teams' AS table_name, id, CAST(NULL AS BIGINT) AS team_id, content
FROM new_teams UNION ALL
SELECT 'prompt_logs', id, NULL, content FROM prompts WHERE id % 3 <> 0 UNION ALL
SELECT 'events', id, NULL, content FROM orders_text WHERE id % 5 <> 0 UNION ALL
SELECT 'documents', d.id, k.new_id, content FROM docs_text d JOIN team_keys k ON k.id = d.team_id
  WHERE NOT (d.id % 4 = 0 AND k.bought > 10) UNION ALL
SELECT 'audit_logs', a.id, k.new_id, content FROM audit a LEFT JOIN team_keys k ON k.id = a.team_id
  WHERE NOT (a.id % 7 = 0 AND a.team_id IS NULL)""",
    "migration_reconcile": D.with_(MIGRATION) + """, found AS (
SELECT 'teams' AS table_name, content AS source_text, content AS target_text, false AS orphan FROM teams UNION ALL
SELECT 'prompt_logs', id || '|' || content, id || '|' || content, false FROM prompts UNION ALL
SELECT 'events', id || '|' || content, id || '|' || content, false FROM orders_text UNION ALL
SELECT 'documents', d.id || '|' || content || '|' || coalesce('team-' || k.id, '<null>'),
  d.id || '|' || content || '|' || 'team-' || k.id, k.id IS NULL FROM docs_text d LEFT JOIN team_keys k ON k.id = d.team_id UNION ALL
SELECT 'audit_logs', id || '|' || coalesce('team-' || team_id, '<null>') || '|' || content,
  id || '|' || coalesce('team-' || team_id, '<null>') || '|' || content, false FROM audit),
counts AS (SELECT table_name, count(*) AS source_count, count(*) FILTER (NOT orphan) AS target_count,
  count(*) FILTER (orphan) AS orphan_count,
  CAST(sum(CAST('0x' || md5(source_text)[1:8] AS BIGINT)) % 2305843009213693952 AS BIGINT) AS source_checksum,
  CAST(coalesce(sum(CAST('0x' || md5(target_text)[1:8] AS BIGINT)) FILTER (NOT orphan), 0) % 2305843009213693952 AS BIGINT)
    AS target_checksum FROM found GROUP BY 1)
SELECT *, source_count = target_count AS matches, source_checksum = target_checksum AS contents_match FROM counts""",
    "add_sources_column": """SELECT 'team-' || user_id AS team_name, 3 * count(*) AS rows, count(*) AS with_sources
FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id""",
}
