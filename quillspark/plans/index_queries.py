"""Queries on the index run, vectors, ordered lookups and reports, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import indexing, results, search, snapshots, tables, vectors
from ..operators.ranking import l2_normalize
from ..sources import files
from ..streaming import events as stream
from ..workspace import Scratch
from .search_queries import bm25_sql, chunks, index_of, read, tokens_sql
from .text_queries import chunk_rows_sql, strip_sql

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- the index run ------------------------------------------------------------------------------
def _files(spark, sf_dir, before: str = "", mtime: float = 1.0) -> DataFrame:
    """Each document as a text file."""
    d = read(spark, sf_dir, "documents")
    text = F.concat(F.lit(before), F.coalesce("text", F.lit("")))
    return d.select("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.lit(mtime).alias("mtime"), F.encode(text, "UTF-8").alias("content"))


def _indexed(spark, sf_dir) -> indexing.Store:
    """A store after two runs: over the even documents, of which half are other texts and all have an earlier
    time, and over those that 5 doesn't divide."""
    store = indexing.Store(spark, Scratch(spark, "store").root)
    old = _files(spark, sf_dir, mtime=0.5).where("doc_id % 4 = 0").unionAll(_files(spark, sf_dir, "old ", 0.5).where("doc_id % 4 = 2"))
    store.index(old)
    return store


def _chunks_of(store: indexing.Store) -> DataFrame:
    place = F.expr("row_number() OVER (PARTITION BY path ORDER BY seq) - 1")
    return store.read("chunks").select("path", place.cast("int").alias("k"), F.md5(F.col("content").cast("binary")).alias("digest"))


def _chunks_sql(text: str, where: str) -> str:
    source = f"(SELECT 'f' || doc_id || '.txt' AS path, {text} AS text FROM documents WHERE {where})"
    return f"SELECT path, k, md5(chunk) AS digest FROM ({chunk_rows_sql('path', 'text', source, 300)})"


_SCANNED = "doc_id % 5 <> 0"


@query(_chunks_sql("coalesce(text, '')", _SCANNED))
def index_folder(spark, sf_dir):
    store = _indexed(spark, sf_dir)
    store.index(_files(spark, sf_dir).where(_SCANNED))
    return _chunks_of(store)


@query(f"""WITH n AS (SELECT count(*) AS n FROM ({_chunks_sql("coalesce(text, '')", _SCANNED)}))
SELECT count(*) FILTER (WHERE {_SCANNED}) AS scanned, count(*) FILTER (WHERE {_SCANNED} AND doc_id % 2 = 1) AS created, count(*) FILTER (WHERE {_SCANNED} AND doc_id % 4 = 2) AS updated,
  count(*) FILTER (WHERE {_SCANNED} AND doc_id % 4 = 0) AS skipped, count(*) FILTER (WHERE NOT ({_SCANNED}) AND doc_id % 2 = 0) AS pruned, (SELECT n FROM n) AS embedded, 0 AS failures,
  count(*) FILTER (WHERE {_SCANNED} AND doc_id % 4 <> 0) AS indexed FROM documents""")
def index_counters(spark, sf_dir):
    store = _indexed(spark, sf_dir)
    out = store.index(_files(spark, sf_dir).where(_SCANNED), model="m", encode=vectors.counting_encoder())
    return out.withColumns({c: F.col(c).cast("long") for c in ("pruned", "embedded")})


@query(_chunks_sql("CASE WHEN doc_id % 3 = 0 THEN 'again ' ELSE '' END || coalesce(text, '')", f"doc_id % 3 = 0 OR ({_SCANNED})"))
def reindex_listed(spark, sf_dir):
    store = indexing.Store(spark, Scratch(spark, "store").root)
    store.index(_files(spark, sf_dir).where(_SCANNED))
    store.index(_files(spark, sf_dir, "again ").where("doc_id % 3 = 0"), prune=False, force=True)
    return _chunks_of(store)


@query("""SELECT 'f' || doc_id || CASE WHEN doc_id % 7 = 0 THEN '.docx' WHEN doc_id % 7 = 1 THEN '.pdf' ELSE '.txt' END AS path, CASE WHEN doc_id % 7 < 2 THEN 'failed' ELSE 'ok' END AS status,
  CASE WHEN doc_id % 7 < 2 THEN 'f' || doc_id ELSE substr(ltrim(""" + strip_sql("coalesce(t, '')") + """, '#'), 1, 200) END AS title
FROM (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: """ + strip_sql("x") + """ <> '')[1] AS t FROM documents)""")
def failed_documents(spark, sf_dir):
    """Files that no reader can open are documents too, named by their file."""
    rows = _files(spark, sf_dir)
    kind = F.when(F.col("doc_id") % 7 == 0, ".docx").when(F.col("doc_id") % 7 == 1, ".pdf").otherwise(".txt")
    store = indexing.Store(spark, Scratch(spark, "store").root)
    store.index(rows.withColumn("path", F.concat(F.lit("f"), F.col("doc_id").cast("string"), kind)))
    return store.read("documents").select("path", "status", "title")


@query("SELECT 'c' || doc_id || '/pic.png' AS image_path FROM documents WHERE doc_id % 3 = 0")
def lingering_images(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    note = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit('{"image_path": "C'), F.col("doc_id").cast("string"), F.lit('/pic.png"}'))).otherwise(F.concat(F.lit('{"image_path": "c'), F.col("doc_id").cast("string"), F.lit('/pic.png"}')))
    folders = d.where("doc_id % 3 = 0").select(F.concat(F.lit("c"), F.col("doc_id").cast("string"), F.lit("/")).alias("folder"))
    return snapshots.lingering(d.select(note.alias("image_json")), folders).select(F.lower("image_path").alias("image_path"))


@query("SELECT vec_id FROM embeddings WHERE vec_id % 2 = 0 AND vec_id % 3 <> 0")
def stale_keys(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    return snapshots.stale(e.where("vec_id % 2 = 0"), e.where("vec_id % 3 = 0"), "vec_id")


@query("""WITH b AS (SELECT doc_id AS path, md5(text) AS h FROM documents WHERE doc_id % 2 = 0),
a AS (SELECT CASE WHEN doc_id % 10 = 0 THEN -1 - doc_id ELSE doc_id END AS path, CASE WHEN doc_id % 4 = 0 AND doc_id % 10 <> 0 THEN 'x' ELSE md5(text) END AS h FROM documents WHERE doc_id % 3 <> 1),
bo AS (SELECT * FROM b WHERE path NOT IN (SELECT path FROM a)), ao AS (SELECT * FROM a WHERE path NOT IN (SELECT path FROM b)),
m AS (SELECT h, min(path) AS source FROM bo GROUP BY h)
SELECT path, CASE WHEN source IS NULL THEN 'created' ELSE 'moved' END AS kind, source FROM ao LEFT JOIN m USING (h)
UNION ALL SELECT a.path, 'modified', NULL FROM a JOIN b USING (path) WHERE a.h <> b.h
UNION ALL SELECT path, 'deleted', NULL FROM bo WHERE path NOT IN (SELECT source FROM m JOIN ao USING (h))""")
def folder_changes(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    h = F.md5(F.col("text").cast("binary"))
    before = d.where("doc_id % 2 = 0").select(F.col("doc_id").alias("path"), h.alias("hash"))
    moved, other = F.col("doc_id") % 10 == 0, (F.col("doc_id") % 4 == 0) & (F.col("doc_id") % 10 != 0)
    after = d.where("doc_id % 3 <> 1").select(F.when(moved, -1 - F.col("doc_id")).otherwise(F.col("doc_id")).alias("path"), F.when(other, "x").otherwise(h).alias("hash"))
    return stream.changes(before, after)


@query("SELECT user_id, count(*) FILTER (WHERE gap IS NULL OR gap > 10800) AS starts, CAST(sum(least(coalesce(next, 10800), 10800)) AS BIGINT) AS busy_sec FROM (SELECT user_id, s - lag(s) OVER w AS gap, lead(s) OVER w - s AS next FROM (SELECT user_id, ts, epoch_us(ts) // 1000000 AS s FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts)) GROUP BY user_id")
def idle_restarts(spark, sf_dir):
    return stream.idle(read(spark, sf_dir, "events").selectExpr("user_id", "cast(ts as timestamp) AS ts"), 10_800)


@query("SELECT count(*) AS n FROM (SELECT lower(regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '\\.([A-Za-z0-9]+)$', 1)) AS e FROM pages) WHERE e IN ('txt', 'md', 'csv', 'log', 'docx', 'xlsx', 'pptx', 'hwpx', 'pdf', 'hwp', 'doc', 'xls', 'ppt', 'rtf')")
def supported_count(spark, sf_dir):
    return files.count_supported(read(spark, sf_dir, "pages").select(F.regexp_replace("url", r"[?#].*\z", "").alias("path")))


@query(f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'trash heap ' ELSE '' END || coalesce(text, '') AS text FROM documents WHERE doc_id % 5 <> 0)
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM (SELECT doc_id, unnest({tokens_sql('text')}) AS term FROM d) GROUP BY term""")
def index_refresh(spark, sf_dir):
    rows = chunks(spark, sf_dir)
    changed = rows.where("seq % 4 = 0").withColumn("content", F.concat(F.lit("trash heap "), "content"))
    index = search.refresh_index(index_of(spark, sf_dir), Scratch(spark, "index").root, changed, rows.where("seq % 5 = 0").select("seq"))
    return search.term_frequencies(index, "content")


@query(f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 < 4 THEN 'heap ' ELSE '' END || coalesce(text, '') AS text FROM documents WHERE doc_id % 7 < 4 OR doc_id % 11 <> 0),
t AS (SELECT doc_id, unnest({tokens_sql('text')}) AS term FROM d) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM t GROUP BY term""")
def segment_merge(spark, sf_dir):
    """Four changes one after the other, so that their segments become one; the last takes chunks out, too."""
    rows, index = chunks(spark, sf_dir), index_of(spark, sf_dir)
    none = rows.select("seq").limit(0)
    for i in range(4):
        changed = rows.where(f"seq % 7 = {i}").withColumn("content", F.concat(F.lit("heap "), "content"))
        index = search.refresh_index(index, Scratch(spark, "index").root, changed, rows.where("seq % 7 > 3 and seq % 11 = 0").select("seq") if i == 3 else none)
    return search.term_frequencies(index, "content")


_STORED_CHUNKS = f"""c AS (SELECT path || ' ' || k AS seq, 'text' AS type, chunk AS content, path AS file_name, 'encoding:utf-8-sig' AS keywords, '' AS caption FROM (
  {chunk_rows_sql('path', 'text', f"(SELECT 'f' || doc_id || '.txt' AS path, coalesce(text, '') AS text FROM documents WHERE {_SCANNED})", 300)}))"""


@query(bm25_sql("trash heap", require_all=False, limit=10**9, source=_STORED_CHUNKS, tail="SELECT file_name AS path, md5(content) AS digest, round(score, 6) AS score FROM top JOIN c USING (seq, content)"))
def store_search(spark, sf_dir):
    """What a store finds after it was filled, then files changed, came and went."""
    store = _indexed(spark, sf_dir)
    store.index(_files(spark, sf_dir).where(_SCANNED))
    found = store.search("trash heap", require_all=False, limit=None, keep=("path", "content"))
    return found.select("path", F.md5(F.col("content").cast("binary")).alias("digest"), F.round("score", 6).alias("score"))


@query("""WITH b AS (SELECT event_id, user_id % 20 AS p, floor(value) % 40 AS x, event_id % 37 AS y FROM events),
t AS (SELECT user_id % 20 AS p, floor(value) % 40 AS x, event_id % 37 AS y FROM events WHERE event_id % 500 = 0)
SELECT event_id FROM b WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.p = b.p AND
  greatest(least(b.x + 4, t.x + 9) - greatest(b.x, t.x), 0) * greatest(least(b.y + 3, t.y + 9) - greatest(b.y, t.y), 0) > 6)""")
def outside_tables(spark, sf_dir):
    e = read(spark, sf_dir, "events").selectExpr("event_id", "user_id % 20 AS page_id", "cast(floor(value) % 40 as double) AS x0", "cast(event_id % 37 as double) AS y0")
    blocks = e.selectExpr("*", "x0 + 4 AS x1", "y0 + 3 AS y1")
    boxes = e.where("event_id % 500 = 0").selectExpr("page_id", "x0", "y0", "x0 + 9 AS x1", "y0 + 9 AS y1")
    return tables.outside_tables(blocks, boxes).select("event_id")


@query("SELECT machine, event_type, CASE WHEN machine = 'a' THEN count(*) END AS n, CASE WHEN machine = 'b' THEN round(sum(value), 3) END AS total FROM events, (VALUES ('a'), ('b')) m(machine) GROUP BY machine, event_type")
def merged_reports(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return results.merge_reports({"a": e.groupBy("event_type").agg(F.count("*").alias("n")), "b": e.groupBy("event_type").agg(F.round(F.sum("value"), 3).alias("total"))})


# --- vectors --------------------------------------------------------------------------------------
_STATES = "list_transform(range(0, 4), lambda i: embedding[16 * i + 1:16 * i + 16]::DOUBLE[])"
_MASK = "[1.0::DOUBLE, (vec_id % 2)::DOUBLE, (vec_id % 3 > 0)::INT::DOUBLE, 0.0]"


def _pooled(spark, sf_dir, how: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    states = F.array(*[F.transform(F.slice("embedding", 16 * i + 1, 16), lambda x: x.cast("double")) for i in range(4)])
    mask = F.array(F.lit(1.0), (F.col("vec_id") % 2).cast("double"), (F.col("vec_id") % 3 > 0).cast("double"), F.lit(0.0))
    pooled = vectors.pool(states, mask, how)
    return e.select("vec_id", F.round(pooled[0], 6).alias("first"), F.round(F.aggregate(pooled, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query(f"""WITH s AS (SELECT vec_id, {_STATES} AS s, {_MASK} AS m FROM embeddings), p AS (SELECT vec_id, list_transform(range(1, 17), lambda d:
  list_sum(list_transform(range(1, 5), lambda i: s[i][d] * m[i])) / greatest(list_sum(m), 1e-9)) AS p FROM s)
SELECT vec_id, round(p[1], 6) AS first, round(list_sum(p), 6) AS total FROM p""")
def mean_pool(spark, sf_dir):
    return _pooled(spark, sf_dir, "mean")


@query("SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS first, round(list_sum(embedding[1:16]::DOUBLE[]), 6) AS total FROM embeddings")
def cls_pool(spark, sf_dir):
    return _pooled(spark, sf_dir, "cls")


_COUNTS = f"list_transform(range(0, 8), lambda i: len(list_filter({tokens_sql('content')}, lambda t: length(t) % 8 = i))::DOUBLE)"


@query(f"""WITH c AS (SELECT doc_id AS key, coalesce(text, '') AS content FROM documents WHERE doc_id % 3 <> 0), v AS (SELECT key, {_COUNTS} AS v FROM c)
SELECT key, 'm' AS model, round(CAST(v[4] / greatest(sqrt(list_dot_product(v, v)), 1e-12) AS FLOAT)::DOUBLE, 5) AS third FROM v""")
def embed_missing(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    there = d.where("doc_id % 3 = 0").select(F.col("doc_id").alias("key"), F.lit("m").alias("model")).unionAll(d.select("doc_id", F.lit("other")))
    found = vectors.embed_missing(d.select(F.col("doc_id").alias("key"), F.col("text").alias("content")), there, "m", vectors.counting_encoder())
    return found.select("key", "model", F.round(F.col("vector")[3].cast("double"), 5).alias("third"))


@query("SELECT vec_id AS key, 'a' AS model, round(CASE WHEN vec_id % 5 = 0 THEN 9 ELSE embedding[1] END::DOUBLE, 5) AS first FROM embeddings WHERE vec_id % 2 = 0 OR vec_id % 5 = 0 UNION ALL SELECT vec_id, 'b', round(embedding[1]::DOUBLE, 5) FROM embeddings WHERE vec_id % 3 = 0")
def upsert_vectors(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").selectExpr("vec_id AS key", "cast(embedding as array<float>) AS vector")
    old = e.where("key % 2 = 0").withColumn("model", F.lit("a")).unionByName(e.where("key % 3 = 0").withColumn("model", F.lit("b")))
    new = e.where("key % 5 = 0").withColumn("model", F.lit("a")).withColumn("vector", F.transform("vector", lambda x: F.lit(9.0).cast("float")))
    return vectors.upsert_vectors(old, new).select("key", "model", F.round(F.col("vector")[0].cast("double"), 5).alias("first"))


@query("SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 4) AS square FROM embeddings")
def vector_codec(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("vec_id", vectors.from_bytes(vectors.to_bytes(F.col("embedding"))).alias("v"))
    return e.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 4).alias("square"))


# --- lookups and reports ----------------------------------------------------------------------------
@query("SELECT CAST(row_number() OVER (ORDER BY md5('' || doc_id)) AS INT) AS pos, doc_id, md5(text) AS digest FROM documents QUALIFY pos <= 200")
def ordered_lookup(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    key = F.md5(F.col("doc_id").cast("string").cast("binary"))
    wanted = d.select("doc_id", key.alias("key")).orderBy("key").limit(200)
    wanted = wanted.select("doc_id", F.row_number().over(Window.orderBy("key")).alias("pos"))  # of 200 rows
    return results.in_order(wanted, d.select("doc_id", "text"), "doc_id").select("pos", "doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT c.id, CAST(p.pos AS INT) AS pos, d.doc_id AS chunk_id, md5(d.text) AS digest FROM (SELECT DISTINCT conv_id AS id FROM conversations) c, (VALUES (0), (1), (2)) p(pos) JOIN documents d ON d.doc_id = (c.id * (p.pos + 3)) % 150")
def case_excerpts(spark, sf_dir):
    cases = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id")).distinct()
    cases = cases.withColumn("chunk_ids", F.array(*[(F.col("id") * (i + 3)) % 150 for i in range(3)]))
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return results.excerpts_of_cases(cases, rows).select("id", "pos", "chunk_id", F.md5(F.col("text").cast("binary")).alias("digest"))


def _outcomes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    c = read(spark, sf_dir, "conversations")
    first = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("answer"))
    cases = c.select("conv_id").distinct().where("conv_id % 4 <> 1")
    keywords = F.array(F.array(F.lit("the"), F.lit("de")), F.array(F.lit("e")))
    return (
        first.select(F.col("conv_id").alias("case_id"), F.when(F.col("conv_id") % 5 == 0, F.lit("문서에서 찾을 수  없습니다.")).otherwise(F.col("answer")).alias("answer"), (F.col("conv_id") % 2 == 0).alias("needs_review")),
        cases.select(F.col("conv_id").alias("id"), (F.col("conv_id") % 3 == 0).alias("expect_abstain"), keywords.alias("keywords")),
    )


_JUDGED = """SELECT conv_id AS case_id, conv_id % 3 = 0 AS expect_abstain, conv_id % 5 = 0 AS abstained, conv_id % 2 = 0 AS needs_review, CASE WHEN conv_id % 5 = 0 THEN false ELSE
  (contains(s, 'the') OR contains(s, 'de')) AND contains(s, 'e') END AS keywords_hit FROM (SELECT conv_id, lower(regexp_replace(arg_min(text, turn), '\\s+', '', 'g')) AS s FROM conversations GROUP BY conv_id) WHERE conv_id % 4 <> 1"""


@query(_JUDGED)
def rescore_outcomes(spark, sf_dir):
    return results.rescore(*_outcomes(spark, sf_dir))[0].drop("answer")


@query("SELECT DISTINCT conv_id AS case_id FROM conversations WHERE conv_id % 4 = 1")
def rescore_unknown(spark, sf_dir):
    return results.rescore(*_outcomes(spark, sf_dir))[1]


_SLIPS = f"SELECT *, expect_abstain AND NOT abstained AS slip FROM ({_JUDGED})"


@query(f"SELECT count(*) FILTER (WHERE needs_review) AS flagged, count(*) FILTER (WHERE slip AND needs_review) AS caught, count(*) FILTER (WHERE slip AND NOT needs_review) AS missed,"
       " coalesce(string_agg(CAST(case_id AS VARCHAR), ',' ORDER BY case_id) FILTER (WHERE slip AND needs_review), '') AS caught_ids,"
       f" coalesce(string_agg(CAST(case_id AS VARCHAR), ',' ORDER BY case_id) FILTER (WHERE slip AND NOT needs_review), '') AS missed_ids FROM ({_SLIPS})")
def hallucination_report(spark, sf_dir):
    out = results.hallucinations(results.rescore(*_outcomes(spark, sf_dir))[0])
    return out.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in ("caught_ids", "missed_ids")})


@query(f"SELECT case_id, needs_review AS caught FROM ({_SLIPS}) WHERE slip")
def hallucination_cases(spark, sf_dir):
    return results.hallucination_cases(results.rescore(*_outcomes(spark, sf_dir))[0])


@query(f"""WITH j AS ({_JUDGED}), w AS (SELECT case_id, expect_abstain <> abstained OR NOT expect_abstain AND NOT keywords_hit AS wrong FROM j)
SELECT case_id, wrong FROM w ORDER BY wrong DESC, case_id LIMIT 40""")
def failures_first(spark, sf_dir):
    return results.failures_first(results.rescore(*_outcomes(spark, sf_dir))[0], 40).select("case_id", "wrong")


@query("""WITH r AS (SELECT event_type AS method, value % 1 AS s FROM events), a AS (SELECT method, min(s) AS least, median(s) AS median, avg(s) AS mean, count(*) FILTER (WHERE s >= 0.99) AS good,
  count(*) FILTER (WHERE s >= 0.95 AND s < 0.99) AS fair, count(*) FILTER (WHERE s < 0.95) AS poor FROM r GROUP BY method)
SELECT method, round(least, 6) AS least, round(median, 6) AS median, round(mean, 6) AS mean, good, fair, poor, method = (SELECT method FROM a ORDER BY median DESC, method LIMIT 1) AS best FROM a""")
def similarity_report(spark, sf_dir):
    out = results.similarity_report(read(spark, sf_dir, "events").selectExpr("event_type AS method", "value % 1 AS similarity"))
    return out.withColumns({c: F.round(c, 6) for c in ("least", "median", "mean")})


@query("""WITH r AS (SELECT DISTINCT user_id AS text_id, CASE WHEN event_id % 4 = 0 THEN 'path' ELSE 'symbol' END AS kind, event_type || event_id % 40 AS name FROM events),
k AS (SELECT DISTINCT event_type || event_id % 40 AS name FROM events WHERE event_id % 3 = 0 AND event_id % 40 < 30),
c AS (SELECT text_id, count(*) FILTER (WHERE kind = 'path') AS p, count(*) AS a, count(*) FILTER (WHERE kind = 'path' AND k.name IS NOT NULL) AS ph, count(k.name) AS h FROM r LEFT JOIN k USING (name) GROUP BY text_id),
n AS (SELECT text_id, CASE WHEN p >= 12 THEN p ELSE a END AS n, CASE WHEN p >= 12 THEN ph ELSE h END AS matched FROM c)
SELECT text_id, n, matched, round(matched / n, 6) AS ratio, n < 30 AS inconclusive, n >= 30 AND matched / n >= 0.5 AS belongs FROM n""")
def provenance(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    name = F.concat("event_type", (F.col("event_id") % 40).cast("string")).alias("name")
    refs = e.select(F.col("user_id").alias("text_id"), F.when(F.col("event_id") % 4 == 0, "path").otherwise("symbol").alias("kind"), name)
    return results.provenance(refs, e.where("event_id % 3 = 0 and event_id % 40 < 30").select(name), 12, 30).withColumn("ratio", F.round("ratio", 6))


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 5 OFFSET 10")
def result_page(spark, sf_dir):
    return results.page(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), [F.desc("n_chars"), "doc_id"], 2)


@query("WITH r AS (SELECT user_id AS job, event_id AS n, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INT) AS place, count(*) OVER (PARTITION BY user_id) AS c FROM events) SELECT job, n, place FROM r WHERE place % 50 = 0 OR place = c")
def progress_checkpoints(spark, sf_dir):
    return results.checkpoints(read(spark, sf_dir, "events").selectExpr("user_id AS job", "event_id AS n"), 50)


@query("SELECT doc_id, CASE WHEN doc_id % 4 <> 1 THEN source END AS caption, CASE WHEN doc_id % 4 <> 1 THEN lang END AS cell FROM documents")
def decode_tables(spark, sf_dir):
    note = F.to_json(F.struct(F.col("source").alias("caption"), F.array("lang").alias("header_row"), F.array(F.array("lang")).alias("rows")))
    d = read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 != 1, note).when(F.col("doc_id") % 8 == 1, F.substring(note, 1, 9)).alias("note"))
    return d.select("doc_id", results.decode_note(F.col("note"), results.TABLE).alias("t")).select("doc_id", "t.caption", F.col("t.rows")[0][0].alias("cell"))
