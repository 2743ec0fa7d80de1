"""Search queries over ``documents`` as chunks, and their SQL."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ranking, search
from ..operators.evidence import select_excerpts
from ..workspace import Scratch, file_system


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one chunk; every seventh plays a table, every tenth has its first line as caption."""
    d = read(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("seq"), F.when(F.col("doc_id") % 7 == 0, "table").otherwise("text").alias("type"),
        F.coalesce("text", F.lit("")).alias("content"), F.concat("source", F.lit(".txt")).alias("file_name"), F.col("lang").alias("keywords"),
        F.when(F.col("doc_id") % 10 == 0, F.substring_index("text", "\n", 1)).otherwise("").alias("caption"), F.lit("").alias("heading"),
    )


CHUNKS_SQL = """c AS (SELECT doc_id AS seq, CASE WHEN doc_id % 7 = 0 THEN 'table' ELSE 'text' END AS type, coalesce(text, '') AS content,
  source || '.txt' AS file_name, lang AS keywords, CASE WHEN doc_id % 10 = 0 THEN split_part(text, chr(10), 1) ELSE '' END AS caption FROM documents)"""
COLUMNS = ["content", "file_name", "keywords", "caption"]


_INDEXES: dict[tuple, search.Index] = {}


def index_of(spark: SparkSession, sf_dir: str) -> search.Index:
    """The index of the chunks, built once for an application and a state of the documents' files."""
    files = []
    for name in read(spark, sf_dir, "documents").inputFiles():
        fs, path = file_system(spark, unquote(name))
        found = fs.getFileStatus(path)
        files.append((name, found.getLen(), found.getModificationTime()))
    key = (spark.sparkContext.applicationId, *sorted(files))
    if key not in _INDEXES:
        _INDEXES[key] = search.build_index(chunks(spark, sf_dir), Scratch(spark, "index").root)
    return _INDEXES[key]


def tokens_sql(column: str) -> str:
    return rf"regexp_extract_all(strip_accents(lower({column})), '[\p{{L}}\p{{N}}]+')"


def bm25_sql(query: str, *, exact=False, require_all=True, fallback=True, types=None, case_sensitive=False, limit=20, tail="SELECT seq, round(score, 6) AS score FROM top", source=CHUNKS_SQL) -> str:
    """BM25 as SQL, from the definition: the weighted instances of each phrase, and three statistics."""
    variants = T.term_variants(query)
    phrases = [(i, search.phrase_tokens(v)) for i, g in enumerate(variants) for v in g]

    def count(col: str, p: list[str]) -> str:
        last = (lambda x, w: f"{x} = '{w}'") if exact else (lambda x, w: f"starts_with({x}, '{w}')")
        if len(p) == 1:
            return f"len(list_filter({col}, lambda x: {last('x', p[0])}))"
        tests = [f"{col}[i + {j}] = '{w}'" for j, w in enumerate(p[:-1])] + [last(f"{col}[i + {len(p) - 1}]", p[-1])]
        return f"len(list_filter(range(1, len({col}) - {len(p) - 2}), lambda i: {' AND '.join(tests)}))"

    hits = ", ".join("(" + " + ".join(f"{search.WEIGHTS[c]} * {count('t_' + c, p)}" for c in COLUMNS) + f") AS f{j}" for j, (_, p) in enumerate(phrases))
    n = range(len(phrases))
    stats = ", ".join(f"count(*) FILTER (WHERE f{j} > 0) AS d{j}" for j in n)
    idf = ", ".join(f"CASE WHEN ln((n - d{j} + 0.5) / (d{j} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - d{j} + 0.5) / (d{j} + 0.5)) END AS i{j}" for j in n)
    score = " + ".join(f"i{j} * f{j} * 2.2 / (f{j} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for j in n)
    groups = ["(" + " OR ".join(f"f{j} > 0" for j in n if phrases[j][0] == g) + ")" for g in range(len(variants))]
    some, every = " OR ".join(groups), " AND ".join(groups)
    kinds = f" AND type IN ({', '.join(repr(t) for t in types)})" if types else ""
    if not require_all:
        where = f"({some})"
    elif fallback and len(variants) > 1:
        where = f"CASE WHEN (SELECT bool_or({every}) FROM f WHERE true{kinds}) THEN {every} ELSE {some} END"
    else:
        where = every
    inner = f"SELECT seq, content, -({score}) AS score FROM f, s2 WHERE {where}{kinds} ORDER BY score, seq LIMIT {5 * limit if case_sensitive else limit}"
    if case_sensitive:
        raw = (" AND " if require_all else " OR ").join(f"contains(content, '{g[0]}')" for g in variants)
        inner = f"SELECT * FROM ({inner}) WHERE {raw} ORDER BY score, seq LIMIT {limit}"
    return f"""WITH {source}, t AS (SELECT *, {', '.join(f'{tokens_sql(x)} AS t_{x}' for x in COLUMNS)} FROM c),
f AS (SELECT seq, type, content, {' + '.join(f'len(t_{x})' for x in COLUMNS)} AS dl, {hits} FROM t),
s AS (SELECT count(*) AS n, avg(dl) AS avgdl, {stats} FROM f), s2 AS (SELECT *, {idf} FROM s), top AS ({inner}) {tail}"""


def bm25_query(query: str, **options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.bm25(index_of(spark, sf_dir), query, limit=20, **options).select("seq", F.round("score", 6).alias("score"))

    return run


QUERIES, SQL = {}, {}
for name, query, spark_options, sql_options in [
    ("bm25_or_top20", "edge trash", {"require_all": False}, {"require_all": False}),
    ("bm25_and_top20", "that this", {"fallback_to_any": False}, {"fallback": False}),
    ("bm25_relaxed", "idiot eaux", {}, {}),
    ("bm25_exact_word", "idiot the", {"exact_word": True}, {"exact": True}),
    ("bm25_phrase", "of-th the", {"require_all": False}, {"require_all": False}),
    ("bm25_weighted_cols", "src1 fr", {}, {}),
    ("bm25_type_filter", "clown", {"types": ["table"]}, {"types": ["table"]}),
    ("bm25_case_sensitive", "Then", {"case_sensitive": True}, {"case_sensitive": True}),
    ("bm25_accent_folding", "éaux", {}, {}),
    ("bm25_korean_stem", "trash에서는 보고서를", {"require_all": False}, {"require_all": False}),
]:
    QUERIES[name], SQL[name] = bm25_query(query, **spark_options), bm25_sql(query, **sql_options)


def block_bounds_query(query: str, **options):
    """A search of an index of small blocks, most of which its bounds leave out."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        index = search.build_index(chunks(spark, sf_dir), Scratch(spark, "index").root, block=8)
        return search.bm25(index, query, limit=20, **options).select("seq", F.round("score", 6).alias("score"))

    return run


for name, query, options in [("bm25_block_bounds", "scum the", {"require_all": False}), ("bm25_block_bounds_all", "idiot trash", {})]:
    QUERIES[name], SQL[name] = block_bounds_query(query, **options), bm25_sql(query, **options)


def tokenize_counts(spark, sf_dir):
    return chunks(spark, sf_dir).select("seq", F.size(T.tokens(F.col("content"))).cast("long").alias("n_tokens"), F.size(F.array_distinct(T.tokens(F.col("content")))).cast("long").alias("n_terms"))


def term_df(spark, sf_dir):
    return search.term_frequencies(index_of(spark, sf_dir), "content")


def doc_len(spark, sf_dir):
    return index_of(spark, sf_dir).read("lengths").select("seq", "n_tokens")


def corpus_stats(spark, sf_dir):
    return index_of(spark, sf_dir).read("stats").select("n", "total", F.round(F.col("total") / F.col("n"), 6).alias("avgdl"))


def prefix_df(spark, sf_dir):
    return search.prefix_frequency(index_of(spark, sf_dir), "trash")


def index_build(spark, sf_dir):
    """Builds the index anew and counts what it holds."""
    index = search.build_index(chunks(spark, sf_dir), Scratch(spark, "index").root)
    return index.read("postings").groupBy("field").agg(F.count("*").alias("n_postings"), F.sum(F.size("places")).alias("n_tokens"), F.countDistinct("term").alias("n_terms"))


QUERIES |= {f.__name__: f for f in (tokenize_counts, term_df, doc_len, corpus_stats, prefix_df, index_build)}
SQL |= {
    "tokenize_counts": f"WITH {CHUNKS_SQL}, t AS (SELECT seq, {tokens_sql('content')} AS t FROM c) SELECT seq, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_terms FROM t",
    "term_df": f"WITH {CHUNKS_SQL}, t AS (SELECT seq, unnest({tokens_sql('content')}) AS term FROM c) SELECT term, count(DISTINCT seq) AS df, count(*) AS tf FROM t GROUP BY term",
    "index_build": " UNION ALL ".join(f"SELECT '{x}' AS field, count(*) AS n_postings, CAST(sum(tf) AS BIGINT) AS n_tokens, count(DISTINCT term) AS n_terms FROM (WITH {CHUNKS_SQL}, t AS (SELECT seq, unnest({tokens_sql(x)}) AS term FROM c) SELECT seq, term, count(*) AS tf FROM t GROUP BY ALL)" for x in COLUMNS),
    "doc_len": f"WITH {CHUNKS_SQL} SELECT seq, CAST({' + '.join(f'len({tokens_sql(x)})' for x in COLUMNS)} AS BIGINT) AS n_tokens FROM c",
    "corpus_stats": f"WITH {CHUNKS_SQL}, l AS (SELECT {' + '.join(f'len({tokens_sql(x)})' for x in COLUMNS)} AS n FROM c) SELECT count(*) AS n, CAST(sum(n) AS BIGINT) AS total, round(avg(n), 6) AS avgdl FROM l",
    "prefix_df": f"WITH {CHUNKS_SQL} SELECT count(*) AS df FROM c WHERE len(list_filter({tokens_sql('content')} || {tokens_sql('file_name')} || {tokens_sql('keywords')} || {tokens_sql('caption')}, lambda x: starts_with(x, 'trash'))) > 0",
}

RANK_QUERY, CANDIDATES = "idiot the scum", 100
#: The query's vector is that of vec_id 7: there is no model to embed text with.
QUERY_VECTOR_ID = 7


def vectors(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("seq"), F.lit("m").alias("model"), F.col("embedding").alias("vector"))


def candidates(spark, sf_dir):
    return search.bm25(index_of(spark, sf_dir), RANK_QUERY, require_all=False, limit=CANDIDATES, keep=("content", "caption", "heading"))


def query_vector(spark, sf_dir) -> list[float]:
    return list(vectors(spark, sf_dir).where(F.col("seq") == QUERY_VECTOR_ID).first()["vector"])


def hybrid_rank(spark, sf_dir):
    found = ranking.rerank(candidates(spark, sf_dir), RANK_QUERY, vectors=vectors(spark, sf_dir), query_vector=query_vector(spark, sf_dir), threshold=0.05, limit=50)
    return found.select("seq", "place", F.round("score", 6).alias("score"), "matched", "rank", "gap", F.round("similarity", 5).alias("similarity"), "is_low_relevance", "is_filename_only")


def hybrid_no_vectors(spark, sf_dir):
    found = ranking.rerank(candidates(spark, sf_dir), RANK_QUERY, limit=50)
    return found.select("seq", "place", F.round("score", 6).alias("score"), "matched", "rank", "gap")


def keyword_vs_hybrid(spark, sf_dir):
    k = search.bm25(index_of(spark, sf_dir), RANK_QUERY, require_all=False, limit=20).withColumn("keyword_place", F.expr("row_number() over (order by score, seq)"))
    h = ranking.rerank(candidates(spark, sf_dir), RANK_QUERY, limit=20).select("seq", F.col("place").alias("hybrid_place"))
    return k.select("seq", "keyword_place").join(h, "seq", "full_outer")


def sequence_gap(spark, sf_dir):
    v = T.term_variants(RANK_QUERY)
    h = ranking.haystack(F.col("content"), F.col("caption"), F.col("heading"))
    rows = chunks(spark, sf_dir).select("seq", ranking.matched_terms(h, v).alias("matched"), ranking.sequence_match(h, v).alias("s"))
    return rows.select("seq", "matched", "s.rank", "s.gap")


def extension_filter(spark, sf_dir):
    """Fetch 100, filter by extension, cut to 20: the filter comes after the limit."""
    found = search.bm25(index_of(spark, sf_dir), "the", limit=100, keep=("file_name",))
    return found.where(F.col("file_name").endswith("7.txt")).orderBy("score", "seq").limit(20).select("seq", F.round("score", 6).alias("score"))


def vector_topk(spark, sf_dir):
    v = vectors(spark, sf_dir)
    q = F.array(*[F.lit(float(x)) for x in query_vector(spark, sf_dir)])
    found = v.select("seq", ranking.dot(F.col("vector"), q).alias("d")).orderBy(F.desc("d"), "seq").limit(20)
    return found.select("seq", F.round("d", 5).alias("similarity"))


def vector_stats(spark, sf_dir):
    return vectors(spark, sf_dir).groupBy("model").agg(F.count("*").alias("n"))


def l2_norm_check(spark, sf_dir):
    unit = ranking.l2_normalize(F.col("vector"))
    return vectors(spark, sf_dir).select("seq", F.round(ranking.l2_norm(unit), 4).alias("norm"), F.round(unit[0].cast("double"), 5).alias("first"))


def missing_vectors(spark, sf_dir):
    from ..operators.snapshots import missing_vectors as missing

    return missing(chunks(spark, sf_dir).select("seq"), vectors(spark, sf_dir), "m").select("seq")


def evidence_select(spark, sf_dir):
    found = ranking.rerank(candidates(spark, sf_dir), RANK_QUERY, vectors=vectors(spark, sf_dir), query_vector=query_vector(spark, sf_dir), threshold=0.05, limit=50)
    rows = search.with_columns(index_of(spark, sf_dir), found.select("seq", "place", "similarity"), ("content",), 50).withColumn("question_id", F.lit(1))
    return select_excerpts(rows, threshold=0.0).select("seq", F.col("n").cast("long").alias("n"))


QUERIES |= {f.__name__: f for f in (hybrid_rank, hybrid_no_vectors, keyword_vs_hybrid, sequence_gap, extension_filter, vector_topk, vector_stats, l2_norm_check, missing_vectors, evidence_select)}


def _walk_sql() -> str:
    """matched, rank and gap of ``h`` for the three one-form terms of RANK_QUERY."""
    a, b, c = RANK_QUERY.split()
    pos = lambda t, start: f"CASE WHEN strpos(substr(h, {start}), '{t}') = 0 THEN 0 ELSE strpos(substr(h, {start}), '{t}') + {start} - 1 END"
    return f"""p0 AS (SELECT *, contains(h, '{a}')::INT AS ha, contains(h, '{b}')::INT AS hb, contains(h, '{c}')::INT AS hc FROM h0),
p1 AS (SELECT *, ha + hb + hc AS matched, array_to_string(list_filter(['{a}', '{b}', '{c}'], lambda t: contains(h, t)), ' ') AS phrase FROM p0),
p2 AS (SELECT *, CASE WHEN ha = 1 THEN strpos(h, '{a}') ELSE 0 END AS at_a FROM p1),
p3 AS (SELECT *, CASE WHEN ha = 1 THEN at_a + {len(a)} ELSE 1 END AS s_b FROM p2),
p4 AS (SELECT *, CASE WHEN hb = 1 THEN {pos(b, 's_b')} ELSE NULL END AS at_b FROM p3),
p5 AS (SELECT *, CASE WHEN hb = 1 THEN at_b + {len(b)} ELSE s_b END AS s_c FROM p4),
p6 AS (SELECT *, CASE WHEN hc = 1 THEN {pos(c, 's_c')} ELSE NULL END AS at_c FROM p5),
w AS (SELECT * EXCLUDE (h, phrase), CASE WHEN matched < 2 THEN 0 WHEN contains(h, phrase) THEN 2 WHEN at_b = 0 OR at_c = 0 THEN 0 ELSE 1 END AS rank,
  CAST(CASE WHEN matched < 2 OR contains(h, phrase) OR at_b = 0 OR at_c = 0 THEN 0
    ELSE CASE WHEN hc = 1 THEN at_c + {len(c)} ELSE at_b + {len(b)} END - CASE WHEN ha = 1 THEN at_a ELSE at_b END END AS INT) AS gap FROM p6)"""


_H = "lower(content || chr(10) || caption || chr(10))"
SQL["sequence_gap"] = f"WITH {CHUNKS_SQL}, h0 AS (SELECT seq, {_H} AS h FROM c), {_walk_sql()} SELECT seq, matched, rank, gap FROM w"
_CAND = bm25_sql(RANK_QUERY, require_all=False, limit=CANDIDATES, tail="SELECT seq, score FROM top")
_RANKED = f"k AS ({_CAND}), cc AS (SELECT * FROM ({'WITH ' + CHUNKS_SQL + ' SELECT * FROM c'})), h0 AS (SELECT k.seq, k.score, content, {_H} AS h FROM k JOIN cc USING (seq)), {_walk_sql()}"
_VEC = f"""v AS (SELECT w.*, list_dot_product(e.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {QUERY_VECTOR_ID})) AS sim FROM w LEFT JOIN embeddings e ON e.vec_id = w.seq),
l AS (SELECT *, coalesce(sim < 0.05, false) AND matched < 3 AS low FROM v),
r AS (SELECT *, row_number() OVER (ORDER BY low, matched DESC, rank DESC, gap, length(content) DESC, coalesce(sim, 0) DESC, score, seq) AS place FROM l)"""
SQL |= {
    "hybrid_rank": f"WITH {_RANKED}, {_VEC} SELECT seq, CAST(place AS INT) AS place, round(score, 6) AS score, matched, rank, gap, round(sim, 5) AS similarity, low AS is_low_relevance, matched = 0 AS is_filename_only FROM r WHERE place <= 50",
    "hybrid_no_vectors": f"WITH {_RANKED} SELECT seq, CAST(row_number() OVER (ORDER BY matched DESC, rank DESC, gap, length(content) DESC, score, seq) AS INT) AS place, round(score, 6) AS score, matched, rank, gap FROM w QUALIFY place <= 50",
    "keyword_vs_hybrid": f"WITH {_RANKED}, a AS (SELECT seq, CAST(row_number() OVER (ORDER BY score, seq) AS INT) AS keyword_place FROM w QUALIFY keyword_place <= 20), b AS (SELECT seq, CAST(row_number() OVER (ORDER BY matched DESC, rank DESC, gap, length(content) DESC, score, seq) AS INT) AS hybrid_place FROM w QUALIFY hybrid_place <= 20) SELECT seq, keyword_place, hybrid_place FROM a FULL JOIN b USING (seq)",
    "extension_filter": bm25_sql("the", limit=100, tail="SELECT top.seq, round(score, 6) AS score FROM top JOIN c USING (seq) WHERE ends_with(file_name, '7.txt') ORDER BY top.score, seq LIMIT 20"),
    "vector_topk": f"SELECT vec_id AS seq, round(list_dot_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {QUERY_VECTOR_ID})), 5) AS similarity FROM embeddings ORDER BY list_dot_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {QUERY_VECTOR_ID})) DESC, vec_id LIMIT 20",
    "vector_stats": "SELECT 'm' AS model, count(*) AS n FROM embeddings GROUP BY 1",
    "l2_norm_check": "WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS v, greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12) AS n FROM embeddings), u AS (SELECT vec_id, list_transform(v, lambda x: CAST(CAST(x / n AS FLOAT) AS DOUBLE)) AS u FROM n) SELECT vec_id AS seq, round(sqrt(list_dot_product(u, u)), 4) AS norm, round(u[1], 5) AS first FROM u",
    "missing_vectors": "SELECT doc_id AS seq FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "evidence_select": f"WITH {_RANKED}, {_VEC}, g AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY place) AS o FROM r WHERE place <= 50 AND sim >= 0) SELECT seq, CAST(row_number() OVER (ORDER BY place) AS BIGINT) AS n FROM g WHERE o = 1 QUALIFY n <= 5",
}
