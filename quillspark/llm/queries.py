"""Queries of this subpackage, one an operator, over whole tables; and their SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, sequences
from .ann import nearest
from .html_extract import extract_pages
from .lattice import embedding_components
from .licences import KNOWN, NOTICE, RESERVED, SPELLINGS, WHOLE, known_licences, scan
from .mixing import mix_sources
from .packing import pack
from .sharding import shard
from .simhash import simhash_components
from .toxicity import toxicity
from .url_lists import judge


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lattice_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(spark, table(spark, sf_dir, "embeddings"))


def op2_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op3_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op4_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


#: The mixture of op5 and of the pipeline: names not listed have weight 1.
MIX_WEIGHTS = {
    "domain": {"web": 50, "books": 30, "forums": 20},
    "lang": {"en": 50, "de": 20, "fr": 20, "es": 10},
    "source": {"src0": 3},
}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.5, 3, 11


def domain_of_source(source: str = "source"):
    """The table has no domain: sources are dealt to three by their number."""
    number = F.regexp_extract(source, r"([0-9]+)$", 1).cast("int")
    return F.when(number % 3 == 0, "web").when(number % 3 == 1, "books").when(number % 3 == 2, "forums")


def op5_hierarchical_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix_sources(
        spark, table(spark, sf_dir, "documents"), domain_of_source(), MIX_WEIGHTS, share=MIX_SHARE,
        max_epochs=MIX_EPOCHS, seed=MIX_SEED,
    )
    return found.select(
        "doc_id", F.col("_quill_domain").alias("domain"), "lang", "source", F.col("_quill_tokens").alias("tokens"),
        F.col("_quill_copies").alias("copies"),
    )


def op6_stable_projection_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(spark, rows, rows.where("vec_id % 100 = 0"))


#: Changes of the lists of op7: (list, action, kind, entry, day).
LIST_CHANGES = [
    ("spam", "add", "host", "www.cheap-pills.example.com", "2024-01-15"),
    ("spam", "remove", "host", "www.cheap-pills.example.com", "2024-03-01"),
    ("spam", "add", "host", "www.cheap-pills.example.com", "2024-04-10"),
    ("spam", "add", "domain", "cheap-pills.example.com", "2024-09-01"),
    ("adult", "add", "domain", "example.net", "2024-02-01"),
    ("adult", "remove", "domain", "example.net", "2024-05-15"),
    ("adult", "add", "domain", "tionsh.example.net", "2024-06-01"),
    ("legal", "add", "domain", "example.org", "2024-07-01"),
    ("legal", "add", "prefix", "thther.example.org/en", "2024-01-01"),
    ("legal", "remove", "prefix", "thther.example.org/en", "2024-10-01"),
    ("allow", "add", "host", "thther.example.org", "2024-08-01"),
    ("allow", "add", "host", "blog.ththon.example.net", "2024-03-10"),
    ("allow", "remove", "host", "blog.ththon.example.net", "2024-04-20"),
]


def op7_temporal_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no time of fetching: a page's is dealt by its id over the days of 2024."""
    pages = table(spark, sf_dir, "pages")
    day = F.expr("date_add(DATE '2024-01-01', cast((page_id * 7919) % 366 as int))")
    changes = spark.createDataFrame(LIST_CHANGES, "list string, action string, kind string, entry string, day string")
    changes = changes.select("list", "action", "kind", "entry", F.to_date("day").alias("at"))
    found = judge(spark, pages.withColumn("fetched_on", day), changes, time_col="fetched_on")
    return found.withColumn("fetched_on", F.date_format("fetched_on", "yyyy-MM-dd"))


def op8_histogram_sort_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark, table(spark, sf_dir, "documents"))


def op9_pigeonring_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(spark, table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op10_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), known_licences(spark))


#: Patterns of op11: the longest step between two events, and of all of one, in microseconds.
GAP, SPAN = 300_000_000, 450_000_000


def click_events(clicks: DataFrame) -> DataFrame:
    """(client_id, at, kind): clicks as events in microseconds. Every fifth of them or so, by its id's digest, is
    opened a second before and shut a second after."""
    since = F.col("ts") - F.lit("1970-01-01 00:00:00").cast(clicks.schema["ts"].dataType)  # without a zone's changes
    part = lambda unit: F.expr(f"extract({unit} FROM since)")
    at = ((part("DAY").cast("long") * 24 + part("HOUR")) * 60 + part("MINUTE")) * 60_000_000 + (part("SECOND") * 1_000_000).cast("long")
    rows = clicks.where("client_id is not null and ts is not null and kind is not null").withColumn("since", since).select("client_id", at.alias("at"), "kind", F.crc32(F.col("click_id").cast("string")).alias("digest"))
    event = lambda kind, shift: F.struct(kind.alias("kind"), (F.col("at") + shift).alias("at"))
    own = event(F.col("kind"), 0)
    said = F.when(F.col("digest") % 5 == 0, F.array(own, event(F.lit("open"), -1_000_000), event(F.lit("shut"), 1_000_000))).otherwise(F.array(own))
    return rows.select("client_id", F.explode(said).alias("e")).select("client_id", "e.at", "e.kind")


def op11_cspade_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = click_events(table(spark, sf_dir, "clicks"))
    found = sequences.frequent_sequences(spark, events, GAP, SPAN, weight=lambda client: F.crc32(client.cast("string")))
    return sequences.with_wider(found).select(
        F.array_join("pattern", ">").alias("pattern"), "length", "support", F.col("weight").alias("clients_crc"), "n_wider", (F.col("n_wider") == 0).alias("closed"))


def op12_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda groups: hashlib.sha256(groups).hexdigest() if groups else ""
    found, _ = alignment.align(spark, table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"), said=digest)
    return found.withColumnRenamed("groups", "groups_sha256")


QUERIES = {
    f.__name__: f
    for f in (
        op1_lattice_near_dups, op2_power_of_two_packing, op3_html_main_text, op4_toxic_segments, op5_hierarchical_mixing,
        op6_stable_projection_search, op7_temporal_url_lists, op8_histogram_sort_shards, op9_pigeonring_simhash,
        op10_licence_digests, op11_cspade_patterns, op12_bpe_transducer, op13_token_alignment,
    )
}


def _weights(level: str) -> str:
    whens = " ".join(f"WHEN {level} = '{n}' THEN {w}" for n, w in MIX_WEIGHTS[level].items())
    return f"CAST(CASE {whens} ELSE 1 END AS BIGINT)"


def _level(name: str, parent: str, keys: list[str]) -> str:
    """Common table expressions that share a parent's budget out over one level of the tree: the level
    at which a child is full is held against what all its siblings would take at that level."""
    by, up = ", ".join(keys), ", ".join(keys[:-1])
    part = f"PARTITION BY {up}" if up else ""
    source = (
        f"(SELECT c.*, p.got AS budget FROM {name}_c c JOIN {parent} p USING ({up}))" if up
        else f"(SELECT c.*, (SELECT CAST(floor(sum(tokens) * {MIX_SHARE}) AS BIGINT) FROM leaves) AS budget FROM {name}_c c)"
    )
    same = " AND ".join(f"a.{k} = b.{k}" for k in keys[:-1]) or "true"
    return f"""
{name}_c AS (SELECT {by}, CAST(sum(tokens * {MIX_EPOCHS}) AS HUGEINT) AS cap, CAST(any_value({_weights(keys[-1])}) AS HUGEINT) AS w FROM leaves GROUP BY {by}),
{name}_b AS (SELECT * FROM {source}),
{name}_f AS (SELECT {', '.join(f'b.{k}' for k in keys)}, b.cap, b.w, b.budget, sum(least(a.cap * b.w, a.w * b.cap)) <= b.budget * b.w AS filled
  FROM {name}_b a JOIN {name}_b b ON {same} GROUP BY {', '.join(f'b.{k}' for k in keys)}, b.cap, b.w, b.budget),
{name}_r AS (SELECT *, budget - coalesce(sum(cap) FILTER (WHERE filled) OVER ({part}), 0) AS rest,
    coalesce(sum(w) FILTER (WHERE NOT filled) OVER ({part}), 1) AS weights FROM {name}_f),
{name}_p AS (SELECT *, row_number() OVER ({part} ORDER BY filled, (w * rest) % weights DESC, {keys[-1]}) AS place,
    sum((w * rest) % weights) FILTER (WHERE NOT filled) OVER ({part}) // weights AS spare FROM {name}_r),
{name} AS (SELECT {by}, CAST(CASE WHEN filled THEN cap ELSE (w * rest) // weights + CASE WHEN place <= spare THEN 1 ELSE 0 END END AS BIGINT) AS got FROM {name}_p)"""


OP5_SQL = f"""
WITH docs AS (
  SELECT doc_id, lang AS raw_lang, source AS raw_source, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
    coalesce(CASE TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) % 3
      WHEN 0 THEN 'web' WHEN 1 THEN 'books' WHEN 2 THEN 'forums' END, 'unknown') AS domain,
    CAST(coalesce(len(regexp_extract_all(text, '[^\\x09-\\x0D\\x20]+')), 0) AS BIGINT) AS tokens
  FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens FROM docs GROUP BY ALL HAVING sum(tokens) > 0),
{_level("d1", "", ["domain"])},{_level("d2", "d1", ["domain", "lang"])},{_level("d3", "d2", ["domain", "lang", "source"])},
keyed AS (
  SELECT docs.*, got // leaves.tokens AS epochs, got % leaves.tokens AS rest,
    CAST('0x' || substr(md5('{MIX_SEED}:' || CAST(got // leaves.tokens AS VARCHAR) || coalesce(':' || CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS k
  FROM docs JOIN leaves USING (domain, lang, source) JOIN d3 USING (domain, lang, source)),
placed AS (
  SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY k)
    - sum(tokens) OVER (PARTITION BY domain, lang, source, k) AS before FROM keyed)
SELECT doc_id, domain, raw_lang AS lang, raw_source AS source, tokens,
  CAST(epochs + CASE WHEN rest > 0 AND before < rest THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM placed WHERE epochs + CASE WHEN rest > 0 AND before < rest THEN 1 ELSE 0 END > 0
"""

_changes = ", ".join(f"('{a}', '{b}', '{c}', '{d}', DATE '{e}')" for a, b, c, d, e in LIST_CHANGES)
OP7_SQL = f"""
WITH changes(list, action, kind, entry, day) AS (VALUES {_changes}),
spans AS (SELECT list, action, kind, entry, day AS since, lead(day) OVER (PARTITION BY list, kind, entry ORDER BY day) AS until FROM changes),
active AS (SELECT * FROM spans WHERE action = 'add'),
captures AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST((page_id * 7919) % 366 AS INTEGER) AS day,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1)) AS host,
    lower(trim(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)', 1), '/')) AS path FROM pages),
hits AS (
  SELECT c.page_id, a.list, a.entry, length(a.entry) AS n FROM captures c JOIN active a
    ON a.since <= c.day AND (a.until IS NULL OR c.day < a.until) AND (
      a.kind = 'host' AND c.host = a.entry
      OR a.kind = 'domain' AND (c.host = a.entry OR ends_with(c.host, '.' || a.entry))
      OR a.kind = 'prefix' AND (c.host || '/' || c.path = a.entry OR starts_with(c.host || '/' || c.path, a.entry || '/')))),
judged AS (
  SELECT page_id, count(*) AS n_entries, arg_max(entry, (n, entry)) AS entry, string_agg(DISTINCT list, ',' ORDER BY list) AS lists,
    coalesce(max(n) FILTER (WHERE list <> 'allow'), 0) AS bad, coalesce(max(n) FILTER (WHERE list = 'allow'), 0) AS good
  FROM hits GROUP BY page_id)
SELECT page_id, url, strftime(day, '%Y-%m-%d') AS fetched_on, coalesce(bad > good, false) AS blocked,
  coalesce(n_entries, 0) AS n_entries, entry, coalesce(lists, '') AS lists
FROM captures LEFT JOIN judged USING (page_id)
"""


def _canonical(text: str) -> str:
    out = f"lower({text})"
    out = f"regexp_replace({out}, '{NOTICE}', ' ', 'g')"
    out = f"regexp_replace({out}, '{RESERVED}', ' ', 'g')"
    out = f"regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')"
    for said, form in SPELLINGS:
        out = f"regexp_replace({out}, '\\b{said}\\b', '{form}', 'g')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


_known = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in KNOWN)
_whole = ", ".join(f"('{d}', '{i}')" for i, d, _ in WHOLE)
OP10_SQL = f"""
WITH known AS (SELECT digest, min(i) AS licence_id FROM (
  SELECT md5({_canonical('t')}) AS digest, i FROM (VALUES {_known}) k(i, t) UNION ALL SELECT * FROM (VALUES {_whole}) w(digest, i)) GROUP BY 1),
texts AS (SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents WHERE text IS NOT NULL),
units AS (
  SELECT doc_id, 'document' AS unit, t FROM texts
  UNION ALL SELECT doc_id, 'paragraph', unnest(regexp_split_to_array(t, '\\n[ \\t]*\\n\\s*')) FROM texts
  UNION ALL SELECT doc_id, 'line', unnest(string_split(t, chr(10))) FROM texts)
SELECT doc_id, unit, licence_id, count(*) AS n
FROM (SELECT doc_id, unit, md5({_canonical('t')}) AS digest FROM units) JOIN known USING (digest)
GROUP BY doc_id, unit, licence_id
"""



def _crc(text: str) -> str:
    """CRC-32 of a string of ASCII characters; ``tab`` is the list of its 256 steps."""
    letters = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {letters}), lambda c, b: xor(c >> 8, tab[CAST(xor(c, b) & 255 AS INT) + 1])), 4294967295)"


def _longer(n: int) -> str:
    return f"""l{n} AS (SELECT l.c, l.p || '>' || v.k AS p, v.t AS e, max(l.s) AS s FROM l{n - 1} l JOIN ev v
  ON v.c = l.c AND v.t > l.e AND v.t <= l.e + {GAP} AND v.t <= l.s + {SPAN} GROUP BY ALL)"""


OP11_SQL = f"""
WITH tab AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM (SELECT unnest(range(256)) AS i))),
k AS (SELECT client_id AS c, kind AS k, epoch_us(ts) AS t, {_crc("click_id::VARCHAR")} AS digest FROM clicks, tab WHERE client_id IS NOT NULL AND ts IS NOT NULL AND kind IS NOT NULL),
ev AS (SELECT c, k, t FROM k UNION SELECT c, 'open', t - 1000000 FROM k WHERE digest % 5 = 0 UNION SELECT c, 'shut', t + 1000000 FROM k WHERE digest % 5 = 0),
l1 AS (SELECT c, k AS p, t AS e, t AS s FROM ev), {_longer(2)}, {_longer(3)}, {_longer(4)},
who AS (SELECT c, {_crc("c::VARCHAR")} AS digest FROM (SELECT DISTINCT c FROM ev), tab),
s AS (SELECT p, count(*) AS support, CAST(sum(digest) AS BIGINT) AS clients_crc FROM (SELECT DISTINCT c, p FROM (SELECT c, p FROM l1 UNION ALL SELECT c, p FROM l2 UNION ALL SELECT c, p FROM l3 UNION ALL SELECT c, p FROM l4))
  JOIN who USING (c) GROUP BY p),
f AS (SELECT p, string_split(p, '>') AS parts, support, clients_crc FROM s WHERE support >= 2 AND support * 100 >= 3 * (SELECT count(*) FROM who)),
d AS (SELECT DISTINCT support, p AS wide, array_to_string(list_filter(parts, lambda x, i: (m >> (i - 1)) & 1 = 1), '>') AS p FROM (SELECT *, unnest(range(1, CAST(pow(2, len(parts)) AS BIGINT) - 1)) AS m FROM f)),
n AS (SELECT p, support, count(*) AS n_wider FROM d GROUP BY p, support)
SELECT p AS pattern, CAST(len(parts) AS INT) AS length, support, clients_crc, coalesce(n_wider, 0) AS n_wider, coalesce(n_wider, 0) = 0 AS closed FROM f LEFT JOIN n USING (p, support)
"""

ORACLE_SQL = {"op11_cspade_patterns": OP11_SQL, "op5_hierarchical_mixing": OP5_SQL, "op7_temporal_url_lists": OP7_SQL, "op10_licence_digests": OP10_SQL}
