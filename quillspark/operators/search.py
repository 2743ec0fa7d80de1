"""Keyword search: column-weighted BM25 over a persisted inverted index.

The index is built once, with one tokenization of each chunk. A query reads the postings of its terms
alone: each file holds its terms in order, so that Parquet's row-group statistics leave out the rest; each posting carries its chunk's length, so that no join is needed to score it.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import BASES, MARKED, term_variants, tokens
from ..workspace import save, ship

WEIGHTS = {"content": 1.0, "file_name": 2.0, "keywords": 1.0, "caption": 5.0}
K1, B = 1.2, 0.75
#: Bytes of a row group of postings: a query reads whole ones.
ROW_GROUP = 8 << 20
#: So many segments of about one size become one.
FANOUT = 4
#: Chunks with neighbouring seqs that share the bounds of their scores.
BLOCK = 1024
#: Chunks whose tokens are gathered at a time in a task.
SLICE = 512
#: Chunks with neighbouring seqs whose postings of a term lie in one file; a multiple of a block.
REACH = 1 << 20
#: Tables of a segment that are parts of another. rows: the postings, and a row without a term for each chunk.
FOLDERS = {"rows": "postings", "lengths": "postings"}
#: Chunks that are out of a segment: so few are joined; bitmaps of 4 KB, of so many at most, tell of more.
FEW_GONE, BITMAPS = 1000, 8192
#: The best blocks that a search reads first; as many times more as long as they hold too few rows.
FIRST = 8
#: Blocks that are named to the scan; more are joined.
NAMED = 10_000
#: Ranges of chunks that the scan's row groups and pages are asked for.
RANGES = 64


def phrase_tokens(phrase: str) -> list[str]:
    """A literal's tokens by the same rule as the columns'."""
    low = unicodedata.normalize("NFC", phrase).lower().translate(str.maketrans(MARKED, BASES))
    return re.findall(r"[^\W_]+", low)


def add(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


@dataclass(frozen=True)
class Segment:
    """A part of an index that is never changed: its folder, its chunks, and how many of them are out by now."""

    path: str
    n: int
    n_gone: int

    @property
    def live(self) -> int:
        return self.n - self.n_gone


@dataclass(frozen=True)
class Index:
    """A version of a search index: ``root`` names its segments, which chunks of them are out, and the counts.

    Of a segment there are postings: (term, field, seq, type, n_tokens, places), a row per term, field and
    chunk: the chunk's tokens in all fields, the term's places in the field. lengths: (seq, type, n_tokens).
    chunks: the rows as they came. bounds: (term, block, least, most), of the chunks of a block that hold the
    term the least tokens and, by field, the most instances; a block is ``block`` neighbouring seqs. Of the version: stats, one row (n, total); gone
    (segment, seq).
    """

    spark: SparkSession
    root: str
    block: int = BLOCK

    @cached_property
    def segments(self) -> list[Segment]:
        """A few: there are less than FANOUT of one size."""
        return [Segment(*r) for r in self.spark.read.parquet(f"{self.root}/segments").orderBy("place").select("path", "n", "n_gone").collect()]

    def of_segment(self, segment: Segment, name: str) -> DataFrame:
        rows = self.spark.read.parquet(f"{segment.path}/{FOLDERS.get(name, name)}")
        if name == "postings":
            rows = rows.where("term is not null")
        elif name == "lengths":
            rows = rows.where("term is null").select("seq", "type", "n_tokens")
        if not segment.n_gone or name == "bounds":  # bounds hold for fewer chunks too
            return rows
        return without(rows, self.spark.read.parquet(f"{self.root}/gone").where(F.col("segment") == segment.path).select("seq"), segment.n_gone)

    def read(self, name: str) -> DataFrame:
        """A table over all segments, without chunks that are out."""
        if name == "stats":
            return self.spark.read.parquet(f"{self.root}/stats")
        return reduce(lambda a, b: a.unionByName(b), [self.of_segment(s, name) for s in self.segments])


def without(rows: DataFrame, gone: DataFrame, n_gone: int) -> DataFrame:
    """rows without those of ``n_gone`` seqs in ``gone``. Seqs lie close together, so that they fit into few bitmaps
    that go to all tasks, and no row moves; where they don't, rows and seqs meet by a join."""
    if n_gone <= FEW_GONE:
        return rows.join(gone, "seq", "left_anti")
    place, bucket = F.bitmap_bit_position("seq"), F.bitmap_bucket_number("seq")
    bits = gone.groupBy(bucket.alias("_bucket")).agg(F.bitmap_construct_agg(place).alias("_bits"))
    if bits.limit(BITMAPS + 1).count() > BITMAPS:
        return rows.join(gone, "seq", "left_anti")
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    out = F.floor(byte / F.pow(F.lit(2), place % 8)) % 2 == 1
    found = rows.join(F.broadcast(bits), bucket == F.col("_bucket"), "left")
    return found.where(F.col("_bits").isNull() | ~out).drop("_bucket", "_bits")


def postings(chunks: DataFrame, columns: tuple[str, ...] = tuple(WEIGHTS)) -> DataFrame:
    """(term, field, seq, type, n_tokens, places) of chunks, a row per term, field and chunk, as they come; and
    for each chunk a row without a term. This is the one pass over the text.

    A chunk's tokens are cut in Catalyst and gathered by term where they lie, so that a term's instances in a
    chunk are one row before anything is shuffled."""
    ship(chunks.sparkSession)
    named = [F.coalesce(tokens(F.col(c)), F.array().cast("array<string>")).alias(f"_t{i}") for i, c in enumerate(columns)]
    kinds = chunks.select("seq", "type").schema
    schema = f"term string, field string, seq {kinds['seq'].dataType.simpleString()}, type {kinds['type'].dataType.simpleString()}, n_tokens long, places array<int>"

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                yield from gathered(batch.slice(at, SLICE), columns)

    return chunks.select("seq", "type", *named).mapInArrow(run, schema)


def gathered(batch: pa.RecordBatch, columns: tuple[str, ...]):
    """Postings of chunks (seq, type, a list of tokens a column), and a row without a term for each chunk."""
    seq, kind, lists = batch.column(0), batch.column(1), batch.columns[2:]
    sizes = [pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in lists]
    n_tokens = np.sum(sizes, axis=0).astype(np.int64) if sizes else np.zeros(batch.num_rows, np.int64)
    names = ["term", "field", "seq", "type", "n_tokens", "places"]
    none = pa.nulls(batch.num_rows, pa.string())
    yield pa.record_batch([none, none, seq, kind, pa.array(n_tokens), pa.nulls(batch.num_rows, pa.list_(pa.int32()))], names=names)
    for field, x, size in zip(columns, lists, sizes):
        found = x.flatten().dictionary_encode()
        if not len(found):
            continue
        row = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        code = found.indices.to_numpy().astype(np.int64)
        key = row * len(found.dictionary) + code
        order = np.argsort(key, kind="stable")
        begins = np.flatnonzero(np.diff(key[order], prepend=-1))
        first = order[begins]
        places = pa.ListArray.from_arrays(pa.array(np.append(begins, len(order)).astype(np.int32)), pa.array(place[order].astype(np.int32)))
        rows = pa.array(row[first])
        yield pa.record_batch([found.dictionary.take(pa.array(code[first])), pa.array([field] * len(first), pa.string()), seq.take(rows), kind.take(rows), pa.array(n_tokens[row[first]]), places], names=names)


def block_of(size: int) -> Column:
    return F.expr(f"(seq - pmod(seq, {size})) div {size}")


def write_postings(rows: DataFrame, path: str, block: int) -> None:
    """Writes postings and lengths, a term's together and sorted, and the bounds that are made of them. What is
    dealt by term and REACH chunks needs no sampling pass, and a term that every chunk has is spread too.
    Bounds are combined where the postings lie before they are shuffled."""
    dealt = rows.repartition("term", block_of(REACH)).sortWithinPartitions("term", "field", "seq")
    save(dealt, f"{path}/postings", ROW_GROUP)
    rows = rows.sparkSession.read.parquet(f"{path}/postings").where("term is not null")
    fields = [r["field"] for r in rows.select("field").distinct().collect()]  # the columns' names
    rows = rows.select("term", block_of(block).alias("block"), "n_tokens", "field", F.size("places").alias("n"))
    most = [F.max(F.when(F.col("field") == f, F.col("n"))).alias(f"_m{i}") for i, f in enumerate(fields)]
    bounds = rows.groupBy("term", "block").agg(F.min("n_tokens").alias("least"), *most)
    entries = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_m{i}").alias("n")) for i, f in enumerate(fields)] or [F.struct(F.lit("").alias("field"), F.lit(None).cast("int").alias("n"))])
    bounds = bounds.select("term", "block", "least", F.map_from_entries(F.filter(entries, lambda x: x["n"].isNotNull())).alias("most"))
    save(bounds.sortWithinPartitions("term", "block"), f"{path}/bounds", ROW_GROUP)


def write_segment(chunks: DataFrame, path: str, columns: tuple[str, ...], block: int = BLOCK) -> tuple[int, int]:
    """Writes a segment of chunks, which are tokenized once: (chunks, their tokens)."""
    spark = chunks.sparkSession
    save(chunks, f"{path}/chunks")
    # the text is read back from the files: a costly source is not made twice
    write_postings(postings(spark.read.parquet(f"{path}/chunks"), columns), path, block)
    n, total = spark.read.parquet(f"{path}/postings").where("term is null").agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    return n, total


def write_version(spark: SparkSession, root: str, segments: list[Segment], n: int, total: int, block: int = BLOCK) -> Index:
    rows = [(i, s.path, s.n, s.n_gone) for i, s in enumerate(segments)]
    spark.createDataFrame(rows, "place int, path string, n long, n_gone long").coalesce(1).write.parquet(f"{root}/segments")
    spark.createDataFrame([(n, total)], "n long, total long").coalesce(1).write.parquet(f"{root}/stats")
    return Index(spark, root, block)


def build_index(chunks: DataFrame, root: str, columns: tuple[str, ...] = tuple(WEIGHTS), block: int = BLOCK) -> Index:
    """Writes the index of chunks (seq, type, the weighted columns, and others to keep) below ``root``, as one
    segment.

    Null columns have no tokens; an empty table gives an empty index. Each chunk has a seq of its own: rows
    that share one would be one chunk to the postings. An index of another ``block`` than BLOCK is opened
    with it.
    """
    n, total = write_segment(chunks, f"{root}/segment", columns, block)
    return write_version(chunks.sparkSession, root, [Segment(f"{root}/segment", n, 0)], n, total, block)


def refresh_index(index: Index, root: str, changed: DataFrame, removed: DataFrame, columns: tuple[str, ...] = tuple(WEIGHTS)) -> Index:
    """Writes the version below ``root`` that holds ``changed`` chunks in the place of those of their seq, or as
    new ones, and none of the ``removed`` (seq).

    What is written follows the change: the changed chunks' segment, and the seqs that are out of each older
    one. When FANOUT segments are of about one size they become one without the chunks that are out, and
    so does one of which more than half are out; a chunk is so written again a few times in all. The old
    version stays as it is for those who read it, and keeps its segments.
    """
    spark = index.spark
    save(changed.select("seq").unionAll(removed.select("seq")).distinct(), f"{root}/touched")
    touched = spark.read.parquet(f"{root}/touched")
    refused = changed.select("seq").join(removed.select("seq").distinct(), "seq", "left_semi")
    # contents move only if some of them are in both tables
    fresh = changed if refused.isEmpty() else changed.join(refused, "seq", "left_anti")
    fresh = fresh.select(*index.read("chunks").columns)
    n, total = write_segment(fresh, f"{root}/segment", columns, index.block)
    lost = [index.of_segment(s, "lengths").join(touched, "seq", "left_semi").select(F.lit(s.path).alias("segment"), "seq", "n_tokens") for s in index.segments]
    save(reduce(DataFrame.unionAll, lost), f"{root}/lost")
    lost = spark.read.schema("segment string, seq long, n_tokens long").parquet(f"{root}/lost")
    out = {r["segment"]: (r["n"], r["t"]) for r in lost.groupBy("segment").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).collect()}
    gone = lost.select("segment", "seq")
    if before := [s.path for s in index.segments if s.n_gone]:
        gone = gone.unionAll(spark.read.parquet(f"{index.root}/gone").where(F.col("segment").isin(before)).select("segment", "seq"))
    save(gone, f"{root}/gone")
    old_n, old_total = index.read("stats").first()
    segments = [Segment(s.path, s.n, s.n_gone + out.get(s.path, (0, 0))[0]) for s in index.segments]
    segments = [s for s in segments if s.live] + [Segment(f"{root}/segment", n, 0)] * (n > 0)
    merged = merge_segments(Index(spark, root, index.block), segments or [Segment(f"{root}/segment", n, 0)])
    return write_version(spark, root, merged, old_n + n - sum(x for x, _ in out.values()), old_total + total - sum(x for _, x in out.values()), index.block)


def merge_segments(index: Index, segments: list[Segment]) -> list[Segment]:
    """Segments of a version after those of one size tier, and those that are mostly out, became one."""
    while True:
        tiers: dict[int, list[Segment]] = {}
        for s in segments:
            tiers.setdefault(int(math.log(max(s.live, 1), FANOUT) + 1e-9), []).append(s)
        found = next((t for t in tiers.values() if len(t) >= FANOUT), None) or next(([s] for s in segments if s.n_gone * 2 > s.n), None)
        if found is None:
            return segments
        path = f"{index.root}/merged-{uuid.uuid4().hex[:8]}"
        both = {name: reduce(DataFrame.unionByName, [index.of_segment(s, name) for s in found]) for name in ("chunks", "rows")}
        save(both["chunks"], f"{path}/chunks")
        write_postings(both["rows"], path, index.block)
        segments = [s for s in segments if s not in found] + [Segment(path, sum(s.live for s in found), 0)]


def bm25(
    index: Index, query: str, *, exact_word: bool = False, require_all: bool = True, fallback_to_any: bool = True,
    case_sensitive: bool = False, types: list[str] | None = None, limit: int | None = 50, weights: dict[str, float] = WEIGHTS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(seq, score, keep...) of chunks that match, best (lowest) first, ties by seq.

    A term is a phrase of its tokens, its stem an alternative; the last token is a prefix unless
    ``exact_word``. All terms must match; if none does and there are several, any (``fallback_to_any``).
    case_sensitive: raw terms must be in the content as written, among the first 5 * limit rows.
    types restrict rows, never the statistics. A query without terms, and an empty index, find
    nothing. keep: columns of the chunks, fetched for the rows within the limit.

    With a limit, and words alone, an index of more than FIRST blocks is searched by the bounds of its
    blocks (``best_blocks``): the rows are the same. A phrase's frequency is known only from its places,
    so a query that holds one reads its words' whole lists.
    """
    variants = term_variants(query)
    phrases = [(i, phrase_tokens(v)) for i, group in enumerate(variants) for v in group]
    if not phrases:
        return index.read("chunks").limit(0).select("seq", F.lit(0.0).alias("score"), *keep)
    ask = (index, phrases, len(variants), exact_word)
    wide = sum(s.n for s in index.segments) > FIRST * index.block
    words = all(len(p) < 2 for _, p in phrases) and any(p for _, p in phrases)
    if limit and wide and words and min(weights.values(), default=0) >= 0:
        found = best_rows(*ask, require_all, fallback_to_any, types, weights, 5 * limit if case_sensitive else limit)
    else:
        found = scored(*ask, require_all, fallback_to_any, types, weights)
    found = found.orderBy("score", "seq")
    if case_sensitive:
        found = found.limit(5 * limit) if limit else found
        found = with_columns(index, found, ("content",), limit)
        raw = [F.col("content").contains(group[0]) for group in variants]
        op = (lambda a, b: a & b) if require_all else (lambda a, b: a | b)
        found = found.where(reduce(op, raw)).select("seq", "score")
        found = found.orderBy("score", "seq")
    if limit:
        found = found.limit(limit)
    return with_columns(index, found, keep, limit).orderBy("score", "seq") if keep else found


def with_columns(index: Index, found: DataFrame, columns: tuple[str, ...], limit: int | None) -> DataFrame:
    """Rows found with columns of their chunks. Within a limit the rows come to the driver, so that the
    search runs once and their ids bound the row groups of the chunks that are read."""
    rows = index.read("chunks").select("seq", *columns)
    if limit:
        few = found.collect()
        found = index.spark.createDataFrame(few, found.schema)
        rows = rows.where(F.col("seq").isin([r["seq"] for r in few]))
    return found.join(rows, "seq", "left")


def is_term(word: str, exact: bool) -> Column:
    return F.col("term") == word if exact else F.col("term").startswith(word)


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def idf_of(n: Column, df: Column) -> Column:
    found = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(found <= 0, 1e-6).otherwise(found)


def saturated(hits: Column, n_tokens: Column, average: Column) -> Column:
    """A term's part of the score beside its idf: it grows with the hits and falls with the length."""
    return hits * (K1 + 1) / (hits + K1 * (1 - B + B * n_tokens / average))


def chunk_counts(index: Index, words: list[str], exact: bool, weights) -> list[int]:
    """Of each word the chunks that hold it, as a term or as a prefix of one, in a field that counts. Of the
    postings only terms, fields and seqs are read; what is shuffled is a bit a chunk."""
    rows = index.read("rows").where(any_of([is_term(w, exact) for w in words]))
    rows = rows.where(F.col("field").isin([f for f, w in weights.items() if w > 0]))
    place = F.bitmap_bit_position("seq")
    bits = [F.bitmap_construct_agg(F.when(is_term(w, exact), place)).alias(f"_b{j}") for j, w in enumerate(words)]
    rows = rows.groupBy(F.bitmap_bucket_number("seq").alias("_bucket")).agg(*bits)
    return list(rows.agg(*[F.coalesce(F.sum(F.bitmap_count(f"_b{j}")), F.lit(0)) for j in range(len(words))]).first())


def block_bounds(index: Index, phrases, n_terms: int, exact: bool, require_all: bool, weights, counts: list[int]) -> DataFrame:
    """(block, bound): no chunk of the block scores better than -bound. Blocks without a term that must
    match are left out."""
    words = [(i, f"_m{j}", p[0]) for j, (i, p) in enumerate(phrases) if p]
    weight = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    entries = F.map_entries("most")
    most = F.aggregate(entries, F.lit(0.0), lambda s, x: s + x["value"] * F.coalesce(weight[x["key"]], F.lit(0.0)))
    rows = index.read("bounds").where(any_of([is_term(w, exact) for _, _, w in words])).withColumn("_most", most)
    hits = [F.sum(F.when(is_term(w, exact), F.col("_most")).otherwise(0.0)).alias(name) for _, name, w in words]
    rows = rows.groupBy("block").agg(F.min("least").alias("_least"), *hits)
    n, total = index.read("stats").first()
    parts = [idf_of(F.lit(n), F.lit(d)) * saturated(F.col(name), F.col("_least"), F.lit(total / n)) for (_, name, _), d in zip(words, counts)]
    if require_all:
        for i in range(n_terms):
            rows = rows.where(any_of([F.lit(False)] + [F.col(name) > 0 for k, name, _ in words if k == i]))
    return rows.select("block", add(parts).alias("bound")).where("bound > 0")


def best_rows(index: Index, phrases, n_terms: int, exact: bool, require_all: bool, fallback: bool, types, weights, limit: int) -> DataFrame:
    """At least the ``limit`` best rows of ``scored``, for single words. The blocks of the best bounds are read
    first, and their limit-th score is the threshold; then blocks whose bound doesn't reach it are left
    out, by their seqs, of the scan of the postings. Ties stay: a bound equal to the threshold is read."""
    counts = chunk_counts(index, [p[0] for _, p in phrases if p], exact, weights)
    padded = iter(counts)
    known = [next(padded) if p else 0 for _, p in phrases]
    relaxed = require_all and fallback and n_terms > 1

    def search(every: bool) -> DataFrame:
        bounds = block_bounds(index, phrases, n_terms, exact, every, weights, counts)
        size, floor = FIRST, 0.0
        while True:
            best = [r["block"] for r in bounds.orderBy(F.desc("bound"), "block").limit(size).collect()]
            rows = scored(index, phrases, n_terms, exact, every, False, types, weights, known, in_blocks(index, best))
            if len(best) < size:
                return rows
            top = rows.orderBy("score", "seq").limit(limit).agg(F.count("*").alias("n"), F.max("score").alias("worst")).first()
            if top["n"] == limit:
                floor = -top["worst"] * (1 - 1e-9)
                break
            if size > NAMED:
                break
            size *= FIRST
        able = bounds.where(F.col("bound") >= floor).select("block")
        few = [r["block"] for r in able.limit(NAMED + 1).collect()]
        if len(few) <= NAMED:
            return scored(index, phrases, n_terms, exact, every, False, types, weights, known, in_blocks(index, few))
        return scored(index, phrases, n_terms, exact, every, False, types, weights, known, able)

    found = search(require_all)
    return search(False) if relaxed and found.isEmpty() else found


def in_blocks(index: Index, blocks: list[int]) -> Column:
    """Whether a chunk is in one of the blocks, with at most RANGES ranges of seqs that hold them all, for row
    groups and pages to be left out by."""
    ordered = sorted(blocks)
    if not ordered:
        return F.lit(False)
    gaps = sorted(((b - a, i + 1) for i, (a, b) in enumerate(zip(ordered, ordered[1:])) if b - a > 1), reverse=True)
    cuts = [0, *sorted(i for _, i in gaps[: RANGES - 1]), len(ordered)]
    spans = [F.col("seq").between(ordered[a] * index.block, (ordered[b - 1] + 1) * index.block - 1) for a, b in zip(cuts, cuts[1:])]
    return any_of(spans) & block_of(index.block).isin(ordered)


def scored(
    index: Index, phrases, n_terms: int, exact: bool, require_all: bool, fallback: bool, types, weights,
    counts: list[int] | None = None, blocks: Column | DataFrame | None = None,
) -> DataFrame:
    """(seq, score) of all chunks that match, or of those in ``blocks``: a condition, or a table (block). Then
    counts are the phrases' numbers of chunks in the whole index."""
    named = [(i, f"_f{j}", p) for j, (i, p) in enumerate(phrases)]

    def is_last(word: str) -> Column:
        return is_term(word, exact)

    wanted = [is_last(p[-1]) for _, _, p in named if p] + [F.col("term").isin(sorted({w for _, _, p in named for w in p[:-1]}))]
    rows = index.read("rows").where(any_of(wanted))  # no test of a term holds for rows without one
    if isinstance(blocks, DataFrame):
        rows = rows.withColumn("block", block_of(index.block)).join(blocks, "block", "left_semi").drop("block")
    elif blocks is not None:
        rows = rows.where(blocks)

    def places(test: Column) -> Column:
        return F.flatten(F.collect_list(F.when(test, F.col("places"))))

    def back(j: int):
        return lambda place: place - j

    weight = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[F.col("field")]
    weight = F.coalesce(weight, F.lit(0.0))
    names = [name for _, name, _ in named]
    if all(len(p) < 2 for _, _, p in named):
        hits = [F.when(is_last(p[0]), F.size("places")).otherwise(0) * weight if p else F.lit(0.0) for _, _, p in named]
        rows = rows.groupBy("seq", "type", "n_tokens").agg(*[F.sum(h).alias(n) for n, h in zip(names, hits)])
    else:  # the places of a phrase's words meet in each field, then fields add up where they lie
        gathered = []
        for _, name, p in named:
            tests = [F.col("term") == w for w in p[:-1]] + [is_last(p[-1])] if p else []
            gathered += [places(t).alias(f"{name}_{j}") for j, t in enumerate(tests)]
        by_field = rows.repartition("seq").groupBy("seq", "type", "n_tokens", "field").agg(*gathered)
        for _, name, p in named:  # starts from which every word of the phrase follows at its distance
            shifted = [F.transform(f"{name}_{j}", back(j)) for j in range(len(p))]
            by_field = by_field.withColumn(name, F.size(reduce(F.array_intersect, shifted)) if p else F.lit(0))
        rows = by_field.groupBy("seq", "type", "n_tokens").agg(*[F.sum(F.col(n) * weight).alias(n) for n in names])
    stats = index.read("stats").select(F.col("n").alias("_n"), (F.col("total") / F.col("n")).alias("_avg"))
    if counts is None:  # one row of counts beside the one of statistics
        stats = stats.crossJoin(rows.agg(*[F.count_if(F.col(n) > 0).alias(f"_d{n}") for n in names]))
    else:
        stats = stats.select("*", *[F.lit(d).alias(f"_d{n}") for n, d in zip(names, counts)])
    score = add([idf_of(F.col("_n"), F.col(f"_d{n}")) * saturated(F.col(n), F.col("n_tokens"), F.col("_avg")) for n in names])
    matched = [any_of([F.col(n) > 0 for j, n, _ in named if j == i]) for i in range(n_terms)]
    every, some = reduce(lambda a, b: a & b, matched), any_of(matched)
    relaxed = require_all and fallback and n_terms > 1
    rows = rows.where(some if not require_all or relaxed else every).withColumn("_all", every)
    if types:
        rows = rows.where(F.col("type").isin(types))
    if relaxed:
        whole = rows.agg(F.coalesce(F.bool_or("_all"), F.lit(False)).alias("_whole"))
        rows = rows.crossJoin(F.broadcast(whole)).where(F.col("_all") | ~F.col("_whole"))  # one row
    return rows.crossJoin(F.broadcast(stats)).select("seq", (-score).alias("score"))  # one row


def with_retry(search, query: str, previous: str | None) -> tuple[str, DataFrame]:
    """(query that was asked, its result): ``search(query)``; without a row, and with an earlier question,
    that question and the query together."""
    found = search(query)
    if previous and previous.strip() and found.isEmpty():
        both = f"{previous.strip()} {query}"
        return both, search(both)
    return query, found


def term_frequencies(index: Index, field: str) -> DataFrame:
    """(term, df, tf): chunks with the term in a field, and its instances."""
    rows = index.read("postings").where(F.col("field") == field)
    return rows.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.size("places")).alias("tf"))


def prefix_frequency(index: Index, prefix: str) -> DataFrame:
    """Chunks with any token of the prefix: not a sum over terms."""
    return index.read("postings").where(F.col("term").startswith(prefix)).agg(F.countDistinct("seq").alias("df"))
