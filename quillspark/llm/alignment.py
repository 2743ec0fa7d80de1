"""Alignment of two tokenizers' tokens of the same texts, by byte offsets.

Python tokenizes. It cuts texts before white space, over which no token of either reaches, and gives for a
block of texts each text as numbers of pieces, and the tokens of the pieces that its task has not had yet. A
token is one long: where it ends, which tokenizer gave it, its id. The ends that both have (array_intersect)
are marks; sorted together, marks and tokens are a merge in which every token sees its neighbours: a mark
before the last tokens of a group, and the token of the other that it shares bytes with. Each end of either
is the last byte of exactly one linked pair. So array functions give the groups and links of each piece, once
a task (of so many pieces as it may remember). The rows stay in order, and Arrow batches put the texts
together from their pieces'; counts over the corpus are aggregates and joins.
"""

from __future__ import annotations

import os
import re
from array import array
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from ..workspace import Scratch, ship
from .packing import byte_letters

#: Bits of an id; above them whether it is the second tokenizer's, a piece's last and a token at all; then the end.
ID_BITS = 20
SECOND, LAST, TOKEN, END = 1 << ID_BITS, 2 << ID_BITS, 4 << ID_BITS, ID_BITS + 3
#: Above a pair of ids: it is its piece's last.
PIECE_END = 1 << 2 * ID_BITS
#: No id: stands for id 0 where a digit follows.
NOUGHT = 9_999_999
#: Pairs whose counts go to every task: a table of more of them meets its pairs by a shuffle.
SENT_PAIRS = 1_000_000
#: Characters of texts in a block.
BLOCK = 50_000
#: Characters of pieces, and so many more for each, after which a task numbers pieces anew.
REMEMBERED, EACH = 12_000_000, 16
#: Bytes of an Arrow batch of texts or of blocks.
BATCH = 4 << 20
#: White space that the tokenizers and Python don't see alike.
UNLIKE = "\x1c\x1d\x1e\x1f"
PIECE = re.compile(r"\s*\S+|\s+")


class Pair:
    """Both tokenizers. A text with white space that a token may hold beside other characters is one piece."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        letters = {c: bytes([b]) for b, c in byte_letters().items()}
        self.bytes_a = {i: b"".join(letters.get(c, c.encode()) for c in x) for x, i in self.a.get_vocab().items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.sizes_a = np.zeros(max(self.bytes_a) + 1, "i8")
        self.sizes_a[list(self.bytes_a)] = list(map(len, self.bytes_a.values()))
        self.sizes_b = np.array(list(map(len, self.bytes_b)), "i8")
        self.longest_token = max(*map(len, self.bytes_a.values()), *map(len, self.bytes_b))
        self.space = self.b.piece_to_id("▁")
        crossing = {c for x in names for m in re.finditer(r"[^\s▁](?=([\s▁]))|▁(?=(\s))", x) for c in m.groups() if c}
        self.whole = re.compile("[" + re.escape(UNLIKE + "".join(sorted(crossing)).replace("▁", " ")) + "]")

    def pieces(self, text: str | None) -> list[str]:
        if not text:
            return []
        return [" " + text] if self.whole.search(text) else PIECE.findall(" " + text)

    def ids(self, pieces: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        # the second tokenizer adds a space, which a piece that begins with one has already
        said = self.b.encode([p[1:] if p[0] == " " else p for p in pieces], num_threads=1)
        b = [[self.space] if p == " " else y if p[0] == " " else y[1:] for p, y in zip(pieces, said)]
        return [x.ids for x in self.a.encode_batch_fast(pieces, add_special_tokens=False)], b

    def learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the pieces their numbers of tokens of both, -1 where the tokens are other bytes; and the others' tokens, as
        longs of length and id."""
        a, b = self.ids(pieces)
        raws = list(map(str.encode, pieces))
        sizes = [np.fromiter(map(len, x), "i8", len(pieces)) for x in (a, b)]
        flat = [np.fromiter(chain.from_iterable(x), "i8", n.sum()) for x, n in zip((a, b), sizes)]
        # one comparison for all; their lengths tell whether the pieces agree with it each
        whole, ends = b"".join(raws), np.cumsum(np.fromiter(map(len, raws), "i8", len(raws)))
        same = all(
            b"".join([names[i] for i in x.tolist()]) == whole and (np.concatenate([[0], np.cumsum(long[x])])[np.cumsum(n)] == ends).all()
            for names, long, x, n in zip((self.bytes_a, self.bytes_b), (self.sizes_a, self.sizes_b), flat, sizes))
        if not same:
            good = np.array([b"".join([self.bytes_a[i] for i in x]) == raw == b"".join([self.bytes_b[i] for i in y]) for x, y, raw in zip(a, b, raws)], bool)
            flat = [x[np.repeat(good, n)] for x, n in zip(flat, sizes)]
            sizes = [np.where(good, n, -1) for n in sizes]
        return (*sizes, *(long[x] << END | x for long, x in zip((self.sizes_a, self.sizes_b), flat)))


class Pieces(dict):
    """Pieces by number, in the order in which they came."""

    def __missing__(self, piece: str) -> int:
        found = self[piece] = len(self)
        return found


class Numbered:
    """A task's pieces by number, until they weigh more than ``remembered``: then all are forgotten."""

    def __init__(self, both: Pair, remembered: int) -> None:
        self.both, self.remembered = both, remembered
        self.forget()

    def forget(self) -> None:
        self.place, self.weight, self.good = Pieces(), 0, 0
        #: Of each piece its numbers of tokens, and its place among the pieces that have tokens, or -1.
        self.n_a, self.n_b, self.numbers = array("q"), array("q"), array("i")

    def block(self, texts: list[str | None]) -> tuple[int, int, list[tuple[int, int, bytes]], np.ndarray, np.ndarray]:
        """(pieces with tokens before this block, and new in it; of each text its numbers of tokens and its
        pieces; the tokens of the new pieces, by both)."""
        if self.weight > self.remembered:
            self.forget()
        had, start, place = len(self.place), self.good, self.place
        lines = [list(map(place.__getitem__, self.both.pieces(text))) for text in texts]
        own = list(islice(reversed(place), len(place) - had))[::-1]
        self.weight += sum(map(len, own)) + EACH * len(own)
        more_a, more_b, *both = self.both.learn(own) if own else [np.empty(0, "i8")] * 4
        fine = more_a >= 0
        self.n_a.frombytes(more_a.tobytes())
        self.n_b.frombytes(more_b.tobytes())
        self.numbers.frombytes(np.where(fine, self.good + np.cumsum(fine) - 1, -1).astype("i4").tobytes())
        self.good += int(fine.sum())
        n_a, n_b, numbers = (np.frombuffer(x, x.typecode) for x in (self.n_a, self.n_b, self.numbers))
        rows = []
        for line in lines:
            at = np.array(line, "i8")
            if not line or (said := numbers[at]).min() < 0:
                rows.append((0, 0, b""))
            else:
                rows.append((int(n_a[at].sum()), int(n_b[at].sum()), said.tobytes()))
        sides = []
        for side, (x, sizes) in enumerate(zip(both, (more_a, more_b))):
            x = np.cumsum(x >> END) << END | x & SECOND - 1 | TOKEN | side * SECOND
            x[np.cumsum(sizes[fine]) - 1] |= LAST
            sides.append(x)
        return start, self.good - start, rows, *sides


_SHARED: dict[tuple[str, str], Pair] = {}


def pair_of(path_a: str, path_b: str) -> Pair:
    if (path_a, path_b) not in _SHARED:
        _SHARED[path_a, path_b] = Pair(path_a, path_b)
    return _SHARED[path_a, path_b]


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in values])]).astype("i4")
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(values), kind))


def tokenized(
    docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, remembered: int = REMEMBERED,
) -> DataFrame:
    """(start, new, docs array<struct<id, n_a, n_b, pieces binary>>, a array<long>, b array<long>), a row per block of
    texts: each text with a space before it, as numbers (int) of pieces, and the tokens of the pieces from ``start``
    on, ``new`` of them; those before came with earlier blocks of the task, since the last one that starts at 0.
    Texts that are null or empty, or whose tokens of either are other bytes, have none. A text longer than
    ``block`` characters is a block of its own."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def run(batches):
        known = Numbered(pair_of(path_a, path_b), remembered)

        def made(keys, texts):
            start, new, found, a, b = known.block(texts)
            n_a, n_b, pieces = zip(*found)
            fields = [pa.array(keys, key_kind), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(pieces, pa.binary())]
            said = pa.StructArray.from_arrays(fields, ["id", "n_a", "n_b", "pieces"])
            said = pa.ListArray.from_arrays(np.array([0, len(keys)], "i4"), said)
            columns = [pa.array([start], pa.int64()), pa.array([new], pa.int64()), said, lists([a], pa.int64()), lists([b], pa.int64())]
            return pa.record_batch(columns, names=["start", "new", "docs", "a", "b"])

        keys, texts, size = [], [], 0
        for batch in batches:
            key_kind = batch.schema.types[0]
            for key, text in zip(batch.column(0), batch.column(1)):
                keys.append(key.as_py())
                texts.append(text.as_py())
                size += len(texts[-1] or "")
                if size >= block:
                    yield made(keys, texts)
                    keys, texts, size = [], [], 0
        if keys:
            yield made(keys, texts)

    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"start long, new long, docs array<struct<id:{kind},n_a:long,n_b:long,pieces:binary>>, a array<long>, b array<long>")


def has(x: Column, bit: int) -> Column:
    return x.bitwiseAND(F.lit(bit)) != 0


def token_id(x: Column) -> Column:
    return x.bitwiseAND(F.lit(SECOND - 1))


def is_mark(x: Column) -> Column:
    return F.coalesce(~has(x, TOKEN), F.lit(False))


def merged(a: Column, b: Column) -> Column:
    """Tokens of both by their ends, a mark before two that end together, the first tokenizer's before the second's."""
    ends = lambda line: F.transform(line, lambda x: F.shiftleft(F.shiftright(x, END), END))
    return F.sort_array(F.concat(F.array_intersect(ends(a), ends(b)), a, b))


def group_lists(line: Column) -> Column:
    """The pieces' groups as text, "a1,a2|b1;a3|b2,b3", with "/;" between pieces. Each id gets a digit that says whether its group, or
    its piece, ends; the digits become separators, and the groups of both tokenizers meet by their place."""

    def one(x: Column, i: Column) -> Column:
        said = lambda ends: F.when(token_id(x) == 0, NOUGHT).otherwise(token_id(x)) * 10 + F.when(~ends, 1).when(has(x, LAST), 3).otherwise(2)
        return F.when(~has(x, TOKEN), F.lit(0).cast("long")).when(has(x, SECOND), -said(is_mark(F.get(line, i - 2)))).otherwise(said(is_mark(F.get(line, i - 1))))

    def groups(numbers: Column, last: str) -> Column:
        said = F.replace(F.concat(F.array_join(numbers.cast("array<string>"), ","), F.lit(",")), F.lit("-"), F.lit(""))
        for digit, mark in (("3", last), ("2", ";"), ("1", ",")):
            said = F.replace(said, F.lit(digit + ","), F.lit(mark))
        return F.split(F.rtrim(F.replace(said, F.lit(str(NOUGHT)), F.lit("0")), F.lit(";")), ";")

    def joined(numbers: Column) -> Column:
        both = F.zip_with(groups(F.filter(numbers, lambda x: x > 0), ";"), groups(F.filter(numbers, lambda x: x < 0), "/;"), lambda p, q: F.concat(p, F.lit("|"), q))
        return F.rtrim(F.array_join(both, ";"), F.lit("/"))

    return let(F.transform(line, one), joined)


def linked_pairs(line: Column, longest_token: int) -> Column:
    """The pieces' pairs of ids whose tokens share bytes, as longs, each as often as it occurs, with a bit above the
    pair (``PIECE_END``) at the last one of a piece. Every end of
    a token is the last byte of one: the token's partner there is the next of the other tokenizer, at most as
    many tokens on as the longest token has bytes, and that many marks."""

    def one(x: Column, i: Column) -> Column:
        other = lambda y: has(y, TOKEN) & has(x.bitwiseXOR(y), SECOND)
        far = F.get(F.filter(F.slice(line, i + 5, F.lit(2 * longest_token)), other), F.lit(0))
        near = [F.get(line, i + k) for k in (1, 2, 3)]
        y = F.when(other(near[0]), near[0]).when(other(near[1]), near[1]).when(other(near[2]), near[2]).otherwise(far)
        left, right = F.shiftleft(token_id(x), ID_BITS).bitwiseOR(token_id(y)), F.shiftleft(token_id(y), ID_BITS).bitwiseOR(token_id(x))
        # a mark, and the second of two that end together, are in the first one's pair; the bit above a pair ends its piece
        pair = F.when(has(x, SECOND), F.when(~is_mark(F.get(line, i - 2)), right)).otherwise(F.when(has(x, LAST), left + PIECE_END).otherwise(left))
        return F.coalesce(F.when(has(x, TOKEN), pair), F.lit(-1).cast("long"))

    return F.filter(F.transform(line, one), lambda p: p >= 0)


def put_together(blocks: DataFrame, longest_token: int, said) -> DataFrame:
    """(_id, n_a, n_b, n_links, groups, pairs array<long>, times array<int>) of the texts of blocks, which must be as ``tokenized``
    gave them, in their order: groups as ``said`` tells them; each linked pair once, and how often it occurs."""

    def run(batches):
        groups, links = [], []  # of the pieces by number
        for batch in batches:
            for at in range(batch.num_rows):
                start, new = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
                if not start:
                    groups, links = [], []
                docs, pairs = batch.column(2)[at].values, batch.column(4)[at].values.to_numpy()
                cuts = [0, *(8 * np.flatnonzero(pairs >= PIECE_END) + 8).tolist()]
                told = batch.column(3)[at].as_py().encode().split(b"/;")[:new]
                if not start == len(groups) == len(links) or not new == len(told) == len(cuts) - 1:
                    raise ValueError("blocks out of order")
                groups += told
                raw = (pairs & PIECE_END - 1).tobytes()
                links += [raw[i:j] for i, j in zip(cuts, cuts[1:])]
                texts, found, times, n_links = [], [], [], []
                for x in docs.field(3).to_pylist():
                    line = np.frombuffer(x, "i4").tolist()
                    texts.append(said(b";".join([groups[i] for i in line])))
                    pair, n = np.unique(np.frombuffer(b"".join([links[i] for i in line]), "i8"), return_counts=True)
                    found.append(pair)
                    times.append(n)
                    n_links.append(n.sum())
                columns = [docs.field(0), docs.field(1), docs.field(2), pa.array(n_links, pa.int64()), pa.array(texts, pa.string()), lists(found, pa.int64()), lists(times, pa.int32())]
                yield pa.record_batch(columns, names=["_id", "n_a", "n_b", "n_links", "groups", "pairs", "times"])

    # bound by functions, not by columns: the optimizer would put a column's expression where it is used, once an element
    by_piece = lambda line: F.struct(group_lists(line).alias("groups"), linked_pairs(line, longest_token).alias("links"))
    found = blocks.select("start", "new", "docs", let(merged(F.col("a"), F.col("b")), by_piece).alias("by"))
    kind = blocks.schema["docs"].dataType.elementType["id"].dataType.simpleString()
    return found.select("start", "new", "docs", "by.groups", "by.links").mapInArrow(run, f"_id {kind}, n_a long, n_b long, n_links long, groups string, pairs array<long>, times array<int>")


def aligned(blocks: DataFrame, longest_token: int) -> DataFrame:
    """(_id, n_a, n_b, groups, links) of the texts of blocks; links: the pairs, each as often as it occurs."""
    links = F.flatten(F.zip_with("pairs", "times", F.array_repeat))
    return put_together(blocks, longest_token, bytes.decode).select("_id", "n_a", "n_b", "groups", links.alias("links"))


def align(
    spark: SparkSession, docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", sent_pairs: int = SENT_PAIRS,
    said=bytes.decode,
) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs) of two tokenizers over whole texts.

    documents: (id_col, n_a, n_b, n_groups, n_links, groups, n_best, count_sum), a row each. groups: the ids
    between ends that both have, "a1,a2|b1;a3|b2", or the text that ``said`` makes of its bytes: it is sent with its
    document, so who needs a digest alone should say so. n_links: pairs of tokens whose bytes overlap; n_best: those
    whose count is the highest of their first id, ties included; count_sum: the links' counts added up.
    pairs: (id_a, id_b, n_docs): in how many documents a pair is linked, over the whole corpus.

    A text that is null or empty, or whose tokens of either tokenizer are other bytes than a space and the
    text, has no tokens: zeros, no groups, and it counts for no pair. Rows that repeat, and null ids, are
    documents of their own. An empty table gives empty results; other columns are ignored.

    Pairs are counted where they lie before a shuffle. Their counts go to every task while there are at
    most ``sent_pairs`` of them, else they meet the documents' pairs by a shuffle.
    """
    scratch = Scratch(spark, "alignment", batch=BATCH)
    longest = pair_of(path_a, path_b).longest_token
    found = put_together(tokenized(docs, path_a, path_b, id_col, text_col), longest, said)
    kept = scratch.keep(found.withColumn("_row", F.monotonically_increasing_id()))
    # posexplode and get: the pairs of a row come apart without a struct for each
    linked = kept.select("_row", "times", F.posexplode("pairs").alias("at", "pair")).select("_row", "pair", F.get("times", F.col("at")).alias("n"))
    counts = scratch.keep(kept.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n_docs")))
    best = counts.groupBy(F.shiftright("pair", ID_BITS).alias("first")).agg(F.max("n_docs").alias("most"))
    counts_now = counts.withColumn("first", F.shiftright("pair", ID_BITS)).join(best, "first").select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))
    counts_now = scratch.keep(counts_now)
    if counts_now.count() <= sent_pairs:  # at most 17 bytes each
        counts_now = F.broadcast(counts_now)
    sums = linked.join(counts_now, "pair").groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("n_docs")).alias("count_sum"))
    out = kept.join(scratch.keep(sums), "_row", "left").select(
        F.col("_id").alias(id_col), "n_a", "n_b", (F.col("n_a") + F.col("n_b") - F.col("n_links")).alias("n_groups"), "n_links", "groups",
        F.coalesce("n_best", F.lit(0).cast("long")).alias("n_best"), F.coalesce("count_sum", F.lit(0).cast("long")).alias("count_sum"))
    return out, counts.select(F.shiftright("pair", ID_BITS).alias("id_a"), token_id(F.col("pair")).alias("id_b"), "n_docs")
