"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are the powers of two of n (and whole
sequences of the longest length before them). Each piece is a sequence of its own, so that no
sequence crosses documents and none is padded; sequences of one length form a bucket.
"""

from __future__ import annotations

import os
import re
from array import array
import struct
import unicodedata
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..workspace import Scratch, ship

#: Characters for which cutting a text into words here equals the tokenizer's own cutting; a text
#: with any other goes to the tokenizer whole. Left out: controls, spaces beyond ASCII, numerals that
#: aren't digits, and letters whose lower case depends on their place or has two characters.
OTHER = re.compile("[^\t-\r -~¡-¬®-±´-¸º»¿-įı-ɏ‐-‧‰-⁞]")
#: The tokenizer's pattern of words, said in Python's classes.
WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


#: The Latin-1 part of the characters that OTHER lets pass.
PLAIN = bytes(x for x in range(256) if not OTHER.search(chr(x)))


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet of BPE vocabularies: printable bytes are themselves, the others follow
    from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in own]
    return {**{x: chr(x) for x in own}, **{x: chr(256 + i) for i, x in enumerate(rest)}}


class WordIds:
    """Ids of texts as little-endian unsigned 32-bit bytes, equal to the tokenizer's.

    Ids never reach over white space, so the ids of a run between spaces are remembered. Two
    generations of at most ``limit`` runs bound the memory; a run that comes again stays.
    """

    def __init__(self, path: str, limit: int = 150_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # strings that the tokenizer takes out of a text as ids of their own, case aside
        self.added = [x.content.lower() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.limit = limit

    def _whole(self, text: str) -> bytes:
        found = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(found)}I", *found)

    def _word(self, word: str) -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [x.id for x in self.model.tokenize(word)]).tobytes()

    def _run(self, run: str) -> bytes:
        found = self.old.get(run)
        if found is None:
            if run.isalpha():
                found = self._word(run)
            else:
                words = WORD.findall(run)
                found = b"".join([self._known(w) for w in words]) if len(words) > 1 else self._word(run)
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        self.young[run] = found
        return found

    def _known(self, word: str) -> bytes:
        return self.young.get(word) or self._run(word)

    def encode(self, text: str) -> bytes:
        """The ids of ``encode(text, add_special_tokens=False)`` of the tokenizer as it was read."""
        said = text
        try:
            plain = not text.encode("latin-1").translate(None, PLAIN)
        except UnicodeEncodeError:
            plain = not OTHER.search(said := unicodedata.normalize("NFC", text))
        if not plain:
            return self._whole(text)
        low = said.lower()
        for x in self.added:
            if x in low:
                return self._whole(text)
        runs = low.split()
        found = list(map(self.young.get, runs))
        if None in found:
            for i, x in enumerate(found):
                if x is None:
                    found[i] = self.young.get(runs[i]) or self._run(runs[i])
        return b"".join(found)


#: What a Python worker has learned of words, kept for its later tasks.
_SHARED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _SHARED:
        _SHARED[path] = WordIds(path)
    return _SHARED[path]


def piece_lengths(n: int, longest: int) -> list[int]:
    """n as whole sequences of ``longest`` and then falling powers of two."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pieces(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", longest: int = 4096,
    end_id: int = 2, with_ids: bool = True,
) -> DataFrame:
    """One row per piece: (id_col, start, length, ids_crc32, doc_tokens, part, rank[, ids binary]).

    ids holds the piece's ids, little-endian unsigned 32 bits, and ids_crc32 their CRC-32. A document's ids are its text's and
    then ``end_id``; a null or empty text has the end alone, so every row gives at least one piece.
    Rows that repeat an id are documents of their own, a null id stays null, an empty table gives no
    piece and other columns are ignored. Texts are never cut before their ids are known. ``longest``
    must be a power of two. (part, rank) numbers the pieces of one length within a task.
    """
    if longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    end = struct.pack("<I", end_id)
    names = ["_id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank", "ids"]

    def run(batches):
        ids = word_ids(tokenizer_path)
        part = TaskContext.get().partitionId()
        ranks: dict[int, int] = {}
        for batch in batches:
            kinds = (batch.schema.types[0], pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            out, size = [[] for _ in kinds], 0

            def flush():
                return pa.record_batch([pa.array(x, t) for x, t in zip(out, kinds)], names=names)

            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = ids.encode(text.as_py() or "") + end
                n, start = len(found) // 4, 0
                for length in piece_lengths(n, longest):
                    rank = ranks.get(length, 0)
                    ranks[length] = rank + 1
                    own = found[4 * start : 4 * (start + length)]
                    row = (key, start, length, zlib.crc32(own), n, part, rank, own if with_ids else None)
                    for column, x in zip(out, row):
                        column.append(x)
                    start += length
                size += len(found)
                if size > 16_000_000:
                    yield flush()
                    out, size = [[] for _ in kinds], 0
            yield flush()

    schema = f"_id {rows.schema[0].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, part int, rank long, ids binary"
    found = rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
    return found if with_ids else found.drop("ids")


def number_sequences(found: DataFrame, scratch: Scratch) -> DataFrame:
    """Pieces with sequence_id (gapless from 0, bucket by bucket from the shortest) and offset 0.

    The rows are written once; of each task and length only the count is gathered, and its running
    sum gives the ids. No row moves.
    """
    found = scratch.keep(found)
    counts = scratch.keep(found.groupBy("length", "part").agg(F.count("*").alias("n")))
    within = Window.partitionBy("length").orderBy("part")
    firsts = counts.withColumn("first", F.sum("n").over(within) - F.col("n"))
    totals = counts.groupBy("length").agg(F.sum("n").alias("total"))  # one row a power of two: 13
    totals = totals.withColumn("base", F.sum("total").over(Window.orderBy("length")) - F.col("total"))
    firsts = firsts.join(F.broadcast(totals.select("length", "base")), "length")
    firsts = scratch.keep(firsts.select("length", "part", (F.col("base") + F.col("first")).alias("first")))
    return (
        found.join(firsts, ["length", "part"])
        .withColumn("sequence_id", F.col("first") + F.col("rank"))
        .withColumn("offset", F.lit(0).cast("long"))
        .drop("part", "rank", "first")
    )


def pack(
    spark: SparkSession, docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
    longest: int = 4096, end_id: int = 2, with_ids: bool = True,
) -> DataFrame:
    """(id_col, start, length, [ids,] ids_crc32, doc_tokens, sequence_id, offset), a row per piece;
    for the rules see ``pieces``. Loaders read the sequences of one length together."""
    found = pieces(docs, tokenizer_path, id_col, text_col, longest, end_id, with_ids)
    return number_sequences(found, Scratch(spark, "packing"))
