"""Links among the rows of hash buckets, found block against block.

Rows of a bucket meet in groups of two blocks of bounded size, so that no task holds a whole hot
bucket, and only a spanning forest of each group's links leaves the task, not all its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import Scratch

BLOCK = 512


#: Bits of one row of a sieve, and the most and fewest rows of one: 32 MB are the most that is broadcast.
SIEVE_ROW, SIEVE_MOST, BITS_EACH = 32_768, 8192, 16


def sieve(ids: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """((block, bits), bits in all) of ids (id long): a table that tells of an id that it is not among them, or
    may be. With 16 bits an id one in 16 of the others may; from 16 million ids on the table grows no
    more and tells less, until in the end every id may be among them."""
    n = ids.count()
    size = SIEVE_ROW
    while size < n * BITS_EACH and size < SIEVE_ROW * SIEVE_MOST:
        size *= 2
    place = F.pmod(F.xxhash64("id"), F.lit(size))
    rows = ids.select(F.floor(place / SIEVE_ROW).cast("int").alias("block"), F.pmod(place, F.lit(SIEVE_ROW)).alias("at"))
    return scratch.keep(rows.groupBy("block").agg(F.bitmap_construct_agg("at").alias("bits"))), size


def free_name(frame: DataFrame, name: str) -> str:
    """``name``, longer by underscores as long as a column has it."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def sifted(frame: DataFrame, id_col: str, found: tuple[DataFrame, int]) -> tuple[DataFrame, DataFrame]:
    """(rows whose id may be one of the sieve's, rows whose id is not), all their columns. No row moves."""
    table, size = found
    block, bits, maybe = (free_name(frame, f"_quill_{x}") for x in ("block", "bits", "maybe"))
    place = F.pmod(F.xxhash64(F.col(id_col)), F.lit(size))
    at = F.pmod(place, F.lit(SIEVE_ROW))
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    bit = F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(at, F.lit(8)))).cast("long"), F.lit(2)) == 1
    table = F.broadcast(table.toDF(block, bits))  # SIEVE_MOST rows of 4 KB at most
    rows = frame.join(table, F.floor(place / SIEVE_ROW).cast("int") == F.col(block), "left")
    rows = rows.withColumn(maybe, F.coalesce(bit, F.lit(False))).drop(block, bits)
    return rows.where(F.col(maybe)).drop(maybe), rows.where(~F.col(maybe)).drop(maybe)


def blocked(rows: DataFrame, scratch: Scratch, block: int = BLOCK, payloads: DataFrame | None = None) -> DataFrame:
    """(k long, id long, payload binary) to rows of (k, lo, hi, part, id, payload), where each pair
    of a bucket shares a group (k, lo, hi). Buckets of one row are left out: they hold no pair.

    payloads: (id, payload), one row an id, where rows have none. Wide payloads then travel only with
    the rows that meet another; the rest are keys and ids."""
    sizes = scratch.keep(rows.groupBy("k").agg(F.count("*").alias("n")).where("n > 1"))
    blocks = F.ceil(F.col("n") / block).cast("int")
    found = rows.join(sizes, "k").withColumn("nb", blocks)
    if payloads is not None:
        found = found.join(payloads, "id")
    found = found.withColumn("part", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    found = found.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return found.select(
        "k", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "id", "payload"
    )


#: Groups of so few rows are looked through together, pair by pair, before any is taken up by itself.
FEW = 16


def eventful(lo: np.ndarray, hi: np.ndarray, payload: np.ndarray, cuts: list[int], screen) -> np.ndarray:
    """Of the groups that end at ``cuts``: whether one has more than FEW rows or two blocks, or a pair that
    ``screen`` (rows, rows) passes."""
    ends = np.array(cuts)
    sizes = np.diff(ends, prepend=0)
    out = (sizes > FEW) | (lo[ends - 1] != hi[ends - 1])
    group = np.repeat(np.arange(len(ends)), sizes)
    for apart in range(1, FEW):
        i = np.flatnonzero(group[apart:] == group[:-apart])
        i = i[~out[group[i]]]
        if not len(i):
            break
        for at in range(0, len(i), 65_536):
            j = i[at : at + 65_536]
            out[group[j[screen(payload[j], payload[j + apart])]]] = True
    return out


def grouped(batches: Iterator[pa.RecordBatch], dtype, screen=None) -> Iterator[tuple]:
    """Consecutive groups (k, lo, hi, part, ids, payload matrix) of batches sorted by (k, lo, hi).
    Payloads of several lengths may come; those of a group that differ in length are groups apart.
    With a screen, small groups without a pair that passes it are left out."""
    held: dict[int, list] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.binary_length(batch.column(5)).to_numpy(zero_copy_only=False)
        kinds = np.unique(lengths).tolist()
        for length in kinds:
            part = batch if len(kinds) == 1 else batch.filter(pa.array(lengths == length))
            cols = [part.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            cols.append(np.frombuffer(b"".join(part.column(5).to_pylist()), dtype=dtype).reshape(part.num_rows, -1))
            if length in held:
                cols = [np.concatenate(x) for x in zip(held[length], cols)]
            k, lo, hi = cols[:3]
            cuts = (np.flatnonzero((k[1:] != k[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1).tolist()
            wanted = eventful(lo, hi, cols[5], cuts, screen).tolist() if screen and cuts else [True] * len(cuts)
            start = 0
            for end, want in zip(cuts, wanted):
                if want:
                    yield tuple(x[start:end] for x in cols)
                start = end
            held[length] = [x[start:] for x in cols]
    for rest in held.values():
        yield tuple(rest)


def forest(linked: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a symmetric link matrix: links that span its components, each linked row but the first of its
    component with one that it has a link to."""
    open_ = linked.any(axis=1)
    a, b = [], []
    while True:
        left = np.flatnonzero(open_)
        if not len(left):
            break
        seed = left[0]
        reached = np.zeros(len(ids), bool)
        reached[seed] = True
        front = np.array([seed])
        while len(front):
            met = linked[front]
            new = np.flatnonzero(met.any(axis=0) & ~reached)
            reached[new] = True
            a.append(ids[front[met[:, new].argmax(axis=0)]])
            b.append(ids[new])
            front = new
        open_ &= ~reached
    if not a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(a), np.concatenate(b)


def marked(payload: np.ndarray, lo: int, hi: int, part: np.ndarray, compare) -> tuple | None:
    """(rows, rows, marks) of the two sides of a group; None if it holds no pair."""
    if len(part) < 2:
        return None
    if lo == hi:
        at = np.arange(len(part))
        marks = np.triu(compare(payload, payload).astype(np.int8), 1)
        return at, at, marks
    left, right = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
    if not len(left) or not len(right):
        return None
    return left, right, compare(payload[left], payload[right]).astype(np.int8)


def spanning(left: np.ndarray, right: np.ndarray, sure: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    linked = np.zeros((len(ids), len(ids)), bool)
    linked[np.ix_(left, right)] = sure
    return forest(linked | linked.T, ids)


def flushed(batches, dtype, compare, of_group, names: list[str], screen=None):
    """Columns that ``of_group(group, left, right, marks)`` makes of each group, in batches."""
    outs, held = [], 0
    for group in grouped(batches, dtype, screen):
        _, lo, hi, part, _, payload = group
        found = marked(payload, lo[0], hi[0], part, compare)
        columns = of_group(group, *found) if found and found[2].any() else None
        if columns and len(columns[0]):
            outs.append(columns)
            held += len(columns[0])
        if held > 50_000:
            yield pa.record_batch([np.concatenate(x) for x in zip(*outs)], names=names)
            outs, held = [], 0
    if held:
        yield pa.record_batch([np.concatenate(x) for x in zip(*outs)], names=names)


def meet(groups: DataFrame) -> DataFrame:
    return groups.repartition("k", "lo", "hi").sortWithinPartitions("k", "lo", "hi")


def forest_links(
    rows: DataFrame, scratch: Scratch, compare: Callable[[np.ndarray, np.ndarray], np.ndarray], dtype: str,
    block: int = BLOCK, payloads: DataFrame | None = None, screen=None,
) -> DataFrame:
    """(a, b, ask): links that join what ``compare`` links in any bucket, and with ask every pair whose
    link it leaves open. rows and payloads as in ``blocked``.

    compare(left payload, right payload) returns a matrix and must be symmetric: 1 or True for a link,
    2 for a pair that it can't decide, else 0. screen(rows, rows) may tell of rows set against rows, one
    by one, which pairs may be of account; it must pass all of them.
    """

    def links(group, left, right, marks):
        ids = group[4]
        a, b = spanning(left, right, marks == 1, ids)
        i, j = np.nonzero(marks == 2)
        i, j = ids[left[i]], ids[right[j]]
        ask = np.repeat([False, True], [len(a), len(i)])
        return np.concatenate([a, np.minimum(i, j)]), np.concatenate([b, np.maximum(i, j)]), ask

    def run(batches):
        return flushed(batches, dtype, compare, links, ["a", "b", "ask"], screen)

    return meet(blocked(rows, scratch, block, payloads)).mapInArrow(run, "a long, b long, ask boolean").distinct()


def settled_links(
    rows: DataFrame, payloads: DataFrame, scratch: Scratch, compare, dtype: str, exact: DataFrame, settle, exact_dtype: str,
    block: int = BLOCK, screen=None,
) -> DataFrame:
    """(a, b): links that join what is linked in any bucket. Pairs that ``compare`` leaves open (2) are
    decided by ``settle`` on the ``exact`` payloads (id, payload): their rows, not the pairs, meet once
    more in the same group, so that however many pairs are open, what travels are rows of groups."""

    def first(group, left, right, marks):
        k, lo, hi, part, ids, _ = group
        a, b = spanning(left, right, marks == 1, ids)
        i, j = np.nonzero(marks == 2)
        again = np.unique(np.concatenate([left[i], right[j]]))
        none = np.zeros(len(a), np.int64)
        return (
            np.concatenate([none, k[again]]), np.concatenate([none, lo[again]]).astype(np.int32),
            np.concatenate([none, hi[again]]).astype(np.int32), np.concatenate([none - 1, part[again]]).astype(np.int32),
            np.concatenate([a, ids[again]]), np.concatenate([b, ids[again]]),
        )

    def run(batches):
        return flushed(batches, dtype, compare, first, ["k", "lo", "hi", "part", "a", "b"], screen)

    def last(group, left, right, marks):
        return spanning(left, right, marks == 1, group[4])

    def run_exact(batches):
        return flushed(batches, exact_dtype, settle, last, ["a", "b"])

    schema = "k long, lo int, hi int, part int, a long, b long"
    found = scratch.keep(meet(blocked(rows, scratch, block, payloads)).mapInArrow(run, schema))
    again = found.where("part >= 0").select("k", "lo", "hi", "part", F.col("a").alias("id")).join(exact, "id")
    again = meet(again.select("k", "lo", "hi", "part", "id", "payload")).mapInArrow(run_exact, "a long, b long")
    return scratch.keep(found.where("part < 0").select("a", "b").unionAll(again).distinct())
