"""SimHash near-duplicates by pigeonring filtering.

A fingerprint is cut into a ring of segments. If two fingerprints differ in at most ``distance``
bits, then from some segment on every chain of l consecutive segments differs in at most
l * distance / segments bits. The first chains whose budget is under one bit must be equal, so they
are the key by which candidates meet; longer chains then prune candidates before the full check.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import Scratch, ship
from .buckets import forest_links
from .components import connected_components

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Ring:
    """bits in ``segments`` segments, links at ``distance`` or fewer bits.

    seed: equal segments by which candidates meet; at most ceil(segments / distance) - 1 of them, so
    that every link is found.
    """

    bits: int
    segments: int
    distance: int
    seed: int

    def __post_init__(self) -> None:
        if self.seed * self.distance >= self.segments or self.bits % 64:
            raise ValueError("a ring needs whole 64-bit words, and seed * distance < segments to lose no link")

    def bounds(self) -> list[int]:
        return [round(i * self.bits / self.segments) for i in range(self.segments + 1)]


#: 64 bits, 2 differing: three equal segments of seven are 27 bits, and no link is lost.
CONTRACT = Ring(bits=64, segments=7, distance=2, seed=3)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def majority(hashes: np.ndarray, words: int) -> bytes:
    """Bits set in over half the hashes. words > 1: further words are mixed from each hash."""
    n = len(hashes)
    if not n:
        return bytes(8 * words)
    total = np.zeros(64 * words, np.int64)
    for at in range(0, n, 255):
        h = hashes[at : at + 255]
        if words > 1:
            h = mix(h[:, None] + GOLDEN * np.arange(words, dtype=np.uint64)[None, :])
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(len(h), -1), axis=1)
        total += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(total * 2 > n).tobytes()


def text_words(raw: bytes | None) -> list[bytes]:
    """Words of a text: A-Z lowered, cut at 0x20 and 0x09-0x0D. Null: none."""
    return (raw or b"").lower().split()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``size`` words joined by one space, repeats included."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= size:
        return np.array([digest(b" ".join(words), 42)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - size + 1].tolist()
    stops = (ends[size - 1 :] - 1).tolist()
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops)), np.uint64, len(starts))


def run_hashes(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words, from the words' hashes (fewer words: of all)."""
    n = len(word_hashes)
    if not n:
        return word_hashes
    size = min(size, n)
    out = np.zeros(n - size + 1, np.uint64)
    for j in range(size):
        out = mix(out + GOLDEN) ^ word_hashes[j : n - size + 1 + j]
    return mix(out + np.uint64(size))


def fingerprint_contract(raw: bytes | None, size: int = 3) -> bytes:
    return majority(shingle_hashes(text_words(raw), size), 1)


def fingerprints(docs: DataFrame, keep: list[str], text_col: str, function) -> DataFrame:
    """The ``keep`` columns and ``fp`` binary of each row, from its whole text."""
    ship(docs.sparkSession)
    rows = docs.select(*keep, F.col(text_col).alias("_quill_text"))
    schema = rows.select(*keep, F.lit(b"").alias("fp")).schema

    def run(batches):
        for batch in batches:
            fps = [function(x) for x in batch.column(len(keep)).cast(pa.binary()).to_pylist()]
            yield pa.record_batch([*batch.columns[: len(keep)], pa.array(fps, pa.binary())], names=[*keep, "fp"])

    return rows.mapInArrow(run, schema)


def chain_keys(fps: np.ndarray, ring: Ring) -> np.ndarray:
    """(rows, bytes) fingerprints to (rows, segments) keys of the seed chain from each segment."""
    bits = np.unpackbits(fps, axis=1)
    ring_bits = np.concatenate([bits, bits], axis=1)
    bounds = ring.bounds()
    bounds += [ring.bits + x for x in bounds[1:]]
    keys = []
    for i in range(ring.segments):
        part = np.packbits(ring_bits[:, bounds[i] : bounds[i + ring.seed]], axis=1)
        wide = np.zeros((len(fps), -(-part.shape[1] // 8) * 8), np.uint8)
        wide[:, : part.shape[1]] = part
        h = np.full(len(fps), (i + 1) * int(GOLDEN) % 2**64, np.uint64)
        for word in wide.view(np.uint64).T:
            h = mix(h ^ word)
        keys.append(h)
    return np.stack(keys, axis=1).view(np.int64)


def candidate_rows(classes: DataFrame, ring: Ring) -> DataFrame:
    """(node, fp) to one row of (k, id) for each seed chain."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = batch.column(1).to_pylist()
            fps = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)[:, : ring.bits // 8]
            keys = chain_keys(fps, ring)
            yield pa.record_batch([batch.column(0), pa.array(list(keys), pa.list_(pa.int64()))], names=["id", "keys"])

    rows = classes.select("node", "fp").mapInArrow(run, "id long, keys array<long>")
    return rows.select(F.explode("keys").alias("k"), "id")


def segment_masks(ring: Ring) -> list[list[tuple[int, np.uint64]]]:
    """Of each segment its (word, mask) parts, for fingerprints read as 64-bit words."""
    bounds, out = ring.bounds(), []
    for i in range(ring.segments):
        bits = np.zeros(ring.bits, np.uint8)
        bits[bounds[i] : bounds[i + 1]] = 1
        words = np.packbits(bits).view(np.uint64)
        out.append([(w, words[w]) for w in range(len(words)) if words[w]])
    return out


def comparer(ring: Ring):
    """(links of two sets of fingerprints as a matrix, candidates among rows set against rows). A pair stays a
    candidate if from some segment on all chains of up to ``seed`` + 2 segments keep to their budgets;
    only candidates get the full Hamming check."""
    masks = segment_masks(ring)
    chains = min(ring.segments, ring.seed + 2)
    budgets = [length * ring.distance // ring.segments for length in range(1, chains + 1)]

    def pairwise(differing_word, words: int) -> np.ndarray:
        other = [differing_word(w) for w in range(words)]
        differing = [sum(np.bitwise_count(other[w] & mask) for w, mask in parts) for parts in masks]
        out = np.zeros(other[0].shape, bool)
        for start in range(ring.segments):
            so_far, good = 0, True
            for length in range(chains):
                so_far = so_far + differing[(start + length) % ring.segments]
                good = good & (so_far <= budgets[length])
            out |= good
        return out

    def compare(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        left, right = (np.ascontiguousarray(x).view(np.uint64) for x in (left, right))
        near = pairwise(lambda w: left[:, w, None] ^ right[None, :, w], left.shape[1])
        i, j = np.nonzero(near)
        if len(i):
            bits = np.zeros(len(i), np.int64)
            for w in range(left.shape[1]):
                bits += np.bitwise_count(left[i, w] ^ right[j, w])
            near[i, j] = bits <= ring.distance
        return near

    def screen(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        left, right = (np.ascontiguousarray(x).view(np.uint64) for x in (left, right))
        return pairwise(lambda w: left[:, w] ^ right[:, w], left.shape[1])

    return compare, screen


def near_links(classes: DataFrame, ring: Ring, scratch: Scratch) -> DataFrame:
    """(node, fp), one row a node, to (a, b): links that span the components of nodes that link. Of a longer fp
    the ring's first bits count."""
    compare, screen = comparer(ring)
    classes = classes.select("node", F.substring("fp", 1, ring.bits // 8).alias("fp"))
    return forest_links(
        candidate_rows(classes, ring), scratch, compare, "uint8",
        payloads=classes.select(F.col("node").alias("id"), F.col("fp").alias("payload")), screen=screen,
    )


def near_duplicates(spark: SparkSession, classes: DataFrame, ring: Ring, scratch: Scratch) -> DataFrame:
    """(node, fp), one row a distinct fingerprint, to (node, component) of nodes that have a link."""
    return connected_components(near_links(classes, ring, scratch), scratch)


def simhash_components(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
    ring: Ring = CONTRACT,
) -> DataFrame:
    """One row per input row: (id_col, fp long, component_id).

    fp: bit b is set if it is in over half the XXH64 hashes of the text's word shingles. Rows link at
    ``ring.distance`` or fewer differing bits; component_id is the smallest id reachable.
    Null, empty and blank texts have fingerprint zero and link like any other. Rows that repeat an id
    are rows of their own. Null ids take part and come back as null; a component of nothing else has
    a null component_id. An empty table gives an empty one; other columns are ignored.

    Equal fingerprints are one node, so copies of any number cost one row after a combining
    aggregation. The table of fingerprints is the only state that grows: 16 bytes a row.
    """
    scratch = Scratch(spark, "simhash")
    rows = fingerprints(
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), ["_id"], "_text",
        lambda raw: fingerprint_contract(raw, shingle),
    )
    rows = scratch.keep(rows)
    classes = rows.groupBy("fp").agg(F.min("_id").alias("low")).withColumn("node", F.monotonically_increasing_id())
    classes = scratch.keep(classes)
    linked = scratch.keep(near_duplicates(spark, classes, ring, scratch))
    labelled = scratch.keep(
        classes.join(linked, "node", "left").select("fp", "low", F.coalesce("component", "node").alias("component"))
    )
    lows = scratch.keep(
        labelled.join(linked.select("component").distinct(), "component", "left_semi")
        .groupBy("component").agg(F.min("low").alias("lowest"))
    )
    named = scratch.keep(
        labelled.join(lows, "component", "left").select("fp", F.coalesce("lowest", "low").alias("component_id"))
    )
    return rows.join(named, "fp").select(
        F.col("_id").alias(id_col), F.conv(F.hex("fp"), 16, -10).cast("long").alias("fp"),
        F.lower(F.hex("fp")).alias("fingerprint"), "component_id",
    )
