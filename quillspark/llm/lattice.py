"""Embedding near-duplicates by E8 lattice hashing.

Each table projects a vector onto random orthonormal 8-dimensional blocks, decodes each block to its
nearest point of the lattice E8 and hashes the points. A vector is put into its own cell and into
the neighbouring cells whose boundaries are nearest; rows that meet in a cell are compared by cosine.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import Scratch
from .buckets import blocked, grouped, meet, settled_links
from .components import connected_components
from .simhash import GOLDEN, mix

def layout(rows: int) -> tuple[int, int]:
    """(E8 blocks a table, tables) for so many distinct vectors, at scale 0.3 and 4 probes.

    By simulation on 64 dimensions a further block divides the pairs of unrelated vectors that meet in a
    table by 2**6.3 or more, so their number a vector stays under 16 with a block for each factor of
    2**6.3 in the rows. A pair at cosine 0.9 meets in one table with a chance of 0.63, 0.31, 0.13, 0.051,
    0.018 and 0.009 at 2 to 7 blocks. The tables grow by 2.4 a block up to 4 and by 2.8 from there,
    which keeps the chance of a miss in all under 1/1000; nearer pairs are missed far more rarely.
    """
    blocks = max(2, math.ceil((math.log2(max(rows, 1)) - 4) / 6.3))
    return blocks, math.ceil(14 * 2.4 ** (min(blocks, 4) - 2) * 2.8 ** max(0, blocks - 4))


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8, by their rule."""
    found = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            found.append(v)
    found += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(found)


def nearest_d8(x: np.ndarray) -> np.ndarray:
    out = np.rint(x)
    off = x - out
    rows = np.flatnonzero(out.sum(axis=1) % 2)
    at = np.abs(off[rows]).argmax(axis=1)
    out[rows, at] += np.where(off[rows, at] >= 0, 1.0, -1.0)
    return out


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The lattice point nearest to each row: of D8 and of D8 shifted by a half, the nearer one."""
    a, b = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def lattice_keys(units: np.ndarray, blocks: int, tables: int, probes: int, scale: float, seed: int) -> np.ndarray:
    """(rows, tables * (1 + probes)) hashes of each row's own cell and its nearest neighbour cells."""
    n, dim = units.shape
    short = minimal_vectors()
    twice = (2 * short).astype(np.int64)
    rng = np.random.default_rng(seed)
    width = max(dim, 8 * blocks)  # fewer dimensions than a table needs: the rest are zeros
    padded = np.zeros((n, width))
    padded[:, :dim] = units
    weights = mix(np.arange(1, 8 * blocks + 1, dtype=np.uint64) * GOLDEN) | np.uint64(1)
    out = np.empty((n, tables * (1 + probes)), np.uint64)
    for t in range(tables):
        # sqrt(dim / 64): the scale is that of 64 dimensions
        basis = np.linalg.qr(rng.normal(size=(width, 8 * blocks)))[0] * math.sqrt(width / 64) / scale
        x = padded @ basis
        cells = np.empty((n, 8 * blocks), np.int64)
        cost = np.empty((n, 240 * blocks))
        for b in range(blocks):
            part = x[:, 8 * b : 8 * b + 8]
            point = nearest_e8(part)
            cells[:, 8 * b : 8 * b + 8] = 2 * point
            cost[:, 240 * b : 240 * b + 240] = -(part - point) @ short.T
        nearest = np.argpartition(cost, probes - 1, axis=1)[:, :probes] if probes else np.empty((n, 0), int)
        own = (cells.view(np.uint64) * weights).sum(axis=1, dtype=np.uint64)
        salt = np.uint64((t + 1) * int(GOLDEN) % 2**64)
        out[:, t * (1 + probes)] = mix(own ^ salt)
        for p in range(probes):
            b, v = np.divmod(nearest[:, p], 240)
            moved = own.copy()
            for d in range(8):
                moved += twice[v, d].view(np.uint64) * weights[8 * b + d]
            out[:, t * (1 + probes) + 1 + p] = mix(moved ^ salt)
    return out.view(np.int64)


def usable(column: str):
    """Rows that take part: no null or non-finite component, not all zeros, not empty."""
    col = F.col(column)
    bad = F.exists(col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return col.isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.exists(col, lambda x: x != 0)


def unit_vectors(batches):
    """(id, embedding) batches to (id, dimension, unit vector as bytes of doubles)."""
    for batch in batches:
        units, dims = [], []
        for v in batch.column(1).to_pylist():
            x = np.array(v, np.float64)
            x /= np.abs(x).max()  # no overflow in the norm
            units.append((x / np.linalg.norm(x)).tobytes())
            dims.append(len(x))
        yield pa.record_batch(
            [batch.column(0), pa.array(dims, pa.int32()), pa.array(units, pa.binary())], names=["_id", "dim", "unit"]
        )


#: The rounding step of a component in a bucket's payload.
STEP = 1 / 32767


def embedding_components(
    spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
    threshold: float = 0.9, scale: float = 0.3, probes: int = 4, seed: int = 8,
) -> DataFrame:
    """One row per input row: (id_col, n_links, component_id, kept) of links at cosine >= threshold.

    n_links counts the other rows linked directly, component_id is the smallest id reachable, kept
    marks the row that stands for its component. Vectors that are null, empty, zero or hold a null or
    non-finite component link with nothing (n_links 0, own component, kept). Vectors of different
    dimension don't link. Rows that repeat an id are rows of their own and of them all that equal the
    component's id are kept; a null id takes part, is never a component's id while another is there,
    and is not kept (null). An empty table gives an empty one; other columns are ignored.

    Equal vectors are one node with a count. Keys travel first, and payloads of 16-bit components only
    with the rows that meet another, to be compared block against block; rows with a cosine within
    rounding of the threshold meet again as doubles. Links are then counted on the doubles over the
    pairs of each component, so that a pair counts once however often it met.
    """
    scratch = Scratch(spark, "lattice")
    source = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("_v"))
    good = source.where(usable("_v")).mapInArrow(unit_vectors, "_id long, dim int, unit binary")
    good = scratch.keep(good)
    classes = good.groupBy("dim", "unit").agg(F.min("_id").alias("low"), F.count("*").alias("n"))
    classes = scratch.keep(classes.withColumn("node", F.monotonically_increasing_id()))

    blocks, tables = layout(classes.count())

    def rows_of(batches):
        for batch in batches:
            units = batch.column(2).to_pylist()
            nodes = batch.column(0).to_numpy()
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                for cut in range(0, len(at), 1024):
                    part = at[cut : cut + 1024]
                    x = np.frombuffer(b"".join(units[i] for i in part)).reshape(len(part), -1)
                    keys = lattice_keys(x, blocks, tables, probes, scale, seed + int(dim))
                    payload = [r.tobytes() for r in np.rint(x / STEP).astype(np.int16)]
                    yield pa.record_batch(
                        [pa.array(nodes[part]), pa.array(list(keys), pa.list_(pa.int64())), pa.array(payload)],
                        names=["id", "keys", "payload"],
                    )

    cells = classes.select("node", "dim", "unit").mapInArrow(rows_of, "id long, keys array<long>, payload binary")
    cells = scratch.keep(cells)

    def band_of(dim):
        return STEP * math.sqrt(dim) + dim * STEP * STEP + 1e-5  # what rounding and single precision may add

    def screen(left, right):
        cos = np.einsum("ij,ij->i", left.astype(np.float32), right.astype(np.float32)) * (STEP * STEP)
        return cos >= threshold - band_of(left.shape[1])

    def compare(left, right):
        band = band_of(left.shape[1])
        cos = left.astype(np.float32) @ right.T.astype(np.float32) * (STEP * STEP)
        return (cos >= threshold - band) * np.int8(2) - (cos >= threshold + band)

    links = settled_links(
        cells.select(F.explode(F.array_distinct("keys")).alias("k"), "id"), cells.select("id", "payload"), scratch, compare, "int16",
        classes.select(F.col("node").alias("id"), F.col("unit").alias("payload")), lambda x, y: x @ y.T >= threshold, "float64", screen=screen,
    )
    linked = scratch.keep(connected_components(links, scratch))

    # the component's smallest node has no row of its own in ``linked`` links: add it, then count
    roots = linked.select(F.col("component").alias("node"), "component").distinct()
    members = scratch.keep(linked.unionAll(roots).distinct())
    counted = scratch.keep(link_counts(classes, members, threshold, scratch))
    named = classes.join(members, "node", "left").join(counted, "node", "left")
    named = scratch.keep(named.select("dim", "unit", "low", "n", F.coalesce("component", "node").alias("component"), "links"))
    lows = scratch.keep(named.where("links is not null").groupBy("component").agg(F.min("low").alias("lowest")))
    named = scratch.keep(
        named.join(lows, "component", "left").select(
            "dim", "unit", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("lowest", "low").alias("component_id"),
        )
    )
    found = good.join(named, ["dim", "unit"]).select("_id", "n_links", "component_id")
    alone = source.where(~usable("_v")).select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"))
    return found.unionAll(alone).select(
        F.col("_id").alias(id_col), "n_links", "component_id", (F.col("_id") == F.col("component_id")).alias("kept")
    )


def link_counts(classes: DataFrame, members: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """(node, links): of each member, the rows of other nodes of its component at the threshold."""
    rows = members.join(classes.select("node", "n", "unit"), "node")
    rows = rows.select(
        F.col("component").alias("k"), F.col("node").alias("id"),
        # the count rides in front of the vector, as a double: exact below 2**53
        F.concat(F.col("n").cast("string"), F.lit("|")).cast("binary").alias("head"), F.col("unit").alias("payload"),
    ).withColumn("payload", F.concat(F.lpad(F.col("head").cast("string"), 16, "0").cast("binary"), "payload")).drop("head")

    def run(batches):
        ids_out, links_out, held = [], [], 0
        for _, lo, hi, part, ids, payload in grouped(batches, "uint8"):
            counts = np.array([int(bytes(r[:15])) for r in payload], np.int64)
            x = np.ascontiguousarray(payload[:, 16:]).view(np.float64)
            left, right = np.flatnonzero(part == lo[0]), np.flatnonzero(part == hi[0])
            if not len(left) or not len(right):
                continue
            near = x[left] @ x[right].T >= threshold
            if lo[0] == hi[0]:
                np.fill_diagonal(near, False)
                ids_out.append(ids[left])
                links_out.append(near @ counts[right])
            else:
                ids_out += [ids[left], ids[right]]
                links_out += [near @ counts[right], near.T @ counts[left]]
            held += len(ids)
            if held > 20_000:
                yield pa.record_batch([np.concatenate(ids_out), np.concatenate(links_out)], names=["node", "links"])
                ids_out, links_out, held = [], [], 0
        if held:
            yield pa.record_batch([np.concatenate(ids_out), np.concatenate(links_out)], names=["node", "links"])

    return meet(blocked(rows, scratch)).mapInArrow(run, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
