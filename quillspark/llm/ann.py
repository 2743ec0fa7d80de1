"""Approximate nearest neighbours by stable projections in a kd-tree.

Vectors are projected to a few dimensions with Gaussian (2-stable) coefficients, so that a squared
projected distance over the squared true one follows a chi-square law. A kd-tree cuts the projected
space into cells. Each query verifies rows by growing projected distance and stops when the law says
that an unseen row is nearer than its k-th found with less than a chosen chance.
"""

from __future__ import annotations

import math
import pickle
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..workspace import Scratch
from .buckets import grouped, meet
from .lattice import usable

#: Rows that a cell should have, and those of a cell that one group holds.
CELL, GROUP_ROWS, GROUP_QUERIES = 512, 4096, 1024
#: Rows of a cell on which its own tree is fitted, and more than the cells that this gives.
SAMPLE, FAN = 20_000, 4096
#: Rows of a cell that one task locates, and cells that a query visits before its bound is drawn anew.
PART_ROWS, NEAREST = 100_000, 8


def chi_square_quantile(p: float, degrees: int) -> float:
    """x with P(chi-square <= x) = p, for an even number of degrees."""
    def below(x: float) -> float:
        term = total = 1.0
        for i in range(1, degrees // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    lo, hi = 0.0, 10.0 * degrees + 100
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


class KdTree:
    """Cells of a box of the projected space: median cuts along the widest side, fitted on a sample."""

    def __init__(self, points: np.ndarray, cells: int, low: np.ndarray, high: np.ndarray) -> None:
        self.cuts: list[tuple[int, float, int, int]] = []  # axis, value, left, right (cells: -1 - number)
        lows: list[np.ndarray] = []
        highs: list[np.ndarray] = []
        self.root = self._build(points, cells, low, high, lows, highs)
        self.low, self.high = np.array(lows), np.array(highs)

    def _build(self, points: np.ndarray, cells: int, low: np.ndarray, high: np.ndarray, lows: list, highs: list) -> int:
        spread = np.ptp(points, axis=0) if len(points) > 1 else np.zeros(len(low))
        if cells <= 1 or not spread.max() > 0:
            lows.append(low)
            highs.append(high)
            return -len(lows)
        axis = int(spread.argmax())
        value = float(np.median(points[:, axis]))
        if not (points[:, axis] > value).any():  # most share the median: cut below it
            value = float(points[points[:, axis] < value, axis].max())
        left = points[:, axis] <= value
        at = len(self.cuts)
        self.cuts.append((axis, value, 0, 0))
        below, above = high.copy(), low.copy()
        below[axis], above[axis] = value, value
        sides = self._build(points[left], cells // 2, low, below, lows, highs), self._build(points[~left], cells - cells // 2, above, high, lows, highs)
        self.cuts[at] = (axis, value, *sides)
        return at

    def cell_of(self, points: np.ndarray) -> np.ndarray:
        out = np.empty(len(points), np.int64)
        stack = [(self.root, np.arange(len(points)))]
        while stack:
            node, at = stack.pop()
            if node < 0:
                out[at] = -1 - node
            elif len(at):
                axis, value, left, right = self.cuts[node]
                go = points[at, axis] <= value
                stack += [(left, at[go]), (right, at[~go])]
        return out

    def gaps(self, points: np.ndarray) -> np.ndarray:
        """Squared distance of each point to each cell."""
        out = np.zeros((len(points), len(self.low)))
        for d in range(points.shape[1]):
            x = points[:, d, None]
            gap = np.maximum(np.maximum(self.low[None, :, d] - x, x - self.high[None, :, d]), 0)
            out += gap * gap
        return out


def projection(dim: int, dims: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).normal(size=(dim, dims))


def search_group(ids, vectors, shadows, queries, quantile, k):
    """Of each query (id, vector, shadow, bound): its k nearest rows of a group, as columns.

    shadows are projections, bound is the squared distance of the k-th found so far."""
    out = [], [], []
    by = np.argsort(ids, kind="stable")
    ids, vectors, shadows = ids[by], vectors[by], shadows[by]
    for qid, q, shadow, bound in queries:
        far = ((shadows - shadow) ** 2).sum(axis=1)
        line = bound * quantile
        order = np.flatnonzero(far <= line)
        order = order[np.argsort(far[order], kind="stable")]
        best_d, best_i = np.empty(0), np.empty(0, np.int64)
        at, size = 0, 64
        while at < len(order) and far[order[at]] <= line:
            part = order[at : at + size]
            at, size = at + size, min(size * 2, 2048)
            part = part[ids[part] != qid]
            d = np.sqrt(((vectors[part] - q) ** 2).sum(axis=1))
            best_d, best_i = np.concatenate([best_d, d]), np.concatenate([best_i, ids[part]])
            keep = np.lexsort((best_i, best_d))[:k]
            best_d, best_i = best_d[keep], best_i[keep]
            if len(best_d) == k:  # the stopping test: what lies further out is nearer with small chance
                line = min(line, best_d[-1] ** 2 * quantile)
        out[0].append(np.full(len(best_i), qid))
        out[1].append(best_i)
        out[2].append(best_d)
    return [np.concatenate(x) if x else np.empty(0) for x in out]


def nearest(
    spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id",
    vector_col: str = "embedding", dims: int = 8, chance: float = 0.97, seed: int = 6, sample: int = SAMPLE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows found, by Euclidean distance in
    double precision, ties to the smaller id; fewer if there are fewer. A query's own id is no
    candidate. chance: with which each true neighbour is within what the stopping test lets be seen.

    Vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do
    null ids; vectors of different dimension never meet. Of rows that repeat id and vector one counts; an
    id with several vectors is a candidate with each. Empty tables give an empty result; other
    columns are ignored.

    All rows are indexed. The kd-tree grows level by level until its cells hold few rows, whatever the
    table: the cuts of a cell come from about ``sample`` of its rows, chosen by hash, and are made where
    the sample is gathered. Of equal vectors only the k + 1 smallest ids can be among the nearest, so
    others don't travel. A query searches its own cell; the k-th distance found bounds the cells in
    reach, of which the nearest are searched next and the rest by the bound that these leave. Queries
    and rows of a cell meet in groups of bounded size, and of a group a query verifies rows by
    growing projected distance until the test holds.
    """
    scratch = Scratch(spark, "ann")
    quantile = chi_square_quantile(chance, dims)

    def prepared(frame: DataFrame) -> DataFrame:
        rows = frame.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))

        def shade(batches):
            known: dict[int, np.ndarray] = {}
            for batch in batches:
                units, sizes = [], []
                for v in batch.column(1).to_pylist():
                    x = np.array(v, np.float64)
                    if len(x) not in known:
                        known[len(x)] = projection(len(x), dims, seed)
                    units.append(x.tobytes() + (x @ known[len(x)]).tobytes())
                    sizes.append(len(x))
                yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(units, pa.binary())], names=["id", "k", "payload"])

        good = rows.where(F.col("id").isNotNull() & usable("v"))
        return scratch.keep(good.mapInArrow(shade, "id long, k long, payload binary").dropDuplicates(["id", "payload"]))

    asked = prepared(queries)
    rows = prepared(vectors)
    salt = F.pmod(F.xxhash64("id"), F.lit(32))
    first = F.row_number().over(Window.partitionBy("payload", "salt").orderBy("id"))
    again = F.row_number().over(Window.partitionBy("payload").orderBy("id"))
    rows = rows.withColumn("salt", salt).withColumn("r", first).where(F.col("r") <= k + 1)
    rows = scratch.keep(rows.withColumn("r", again).where(F.col("r") <= k + 1).drop("salt", "r"))
    return search(scratch, rows, asked, dims, quantile, k, sample)


def shadows(payload: list[bytes], dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(p[-8 * dims :] for p in payload)).reshape(-1, dims)


def grow(rows: DataFrame, boxes: DataFrame, big: DataFrame, dims: int, sample: int, level: int) -> DataFrame:
    """(k, tree, low, high): the tree of each cell of ``big`` and, with no tree, the boxes of its new cells."""

    def build(key, frame):
        points = shadows(frame["payload"].tolist(), dims)
        low, high = (np.frombuffer(frame[c].iloc[0]).copy() for c in ("low", "high"))
        tree = KdTree(points, max(1, min(int(frame["n"].iloc[0]) // CELL, len(points) // 8, FAN)), low, high)
        out = [(key[0], pickle.dumps(tree), None, None)]
        out += [(key[0] * FAN + i, None, a.tobytes(), b.tobytes()) for i, (a, b) in enumerate(zip(tree.low, tree.high))]
        return pd.DataFrame(out, columns=["k", "tree", "low", "high"])

    place = F.pmod(F.xxhash64("id", F.lit(level)), F.lit(2**40)) / F.lit(2.0**40)
    chosen = rows.join(big, "k").where(place * F.col("n") < sample)
    chosen = chosen.select("k", F.substring("payload", F.length("payload") - 8 * dims + 1, F.lit(8 * dims)).alias("payload"), "n").join(boxes, "k")
    return chosen.groupBy("k").applyInPandas(build, "k long, tree binary, low binary, high binary")


COLUMNS = ["k", "id", "payload", "bound", "home", "gap"]


def descend(rows: DataFrame, trees: DataFrame, big: DataFrame, dims: int, reach: float | None) -> DataFrame:
    """COLUMNS of rows a level down: k the new cell of each row or, with ``reach``, a row for every new cell
    at a squared gap of at most ``reach`` bounds. Rows meet their cell's tree in parts of bounded size."""
    stay = rows.join(big, "k", "left_anti").withColumn("k", F.col("k") * FAN)
    parts = big.select("k", F.ceil(F.col("n") / PART_ROWS).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")
    move = rows.join(parts, "k").select("k", part, F.lit(1).alias("kind"), *COLUMNS[1:])
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("bound", "double"), ("home", "long"), ("gap", "double"))]
    tree = trees.where("tree is not null").join(parts, "k").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tree = tree.select("k", "part", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("id"), F.col("tree").alias("payload"), *nothing)
    both = tree.unionAll(move).repartition("k", "part").sortWithinPartitions("k", "part", "kind")

    def run(batches):
        tree = None
        for batch in batches:
            kind = batch.column(2).to_numpy()
            starts = np.flatnonzero(kind == 0)
            for start, end in zip([-1, *starts.tolist()], [*starts.tolist(), len(kind)]):
                if start >= 0:
                    tree = pickle.loads(batch.column(4)[start].as_py())
                for at in range(start + 1, end, 2048):
                    yield from moved(tree, batch.slice(at, min(2048, end - at)))

    def moved(tree, batch):
        k = batch.column(0).to_numpy() * FAN
        s = shadows(batch.column(4).to_pylist(), dims)
        if reach is None:
            gap = batch.column(7)
            i, cells = np.arange(len(k)), tree.cell_of(s)
        else:
            gaps = tree.gaps(s)
            bounds = batch.column(5).to_numpy(zero_copy_only=False)
            i, cells = np.nonzero(gaps <= bounds[:, None] * reach)
            gap = gaps[i, cells]
        for at in range(0, len(i), 20_000):
            own = slice(at, at + 20_000)
            part = batch.take(pa.array(i[own]))
            columns = [pa.array(k[i[own]] + cells[own]), *part.columns[3:7], part.column(7) if reach is None else pa.array(gap[own])]
            yield pa.record_batch(columns, names=COLUMNS)

    found = both.mapInArrow(run, "k long, id long, payload binary, bound double, home long, gap double")
    return stay.select(*COLUMNS).unionAll(found)


def search(scratch, rows, asked, dims, quantile, k, sample) -> DataFrame:
    """``nearest`` of rows and questions (id, k, payload), k the dimension and so the first cell."""
    spread = lambda x: F.unhex(F.lit(np.full(dims, x).tobytes().hex()))
    boxes = scratch.keep(rows.select("k").distinct().select("k", spread(-np.inf).alias("low"), spread(np.inf).alias("high")))
    blank = {"bound": F.lit(None).cast("double"), "home": F.lit(None).cast("long"), "gap": F.lit(0.0)}
    located, questions = (x.withColumns(blank).select(*COLUMNS) for x in (rows, asked))
    first = questions
    levels = []
    total = rows.count()
    # a level divides a cell by up to sample / 8; two more for cells that the sample cut unevenly
    for level in range(2 + math.ceil(math.log(max(total / CELL, 1)) / math.log(max(sample / 8, 2)))):
        big = scratch.keep(located.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > (GROUP_ROWS if level else CELL)))
        if big.isEmpty():
            break
        trees = scratch.keep(grow(located, boxes, big, dims, sample, level))
        # a cell whose rows are all alike has no tree to speak of; it goes on in blocks
        big = scratch.keep(big.join(trees.where("tree is not null").select("k"), "k", "left_semi"))
        located = scratch.keep(descend(located, trees, big, dims, None))
        questions = scratch.keep(descend(questions, trees, big, dims, None))
        boxes = scratch.keep(
            boxes.join(big, "k", "left_anti").withColumn("k", F.col("k") * FAN)
            .unionAll(trees.where("tree is null").select("k", "low", "high"))
        )
        levels.append((trees, big))
    sizes = scratch.keep(located.groupBy("k").agg(F.ceil(F.count("*") / GROUP_ROWS).cast("int").alias("nb")))
    located = located.join(sizes, "k").select("k", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int").alias("lo"), "id", "payload")

    def run(batches):
        for _, _, _, part, ids, payload in grouped(batches, "float64"):
            theirs = np.flatnonzero(part == 1)
            x = payload[part == 0]
            if not len(theirs) or not len(x):
                continue
            v, s = slice(0, payload.shape[1] - dims - 1), slice(payload.shape[1] - dims - 1, -1)
            qs = [(int(ids[i]), payload[i, v], payload[i, s], payload[i, -1]) for i in theirs]
            q, i, d = search_group(ids[part == 0], x[:, v], x[:, s], qs, quantile, k)
            yield pa.record_batch([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(d, pa.float64())], names=["query_id", "vec_id", "score"])

    def bounded(batches):
        """(k, id, payload, bound) to (k, id, payload with the bound behind it)."""
        for batch in batches:
            payload = [p + struct.pack("<d", b) for p, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(payload, pa.binary())], names=["k", "id", "payload"])

    def visit(visits: DataFrame) -> DataFrame:
        """Rows found by visits (k, id, payload, bound). Queries of a cell come in blocks."""
        visits = scratch.keep(visits.select("k", "id", "payload", "bound"))
        blocks = scratch.keep(visits.groupBy("k").agg(F.ceil(F.count("*") / GROUP_QUERIES).cast("int").alias("qb")))
        q = visits.mapInArrow(bounded, "k long, id long, payload binary")
        q = q.join(blocks, "k").withColumn("hi", F.pmod(F.xxhash64("id", F.lit(7)), F.col("qb")).cast("int"))
        q = q.join(sizes, "k").withColumn("lo", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        q = q.select("k", "lo", "hi", F.lit(1).alias("part"), "id", "payload")
        r = located.join(blocks, "k").withColumn("hi", F.explode(F.sequence(F.lit(0), F.col("qb") - 1)))
        r = r.select("k", "lo", "hi", F.lit(0).alias("part"), "id", F.concat("payload", F.unhex(F.lit("0000000000000000"))).alias("payload"))
        return meet(r.unionAll(q)).mapInArrow(run, "query_id long, vec_id long, score double")

    def best(found: DataFrame) -> DataFrame:
        line = Window.partitionBy("query_id").orderBy("score", "vec_id")
        # the same id comes twice only with several vectors: its nearest counts
        one = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        return one.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= k)

    def bounds(found: DataFrame) -> DataFrame:
        """(id, bound): the squared distance of each query's k-th row found; without k rows none."""
        reach = found.groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("d"))
        return scratch.keep(reach.where(F.col("n") >= k).select(F.col("query_id").alias("id"), (F.col("d") * F.col("d")).alias("bound")))

    endless = F.lit(float("inf"))
    found = scratch.keep(best(visit(questions.withColumn("bound", endless))))
    # all cells in reach of each vector asked about, but its own
    home = questions.select("id", "payload", F.col("k").alias("home"))
    more = first.drop("bound", "home").join(bounds(found), "id", "left").withColumn("bound", F.coalesce("bound", endless))
    more = more.join(home, ["id", "payload"]).select(*COLUMNS)
    for trees, big in levels:
        more = scratch.keep(descend(more, trees, big, dims, quantile))
    line = F.row_number().over(Window.partitionBy("id", "payload").orderBy("gap", "k"))
    more = scratch.keep(more.where("k <> home").withColumn("place", line))
    near = visit(more.where(F.col("place") <= NEAREST))
    found = scratch.keep(best(found.select("query_id", "vec_id", "score").unionAll(near)))
    far = more.where(F.col("place") > NEAREST).drop("bound").join(bounds(found), "id", "left")
    far = far.withColumn("bound", F.coalesce("bound", endless)).where(F.col("gap") <= F.col("bound") * quantile)
    found = best(found.select("query_id", "vec_id", "score").unionAll(visit(far)))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
