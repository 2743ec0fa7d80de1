"""Links of documents by the exact similarity of their sets of word runs.

Of two sets at a similarity (common runs / all runs) of 4/5 or more, each has at most a fifth of its runs
outside the other. So in any order of all runs the first fifth and one more of each set hold a run of the
other's: documents meet on these keys, and no link is lost wherever the texts differ. Common runs come
last in the order, so that hardly any document has them as keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import Scratch, ship
from .buckets import forest_links
from .components import connected_components
from .simhash import CONTRACT, majority, near_links, run_hashes, text_words

WORDS = 8
#: Differing bits of 512 of two fingerprints of sets. At similarity 4/5 they are 78 with a deviation of 8
#: (96 and 9 for the smallest sets): pairs beyond FAR can't link, pairs up to NEAR are verified first.
NEAR, FAR = 78, 150
#: Bits of a sketch: each run of a set flips one. Two sketches differ in no more bits than the sets in runs,
#: and sets that link differ in a ninth of their sizes' sum at most.
SKETCH = 512
#: The keys by which likely links are found before all keys are compared.
FIRST = 4
#: One text in SAMPLE is searched for common runs: those in COMMON texts of it, at most MOST of them.
SAMPLE, COMMON, MOST = 16, 8, 200_000


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches in parts of few rows: what Python makes of a part is gone before the next."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def run_set(raw: bytes | None, size: int) -> np.ndarray:
    """The hashes of the text's runs of ``size`` words, sorted, each once."""
    import xxhash

    found = text_words(raw)
    h = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in found), np.uint64, len(found))
    runs = np.sort(run_hashes(h, size))
    return runs[np.diff(runs, prepend=~runs[:1]) != 0]  # np.unique takes ten times as long on so few


def similar(left: np.ndarray, right: np.ndarray) -> bool:
    """Whether two sets have a similarity of 4/5 or more; two empty sets have."""
    both = len(np.intersect1d(left, right, assume_unique=True))
    return 5 * both >= 4 * (len(left) + len(right) - both)


def sketch(runs: np.ndarray) -> bytes:
    return np.packbits(np.bincount((runs % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) % 2 == 1).tobytes()


def set_keys(runs: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first fifth of a set's runs and one more, in the order of hashes with ``common`` ones (sorted) last.
    The common runs grow with the corpus: a set must not go through all of them."""
    at = np.minimum(np.searchsorted(common, runs), max(len(common) - 1, 0))
    last = common[at] == runs if len(common) else np.zeros(len(runs), bool)
    count = len(runs) + (4 * len(runs)) // -5 + 1 if len(runs) else 0
    return np.concatenate([runs[~last], runs[last]])[:count]


def common_runs(docs: DataFrame, size: int) -> np.ndarray:
    """Runs that many texts have, by a sample of texts. They set the order of keys, not what links."""

    def run(batches):
        for batch in slices(batches):
            sets = [run_set(x, size).view(np.int64) for x in batch.column(0).cast(pa.binary()).to_pylist()]
            yield pa.record_batch([pa.array(sets, pa.list_(pa.int64()))], names=["runs"])

    texts = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").distinct()
    found = texts.mapInArrow(run, "runs array<long>").select(F.explode("runs").alias("run")).groupBy("run").count()
    found = found.where(F.col("count") >= COMMON).orderBy(F.desc("count"), "run").limit(MOST)
    return np.sort(np.array([r["run"] for r in found.collect()], np.int64).view(np.uint64))


def text_sets(rows: DataFrame, keep: list[str], size: int) -> DataFrame:
    """(keep..., text) to the ``keep`` columns, ``node`` (a digest of the text's set of runs), ``n``, its
    number of runs, ``fp``, its fingerprint and sketch, and ``keys``."""
    ship(rows.sparkSession)
    order = common_runs(rows, size)
    schema = rows.select(*keep, F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("n"), F.lit(b"").alias("fp"), F.array().cast("array<long>").alias("keys")).schema

    def run(batches):
        for batch in slices(batches):
            nodes, sizes, fps, keys = [], [], [], []
            for raw in batch.column(len(keep)).cast(pa.binary()).to_pylist():
                runs = run_set(raw, size)
                nodes.append(int.from_bytes(hashlib.sha256(runs.tobytes()).digest()[:8], "little", signed=True))
                sizes.append(len(runs))
                fps.append(majority(runs, WORDS) + sketch(runs))
                keys.append(set_keys(runs, order).view(np.int64))
            columns = [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(fps, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.record_batch([*batch.columns[: len(keep)], *columns], names=[*keep, "node", "n", "fp", "keys"])

    return rows.select(*keep, "text").mapInArrow(run, schema)


def comparer(mark: int, distance: int):
    """(marks of two sets of payloads as a matrix, candidates among rows set against rows): pairs of sizes
    that allow a similarity of 4/5, of other components and at most ``distance`` differing bits.
    Payloads: fingerprint and sketch, then the size and the component as whole numbers."""
    wide = WORDS + SKETCH // 64

    def near(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of rows set against rows."""
        n, m = left[:, wide].astype(np.int64), right[:, wide].astype(np.int64)
        good = (5 * n >= 4 * m) & (5 * m >= 4 * n) & (left[:, wide + 1] != right[:, wide + 1])
        for words, most in ((range(WORDS, wide), (n + m) // 9), (range(WORDS), np.full(len(n), distance))):
            at = np.flatnonzero(good)
            bits = np.zeros(len(at), np.int64)
            for w in words:
                bits += np.bitwise_count(left[at, w] ^ right[at, w])
            good[at] = bits <= most[at]
        return good

    def compare(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        left, right = (np.ascontiguousarray(x).view(np.uint64) for x in (left, right))
        n, m = left[:, wide, None].astype(np.int64), right[None, :, wide].astype(np.int64)
        open_ = (5 * n >= 4 * m) & (5 * m >= 4 * n) & (left[:, wide + 1, None] != right[None, :, wide + 1])
        marks = np.zeros(open_.shape, np.int8)
        i, j = np.nonzero(open_)
        for at in range(0, len(i), 65_536):
            x, y = i[at : at + 65_536], j[at : at + 65_536]
            ok = near(left[x], right[y])
            marks[x[ok], y[ok]] = mark
        return marks

    def screen(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return near(*(np.ascontiguousarray(x).view(np.uint64) for x in (left, right)))

    return compare, screen


def payloads(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            numbers = np.stack([batch.column(i).to_numpy() for i in (1, 2)], axis=1)
            rows = [fp + x.tobytes() for fp, x in zip(batch.column(3).to_pylist(), numbers)]
            yield pa.record_batch([batch.column(0), pa.array(rows, pa.binary())], names=["id", "payload"])

    return classes.select("node", "n", "component", "fp").mapInArrow(run, "id long, payload binary")


def verified(pairs: DataFrame, texts, size: int, scratch: Scratch) -> DataFrame:
    """The (a, b) whose sets are similar. texts(nodes) returns (node, text) of nodes."""

    def sets_of(batches):
        for batch in slices(batches):
            sets = [run_set(x, size).tobytes() for x in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(sets, pa.binary())], names=["node", "runs"])

    def judge(batches):
        for batch in slices(batches):
            left, right = (map(lambda x: np.frombuffer(x, np.uint64), batch.column(i).to_pylist()) for i in (2, 3))
            ok = pa.array([similar(x, y) for x, y in zip(left, right)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(ok)

    nodes = scratch.keep(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    sets = scratch.keep(texts(nodes).mapInArrow(sets_of, "node long, runs binary"))
    both = pairs.hint("merge").join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y").hint("merge"), "b").select("a", "b", "x", "y")
    links = scratch.keep(both.mapInArrow(judge, "a long, b long"))
    scratch.drop(nodes, sets)
    return links


def similar_components(classes: DataFrame, texts, size: int, scratch: Scratch) -> DataFrame:
    """(node, n, fp, keys), one row a distinct set, to (node, component) of nodes that have a link.

    First the sets whose fingerprints the pigeonring filter (``simhash.near_links``, op9's) finds alike are
    verified. What it can't see is completed: likely links that span what meets on a few keys across the
    components so found, then on all keys; last, all keys are searched for every pair across the
    components, of which few are left to link.
    """

    def pairs(found: DataFrame) -> DataFrame:
        return scratch.keep(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    links = verified(pairs(near_links(classes, CONTRACT, scratch)), texts, size, scratch)
    rows = None
    for few, mark, distance in ((True, 1, NEAR), (False, 1, NEAR), (False, 2, FAR)):
        so_far = scratch.keep(connected_components(links, scratch))
        # both sides grow with the corpus: one plan for all sizes
        # sets meet their components before their keys come apart, with the keys that are asked for alone
        labelled = classes.withColumn("keys", F.slice("keys", 1, FIRST) if few else F.col("keys"))
        labelled = labelled.join(so_far.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
        if rows is None:
            named = labelled.select(F.explode("keys").alias("k"), F.col("node").alias("id"), "component")
        else:
            named = rows.join(labelled.select(F.col("node").alias("id"), "component"), "id")
        labelled = scratch.keep(labelled.drop("keys"))
        across = named.groupBy("k").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
        before, open_ = rows, scratch.keep(named.join(across.select("k"), "k").select("k", "id"))
        rows = None if few else open_
        compare, screen = comparer(mark, distance)
        found = pairs(forest_links(open_, scratch, compare, "uint8", payloads=payloads(labelled), screen=screen))
        links = scratch.keep(links.unionAll(verified(found, texts, size, scratch)))
        scratch.drop(labelled, *([before] if before is not None else []), *([open_] if few else []))
    return connected_components(links, scratch)
