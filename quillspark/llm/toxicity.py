"""Toxicity by maximum-scoring segment search.

Training counts in how many labelled documents a word or word beginning occurs, and turns the counts
into log-odds with an informative Dirichlet prior. Scoring scans a document's token scores once and
finds all maximal scoring segments (Ruzzo and Tompa). Segments that chance in clean text would not
give, by extreme-value statistics (Karlin and Altschul), are its toxic passages; their sum statistic
becomes a probability on labelled documents that the counts have not seen.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..workspace import ship
from .buckets import free_name

WORD = re.compile(r"[^\W\d_]+")
#: Lengths of word beginnings that are features beside whole words: inflected forms share them.
BEGINNINGS = (4, 5, 6)
#: Labelled rows used at most; they are chosen by a hash of their id.
MAX_LABELLED = 40_000
#: Words that a task remembers at a time, so that its memory has a bound; it begins anew with the next.
MOST_WORDS = 150_000


@dataclass(frozen=True)
class Model:
    scores: dict[str, float]  # features that differ between the classes: "w:" whole word, "b:" beginning
    neutral: float  # of every other token; below zero
    decay: float  # lambda of the extreme-value law
    scale: float  # K of it
    slope: float  # of the logistic link of the sum statistic
    offset: float


def features(text: str) -> set[str]:
    words = set(WORD.findall(text.lower()))
    found = {"w:" + w for w in words}
    for n in BEGINNINGS:
        found.update("b:" + w[:n] for w in words if len(w) > n)
    return found


class Scores(dict):
    """Token scores by word: the whole word's if it has one, else that of its longest beginning.
    Bounded: it forgets all when it holds MOST_WORDS."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        known = self.model.scores
        found = known.get("w:" + word)
        if found is None:
            for n in reversed(BEGINNINGS):
                if len(word) > n and (found := known.get("b:" + word[:n])) is not None:
                    break
        if found is None:
            found = self.model.neutral
        if len(self) >= MOST_WORDS:
            self.clear()
        self[word] = found
        return found


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), end exclusive, in linear time."""
    if not len(scores):
        return []
    total = np.concatenate(([0.0], np.cumsum(scores)))
    starts: list[int] = []
    ends: list[int] = []
    left: list[float] = []
    right: list[float] = []
    back: list[int] = []  # the nearest earlier candidate that begins lower
    for i in np.flatnonzero(scores > 0).tolist():
        start, lo, hi = i, total[i], total[i + 1]
        while True:
            j = len(starts) - 1
            while j >= 0 and left[j] >= lo:
                j = back[j]
            if j < 0 or right[j] >= hi:
                break
            start, lo = starts[j], left[j]
            del starts[j:], ends[j:], left[j:], right[j:], back[j:]
        starts.append(start)
        ends.append(i + 1)
        left.append(lo)
        right.append(hi)
        back.append(j)
    return [(s, e, float(r - l)) for s, e, l, r in zip(starts, ends, left, right)]


def sum_statistic(model: Model, n: int, found: list[float]) -> tuple[float, list[bool]]:
    """-ln of the chance that clean text of n tokens has segments that score as high together, and
    which segments are significant by themselves (expected less than once)."""
    if not found or not n:
        return 0.0, [False] * len(found)
    own = [model.decay * s - math.log(model.scale * n) for s in found]
    keep = [x > 0 for x in own]
    total, r = sum(x for x in own if x > 0), sum(keep)
    if not r:
        return 0.0, keep
    # P(T_r >= t) ~ exp(-t) t^(r-1) / (r! (r-1)!)
    return max(0.0, total - (r - 1) * math.log(max(total, 1.0)) + math.lgamma(r + 1) + math.lgamma(r)), keep


def assess(model: Model, scores: Scores, text: str) -> tuple[float, list[tuple[int, int, float]]]:
    """(sum statistic, significant segments in tokens) of a text."""
    words = WORD.findall(text.lower())
    if not words:
        return 0.0, []
    values = np.fromiter(map(scores.__getitem__, words), np.float64, len(words))
    if values.max() <= 0:
        return 0.0, []
    segments = maximal_segments(values)
    stat, keep = sum_statistic(model, len(words), [s for _, _, s in segments])
    return stat, [x for x, k in zip(segments, keep) if k]


def probability(model: Model, stat: float) -> float:
    z = model.slope * stat + model.offset
    return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def decay_of(values: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum(p * exp(l * s)) = 1; the mean of s must be below 0."""
    lo, hi = 0.0, 1.0
    f = lambda x: float((weights * np.exp(x * values)).sum()) - 1
    while f(hi) < 0 and hi < 64:
        lo, hi = hi, hi * 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return max(lo, 1e-3)


def fold(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def train(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
    max_labelled: int = MAX_LABELLED, prior: float = 0.02, least: float = 3.0, telling_odds: float = 2.0,
) -> Model:
    """Fits the model on at most ``max_labelled`` labelled rows outside the held-out fold.

    Rows without a label, id or text teach nothing; of several labels of one id the highest counts.
    With rows of one class or none, every document gets the share of toxic rows (0.1 without any).
    prior: the Dirichlet prior's weight as a part of the counts. least: the z score from which a
    feature's log-odds are used, if they are at least ``telling_odds`` away from 0. The chosen ids are broadcast: ``max_labelled`` bounds their size,
    and the features that come to the driver are those of that many documents that pass ``least``.
    """
    ship(spark)
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    known = known.where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & (fold("_id") != 0))
    known = known.groupBy("_id").agg(F.max("_y").alias("_y"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(max_labelled).collect()
    chosen = spark.createDataFrame(pa.table({"_id": [r[0] for r in chosen], "_y": [r[1] for r in chosen]}, schema=to_arrow_schema(known.schema)), known.schema)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_text is not null")
    rows = rows.join(F.broadcast(chosen), "_id").select("_text", "_y", (F.xxhash64("_id", F.lit(1)) % 4 == 0).alias("_late"))

    def count(batches):
        seen: dict[str, list[int]] = {}
        docs_of = [0, 0]

        def out():
            seen[""] = docs_of
            return pa.record_batch(
                [pa.array(list(seen)), pa.array([x[0] for x in seen.values()]), pa.array([x[1] for x in seen.values()])],
                names=["f", "n0", "n1"],
            )

        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist()):
                docs_of[y] += 1
                for f in features(text.as_py()):
                    if (x := seen.get(f)) is None:
                        x = seen[f] = [0, 0]
                    x[y] += 1
            if len(seen) > MOST_WORDS:
                yield out()
                seen, docs_of = {}, [0, 0]
        yield out()

    counts = rows.where("not _late").select("_text", "_y").mapInArrow(count, "f string, n0 long, n1 long")
    counts = counts.groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    # log-odds against the other class, prior in proportion to the feature's frequency in both
    kind = F.when(F.col("f") == "", "").otherwise(F.substring("f", 1, 1))
    counts = counts.withColumn("kind", kind)
    seen_ = counts.persist()
    totals = {r[0]: (float(r[1]), float(r[2])) for r in seen_.groupBy("kind").agg(F.sum("n0"), F.sum("n1")).collect()}
    n0, n1 = totals.get("", (0.0, 0.0))
    share = n1 / (n0 + n1) if n0 + n1 else 0.1
    if not n0 or not n1:
        seen_.unpersist()
        share = min(max(share, 0.01), 0.99)
        return Model({}, -0.01, 1.0, 1.0, 0.0, math.log(share / (1 - share)))
    # documents are the trials, so that long ones don't outweigh short ones
    alpha = prior * (F.col("n0") + F.col("n1"))
    spread = alpha
    odds = lambda n, total: F.log((n + spread * total / (n0 + n1)) / (total * (1 + prior)))
    delta = odds(F.col("n1"), n1) - odds(F.col("n0"), n0)
    # signed root of the likelihood ratio against one share of toxic documents for all features
    both = F.col("n0") + F.col("n1")
    term = lambda n, p: F.when(n > 0, n * F.log(n / (both * p))).otherwise(0.0)
    ratio = F.sqrt(2 * F.greatest(term(F.col("n1"), share) + term(F.col("n0"), 1 - share), F.lit(0.0)))
    marked = seen_.where("kind <> '' and n0 + n1 >= 3").withColumn("delta", delta).withColumn("z", ratio)
    # so many features are tried that chance passes ``least``: about one of them may
    line = max(least, NormalDist().inv_cdf(1 - 0.5 / max(marked.count(), 2)))
    telling = marked.where(F.col("z") >= line).select("f", "delta").collect()
    seen_.unpersist()
    scores = {r["f"]: float(min(max(r["delta"], -4.0), 8.0)) for r in telling if abs(r["delta"]) >= telling_odds}
    model = Model(scores, -0.02, 1.0, 1.0, 0.0, 0.0)
    return calibrate(rows, model, share)


def calibrate(rows: DataFrame, model: Model, share: float) -> Model:
    """Neutral score, extreme-value law and logistic link, from labelled documents not counted."""
    quick = Scores(model)
    floor = model.neutral

    def tally(batches):
        for batch in batches:
            hits0, total0, hits1, total1 = {}, 0, 0, 0
            for text, y in zip(batch.column(0), batch.column(1).to_pylist()):
                values = [quick[w] for w in WORD.findall(text.as_py().lower())]
                told = [round(v, 2) for v in values if v != floor]
                if y:
                    hits1 += len(told)
                    total1 += len(values)
                else:
                    total0 += len(values)
                    for v in told:
                        hits0[v] = hits0.get(v, 0) + 1
            out = [(v, n, 0) for v, n in hits0.items()] + [(None, total0, 0), (99.0, hits1, 1), (None, total1, 1)]
            yield pa.record_batch([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.float64(), pa.int64(), pa.int32()))], names=["v", "n", "y"])

    late = rows.where("_late").select("_text", "_y")
    seen = late.mapInArrow(tally, "v double, n long, y int").groupBy("v", "y").agg(F.sum("n").alias("n")).collect()
    total0 = sum(r["n"] for r in seen if r["v"] is None and not r["y"]) or 1
    total1 = sum(r["n"] for r in seen if r["v"] is None and r["y"]) or 1
    told0 = [(r["v"], r["n"]) for r in seen if r["v"] is not None and not r["y"]]
    told1 = sum(r["n"] for r in seen if r["v"] is not None and r["y"])
    told0_n = sum(n for _, n in told0)
    neutral = math.log(max(1 - told1 / total1, 0.5) / max(1 - told0_n / total0, 0.5))
    neutral = min(neutral, -0.02)
    # the clean law, every positive score once more than seen, so that none is impossible
    law = {round(v, 2): 1.0 for v in set(model.scores.values()) if v > 0}
    for v, n in told0:
        law[v] = law.get(v, 0.0) + n
    rare = sum(law.values())
    shrink = min(1.0, 0.02 * total0 / rare) if rare else 1.0
    law = {v: n * shrink for v, n in law.items()}
    values = np.array([neutral, *law])
    weights = np.array([max(total0 - sum(law.values()), 1.0), *law.values()])
    weights /= weights.sum()
    while (values * weights).sum() >= 0:  # segments need a falling mean
        neutral *= 2
        values[0] = neutral
    decay = decay_of(values, weights)
    model = Model(model.scores, neutral, decay, 1.0, 0.0, 0.0)
    scorer = Scores(model)

    def top(batches):
        for batch in batches:
            out = []
            for text in batch.column(0):
                words = WORD.findall(text.as_py().lower())
                found = maximal_segments(np.array([scorer[w] for w in words]))
                out.append((len(words), max((s for _, _, s in found), default=0.0)))
            yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.float64())], names=["n", "s"])

    clean = late.where("_y = 0").mapInArrow(top, "n long, s double").where("n > 0")
    mean = clean.agg(F.avg(F.col("n") * F.exp(-F.col("s") * decay))).first()[0]
    model = Model(model.scores, neutral, decay, 1 / mean if mean else 1.0, 0.0, 0.0)
    scorer2 = Scores(model)

    def stats(batches):
        for batch in batches:
            found = [round(assess(model, scorer2, x.as_py())[0], 1) for x in batch.column(0)]
            yield pa.record_batch([pa.array(found, pa.float64()), batch.column(1)], names=["x", "y"])

    # tenths up to 60: at most some 1200 rows
    seen = late.mapInArrow(stats, "x double, y int").select(F.least("x", F.lit(60.0)).alias("x"), "y")
    seen = seen.groupBy("x", "y").count().collect()
    x = np.array([r["x"] for r in seen] + [0.0, 60.0])
    y = np.array([r["y"] for r in seen] + [0, 1], float)
    w = np.array([r["count"] for r in seen] + [1, 1], float)
    slope, offset = logistic(x, y, w)
    return Model(model.scores, neutral, decay, model.scale, slope, offset)


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Ridge-regularised logistic regression of y on x; the slope is never below 0."""
    a, b = 0.0, 0.0
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        gradient = design.T @ (w * (y - p)) - np.array([0.5 * a, 0.01 * b])
        curve = (design * (w * p * (1 - p))[:, None]).T @ design + np.diag([0.5, 0.01])
        step = np.linalg.solve(curve, gradient)
        step *= min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(a, 0.0), b


def char_spans(text: str, spans: list[tuple[int, int, float]]) -> list[dict]:
    """Token segments as characters of the lower-cased text's words."""
    words = [(m.start(), m.end()) for m in WORD.finditer(text.lower())]
    return [{"begin": words[s][0], "end": words[e - 1][1], "score": v} for s, e, v in spans]


def score_documents(
    docs: DataFrame, model: Model, text_col: str = "text", spans: bool = False, reject: bool = False
) -> DataFrame:
    """The columns of docs with ``_quill_score`` (0 to 1) and, if asked, ``_quill_passages``: begin,
    end and score of every significant passage. Where docs has a column of such a name the new one's ends
    with ``_``. reject: only rows under 0.5, columns as they were.

    Null, empty and word-less texts get the score of a text without any sign. Every row is scored by
    its whole text alone; nothing is shuffled. An empty table gives an empty one.
    """
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)
    schema = docs.schema if reject else docs.select(
        "*", F.lit(0.0).alias(free_name(docs, "_quill_score")),
        *([F.lit(None).cast("array<struct<begin:int,end:int,score:double>>").alias(free_name(docs, "_quill_passages"))] if spans else []),
    ).schema
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        scores = Scores(model)
        for batch in batches:
            got, where = [], []
            for x in batch.column(at):
                text = x.as_py() or ""
                stat, found = assess(model, scores, text)
                got.append(probability(model, stat))
                if spans:
                    where.append(char_spans(text, found) if found else [])
            if reject:
                yield batch.filter(pa.array([p < 0.5 for p in got], pa.bool_()))
                continue
            more = [pa.array(got, pa.float64())] + ([pa.array(where, kind)] if spans else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=schema.names)

    return docs.mapInArrow(run, schema)


def toxicity(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic",
) -> DataFrame:
    """One row per document: (id_col, held_out, score, predicted, passages).

    held_out: crc32 of the id as text, mod 5, is 0 (a null id: false); such rows never teach. Rows
    that repeat an id are scored each by its own text. See ``train`` and ``score_documents``.
    """
    model = train(spark, docs, labels, id_col, text_col, label_col)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    found = score_documents(rows, model, "_text", spans=True)
    return found.select(
        F.col("_id").alias(id_col), F.coalesce(fold("_id") == 0, F.lit(False)).alias("held_out"),
        F.col("_quill_score").alias("score"), (F.col("_quill_score") >= 0.5).cast("int").alias("predicted"),
        F.col("_quill_passages").alias("passages"),
    )
