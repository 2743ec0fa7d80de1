"""Order-based context: neighbours, headings, history and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip


def neighbours(chunks: DataFrame, partition: str = "doc_id", order: str = "seq", keep: tuple[str, ...] = ("content",)) -> DataFrame:
    """Each chunk with the previous and next of its document; never across documents."""
    line = Window.partitionBy(partition).orderBy(order)
    return chunks.withColumns({f"{side}_{c}": f(c).over(line) for side, f in (("prev", F.lag), ("next", F.lead)) for c in (order, *keep)})


def heading_before(chunks: DataFrame, max_chars: int = 120) -> DataFrame:
    """(seq, heading): the previous chunk's first non-blank line, if that is text and short enough."""
    line = Window.partitionBy("doc_id").orderBy("seq")
    before = F.lag(F.struct("type", "content")).over(line)
    out = chunks.select("seq", before.alias("p"))
    first = F.get(F.filter(F.transform(F.split("p.content", "\n"), strip), lambda x: x != ""), F.lit(0))
    return out.select("seq", F.when((F.col("p.type") == "text") & (F.length(first) <= max_chars), first).otherwise("").alias("heading"))


def history(turns: DataFrame, last: int = 3) -> DataFrame:
    """Each turn with the last turns before it whose status is ok, oldest first.

    The latest ok turn before a turn is one value carried along the conversation; the one before that is what
    was carried at it, and so on: ``last`` passes over one sort, whatever a conversation's length."""
    line = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = turns.select("conv_id", "turn", "ok", F.struct("turn", "text").alias("_0"))
    for k in range(last):
        rows = rows.withColumn(f"_{k + 1}", F.last(F.when(F.col("ok"), F.col(f"_{k}")), ignorenulls=True).over(line))
    found = F.array(*[F.col(f"_{k}") for k in range(last, 0, -1)])
    return rows.select("conv_id", "turn", F.filter(found, lambda x: x.isNotNull()).alias("history"))


def previous_question(turns: DataFrame) -> DataFrame:
    line = Window.partitionBy("conv_id").orderBy("turn")
    return turns.withColumn("previous", F.lag("text").over(line))


def retain_newest(turns: DataFrame, n: int = 100) -> DataFrame:
    line = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("_r", F.row_number().over(line)).where(F.col("_r") <= n).drop("_r")


def recent_searches(searches: DataFrame, n: int = 10) -> DataFrame:
    """(query, last): the newest distinct queries."""
    return searches.where(F.col("query") != "").groupBy("query").agg(F.max("ts").alias("last")).orderBy(F.desc("last"), "query").limit(n)


def eta(samples: DataFrame, last: int = 5) -> DataFrame:
    """Seconds left by the rate over the last samples (job, ts, done, total); null where it has no sense."""
    line = Window.partitionBy("job").orderBy("ts", "done").rowsBetween(-(last - 1), 0)
    d = F.col("done") - F.first("done").over(line)
    t = (F.unix_micros("ts") - F.unix_micros(F.first("ts").over(line))) / 1e6
    n = F.count("*").over(line)
    good = (n >= 2) & (F.col("total") > 0) & (F.col("done") < F.col("total")) & (d > 0) & (t > 0)
    return samples.select("job", "ts", "done", F.when(good, (F.col("total") - F.col("done")) / (d / t)).alias("eta_sec"))


def half_trend(samples: DataFrame) -> DataFrame:
    """(job, first_half, second_half, leak): growth in either half of a job's ordered values."""
    line = Window.partitionBy("job").orderBy("ts", "value")
    n = F.count("*").over(Window.partitionBy("job"))
    rows = samples.select("job", "ts", "value", F.row_number().over(line).alias("i"), n.alias("n"))
    half = F.floor(F.col("n") / 2)
    at = lambda i: F.max(F.when(F.col("i") == i, F.col("value")))
    out = rows.groupBy("job").agg((at(half) - at(F.lit(1))).alias("first_half"), (at(F.col("n")) - at(half + 1)).alias("second_half"))
    return out.withColumn("leak", F.col("second_half") > 0.5 * F.greatest("first_half", F.lit(0.0)) + 1)


def sample_round_robin(chunks: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Text chunks of 120 characters or more, documents in turn, in an order fixed by the seed."""
    key: Column = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("seq").cast("string")))
    line = Window.partitionBy("doc_id").orderBy(key)
    rows = chunks.where((F.col("type") == "text") & (F.length("content") >= 120))
    rows = rows.withColumn("turn", F.row_number().over(line)).withColumn("_k", key)
    return rows.orderBy("turn", "_k").limit(n).drop("_k")
