"""Streams of change events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import listing
from ..workspace import file_system


def debounce(events: DataFrame, keys: tuple[str, ...] = (), quiet: str = "3 seconds", late: str = "1 minute") -> DataFrame:
    """One row per burst of events (ts, keys): its start, end and count. A burst ends with ``quiet`` time
    without an event. On a stream a burst comes out once the watermark has passed it."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    burst = F.session_window("ts", quiet)
    # a streaming session needs a key beside the window
    out = rows.withColumn("_all", F.lit(0)).groupBy(burst.alias("w"), "_all", *keys).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return out.select(*keys, "first_ts", "last_ts", "n")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, kind, source): what happened between two scans (path, hash) of a folder: "created", "modified",
    "deleted" and "moved", with the path that a moved file had. A file that came with the bytes of one
    that went has moved; of several with these bytes the first path counts."""
    gone = before.join(after.select("path"), "path", "left_anti")
    come = after.join(before.select("path"), "path", "left_anti")
    first = gone.groupBy("hash").agg(F.min("path").alias("source"))
    moved = come.join(first, "hash", "left")
    used = moved.select(F.col("source").alias("path")).where("path is not null").distinct()
    none = F.lit(None).cast(before.schema["path"].dataType).alias("source")
    both = after.join(before.select("path", F.col("hash").alias("_h")), "path").where(F.col("hash") != F.col("_h"))
    return (
        moved.select("path", F.when(F.col("source").isNull(), "created").otherwise("moved").alias("kind"), "source")
        .unionAll(both.select("path", F.lit("modified").alias("kind"), none))
        .unionAll(gone.join(used, "path", "left_anti").select("path", F.lit("deleted").alias("kind"), none))
    )


def idle(requests: DataFrame, after: int = 300, key: str = "user_id") -> DataFrame:
    """(key, starts, busy_sec) of requests (key, ts): how often something that stops when ``after`` seconds
    bring no request is started, and how long it runs in all."""
    line = Window.partitionBy(key).orderBy("ts")
    second = F.unix_seconds("ts")
    rows = requests.select(key, (second - F.lag(second).over(line)).alias("gap"), (F.lead(second).over(line) - second).alias("next"))
    busy = F.sum(F.least(F.coalesce("next", F.lit(after)), F.lit(after)))
    return rows.groupBy(key).agg(F.count_if(F.col("gap").isNull() | (F.col("gap") > after)).alias("starts"), busy.alias("busy_sec"))


def idle_timers(requests: DataFrame, after: float = 300, key: str = "user_id") -> DataFrame:
    """(key, what, at, n) of a stream of requests: "start" when a key's first request comes, "stop" when
    ``after`` seconds of the clock have brought it none, with the n requests in between; then it may start
    again. ``idle`` tells the same of a table by the requests' own times.

    A key's state is a number, kept with a timer that each of its requests sets anew; timers are looked at in
    every batch, also in those without requests, and survive a restart with the checkpoint. Null keys
    are one key. Other columns are ignored.
    """
    import pandas as pd

    schema = f"{key} {requests.schema[key].dataType.simpleString()}, what string, at timestamp, n long"

    def step(keys, batches, state):
        n = sum(map(len, batches))
        at = pd.Timestamp(state.getCurrentProcessingTimeMs(), unit="ms")
        row = lambda what, n: pd.DataFrame({key: [keys[0]], "what": [what], "at": [at], "n": [n]})
        if state.hasTimedOut:
            (served,) = state.get
            state.remove()
            yield row("stop", served)
            return
        running = state.exists
        state.update(((state.get[0] if running else 0) + n,))
        state.setTimeoutDuration(int(after * 1000))
        if not running:
            yield row("start", 0)

    return requests.select(key).groupBy(key).applyInPandasWithState(step, schema, "n long", "append", "ProcessingTimeTimeout")


def run_until(stream: DataFrame, name: str, checkpoint: str, stop, poll: float = 0.2) -> None:
    """Runs a stream into a memory table until ``stop()`` says so; the batch at hand is ended first."""
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
    while not query.awaitTermination(poll):
        if stop():
            query.processAllAvailable()
            query.stop()
            return


def watch(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of the change records (kind, path, is_dir, ...) that appear as JSON files below a folder. With
    these columns, records of folders and of kinds other than created, modified, deleted and moved are
    left out."""
    rows = spark.readStream.schema(schema).option("recursiveFileLookup", True).json(path)
    if "is_dir" in rows.columns:
        rows = rows.where(~F.coalesce("is_dir", F.lit(False)))
    return rows.where(F.col("kind").isin("created", "modified", "deleted", "moved")) if "kind" in rows.columns else rows


def watch_folder(spark: SparkSession, folder: str, state: str, interval: str = "3 seconds", skip: str | None = None, once: bool = False):
    """A running query that lists a folder's files at every interval and writes what happened to them since the
    last listing, (path, kind, source) as in ``changes``, below ``state``/changes. Readers stream from there
    (``watched``). once: one listing, then it ends.

    A listing is a table of its batch, never the driver's, and a batch that is run again after a failure
    compares with the same earlier listing, or finds its changes written: each is told once. No file
    is opened: a file is modified if its time or length changed, and moved if one with its time and length
    went in the same interval. The first listing tells of every file as created. ``skip``: a folder
    whose files are left out; ``state`` lies outside ``folder`` or is that folder.
    """
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()

    def compare(_, batch: int) -> None:
        fs, told = file_system(spark, f"{state}/changes/batch={batch}/_SUCCESS")
        if fs.exists(told):  # it failed after its changes were written
            return
        now = listing(spark, folder, skip).select("path", F.concat_ws("/", "mtime", "length").alias("hash"))
        now.write.mode("overwrite").parquet(f"{state}/listing/{batch}")
        now = spark.read.parquet(f"{state}/listing/{batch}")
        before = spark.read.parquet(f"{state}/listing/{batch - 1}") if batch else now.limit(0)
        found = changes(before, now).withColumn("at", F.current_timestamp())
        found.write.mode("overwrite").parquet(f"{state}/changes/batch={batch}")
        if batch > 1:  # no batch before this one can be run again
            fs.delete(file_system(spark, f"{state}/listing/{batch - 2}")[1], True)

    stream = ticks.writeStream.foreachBatch(compare).option("checkpointLocation", f"{state}/checkpoint")
    return stream.trigger(processingTime=interval).start() if not once else _one_batch(stream)


def _one_batch(stream):
    """A started query that has ended its next batch; of batches that come as fast as they can it takes one."""
    query = stream.trigger(processingTime="1 day").start()
    while query.isActive and query.lastProgress is None:
        query.awaitTermination(0.1)
    query.stop()
    if query.exception():
        raise query.exception()
    return query


def watched(spark: SparkSession, state: str) -> DataFrame:
    """The stream of a watched folder's changes: (path, kind, source, at, batch)."""
    return spark.readStream.schema("path string, kind string, source string, at timestamp, batch long").parquet(f"{state}/changes")


def latest(results: DataFrame, key: str = "user_id", order: str = "request_id") -> DataFrame:
    """Of each key the result of its newest request."""
    cols = [c for c in results.columns if c != key]
    return results.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("r")).select(key, "r.*")


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what is there into a memory table, and stops."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
