"""Timers of a stream: what stops when no request comes."""

import time

from quillspark.streaming import events


def test_keys_stop_when_the_clock_says_so_and_start_again(spark, tmp_path):
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "state")

    def come(keys):
        spark.createDataFrame([(k, "x") for k in keys], "user_id long, what string").coalesce(1).write.mode("append").parquet(folder)

    def run(until):
        """Runs the stream, from its checkpoint on, until as many rows were written in all."""
        stream = events.idle_timers(spark.readStream.schema("user_id long, what string").parquet(folder), after=2)
        query = stream.writeStream.option("checkpointLocation", checkpoint).option("path", str(tmp_path / "out")).trigger(processingTime="500 milliseconds").start()
        told, end = [], time.time() + 90
        while len(told) < until and time.time() < end:
            assert not query.exception()
            time.sleep(0.5)
            told = spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect() if (tmp_path / "out").exists() else []
        query.stop()
        return sorted((r["user_id"] is None, r["user_id"] or 0, r["at"], r["what"], r["n"]) for r in told)

    come([1, 1, 1, 2, None])
    told = run(6)
    by_key = lambda k: [(what, n) for null, key, _, what, n in told if (None if null else key) == k]
    assert by_key(1) == [("start", 0), ("stop", 3)]
    assert by_key(2) == by_key(None) == [("start", 0), ("stop", 1)]
    come([2, 2])
    told = run(8)
    assert by_key(2) == [("start", 0), ("stop", 1), ("start", 0), ("stop", 2)]
    assert by_key(1) == [("start", 0), ("stop", 3)]
