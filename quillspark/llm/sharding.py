"""Sharding by histogram sort.

Rows are ordered by a 64-bit hash of their text. Exact bytes below candidate boundaries are counted
over all partitions, and the ranges that hold a splitter are probed more finely until each splitter is
within tolerance; then rows move once.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..workspace import Scratch

#: Bits that one refinement resolves: every splitter's range is counted in so many parts.
STEP_BITS = 9


def row_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def splitters(rows: DataFrame, targets: list[int], tolerance: int) -> list[int]:
    """Of rows (key, size): for each target the boundary, as an unsigned key, below which so many bytes
    lie, within tolerance or to the last bit.

    Every step counts bytes in 2**STEP_BITS parts of each range that holds a target; at most that many
    sums per target come to the driver, whatever the rows.
    """
    found: dict[int, int] = {}
    open_ = {i: (0, 0) for i in range(len(targets))}  # target: prefix of its range, bytes below it
    shift = 64
    while open_ and shift > 0:
        step = min(STEP_BITS, shift)
        prefixes = sorted({p for p, _ in open_.values()})
        inside = rows
        if shift < 64:
            inside = rows.where(F.shiftrightunsigned("key", shift).isin(prefixes))
        shift -= step
        part = F.shiftrightunsigned("key", shift) if shift else F.col("key")
        sums = {int(r[0]) % 2**64: int(r[1]) for r in inside.groupBy(part.alias("p")).agg(F.sum("size")).collect()}
        for i, (prefix, below) in list(open_.items()):
            for p in range(prefix << step, (prefix + 1) << step):
                here = sums.get(p, 0)
                if below + here >= targets[i]:
                    left, right = targets[i] - below, below + here - targets[i]
                    if min(left, right) <= tolerance or not shift:
                        found[i] = (p if left <= right else p + 1) << shift
                        del open_[i]
                    else:
                        open_[i] = (p, below)
                    break
                below += here
            else:
                found[i] = (prefix + 1) << (shift + step)
                del open_[i]
    return [found[i] for i in range(len(targets))]


def dealt(rows: DataFrame, rows_a_task: int, scratch: Scratch) -> DataFrame:
    """Rows (key, spread, shard, ...) with ``run`` and ``deal``: parts of a shard that one task can sort.

    Runs are ranges of the key, so many that they hold half of rows_a_task on the average. One of more
    than rows_a_task, whatever fills it, is dealt by the rows' spread to parts of half of that, so
    that chance fills none much beyond it.
    """
    n = rows.count()
    bits = max(0, (2 * n // rows_a_task).bit_length())
    run = F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long")
    rows = scratch.keep(rows.withColumn("run", run))
    full = rows.groupBy("shard", "run").agg(F.count("*").alias("n")).where(F.col("n") > rows_a_task)
    full = scratch.keep(full.select("shard", "run", F.ceil(2 * F.col("n") / rows_a_task).alias("parts")))
    found = rows.join(full, ["shard", "run"], "left")
    found = found.withColumn("deal", F.coalesce(F.pmod(F.col("spread"), F.col("parts")), F.lit(0).cast("long")))
    found = scratch.keep(found.drop("parts"))
    scratch.drop(rows)
    return found


def shard(
    spark: SparkSession, docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text",
    tolerance: float = 0.002, rows_a_task: int = 2048,
) -> DataFrame:
    """One row per input row: (id_col, size, text_crc32, law "bytes", shard, slot, grown_shard null).

    size is the text's UTF-8 bytes (null: none) plus 1. Shards are nearly equal in bytes: off by twice
    ``tolerance`` of a shard at most, as long as no group of equal texts is larger than what is left of
    a shard. Equal texts stay together; only a group larger than a whole shard is cut, by a hash of id,
    into parts of at most half a shard. slot numbers a shard's rows without a gap from 0, by ranges of the
    text hash; a range of more than ``rows_a_task`` rows, such as the copies of one short text, is dealt
    to parts by a hash of id, so that no task sorts many more rows of one range. Rows that repeat
    are rows of their own. A null text is a group like any other; null ids are allowed; an empty
    table gives an empty one; other columns are ignored.

    Groups of more than ``tolerance`` of a shard are placed whole, the largest first, each in the
    emptiest shard: there are at most shards / tolerance of them (with cut parts, twice that), the only
    rows that reach the driver. What is left of each shard is filled with the rest in hash order.
    """
    scratch = Scratch(spark, "sharding")
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"), row_size(text).alias("size"), F.coalesce(F.crc32(text.cast("binary")), F.lit(0).cast("long")).alias("crc"),
        F.xxhash64(text.isNull(), text).alias("key"),
    ).withColumn("spread", F.xxhash64("id", "crc", F.monotonically_increasing_id()))
    rows = scratch.keep(rows)
    total = int(rows.agg(F.sum("size")).first()[0] or 0)
    goal = -(-total // shards)
    slack = max(1, int(goal * tolerance))
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).where(F.col("bytes") > slack)
    # one text larger than a shard is one row: it can't be cut
    large = [(int(r["key"]), int(r["bytes"]), max(1, min(int(r["n"]), -(-2 * int(r["bytes"]) // goal))) if r["bytes"] > goal else 1) for r in groups.collect()]
    cut = spark.createDataFrame([(k, n) for k, _, n in large], "key long, parts int")
    rows = rows.join(cut, "key", "left").withColumn("piece", F.pmod(F.col("spread"), F.col("parts")))
    rows = scratch.keep(rows)
    parts = rows.where("parts is not null").groupBy("key", "piece").agg(F.sum("size").alias("bytes")).collect()
    filled = [(0, s) for s in range(shards)]
    heapq.heapify(filled)
    place = []
    for key, piece, size in sorted(((int(r[0]), int(r[1]), int(r[2])) for r in parts), key=lambda x: (-x[2], x[0], x[1])):
        held, s = heapq.heappop(filled)
        place.append((key, piece, s))
        heapq.heappush(filled, (held + size, s))
    held = dict((s, n) for n, s in filled)
    light = total - sum(held.values())
    # level the rest: shards over the common level take nothing
    level, order = 0, sorted(held.values())
    for i in range(1, shards + 1):
        level = (sum(order[:i]) + light) / i
        if i == shards or level <= order[i]:
            break
    need, targets = 0.0, []
    for s in range(shards - 1):
        need += max(0.0, level - held[s])
        targets.append(min(light, round(need)))
    bounds = splitters(rows.where("parts is null").select("key", "size"), targets, max(1, slack // 4)) if light else [0] * (shards - 1)
    signed = F.col("key").bitwiseXOR(F.lit(-(2**63)))  # unsigned order as signed
    place_of = F.lit(0)
    for b in bounds:
        if b < 2**64:
            place_of = place_of + (signed >= F.lit(b - 2**63)).cast("int")
    placed = spark.createDataFrame(place, "key long, piece long, at int")
    rows = rows.join(placed, ["key", "piece"], "left")
    rows = rows.withColumn("shard", F.coalesce("at", place_of))
    rows = dealt(rows.select("id", "size", "crc", "key", "spread", "shard"), rows_a_task, scratch)
    sizes = rows.groupBy("shard", "run", "deal").agg(F.count("*").alias("n"))
    first = F.sum("n").over(Window.partitionBy("shard").orderBy("run", "deal")) - F.col("n")
    starts = scratch.keep(sizes.select("shard", "run", "deal", first.alias("first")))
    inside = Window.partitionBy("shard", "run", "deal").orderBy("key", "id", "spread")
    return rows.withColumn("rank", F.row_number().over(inside)).join(starts, ["shard", "run", "deal"]).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("first") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
