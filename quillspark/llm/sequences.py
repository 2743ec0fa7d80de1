"""Sequential patterns by vertical id-lists (cSPADE).

A pattern's id-list has a row per client and end of an occurrence, with the latest start that an occurrence
ending there can have. A prefix grows by an event that comes after such an end, within the gap, and no
later than the span after the start. Of a prefix's ends before an event the last one has the latest start
of all: were there a later start with an earlier end, the two occurrences would cross, and the first part
of one with the second part of the other would end at the later end. So one row of a list, the last before
an event, decides about it: a list's row holds for the events up to its client's next row.

Buckets are one gap wide. Events lie in runs of buckets of a client, together with those of the buckets
before the run that the span reaches: equal keys of client and run. Lists are so never longer than a
run, however many events a client has, and every length's lists are made anew from the events where
they lie, along prefixes and suffixes that are frequent. What leaves a task is which clients support
which candidates, as bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import Scratch, ship

#: Buckets of a run: a tenth of the events or so lie in two runs.
RUN = 16
#: Events that a task looks at together, and rows of lists.
ROWS, STEP = 1 << 14, 1 << 20
#: Candidates of a row of bits: eight words.
WORDS, WIDE = 8, 512
#: Candidates of a row of counts.
SIDE_BY_SIDE = 32


class Miner:
    """Finds the clients' candidates in a stream of events sorted by client, run and time. What it keeps of a run
    that goes on is the last row or two of each list.

    child: of each length the next length's number by pattern and kind, -1 for none (a last column for no
    kind); the last length's are the candidates."""

    def __init__(self, child: list[np.ndarray], gap: int, span: int) -> None:
        self.child, self.gap, self.span = child, gap, span
        self.before = -(-span // gap) * gap
        self.width = RUN * gap
        self.room = self.width + self.before + max(gap, span) + 1
        self.key: tuple | None = None
        self.carried: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def take(self, clients: pa.Array, runs: np.ndarray, at: np.ndarray, kinds: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(clients, chunks, words) of the candidates that are found with these events."""
        other_client = np.ones(len(at), bool)
        other_client[1:] = pc.not_equal(clients.slice(1), clients.slice(0, len(clients) - 1)).to_numpy(zero_copy_only=False)
        firsts = np.flatnonzero(other_client)
        client = np.cumsum(other_client) - 1
        new = other_client.copy()
        new[1:] |= runs[1:] != runs[:-1]
        group = np.cumsum(new) - 1
        goes_on = self.key == (clients[0].as_py(), int(runs[0]))
        carried = self.carried if goes_on else []
        # places of carried rows: events of no kind before the others
        ghosts = np.unique(np.concatenate([x for _, e, s in carried for x in (e, s)])) if carried else np.empty(0, "i8")
        n = len(ghosts)
        at, kinds = np.concatenate([ghosts, at]), np.concatenate([np.full(n, -1), kinds])
        group, client = (np.concatenate([np.zeros(n, "i8"), x]) for x in (group, client))
        runs = np.concatenate([np.full(n, runs[0]), runs])
        key = group * self.room + (at - (runs * self.width - self.before))
        after = np.searchsorted(key, key, "right")
        gap_ends, span_ends = np.searchsorted(key, key + self.gap, "right"), np.searchsorted(key, key + self.span, "right")

        real = np.flatnonzero(kinds >= 0)
        rows = (kinds[real], real, real)
        kept, bits = [], []
        for depth, child in enumerate(self.child):
            if depth < len(carried):
                rows = tuple(np.concatenate([x, y]) for x, y in zip((carried[depth][0], *(np.searchsorted(ghosts, t) for t in carried[depth][1:])), rows))
            pattern, end, start = (x[np.argsort(rows[0], kind="stable")] for x in rows)
            until = np.minimum(gap_ends[end], span_ends[start])
            same = (pattern[1:] == pattern[:-1]) & (group[end[1:]] == group[end[:-1]])
            until[:-1] = np.where(same, np.minimum(until[:-1], after[end[1:]]), until[:-1])
            # the last row, and the one before the end of the part: more events of that time may come
            last = np.append(~same, True)[: len(end)]
            last[:-1] |= (at[end[:-1]] < at[-1]) & (at[end[1:]] == at[-1])
            last &= group[end] == group[-1]
            kept.append((pattern[last], at[end[last]], at[start[last]]))
            found = [self._extend(child, kinds, pattern[i], after[end[i]], until[i], start[i]) for i in self._steps(after[end], until)]
            if depth + 1 < len(self.child):
                rows = tuple(np.concatenate([f[i] for f in found]) if found else np.empty(0, "i8") for i in range(3))
            else:
                bits = [np.unique(client[f[1]] * (-(-(child.max(initial=0) + 1) // WIDE) * WIDE) + f[0]) for f in found]
        self.carried, self.key = kept, (clients[-1].as_py(), int(runs[-1]))
        return self._words(clients.take(pa.array(firsts)), np.unique(np.concatenate(bits)) if bits else np.empty(0, "i8"))

    @staticmethod
    def _steps(low: np.ndarray, high: np.ndarray):
        """Parts of the rows that give at most STEP rows or so each."""
        total = np.cumsum(np.maximum(high - low, 0))
        at = 0
        while at < len(total):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + STEP, "right")))
            yield slice(at, to)
            at = to

    @staticmethod
    def _extend(child, kinds, pattern, low, high, start):
        n = np.maximum(high - low, 0)
        row = np.repeat(np.arange(len(n)), n)
        event = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + low[row]
        made = child[pattern[row], kinds[event]]
        there = made >= 0
        return made[there].astype("i8"), event[there], start[row[there]]

    def _words(self, clients: pa.Array, bits: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        chunks = -(-(int(self.child[-1].max(initial=0)) + 1) // WIDE)
        word = bits >> 6
        begins = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(bits) else np.empty(0, "i8")
        values = np.bitwise_or.reduceat(np.uint64(1) << (bits & 63).astype("u8"), begins) if len(bits) else np.empty(0, "u8")
        word = word[begins]
        chunk, row = np.unique(word // WORDS, return_inverse=True)
        out = np.zeros((len(chunk), WORDS), "u8")
        out[row, word % WORDS] = values
        return clients.take(pa.array(chunk // chunks)), (chunk % chunks).astype("i4"), out.view("i8")


def supporters(spread: DataFrame, child: list[np.ndarray], gap: int, span: int) -> DataFrame:
    """(_client, chunk, w0..w7): bits of the candidates that a client supports, merged by client."""
    names = ["_client", "chunk", *[f"w{i}" for i in range(WORDS)]]

    def run(batches):
        miner = Miner(child, gap, span)

        def made(table: pa.Table):
            clients = table.column(0).combine_chunks()
            found, chunk, words = miner.take(clients, *[table.column(i).to_numpy().astype("i8") for i in (1, 2, 3)])
            return pa.record_batch([found, pa.array(chunk, pa.int32()), *[pa.array(np.ascontiguousarray(words[:, i])) for i in range(WORDS)]], names=names)

        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                held.append(batch.slice(at, ROWS))
                n += held[-1].num_rows
                if n >= ROWS:
                    yield made(pa.Table.from_batches(held))
                    held, n = [], 0
        if n:
            yield made(pa.Table.from_batches(held))

    kind = spread.schema["_client"].dataType.simpleString()
    found = spread.mapInArrow(run, f"_client {kind}, chunk int, " + ", ".join(f"w{i} long" for i in range(WORDS)))
    return found.groupBy("_client", "chunk").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def counted(bits: DataFrame, weight) -> DataFrame:
    """(candidate, support, weight) of the bits of clients. A task adds up what it reads, and gives rows of SIDE_BY_SIDE
    candidates each."""
    names = [f"{x}{i}" for i in range(SIDE_BY_SIDE) for x in ("n", "s")]

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            chunks, weights = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            words = np.stack([batch.column(2 + i).to_numpy() for i in range(WORDS)], 1)
            for c in np.unique(chunks):
                own = chunks == c
                on = np.unpackbits(np.ascontiguousarray(words[own]).view("u1"), axis=1, bitorder="little").astype("i8")
                sums[int(c)] = sums.get(int(c), 0) + np.stack([on.sum(0), weights[own] @ on], 1)
        for c, found in sums.items():
            blocks = found.reshape(-1, 2 * SIDE_BY_SIDE)
            there = np.flatnonzero(blocks.any(1))
            yield pa.record_batch([pa.array(c * len(blocks) + there), *[pa.array(np.ascontiguousarray(blocks[there, i])) for i in range(len(names))]], names=["block", *names])

    rows = bits.select("chunk", weight(F.col("_client")).cast("long").alias("weight"), *[f"w{i}" for i in range(WORDS)])
    found = rows.mapInArrow(run, "block long, " + ", ".join(f"{x} long" for x in names)).groupBy("block").agg(*[F.sum(x).alias(x) for x in names])
    each = F.array(*[F.struct((F.col("block") * SIDE_BY_SIDE + i).alias("candidate"), F.col(f"n{i}").alias("support"), F.col(f"s{i}").alias("weight")) for i in range(SIDE_BY_SIDE)])
    return found.select(F.inline(each)).where("support > 0")


def frequent_sequences(
    spark: SparkSession, events: DataFrame, gap: int, span: int, client_col: str = "client_id", time_col: str = "at", kind_col: str = "kind",
    longest: int = 4, min_clients: int = 2, min_percent: int = 3, weight=lambda client: F.lit(0),
) -> DataFrame:
    """(pattern array<string>, length, support, weight): the patterns of up to ``longest`` kinds that at least
    ``min_clients`` and ``min_percent`` of a hundred of the clients with events support.

    A client supports a pattern if it has events of these kinds in this order, others between allowed, each
    more than 0 and at most ``gap`` after the one before, the first to the last at most ``span`` apart. Times
    are integers (microseconds, say). weight: a number by client, added up over supporters.

    Events with a null client, time or kind are left out, and so are their clients if they have no others.
    Equal events, and those of one time, never follow each other. An empty table has no patterns; other
    columns are ignored. A kind that few clients have is in no pattern, so its events go before the shuffle.

    To the driver go frequent patterns alone. Each takes ``min_percent`` of a hundred of all clients, so
    there are at most 100 / min_percent times as many as a client supports on average, however many
    clients and events there are; a task gets the table of their extensions.
    """
    if span < gap or gap < 1 or RUN * gap < span:
        raise ValueError(f"the span must be the gap at least, and at most {RUN} times as long")
    if (RUN + 2 + 2 * span // gap) * gap * ROWS >= 1 << 62:
        raise ValueError("the gap is too long for times in 64 bits")
    ship(spark)
    scratch = Scratch(spark, "sequences")
    rows = events.select(F.col(client_col).alias("_client"), F.col(time_col).cast("long").alias("_at"), F.col(kind_col).alias("_kind")).dropna()
    rows = scratch.keep(rows)
    own = rows.groupBy("_client", "_kind").agg(F.count("*").alias("n"))
    own = scratch.keep(own)
    clients = own.select("_client").distinct().count()
    enough = F.col("support") >= max(min_clients, 1)
    enough = enough & (F.col("support") * 100 >= min_percent * clients)
    singles = own.groupBy("_kind").agg(F.count("*").alias("support"), F.sum(weight(F.col("_client")).cast("long")).alias("weight")).where(enough)
    kinds = sorted((r["_kind"], r["support"], r["weight"]) for r in singles.collect())
    names = [k for k, *_ in kinds]
    found = [([k], 1, n, w) for k, n, w in kinds]
    if names and longest > 1:
        code = F.create_map(*[x for i, k in enumerate(names) for x in (F.lit(k), F.lit(i))])[F.col("_kind")]
        bucket = F.expr(f"(_at - pmod(_at, {gap}L)) div {gap}L")
        run = lambda b: F.floor(b / RUN)
        # a bucket's events are also those of the run that the buckets after it begin
        runs = F.explode(F.array_distinct(F.array(run(F.col("_bucket")), run(F.col("_bucket") + -(-span // gap)))))
        spread = rows.where(F.col("_kind").isin(names)).select("_client", "_at", code.alias("_code"), bucket.alias("_bucket"))
        spread = spread.select("_client", runs.alias("_run"), "_at", "_code").repartition("_client", "_run").sortWithinPartitions("_client", "_run", "_at")
        spread = spread.persist(StorageLevel.MEMORY_AND_DISK)
        known = [[(i,) for i in range(len(names))]]
        children: list[np.ndarray] = []
        for length in range(2, longest + 1):
            before = set(known[-1])
            child = np.full((len(known[-1]), len(names) + 1), -1, "i8")
            candidates = []
            for i, p in enumerate(known[-1]):
                for k in range(len(names)):
                    if p[1:] + (k,) in before or length == 2:
                        child[i, k] = len(candidates)
                        candidates.append(p + (k,))
            if not candidates:
                break
            counts = counted(supporters(spread, [*children, child], gap, span), weight).where(enough).collect()
            numbers = {r["candidate"]: i for i, r in enumerate(sorted(counts, key=lambda r: r["candidate"]))}
            found += [([names[k] for k in candidates[r["candidate"]]], length, r["support"], r["weight"]) for r in counts]
            known.append([candidates[c] for c in numbers])
            children.append(np.vectorize(lambda c: numbers.get(c, -1), otypes=["i8"])(child))
            if not numbers:
                break
        spread.unpersist()
    return spark.createDataFrame(found, f"pattern array<{events.schema[kind_col].dataType.simpleString()}>, length int, support long, weight long")


def with_wider(patterns: DataFrame) -> DataFrame:
    """Patterns with ``n_wider``: how many longer ones of them with the same support become it when entries are
    deleted anywhere. A pattern of n kinds gives at most 2^n - 2 shorter ones."""
    masks = F.sequence(F.lit(1), (F.pow(F.lit(2), F.size("pattern")) - 2).cast("int"))
    places = F.transform("pattern", lambda x, j: F.struct(x.alias("x"), F.pow(F.lit(2), j).cast("int").alias("bit")))
    shorter = lambda m: F.transform(F.filter(places, lambda p: m.bitwiseAND(p["bit"]) != 0), lambda p: p["x"])
    wide = patterns.where(F.size("pattern") > 1).select(F.col("pattern").alias("wide"), "support", F.explode(F.array_distinct(F.transform(masks, shorter))).alias("pattern"))
    n = patterns.select("pattern", "support").join(wide, ["pattern", "support"]).groupBy("pattern").agg(F.count("*").alias("n_wider"))
    return patterns.join(n, "pattern", "left").withColumn("n_wider", F.coalesce("n_wider", F.lit(0).cast("long")))
