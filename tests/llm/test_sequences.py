"""Sequential patterns against a search through all occurrences."""

import random
import zlib
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import sequences


def supports(events, pattern, gap, span):
    """Does a client with events (at, kind) support a pattern? By all occurrences."""
    ends = {(t, t) for t, k in events if k == pattern[0]}
    for kind in pattern[1:]:
        ends = {(s, t) for s, e in ends for t, k in events if k == kind and 0 < t - e <= gap and t - s <= span}
    return bool(ends)


def plain(rows, gap, span, longest, min_clients, min_percent):
    clients = {}
    for c, t, k in rows:
        if None not in (c, t, k):
            clients.setdefault(c, set()).add((t, k))
    kinds = sorted({k for c in clients.values() for _, k in c})
    out = {}
    for n in range(1, longest + 1):
        for p in product(kinds, repeat=n):
            who = [c for c, e in clients.items() if supports(e, p, gap, span)]
            if len(who) >= max(min_clients, 1) and len(who) * 100 >= min_percent * len(clients):
                out[p] = (len(who), sum(zlib.crc32(str(c).encode()) for c in who))
    return out


def data(rng, clients, each, kinds, spread):
    rows = []
    for c in range(clients):
        at = rng.randint(-5000, 5000)
        for _ in range(rng.randint(0, each)):
            at += rng.choice([0, 1, 3, 10, 40, 99, 100, 101, spread])
            rows.append((c, at, rng.choice(kinds)))
    return rows


@pytest.mark.parametrize("seed,min_percent", [(1, 0), (2, 30), (3, 60)])
def test_patterns_of_random_events(spark, seed, min_percent):
    rng = random.Random(seed)
    rows = data(rng, 14, 40, "abc", 2500) + [(None, 1, "a"), (3, None, "a"), (3, 1, None), (99, 5, "rare")]
    rows += rng.sample(rows, 20)
    frame = spark.createDataFrame([(*r, "x") for r in rows], "client_id long, at long, kind string, _code string").repartition(3)
    got = sequences.frequent_sequences(spark, frame, 100, 150, min_percent=min_percent, weight=lambda c: F.crc32(c.cast("string"))).collect()
    assert {tuple(r["pattern"]): (r["support"], r["weight"]) for r in got} == plain(rows, 100, 150, 4, 2, min_percent)
    assert all(r["length"] == len(r["pattern"]) for r in got)


@pytest.mark.parametrize("size", [1, 2, 5, 17, 1000])
def test_events_in_parts_of_any_size(size):
    """What a run's lists keep from one part of the events to the next."""
    rng = random.Random(size)
    gap, span, kinds = 100, 250, 3
    for _ in range(12):
        rows = sorted((c, t // (sequences.RUN * gap), t, ord(k) - 97) for c, t, k in data(rng, 3, 60, "abc", 3000))
        # all pairs and triples are candidates, but some
        pairs = [p for p in product(range(kinds), repeat=2) if rng.random() < 0.9]
        triples = [(*p, k) for p in pairs for k in range(kinds) if rng.random() < 0.9]
        first, second = np.full((kinds, kinds + 1), -1), np.full((len(pairs), kinds + 1), -1)
        for i, p in enumerate(pairs):
            first[p[0], p[1]] = i
        for i, t in enumerate(triples):
            second[pairs.index(t[:2]), t[2]] = i
        miner, got = sequences.Miner([first, second], gap, span), set()
        for at in range(0, len(rows), size):
            c, r, t, k = map(list, zip(*rows[at : at + size]))
            clients, chunks, words = miner.take(pa.array(c), np.array(r), np.array(t), np.array(k))
            for client, chunk, line in zip(clients.to_pylist(), chunks, words.view("u8")):
                got |= {(client, chunk * 512 + 64 * w + b) for w, x in enumerate(line.tolist()) for b in range(64) if x >> b & 1}
        want = set()
        for c in {r[0] for r in rows}:
            for run in {r[1] for r in rows}:
                own = {(t, k) for i, r, t, k in rows if i == c and r == run}
                want |= {(c, i) for i, p in enumerate(triples) if supports(own, p, gap, span)}
        assert got == want


def test_one_long_client_and_many_ties(spark):
    rng = random.Random(4)
    rows = [(1, rng.randint(0, 3000) * 10, rng.choice("abcde")) for _ in range(1500)] + [(c, t, k) for c in range(2, 6) for t, k in ((0, "a"), (0, "b"), (50, "c"))]
    frame = spark.createDataFrame(rows, "client_id long, at long, kind string")
    got = {tuple(r["pattern"]): r["support"] for r in sequences.frequent_sequences(spark, frame, 100, 150, longest=3, min_percent=0).collect()}
    assert got == {p: n for p, (n, _) in plain(rows, 100, 150, 3, 2, 0).items()}
    assert ("a", "c") in got and ("a", "b") not in {p for p, n in got.items() if n > 4}


def test_no_events_wrong_limits_and_other_types(spark):
    frame = spark.createDataFrame([("x", 1, "a"), ("x", 2, "b"), ("y", 1, "a"), ("y", 90, "b")], "client_id string, at long, kind string")
    assert sequences.frequent_sequences(spark, frame.limit(0), 100, 150).count() == 0
    got = {tuple(r["pattern"]): r["support"] for r in sequences.frequent_sequences(spark, frame, 100, 150).collect()}
    assert got == {("a",): 2, ("b",): 2, ("a", "b"): 2}
    for gap, span in ((100, 50), (0, 10), (10, 1000), (1 << 50, 1 << 50)):
        with pytest.raises(ValueError):
            sequences.frequent_sequences(spark, frame, gap, span)


def test_wider_patterns(spark):
    rows = [("a", 5), ("b", 5), ("aa", 4), ("ab", 5), ("aab", 4), ("aba", 4), ("aaba", 4), ("ba", 3)]
    frame = spark.createDataFrame([(list(p), n) for p, n in rows], "pattern array<string>, support long")
    got = {"".join(r["pattern"]): r["n_wider"] for r in sequences.with_wider(frame).collect()}

    def within(short, long):
        it = iter(long)
        return all(x in it for x in short)

    assert got == {p: sum(len(q) > len(p) and n == m and within(p, q) for q, m in rows) for p, n in rows}
