from fractions import Fraction

import numpy as np
import pytest

from quillspark.llm import mixing
from pyspark.sql import functions as F
from quillspark.llm.pipeline_stages import mix

LEAF = "domain string, lang string, source string, tokens long"


def test_names_left_out_leave_their_budget_to_others(spark):
    rows = [("d1", "en", "a", 100), ("d1", "fr", "b", 10), ("d2", "en", "c", 100)]
    leaves = spark.createDataFrame(rows, LEAF)
    for weights in ({"source": {"a": 0}}, {"lang": {"xx": 1}, "source": {"a": 0, "zz": 0}}):
        got = {r["source"]: r["quota"] for r in mixing.quotas(leaves, 100, weights, 1).collect()}
        assert got == {"b": 10, "c": 90}


def plain_parts(children, budget):
    """{name: (weight, cap)} to {name: tokens}: water filling in fractions, full children one by one."""
    got, left = {}, dict(children)
    while left:
        level = Fraction(budget - sum(got.values()), sum(w for w, _ in left.values()))
        full = [n for n, (w, cap) in left.items() if cap <= w * level]
        if not full:
            shares = {n: w * level for n, (w, _) in left.items()}
            whole = {n: int(x) for n, x in shares.items()}
            over = budget - sum(got.values()) - sum(whole.values())
            for n in sorted(shares, key=lambda n: (whole[n] - shares[n], n))[:over]:
                whole[n] += 1
            return got | whole
        for n in full:
            got[n] = left.pop(n)[1]
    return got


def plain_quotas(leaves, budget, weights, epochs):
    weight = lambda level, name: weights.get(level, {}).get(name, 1)
    used = {k: n * epochs for k, n in leaves.items() if n and all(weight(level, x) for level, x in zip(mixing.LEVELS, k))}

    def down(prefix, budget):
        depth = len(prefix)
        if depth == 3:
            return {prefix: budget}
        caps = {}
        for k, cap in used.items():
            if k[:depth] == prefix:
                caps[k[depth]] = caps.get(k[depth], 0) + cap
        parts = plain_parts({n: (weight(mixing.LEVELS[depth], n), cap) for n, cap in caps.items()}, budget)
        return {k: v for n, part in parts.items() for k, v in down((*prefix, n), part).items()}

    return down((), budget)


@pytest.mark.parametrize("seed", range(4))
def test_quotas_are_those_of_water_filling(spark, seed):
    rng = np.random.default_rng(seed)
    leaves = {(f"d{a}", f"l{b}", f"s{c}"): int(rng.integers(0, 10 ** int(rng.integers(1, 6)))) for a in range(3) for b in range(3) for c in range(4) if rng.random() < 0.8}
    weights = {"domain": {"d0": 5, "d1": 2}, "lang": {"l0": 7, "l1": int(seed % 2)}, "source": {"s0": 0 if seed % 3 == 0 else 9, "s2": 4}}
    caps = sum(plain_quotas(leaves, 10**12, weights, 2).values())
    frame = spark.createDataFrame([(*k, n) for k, n in leaves.items()], LEAF)
    for budget in (0, 7, caps // 3, caps - 1, caps + 50):
        got = {(r["domain"], r["lang"], r["source"]): r["quota"] for r in mixing.quotas(frame, budget, weights, 2).collect()}
        assert got == plain_quotas(leaves, budget, weights, 2)
        assert sum(got.values()) == min(budget, caps)


def test_equal_leaves_share_every_token(spark):
    frame = spark.createDataFrame([("d", "l", f"s{i}", 1000) for i in range(7)], LEAF)
    got = sorted(r["quota"] for r in mixing.quotas(frame, 100, {}, 1).collect())
    assert got == [14, 14, 14, 14, 14, 15, 15]


def test_huge_budgets_do_not_overflow(spark):
    frame = spark.createDataFrame([("d", "l", "a", 4 * 10**16), ("d", "l", "b", 4 * 10**16)], LEAF)
    got = {r["source"]: r["quota"] for r in mixing.quotas(frame, 3 * 10**16, {"source": {"a": 1000, "b": 500}}, 1).collect()}
    assert got == {"a": 2 * 10**16, "b": 10**16}


def test_columns_that_are_named_like_added_ones_keep_their_values(spark):
    rows = [(i, f"word {i} of a text", "en", f"src{i % 3}", f"d{i}", -i, "t", 0.5, "x.y") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _quill_domain string, _quill_copies int, _QUILL_TOKENS string, _quill_cut double, `a.b` string")
    (domain, _, _), copies, tokens = mixing.mixture_columns(docs)
    assert (domain, copies, tokens) == ("_quill_domain_", "_quill_copies_", "_quill_tokens_")
    plain = mixing.mix_sources(spark, docs.select("doc_id", "text", "lang", "source"), F.lit("all"), {})
    found = mixing.mix_sources(spark, docs, F.lit("all"), {})
    assert found.columns == [*docs.columns, copies, domain, tokens]
    taken = {r["doc_id"]: r["_quill_copies"] for r in plain.collect()}
    got = {r["doc_id"]: r for r in found.collect()}
    assert {i: r[copies] for i, r in got.items()} == taken and taken
    assert all((r["_quill_domain"], r["_quill_copies"], r["a.b"]) == (f"d{i}", -i, "x.y") for i, r in got.items())
    mixed = mix(spark, docs, {}, 0.5, 3, F.lit("all"))
    assert mixed.columns == docs.columns and sorted(r["_quill_domain"] for r in mixed.collect()) == sorted(f"d{i}" for i, n in taken.items() for _ in range(n))
