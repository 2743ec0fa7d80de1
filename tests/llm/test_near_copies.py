import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import buckets, shingle_join
from quillspark.llm.pipeline_stages import drop_near_copies
from quillspark.workspace import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def runs(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    x, y = runs(a), runs(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def kept(rows):
    """The smallest id of each group, by comparing all pairs."""
    label = {i: i for i, _ in rows}
    pairs = [(i, j) for i, x in rows for j, y in rows if i < j and similarity(x, y) >= 0.8]
    for _ in rows:
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    return sorted({*label.values()})


def scattered(rng, words, similarity_at_most):
    """Single words replaced until the similarity is at most so much; and the text one edit before."""
    out, before = list(words), list(words)
    while similarity(" ".join(words), " ".join(out)) > similarity_at_most:
        before = list(out)
        out[rng.integers(len(out))] = f"new{rng.integers(10**9)}"
    return before, out


def contiguous(rng, words, similarity_at_most):
    """One passage replaced, as long as it takes; and the text with one word less replaced."""
    at, fresh = len(words) // 3, [f"new{x}" for x in rng.integers(0, 10**9, len(words))]
    before = out = list(words)
    n = 0
    while similarity(" ".join(words), " ".join(out)) > similarity_at_most:
        before, n = out, n + 1
        out = [*words[:at], *fresh[:n], *words[at + n :]]
    return before, out


def pairs(edit):
    """Forty texts, each with a copy just above and one just below 0.8, as rows of their own."""
    rng = np.random.default_rng(11)
    rows = []
    for _ in range(40):
        words = [f"w{x}" for x in rng.integers(0, 20_000, rng.integers(60, 400))]
        above, below = edit(rng, words, 0.7999)
        for copy in (above, below):
            fresh = [f"{w}t{len(rows)}" for w in words]  # so that the two pairs of a text don't meet
            name = dict(zip(words, fresh))
            rows += [(len(rows), " ".join(fresh)), (len(rows) + 1, " ".join(name.get(w, w) for w in copy))]
    return rows


@pytest.mark.parametrize("edit", [scattered, contiguous])
def test_near_copies_are_those_of_all_pairs(spark, edit):
    rows = pairs(edit)
    near = [similarity(rows[i][1], rows[i + 1][1]) for i in range(0, len(rows), 2)]
    assert min(near) < 0.8 <= max(near)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    assert sorted(r["doc_id"] for r in drop_near_copies(spark, docs).collect()) == kept(rows)


def test_near_copies_of_short_and_repeating_texts(spark):
    line = "one line that comes again and again\n"
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h i"), (3, "a b c d e f g"), (4, "a b c"), (5, "A  b C"), (6, "a b"), (7, line * 40),
            (8, line * 300), (9, line + "and more " * 3), (10, ""), (11, " \n"), (12, "x y z u v " * 3 + "end"), (13, "x y z u v " * 30 + "end")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    assert sorted(r["doc_id"] for r in drop_near_copies(spark, docs).collect()) == kept(rows)


def test_likely_links_that_fail_leave_the_others(spark, monkeypatch):
    monkeypatch.setattr(shingle_join, "NEAR", 150)  # so that what spans the likely links is often no link
    rng = np.random.default_rng(12)
    words = [f"w{x}" for x in rng.integers(0, 20_000, 200)]
    rows = [(i, " ".join(w if rng.random() > 0.03 else f"n{rng.integers(10**9)}" for w in words)) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    assert sorted(r["doc_id"] for r in drop_near_copies(spark, docs).collect()) == kept(rows)


@pytest.mark.parametrize("most", [8192, 1])
def test_a_sieve_holds_back_none_of_its_ids(spark, monkeypatch, most):
    monkeypatch.setattr(buckets, "SIEVE_MOST", most)
    ids = spark.range(30_000).select((F.col("id") * 7919).alias("id"))
    frame = spark.range(300_000).select(F.col("id").alias("a"), F.lit("x").alias("block"))
    maybe, sure = buckets.sifted(frame, "a", buckets.sieve(ids, Scratch(spark, "t")))
    assert maybe.columns == sure.columns == frame.columns and maybe.count() + sure.count() == 300_000
    own = ids.withColumnRenamed("id", "a")
    assert sure.join(own, "a").count() == 0
    assert maybe.join(own, "a", "left_anti").count() < 300_000 * (0.08 if most > 1 else 0.7)
    none, rest = buckets.sifted(frame, "a", buckets.sieve(ids.limit(0), Scratch(spark, "t")))
    assert none.count() == 0 and rest.count() == 300_000


def test_pigeonring_alone_links_what_it_sees(spark):
    """with no keys to complete by, the fingerprints' links are there, verified; others aren't."""
    rng = np.random.default_rng(13)
    words = [f"w{x}" for x in rng.integers(0, 20_000, 2000)]
    near, far = list(words), list(words)
    near[1000] = "new"
    far[:700] = [f"n{x}" for x in range(700)]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))]
    docs = spark.createDataFrame(rows, "row long, text string")
    scratch = Scratch(spark, "t")
    sets = scratch.keep(shingle_join.text_sets(docs, ["row"], 5).withColumn("keys", F.array().cast("array<long>")))
    texts = lambda nodes: sets.join(nodes, "node").join(docs, "row").select("node", "text")
    found = {r["node"]: r["component"] for r in shingle_join.similar_components(sets, texts, 5, scratch).collect()}
    node = {r["row"]: r["node"] for r in sets.collect()}
    assert found == {max(node[1], node[2]): min(node[1], node[2])}


def test_batches_to_python_are_bounded_only_meanwhile(spark):
    def sizes(batches):
        for batch in batches:
            yield batch.from_pydict({"n": [batch.num_rows]})

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    wide = spark.range(0, 200, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("t"))
    got = [r["n"] for r in Scratch(spark, "t", batch=1 << 20).keep(wide.mapInArrow(sizes, "n long")).collect()]
    assert sum(got) == 200 and max(got) < 30 and spark.conf.get(name) == before


def test_keys_cost_no_pass_through_the_common_runs(spark):
    """each set was held against all common runs, which grow with the corpus (80 ms a set at 200,000)."""
    rng = np.random.default_rng(14)
    common = np.unique(rng.integers(0, 2**63, 200_000).astype(np.uint64) * np.uint64(2))
    sets = [np.unique(np.concatenate([rng.choice(common, 40), rng.integers(0, 2**63, n).astype(np.uint64)])) for n in (0, 1, 9, 400)]
    for runs in (*sets, np.empty(0, np.uint64)):
        for some in (common, common[:1], common[:0], runs):
            last = np.isin(runs, some)
            wanted = np.concatenate([runs[~last], runs[last]])[: len(runs) - (4 * len(runs) + 4) // 5 + 1 if len(runs) else 0]
            assert np.array_equal(shingle_join.set_keys(runs, some), wanted)
    began = time.perf_counter()
    for _ in range(200):
        shingle_join.set_keys(sets[-1], common)
    assert time.perf_counter() - began < 2


def test_run_sets_hold_each_run_once():
    for text in ("", "a", "a b c d e", "x y z u v " * 3 + "end", "w " * 400):
        found = shingle_join.run_set(text.encode(), 5).tolist()
        assert found == sorted({*found}) and len(found) == len(runs(text))
