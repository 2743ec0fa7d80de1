"""Token alignment against two pointers that walk over both tokenizers' tokens."""

import hashlib
import random
from collections import Counter
from itertools import accumulate

import pytest

from quillspark.llm import alignment, queries

SF = "/root/testdata/sf0.001"
ODD = "ΣσςİıſKÅéèöÄ中文한국어가́̀  ​½²①٣🎉👍🏽ﬁ'sS'tdll'RE<|endoftext|></s><s><0x41>▁! \t\n\x0b\x1c\x85\x00\r"


@pytest.fixture(scope="module")
def paths():
    return queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")


def walk(both, text):
    """(n_a, n_b, groups, links) of the tokenizers on the whole text."""
    if not text:
        return 0, 0, "", []
    a, b = both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)
    left, right = [both.bytes_a[i] for i in a], [both.bytes_b[i] for i in b]
    if not b"".join(left) == b"".join(right) == (" " + text).encode():
        return 0, 0, "", []
    ends_a, ends_b = list(accumulate(map(len, left))), list(accumulate(map(len, right)))
    i = j = 0
    groups, links, own = [], [], ([], [])
    while i < len(a):
        links.append((a[i], b[j]))
        step_a, step_b = ends_a[i] <= ends_b[j], ends_b[j] <= ends_a[i]
        if step_a:
            own[0].append(str(a[i]))
        if step_b:
            own[1].append(str(b[j]))
        if step_a and step_b:
            groups.append("|".join(map(",".join, own)))
            own = ([], [])
        i, j = i + step_a, j + step_b
    return len(a), len(b), ";".join(groups), links


def expected(both, texts):
    found = [walk(both, t) for t in texts]
    counts = Counter(p for *_, links in found for p in set(links))
    most = {}
    for (a, _), n in counts.items():
        most[a] = max(most.get(a, 0), n)
    rows = []
    for n_a, n_b, groups, links in found:
        n_best = sum(counts[p] == most[p[0]] for p in links)
        rows.append((n_a, n_b, n_a + n_b - len(links), len(links), groups, n_best, sum(counts[p] for p in links)))
    return rows, counts


NAMES = ["n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]


@pytest.mark.parametrize("sent_pairs", [10**6, 0])
def test_random_texts_by_both_ways_to_the_counts(spark, paths, sent_pairs):
    rng = random.Random(7)
    some = ["".join(rng.choice(ODD + "abcdeth in the 'll 123!?.,-  \n") for _ in range(rng.randint(0, 50))) for _ in range(400)]
    texts = [*some, *some[:30], "x" * 3000 + " " + "=" * 2000, None, "", " ", "  ", "\n", "a ", "a  \n ", "! ! !", "a▁b", "a\rb"]
    both = alignment.pair_of(*paths)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found, pairs = alignment.align(spark, frame, *paths, sent_pairs=sent_pairs)
    want, counts = expected(both, texts)
    got = {r["doc_id"]: tuple(r[n] for n in NAMES) for r in found.collect()}
    assert got == dict(enumerate(want))
    assert {(r["id_a"], r["id_b"]): r["n_docs"] for r in pairs.collect()} == counts
    # texts that are no bytes of the second tokenizer's have no tokens
    assert want[texts.index("a▁b")][0] == 0 and want[texts.index("a\rb")][0] > 0


def test_small_blocks_and_long_texts(spark, paths):
    texts = ["one two three one", "two", "x " * 4000, "three " * 10, ""] * 3
    both = alignment.pair_of(*paths)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    blocks = alignment.tokenized(frame, *paths, block=1000)
    assert blocks.count() > 3
    got = {r["_id"]: r for r in alignment.aligned(blocks, both.longest_token).collect()}
    for i, text in enumerate(texts):
        n_a, n_b, groups, links = walk(both, text)
        mine = sorted((p >> alignment.ID_BITS, p & (1 << alignment.ID_BITS) - 1) for p in got[i]["links"])
        assert (got[i]["n_a"], got[i]["n_b"], got[i]["groups"], mine) == (n_a, n_b, groups, sorted(links))


def test_nulls_repeats_empty_tables_and_clashing_columns(spark, paths):
    rows = [(1, "same words", 1, "x"), (1, "same words", 2, "y"), (None, None, None, None), (None, "words", 3, "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_best long, _id string")
    got = sorted(((r["doc_id"] or 0, r["n_a"], r["n_best"]) for r in alignment.align(spark, frame, *paths)[0].collect()))
    assert got == [(0, 0, 0), (0, 1, 1), (1, 2, 2), (1, 2, 2)]
    found, pairs = alignment.align(spark, frame.limit(0), *paths)
    assert found.count() == pairs.count() == 0 and found.columns == ["doc_id", *NAMES]


def test_op13(spark, paths):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want, _ = expected(alignment.pair_of(*paths), [r["text"] for r in rows])
    got = {r["doc_id"]: tuple(r[n] for n in [*NAMES[:4], "groups_sha256", *NAMES[5:]]) for r in queries.op13_token_alignment(spark, SF).collect()}
    assert got == {r["doc_id"]: (*w[:4], hashlib.sha256(w[4].encode()).hexdigest() if w[4] else "", *w[5:]) for r, w in zip(rows, want)}


def test_a_task_aligns_each_piece_once(spark, paths):
    texts = ["one two three one", "two one", "a▁b", None, "four one", "two three"] * 40
    both = alignment.pair_of(*paths)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    blocks = alignment.tokenized(frame, *paths, block=30)
    assert blocks.count() > 10
    own = {p for t in texts if t and "▁" not in t for p in both.pieces(t)}
    assert sum(len(r["a"]) for r in blocks.collect()) == sum(walk(both, p[1:])[0] for p in own)
    # numbered anew at every block, and now and then
    for remembered in (0, 100):
        again = alignment.tokenized(frame, *paths, block=30, remembered=remembered)
        assert sum(r["start"] == 0 for r in again.collect()) > 1
        for r in alignment.aligned(again, both.longest_token).collect():
            assert (r["n_a"], r["n_b"], r["groups"], len(r["links"])) == (*(w := walk(both, texts[r["_id"]]))[:3], len(w[3]))
