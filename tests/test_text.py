import uuid

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


def test_tokens_fold_marks_and_split_at_underscores(spark):
    assert one(spark, "Éa_ñ-B2 ß", T.tokens) == ["ea", "n", "b2", "ß"]


@pytest.mark.parametrize("said,expected", [("Pi is 3.14. Yes!\nNext", ["Pi is 3.14.", "Yes!", "Next"]), ("", []), ('He said "no." Then', ['He said "no."', "Then"])])
def test_sentences(spark, said, expected):
    assert one(spark, said, T.sentences) == expected


def test_chunks_pack_and_keep_long_sentences(spark):
    assert one(spark, "Aa. Bb. Cccccccccccc.", lambda c: T.chunk_text(c, 8)) == ["Aa. Bb.", "Cccccccccccc."]
    assert one(spark, "  ", lambda c: T.chunk_text(c, 8)) == ["  "]


def test_stems_stop_at_the_first_ending(spark):
    for term, stem in [("보고서를", "보고서"), ("바로", None), ("trash", None)]:
        assert one(spark, term, T.stem_column) == stem == T.stem(term)


def test_overlap_of_empty_texts(spark):
    rows = spark.createDataFrame([("", "ab"), ("ab", ""), ("abc", "abd")], "a string, b string")
    assert [r[0] for r in rows.select(T.overlap_ratio(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.5]


def test_spans_merge_when_they_touch(spark):
    got = one(spark, "abcab", lambda c: T.highlight_spans(c, ["ab", "c"]))
    assert [tuple(x) for x in got] == [(0, 5)]


def test_uuid5_is_that_of_the_standard(spark):
    ns = uuid.UUID("6f1a2c3d-4e5b-4a7c-8d9e-0f1a2b3c4d5e")
    assert one(spark, "/a/b", lambda c: T.uuid5(ns.hex, c)) == uuid.uuid5(ns, "/a/b").hex


def test_rich_text_escapes_once_and_marks_matches(spark):
    rows = spark.createDataFrame([(1, 'a <b> & "The" the\'s'), (2, None), (3, ""), (4, "no match & more")], "i int, x string")
    got = {r["i"]: r["r"] for r in rows.select("i", T.rich_text(F.col("x"), ["the"]).alias("r")).collect()}
    assert got == {1: "a &lt;b&gt; &amp; &quot;<b>The</b>&quot; <b>the</b>&#x27;s", 2: "", 3: "", 4: "no match &amp; more"}
    one = rows.where("i = 1").select(T.rich_excerpt(F.col("x"), "the", 8).alias("r")).first()["r"]
    assert one.startswith("…") and "<b>The</b>" in one


def test_chunks_of_long_texts_and_by_tokens(spark):
    text = "One two three four. " * 20_000
    rows = spark.createDataFrame([(text,), ("",), (" \n",), ("x" * 500 + ". b",)], "x string")
    by_chars, by_tokens = [[r[0] for r in rows.select(T.chunk_text(F.col("x"), 60, m)).collect()] for m in (None, T.count_tokens)]
    assert by_chars[0] == ["One two three four. One two three four. One two three four."] * 6666 + ["One two three four. One two three four."]
    assert by_tokens[0] == [" ".join(["One two three four."] * 15)] * 1333 + [" ".join(["One two three four."] * 5)]
    assert by_chars[1:] == [[""], [" \n"], ["x" * 500 + ".", "b"]]
