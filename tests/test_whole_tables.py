"""Queries that must give a row for every document or term, against plain Python."""

import json
import re
from collections import Counter

import duckdb

import __spark_entry__ as entry
from quillspark.functions import text as T

SF = "/root/testdata/sf0.001"


def documents(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def plain_spans(text, terms):
    covered = set()
    for term in terms:
        for m in re.finditer(re.escape(term), text, re.IGNORECASE):
            covered.update(range(2 * m.start(), 2 * m.end() + 1))  # borders too, so that touching spans are one
    edges = sorted(covered)
    begins = [x // 2 for x in edges if x - 1 not in covered]
    ends = [x // 2 for x in edges if x + 1 not in covered]
    return list(zip(begins, ends))


def test_highlight_merge_has_every_document(spark):
    texts = documents(spark)
    got = {r["doc_id"]: [(x["b"], x["e"]) for x in json.loads(r["spans"])] for r in entry.queries()["highlight_merge"](spark, SF).collect()}
    assert got == {i: plain_spans(t or "", ["the", "her", "on"]) for i, t in texts.items()}


def test_spans_of_null_and_long_texts_and_whole_words(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "The other " * 50_000), (4, "\u0130 aaa on")], "i int, x string")
    got = {r["i"]: [tuple(s) for s in r["s"]] for r in rows.select("i", T.highlight_spans(rows["x"], ["the", "on", "aa"]).alias("s")).collect()}
    assert got[1] == got[2] == [] and len(got[3]) == 100_000 and got[4] == [(2, 4), (6, 8)]
    whole = rows.where("i = 3").select(T.highlight_spans(rows["x"], ["the"], exact_word=True).alias("s")).first()["s"]
    assert len(whole) == 50_000 and tuple(whole[1]) == (10, 13)


def test_term_df_has_every_term(spark):
    df, tf = Counter(), Counter()
    rows = spark.createDataFrame(list(documents(spark).items()), "i long, x string")
    for r in rows.select(T.tokens(rows["x"]).alias("t")).collect():
        tf.update(r["t"] or [])
        df.update(set(r["t"] or []))
    got = {r["term"]: (r["df"], r["tf"]) for r in entry.queries()["term_df"](spark, SF).collect()}
    assert got == {t: (df[t], tf[t]) for t in tf}
    # and so does the query's SQL
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    assert {t: (d, n) for t, d, n in con.execute("select term, df, tf from (" + entry.oracle_sql()["term_df"] + ")").fetchall()} == got
