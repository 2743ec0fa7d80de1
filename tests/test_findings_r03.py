"""Findings of the third review: each test failed before the change that it is named after."""

import inspect
import json
import random

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillspark.functions import text as T
from quillspark.operators import evidence, indexing, search, vectors

SF = "/root/testdata/sf0.001"


def of_sql(name, *tables):
    con = duckdb.connect()
    for table in tables:
        con.execute(f"create view {table} as select * from read_parquet('{SF}/{table}.parquet')")
    found = con.execute(entry.oracle_sql()[name])
    return [x[0] for x in found.description], found.fetchall()


def plan_of(frame):
    return frame._jdf.queryExecution().toString()


def test_f2_keywords_are_not_found_across_spaces(spark, tmp_path):
    rows = [(1, "the music umbrella"), (2, "this cum the"), (3, "The SCUM"), (4, "t he scum"), (5, None), (6, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["hit"] for r in entry.queries()["keyword_grade"](spark, str(tmp_path)).collect()}
    assert got == {1: False, 2: False, 3: True, 4: False, 5: None, 6: False}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert dict(con.execute(entry.oracle_sql()["keyword_grade"]).fetchall()) == got
    slots = F.array(F.array(F.lit("scum")))  # the operator's own rule stays
    assert spark.range(1).select(evidence.keywords_hit(F.lit("s cum"), slots)).first()[0]


def test_f3_report_names_the_cases(spark):
    found = entry.queries()["hallucination_report"](spark, SF)
    names, rows = of_sql("hallucination_report", "conversations")
    assert found.columns == names == ["flagged", "caught", "missed", "caught_ids", "missed_ids"]
    assert [tuple(r) for r in found.collect()] == rows
    assert len(rows[0][3].split(",")) == rows[0][1] > 0 and len(rows[0][4].split(",")) == rows[0][2] > 0


def plain_postings(texts):
    out = set()
    for seq, fields in texts.items():
        for field, words in fields.items():
            places = {}
            for i, w in enumerate(words):
                places.setdefault(w, []).append(i)
            out |= {(w, field, seq, tuple(p)) for w, p in places.items()}
    return out


def test_index_gathers_a_chunks_tokens_before_the_shuffle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "SLICE", 3)
    rng = random.Random(5)
    texts = {i: {c: [f"w{rng.randint(0, 9)}" for _ in range(rng.choice([0, 1, 7, 400]))] for c in search.WEIGHTS} for i in range(-3, 20)}
    rows = [(i, "text", *(" ".join(t[c]) if t[c] or i % 2 else None for c in search.WEIGHTS)) for i, t in texts.items()]
    chunks = spark.createDataFrame(rows, "seq long, type string, " + ", ".join(f"{c} string" for c in search.WEIGHTS))
    index = search.build_index(chunks, str(tmp_path / "i"), block=4)
    got = {(r["term"], r["field"], r["seq"], tuple(r["places"])) for r in index.read("postings").collect()}
    assert got == plain_postings(texts) and index.read("postings").count() == len(got)
    assert {r["seq"]: r["n_tokens"] for r in index.read("lengths").collect()} == {i: sum(map(len, t.values())) for i, t in texts.items()}
    bounds = {(r["term"], r["block"]): (r["least"], r["most"]) for r in index.read("bounds").collect()}
    wanted = {}
    for term, field, seq, places in got:
        least, most = wanted.setdefault((term, seq // 4), (10**9, {}))
        most[field] = max(most.get(field, 0), len(places))
        wanted[term, seq // 4] = (min(least, sum(map(len, texts[seq].values()))), most)
    assert bounds == wanted
    assert "collect_list" not in plan_of(search.postings(chunks))


def test_f13_evidence_is_cut_once_a_row(spark):
    rows = spark.createDataFrame([(["ab", "", "abcd", None], "xabx"), (["ab"], ""), ([], "ab"), (None, "ab"), (["ab"], None), (["a"], "a")], "s array<string>, e string")
    got = [r[0] for r in rows.select(T.overlaps(F.col("s"), F.col("e"))).collect()]
    assert got == [[1.0, 1.0, 1 / 3, None], [0.0], [], None, [None], [1.0]]
    excerpts = F.array(F.struct(F.col("e").alias("text")))
    assert "array_intersect" not in plan_of(rows.select(evidence.verify(F.col("e"), excerpts)))


def test_f21_runs_are_counted_without_an_array_of_characters(spark):
    rows = spark.createDataFrame([("",), ("a",), ("a b\n ab",), ("가나 가나다",), (None,), ("\U0001d51e\U0001d51e\U0001d51e",)], "x string")
    assert [r[0] for r in rows.select(T.shingle_count(F.col("x"))).collect()] == [0, 1, 2, 3, None, 1]
    assert "array_distinct" not in plan_of(entry.queries()["bigram_sets"](spark, SF))


def test_f22_spans_leave_python_as_numbers(spark):
    rows = spark.range(300).select(F.repeat(F.lit("the x "), 2000).alias("x"))
    assert "ArrowEvalPython" in plan_of(rows.select(T.highlight_spans(F.col("x"), ["the"])))
    assert "arrow_udf" in inspect.getsource(T.highlight_spans)
    got = rows.select(T.highlight_spans(F.col("x"), ["the"]).alias("s")).select(F.size("s").alias("n"), F.to_json(F.slice("s", 2, 1)).alias("b")).distinct().collect()
    assert [(r["n"], json.loads(r["b"])) for r in got] == [(2000, [{"b": 6, "e": 9}])]


def test_f23_texts_are_not_sorted_to_be_embedded(spark):
    rows = spark.createDataFrame([(i, f"a bb {'c' * i}") for i in range(5)], "key long, content string")
    there = spark.createDataFrame([(1, "m"), (2, "n")], "key long, model string")
    made = vectors.embed_missing(rows, there, "m", vectors.counting_encoder())
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" not in plan
    got = {r["key"]: list(r["vector"]) for r in made.collect()}
    assert sorted(got) == [0, 2, 3, 4] and all(abs(sum(x * x for x in v) - 1) < 1e-6 for v in got.values())


def test_f1_chunks_are_cut_once_to_be_numbered(spark):
    cuts = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def cut(x):
        cuts.add(1)
        return x

    rows = spark.range(200).select(F.format_string("p%03d", F.col("id") % 9).alias("path"), F.lit(0).alias("pos"), F.col("id").alias("k"), cut(F.lit("x")).alias("content"))
    got = [(r["path"], r["k"]) for r in indexing.numbered(rows, 5).orderBy("seq").collect()]
    assert got == sorted(got) and len(got) == 200 and cuts.value == 200
