import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark.operators import context, evidence, ranking, search, segments, snapshots
from quillspark.sources import files
from quillspark.streaming import events


@pytest.fixture(scope="module")
def chunks(spark, tmp_path_factory):
    rows = [(1, "text", "red fox and red hen", "a.txt", "", "", ""), (2, "text", "a Reddish barn", "b.txt", "", "", ""),
            (3, "table", "blue sky", "red.xlsx", "", "fox", ""), (4, "text", "infrared", "c.txt", "", "", "")]
    frame = spark.createDataFrame(rows, "seq long, type string, content string, file_name string, keywords string, caption string, heading string")
    return search.build_index(frame, str(tmp_path_factory.mktemp("index")) + "/i")


def ids(frame):
    return [r["seq"] for r in frame.collect()]


def test_prefix_matches_tokens_not_their_middle(chunks):
    assert set(ids(search.bm25(chunks, "red"))) == {1, 2, 3}
    assert set(ids(search.bm25(chunks, "red", exact_word=True))) == {1, 3}


def test_all_terms_or_any_where_none_has_all(chunks):
    assert ids(search.bm25(chunks, "red hen")) == [1]
    assert set(ids(search.bm25(chunks, "hen blue"))) == {1, 3}
    assert ids(search.bm25(chunks, "hen blue", fallback_to_any=False)) == []
    assert ids(search.bm25(chunks, "  ")) == []


def test_filters(chunks):
    assert ids(search.bm25(chunks, "red", types=["table"])) == [3]
    assert ids(search.bm25(chunks, "redd", case_sensitive=True)) == []
    assert ids(search.bm25(chunks, "Redd", case_sensitive=False)) == [2]
    assert ids(search.bm25(chunks, "fox-an")) == [1]


def test_index_of_odd_rows(spark, tmp_path):
    schema = "seq long, type string, content string, file_name string, keywords string, caption string, heading string, term string"
    long = "wide words " * 60_000
    rows = [(1, "text", None, None, None, None, None, "t"), (2, None, "", "", "", "", "", None), (3, "text", long + "end", "a.txt", None, "", "", "t"), (4, "text", "end wide", "a", "", "", "", "t")]
    frame = spark.createDataFrame(rows, schema)
    index = search.build_index(frame, f"{tmp_path}/odd")
    assert sorted(ids(search.bm25(index, "wide end"))) == [3, 4] and ids(search.bm25(index, "words-end")) == [3]
    assert {r["seq"]: r["n_tokens"] for r in index.read("lengths").collect()} == {1: 0, 2: 0, 3: 120_003, 4: 3}
    assert [r["term"] for r in search.bm25(index, "wide", keep=("term",)).collect()] == ["t", "t"]
    none = search.build_index(frame.limit(0), f"{tmp_path}/none")
    assert ids(search.bm25(none, "wide end")) == ids(search.bm25(index, "...")) == []
    assert none.read("stats").first()["n"] == 0


def test_a_refreshed_index_is_the_one_built_anew(spark, chunks, tmp_path):
    old = chunks.read("chunks")
    changed = old.where("seq = 2").withColumn("content", F.lit("a red hen")).unionByName(old.where("seq = 3").withColumn("seq", F.lit(9).cast("long")))
    new = search.refresh_index(chunks, f"{tmp_path}/new", changed, old.where("seq = 1").select("seq"))
    whole = search.build_index(old.where("seq in (3, 4)").unionByName(changed), f"{tmp_path}/whole")
    for name in ("postings", "lengths", "stats", "chunks"):
        assert sorted(map(str, new.read(name).collect())) == sorted(map(str, whole.read(name).select(*new.read(name).columns).collect()))
    assert ids(search.bm25(new, "red hen")) == [2] and ids(search.bm25(chunks, "red hen")) == [1]


def test_a_query_reads_the_postings_of_its_terms(spark, chunks):
    plan = search.bm25(chunks, "red hen")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(term,red)" in plan and "StringStartsWith(term,hen)" in plan and "/postings" in plan and "/chunks" not in plan


def test_follow_up_is_asked_again_with_the_question_before(chunks):
    ask = lambda q: search.bm25(chunks, q, fallback_to_any=False)
    assert search.with_retry(ask, "hen", "blue")[0] == "hen"
    query, found = search.with_retry(ask, "nowhere", None)
    assert query == "nowhere" and ids(found) == []
    query, found = search.with_retry(lambda q: search.bm25(chunks, q), "nowhere", " red ")
    assert query == "red nowhere" and set(ids(found)) == {1, 2, 3}


def test_rerank_orders_by_sequence(spark):
    rows = spark.createDataFrame([(1, -1.0, "hen fox", "", ""), (2, -1.0, "fox then hen", "", ""), (3, -1.0, "fox hen", "", "")], "seq long, score double, content string, caption string, heading string")
    got = ranking.rerank(rows, "fox hen").collect()
    assert [(r["seq"], r["rank"], r["gap"]) for r in got] == [(3, 2, 0), (2, 1, 8), (1, 0, 0)]


def test_missing_and_misshapen_vectors_are_not_low(spark):
    rows = spark.createDataFrame([(1, -1.0, "fox", "", ""), (2, -1.0, "fox", "", ""), (3, -1.0, "x", "", "")], "seq long, score double, content string, caption string, heading string")
    v = spark.createDataFrame([(1, [1.0]), (3, [0.0, 1.0])], "seq long, vector array<double>")
    got = {r["seq"]: (r["similarity"], r["is_low_relevance"]) for r in ranking.rerank(rows, "fox hen", vectors=v, query_vector=[1.0, 0.0]).collect()}
    assert got == {1: (None, False), 2: (None, False), 3: (0.0, True)}


def test_changes(spark):
    scan = spark.createDataFrame([("n", 1.0, "a"), ("t", 2.0, "b"), ("s", 2.0, "c"), ("c", 2.0, "d")], "path string, mtime double, hash string")
    old = spark.createDataFrame([("t", 2.0, "z"), ("s", 1.0, "c"), ("c", 1.0, "x"), ("gone", 1.0, "y")], "path string, mtime double, hash string")
    got = {r["path"]: (r["change"], r["refresh_mtime"]) for r in snapshots.classify(scan, old).collect()}
    assert got == {"n": ("new", False), "t": ("unchanged", False), "s": ("unchanged", True), "c": ("changed", False)}
    assert [r["path"] for r in snapshots.prune(old, scan).collect()] == ["gone"]


def test_snapshots_switch(spark, tmp_path):
    root = str(tmp_path)
    assert snapshots.current(spark, root) == {}
    for n in (1, 2):
        assert snapshots.publish(spark, root, {"t": spark.range(n)}) == n
    old = snapshots.current(spark, root)["t"]
    assert spark.read.parquet(old).count() == 2
    snapshots.publish(spark, root, {"t": old, "u": spark.range(5)})  # a table that stays is not written again
    assert snapshots.current(spark, root)["t"] == old and spark.read.parquet(snapshots.current(spark, root)["u"]).count() == 5


def test_a_failed_write_leaves_the_version_before(spark, tmp_path):
    root = str(tmp_path)
    snapshots.publish(spark, root, {"t": spark.range(3)})
    with pytest.raises(Exception, match="broken"):
        snapshots.publish(spark, root, {"t": spark.range(9), "u": spark.range(1).select(F.raise_error(F.lit("broken")))})
    assert spark.read.parquet(snapshots.current(spark, root)["t"]).count() == 3


def test_answers(spark):
    rows = spark.createDataFrame([("The red fox runs fast [1]. Cows fly over moons [3].",)], "a string")
    ex = F.array(F.struct(F.lit("f").alias("file_name"), F.lit("p").alias("location"), F.lit("the red fox runs fast").alias("text")))
    v = rows.select(evidence.verify(F.col("a"), ex).alias("v")).first()["v"]
    assert v["needs_review"] and v["invalid_citations"] == [3] and len(v["weak_sentences"]) == 1


def test_debounce_stream(spark, tmp_path):
    rows = [("2024-01-01 00:00:00",), ("2024-01-01 00:00:02",), ("2024-01-01 00:00:09",), ("2024-01-01 01:00:00",)]
    for i, r in enumerate(rows):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.json").write_text('{"ts": "%s"}' % r[0])
    stream = events.watch(spark, str(tmp_path / "in"), "ts timestamp")
    events.run_available(events.debounce(stream), "bursts", str(tmp_path / "ck"))
    assert [r["n"] for r in spark.table("bursts").orderBy("first_ts").collect()] == [2, 1]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("# 제목\n본문".encode("cp949"))
    (tmp_path / "~$b.docx").write_bytes(b"x")
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "b.docx").write_bytes(raw.getvalue())
    got = files.parse(files.scan(spark, str(tmp_path))).orderBy("path", "pos").collect()
    assert [(r["path"].rpartition("/")[2], r["status"], r["kind"], r["title"]) for r in got] == [
        ("a.txt", "ok", "text", "제목"), ("b.docx", "ok", "heading", "Top"), ("b.docx", "ok", "table", "Top"), ("bad.xlsx", "failed", None, None)]


def test_captions_of_other_labels_stay(spark):
    rows = [(1, 1, True, "x"), (1, 2, False, "[T 1-1] a"), (1, 3, True, "y"), (1, 4, False, "[T 1-2] b"), (1, 5, False, "[F 1-9] c"), (1, 6, False, "[F 1-10] c")]
    got = segments.renumber_captions(spark.createDataFrame(rows, "doc_id int, pos int, is_boundary boolean, text string")).collect()
    assert [r["text"] for r in got] == ["[T 2-1] b"]


def test_history_takes_ok_turns_before(spark):
    rows = spark.createDataFrame([(1, i, f"t{i}", i != 2) for i in range(1, 7)], "conv_id int, turn int, text string, ok boolean")
    got = {r["turn"]: [x["turn"] for x in r["history"]] for r in context.history(rows).collect()}
    assert got == {1: [], 2: [1], 3: [1], 4: [1, 3], 5: [1, 3, 4], 6: [3, 4, 5]}
