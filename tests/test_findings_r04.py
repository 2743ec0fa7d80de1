"""Findings of the fourth review: tests named after the finding whose change they hold."""

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillspark.operators import indexing, search
from quillspark.workspace import Scratch, save, shared_dir


def shuffled(spark):
    """Files of shuffles on this machine's disk."""
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {p for d in dirs for p in Path(d).rglob("shuffle_*.data")}


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_f2_a_written_table_leaves_no_shuffle(spark, tmp_path):
    before = shuffled(spark)
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name)
    save(spark.range(50_000).repartition("id").groupBy((F.col("id") % 100).alias("k")).count(), str(tmp_path / "t"))
    for _ in range(50):  # they go a moment later
        if not (left := shuffled(spark) - before):
            break
        time.sleep(0.2)
    assert not left and spark.conf.get(name) == was
    assert spark.read.parquet(str(tmp_path / "t")).count() == 100


def files(rows):
    return [(path, mtime, bytearray(text.encode())) for path, mtime, text in rows]


def test_f2_f3_f4_f5_a_run_of_the_index_leaves_but_the_store(spark, tmp_path):
    root = Path(shared_dir(spark).removeprefix("file:"))
    here = lambda: {p for x in ("indexing", "chunks") for p in root.glob(f"quillspark-{x}-*/*")}
    before, store = here(), indexing.Store(spark, str(tmp_path / "store"))
    schema = "path string, mtime double, content binary"
    store.index(spark.createDataFrame(files([(f"f{i}.txt", 1.0, f"old word{i} here") for i in range(9)]), schema))
    new = spark.createDataFrame(files([(f"f{i}.txt", 2.0, f"new word{i} here\n" + "x y z. " * 300) for i in range(1, 12)]), schema)
    report = store.index(new)
    assert not here() - before
    assert report.first().asDict() == {"scanned": 11, "created": 3, "updated": 8, "skipped": 0, "pruned": 1, "embedded": 0, "failures": 0, "indexed": 11}
    rows = sorted((r["seq"], r["path"]) for r in store.read("chunks").select("seq", "path").collect())
    assert [s for s, _ in rows] == list(range(9, 9 + len(rows))) and [p for _, p in rows] == sorted(p for _, p in rows) and len(rows) > 11
    assert {r["path"] for r in store.search("new", limit=None, keep=("path",)).collect()} == {f"f{i}.txt" for i in range(1, 12)}
    assert store.search("old", limit=None).count() == 0


def test_f2_blocks_are_cut_in_their_place(spark):
    rows = spark.range(300).select(F.format_string("p%03d", (F.col("id") * 7) % 100).alias("path"), (F.col("id") % 3).alias("pos"), F.lit("x").alias("content"))
    cut = lambda x: x.select("path", "pos", F.posexplode(F.array_repeat("content", 4)).alias("k", "content"))
    scratch = Scratch(spark, "t")
    got = [(r["seq"], r["path"], r["pos"], r["k"]) for r in indexing.numbered(rows, 5, ("path", "pos"), cut, scratch).orderBy("seq").collect()]
    assert [x[0] for x in got] == list(range(5, 1205)) and [x[1:] for x in got] == sorted(x[1:] for x in got)
    assert scratch.count == 1  # what the cut chunks are numbered in is the only table


@pytest.mark.parametrize("seqs", [range(-40_000, 70_000, 3), range(-(10**12), 10**12, 10**9 + 7)])
def test_f5_what_is_out_of_a_segment_is_told_where_rows_lie(spark, monkeypatch, seqs):
    monkeypatch.setattr(search, "FEW_GONE", 0)
    monkeypatch.setattr(search, "BITMAPS", 100)
    near = seqs.step < 10
    rows = spark.createDataFrame([(s, "t") for s in seqs for _ in range(2)], "seq long, term string")
    out = [s for i, s in enumerate(seqs) if i % 5 < 2]
    found = search.without(rows, spark.createDataFrame([(s,) for s in out], "seq long"), len(out))
    assert ("_bits" in found._jdf.queryExecution().toString()) == near and found.columns == ["seq", "term"]
    got = sorted(r["seq"] for r in found.collect())
    assert got == sorted(s for i, s in enumerate(seqs) if i % 5 >= 2 for _ in range(2))


def test_f2_contents_stay_where_no_chunk_is_both_changed_and_out(spark, tmp_path, monkeypatch):
    schema = "seq long, type string, content string, file_name string, keywords string, caption string"
    rows = lambda ids, text: spark.createDataFrame([(i, "text", f"{text} w{i}", "a", "", "") for i in ids], schema)
    index = search.build_index(rows(range(20), "old"), str(tmp_path / "a"))
    written = []
    monkeypatch.setattr(search, "save", lambda frame, path, *x: (written.append((path, plan_of(frame))), save(frame, path, *x)))
    new = search.refresh_index(index, str(tmp_path / "b"), rows(range(30, 33), "new"), spark.range(5).select(F.col("id").alias("seq")))
    assert {r["seq"] for r in new.read("chunks").collect()} == {*range(5, 20), *range(30, 33)}
    assert "Join" not in dict((Path(p).name, plan) for p, plan in written)["chunks"]
    both = search.refresh_index(new, str(tmp_path / "c"), rows([6, 7], "new"), spark.createDataFrame([(7,), (8,)], "seq long"))
    assert {r["seq"] for r in both.read("chunks").collect()} == {5, 6, *range(9, 20), *range(30, 33)}
