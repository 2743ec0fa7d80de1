"""Segments of an index, the store that is searched, and which files a run opens."""

import io
import os
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark.operators import indexing, search, snapshots
from quillspark.sources import files

FILES = "path string, mtime double, content binary"
CHUNK = "seq long, type string, content string, file_name string, keywords string, caption string"


def written(root):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet"))


def rows_of(frame):
    return sorted(map(str, frame.select(*sorted(frame.columns)).collect()))


def found(frame):
    return sorted((r["seq"], round(r["score"], 9)) for r in frame.collect())


def test_segments_are_the_index_built_anew(spark, tmp_path):
    now = {i: f"word{i % 7} fox {'red ' * (i % 3)}number{i}" for i in range(64)}
    frame = lambda some: spark.createDataFrame([(i, "text", now[i], f"f{i}.txt", "", "") for i in some], CHUNK)
    first = index = search.build_index(frame(now), f"{tmp_path}/0")
    before = found(search.bm25(first, "red fox", limit=None))
    for step in range(1, 8):
        changed = [i for i in range(64 + step) if i % 9 == step or i >= 63 + step]
        removed = [i for i in now if i % 13 == step]
        now |= {i: f"blue fox step{step} number{i}" for i in changed}
        index = search.refresh_index(index, f"{tmp_path}/{step}", frame(changed), spark.createDataFrame([(i,) for i in removed], "seq long"))
        now = {i: x for i, x in now.items() if i not in removed}
        sizes = [s.live for s in index.segments]
        assert sum(sizes) == len(now) and min(sizes) > 0 and len(sizes) <= 2 * search.FANOUT
    whole = search.build_index(frame(now), f"{tmp_path}/whole")
    for name in ("postings", "lengths", "stats", "chunks"):
        assert rows_of(index.read(name)) == rows_of(whole.read(name))
    for query in ("red fox", "blue number1", "step3", "fox number", "nothing"):
        for options in ({}, {"require_all": False}, {"exact_word": True}):
            assert found(search.bm25(index, query, limit=None, **options)) == found(search.bm25(whole, query, limit=None, **options))
    assert any("merged" in s.path for s in index.segments)
    assert found(search.bm25(first, "red fox", limit=None)) == before  # older versions stay


def test_a_small_change_writes_little_and_all_may_go(spark, tmp_path):
    chunks = spark.range(4000).selectExpr("id AS seq", "'text' AS type", "concat_ws(' ', transform(sequence(1, 60), x -> concat('w', (id * x) % 977))) AS content", "'a.txt' AS file_name", "'' AS keywords", "'' AS caption")
    index = search.build_index(chunks, f"{tmp_path}/0")
    new = search.refresh_index(index, f"{tmp_path}/1", chunks.where("seq % 100 = 0"), chunks.select("seq").limit(0))
    assert written(f"{tmp_path}/1") < 0.1 * written(f"{tmp_path}/0")
    assert rows_of(new.read("lengths")) == rows_of(index.read("lengths"))
    none = search.refresh_index(new, f"{tmp_path}/2", chunks.limit(0), chunks.select("seq"))
    assert none.read("stats").first()[:] == (0, 0) and none.read("postings").isEmpty() and search.bm25(none, "w1").isEmpty()
    again = search.refresh_index(none, f"{tmp_path}/3", chunks.limit(3), chunks.select("seq").limit(0))
    assert again.read("stats").first()["n"] == 3


def test_bounds_of_blocks_leave_out_most_of_a_common_term(spark, tmp_path, monkeypatch):
    # "common" is everywhere, "rare" in two chunks, "tied" in equal chunks far apart
    text = "concat_ws(' ', transform(sequence(1, 2 + cast(id % 37 as int)), x -> 'common'), CASE WHEN id IN (70, 3900) THEN 'rare' END, CASE WHEN id % 500 = 3 THEN 'tied' END, concat('commonly', id % 3), transform(sequence(1, 30), x -> concat('w', (id * x) % 977)))"
    rows = spark.range(4000).coalesce(2).selectExpr("id AS seq", "if(id % 5 = 0, 'table', 'text') AS type", f"{text} AS content", "if(id % 100 = 0, 'common.txt', 'a.txt') AS file_name", "'' AS keywords", "CAST(NULL AS string) AS caption")
    index = search.build_index(rows, f"{tmp_path}/0", block=16)
    changed = rows.where("seq % 97 = 5").withColumn("content", F.concat("content", F.lit(" rare common")))
    index = search.refresh_index(index, f"{tmp_path}/1", changed, rows.where("seq % 31 = 7").select("seq"))
    assert index.block == 16 and any(s.n_gone for s in index.segments)
    cases = [
        ("rare common", {}), ("rare common", {"require_all": False}), ("tied rare", {}), ("common", {"types": ["table"]}),
        ("rare +++", {"fallback_to_any": False}), ("rare common", {"require_all": False, "exact_word": True, "weights": {"content": 1.0, "file_name": 0.0}}),
    ]
    rounded = lambda frame: [(r["seq"], round(r["score"], 9)) for r in frame.collect()]
    for query, options in cases:
        assert rounded(search.bm25(index, query, limit=7, **options)) == rounded(search.bm25(index, query, limit=None, **options))[:7], (query, options)
    named = []
    monkeypatch.setattr(search, "in_blocks", lambda i, b, f=search.in_blocks: named.append(len(b)) or f(i, b))
    search.bm25(index, "rare common", require_all=False, limit=5, exact_word=True).collect()
    assert 0 < max(named) <= 60  # of 250 blocks, all of which hold the common term
    monkeypatch.setattr(search, "NAMED", 0)  # too many to be named: joined
    assert [r["seq"] for r in search.bm25(index, "common", limit=7).collect()] == [r["seq"] for r in search.bm25(index, "common", limit=None).limit(7).collect()]


def test_a_store_is_searched_while_it_changes(spark, tmp_path):
    store = indexing.Store(spark, str(tmp_path))
    assert store.search("fox", keep=("path",)).collect() == []
    first = [("a.txt", 1.0, b"The red fox."), ("b.txt", 1.0, b"A blue hen. " * 60), ("c.txt", 1.0, b"fox and hen")]
    store.index(spark.createDataFrame(first, FILES))
    paths = lambda query: sorted({r["path"] for r in store.search(query, limit=None, keep=("path",)).collect()})
    assert paths("fox") == ["a.txt", "c.txt"] and paths("blue") == ["b.txt"] and paths("a.txt") == ["a.txt"]
    seqs = {r["seq"] for r in store.read("chunks").collect()}
    assert seqs == set(range(len(seqs)))

    def broken(rows):
        raise RuntimeError("the model is gone")

    second = [("a.txt", 2.0, b"The green fox."), ("c.txt", 1.0, b"fox and hen"), ("d.txt", 1.0, b"new hen")]
    with pytest.raises(RuntimeError):
        store.index(spark.createDataFrame(second, FILES), model="m", encode_rows=broken)
    assert paths("red") == ["a.txt"] and paths("blue") == ["b.txt"]  # as before
    store.index(spark.createDataFrame(second, FILES))
    assert paths("red") == paths("blue") == [] and paths("green") == ["a.txt"] and paths("hen") == ["c.txt", "d.txt"]
    assert not seqs & {r["seq"] for r in store.read("chunks").where("path <> 'c.txt'").collect()}  # no seq comes twice


def test_many_chunks_of_one_file_take_a_time_that_follows_its_length(spark):
    def run(n):
        text = "".join(f"Sentence {i} of the file is {'long ' * 50}.\n" for i in range(n))
        blocks = spark.createDataFrame([("p.log", "ok", None, "t", 0, "text", None, None, text, *[None] * 9)], files.SCHEMA)
        began = time.perf_counter()
        rows = indexing.chunk_rows(blocks).select("seq", "chunk_id").collect()
        return time.perf_counter() - began, rows

    run(100)
    small, _ = run(1250)
    large, rows = run(5000)
    assert len(rows) == 5000 == len({r["seq"] for r in rows}) == len({r["chunk_id"] for r in rows})
    assert large < 10 * small + 5


def test_no_two_of_many_files_share_a_seq(spark):
    blocks = spark.range(200_000).selectExpr("concat('f', id, '.txt') AS path", "'ok' AS status", "0 AS pos", "'text' AS kind", "'x' AS content")
    none = spark.createDataFrame([], files.SCHEMA)
    rows = indexing.chunk_rows(none.unionByName(blocks, allowMissingColumns=True), first=7)
    n, distinct, least, most = rows.agg(F.count("*"), F.countDistinct("seq"), F.min("seq"), F.max("seq")).first()
    assert (n, distinct, least, most) == (200_000, 200_000, 7, 200_006)


def test_a_run_opens_new_and_touched_files_alone(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    folder.mkdir()
    for name in ("a.txt", "b [1]*.txt", "c{2}.txt"):
        (folder / name).write_text(f"text of {name} " + "x" * 1000)
    store = indexing.Store(spark, str(tmp_path / "store"))
    got = store.index_folder(files.listing(spark, str(folder))).first()
    assert (got["created"], got["failures"]) == (3, 0)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 10)  # any file that is opened now is an error
    try:
        got = store.index_folder(files.listing(spark, str(folder))).first()
        assert (got["skipped"], got["updated"]) == (3, 0)
        (folder / "d.txt").write_text("short")
        os.remove(folder / "a.txt")
        got = store.index_folder(files.listing(spark, str(folder))).first()
        assert (got["created"], got["skipped"], got["pruned"]) == (1, 2, 1)
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    # a file too long to be read is a failed document, and the run goes on
    monkeypatch.setattr(indexing, "MAX_LENGTH", 2000)
    (folder / "long.txt").write_text("y" * 3000)
    got = store.index_folder(files.listing(spark, str(folder))).first()
    assert (got["created"], got["failures"]) == (1, 1)
    row = store.read("documents").where("path like '%long.txt'").first()
    assert row["status"] == "failed" and "longer than" in row["error"]
    assert store.index_folder(files.listing(spark, str(folder))).first()["skipped"] == 4
    some = files.listing(spark, str(folder)).select("path")
    assert files.contents_of(spark, some, named=1).count() == 4


@pytest.mark.parametrize("text,encoding,said", [
    ("café ole", "latin-1", "cp1252"), ("über alles Größe", "cp1252", "cp1252"), ("Déjà vu, naïve façade — “quoted”", "cp1252", "cp1252"), ("ñandú señor año", "latin-1", "cp1252"),
    ("회의록을 보냅니다. 다음 주까지 확인해 주세요.", "cp949", "cp949"), ("회의록을 보냅니다 (초안) v2", "euc-kr", "cp949"), ("똠방각하와 펲시", "cp949", "cp949"),
    ("hello world 문서", "utf-16-le", "utf-16-le"), ("hello", "utf-16-be", "utf-16-be"), ("hello 문서", "utf-16", "utf-16"),
    ("문서", "utf-8", "utf-8-sig"), ("문서", "utf-8-sig", "utf-8-sig"), ("plain", "ascii", "utf-8-sig"), ("", "ascii", "utf-8-sig"),
])
def test_encodings_are_told_by_their_bytes(text, encoding, said):
    assert files.decode(text.encode(encoding)) == (text, said)


def test_bytes_of_no_encoding_are_replaced():
    text, encoding = files.decode(b"\x81 \x8d\xff\x81")
    assert encoding == "utf-8" and "�" in text


def docx_with(images):
    out = io.BytesIO()
    links = "".join(f'<Relationship Id="r{i}" Target="media/{name}"/>' for i, name in enumerate(images))
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="u"><w:body><w:p><w:r><w:t>text</w:t></w:r></w:p></w:body></w:document>')
        z.writestr("word/_rels/document.xml.rels", f"<Relationships>{links}</Relationships>")
        for name, content in images.items():
            z.writestr(f"word/media/{name}", content)
    return out.getvalue()


def test_images_can_be_read_back_and_go_with_their_chunks(spark, tmp_path):
    png = lambda x: b"\x89PNG\r\n\x1a\n" + x * 20
    store = indexing.Store(spark, str(tmp_path))
    assert store.assets().count() == store.image_contents().count() == 0
    first = [("a.docx", 1.0, docx_with({"x.png": png(b"1"), "y.png": png(b"2")})), ("b.docx", 1.0, docx_with({"x.png": png(b"1")})), ("c.txt", 1.0, b"no image")]
    store.index(spark.createDataFrame(first, FILES))
    held = lambda: {r["image_path"]: bytes(r["content"]) for r in store.image_contents().collect()}
    assert held() == {"a.docx/x.png": png(b"1"), "a.docx/y.png": png(b"2"), "b.docx/x.png": png(b"1")}
    assert store.assets().count() == 2  # equal bytes are kept once
    named = {r["chunk_id"] for r in store.read("chunks").where("type = 'image'").collect()}
    assert named == {r["chunk_id"] for r in store.read("images").collect()}
    # b stays, a changes one image and loses the other
    second = [("a.docx", 2.0, docx_with({"x.png": png(b"3")})), *first[1:]]
    store.index(spark.createDataFrame(second, FILES))
    assert held() == {"a.docx/x.png": png(b"3"), "b.docx/x.png": png(b"1")} and store.assets().count() == 2
    assert store.stale_images.count() == 1
    store.index(spark.createDataFrame(first[2:], FILES))
    assert held() == {} and store.assets().count() == 0
    assert snapshots.current(spark, str(tmp_path))["assets"] == "[]"
