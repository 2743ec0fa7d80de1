"""The pipeline's stages and ``run`` against plain versions."""

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quillspark.llm import pipeline_stages, toxicity
from quillspark.llm.queries import MIX_EPOCHS, MIX_SEED, MIX_SHARE, MIX_WEIGHTS, domain_of_source, tokenizer_path

from test_mixing_weights import plain_quotas
from test_near_copies import kept

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def clean(rng, n):
    return ["".join(chr(97 + int(c)) for c in f"{x:04d}") for x in rng.integers(0, 3000, n)]


@pytest.fixture(scope="module")
def corpus():
    """Rows with toxic texts, exact and near copies, null and empty texts, null ids and repeated rows."""
    rng = np.random.default_rng(21)
    rows = []
    for i in range(320):
        words = clean(rng, int(rng.integers(8, 90)))
        if i % 5 == 1:
            words[3:6] = ["vilest", "vile", "rotten"]
        rows.append((i, " ".join(words), ["en", "de", None][i % 3], None if i % 17 == 0 else f"src{i % 4}", i))
    for i in range(0, 60, 3):
        words = rows[i][1].split()
        rows.append((500 + i, " ".join(words), "en", "src1", 1))
        words[len(words) // 2] = "other"
        rows.append((600 + i, " ".join(words), "en", "src0", 1))
    rows += [(700, None, "en", "src0", None), (701, "", "en", "src1", 0), (None, "a null id " * 9, None, None, 1), rows[2], rows[2]]
    return rows


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(corpus, SCHEMA).write.parquet(f"{out}/documents.parquet")
    labels = [(i, int(i % 5 == 1)) for i in range(320)] + [(None, 1), (2, None), (9999, 1)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


def plain_mix(rows):
    """Rows as often as the mixture takes them."""
    words = lambda t: len((t or "").split())
    domains = {0: "web", 1: "books", 2: "forums"}
    leaf = lambda r: (domains[int(r[3][3:]) % 3] if r[3] else "unknown", r[2] or "unknown", r[3] or "unknown")
    tokens = {}
    for r in rows:
        tokens[leaf(r)] = tokens.get(leaf(r), 0) + words(r[1])
    budget = int(sum(tokens.values()) * MIX_SHARE)
    quotas = plain_quotas(tokens, budget, MIX_WEIGHTS, MIX_EPOCHS)
    out = []
    for at, quota in quotas.items():
        epochs, rest = divmod(quota, tokens[at])
        key = lambda r: int(hashlib.md5(":".join([str(MIX_SEED), str(epochs)] + ([str(r[0])] if r[0] is not None else [])).encode()).hexdigest()[:15], 16)  # noqa: B023, E731
        own = sorted((r for r in rows if leaf(r) == at), key=key)
        taken = {key(r): 0 for r in own}
        for k in taken:
            taken[k] = sum(words(r[1]) for r in own if key(r) < k) < rest
        out += [r for r in own for _ in range(epochs + taken[key(r)])]
    return out


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_toxic_rows_go_and_others_stay(spark, corpus, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    got = rows_of(corpus_pipeline.toxicity_stage(spark, docs, folder))
    model = toxicity.train(spark, docs, labels, "doc_id", "text", "toxic")
    plain = [r for r in corpus if toxicity.probability(model, toxicity.assess(model, toxicity.Scores(model), r[1] or "")[0]) < 0.5]
    assert got == sorted(plain, key=str) and 200 < len(got) < len(corpus)
    assert {None, 700, 701} <= {r[0] for r in got}
    assert corpus_pipeline.toxicity_stage(spark, docs.limit(0), folder).count() == 0


def test_near_copies_leave_columns_alone(spark, corpus):
    rows = [(*r, "mine", f"row {n}", {"a": n}) for n, r in enumerate(corpus)]
    docs = spark.createDataFrame(rows, SCHEMA + ", _id string, _quill_row string, m map<string,int>").withColumns({"_quill_maybe": F.lit(1), "_quill_bits": F.lit(2), "a.b": F.lit(3)})
    got = pipeline_stages.drop_near_copies(spark, docs)
    assert got.columns == docs.columns
    got = got.collect()
    ids = [(10**9 if r[0] is None else r[0], r[1]) for r in corpus]
    assert sorted(10**9 if r["doc_id"] is None else r["doc_id"] for r in got) == kept(list(dict.fromkeys(ids)))
    assert all(r["_id"] == "mine" and tuple(r)[:5] == rows[int(r["_quill_row"][4:])][:5] for r in got)
    assert pipeline_stages.drop_near_copies(spark, docs.limit(0)).count() == 0


def test_mixture_is_that_of_the_plain_version(spark, corpus):
    docs = spark.createDataFrame(corpus, SCHEMA)
    got = rows_of(pipeline_stages.mix(spark, docs, MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, domain_of_source()))
    assert got == sorted(plain_mix(corpus), key=str) and got
    named = docs.withColumnRenamed("n_chars", "_quill_copy")
    assert rows_of(pipeline_stages.mix(spark, named, MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, domain_of_source())) == got
    assert pipeline_stages.mix(spark, docs.limit(0), MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, domain_of_source()).count() == 0


def test_run_is_the_stages_one_after_the_other(spark, corpus, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.train(spark, docs, labels, "doc_id", "text", "toxic")
    rows = [r for r in corpus if toxicity.probability(model, toxicity.assess(model, toxicity.Scores(model), r[1] or "")[0]) < 0.5]
    stay = set(kept(list(dict.fromkeys((10**9 if r[0] is None else r[0], r[1]) for r in rows))))
    rows = list(dict.fromkeys(r for r in rows if (10**9 if r[0] is None else r[0]) in stay))
    rows = plain_mix(rows)
    tokenizer = Tokenizer.from_file(tokenizer_path())
    plain = []
    for r in rows:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]
        start = 0
        for bit in range(11, -1, -1):
            if len(ids) >> bit & 1:
                own = struct.pack(f"<{1 << bit}I", *ids[start : start + (1 << bit)])
                plain.append((r[0], start, 1 << bit, own, zlib.crc32(own), len(ids)))
                start += 1 << bit
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted(r["sequence_id"] for r in got) == list(range(len(got)))
    assert sorted(((r["doc_id"], r["start"], r["length"], bytes(r["ids"]), r["ids_crc32"], r["doc_tokens"]) for r in got), key=str) == sorted(plain, key=str)
    assert len(got) > 300


def test_run_of_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_toxicity_sends_texts_in_small_batches(spark, monkeypatch):
    def sizes(docs, *_, **__):
        return docs.mapInArrow(lambda batches: (pa.record_batch([pa.array([b.num_rows])], names=["n"]) for b in batches), "n long")

    monkeypatch.setattr(pipeline_stages, "BATCH", 20_000)
    monkeypatch.setattr(pipeline_stages, "score_documents", sizes)
    docs = spark.range(400).coalesce(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 200).alias("text"))
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    found = [r["n"] for r in pipeline_stages.drop_toxic(spark, docs, labels).collect()]
    assert sum(found) == 400 and max(found) < 100
