import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillspark.llm import ann, html_extract, lattice, licences, mixing, packing, queries, sharding, simhash, toxicity, url_lists
from quillspark.llm.components import connected_components
from quillspark.llm.pipeline_stages import drop_near_copies
from quillspark.llm.queries import domain_of_source, tokenizer_path
from quillspark.workspace import Scratch

#: Columns with names that operators use inside, beside null ids, null and empty texts and repeated rows.
DOCS = [(1, "alpha beta gamma delta", 0, "x"), (2, "alpha beta gamma delta", 0, "x"), (2, "alpha beta gamma delta", 0, "x"), (3, None, 1, None),
        (4, "", 1, "y"), (None, "one two three four five", 2, "y"), (5, "  \n\t ", 2, "y"), (6, "Long " * 30_000, 3, "z")]
SCHEMA = "doc_id long, text string, _id long, fp string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 101), (100, 101), (None, 7), (200, None), (None, None)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges, Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}


def plain_simhash(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_cases(spark, docs, empty):
    got = simhash.simhash_components(spark, docs).collect()
    assert len(got) == len(DOCS)
    by = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in got}
    assert by == {(i, f"{plain_simhash(t):016x}"): {1: 1, 2: 1, 3: 3, 4: 3, 5: 3, 6: 6, None: None}[i] for i, t, *_ in DOCS}
    assert simhash.simhash_components(spark, empty).count() == 0


def test_pigeonring_loses_no_link(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = [int(x) for x in base]
    for x in base[:30]:
        for n in (1, 2, 3):
            y = int(x)
            for b in rng.choice(64, n, replace=False):
                y ^= 1 << int(b)
            fps.append(y)
    fps = sorted(set(fps))
    classes = spark.createDataFrame([(i, bytearray(struct.pack(">Q", f))) for i, f in enumerate(fps)], "node long, fp binary")
    got = {r["node"]: r["component"] for r in simhash.near_duplicates(spark, classes, simhash.CONTRACT, Scratch(spark, "t")).collect()}
    label = list(range(len(fps)))
    for _ in fps:
        for i, x in enumerate(fps):
            for j, y in enumerate(fps):
                if (x ^ y).bit_count() <= 2:
                    label[i] = min(label[i], label[j])
    assert {i: got.get(i, i) for i in range(len(fps))} == dict(enumerate(label))


def test_pigeonring_compares_blocks_of_any_size_alike():
    rng = np.random.default_rng(15)
    for ring in (simhash.CONTRACT, simhash.Ring(128, 13, 4, 3)):
        x = rng.integers(0, 256, (300, ring.bits // 8), np.uint8)
        y = x[rng.integers(0, 300, 280)].copy()
        for row in y:
            for b in rng.choice(ring.bits, rng.integers(0, 6), replace=False):
                row[b // 8] ^= 128 >> b % 8
        bits = (np.unpackbits(x, axis=1)[:, None, :] != np.unpackbits(y, axis=1)[None, :, :]).sum(2)
        compare, screen = simhash.comparer(ring)
        assert screen(x[:280], y)[np.diag(bits[:280]) <= ring.distance].all()
        assert np.array_equal(compare(x, y), bits <= ring.distance)
        assert np.array_equal(compare(x[:5], y[:7]), bits[:5, :7] <= ring.distance)
        assert 0 < (bits <= ring.distance).sum() < (bits <= 5).sum()


def test_near_copies_stage_keeps_one(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in rng.integers(0, 5000, 300)]
    near = list(words)
    near[100] = "changed"
    rows = [(7, " ".join(words)), (3, " ".join(near)), (9, " ".join(words)), (4, " ".join(words[:150])), (5, "short text"), (5, "short text"), (6, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in drop_near_copies(spark, docs).collect()) == [3, 4, 5, 6]
    assert drop_near_copies(spark, docs.limit(0)).count() == 0


def plain_components(x, threshold):
    """(links of each row, smallest row reachable) by all pairs of rows."""
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    for _ in range(len(x)):
        after = np.minimum(label, np.where(near, label[None, :], len(x)).min(axis=1))
        if (after == label).all():
            break
        label = after
    return near.sum(1).tolist(), label.tolist()


VECTORS = "vec_id long, embedding array<double>, dim int, unit string"


def test_lattice_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 64))
    for i in range(0, 150, 3):  # cosines around the threshold
        x[i + 1] = x[i] + rng.normal(size=64) * rng.uniform(0.1, 0.6)
    x[290:] = x[0]
    links, components = plain_components(x, 0.9)
    rows = [(i, [float(a) for a in v], 0, "x") for i, v in enumerate(x)]
    rows += [(900, None, 0, "x"), (901, [], 0, "x"), (902, [0.0] * 64, 0, "x"), (903, [float("nan")] * 64, 0, "x"), (904, [None] * 64, 0, "x")]
    got = {r["vec_id"]: r for r in lattice.embedding_components(spark, spark.createDataFrame(rows, VECTORS)).collect()}
    assert [got[i]["n_links"] for i in range(300)] == links
    assert [got[i]["component_id"] for i in range(300)] == components
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in range(300))
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(900, 905))


def test_lattice_of_two_dimensions_null_and_repeated_ids(spark):
    rng = np.random.default_rng(12)
    rows, place = [], 0
    for dim in (16, 40):
        x = rng.normal(size=(60, dim))
        for i in range(0, 60, 4):
            x[i + 1] = x[i] + rng.normal(size=dim) * 0.2
        links, components = plain_components(x, 0.9)
        rows += [(place + i, [float(a) for a in v], n, f"{place + c}") for i, (v, n, c) in enumerate(zip(x, links, components))]
        place += 60
    frame = spark.createDataFrame(rows, VECTORS)
    got = {r["vec_id"]: (r["n_links"], str(r["component_id"])) for r in lattice.embedding_components(spark, frame).collect()}
    assert got == {i: (n, c) for i, _, n, c in rows} and any(n for n, _ in got.values())
    assert lattice.embedding_components(spark, frame.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, rows[0][1], 0, ""), (7, rows[0][1], 0, ""), (7, rows[0][1], 0, ""), (None, None, 0, "")], VECTORS)
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), str(r["kept"])) for r in lattice.embedding_components(spark, odd).collect())
    assert got == [("7", 2, "7", "True"), ("7", 2, "7", "True"), ("None", 0, "None", "None"), ("None", 2, "7", "None")]


def test_lattice_at_the_threshold_sends_rows_and_no_pairs(spark):
    """Vectors with one cosine to each other, by 16 bits too close to the threshold to tell."""
    n = 60
    for cosine, together in ((0.90004, True), (0.89996, False)):
        gram = np.full((n, n), cosine) + np.eye(n) * (1 - cosine)
        x = np.linalg.cholesky(gram)
        rows = [(i, [float(a) for a in v] + [0.0] * 4, 0, "x") for i, v in enumerate(x)]
        got = lattice.embedding_components(spark, spark.createDataFrame(rows, VECTORS)).collect()
        assert [(r["n_links"], r["component_id"]) for r in sorted(got)] == [(n - 1, 0) if together else (0, i) for i in range(n)]


def test_tables_follow_the_rows_without_a_cap():
    assert [lattice.layout(n) for n in (0, 10**4, 10**6, 10**8)] == [(2, 14), (2, 14), (3, 34), (4, 81)]
    assert lattice.layout(10**10) == (5, 226) and lattice.layout(10**12)[0] == 6


def test_packing_round_trip(spark, docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    got = packing.pack(spark, docs, tokenizer_path()).collect()
    assert sorted(r["sequence_id"] for r in got) == list(range(len(got)))
    for i, text, *_ in DOCS:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        own = sorted({(r["start"], r["length"], bytes(r["ids"]), r["ids_crc32"]) for r in got if r["doc_id"] == i})
        assert b"".join(x[2] for x in own) == struct.pack(f"<{len(ids)}I", *ids)
        assert all(zlib.crc32(x[2]) == x[3] and x[1] <= 4096 and not x[1] & (x[1] - 1) for x in own)
    assert packing.pack(spark, empty, tokenizer_path()).count() == 0


def plain_ids(tokenizer, text):
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    return struct.pack(f"<{len(ids)}I", *ids)


def test_word_ids_equal_the_tokenizers():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())  # another one than the encoder's, as it is read
    w = packing.WordIds(tokenizer_path(), limit=5)
    added = [x.content for x in tokenizer.get_added_tokens_decoder().values()]
    assert added
    texts = ["It's DON'T 12a_b ''s !'s", "Σίσυφος ½ İ x² é é ﬁ", "", "a\x1cb\x85c d", *added]
    texts += [f"end {x} here" for x in added] + [f"x{x}y{x}{x} z" for x in added] + [f"é {x.upper()} {x[:-1]} >" for x in added] + [f"Σ {x} e\u0301" for x in added]
    for text in texts:
        assert w.encode(text) == plain_ids(tokenizer, text)


def test_word_ids_equal_the_tokenizers_on_random_texts():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    w = packing.WordIds(tokenizer_path(), limit=1000)
    added = [x.content for x in tokenizer.get_added_tokens_decoder().values()]
    rng = np.random.default_rng(9)
    bits = [*"abcXYZ 019 _-'.,!?<|>\n\t", "'s", "'LL", "é", "É", "e\u0301", "ß", "“", "—", "日本", "\u212a", "\u00a0", "the ", "Then ", " end", *added]
    for _ in range(4000):
        text = "".join(bits[i] for i in rng.integers(0, len(bits), rng.integers(1, 30)))
        assert w.encode(text) == plain_ids(tokenizer, text), text


def test_html_cases(spark):
    page = "<html><body><nav><a href=x>Menu</a></nav><div class='cookie-notice'>We use cookies, many of them, for all sorts of reasons.</div><article><h1>A &amp; B</h1><p>First,  long\nparagraph of text, with commas, and words.<p>Second <b>bold</b>.<div class='comments'><p>Nice, very nice comment, really.</div></article><footer>Foot</footer>"
    rows = [(1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "<script>x</script>"), (None, "x", "plain text < here"), (1, "u", page)]
    got = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r["text"] for r in got] == ["A & B First, long paragraph of text, with commas, and words. Second bold."] + ["", "", "", "plain text < here"] + [got[0]["text"]]
    assert [r["n_chars"] for r in got] == [len(r["text"]) for r in got]


def test_maximal_segments_are_those_of_the_definition():
    rng = np.random.default_rng(3)
    for _ in range(300):
        s = rng.normal(-0.2, 1, rng.integers(0, 14))  # no two sums are equal, so the places are one

        def split(lo, hi):  # the best segment, then both sides of it
            best = max(((s[i:j].sum(), i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=(0,))
            if best[0] <= 0:
                return []
            return split(lo, best[1]) + [best[1:]] + split(best[2], hi)

        got = toxicity.maximal_segments(s)
        assert [(i, j) for i, j, _ in got] == split(0, len(s))
        assert [v for *_, v in got] == pytest.approx([s[i:j].sum() for i, j, _ in got])


def test_passages_of_very_long_texts(spark):
    model = toxicity.Model({"w:vile": 4.0, "b:rott": 3.0}, -0.05, 1.0, 0.5, 1.0, -3.0)
    long = "plain words " * 300_000
    rows = [(1, long + "vile rotten vile rottenness " + long, 0, "x"), (2, long, 0, "x"), (3, None, 0, "x"), (4, "!", 0, "x"), (5, "Vile, VILE rotten", 0, "x")]
    got = {r["doc_id"]: r for r in toxicity.score_documents(spark.createDataFrame(rows, SCHEMA), model, spans=True).collect()}
    assert [(x["begin"], x["end"]) for x in got[1]["_quill_passages"]] == [(len(long), len(long) + 27)]
    assert [(x["begin"], x["end"]) for x in got[5]["_quill_passages"]] == [(0, 17)]
    assert got[2]["_quill_score"] == got[3]["_quill_score"] == got[4]["_quill_score"] < got[1]["_quill_score"] < 1
    own = spark.createDataFrame(rows[1:], SCHEMA).selectExpr("*", "'own' AS _quill_score", "7 AS _quill_passages")
    same = toxicity.score_documents(own, model, spans=True).collect()
    assert all((r["_quill_score"], r["_quill_passages"]) == ("own", 7) for r in same)
    assert {r["doc_id"]: (r["_quill_score_"], r["_quill_passages_"]) for r in same} == {i: (got[i]["_quill_score"], got[i]["_quill_passages"]) for i in (2, 3, 4, 5)}
    assert toxicity.score_documents(own, model, reject=True).columns == own.columns


def test_toxicity_learns_and_handles_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        words = [f"w{x}" for x in rng.integers(0, 200, 60)]
        words = ["".join(chr(97 + int(c)) for c in w[1:]) + "xx" for w in words]
        if i % 5 == 0:
            words[10:13] = ["vilest", "vile", "rotten"]
        rows.append((i, " ".join(words), None, "x"))
    docs = spark.createDataFrame(rows + [(None, None, None, "x"), (9999, "", None, "x"), (9998, "!!", None, None)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)] + [(None, 1), (1, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(spark, docs, labels).collect()
    assert len(got) == 403 and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 400]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held)
    assert np.mean([r["predicted"] == int(r["doc_id"] % 5 == 0) for r in held]) > 0.9
    assert all(r["predicted"] == 0 for r in got if r["doc_id"] in (None, 9998, 9999))
    assert toxicity.toxicity(spark, docs.limit(0), labels.limit(0)).count() == 0


def test_mixing_water_level(spark):
    rows = [("a", 10, 1), ("b", 100, 1), ("c", 100, 2)]
    frame = spark.createDataFrame([(n, cap, w, 120) for n, cap, w in rows], "lang string, cap long, w long, budget long")
    got = {r["lang"]: r["got"] for r in mixing.share_out(frame, [], "lang").collect()}
    assert got == {"a": 10, "b": 37, "c": 73}


def test_mixing_cases(spark):
    rows = [(i, "a b c", None if i % 7 == 0 else "en", None if i % 11 == 0 else f"src{i % 4}", 3) for i in range(100)] + [(None, None, None, None, None), (5, "a b c", "en", "src1", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, key long")
    got = mixing.mix_sources(spark, docs, domain_of_source(), {}, share=0.5)
    taken = got.agg(F.sum(F.col("_quill_copies") * F.col("_quill_tokens"))).first()[0]
    assert 150 <= taken <= 170 and got.columns[:5] == docs.columns
    assert mixing.mix_sources(spark, docs.limit(0), domain_of_source(), {}).count() == 0


def test_nearest_recall_and_odd_rows(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 16)).round(3)
    x[2900:] = x[1]
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(9000, None), (9001, [0.0] * 16), (9002, [float("inf")] * 16), (None, [1.0] * 16), (3, [float(a) for a in x[3]])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(spark, frame, frame.where("vec_id % 100 = 0 or vec_id = 1")).collect()
    hit = total = 0
    for q in sorted({r["query_id"] for r in got}):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(3000), d))[:10]
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11)) and all(r["score"] == pytest.approx(d[r["vec_id"]]) for r in own)
        hit, total = hit + len(set(best) & {r["vec_id"] for r in own}), total + 10
        if q == 1:
            assert [r["vec_id"] for r in own] == list(range(2900, 2910))
    assert hit / total >= 0.9 and total == 310
    assert ann.nearest(spark, frame.limit(0), frame.limit(0)).count() == 0


def test_index_grows_by_levels_for_each_dimension(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL", 16)
    monkeypatch.setattr(ann, "GROUP_ROWS", 40)
    monkeypatch.setattr(ann, "PART_ROWS", 500)
    monkeypatch.setattr(ann, "GROUP_QUERIES", 5)
    rng = np.random.default_rng(16)
    rows, plain = [], {}
    for dim, start, n in ((12, 0, 2500), (5, 5000, 700)):
        centres = rng.normal(size=(20, dim)) * 3
        x = centres[rng.integers(0, 20, n)] + rng.normal(size=(n, dim)) * 0.3
        x[n // 2 : n // 2 + 60] = x[0]  # no tree can cut these
        rows += [(start + i, [float(a) for a in v], 1, "p") for i, v in enumerate(x)]
        for q in range(0, n, 25):
            d = np.sqrt(((x - x[q]) ** 2).sum(1))
            d[q] = np.inf
            plain[start + q] = [start + int(i) for i in np.lexsort((np.arange(n), d))[:10]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, k long, payload string")
    seen = []
    grow = ann.grow
    monkeypatch.setattr(ann, "grow", lambda *a: seen.append(a[-1]) or grow(*a))
    got = {}
    for r in ann.nearest(spark, frame, frame.where("vec_id % 25 = 0"), sample=200).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    assert sorted(got) == sorted(plain) and all(sorted(g) == list(range(1, 11)) for g in got.values()) and len(seen) >= 2
    assert sum(len(set(g.values()) & set(plain[q])) for q, g in got.items()) / (10 * len(plain)) >= 0.9
    assert [got[0][i] for i in range(1, 11)] == plain[0]


def test_lists_over_time(spark):
    changes = [("spam", "add", "domain", "bad.com", "2024-02-01"), ("spam", "remove", "domain", "bad.com", "2024-03-01"), ("spam", "add", "prefix", "ok.com/x", "2024-01-01"), ("allow", "add", "host", "fine.bad.com", "2024-01-01"), ("spam", "add", "host", None, "2024-01-01")]
    lists = spark.createDataFrame(changes, "list string, action string, kind string, entry string, at string").withColumn("at", F.to_date("at"))
    caps = [(1, "http://a.BAD.com/q", "2024-02-01"), (2, "http://bad.com", "2024-03-01"), (3, "https://u@ok.com:8/x/y?z", "2024-05-01"), (4, "http://ok.com/xy", "2024-05-01"), (5, "http://fine.bad.com/", "2024-02-10"), (6, None, "2024-02-10"), (7, "no url", "2024-02-10"), (8, "http://bad.com", None), (1, "http://a.BAD.com/q", "2024-02-01")]
    caps = spark.createDataFrame(caps, "page_id long, url string, at string").withColumn("fetched_at", F.to_date("at"))
    got = url_lists.judge(spark, caps, lists).collect()
    assert sorted((r["page_id"], r["blocked"], r["n_entries"]) for r in got) == [(1, True, 1), (1, True, 1), (2, False, 0), (3, True, 1), (4, False, 0), (5, False, 2), (6, False, 0), (7, False, 0), (8, False, 0)]
    hot = url_lists.judge(spark, caps, lists, hot=1).collect()
    assert sorted(map(str, hot)) == sorted(map(str, got))
    assert url_lists.judge(spark, caps.limit(0), lists.limit(0)).count() == 0
    assert {r["blocked"] for r in url_lists.judge(spark, caps, lists.limit(0)).collect()} == {False}
    clash = caps.selectExpr("*", "1 AS list", "'x' AS entry", "'k' AS kind", "2 AS since", "3 AS until", "4 AS _row", "'u' AS _url")
    same = url_lists.judge(spark, clash, lists.selectExpr("*", "'h' AS url", "5 AS page_id", "6 AS _at")).collect()
    assert sorted((r["page_id"], r["blocked"], r["n_entries"]) for r in same) == sorted((r["page_id"], r["blocked"], r["n_entries"]) for r in got)


def test_shards_are_even_and_whole(spark, docs, empty):
    rng = np.random.default_rng(7)
    rows = [(int(i), "t" * int(n), 0, "x") for i, n in enumerate(rng.integers(0, 400, 4000))] + [(10_000 + i, "copy" * 50, 0, "x") for i in range(200)]
    got = sharding.shard(spark, spark.createDataFrame(rows, SCHEMA)).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(got) == 4200 and len(sizes) == 16 and sizes.max() / sizes.mean() < 1.02
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"])
    assert got.groupby("text_crc32")["shard"].nunique().max() == 1
    small = sharding.shard(spark, docs).collect()
    assert len(small) == len(DOCS) and sharding.shard(spark, empty).count() == 0


def test_no_run_of_a_shard_is_too_long(spark):
    rows = [(i, "" if i % 5 == 0 else f"text {i}", 0, "x") for i in range(30_000)]
    keyed = spark.createDataFrame(rows, SCHEMA).select("doc_id", F.xxhash64("text").alias("key"), F.xxhash64("doc_id").alias("spread"), F.lit(0).alias("shard"))
    got = sharding.dealt(keyed, 512, Scratch(spark, "t")).groupBy("shard", "run", "deal").count()
    assert got.agg(F.max("count")).first()[0] <= 700 and got.agg(F.sum("count")).first()[0] == 30_000
    out = sharding.shard(spark, spark.createDataFrame(rows, SCHEMA), rows_a_task=512).toPandas()
    assert all(sorted(g) == list(range(len(g))) for _, g in out.groupby("shard")["slot"])
    assert out[out["size"] == 1]["shard"].nunique() == 1 and len(out) == 30_000


def test_shards_of_the_query_keep_the_law(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op8_histogram_sort_shards(spark, sf).toPandas()
    assert sorted(got["doc_id"]) == sorted(texts) and set(got["law"]) == {"bytes"} and got["grown_shard"].isna().all()
    raw = {i: (t or "").encode() for i, t in texts.items()}
    assert all(s == len(raw[i]) + 1 and c == zlib.crc32(raw[i]) for i, s, c in zip(got["doc_id"], got["size"], got["text_crc32"]))
    sizes = got.groupby("shard")["size"].sum().reindex(range(16), fill_value=0)
    largest = got.groupby("text_crc32")["size"].sum().max()
    assert sizes.max() - sizes.min() <= largest + 2 * 0.002 * sizes.mean() + 1
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"])
    assert got.groupby("text_crc32")["shard"].nunique().max() == 1
