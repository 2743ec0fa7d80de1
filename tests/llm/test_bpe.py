"""Streaming BPE against the tokenizers library, its lookahead against brute force, and round trips."""

import hashlib
import itertools
import random

import pytest
from tokenizers import Tokenizer

from quillspark.llm import bpe, queries

SF = "/root/testdata/sf0.001"
FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
ODD = "ΣσςİıſKÅéèöÄ中文한국어가́̀  ​½²①٣🎉👍🏽ﬁ'sS'tdll'RE<|endoftext|><|startoftext|> \t\n\x0b\x1c\x85\x00"


def texts():
    rng = random.Random(5)
    some = ["".join(rng.choice(ODD + "abcdeth in the 'll 123!?.,-_") for _ in range(rng.randint(0, 60))) for _ in range(800)]
    long = ["a" * 5000, "ab" * 7000 + "'s", "x" * 9000 + " " + "é" * 4000, "=-" * 5000, "".join(rng.choice("the andino") for _ in range(150_000)), "".join(rng.choice("abcdefgh") for _ in range(20_000))]
    return some + long + ["", " ", "<|endoftext|>", "don't DON'T 'stop"]


@pytest.mark.parametrize("name", FILES)
def test_ids_and_decoding_are_the_library_s(name):
    path = queries.tokenizer_path(name)
    library, machine = Tokenizer.from_file(path), bpe.Transducer(path)
    for text in texts():
        ids = library.encode(text, add_special_tokens=False).ids
        said = library.decode(ids, skip_special_tokens=False)
        assert list(machine.encode(text)) == ids, text[:80]
        decoder = bpe.Decoder(machine.tokens, machine.byte_level)
        assert "".join([*map(decoder.push, ids), decoder.finish()]) == said, text[:80]
        assert machine.digests(text) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(said.encode()).hexdigest())


def model(merges, suffix=""):
    letters = sorted({x for pair in merges for x in "".join(pair).replace(suffix, "") if x} if suffix else set("".join(map("".join, merges))))
    vocab = dict.fromkeys([*letters, *[x + suffix for x in letters], *["".join(p) for p in merges]])
    return {"merges": merges, "vocab": {x: i for i, x in enumerate(vocab)}, "end_of_word_suffix": suffix}


def plain(merges, symbols):
    """Rule by rule from the left."""
    for u, v in merges:
        out = []
        for x in symbols:
            if out and (out[-1], x) == (u, v):
                out[-1] += v
            else:
                out.append(x)
        symbols = out
    return symbols


def proper_merges(rng, letters, n):
    known, merges = list(letters), []
    while len(merges) < n:
        pair = [rng.choice(known), rng.choice(known)]
        if "".join(pair) not in known:
            merges.append(pair)
            known.append("".join(pair))
    return merges


def test_lookahead_bounds_every_change_of_small_merge_lists():
    rng = random.Random(8)
    for _ in range(60):
        merges = proper_merges(rng, "ab", rng.randint(1, 6))
        found = bpe.Merges(model(merges))
        assert found.lookahead is not None
        for n in range(1, 10):
            for word in itertools.product("ab", repeat=n):
                whole = plain(merges, list(word))
                assert found.merge(list(word)) == found._merge_long(list(word)) == whole
                # beginnings of the word: tokens that end so far before the end are tokens of the whole
                for k in range(1, n):
                    done = 0
                    for token, final in zip(plain(merges, list(word[:k])), whole):
                        done += len(token)
                        if done > k - found.lookahead:
                            break
                        assert token == final


def test_lookahead_of_chains_and_of_improper_lists():
    assert bpe.Merges(model([])).lookahead == 0
    assert bpe.Merges(model([["a", "b"]])).lookahead == 1
    # ab takes b's a first, so that bc loses its c's place, and so on to the left
    assert bpe.Merges(model([["c", "d"], ["b", "c"], ["a", "b"]])).lookahead == 3
    assert bpe.Merges(model([["ab", "c"], ["a", "b"]])).lookahead is None
    assert bpe.Merges(model([["a", "b"], ["b", "c"], ["a", "bc"], ["ab", "c"]])).lookahead is None
    for name in FILES:
        assert 100 < bpe.Transducer(queries.tokenizer_path(name)).merges.lookahead < 2000


def test_words_hold_a_bounded_number_of_symbols():
    rng = random.Random(9)
    for _ in range(20):
        merges = proper_merges(rng, "abc", 12)
        found = bpe.Merges(model(merges, "#"))
        word = "".join(rng.choice("abc") for _ in range(6000))
        machine, out, most = bpe.WordTransducer(found), [], 0
        for at in range(0, len(word), 7):
            out += machine.push(word[at : at + 7])
            most = max(most, len(machine.held))
        assert most <= machine.room + 7 and out  # tokens came before the end
        assert out + machine.finish() == plain(merges, [*word[:-1], word[-1] + "#"])
        assert machine.finish() == [] and list(machine.push("ab")) == []


def test_decoder_keeps_parts_of_characters_and_marks_broken_ones():
    path = queries.tokenizer_path("byte_bpe_50k.json")
    machine = bpe.Transducer(path)
    ids = list(machine.encode("🎉 한"))
    decoder = bpe.Decoder(machine.tokens, True)
    said = [decoder.push(i) for i in ids]
    assert "".join(said) + decoder.finish() == "🎉 한" and "" in said
    assert decoder.push(ids[0]) == "" and decoder.finish() == "�" and decoder.push(10**6) == ""


def test_frames_round_trip_with_nulls_repeats_and_clashing_columns(spark):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    rows = [(1, "Hello, wörld 🎉", "i", "v"), (1, "Hello, wörld 🎉", "i", "v"), (None, None, None, None), (3, "", "", ""), (4, "x" * 200_000 + " end", "", "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _id string, _value string")
    ids = bpe.encode(frame, path)
    assert ids.columns == ["doc_id", "ids"] and sorted(len(r["ids"]) for r in ids.collect())[:2] == [0, 0]
    back = sorted(((r["doc_id"] or 0, r["text"]) for r in bpe.decode(ids, path).collect()))
    assert back == sorted((i or 0, t or "") for i, t, *_ in rows)
    odd = spark.createDataFrame([(1, [15496, None, 999_999]), (2, None)], "doc_id long, ids array<int>")
    assert [r["text"] for r in bpe.decode(odd, path).orderBy("doc_id").collect()] == ["Hello", ""]
    assert bpe.encode(frame.limit(0), path).count() == bpe.decode(ids.limit(0), path).count() == 0


def test_op12(spark):
    library = Tokenizer.from_file(queries.tokenizer_path())
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op12_bpe_transducer(spark, SF).collect()}
    want = {}
    for i, text in texts.items():
        ids = library.encode(text or "", add_special_tokens=False).ids
        said = library.decode(ids, skip_special_tokens=False)
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(said.encode()).hexdigest())
    assert got == want
