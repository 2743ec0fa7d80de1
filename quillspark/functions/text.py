"""Text expressions: folding, tokens, sentences, chunks, shingles and excerpts, all in Catalyst but the
places of matches."""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..workspace import ship

TOKEN = r"([\p{L}\p{N}\p{Co}]+)"
#: Korean particles and endings, in the order in which they are tried.
KOREAN_SUFFIXES = (
    "으로부터", "이라고", "에서는", "에게서", "이라는", "으로써", "으로서",
    "에서의", "에게는", "부터", "까지", "에서", "에게", "이나", "라도",
    "처럼", "보다", "조차", "마저", "으로", "이랑", "하는", "합니다",
    "했다", "하고", "하여", "해서", "이다", "이며",
    "은", "는", "이", "가", "을", "를", "의", "에", "와", "과",
    "도", "만", "로", "랑", "한", "할", "함", "됨", "된",
)


def _folds() -> tuple[str, str]:
    """Lower-case Latin letters with one mark, and their bases; letters with two marks don't fold."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) == 2 and unicodedata.combining(parts[1]) and chr(code).islower():
            pairs.append((chr(code), parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


MARKED, BASES = _folds()


def let(value: Column, use) -> Column:
    """use(value) with the value evaluated once a row, also where a lambda uses it for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fold(text: Column) -> Column:
    return F.translate(F.lower(text), MARKED, BASES)


def tokens(text: Column) -> Column:
    """Folded runs of letters and numbers, in order. Null: null."""
    return F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(1))


#: What (?U)\s matches: the characters with Unicode's White_Space property.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def strip_end(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITE))


def split_terms(query: str) -> list[str]:
    return query.split()


def stem(term: str) -> str | None:
    """The term without the first listed ending it has, if two characters or more are left."""
    for suffix in KOREAN_SUFFIXES:
        if term.endswith(suffix) and len(term) > len(suffix):
            rest = term[: -len(suffix)]
            return rest if len(rest) >= 2 else None
    return None


def term_variants(query: str) -> list[tuple[str, ...]]:
    """Of each term, in order and with repeats: itself and, if it has one, its stem."""
    return [(t, s) if (s := stem(t)) else (t,) for t in split_terms(query)]


def stem_column(term: Column) -> Column:
    """``stem`` of a column, as one CASE over the endings."""
    out = F.lit(None).cast("string")
    for suffix in reversed(KOREAN_SUFFIXES):
        rest = F.substring(term, F.lit(1), F.length(term) - len(suffix))
        hit = term.endswith(suffix) & (F.length(term) > len(suffix))
        out = F.when(hit, F.when(F.length(rest) >= 2, rest)).otherwise(out)
    return out


_END = r"""[.!?]+(?!\d)["')\]】」』]*\s*|\n+"""
#: A sentence: one character and what follows up to marks that no digit follows, with closing quotes and
#: spaces; or to a line's end; or the rest. Runs without marks are taken whole, and nothing is tried twice.
SENTENCE = rf"(?s)(.[^.!?\n]*+(?:(?!{_END})[.!?\n][^.!?\n]*+)*+(?:{_END}|\z))"


def sentence_pieces(text: Column) -> Column:
    """Sentences with the separator that joins them to the next: a newline if one was there, else a space."""
    raw = F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(1))
    pieces = F.transform(raw, lambda p: F.concat(strip(p), F.when(p.contains("\n"), "\n").otherwise(" ")))
    return F.filter(pieces, lambda p: F.length(p) > 1)


def sentences(text: Column) -> Column:
    raw = F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(1))
    return F.filter(F.transform(raw, strip), lambda p: p != "")


def chunk_text(text: Column, max_chars: int = 300, measure=None) -> Column:
    """Sentences packed greedily into chunks of at most ``max_chars``; a longer sentence is a chunk of its
    own. A text without sentences is one chunk as it is.

    measure: a text column's size, its characters if not given; ``count_tokens`` bounds chunks by tokens.
    Chunks gather in blocks, so that a long text's are not copied for each more.
    """
    size = measure or F.length
    none, block = F.array().cast("array<string>"), 64
    empty = F.struct(F.array().cast("array<array<string>>").alias("full"), none.alias("done"), F.lit("").alias("cur"))

    def step(state, piece):
        fits = (state["cur"] == "") | (size(strip_end(F.concat(state["cur"], piece))) <= max_chars)
        ends = F.size(state["done"]) >= block
        done = F.concat(F.when(ends, none).otherwise(state["done"]), F.array(strip_end(state["cur"])))
        return F.when(fits, F.struct(state["full"].alias("full"), state["done"].alias("done"), F.concat(state["cur"], piece).alias("cur"))).otherwise(F.struct(
            F.when(ends, F.concat(state["full"], F.array(state["done"]))).otherwise(state["full"]).alias("full"), done.alias("done"), piece.alias("cur")))

    def finish(state):
        last = F.when(state["cur"] == "", none).otherwise(F.array(strip_end(state["cur"])))
        return F.concat(F.flatten(state["full"]), state["done"], last)

    found = F.aggregate(sentence_pieces(text), empty, step, finish)
    return let(found, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(text)))


def count_tokens(text: Column) -> Column:
    """Tokens of a text by the index's rule: there is no model whose tokenizer could count them."""
    return F.size(tokens(text))


def normalized(text: Column) -> Column:
    """For overlap: no white space, no characters but letters, digits and underscores."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", ""), r"(?U)[^\w]+", "")


def shingles(text: Column, n: int = 2) -> Column:
    """The set of n-character runs of the normalized text; a shorter text is its only run."""

    def of(t: Column) -> Column:  # an array of characters: places in a string are found by counting
        runs = F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, F.lit(n)), ""))
        whole = F.array(F.array_join(t, ""))
        return F.when(F.size(t) == 0, F.array().cast("array<string>")).when(F.size(t) < n, whole).otherwise(F.array_distinct(runs))

    return let(F.filter(F.split(normalized(text), ""), lambda c: c != ""), of)


def run_set(text: str, n: int) -> set[str]:
    """``shingles`` of a text that is normalized."""
    return {text[i : i + n] for i in range(len(text) - n + 1)} if len(text) >= n else {text} - {""}


def shingle_count(text: Column, n: int = 2) -> Column:
    """How many ``shingles`` a text has, as a long, on Arrow batches in Python: Catalyst would make an array of
    each character. Null: null."""
    ship(SparkSession.active())

    @F.arrow_udf("long")
    def count(values: pa.Array) -> pa.Array:
        return pa.array([None if x is None else len(run_set(x, n)) for x in (v.as_py() for v in values)], pa.int64())

    return count(normalized(text))


def overlaps(said: Column, evidence: Column, n: int = 2) -> Column:
    """``overlap_ratio`` of each text of an array, as an array. The evidence's runs are made once a row, on Arrow
    batches in Python; in Catalyst each text's meeting with them would go through all of them again."""
    ship(SparkSession.active())

    def of(texts: list[str | None] | None, whole: str | None) -> list[float | None] | None:
        if texts is None:
            return None
        found = None if whole is None else run_set(whole, n)
        return [None if t is None else 1.0 if not t else None if found is None else share(run_set(t, n), found) for t in texts]

    def share(a: set[str], b: set[str]) -> float:
        return len(a & b) / len(a)

    @F.arrow_udf("array<double>")
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([of(a.as_py(), b.as_py()) for a, b in zip(left, right)], pa.list_(pa.float64()))

    return run(F.transform(said, normalized), normalized(evidence))


def overlap_ratio(sentence: Column, evidence: Column) -> Column:
    """Share of the sentence's runs that the evidence has; empty sentence 1, empty evidence 0."""
    return ratio(shingles(sentence), shingles(evidence))


def ratio(said: Column, evidence: Column) -> Column:
    """``overlap_ratio`` of two sets of runs."""

    def of(p: Column) -> Column:
        a, b = p["a"], p["b"]
        return F.when(F.size(a) == 0, 1.0).when(F.size(b) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))

    return let(F.struct(said.alias("a"), evidence.alias("b")), of)


def excerpt(text: Column, term: str, window: int = 140) -> Column:
    """A window around the first match, spaces collapsed, with marks where text was cut off."""
    return let(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), lambda flat: _window(flat, term, window))


def _window(flat: Column, term: str, window: int) -> Column:
    at = F.greatest(F.locate(term.lower(), F.lower(flat)) - 1, F.lit(0))
    middle = at + F.lit(len(term) // 2)
    start = F.greatest(F.least(middle - window // 2, F.length(flat) - window), F.lit(0))
    body = F.substring(flat, (start + 1).cast("int"), F.lit(window))
    return F.concat(F.when(start > 0, "…").otherwise(""), body, F.when(start + window < F.length(flat), "…").otherwise(""))


def merged_spans(text: str, terms: list[str], exact_word: bool) -> list[list[int]]:
    found = []
    for term in terms:
        if term.strip():
            pattern = rf"\b{re.escape(term)}\b" if exact_word else re.escape(term)
            found += [m.span() for m in re.finditer(pattern, text, re.IGNORECASE)]
    merged: list[list[int]] = []
    for begin, end in sorted(found):
        if merged and begin <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([begin, end])
    return merged


def highlight_spans(text: Column, terms: list[str], exact_word: bool = False) -> Column:
    """Merged [begin, end) spans of the terms' matches, case ignored; touching spans are one. Null: none.

    A term's matches don't overlap each other. exact_word: only between word borders. One search a term
    and one merge, on Arrow batches in Python: Catalyst has no places of matches, and arrays that grow
    are copied."""
    ship(SparkSession.active())

    @F.arrow_udf("array<struct<b:int,e:int>>")
    def spans(values: pa.Array) -> pa.Array:
        found, ends = [], [0]  # numbers alone: one text's spans are objects at a time
        for x in values:
            found.append(np.array(merged_spans(x.as_py() or "", terms, exact_word), np.int32).reshape(-1, 2))
            ends.append(ends[-1] + len(found[-1]))
        flat = np.concatenate([np.empty((0, 2), np.int32), *found])
        both = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["b", "e"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), both)

    return spans(F.coalesce(text, F.lit("")))


#: Characters that markup needs written otherwise, the one that the others hold first.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))


def escape(text: Column) -> Column:
    for raw, safe in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def marked_up(text: str, terms: list[str], exact_word: bool, tag: str) -> str:
    out, at = [], 0
    for b, e in merged_spans(text, terms, exact_word):
        out += [html.escape(text[at:b]), f"<{tag}>", html.escape(text[b:e]), f"</{tag}>"]
        at = e
    return "".join([*out, html.escape(text[at:])])


def rich_text(text: Column, terms: list[str], exact_word: bool = False, tag: str = "b") -> Column:
    """The text as markup, the terms' matches in a tag, all else escaped once. Null: empty."""
    ship(SparkSession.active())

    @F.pandas_udf("string")
    def rich(values: pd.Series) -> pd.Series:
        return values.map(lambda x: marked_up(x, terms, exact_word, tag))

    return rich(F.coalesce(text, F.lit("")))


def rich_excerpt(text: Column, term: str, window: int = 140) -> Column:
    return rich_text(excerpt(text, term, window), [term])


def clean_heading(text: Column, limit: int = 40) -> Column:
    t = strip(text)
    return F.when(F.length(t).between(1, limit), t).otherwise("")


def safe_name(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9_-]", "_")


def needles(text: Column, sizes: tuple[int, ...] = (180, 90, 40, 20)) -> Column:
    """Of each paragraph: itself cut to falling sizes, the longest first, each once."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda p: p != "")
    cuts = F.transform(lines, lambda p: F.filter(
        F.concat(F.array(F.when(F.length(p) <= sizes[0], p)), *[F.array(F.when(F.length(p) > s, F.substring(p, F.lit(1), F.lit(s)))) for s in sizes]),
        lambda x: x.isNotNull()))
    return F.array_distinct(F.flatten(cuts))


def uuid5(namespace_hex: str, name: Column) -> Column:
    """Version 5 UUID as 32 hex digits: SHA-1 of namespace and name with version and variant bits."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), name.cast("binary")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat(F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3), variant, F.substring(h, 18, 15))


def relative_time(then: Column, now: Column) -> Column:
    s = F.unix_timestamp(now) - F.unix_timestamp(then)
    return (
        F.when(s < 60, "now").when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit(" min")))
        .when(s < 86400, F.concat(F.floor(s / 3600).cast("string"), F.lit(" h")))
        .when(s < 7 * 86400, F.concat(F.floor(s / 86400).cast("string"), F.lit(" d"))).otherwise(F.date_format(then, "yyyy-MM-dd"))
    )


def image_kind(content: Column) -> Column:
    """File kind by signature: png gif jpg bmp tif wmf emf webp; null for none of them."""
    h = F.hex(F.substring(content, 1, 48))
    head = lambda x: h.startswith(x)
    return (
        F.when(head("89504E470D0A1A0A"), "png").when(head("474946383761") | head("474946383961"), "gif").when(head("FFD8FF"), "jpg")
        .when(head("424D"), "bmp").when(head("49492A00") | head("4D4D002A"), "tif").when(head("D7CDC69A"), "wmf")
        .when(F.substring(h, 81, 8) == "20454D46", "emf").when(head("52494646") & (F.substring(h, 17, 8) == "57454250"), "webp")
    )
