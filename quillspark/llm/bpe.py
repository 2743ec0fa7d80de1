"""BPE as streaming transducers: bytes to token ids with a bounded lookahead, ids to text by a state machine.

Merges are applied by rank. Let the rules be (u, v), each token made by one rule and after its parts.
Then what follows a known beginning of a word can change its tokens only by a chain of rules of rising
ranks that walks to the left: the first takes the last token u with something unknown, each other takes
a token v that begins with the u of the one before it. The chain's u's add up to how far the change
reaches, and the largest such sum over all chains is the merge list's sufficient lookahead: tokens that
end so far before the known end are final. What follows a token's end is encoded as if it began there.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import os
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import ship
from .packing import OTHER, PLAIN, WORD, byte_letters

#: Characters of a text that are normalized and cut into words at a time.
WINDOW = 1 << 16
#: Symbols that a word's transducer takes beyond its lookahead and the longest token.
BLOCK = 512
#: Words of up to so many symbols are merged without a heap.
SHORT = 48


class Merges:
    """A merge list of a tokenizer file: ranks, ids, and its sufficient lookahead (None: no bound is known,
    since a token has several rules or comes before its parts)."""

    def __init__(self, model: dict) -> None:
        pairs = [tuple(x) if not isinstance(x, str) else tuple(x.split(" ")) for x in model["merges"]]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.ranks = {pair: i for i, pair in enumerate(pairs)}
        self.longest = max((self.size(x) for x in self.ids), default=1)
        self.lookahead = self._lookahead(pairs)

    def bare(self, token: str) -> str:
        return token[: -len(self.suffix)] if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix) else token

    def size(self, token: str) -> int:
        """Symbols of a token."""
        return len(self.bare(token))

    def _lookahead(self, pairs: list[tuple[str, str]]) -> int | None:
        made: set[str] = set()
        reach: dict[str, int] = {}
        most = 0
        for u, v in pairs:
            if u + v in made or any(self.size(x) > 1 and x not in made for x in (u, v)):
                return None
            made.add(u + v)
            bare = self.bare(v)
            # a word's end is no beginning of a longer token
            starts = len(bare) - (bare != v)
            far = len(u) + max((reach.get(v[:k], 0) for k in range(1, starts + 1)), default=0)
            reach[u] = max(reach.get(u, 0), far)
            most = max(most, far)
        return most

    def merge(self, symbols: list[str]) -> list[str]:
        """The tokens of symbols: the pair of the lowest rank first, of equals the leftmost."""
        if len(symbols) > SHORT:
            return self._merge_long(symbols)
        rank, none = self.ranks.get, len(self.ranks)
        line = [rank(p, none) for p in zip(symbols, symbols[1:])]
        while line and (best := min(line)) < none:
            at = line.index(best)
            symbols[at] += symbols.pop(at + 1)
            del line[at]
            if at:
                line[at - 1] = rank((symbols[at - 1], symbols[at]), none)
            if at < len(line):
                line[at] = rank((symbols[at], symbols[at + 1]), none)
        return symbols

    def _merge_long(self, symbols: list[str]) -> list[str]:
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        parts: list[str | None] = list(symbols)
        heap = [(r, i, p) for i, p in enumerate(zip(symbols, symbols[1:])) if (r := self.ranks.get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if parts[i] != pair[0] or j >= len(parts) or parts[j] != pair[1]:
                continue
            parts[i], parts[j] = pair[0] + pair[1], None
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < len(parts) and (rank := self.ranks.get(found := (parts[k], parts[after[k]]))) is not None:
                    heapq.heappush(heap, (rank, k, found))
        return [x for x in parts if x is not None]


class WordTransducer:
    """A word's symbols in, its tokens out as soon as nothing that follows can change them.

    At most lookahead + longest token + BLOCK symbols are held; without a known lookahead the word is."""

    def __init__(self, merges: Merges) -> None:
        self.merges = merges
        self.held: list[str] = []
        self.room = None if merges.lookahead is None else merges.lookahead + merges.longest + BLOCK

    def push(self, letters: str) -> Iterator[str]:
        """Takes more of the word. The last letter is kept back: it may be the word's end."""
        for at in range(0, len(letters), BLOCK):
            self.held.extend(letters[at : at + BLOCK])
            if self.room is not None and len(self.held) > self.room:
                known = self.held[:-1]
                done, end = 0, len(known) - self.merges.lookahead
                for token in self.merges.merge(known.copy()):
                    if done + len(token) > end:
                        break
                    done += len(token)
                    yield token
                del self.held[:done]

    def finish(self) -> list[str]:
        """The rest of the word's tokens; the transducer then takes the next word."""
        held, self.held = self.held, []
        if held:
            held[-1] += self.merges.suffix
        return self.merges.merge(held)


class Decoder:
    """Ids to text, one id at a time.

    A tokenizer file with the byte-level decoder: bytes wait until a character is whole, bytes that are
    none become U+FFFD. One without a decoder: token strings with a space between. Unknown ids: nothing."""

    def __init__(self, tokens: dict[int, str], byte_level: bool) -> None:
        self.tokens, self.byte_level = tokens, byte_level
        self.bytes = {c: bytes([b]) for b, c in byte_letters().items()}
        self.text = codecs.getincrementaldecoder("utf-8")("replace")
        self.begun = False

    def push(self, i: int) -> str:
        token = self.tokens.get(i)
        if token is None:
            return ""
        if self.byte_level:
            known = all(c in self.bytes for c in token)
            return self.text.decode(b"".join(self.bytes[c] for c in token) if known else token.encode())
        out, self.begun = (" " if self.begun else "") + token, True
        return out

    def finish(self) -> str:
        self.begun = False
        return self.text.decode(b"", True) if self.byte_level else ""


class Transducer:
    """A tokenizer file's encoding of whole texts, without its special ids added, as a stream of ids.

    A text is taken in windows that end at white space; what a window's runs between spaces give is
    remembered (two generations of at most ``limit`` runs, none longer than ``longest_run`` characters)."""

    def __init__(self, path: str, limit: int = 150_000, longest_run: int = 64) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        self.library = Tokenizer.from_file(path)  # its normalizer and its cutting into words
        self.merges = Merges(described["model"])
        self.word = WordTransducer(self.merges)
        self.tokens = {i: x for x, i in self.library.get_vocab().items()}
        self.byte_level = (described.get("decoder") or {}).get("type") == "ByteLevel"
        self.added = {x["content"]: x["id"] for x in described["added_tokens"]}
        self.cut_added = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        # lower-case words without their spaces can be cut here as long as characters are plain
        self.lower = '"Lowercase"' in json.dumps(described["normalizer"]) and '"invert": true' in json.dumps(described["pre_tokenizer"])
        self.letters = byte_letters()
        self.young: dict[str, tuple[int, str, str]] = {}
        self.old: dict[str, tuple[int, str, str]] = {}
        self.limit, self.longest_run = limit, longest_run

    def word_ids(self, letters: str) -> Iterator[int]:
        ids = self.merges.ids
        for token in self.word.push(letters):
            yield ids[token]
        for token in self.word.finish():
            yield ids[token]

    def windows(self, text: str) -> Iterator[str]:
        """Parts of a text that end before white space, so that no character or word reaches over their ends."""
        at = 0
        while at < len(text):
            end = at + WINDOW
            if end < len(text):
                while end < len(text) and text[end] not in " \n\t\r":
                    end += 1
            yield text[at:end]
            at = end

    def pieces(self, window: str) -> Iterator[str | int]:
        """What a window holds in order: added tokens as ids, other parts as they are."""
        if self.cut_added is None or not any(x in window for x in self.added):
            yield window
            return
        for part in self.cut_added.split(window):
            if part:
                yield self.added.get(part, part)

    def encode(self, text: str) -> Iterator[int]:
        """The ids of a text, as they become known."""
        for window in self.windows(text):
            for part in self.pieces(window):
                if isinstance(part, int):
                    yield part
                    continue
                for words in self._words(part):
                    for w in words:
                        yield from self.word_ids(w)

    def _plain(self, part: str) -> str | None:
        """The part with its characters normalized and in lower case, if cutting it here is cutting it as the
        tokenizer does."""
        if not self.lower:
            return None
        try:
            plain, said = not part.encode("latin-1").translate(None, PLAIN), part
        except UnicodeEncodeError:
            plain = not OTHER.search(said := unicodedata.normalize("NFC", part))
        return said.lower() if plain else None

    def _run_words(self, run: str) -> list[str]:
        words = [run] if run.isalpha() else WORD.findall(run)
        return [w if w.isascii() else w.encode().decode("latin-1").translate(self.letters) for w in words]

    def _words(self, part: str) -> Iterator[list[str]]:
        plain = self._plain(part)
        if plain is not None:
            for run in plain.split():
                yield self._run_words(run)
        else:
            normal = self.library.normalizer.normalize_str(part) if self.library.normalizer else part
            yield [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def _said(self, words: list[str]) -> tuple[int, str, str]:
        """(number of ids, ids as text, their tokens as text) of short words."""
        if len(words) != 1:
            return self._joined([self.young.get(w) or self._keep(w, self._said([w])) for w in words]) if words else (0, "", "")
        ids = [*self.word_ids(words[0])]
        return len(ids), " ".join(map(str, ids)), " ".join([self.tokens[i] for i in ids])

    def _keep(self, run: str, found: tuple[int, str, str]) -> tuple[int, str, str]:
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        self.young[run] = found
        return found

    def digests(self, text: str) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the ids as decimals with spaces between, SHA-256 of the decoded text)."""
        n, ids, said = 0, hashlib.sha256(), hashlib.sha256()
        if self.byte_level:
            decoder = Decoder(self.tokens, True)
            for i in self.encode(text):
                ids.update(f"{' ' if n else ''}{i}".encode())
                said.update(decoder.push(i).encode())
                n += 1
            said.update(decoder.finish().encode())
            return n, ids.hexdigest(), said.hexdigest()
        for window in self.windows(text):
            for part in self.pieces(window):
                for m, a, b in self._remembered(part):
                    if m:
                        ids.update(f"{' ' if n else ''}{a}".encode())
                        said.update(f"{' ' if n else ''}{b}".encode())
                        n += m
        return n, ids.hexdigest(), said.hexdigest()

    def _remembered(self, part: str | int) -> Iterator[tuple[int, str, str]]:
        if isinstance(part, int):
            yield 1, str(part), self.tokens[part]
            return
        plain = self._plain(part)
        if plain is None:
            for words in self._words(part):
                for w in words:
                    yield from self._long(w) if len(w) > self.longest_run else [self._said([w])]
            return
        gathered: list[tuple[int, str, str]] = []
        for run in plain.split():
            found = self.young.get(run)
            if found is None:
                if len(run) > self.longest_run:
                    if gathered:
                        yield self._joined(gathered)
                        gathered = []
                    for w in self._run_words(run):
                        yield from self._long(w)
                    continue
                found = self._keep(run, self.old.get(run) or self._said(self._run_words(run)))
            gathered.append(found)
        if gathered:
            yield self._joined(gathered)

    @staticmethod
    def _joined(found: list[tuple[int, str, str]]) -> tuple[int, str, str]:
        n, a, b = zip(*found)
        return sum(n), " ".join(a), " ".join(b)

    def _long(self, word: str) -> Iterator[tuple[int, str, str]]:
        for i in self.word_ids(word):
            yield 1, str(i), self.tokens[i]


#: What a Python worker has learned of runs, kept for its later tasks.
_SHARED: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    if path not in _SHARED:
        _SHARED[path] = Transducer(path)
    return _SHARED[path]


def mapped(docs: DataFrame, path: str, id_col: str, text_col: str, fields: list[tuple[str, pa.DataType, str]], row) -> DataFrame:
    """A row per document: its id and ``fields`` of ``row(transducer, value)``. Nothing is shuffled."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_value"))

    def run(batches):
        machine = transducer(path)
        for batch in batches:
            columns: list[list] = [[] for _ in fields]
            keys, size = [], 0
            for key, value in zip(batch.column(0), batch.column(1)):
                found = row(machine, value.as_py())
                keys.append(key)
                for column, x in zip(columns, found):
                    column.append(x)
                size += sum(len(x) for x in found if isinstance(x, (list, str)))
                if size > 4_000_000:
                    yield batch_of(batch.schema.types[0], keys, columns)
                    keys, columns, size = [], [[] for _ in fields], 0
            yield batch_of(batch.schema.types[0], keys, columns)

    def batch_of(kind, keys, columns):
        arrays = [pa.array([x.as_py() for x in keys], kind), *[pa.array(c, t) for c, (_, t, _) in zip(columns, fields)]]
        return pa.record_batch(arrays, names=["_id", *[name for name, _, _ in fields]])

    schema = ", ".join([f"_id {rows.schema[0].dataType.simpleString()}", *[f"{name} {kind}" for name, _, kind in fields]])
    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>): each whole text's ids, as the tokenizer's without special ids added.

    A null or empty text has no ids. Rows that repeat are documents of their own, a null id stays null,
    an empty table gives an empty one, other columns are ignored."""
    return mapped(docs, tokenizer_path, id_col, text_col, [("ids", pa.list_(pa.int32()), "array<int>")], lambda m, x: ([*m.encode(x or "")],))


def decode(rows: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, text): ids back to text, special ids too, as the tokenizer's decoder writes it. Null ids and
    none: the empty text; null elements and ids that the vocabulary lacks are left out."""

    def text(machine: Transducer, ids: list[int] | None) -> tuple[str]:
        decoder = Decoder(machine.tokens, machine.byte_level)
        return ("".join([*[decoder.push(i) for i in ids or []], decoder.finish()]),)

    return mapped(rows, tokenizer_path, id_col, ids_col, [("text", pa.string(), "string")], text)


def digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) of each whole text, by the same transducers; a text's ids
    and what they decode to are never held at once. For the cases see ``encode``."""
    fields = [("n_tokens", pa.int64(), "long"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")]
    return mapped(docs, tokenizer_path, id_col, text_col, fields, lambda m, x: m.digests(x or ""))
