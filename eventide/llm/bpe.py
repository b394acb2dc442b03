"""BPE encoding and decoding with word ends, merges by a contiguous rank array.

A vocabulary file of the ``tokenizers`` format gives token ids, merge ranks, the
suffix of a word's last symbol, and the normaliser and splitter (these two run in the
library, so that Unicode tables agree, but for ``SETTLED`` characters).  Words are merged here:

* short words (up to ``SHORT`` symbols) hold the parts between their boundaries in one
  array (by token id) and the merge rank of every two adjacent parts in another; the smallest
  rank (leftmost of equals) is found by a scan, the boundary between its parts is
  deleted, and the ranks of the two neighbours are looked up anew.  Words that are
  new to a group of texts are merged side by side, each in its row of the two arrays;
* longer ones pop the smallest rank from a heap over linked parts, the
  same order in n log n steps.

Encoding is a map over documents without a shuffle; a task's texts are taken in
groups of about ``WINDOW`` characters.  Words (and, of text that goes through the library, whitespace-delimited chunks) are
kept in bounded caches of two generations (``CACHED``).  A text is read
in windows of ``WINDOW`` characters that end before ASCII white space, where
neither normalising nor splitting nor merging looks across.

Strings of added tokens (``<|endoftext|>``) inside a text become their ids,
as the library's ``encode`` does.  ``decode`` joins the vocabulary's
strings by one space, which is the library's rule for a file without decoder.

Edge cases: null and empty texts, and texts of white space only, have no tokens
and decode to the empty string; null ids decode to the empty string; ids that the
vocabulary doesn't hold are skipped; repeated rows each get a row; other columns are
ignored; an empty table gives an empty result.  Files with features not
handled here (dropout, byte fallback, another decoder, added tokens that strip or
need normalised text) are refused.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import as_bytes, texts

SHORT = 64
CACHED = 1 << 17  # entries of a generation of a cache, each of at most CHUNK characters
CHUNK = 64
WINDOW = 1 << 20
OUT_CHARS = 1 << 22  # characters of the texts in a batch of results, but for one long text
OUT_IDS = 1 << 20  # ids in a batch that is decoded
NEVER = np.iinfo(np.int32).max
GONE = -1
ROWS = 1 << 13  # words that are merged side by side


# Text of these characters is normalised and split here (Latin letters and general
# punctuation: all in composed form, their classes and lower cases are settled, no separator that
# str.lower() or the pattern would treat otherwise); any other text goes to the library.
LATIN = [chr(c) for c in range(0x180)]
SETTLED = re.compile("[\x00-\x1b\x20-\u017f\u2010-\u2027\u2030-\u205e]*")


def _class(kind: str) -> str:
    return "".join(re.escape(c) for c in LATIN if unicodedata.category(c).startswith(kind))


# Fixed value: the splitter's pattern, with the letters and numbers below U+0180 spelled out.
WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_class('L')}]+|[{_class('N')}]|[^\\s{_class('L')}{_class('N')}]+")
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
PROBE = "don't we'll 12 'tis x's!? a-b ''d \u00e9t\u00e9\u00b2\u00bd\u00ab\u00bb na\u00efve\u0142\u017f"


def byte_letters() -> list[str]:
    """The byte-level alphabet: printable Latin-1 characters stand for their own
    bytes, the other bytes follow from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]

# What str.split() takes for white space and the normaliser doesn't.
SEPARATORS = re.compile(r"[\x1c-\x1f]")


class Cache:
    """A bounded map: the younger generation takes what is used, and when it is
    full it becomes the older one, whose entries come back when used again."""

    def __init__(self) -> None:
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def found(self, keys: Iterable[str]) -> tuple[dict[str, bytes], list[str]]:
        """What is known of the keys, and the other ones."""
        young, old = self.young.get, self.old.get
        out, back, new = {}, [], []
        for k in keys:
            if (v := young(k)) is not None:
                out[k] = v
            elif (v := old(k)) is not None:
                out[k] = v
                back.append(k)
            else:
                new.append(k)
        self.put((k, out[k]) for k in back)
        return out, new

    def put(self, items: Iterable[tuple[str, bytes]]) -> None:
        for key, value in items:
            if len(key) <= CHUNK:
                if len(self.young) >= CACHED:
                    self.young, self.old = {}, self.young
                self.young[key] = value


class Pairs:
    """Merge ranks by pair of ids, looked up for whole arrays: an open-addressed table."""

    def __init__(self, ranks: dict[int, int]) -> None:
        self.bits = max(4, (2 * len(ranks)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NEVER, np.int32)
        keys = np.array(list(ranks), np.int64)
        values = np.array(list(ranks.values()), np.int32)
        at = self.slot(keys)
        while len(keys):
            free = self.keys[at] == -1
            first = np.zeros(len(keys), bool)
            first[np.unique(at, return_index=True)[1]] = True  # one key a slot
            put = free & first
            self.keys[at[put]], self.ranks[at[put]] = keys[put], values[put]
            keys, values, at = keys[~put], values[~put], (at[~put] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Rank of each key; ``NEVER`` for a pair that isn't merged."""
        at = self.slot(keys)
        out = self.ranks[at]
        held = self.keys[at]
        on = np.flatnonzero((held != keys) & (held != -1))  # another key's slot: look on
        out[(held != keys) & (held == -1)] = NEVER
        while len(on):
            at = (at[on] if len(at) == len(keys) else at) + 1 & ((1 << self.bits) - 1)
            held = self.keys[at]
            done = (held == keys[on]) | (held == -1)
            out[on[done]] = np.where(held[done] == -1, NEVER, self.ranks[at[done]])
            on, at = on[~done], at[~done]
        return out


class Codec:
    def __init__(self, raw: bytes) -> None:
        from tokenizers import Tokenizer
        spec = json.loads(raw)
        model = spec["model"]
        added = spec["added_tokens"]
        odd = [a["content"] for a in added
               if a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] or re.search(r"\s", a["content"])]
        if (model["type"] != "BPE" or model["dropout"] or model["byte_fallback"] or model["ignore_merges"]
                or model["continuing_subword_prefix"] or spec["decoder"] or spec["post_processor"] or odd):
            raise ValueError("vocabulary with a feature that isn't handled here")
        library = Tokenizer.from_str(raw.decode())
        self.normal = library.normalizer.normalize_str
        self.split = library.pre_tokenizer.pre_tokenize_str
        self.letters = byte_letters()
        # the library's normaliser and splitter must agree with the patterns used here
        ours = [self.spelled(w) for w in WORDS.findall(PROBE.lower())]
        self.settled = [w for w, _ in self.split(self.normal(PROBE))] == ours
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        # by pair of ids: the merge's rank; by rank: the id of what it makes
        self.bits = max(self.ids.values()).bit_length()
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for i, m in enumerate(model["merges"]):
            left, right = m if isinstance(m, list) else m.split(" ")
            self.ranks[self.ids[left] << self.bits | self.ids[right]] = i
            self.made.append(self.ids[left + right])
        self.special = {a["content"]: a["id"] for a in added}
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.pairs = Pairs(self.ranks)
        self.makes = np.array(self.made, np.int32)
        # by word, by word in the byte-level alphabet, by chunk without white space
        self.words, self.spellings, self.chunks = Cache(), Cache(), Cache()

    def spelled(self, word: str) -> str:
        """A word in the byte-level alphabet."""
        return word if word.isascii() and word.isprintable() else "".join(map(self.letters.__getitem__, word.encode()))

    def parts(self, word: str) -> list[int]:
        """Ids of a word's symbols, the last with the suffix; unknown ones are dropped."""
        get = self.ids.get
        ids = [*map(get, word[:-1]), get(word[-1] + self.suffix)]
        return [i for i in ids if i is not None] if None in ids else ids

    def merged(self, words: list[str]) -> list[bytes]:
        """Token ids (little-endian, four bytes each) of each word, spelled in
        the byte-level alphabet."""
        parts = [self.parts(w) for w in words]
        out = [b""] * len(words)
        short = []
        for k, p in enumerate(parts):
            if len(p) > SHORT:
                out[k] = np.array(self.merged_long(p), "<i4").tobytes()
            else:
                short.append(k)
        short.sort(key=lambda k: len(parts[k]))  # rows of like length
        for i in range(0, len(short), ROWS):
            some = short[i:i + ROWS]
            for k, ids in zip(some, self.merged_rows([parts[k] for k in some])):
                out[k] = ids
        return out

    def merged_rows(self, words: list[list[int]]) -> list[bytes]:
        """Short words side by side: a row of ``parts`` and of ``ranks`` each."""
        n, width = len(words), max(map(len, words), default=0)
        size = np.array([len(w) for w in words])
        parts = np.full((n, width + 1), GONE, np.int64)
        parts[np.arange(width + 1) < size[:, None]] = [x for w in words for x in w]
        rows = np.arange(n)

        def rank(r: np.ndarray, i: np.ndarray) -> np.ndarray:
            """Ranks of parts i and i + 1 of rows r; NEVER past a row's end."""
            a, b = parts[r, i], parts[r, i + 1]
            return np.where((a >= 0) & (b >= 0), self.pairs.find(np.maximum(a, 0) << self.bits | np.maximum(b, 0)), NEVER)

        ranks = np.full((n, width + 1), NEVER, np.int32)
        where = np.flatnonzero((np.arange(width + 1) < size[:, None] - 1).ravel())
        ranks.ravel()[where] = rank(where // (width + 1), where % (width + 1))
        cols = np.arange(width + 1)
        while len(rows):
            i = ranks[rows].argmin(axis=1)  # the leftmost of the smallest
            least = ranks[rows, i]
            rows, i, least = rows[least < NEVER], i[least < NEVER], least[least < NEVER]
            if not len(rows):
                break
            parts[rows, i] = self.makes[least]
            # delete boundary i + 1: what stands behind moves up
            behind = np.minimum(cols + (cols > i[:, None]), width)
            moved = np.take_along_axis(parts[rows], behind, 1)
            moved[:, width] = GONE
            parts[rows] = moved
            behind = np.minimum(cols + (cols >= i[:, None]), width)
            moved = np.take_along_axis(ranks[rows], behind, 1)
            moved[:, width] = NEVER
            ranks[rows] = moved
            ranks[rows, i] = rank(rows, np.minimum(i, width - 1))
            left = i > 0
            ranks[rows[left], i[left] - 1] = rank(rows[left], i[left] - 1)
        ids = parts[parts != GONE].astype("<i4").tobytes()
        ends = (4 * np.cumsum((parts != GONE).sum(axis=1))).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def merged_long(self, parts: list[int]) -> list[int]:
        n = len(parts)
        after = list(range(1, n + 1))  # place of the part after this one
        before = list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (r := self.ranks.get(parts[i] << self.bits | parts[j])) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right:
                continue  # one of the parts has been merged since
            parts[i], parts[j] = self.made[r], GONE
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p != GONE]

    def ids_of_words(self, words: set[str]) -> dict[str, bytes]:
        """Token ids of lower-case words; those that the cache lacks are merged together."""
        out, new = self.words.found(words)
        merged = dict(zip(new, self.merged([*map(self.spelled, new)])))
        self.words.put(merged.items())
        return out | merged

    def ids_of_chunks(self, chunks: set[str]) -> dict[str, bytes]:
        """Token ids of text without white space, by the library's normaliser and splitter."""
        out, new = self.chunks.found(chunks)
        split = [[w for w, _ in self.split(self.normal(c))] for c in new]
        words, unknown = self.spellings.found({w for ws in split for w in ws})
        merged = dict(zip(unknown, self.merged(unknown)))
        self.spellings.put(merged.items())
        words |= merged
        own = {c: b"".join(map(words.__getitem__, ws)) for c, ws in zip(new, split)}
        self.chunks.put(own.items())
        return out | own

    def segments(self, text: str) -> Iterator[tuple[str, list[str]] | int]:
        """Ids of added tokens, and the words or chunks of the text between them."""
        at = 0
        for m in self.specials.finditer(text):
            yield from self.plain(text[at:m.start()])
            yield self.special[m[0]]
            at = m.end()
        yield from self.plain(text[at:] if at else text)

    def plain(self, text: str) -> Iterator[tuple[str, list[str]]]:
        for window in windows(text):
            if self.settled and window.isascii() and not SEPARATORS.search(window):
                yield "words", ASCII_WORDS.findall(window.lower())
            elif self.settled and SETTLED.fullmatch(window):
                yield "words", WORDS.findall(window.lower())
            else:  # nothing is normalised, split or merged across white space
                yield "chunks", [c for c in self.normal(window).split(" ") if c] if SEPARATORS.search(window) else window.split()

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """Token ids of each text, four bytes each."""
        out: list[list[bytes]] = []
        held: list[tuple[list[bytes], tuple[str, list[str]] | int]] = []
        size = 0

        def flush() -> None:
            every = {kind: set().union(*(p[1] for _, p in held if not isinstance(p, int) and p[0] == kind)) for kind in ("words", "chunks")}
            ids = {"words": self.ids_of_words(every["words"]), "chunks": self.ids_of_chunks(every["chunks"])}
            for to, part in held:
                to.append(part.to_bytes(4, "little") if isinstance(part, int) else b"".join(map(ids[part[0]].__getitem__, part[1])))

        for text in texts:
            out.append(to := [])
            for part in self.segments(text):
                held.append((to, part))
                size += 1 if isinstance(part, int) else 8 * len(part[1])
                if size >= WINDOW:
                    flush()
                    held, size = [], 0
        flush()
        return [b"".join(x) for x in out]

    def decode(self, ids: list[int]) -> str:
        try:
            return " ".join(map(self.tokens.__getitem__, ids))
        except KeyError:
            return " ".join(t for i in ids if (t := self.tokens.get(i)) is not None)


def windows(text: str) -> Iterator[str]:
    """Parts of about ``WINDOW`` characters that end before ASCII white space."""
    if len(text) <= WINDOW:
        yield text
        return
    space = re.compile(r"[\x20\t\n\r]")
    at = 0
    while at < len(text):
        m = space.search(text, at + WINDOW)
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end


@lru_cache(maxsize=2)
def codec(raw: bytes) -> Codec:
    """A worker builds its tables once."""
    return Codec(raw)


def vocabulary(docs: DataFrame, path: str):
    """The file, read by the driver and broadcast (a few MB): executors need no
    copy of it."""
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def id_lists(name: str, keys: list, lists: list[bytes], kind: pa.DataType) -> pa.RecordBatch:
    offsets = np.zeros(len(lists) + 1, np.int32)
    np.cumsum([len(x) // 4 for x in lists], out=offsets[1:])
    values = np.frombuffer(b"".join(lists), "<i4")
    return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.ListArray.from_arrays(offsets, values)], names=["doc_id", name])


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids array<int>)``, one row per row of ``docs``."""
    body = as_bytes(texts(docs, id_col, text_col))
    raw = vocabulary(docs, path)

    def run(batches):
        c = codec(raw.value)
        for batch in batches:
            kind, texts_, keys, held = batch.schema.field(0).type, [], [], 0
            for key, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                texts_.append(x.as_buffer().to_pybytes().decode("utf-8", "replace") if x.is_valid else "")
                keys.append(key)
                held += len(texts_[-1])
                if held >= OUT_CHARS:
                    yield id_lists("ids", keys, c.encode(texts_), kind)
                    texts_, keys, held = [], [], 0
            yield id_lists("ids", keys, c.encode(texts_), kind)

    return body.mapInArrow(run, f"doc_id {dict(body.dtypes)['doc_id']}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids, decoded)`` of a table with ``doc_id`` and ``ids``."""
    rows = encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids"))
    raw = vocabulary(encoded, path)

    def run(batches):
        c = codec(raw.value)
        for batch in batches:
            step = max(1, batch.num_rows // (1 + batch.nbytes // (4 * OUT_IDS)))
            for part in (batch.slice(i, step) for i in range(0, batch.num_rows, step)):
                decoded = pa.array([c.decode(x.values.to_numpy().tolist()) if x.is_valid else "" for x in part.column(1)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), decoded], names=["doc_id", "ids", "decoded"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, ids array<int>, decoded string")


def report(decoded: DataFrame) -> DataFrame:
    """Counts and digests of ids and decoded texts."""
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
