"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A window is ``window`` consecutive words of a test item (an item of fewer
words, but not none, is one window).  The alphabet of the search is words:

* the **shift table** holds, for each block of two words that occurs in a
  window, how far the block's last place is from the window's end; any other
  block lets the search jump ``length - 1`` words;
* where the shift is zero, the **suffix bucket** (hash of the last four words)
  selects the windows that may end there;
* **direct comparison** of all words confirms an occurrence.

The search is a map over documents: no text is shuffled.  Windows are held in
blocks of at most ``block_windows``; a longer benchmark is searched block by
block (each block is a stated query set against all rows) and the blocks'
hits are joined by document.

Edge cases: null and empty texts have no words, so no hit, ``n_items`` 0 and the
digest of the empty string; null item texts and items without words
have no window; a null ``item_id`` is skipped (it cannot be named); equal
windows of several items count for all of them; repeated document rows each
get a row; an empty benchmark hits nothing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import PLAIN_WORDS, as_bytes, fresh, quoted, saved, text_hash, texts

WINDOW = 10
# Windows compiled into one search; 200,000 take about 100 MB in a worker.
BLOCK_WINDOWS = 200_000
# A text is split into words in pieces of so many bytes.
PIECE = 1 << 20

HITS = "doc_id {id}, h long, n_words long, spans array<struct<a:long,b:long>>, items array<{item}>"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(PLAIN_WORDS).split() if text else []


def windows_of(words: list[bytes], window: int) -> list[tuple[bytes, ...]]:
    if len(words) <= window:
        return [tuple(words)] if words else []
    return [tuple(words[i:i + window]) for i in range(len(words) - window + 1)]


class Search:
    """Wu-Manber tables for windows that all have ``length`` words."""

    def __init__(self, length: int, windows: dict[tuple[bytes, ...], list[int]]):
        self.length, self.block, self.suffix = length, min(2, length), min(4, length)
        self.jump = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], list[tuple[list[bytes], list[int]]]] = {}
        for w, owners in windows.items():
            for end in range(self.block, length + 1):
                key = w[end - self.block:end]
                self.shift[key] = min(self.shift.get(key, self.jump), length - end)
            self.buckets.setdefault(w[-self.suffix:], []).append((list(w), owners))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """Ends (exclusive) of occurrences and the items they belong to."""
        length, block, suffix, jump = self.length, self.block, self.suffix, self.jump
        shift, bucket = self.shift.get, self.buckets.get
        end, n = length, len(words)
        while end <= n:
            skip = shift(tuple(words[end - block:end]), jump)
            if skip:
                end += skip
                continue
            for w, owners in bucket(tuple(words[end - suffix:end]), ()):
                if words[end - length:end] == w:
                    yield end, owners
            end += 1


def compiled(items: list[tuple[int, bytes]], window: int) -> list[Search]:
    """One search for each length of window among ``(number, text)`` items."""
    by: dict[int, dict[tuple[bytes, ...], list[int]]] = {}
    for k, text in items:
        for w in windows_of(words_of(text), window):
            owners = by.setdefault(len(w), {}).setdefault(w, [])
            if not owners or owners[-1] != k:
                owners.append(k)
    return [Search(n, ws) for n, ws in sorted(by.items(), reverse=True)]


def pieces(text: bytes | None, overlap: int) -> Iterator[tuple[int, list[bytes]]]:
    """``(place of the first word, words)`` of consecutive pieces of a text,
    each with the ``overlap`` words before it."""
    if not text:
        return
    plain, at, first, tail = text.translate(PLAIN_WORDS), 0, 0, []
    while at < len(plain):
        end = len(plain) if len(plain) - at <= PIECE else plain.find(b" ", at + PIECE)
        end = len(plain) if end < 0 else end
        words = tail + plain[at:end].split()
        yield first - len(tail), words
        first += len(words) - len(tail)
        tail, at = words[-overlap:] if overlap else [], end


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan_text(text: bytes | None, searches: list[Search], overlap: int) -> tuple[int, list[tuple[int, int]], set[int]]:
    """Number of words, merged spans of hit words and numbers of the items."""
    n, spans, items = 0, [], set()
    for first, words in pieces(text, overlap):
        n = first + len(words)
        for s in searches:
            for end, owners in s.find(words):
                b = first + end
                a = b - s.length
                if spans and spans[-1][0] <= a <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
                else:
                    spans.append((a, b))
                items.update(owners)
    return n, merged(spans), items


def _hits(docs: DataFrame, items: list[tuple[object, bytes]], window: int, id_type: str, item_type: str) -> DataFrame:
    """Every document's words, hit spans and items for one block of items."""
    names = [k for k, _ in items]
    shared = docs.sparkSession.sparkContext.broadcast((names, [t for _, t in items]))
    schema = HITS.format(id=id_type, item=item_type)

    def scan(batches):
        names, bodies = shared.value
        searches = compiled(list(enumerate(bodies)), window)
        for batch in batches:
            found = [scan_text(x.as_py(), searches, window - 1) for x in batch.column(2)]
            spans = pa.array([[{"a": a, "b": b} for a, b in s] for _, s, _ in found],
                             pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))
            kind = pa.int64() if item_type == "bigint" else pa.string()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([n for n, _, _ in found], pa.int64()), spans,
                 pa.array([[names[k] for k in sorted(x)] for _, _, x in found], pa.list_(kind))],
                names=["doc_id", "h", "n_words", "spans", "items"])

    return docs.mapInArrow(scan, schema)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS,
                       id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                       item_text_col: str = "text") -> DataFrame:
    """``(doc_id, h, n_words, spans, items)`` for each document row: the spans
    of word places hit by any window (merged, end exclusive) and the items
    whose windows occur."""
    spark = docs.sparkSession
    body = texts(docs, id_col, text_col).select("doc_id", text_hash().alias("h"), F.col("text").cast("binary").alias("body"))
    items = texts(benchmark, item_col, item_text_col).where("doc_id is not null")
    id_type, item_type = dict(body.dtypes)["doc_id"], dict(items.dtypes)["doc_id"]
    if item_type != "bigint":
        items, item_type = items.withColumn("doc_id", F.col("doc_id").cast("string")), "string"
    # at most one window starts at each byte pair of a text
    total = items.agg(F.sum(F.floor(F.octet_length("text") / 2) + 1)).first()[0] or 0
    blocks = max(1, -(-int(total) // (4 * block_windows)))
    parts = []
    for k in range(blocks):
        block = as_bytes(items.where(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) == k)).orderBy("doc_id").collect()
        parts.append(_hits(body, [(r[0], bytes(r[1] or b"")) for r in block], window, id_type, item_type))
    if blocks == 1:
        return parts[0]
    parts[0] = saved(parts[0], "hits0")  # each block scans the documents once
    hits = [p.where("size(spans) > 0").dropDuplicates(["doc_id", "h"]) for p in parts]
    hits = [hits[0], *(saved(p, f"hits{k}") for k, p in enumerate(hits[1:], 1))]
    every = hits[0]
    for p in hits[1:]:
        every = every.unionByName(p)
    joined = every.groupBy("doc_id", "h").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"),
                                              F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("i"))
    runs = F.aggregate("s", F.expr("cast(array() as array<struct<a:bigint,b:bigint>>)"), lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["b"] >= x["a"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
            F.element_at(acc, -1)["a"].alias("a"), F.greatest(F.element_at(acc, -1)["b"], x["b"]).alias("b"))))
    ).otherwise(F.concat(acc, F.array(x))))
    joined = joined.select(F.col("doc_id").alias("d2"), F.col("h").alias("h2"), runs.alias("s2"), "i")
    base = parts[0].select("doc_id", "h", "n_words", F.col("spans").alias("s0"), F.col("items").alias("i0"))
    on = base["doc_id"].eqNullSafe(joined["d2"]) & (base["h"] == joined["h2"])
    return base.join(joined, on, "left").select(
        "doc_id", "h", "n_words", F.coalesce("s2", "s0").alias("spans"), F.coalesce("i", "i0").alias("items"))


def report(found: DataFrame) -> DataFrame:
    """The digest columns of :func:`find_contamination`'s result."""
    items = F.array_distinct("items")
    names = F.array_join(F.array_sort(F.transform(items, lambda x: x.cast("string"))), ",")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["b"] - s["a"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
                        F.sha2(names, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows in which any window occurs; columns as given.
    Only the identities of contaminated rows meet the table in a join."""
    cols = docs.columns
    d, h = fresh(cols, "d", "h")
    found = find_contamination(docs, benchmark, window).where("size(spans) > 0").select(
        F.col("doc_id").alias(d), F.col("h").alias(h)).distinct()
    on = docs["doc_id"].eqNullSafe(F.col(d)) & (text_hash(docs["text"]) == F.col(h))
    return docs.join(found, on, "left_anti").select(*map(quoted, cols))
