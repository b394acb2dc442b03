"""Target-distribution importance resampling over a head-tail vocabulary.

Features are all runs of 1 to 3 consecutive words; a feature's bucket is the
CRC-32 of its UTF-8 bytes modulo ``buckets``.

1. Head: every task counts words and word pairs of all its documents (in bounded
   memory: the rarest are dropped when there are too many), hands on those with at
   least one in ``2 * HEAD`` of its own occurrences, and the sums pick the words and
   pairs with at least one in ``HEAD`` of all: at most ``HEAD`` of each, by counting.
   The exact CRC states of those words and pairs are broadcast (words over
   ``HEAD_BYTES`` stay out, so the broadcast has a size bound).  The head only saves
   work: what is not in it takes the direct CRC of its bytes, so a word or pair that
   is missed changes no result.
2. Totals: exact counts of every bucket over all documents and over all of the
   target, one vector of ``buckets`` numbers a task, summed by Spark.
3. Weights: a second scan sums each document's gains; scores add Gumbel noise
   from a hash of the id, so the draw is a weighted one without replacement.
4. Draw: eligible scores are range-partitioned and sorted; ranks are places in a
   partition plus the sizes of the ones before it.  No global sort in one task.

Edge cases: null and empty texts have no words, no features and weight 0; a
null id is hashed as the empty string and comes first among ties; repeated
rows each get a score, and their ranks follow one another; an empty
corpus or target counts as no features (all gains stay defined); long texts are
read in pieces of ``PIECE`` bytes; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.llm.common import PLAIN_WORDS, as_bytes, saved, texts

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 5
SEED = 42

HEAD = 8192  # a head word or pair has one in so many of all occurrences
HEAD_BYTES = 64  # longest head word
COUNTERS = 16 * HEAD  # a task's counters of words, and of pairs
BUFFER = 1 << 19  # words that are counted at a time
PIECE = 1 << 20  # bytes of a text that are split into words at a time


@dataclass
class Head:
    """CRC states of the frequent words and pairs; pairs are sorted by key."""
    words: dict[bytes, int]
    states: np.ndarray
    pairs: np.ndarray
    pair_states: np.ndarray


def pieces(body: bytes | None) -> Iterator[list[bytes]]:
    """The words of a text, list by list, cut between words."""
    if not body:
        return
    plain = body.translate(PLAIN_WORDS)
    at = 0
    while at < len(plain):
        end = plain.find(b" ", at + PIECE)
        end = len(plain) if end < 0 else end
        if ws := plain[at:end].split():
            yield ws
        at = end


def crossing(body: bytes | None) -> Iterator[tuple[list[bytes], int]]:
    """As ``pieces``, each with up to two words of the one before it in front,
    and how many those are."""
    last: list[bytes] = []
    for ws in pieces(body):
        ws = last + ws
        yield ws, len(last)
        last = ws[-2:]


def build_head(words: list[bytes], pairs: list[tuple[bytes, bytes]]) -> Head:
    ids = {w: i for i, w in enumerate(words)}
    states = np.array([*map(crc32, words), 0], np.uint32)  # the last one for a word that isn't there
    both = sorted((ids[a] << 32 | ids[b], crc32(b" " + b, crc32(a))) for a, b in pairs if a in ids and b in ids)
    return Head(ids, states, np.array([k for k, _ in both], np.int64), np.array([s for _, s in both], np.uint32))


def feature_states(ws: list[bytes], carried: int, head: Head) -> np.ndarray:
    """CRC-32 of all features that end in ``ws[carried:]``: words, pairs, triples."""
    n = len(ws)
    ids = np.array([*map(head.words.get, ws, repeat(-1))], np.int64)
    one = head.states[ids]
    tail = np.flatnonzero(ids < 0)
    one[tail] = [*map(crc32, map(ws.__getitem__, tail.tolist()))]

    spaced = [b" " + w for w in ws]
    two = np.empty(max(n - 1, 0), np.uint32)
    if n > 1:
        known = np.zeros(n - 1, bool)
        if len(head.pairs):
            key = np.where((ids[:-1] >= 0) & (ids[1:] >= 0), ids[:-1] << 32 | ids[1:], -1)
            at = np.minimum(np.searchsorted(head.pairs, key), len(head.pairs) - 1)
            known = head.pairs[at] == key
            two[known] = head.pair_states[at[known]]
        tail = np.flatnonzero(~known)
        two[tail] = [*map(crc32, map(spaced.__getitem__, (tail + 1).tolist()), one[tail].tolist())]
    three = np.array([*map(crc32, spaced[2:], two[:-1].tolist())], np.uint32)
    return np.concatenate((one[carried:], two[max(carried - 1, 0):], three[max(carried - 2, 0):]))


class Numbers(dict):
    """Words and their numbers, from 1 on; a new word gets the next one."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) + 1
        return number


class Frequent:
    """Counts of the words and pairs of a stream of texts; of more than
    ``COUNTERS`` the rarer half is forgotten."""

    def __init__(self) -> None:
        self.number = Numbers()
        self.words = np.zeros(1, np.int64)  # by number; 0 stands between texts
        self.pairs, self.pair_counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.held = [0]
        self.total = 0

    def add(self, body: bytes | None) -> None:
        for ws in pieces(body):
            self.held += map(self.number.__getitem__, ws)
            self.total += len(ws)
            if len(self.held) >= BUFFER:
                self.count()
        if self.held[-1]:
            self.held.append(0)

    def count(self) -> None:
        ids = np.array(self.held, np.int64)
        new = np.bincount(ids[1:], minlength=len(self.number) + 1)  # the first was counted before
        new[:len(self.words)] += self.words
        self.words = new
        code = (ids[:-1] << 32 | ids[1:])[(ids[:-1] > 0) & (ids[1:] > 0)]
        code, n = np.unique(code, return_counts=True)
        self.pairs, at = np.unique(np.concatenate((self.pairs, code)), return_inverse=True)
        self.pair_counts = np.bincount(at, weights=np.concatenate((self.pair_counts, n))).astype(np.int64)
        last = self.held[-1]
        if len(self.pairs) > COUNTERS:
            self.keep_pairs(np.argpartition(-self.pair_counts, COUNTERS // 2)[:COUNTERS // 2])
        if len(self.number) > COUNTERS:
            last = int(self.forget()[last])
        self.held = [last]

    def keep_pairs(self, at: np.ndarray) -> None:
        at = np.sort(at)
        self.pairs, self.pair_counts = self.pairs[at], self.pair_counts[at]

    def forget(self) -> np.ndarray:
        """Drop the rarer words, and their pairs; the others' new numbers (0 if dropped)."""
        stay = np.argpartition(-self.words[1:], COUNTERS // 2)[:COUNTERS // 2] + 1
        new = np.zeros(len(self.words), np.int64)
        new[stay] = np.arange(1, len(stay) + 1)
        self.number = Numbers((w, k) for w, i in self.number.items() if (k := int(new[i])))
        self.words = np.concatenate(([0], self.words[stay]))
        a, b = new[self.pairs >> 32], new[self.pairs & 0xFFFFFFFF]
        self.pairs = a << 32 | b
        self.keep_pairs(np.flatnonzero((a > 0) & (b > 0)))
        order = np.argsort(self.pairs)
        self.pairs, self.pair_counts = self.pairs[order], self.pair_counts[order]
        return new

    def rows(self) -> Iterator[tuple[bytes | None, bytes | None, int]]:
        """``(word, None, n)`` and ``(word, word, n)`` of the frequent ones, and the total."""
        self.count()
        least = self.total / (2 * HEAD)
        name = {i: w for w, i in self.number.items() if len(w) <= HEAD_BYTES}
        for i in np.flatnonzero(self.words >= max(least, 1)).tolist():
            if i in name:
                yield name[i], None, int(self.words[i])
        for k in np.flatnonzero(self.pair_counts >= least).tolist():
            a, b = divmod(int(self.pairs[k]), 1 << 32)
            if a in name and b in name:
                yield name[a], name[b], int(self.pair_counts[k])
        yield None, None, self.total


def frequent(body: DataFrame) -> tuple[list[bytes], list[tuple[bytes, bytes]]]:
    """Words and pairs with at least one in ``HEAD`` of all occurrences."""
    def count(batches):
        own = Frequent()
        for batch in batches:
            for x in batch.column(1):
                own.add(x.as_py())
        for some in batched(own.rows(), 10_000):
            a, b, n = zip(*some)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64())],
                                             names=["a", "b", "n"])

    counts = saved(body.mapInArrow(count, "a binary, b binary, n long").groupBy("a", "b").agg(F.sum("n").alias("n")),
                   "resample-head")
    total = counts.where("a IS NULL").agg(F.sum("n")).first()[0] or 0
    rows = counts.where(F.col("a").isNotNull() & (F.col("n") * HEAD >= total)).collect()  # 2 x HEAD rows at most
    return (sorted(bytes(r.a) for r in rows if r.b is None),
            sorted((bytes(r.a), bytes(r.b)) for r in rows if r.b is not None))


def bucket_totals(body: DataFrame, head: Head, buckets: int) -> np.ndarray:
    """Exact number of features in each bucket, over all rows."""
    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for x in batch.column(1):
                for ws, carried in crossing(x.as_py()):
                    total += np.bincount(feature_states(ws, carried, head) % buckets, minlength=buckets)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(total[full])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in body.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n  # one row a bucket
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log of how much likelier a bucket is in the target (add-one smoothing), rounded down."""
    all_raw, all_target, n = float(raw.sum()), float(target.sum()), len(raw)
    return np.array([math.floor(1000 * math.log((t + 1) * (all_raw + n) / ((s + 1) * (all_target + n))))
                     for s, t in zip(raw.astype(float).tolist(), target.astype(float).tolist())], np.int64)


def weigh(body: DataFrame, head: Head, gains: np.ndarray) -> DataFrame:
    buckets = len(gains)

    def weight(batches):
        for batch in batches:
            out = []
            for x in batch.column(1):
                n_words = n_features = total = 0
                for ws, carried in crossing(x.as_py()):
                    states = feature_states(ws, carried, head)
                    n_words += len(ws) - carried
                    n_features += len(states)
                    total += int(gains[states % buckets].sum())
                out.append((n_words, n_features, total))
            cols = zip(*out) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols)],
                                             names=["doc_id", "n_words", "n_features", "weight"])

    kind = dict(body.dtypes)["doc_id"]
    return body.mapInArrow(weight, f"doc_id {kind}, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """1000 times a standard Gumbel number from a hash of the id, rounded down."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def draw(scored: DataFrame, min_words: int, percent: int) -> DataFrame:
    """Ranks of the ``percent`` highest scores among rows of ``min_words``
    words or more; null for all other rows."""
    scored = saved(scored.withColumn("place", F.monotonically_increasing_id()), "resample-scores")
    able = scored.where(F.col("n_words") >= min_words)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("place")]
    # (place) only separates equal rows, so that any number of them can be dealt out
    parted = saved(able.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "part", F.spark_partition_id()), "resample-order")
    sizes = {r.part: r.n for r in parted.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row a partition
    drawn, before, at = sum(sizes.values()) * percent // 100, [], 0
    for part in sorted(sizes):
        before.append((part, at))
        at += sizes[part]
    if before:
        offset = F.element_at(F.map_from_arrays(F.array(*[F.lit(p) for p, _ in before]),
                                                F.array(*[F.lit(n).cast("long") for _, n in before])), F.col("part"))
    else:
        offset = F.lit(0).cast("long")
    rank = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + offset
    ranked = parted.withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    cols = ["doc_id", "n_words", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank")]
    return ranked.select(*cols).unionByName(rest.select(*cols))


def resample(docs: DataFrame, target: DataFrame, *, buckets: int = BUCKETS, min_words: int = MIN_WORDS,
             percent: int = PERCENT, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text",
             target_text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_features, weight,
    score, rank``; ``rank`` is null unless the row is drawn."""
    body = as_bytes(texts(docs, id_col, text_col))
    wanted = as_bytes(texts(target, target_text, target_text))
    head = build_head(*frequent(body))
    gains = bucket_gains(bucket_totals(body, head, buckets), bucket_totals(wanted, head, buckets))
    scored = weigh(body, head, gains).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    return draw(scored, min_words, percent)
