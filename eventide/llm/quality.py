"""Quality classifier: weak labels by EM, then a hashed linear scorer.

1. **Labellers.**  Overlapping heuristics vote good (1), bad (-1) or abstain (0)
   on whole texts from a few byte and word statistics (``VOTES``).
2. **EM.**  Votes are independent given the unknown class; the corpus is one
   count for each vote pattern (at most 3 to the number of labellers, so the
   table is bounded whatever the corpus).  Expectation-maximisation over those counts of *all*
   documents estimates each labeller's accuracy and the class shares, and gives
   each pattern a posterior.
3. **Scorer.**  Logistic regression on hashed word and shape features, trained
   on the posteriors of a bounded sample (about ``SAMPLE`` documents by a hash of id
   and text, never more than twice as many, never none) in one task; only its
   weights reach the driver.
4. **Scores.**  A map over whole texts; a document is kept if its score is at
   least ``THRESHOLD``.

A text of more than ``PIECE`` bytes is read piece by piece, cut between words; what
is held of it is one number for each distinct word.

Edge cases: null and empty texts have no words and get the score of no
features (the bias), except that they are never kept; ties at the threshold are kept;
equal rows get equal scores, whatever stands beside them; rows that share an id or
have none are sampled by their texts; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import bounded_sample, buffers, fresh, quoted, spans_by_bytes, texts

# Bound of the scorer's training sample, in documents.
SAMPLE = 3000
BUCKETS = 1 << 15
THRESHOLD = 0.5
# Bytes that a worker turns into arrays at a time.
PIECE = 1 << 20

# Classes of bytes.
LOWERS, UPPERS, DIGITS, BLANKS, STOPS, BANGS, SYMBOLS, HIGH = range(8)
CLASS = np.full(256, SYMBOLS, np.uint8)
CLASS[:33] = BLANKS
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[128:] = LOWERS, UPPERS, DIGITS, HIGH
CLASS[[ord(c) for c in ".,;:?'\"()-"]] = STOPS
CLASS[ord("!")] = BANGS
PACKED = [np.array([1 << 21 * (c - 3 * k) if 0 <= c - 3 * k < 3 else 0 for c in CLASS.tolist()], np.uint64) for k in range(3)]
KINDS = 9
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True

_R = np.uint64(0x9E3779B97F4A7C15)
_R_INVERSE = np.uint64(pow(int(_R), -1, 1 << 64))
_GOLD = np.uint64(0xD6E8FEB86659FD93)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.ones(1, np.uint64)
    step = base
    while len(out) < n:
        out = np.concatenate((out, out * step))
        step = step * step
    return out[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of a run of texts of at most a piece, as arrays: hash,
    document, shape, length, and what the word before in its document has."""

    def __init__(self, offs: np.ndarray, data: np.ndarray):
        with np.errstate(over="ignore"):
            base, n = offs[0], int(offs[-1] - offs[0])
            docs = len(offs) - 1
            x = data[base:base + n]
            cuts = offs - base
            blank = SPACE[x]
            first = np.zeros(n + 1, bool)
            first[cuts] = True
            start = np.flatnonzero(~blank & (first[:n] | np.concatenate(([True], blank[:-1]))[:n]))
            stop = np.flatnonzero(~blank & (first[1:] | np.concatenate((blank[1:], [True]))[:n])) + 1
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((x.astype(np.uint64) + np.uint64(1)) * powers(_R, n))))
            hashes = mixed((sums[stop] - sums[start]) * powers(_R_INVERSE, n + 1)[start])
            kinds = np.empty((len(start), KINDS), np.int64)
            for k, packed in enumerate(PACKED):  # three counts in a word, each under 2^21 as a run is no longer
                seen = np.concatenate((np.zeros(1, np.uint64), np.cumsum(packed[x])))
                of = seen[stop] - seen[start]
                for j in range(3):
                    kinds[:, 3 * k + j] = (of >> np.uint64(21 * j)) & np.uint64((1 << 21) - 1)
        self.set(hashes, kinds, stop - start, np.searchsorted(cuts, start, side="right") - 1, docs)

    def set(self, hashes: np.ndarray, kinds: np.ndarray, length: np.ndarray, doc: np.ndarray, docs: int) -> None:
        self.hash, self.kinds, self.length, self.doc, self.docs = hashes, kinds, length, doc, docs
        self.follows = np.zeros(len(doc), bool)  # a word of the same document stands before
        self.follows[1:] = doc[1:] == doc[:-1]
        self.before = np.concatenate((hashes[:1], hashes[:-1]))
        self.count = np.bincount(doc, minlength=docs)
        self.shapes()

    def after(self, last: Words | None) -> Words:
        """The same words of one text, told which word stands before them."""
        if last is not None and len(self.doc):
            self.follows[0], self.before[0] = True, last.hash[-1]
            self.shapes()
            self.shape_before[0] = last.shape[-1]
        return self

    def shapes(self) -> None:
        k = self.kinds
        self.repeat = self.follows & (self.hash == self.before)
        letters = k[:, LOWERS] + k[:, UPPERS] + k[:, HIGH]
        self.shape = ((letters == 0) + 2 * (k[:, UPPERS] * 2 > letters) + 4 * (k[:, SYMBOLS] > 0) + 8 * (k[:, BANGS] > 0)
                      + 16 * self.repeat + 32 * (k[:, STOPS] > 0) + 64 * (k[:, DIGITS] > 0)
                      + 128 * np.minimum(self.length // 4, 7)).astype(np.uint64)
        self.shape_before = np.concatenate((self.shape[:1], self.shape[:-1]))

    def per_doc(self, values) -> np.ndarray:
        return np.bincount(self.doc, weights=values, minlength=self.docs)

    def sums(self) -> dict[str, np.ndarray]:
        """Sums over each document's words; those of pieces of a text add up."""
        chars = self.kinds.sum(axis=1) - self.kinds[:, HIGH] / 2  # about one code point for two high bytes
        letters = self.kinds[:, LOWERS] + self.kinds[:, UPPERS] + self.kinds[:, HIGH] / 2
        return {
            "words": self.count,
            "repeats": self.per_doc(self.repeat),
            "chars": self.per_doc(chars),
            "letters": self.per_doc(letters),
            "upper": self.per_doc(self.kinds[:, UPPERS]),
            "marked": self.per_doc(self.kinds[:, SYMBOLS] + self.kinds[:, BANGS] > 0),
            "bare": self.per_doc(letters == 0),
            "stops": self.per_doc(self.kinds[:, STOPS] > 0),
        }

    def distinct(self) -> np.ndarray:
        with np.errstate(over="ignore"):
            key = self.hash ^ (self.doc.astype(np.uint64) * _GOLD)
        _, at = np.unique(key, return_index=True)
        return np.bincount(self.doc[at], minlength=self.docs)

    def stats(self) -> dict[str, np.ndarray]:
        """Statistics of each text that the labellers look at."""
        return shares(self.sums(), self.distinct())

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashed features of every word: ``(document, bucket)`` pairs.  Of each word its
        hash, the hash with the word before, its shape, and both shapes."""
        zero = np.uint64(0)
        with np.errstate(over="ignore"):
            joined = self.hash + np.where(self.follows, self.before * _R, zero)
            both = self.shape + np.where(self.follows, (self.shape_before + np.uint64(1)) * np.uint64(4096), zero)
            parts = [h * _GOLD + np.uint64(salt) * _R for salt, h in enumerate((self.hash, joined, self.shape, both), 1)]
            bucket = np.concatenate([((h ^ (h >> np.uint64(29))) * _GOLD) >> np.uint64(64 - 15) for h in parts])
        return np.tile(self.doc, len(parts)), bucket.astype(np.int64)

    def weighed(self, weights: np.ndarray) -> np.ndarray:
        """Sum of the weights of each document's features."""
        doc, bucket = self.features()
        return np.bincount(doc, weights=weights[bucket], minlength=self.docs)

    def bucket_counts(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Each document's buckets and how often they occur."""
        doc, bucket = self.features()
        pairs, n = np.unique(doc * BUCKETS + bucket, return_counts=True)
        cut = np.searchsorted(pairs // BUCKETS, np.arange(self.docs + 1))
        return [(pairs[a:b] % BUCKETS, n[a:b]) for a, b in zip(cut, cut[1:])]


def shares(sums: dict[str, np.ndarray], distinct: np.ndarray) -> dict[str, np.ndarray]:
    n, chars, letters = (np.maximum(sums[k], 1) for k in ("words", "chars", "letters"))
    return {
        "words": sums["words"], "repeats": sums["repeats"] / n, "distinct": distinct / n,
        "letters": sums["letters"] / chars, "upper": sums["upper"] / letters, "marked": sums["marked"] / n,
        "bare": sums["bare"] / n, "mean": sums["chars"] / n, "stops": sums["stops"] / n,
    }


class LongText:
    """One text of more than a piece; answers as :class:`Words` of one
    document, reading piece after piece."""

    docs = 1

    def __init__(self, data: np.ndarray):
        self.data = data

    def parts(self):
        last, at, n = None, 0, len(self.data)
        while at < n:
            end = min(n, at + PIECE)
            if end < n:  # back to a word's end, or on to the end of a word that is longer than a piece
                blanks = np.flatnonzero(SPACE[self.data[at:end]])
                end = at + int(blanks[-1]) + 1 if len(blanks) else self.word_end(end)
            part = (Words(np.array([0, end - at]), self.data[at:end]) if end - at <= PIECE else self.long_word(at, end)).after(last)
            if len(part.doc):
                last = part
                yield part
            at = end

    def word_end(self, at: int) -> int:
        while at < len(self.data):
            blanks = np.flatnonzero(SPACE[self.data[at:at + PIECE]])
            if len(blanks):
                return at + int(blanks[0])
            at += PIECE
        return len(self.data)

    def long_word(self, at: int, end: int) -> Words:
        """One word of more than a piece: its hash and counts, block by block."""
        counts, h, power = np.zeros(KINDS, np.int64), np.uint64(0), np.uint64(1)
        with np.errstate(over="ignore"):
            block = powers(_R, PIECE + 1)
            for i in range(at, end, PIECE):
                x = self.data[i:min(end, i + PIECE)]
                counts += np.bincount(CLASS[x], minlength=KINDS)
                h += ((x.astype(np.uint64) + np.uint64(1)) * block[:len(x)]).sum(dtype=np.uint64) * power
                power *= block[len(x)]
        out = Words.__new__(Words)
        out.set(mixed(np.array([h])), counts[None, :], np.array([end - at]), np.zeros(1, np.int64), 1)
        return out

    @property
    def count(self) -> np.ndarray:
        return sum((w.count for w in self.parts()), np.zeros(1, np.int64))

    def stats(self) -> dict[str, np.ndarray]:
        total, seen = None, np.zeros(0, np.uint64)
        for w in self.parts():
            own = w.sums()
            total = own if total is None else {k: total[k] + own[k] for k in own}
            seen = np.union1d(seen, w.hash)
        if total is None:
            return Words(np.array([0, 0]), self.data[:0]).stats()
        return shares(total, np.array([len(seen)]))

    def weighed(self, weights: np.ndarray) -> np.ndarray:
        return sum((w.weighed(weights) for w in self.parts()), np.zeros(1))

    def bucket_counts(self) -> list[tuple[np.ndarray, np.ndarray]]:
        n = np.zeros(BUCKETS, np.int64)
        for w in self.parts():
            n += np.bincount(w.features()[1], minlength=BUCKETS)
        found = np.flatnonzero(n)
        return [(found, n[found])]


# Labellers: name, statistic, words needed, vote (1 good, 2 bad) and the range
# in which it is cast; elsewhere, or with fewer words, the labeller abstains.
# Each says one thing only: a text free of one fault may well have another.
INF = float("inf")
VOTES = (
    ("repeated words", "repeats", 5, 2, (0.10, INF)),
    ("few distinct words", "distinct", 20, 2, (-INF, 0.25)),
    ("few letters", "letters", 5, 2, (-INF, 0.85)),
    ("capitals", "upper", 10, 2, (0.30, INF)),
    ("marked words", "marked", 5, 2, (0.20, INF)),
    ("bare marks", "bare", 5, 2, (0.15, INF)),
    ("odd word length", "mean", 5, 2, (6.8, INF)),
    ("sentence marks", "stops", 5, 1, (0.05, 0.35)),
)


def votes(stats: dict[str, np.ndarray]) -> np.ndarray:
    """(documents, labellers) of 0 abstain, 1 good, 2 bad."""
    out = np.zeros((len(stats["words"]), len(VOTES)), np.int64)
    for k, (_, of, least, vote, (low, high)) in enumerate(VOTES):
        out[(stats["words"] >= least) & (stats[of] >= low) & (stats[of] < high), k] = vote
    return out


def pattern_of(v: np.ndarray) -> np.ndarray:
    return v @ 3 ** np.arange(len(VOTES))


def votes_of(pattern: np.ndarray) -> np.ndarray:
    return pattern[:, None] // 3 ** np.arange(len(VOTES)) % 3


def em(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for each pattern, each labeller's probabilities of a
    vote given the class (labellers, class, vote), and the share of good.

    Starts from the votes (9 to 1 for good, each bad vote dividing the odds by
    30); every probability is smoothed by one count, so a labeller that never
    votes says nothing."""
    v = votes_of(patterns)
    odds = 9.0 * 1.5 ** (v == 1).sum(axis=1) / 30.0 ** (v == 2).sum(axis=1)
    post = odds / (1 + odds)
    counts = counts.astype(float)
    for _ in range(rounds):
        share = (counts @ post + 1) / (counts.sum() + 2)
        table = np.empty((v.shape[1], 2, 3))
        for c, weight in enumerate((counts * post, counts * (1 - post))):
            for k in range(3):
                table[:, c, k] = weight @ (v == k) + 1
        table /= table.sum(axis=2, keepdims=True)
        logs = np.log(table)
        at = np.arange(v.shape[1])[None, :]
        up = np.log(share) + logs[at, 0, v].sum(axis=1)
        down = np.log1p(-share) + logs[at, 1, v].sum(axis=1)
        new = 1 / (1 + np.exp(np.clip(down - up, -500, 500)))
        done = np.abs(new - post).max(initial=0) < 1e-6
        post = new
        if done:
            break
    return post, table, float(share)


class Scorer:
    """Logistic regression on a document's mean hashed features."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, w: Words | LongText) -> np.ndarray:
        z = w.weighed(self.weights) / np.maximum(w.count, 1)
        return 1 / (1 + np.exp(-np.clip(z + self.bias, -50, 50)))

    @staticmethod
    def fit(rows: list[tuple[np.ndarray, np.ndarray, float]], steps: int = 150, rate: float = 0.1,
            shrink: float = 1e-4) -> Scorer:
        """``rows``: buckets, their means, and the posterior of each document."""
        idx = np.concatenate([r[0] for r in rows])
        val = np.concatenate([r[1] for r in rows]).astype(np.float64)
        doc = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
        y = np.array([r[2] for r in rows])
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        each = y / share / 2 + (1 - y) / (1 - share) / 2  # both classes weigh the same
        w, b = np.zeros(BUCKETS), 0.0
        m, s = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
        for step in range(1, steps + 1):
            p = 1 / (1 + np.exp(-np.clip(np.bincount(doc, weights=val * w[idx], minlength=len(rows)) + b, -50, 50)))
            err = (p - y) * each / len(rows)
            g = np.append(np.bincount(idx, weights=val * err[doc], minlength=BUCKETS) + shrink * w, err.sum())
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            move = rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
            w -= move[:-1]
            b -= move[-1]
        return Scorer(w, float(b))


def runs(column):
    """The texts of an Arrow binary column as :class:`Words`, a piece at a
    time, or as :class:`LongText`."""
    offs, data = buffers(column)
    for i, j in spans_by_bytes(offs, PIECE):
        long = j == i + 1 and offs[j] - offs[i] > PIECE
        yield LongText(data[offs[i]:offs[j]]) if long else Words(offs[i:j + 1], data)


def _body(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return texts(docs, id_col, text_col).select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"))


def vote_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(pattern, n)`` over all documents."""
    def run(batches):
        for batch in batches:
            found = np.concatenate([pattern_of(votes(w.stats())) for w in runs(batch.column(0))]) if batch.num_rows else np.zeros(0, int)
            p, n = np.unique(found, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(n, pa.int64())], names=["pattern", "n"])

    return _body(docs, id_col, text_col).select("body").mapInArrow(run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> tuple[Scorer | None, dict]:
    """The scorer (None for an empty table) and what EM found: ``accuracy`` by
    labeller, ``share``."""
    table = sorted((r.pattern, r.n) for r in vote_counts(docs, id_col, text_col).collect())  # at most 3^8 rows
    if not table:
        return None, {"accuracy": {}, "share": None}
    patterns, counts = (np.array(c, np.int64) for c in zip(*table))
    post, probs, share = em(patterns, counts)
    known = docs.sparkSession.sparkContext.broadcast(dict(zip(patterns.tolist(), post.tolist())))

    def rows(batches):
        for batch in batches:
            for w in runs(batch.column(0)):
                labels = [known.value[x] for x in pattern_of(votes(w.stats())).tolist()]
                for (bucket, n), words, label in zip(w.bucket_counts(), w.count, labels):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([bucket.astype(np.int32)], pa.list_(pa.int32())),
                         pa.array([(n / max(1, words)).astype(np.float32)], pa.list_(pa.float32())),
                         pa.array([label], pa.float64())], names=["buckets", "means", "label"])

    def train(batches):
        got = []
        for batch in batches:
            for b, v, y in zip(*(c.to_pylist() for c in batch.columns)):
                got.append((np.array(b, np.int64), np.array(v), y))
        if got:
            got.sort(key=lambda r: (len(r[0]), r[2], r[0].tobytes()))  # the same whatever the order of arrival
            s = Scorer.fit(got)
            yield pa.RecordBatch.from_arrays([pa.array([s.weights.astype("<f8").tobytes()], pa.binary()),
                                              pa.array([s.bias], pa.float64())], names=["weights", "bias"])

    chosen = bounded_sample(texts(docs, id_col, text_col), int(counts.sum()), sample, "quality-sample")
    row = _body(chosen, "doc_id", "text").select("body").mapInArrow(
        rows, "buckets array<int>, means array<float>, label double").repartition(1).mapInArrow(
        train, "weights binary, bias double").first()  # the sample has rows as the table has
    scorer = Scorer(np.frombuffer(bytes(row[0]), "<f8"), row[1])
    # how often a labeller that votes is right
    accuracy = {name: float((share * probs[k, 0, 1] + (1 - share) * probs[k, 1, 2])
                            / (share * probs[k, 0, 1:].sum() + (1 - share) * probs[k, 1, 1:].sum()))
                for k, (name, *_) in enumerate(VOTES)}
    return scorer, {"accuracy": accuracy, "share": share}


def scores(docs: DataFrame, scorer: Scorer | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, score)`` of each row."""
    body = _body(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(None if scorer is None else (scorer.weights, scorer.bias))

    def run(batches):
        own = Scorer(*(shared.value or (np.zeros(BUCKETS), 0.0)))
        for batch in batches:
            done = [(w.count, own.score(w)) for w in runs(batch.column(1))] if batch.num_rows else [(np.zeros(0, int), np.zeros(0))]
            n, s = (np.concatenate(c) for c in zip(*done))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(s, pa.float64())],
                                             names=["doc_id", "n_words", "score"])

    return body.mapInArrow(run, f"doc_id {dict(body.dtypes)['doc_id']}, n_words long, score double")


def classify(docs: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, score, kept)`` of each row."""
    scorer, _ = fit(docs, sample, id_col, text_col)
    return scores(docs, scorer, id_col, text_col).withColumn("kept", (F.col("n_words") > 0) & (F.col("score") >= threshold))


def keep_good(docs: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; columns as given.
    The rows pass through one map: no join, no shuffle."""
    scorer, _ = fit(docs, sample)
    shared = docs.sparkSession.sparkContext.broadcast(None if scorer is None else (scorer.weights, scorer.bias))
    cols = docs.columns
    (body,) = fresh(cols, "body")

    def run(batches):
        own = Scorer(*(shared.value or (np.zeros(BUCKETS), 0.0)))
        for batch in batches:
            done = [(w.count, own.score(w)) for w in runs(batch.column(len(cols)))] if batch.num_rows else [(np.zeros(0, int), np.zeros(0))]
            n, s = (np.concatenate(c) for c in zip(*done))
            mask = pa.array((n > 0) & (s >= threshold))
            yield pa.RecordBatch.from_arrays([c.filter(mask) for c in batch.columns[:-1]], names=cols)

    # the text travels once, as bytes
    sent = docs.select(*map(quoted, cols), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias(body))
    return sent.mapInArrow(run, docs.schema)
