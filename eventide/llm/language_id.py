"""Language identification by a byte convolutional network.

Architecture: bytes of a fixed-length window -> for each width a bank of
filters over one-hot bytes (a sum of table rows, one for each offset) -> bias,
max pooling over the window, ReLU -> linear layer -> softmax.  Trained in numpy by
Adam on a **bounded** sample of labelled windows: at most ``PER_LANG``
windows of ``LENGTH`` bytes for each language, and ``IN_ALL`` together (but one for
each language), chosen by hash among the rows with a language that are not held
out.  Every such language is learned.  The sample is trained on in one task;
only the weights (some 100 kB) reach the driver.

Prediction is a map over whole texts: every window of a text is scored and the
text's probabilities are the means over its windows, weighted by length.

Edge cases: a null text or one without a letter is ``und`` with score 0; a null
id is never held out (its crc32 is taken of the empty text); rows without
language are predicted but not learned from; without any
labelled row every text is ``und`` with score 0; equal rows each get a row (and
give one window to learn from); other columns are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from eventide.llm.common import LOWER, saved, unit_hash

LENGTH = 256
# Bound of the training sample: windows for each language.
PER_LANG = 1500
# Bound of the training sample in all: with many languages each has fewer windows.
IN_ALL = 200_000
WIDTHS = (2, 3, 4)
FILTERS = 12
STEPS = 1200
BATCH = 64
RATE = 0.02
# Windows scored, and texts held, at a time.
WINDOWS = 256
TEXTS = 512


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


class ByteConv:
    """Filters of several widths over bytes; ``tables[w]`` is (w, 256, filters)."""

    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.p: dict[str, np.ndarray] = {
            f"t{w}": (rng.normal(size=(w, 256, FILTERS)) * 0.3).astype(np.float32) for w in WIDTHS}
        n = FILTERS * len(WIDTHS)
        self.p["b"] = np.zeros(n, np.float32)
        self.p["w"] = (rng.normal(size=(n, len(langs))) * 0.1).astype(np.float32)
        self.p["c"] = np.zeros(len(langs), np.float32)

    def pooled(self, x: np.ndarray):
        """Max-pooled filter outputs of windows (n, length), and their places."""
        tops, places = [], []
        for w in WIDTHS:
            t = self.p[f"t{w}"]
            n = x.shape[1] - w + 1
            out = t[0][x[:, :n]]
            for k in range(1, w):
                out += t[k][x[:, k:k + n]]
            at = out.argmax(axis=1)
            places.append(at)
            tops.append(np.take_along_axis(out, at[:, None, :], 1)[:, 0])
        return np.concatenate(tops, axis=1) + self.p["b"], places

    def ready(self) -> ByteConv:
        """Tables of byte pairs for scoring: a filter of width w is then a sum
        of w/2 rows."""
        self.pairs = {}
        for w in WIDTHS:
            t = self.p[f"t{w}"]
            self.pairs[w] = [(t[k][:, None] + t[k + 1][None]).reshape(65536, FILTERS) for k in range(0, w - 1, 2)]
            if w % 2:
                self.pairs[w].append(t[w - 1])
        return self

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        two = x[:, :-1].astype(np.intp) * 256 + x[:, 1:]
        tops = []
        for w in WIDTHS:
            n = x.shape[1] - w + 1
            out = np.take(self.pairs[w][0], two[:, :n], axis=0)
            for k, t in enumerate(self.pairs[w][1:], 1):
                out += np.take(t, (two if len(t) > 256 else x)[:, 2 * k:2 * k + n], axis=0)
            tops.append(out.max(axis=1))
        z = np.maximum(np.concatenate(tops, axis=1) + self.p["b"], 0) @ self.p["w"] + self.p["c"]
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        pre, places = self.pooled(x)
        h = np.maximum(pre, 0)
        z = h @ self.p["w"] + self.p["c"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        dz = (z / z.sum(axis=1, keepdims=True)).astype(np.float32)
        dz[np.arange(len(y)), y] -= 1
        dz /= len(y)
        dh = (dz @ self.p["w"].T) * (pre > 0)
        g = {"w": h.T @ dz, "c": dz.sum(axis=0), "b": dh.sum(axis=0)}
        rows = np.arange(len(x))[:, None]
        filters = np.broadcast_to(np.arange(FILTERS), (len(x), FILTERS))
        for i, w in enumerate(WIDTHS):
            d = dh[:, i * FILTERS:(i + 1) * FILTERS]
            g[f"t{w}"] = np.zeros_like(self.p[f"t{w}"])
            for k in range(w):  # max pooling passes the gradient to the place of the maximum
                np.add.at(g[f"t{w}"][k], (x[rows, places[i] + k], filters), d)
        return g

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 11) -> ByteConv:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        by = [np.flatnonzero(y == k) for k in range(len(self.langs))]
        by = [b for b in by if len(b)]
        for step in range(1, steps + 1):
            # the same number of windows of each language, whatever its share
            pick = np.concatenate([rng.choice(b, -(-BATCH // len(by))) for b in by])
            rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in self.gradients(x[pick], y[pick]).items():
                m[k] += 0.1 * (g - m[k])
                s[k] += 0.01 * (g * g - s[k])
                self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)
        return self


def window_of(body: bytes) -> np.ndarray:
    """One window, A-Z lower-cased, padded with spaces."""
    x = np.full(LENGTH, 32, np.uint8)
    x[:len(body[:LENGTH])] = np.frombuffer(body[:LENGTH].translate(LOWER), np.uint8)
    return x


def sample(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """``(lang, body)``: for each language at most ``per_lang`` windows, one of
    a document, at a place chosen by hash.  A language's rows are thinned by hash to
    about twice that number where they lie, repeated ones are taken once, and the rest is
    ranked, so that a language or a row with most of the rows does not meet in one task."""
    own = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    own = own.withColumn("r", unit_hash(F.lit("rank"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"))
    # a language's least rank stays, so that few texts that are repeated often don't all lie above the bound
    sizes = saved(own.groupBy("lang").agg(F.count("*").alias("n"), F.min("r").alias("least")), "languages").withColumnRenamed("lang", "of")
    per_lang = min(per_lang, max(1, IN_ALL // max(1, sizes.count())))
    own = own.join(sizes, own["lang"] == sizes["of"]).where((F.col("r") * F.col("n") < 2 * per_lang) | (F.col("r") == F.col("least")))
    start = F.floor(unit_hash(F.lit("place"), "doc_id") * F.greatest(F.char_length("text") - LENGTH + 1, F.lit(1))).cast("int")
    cut = own.select("lang", "r", F.col("doc_id").alias("d"),
                     F.substring("text", start + 1, LENGTH).cast("binary").alias("body")).distinct()
    place = F.row_number().over(W.partitionBy("lang").orderBy("r", "d", "body"))
    return cut.withColumn("k", place).where(F.col("k") <= per_lang).select("lang", "body")


def fit(docs: DataFrame, per_lang: int = PER_LANG, steps: int = STEPS) -> bytes | None:
    """The pickled network, trained in one task on the bounded sample."""
    def train(batches):
        langs, bodies = [], []
        for batch in batches:
            langs += batch.column(0).to_pylist()
            bodies += batch.column(1).to_pylist()
        if not langs:
            return
        order = sorted(range(len(langs)), key=lambda i: (langs[i], bodies[i]))  # the same whatever the order of arrival
        names = sorted(set(langs))
        number = {k: i for i, k in enumerate(names)}
        net = ByteConv(names).train(np.stack([window_of(bodies[i]) for i in order]),
                                    np.array([number[langs[i]] for i in order]), steps)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], names=["net"])

    row = sample(docs, per_lang).repartition(1).mapInArrow(train, "net binary").first()
    return bytes(row[0]) if row else None


def score_texts(net: ByteConv, bodies: list[bytes]) -> np.ndarray:
    """Mean probabilities of each text over all its windows, so that a text of two
    languages gets the one that has more of it."""
    total = np.zeros((len(bodies), len(net.langs)))
    weight = np.zeros(len(bodies))
    held, owner, size = [], [], []

    def flush() -> None:
        p = np.exp(net.log_probs(np.stack(held)))
        np.add.at(total, owner, p * np.array(size)[:, None])
        np.add.at(weight, owner, size)
        held.clear(), owner.clear(), size.clear()

    for i, body in enumerate(bodies):
        body = body.translate(LOWER)
        for at in range(0, len(body), LENGTH):
            part = body[at:at + LENGTH]
            held.append(np.frombuffer(part, np.uint8) if len(part) == LENGTH else window_of(part))
            owner.append(i)
            size.append(len(part))
            if len(held) == WINDOWS:
                flush()
    if held:
        flush()
    return total / np.maximum(weight, 1)[:, None]


def predict(docs: DataFrame, model: bytes | None) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of each row, from its text alone."""
    body = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("body"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        net = pickle.loads(shared.value).ready() if shared.value else None
        for whole in batches:
            for batch in (whole.slice(i, TEXTS) for i in range(0, whole.num_rows, TEXTS)):
                bodies = [x.as_py() for x in batch.column(1)]
                has = [b is not None and any(map(str.isalpha, b.decode("utf-8", "replace"))) for b in bodies]
                lang, score = ["und"] * len(bodies), [0.0] * len(bodies)
                at = [i for i, h in enumerate(has) if h] if net else []
                if at:
                    p = score_texts(net, [bodies[i] for i in at])
                    for i, k, s in zip(at, p.argmax(axis=1), p.max(axis=1)):
                        lang[i], score[i] = net.langs[k], min(1.0, float(s))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang), pa.array(score, pa.float64())],
                                                 names=["doc_id", "lang_pred", "score"])

    out = body.mapInArrow(run, f"doc_id {dict(body.dtypes)['doc_id']}, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def identify_languages(docs: DataFrame, per_lang: int = PER_LANG, steps: int = STEPS) -> DataFrame:
    return predict(docs, fit(docs, per_lang, steps))
