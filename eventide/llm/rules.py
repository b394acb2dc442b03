"""Quality rules with DataFrame functions only.

Base counts of each whole text, and a verdict by importance: hashed word
1- and 2-grams have one multinomial over **all** documents (raw corpus) and one over
**all** trusted documents (labelled quality 1, not toxic).  A text's score is the mean log-likelihood
ratio of target to raw over its n-grams, so its length does not matter; it
is kept if the score is at least ``THRESHOLD`` and no base rule failed.

Counts are partial aggregates over ``BUCKETS`` keys; the table of ratios is a
constant of bounded size.  Texts are shuffled only where a sieve of bounded size lets their id
through: the trusted ones and, as the ids fill the sieve, a share of the others, which
the exact join then turns down.  Words that lie in repeated 3-word windows are found inside a row: window hashes, with the place in the low bits, are
sorted, equal neighbours are confirmed word by word and their places merged.

Edge cases: null and empty texts have no words, score 0, and fail the length rule; texts
under three words have no window; equal rows each get a row; without trusted
documents every score is 0 and only the base rules decide; labels that repeat count once;
ties at the threshold are kept; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import number_array, once, texts
from eventide.operators.settled import settled

WORD_GAP = r"[\x20\x09-\x0D]+"
BUCKETS = 1 << 14
SIEVE = 1 << 24  # places of the sieve of trusted ids, 64 to a row
SMOOTHING = 1.0
THRESHOLD = -0.08
MIN_WORDS = 50
MAX_REPEATED = 50  # per cent
HASHED = -1  # bits of a window's hash that are used: all


def words(text: Column) -> Column:
    return F.filter(F.split(text, WORD_GAP), lambda w: w != "")


def grams(ws: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of an array's words and pairs of words."""
    def at(*of: Column) -> Column:
        return F.xxhash64(*of).bitwiseAND(F.lit(buckets - 1)).cast("int")

    one = F.transform(ws, lambda w: at(w))
    two = F.when(F.size(ws) > 1, F.transform(F.sequence(F.lit(1), F.size(ws) - 1), lambda i: at(F.get(ws, i - 1), F.get(ws, i))))
    return F.concat(one, F.coalesce(two, F.array().cast("array<int>")))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of all documents labelled good."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    return good.select(F.col("doc_id").alias("id")).distinct()


def place(key: Column) -> Column:
    """An id's place in the sieve; none if it is null."""
    return F.when(key.isNotNull(), F.xxhash64(key).bitwiseAND(F.lit(SIEVE - 1)))


def sieve(ids: DataFrame) -> DataFrame:
    """Places of the ids as bits, at most ``SIEVE / 64`` rows however many ids there are."""
    at = place(F.col("id"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    return ids.select(F.shiftright(at, 6).alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits"))


def marked(own: DataFrame, ids: DataFrame) -> DataFrame:
    """``(text, good)`` of each row: whether its id is among the ids, which are distinct.

    Only rows that the sieve lets through are joined.  That join is sorted at any size, as
    the ids grow with the corpus; so what it shuffles follows the input."""
    kind = own.select("doc_id").union(ids).schema[0].dataType  # ids of two types must hash alike
    own, ids = own.select(F.col("doc_id").cast(kind), "text"), ids.select(F.col("id").cast(kind))
    at = place(F.col("doc_id"))
    sifted = own.join(F.broadcast(sieve(ids)), F.shiftright(at, 6) == F.col("at"), "left").select(
        "doc_id", "text", F.coalesce(F.getbit("bits", at.bitwiseAND(F.lit(63)).cast("int")) == 1, F.lit(False)).alias("maybe"))
    found = sifted.where("maybe").join(ids.hint("merge"), F.col("doc_id") == F.col("id"), "left")
    return sifted.where("not maybe").select("text", F.lit(False).alias("good")).union(
        found.select("text", F.col("id").isNotNull().alias("good")))


def ratios(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[float] | None:
    """Log-likelihood ratio of target to raw for each bucket."""
    own = texts(docs, id_col, text_col).where("text is not null")
    seen = marked(own, settled(trusted_ids(labels), "trusted-ids")).select(words(F.col("text")).alias("ws"), "good")
    rows = seen.select(F.explode(once(F.col("ws"), lambda ws: grams(ws))).alias("b"), "good").groupBy("b").agg(
        F.count("*").alias("raw"), F.sum(F.col("good").cast("long")).alias("target")).collect()  # at most BUCKETS rows
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for r in rows:
        raw[r["b"]], target[r["b"]] = r["raw"], r["target"]
    if not sum(target):
        return None
    n_raw, n_target = sum(raw) + SMOOTHING * BUCKETS, sum(target) + SMOOTHING * BUCKETS
    return [math.log((t + SMOOTHING) / n_target) - math.log((r + SMOOTHING) / n_raw) for t, r in zip(target, raw)]


def repeated_words(ws: Column) -> Column:
    """Number of words inside windows that occur twice or more.

    Keys hold the window's hash and, in as many low bits as the largest place needs,
    its place; sorted, windows of one hash are a run.  Each is compared, word by word, with the
    one before it.  If two in a row are not equal (different windows of one hash, which
    might stand between equal ones) the text's windows are sorted by their words instead."""
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.ceil(F.log2(F.greatest(F.size(ws), F.lit(2)).cast("double"))).cast("int")) - 1

    def equal(a: Column, b: Column) -> Column:
        same = F.get(ws, a) == F.get(ws, b)
        for k in (1, 2):
            same = same & (F.get(ws, a + k) == F.get(ws, b + k))
        return same

    def marks(keys: Column, mask: Column) -> Column:
        """Of each key: 0 its hash is another than the one before, 1 its window is the same, 2 it isn't."""
        def mark(x: Column, i: Column) -> Column:
            y = F.get(keys, i - 1)
            return F.when(x.bitwiseXOR(y).between(F.lit(0), mask), F.when(
                equal(x.bitwiseAND(mask).cast("int"), y.bitwiseAND(mask).cast("int")), 1).otherwise(2)).otherwise(0)
        return F.transform(keys, mark)

    def repeats(keys: Column, marks: Column, place) -> Column:
        """Places of the keys that equal a neighbour, sorted."""
        again = F.filter(keys, lambda x, i: (F.get(marks, i) == 1) | F.coalesce(F.get(marks, i + 1) == 1, F.lit(False)))
        return F.sort_array(F.transform(again, place))

    def covered(p: Column) -> Column:
        three = F.lit(3).cast("long")
        return F.aggregate(F.transform(p, lambda x, i: F.least(three, F.coalesce(F.get(p, i + 1) - x, three))),
                           F.lit(0).cast("long"), lambda acc, x: acc + x)

    starts = F.sequence(F.lit(0), F.size(ws) - 3)

    def keys(mask: Column) -> Column:
        return F.sort_array(F.transform(starts, lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)).bitwiseAND(
            F.lit(HASHED)).bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long"))))

    def by_words() -> Column:
        windows = F.array_sort(F.transform(starts, lambda i: F.struct(
            *[F.get(ws, i + k).alias(f"w{k}") for k in range(3)], i.cast("long").alias("at"))))
        return once(windows, lambda w: once(F.transform(w, lambda x, i: F.when(
            (x["w0"] == F.get(w, i - 1)["w0"]) & (x["w1"] == F.get(w, i - 1)["w1"]) & (x["w2"] == F.get(w, i - 1)["w2"]), 1).otherwise(0)),
            lambda m: once(repeats(w, m, lambda x: x["at"]), covered)))

    def counted(k: Column, m: Column, mask: Column) -> Column:
        return F.when(F.exists(m, lambda x: x == 2), by_words()).otherwise(
            once(repeats(k, m, lambda x: x.bitwiseAND(mask)), covered))

    found = once(mask, lambda m: once(keys(m), lambda k: once(marks(k, m), lambda s: counted(k, s, m))))
    return F.when(F.size(ws) >= 3, found).otherwise(F.lit(0).cast("long"))


def measure(docs: DataFrame, table: list[float] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    score)`` of each row."""
    own = texts(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))

    def of_words(ws: Column) -> Column:
        score = F.lit(0.0) if table is None else F.when(F.size(ws) > 0, F.aggregate(
            grams(ws), F.lit(0.0), lambda acc, b: acc + F.get(number_array(table), b)) / (2 * F.size(ws) - 1)).otherwise(0.0)
        return F.struct(F.size(ws).cast("long").alias("n_words"), F.char_length(F.array_join(ws, "")).cast("long").alias("word_chars"),
                        repeated_words(ws).alias("n_repeat_words"), score.alias("score"))

    lines = F.filter(F.split("text", "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    counted = own.select(
        "doc_id", once(words(F.col("text")), of_words).alias("w"),
        F.char_length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        once(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    return counted.select("doc_id", "w.n_words", "w.word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words", "w.score")


def judge(measured: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``base_failed`` and ``kept``."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    cols = [c for c in measured.columns if c != "score"]
    return measured.select(*cols, failed.alias("base_failed"), (~failed & (F.col("score") >= threshold)).alias("kept"), "score")


def apply_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return judge(measure(docs, ratios(docs, labels)), threshold)
