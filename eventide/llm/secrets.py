"""Secret scan with DataFrame functions only.

Base patterns (``KINDS``) give their leftmost non-overlapping matches.  Beside
them, character Markov models score every long token: one model of random
strings, one of ordinary identifiers, both first-order over ASCII; a token whose mean
log-likelihood ratio is at least ``THRESHOLD`` a character is a ``markov`` span
unless it overlaps a base span.

Both models are trained from labelled samples, over a **bounded** number of documents
(about ``SAMPLE`` by a hash of id and text, never more than twice as many, never none): random strings are
what the base patterns match there, and digests of the documents in hex,
base 36 and base 64; ordinary identifiers are the words of 6
letters or more outside base matches.  Counts are grouped by pair of characters, so the
model has at most 128 x 128 entries, whatever the corpus.

Spans count code points, end exclusive: the lengths of the pieces between the matches
and of the matches are summed, for matching texts only.

Edge cases: null and empty texts have no span; equal spans of different kinds all
count; repeated rows each get a row and are sampled once; rows that share an id or have
none are sampled by their texts; other columns are ignored; an empty table gives an
empty result.  Without a sampled word of 6 letters or more there is no model of
identifiers, and only base spans are found.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import bounded_sample, number_array, once, texts

# Base patterns, in this order; the group that must have at
# least so many characters.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
# The same matches where the length limit can go into the pattern: a run that
# is too short holds no longer one.
SEARCHED = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}

MARKOV = "markov"
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
IDENTIFIER = r"[A-Za-z_]{6,}"
SAMPLE = 1000
SMOOTHING = 0.5
THRESHOLD = 0.25

SPANS = "array<struct<start:int,no:int,end:int,kind:string>>"


def none() -> Column:
    return F.array().cast(SPANS)


def spans(text: Column, pattern: str, no: int, kind: str, fits) -> Column:
    """Spans of the matches that ``fits`` accepts.  Pieces and matches are
    computed once each; a text without a match costs one search."""
    def walk(both: Column) -> Column:
        found, pieces = both["found"], both["pieces"]
        return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), F.struct(F.lit(0).alias("at"), none().alias("out")), lambda acc, i: once(
            F.struct((acc["at"] + F.char_length(F.get(pieces, i))).alias("start"), F.get(found, i).alias("m")),
            lambda x: F.struct((x["start"] + F.char_length(x["m"])).alias("at"), F.when(fits(x["m"]), F.concat(acc["out"], F.array(F.struct(
                x["start"].alias("start"), F.lit(no).alias("no"), (x["start"] + F.char_length(x["m"])).alias("end"), F.lit(kind).alias("kind")))))
                .otherwise(acc["out"]).alias("out"))))["out"]

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("pieces"))
    return F.when(F.regexp_like(text, F.lit(pattern)), once(both, walk)).otherwise(none())


def base_spans(text: Column) -> Column:
    parts = []
    for no, (kind, pattern, group, least) in enumerate(KINDS):
        if kind in SEARCHED:
            s = spans(text, SEARCHED[kind], no, kind, lambda m: F.lit(True))
            parts.append(F.when(F.contains(text, F.lit("AKIA")), s).otherwise(none()) if kind == "access" else s)
        else:
            parts.append(spans(text, pattern, no, kind, lambda m, p=pattern, g=group, n=least:
                               F.char_length(F.regexp_extract(m, p, g)) >= n))
    return F.array_sort(F.concat(*parts))


def pairs(token: Column) -> Column:
    """Codes of the consecutive characters of an ASCII token."""
    return once(F.transform(F.split(token, ""), lambda c: F.ascii(c)), lambda cs: F.transform(
        F.slice(cs, 2, F.greatest(F.char_length(token) - 1, F.lit(0))), lambda c, i: F.get(cs, i) * 128 + c))


def samples(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``(random, token)``: labelled strings of a bounded number of documents."""
    own = texts(docs).where("text is not null")
    own = bounded_sample(own, own.count(), sample, "secrets-sample")
    cut = own.select("text", F.concat(*[F.regexp_extract_all("text", F.lit(SEARCHED.get(k, p)), F.lit(g)) for k, p, g, _ in KINDS]).alias("hits"))
    digest = F.sha2("text", 256)
    drawn = F.array(digest, F.conv(F.substring(digest, 1, 15), 16, 36), F.conv(F.substring(digest, 16, 15), 16, 36),
                    F.regexp_replace(F.base64(F.unhex(digest)), "=+$", ""), F.lower(F.conv(F.substring(digest, 31, 15), 16, 36)))
    ordinary = F.regexp_extract_all(F.regexp_replace(F.regexp_replace("text", KINDS[0][1], " "), r"AKIA[A-Z0-9]+|[0-9a-f]{16,}", " "),
                                    F.lit(IDENTIFIER), F.lit(0))
    return cut.select(F.lit(True).alias("random"), F.explode(F.concat("hits", drawn)).alias("token")).where(
        F.char_length("token") >= 12).unionByName(cut.select(F.lit(False).alias("random"), F.explode(ordinary).alias("token")))


def train(labelled: DataFrame) -> list[float] | None:
    """Log-likelihood ratio of random to ordinary for each pair of characters;
    None without samples of both kinds."""
    counts = labelled.where(F.char_length("token") >= 2).select("random", F.explode(pairs(F.col("token"))).alias("pair")).groupBy(
        "random", "pair").count().collect()  # at most 2 x 128 x 128 rows
    seen: dict[bool, dict[int, int]] = {True: {}, False: {}}
    for r in counts:
        seen[r["random"]][r["pair"]] = r["count"]
    if not seen[True] or not seen[False]:
        return None
    symbols = [c for c in range(128) if chr(c).isalnum() or chr(c) in "+/_=-."]

    def logs(of: dict[int, int]) -> dict[int, float]:
        out = {}
        for a in symbols:
            total = sum(of.get(a * 128 + b, 0) for b in symbols) + SMOOTHING * len(symbols)
            for b in symbols:
                out[a * 128 + b] = math.log((of.get(a * 128 + b, 0) + SMOOTHING) / total)
        return out

    random, ordinary = logs(seen[True]), logs(seen[False])
    return [random[k] - ordinary[k] if k in random else 0.0 for k in range(128 * 128)]


def ratio(token: Column, table: Column) -> Column:
    """Mean log-likelihood ratio a pair of characters."""
    return F.aggregate(pairs(token), F.lit(0.0), lambda acc, k: acc + F.get(table, k)) / (F.char_length(token) - 1)


def find_secrets(docs: DataFrame, model: list[float] | None, threshold: float = THRESHOLD, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``(doc_id, base, added)``: spans ``(start, no, end, kind)`` of each row,
    sorted, of the base patterns and of the Markov models."""
    own = texts(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    base = own.select("doc_id", "text", base_spans(F.col("text")).alias("base"))
    if model is None:
        return base.select("doc_id", "base", none().alias("added"))
    table = number_array(model)
    hits = F.filter(F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)), lambda t: ratio(t, table) >= threshold)
    scored = base.withColumn("hits", hits)
    placed = F.when(F.size("hits") > 0, spans(F.col("text"), CANDIDATE, len(KINDS), MARKOV, lambda m: F.array_contains("hits", m))).otherwise(none())
    scored = scored.select("doc_id", "base", placed.alias("found"))
    return scored.select("doc_id", "base", F.filter("found", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (
        s["start"] < b["end"]))).alias("added"))


def joined(of: Column) -> Column:
    return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(found: DataFrame) -> DataFrame:
    def n(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select("doc_id", *[n(k).alias(f"n_{k}") for k, *_ in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
                        joined(F.array_sort(F.concat("base", "added"))).alias("spans"))


def scan_secrets(docs: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    return find_secrets(docs, train(samples(docs, sample)), threshold)
