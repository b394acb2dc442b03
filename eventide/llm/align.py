"""Cross-tokenizer alignment by merge-path partitioning.

Two tokenizers cut the same bytes (a space and the text): A is a byte-level BPE,
B a SentencePiece BPE that adds the space itself.  Byte offsets where a token of
both ends are the cuts; between two cuts lies a group of A and B tokens.

1. Each document is tokenised where it lies (texts over ``WINDOW`` characters in
   parts that neither tokenizer looks across).
2. The ends of a batch of documents are two rising sequences.  Their merge is
   divided into pieces of ``WORK`` ends: a binary search on each diagonal finds how
   many of the first d merged ends are A's.  Each piece finds its own common
   ends; an end of A and its equal in B that fall into neighbouring pieces are
   joined afterwards, and groups are stitched from cut to cut over
   the pieces.  One long document is many pieces, short ones share one.
3. A cut links the A and the B token that end there.  Links are counted in
   each document, then over the corpus by a Spark aggregate.
4. Counts go back to the documents: pairs with at least one in ``HEAD`` of all
   links (at most ``HEAD`` pairs, by counting) are broadcast; the rest, none of
   which is frequent, meet the documents' leftovers in a shuffled join.

Edge cases: null and empty texts, and texts whose joined A or B bytes differ from
space + text, have no tokens: zeros, and an empty ``groups_sha256``; strings of
special tokens inside texts are plain text; rows that share an id or a text each
get a row (rows are told apart by their place, and each row's links count);
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import as_bytes, saved, texts

WINDOW = 1 << 20  # characters of a text that are tokenised at a time
WORK = 1 << 16  # ends of both tokenizers in a piece of the merge
TOKENS = 1 << 19  # tokens of a batch of documents, but for one long document
HEAD = 131_072  # a broadcast pair has one in so many of all links
ID_BITS = 22  # token ids are below 2^22
NOTED = 1 << 18  # tokens of a document whose decimal ids are joined at a time

# Fixed value: the pattern by which the byte-level tokenizer splits text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

SAFE = re.compile(r"(?<=[0-9A-Za-z]) (?=[0-9A-Za-z])")  # both tokenizers start a token with this space

LINKS = "link_a array<int>, link_b array<int>, link_n array<int>"


def byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 characters stand for their own
    bytes, the other bytes follow from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    def __init__(self, raw_a: bytes, raw_b: bytes) -> None:
        import sentencepiece
        import tiktoken
        spec = json.loads(raw_a)
        letters = byte_alphabet()
        ids = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items()
               if t not in {a["content"] for a in spec["added_tokens"]}}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        made = [ids[bytes(letters[c] for c in a + b)] for a, b in pairs]
        if spec["normalizer"] or spec["pre_tokenizer"] != {
                "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} or made != sorted(made):
            raise ValueError("not a byte-level vocabulary whose ids rise with the merges")
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ids, special_tokens={}).encode_ordinary
        self.bytes_a = [b""] * (1 + max(ids.values()))
        for t, i in ids.items():
            self.bytes_a[i] = t
        self.b = sentencepiece.SentencePieceProcessor(model_proto=raw_b)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(names)]
        # no piece holds a space behind another character: nothing merges across a safe place
        self.windowed = not any("▁" in p.lstrip("▁") for p in names)
        self.len_a, self.len_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        if max(len(self.bytes_a), len(self.bytes_b)) >= 1 << ID_BITS:
            raise ValueError("more token ids than expected")

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A and B of a whole text; none if their bytes are not space + text."""
        ids_a, ids_b = [], []
        for part in windows(text) if self.windowed else [text]:
            a, b = self.a(" " + part), self.b.encode(part)
            whole = (" " + part).encode()
            if b"".join(map(self.bytes_a.__getitem__, a)) != whole or b"".join(map(self.bytes_b.__getitem__, b)) != whole:
                return NONE, NONE
            ids_a.append(np.array(a, np.int32))
            ids_b.append(np.array(b, np.int32))
        return np.concatenate(ids_a), np.concatenate(ids_b)


NONE = np.zeros(0, np.int32)


def windows(text: str) -> Iterator[str]:
    """A long text in parts; the space between two parts belongs to neither."""
    at = 0
    while len(text) - at > WINDOW and (m := SAFE.search(text, at + WINDOW)):
        yield text[at:m.start()]
        at = m.end()
    yield text[at:] if at else text


@lru_cache(maxsize=2)
def tokenizers(raw_a: bytes, raw_b: bytes) -> Tokenizers:
    """A worker loads the vocabularies once."""
    return Tokenizers(raw_a, raw_b)


def diagonals(a: np.ndarray, b: np.ndarray, work: int) -> np.ndarray:
    """Where the merge of ``a`` and ``b`` (A first among equals) is divided: the
    number of A's ends among the first 0, work, 2 work, ... merged ones."""
    d = np.append(np.arange(0, len(a) + len(b), work), len(a) + len(b))
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        first = np.zeros(len(d), bool)
        first[open_] = a[mid[open_]] <= b[d[open_] - mid[open_] - 1]
        low, high = np.where(open_ & first, mid + 1, low), np.where(open_ & ~first, mid, high)
    return low


def common_ends(a: np.ndarray, b: np.ndarray, work: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indices in ``a`` and ``b`` (both strictly rising) of their common values."""
    work = work or WORK
    cut_a = diagonals(a, b, work)
    cut_b = np.append(np.arange(0, len(a) + len(b), work), len(a) + len(b)) - cut_a
    at_a, at_b = [], []
    for i0, i1, j0, j1 in zip(cut_a, cut_a[1:], cut_b, cut_b[1:]):
        mine, other = a[i0:i1], b[j0:j1]
        if len(mine) and len(other):
            j = np.searchsorted(other, mine)
            hit = np.flatnonzero(other[np.minimum(j, len(other) - 1)] == mine)
            at_a.append(i0 + hit)
            at_b.append(j0 + j[hit])
        if i1 and j1 < len(b) and a[i1 - 1] == b[j1]:  # equals on both sides of the boundary
            at_a.append(np.array([i1 - 1]))
            at_b.append(np.array([j1]))
    return (np.concatenate(at_a), np.concatenate(at_b)) if at_a else (np.zeros(0, np.int64),) * 2


def offsets(sizes) -> np.ndarray:
    out = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    return out


def align_batch(tok: Tokenizers, keys: list, of: list[tuple[np.ndarray, np.ndarray]], kind: pa.DataType) -> pa.RecordBatch:
    off_a, off_b = offsets([len(a) for a, _ in of]), offsets([len(b) for _, b in of])
    a, b = (np.concatenate(x) if of else NONE for x in zip(*of))
    at_a, at_b = common_ends(np.cumsum(tok.len_a[a]), np.cumsum(tok.len_b[b]))
    row = np.searchsorted(off_a, at_a, side="right") - 1  # a document's last byte is a cut, so no group leaves it
    off_g = np.searchsorted(row, np.arange(len(of) + 1)).astype(np.int32)
    lists = [(off_a, a), (off_b, b), (off_g, at_a + 1 - off_a[row]), (off_g, at_b + 1 - off_b[row])]
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, kind), *(pa.ListArray.from_arrays(o.astype(np.int32), v.astype(np.int32)) for o, v in lists)],
        names=["doc_id", "a_ids", "b_ids", "a_cuts", "b_cuts"])


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, a_ids, b_ids, a_cuts, b_cuts``; group
    g holds A tokens ``a_cuts[g-1]`` to ``a_cuts[g] - 1`` and B's likewise."""
    body = as_bytes(texts(docs, id_col, text_col))
    raw = []
    for path in (path_a, path_b):
        with open(path, "rb") as f:
            raw.append(docs.sparkSession.sparkContext.broadcast(f.read()))  # vocabularies: a few MB

    def run(batches):
        tok = tokenizers(raw[0].value, raw[1].value)
        for batch in batches:
            kind, keys, of, held = batch.schema.field(0).type, [], [], 0
            for key, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = x.as_buffer().to_pybytes().decode("utf-8", "replace") if x.is_valid else ""
                of.append(tok.tokens(text) if text else (NONE, NONE))
                keys.append(key)
                held += len(of[-1][0]) + len(of[-1][1])
                if held >= TOKENS:
                    yield align_batch(tok, keys, of, kind)
                    keys, of, held = [], [], 0
            if keys:
                yield align_batch(tok, keys, of, kind)

    return body.mapInArrow(run, f"doc_id {dict(body.dtypes)['doc_id']}, a_ids array<int>, b_ids array<int>, "
                                "a_cuts array<int>, b_cuts array<int>")


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and values of an Arrow list column."""
    off = column.offsets.to_numpy().astype(np.int64)
    return off - off[0], column.values.to_numpy(zero_copy_only=False)[off[0]:off[-1]]


def notation(a, b, end_a, end_b, off_g, off_a, off_b, table) -> list[str]:
    """Each document's groups, ``a1,a2|b1;a3|b2,b3``, as a SHA-256 digest; empty without groups.

    Every token's place in the text of its document follows from the sizes of the
    groups before it; ``table`` has each id with each separator."""
    n_a, n_b = (np.diff(e, prepend=0) for e in (end_a, end_b))
    code = np.empty(len(a) + len(b), np.int64)
    sep = np.zeros(len(a), np.int64)
    sep[end_a - 1] = 1
    code[np.arange(len(a)) + np.repeat(end_b - n_b, n_a)] = a.astype(np.int64) * 3 + sep
    sep = np.zeros(len(b), np.int64)
    sep[end_b - 1] = 2
    code[np.arange(len(b)) + np.repeat(end_a, n_b)] = b.astype(np.int64) * 3 + sep
    out = []
    for k in range(len(off_g) - 1):
        lo, hi = off_a[k] + off_b[k], off_a[k + 1] + off_b[k + 1]
        if off_g[k] == off_g[k + 1]:
            out.append("")
            continue
        h = hashlib.sha256()
        for i in range(lo, hi, NOTED):
            said = b"".join(map(table.__getitem__, code[i:min(hi, i + NOTED)].tolist()))
            h.update(said[:-1] if i + NOTED >= hi else said)
        out.append(h.hexdigest())
    return out


def linked(aligned: DataFrame) -> DataFrame:
    """Sizes, the digest of the groups, and each document's distinct linked
    pairs with their numbers (``link_a, link_b, link_n``)."""
    def run(batches):
        table: list[bytes] = []
        for whole in batches:
            step = max(1, whole.num_rows // (1 + whole.nbytes // (16 * TOKENS)))
            for batch in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                (off_a, a), (off_b, b), (off_g, end_a), (_, end_b) = (flat(batch.column(i)) for i in range(1, 5))
                n = batch.num_rows
                top = int(max(a.max(initial=0), b.max(initial=0)))
                for i in range(len(table) // 3, top + 1):
                    table += [b"%d," % i, b"%d|" % i, b"%d;" % i]
                row = np.repeat(np.arange(n), np.diff(off_g))
                end_a, end_b = end_a + off_a[row], end_b + off_b[row]
                digests = notation(a, b, end_a, end_b, off_g, off_a, off_b, table)
                link = row << 2 * ID_BITS | a[end_a - 1].astype(np.int64) << ID_BITS | b[end_b - 1].astype(np.int64)
                link, count = np.unique(link, return_counts=True)
                off_l = np.searchsorted(link >> 2 * ID_BITS, np.arange(n + 1)).astype(np.int32)
                low = (1 << ID_BITS) - 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(np.diff(o)) for o in (off_a, off_b, off_g)), pa.array(digests, pa.string()),
                     *(pa.ListArray.from_arrays(off_l, v.astype(np.int32)) for v in (link >> ID_BITS & low, link & low, count))],
                    names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "link_a", "link_b", "link_n"])

    return aligned.mapInArrow(run, f"doc_id {dict(aligned.dtypes)['doc_id']}, n_a long, n_b long, n_groups long, "
                                   f"groups_sha256 string, {LINKS}")


def pair_counts(rows: DataFrame) -> DataFrame:
    """``(a, b, n, best)``: corpus-wide number of links of each pair, and
    whether no other pair of that B token has more."""
    each = rows.select(F.explode(F.arrays_zip("link_a", "link_b", "link_n")).alias("l"))
    counts = saved(each.groupBy(F.col("l.link_a").alias("a"), F.col("l.link_b").alias("b")).agg(
        F.sum("l.link_n").alias("n")), "align-pairs")
    top = F.broadcast(counts.groupBy("b").agg(F.max("n").alias("most")))  # a row for each id of B
    return counts.join(top, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def with_counts(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """``place, n_best, count_sum`` of each row of ``rows``."""
    total = pairs.agg(F.sum("n")).first()[0] or 0
    head = pairs.where(F.col("n") * HEAD >= total).toArrow()  # HEAD rows at most
    key = head["a"].to_numpy().astype(np.int64) << 32 | head["b"].to_numpy()
    order = np.argsort(key)
    key, n, best = key[order], head["n"].to_numpy()[order], head["best"].to_numpy()[order].astype(np.int64)

    def run(batches):
        for batch in batches:
            (off, a), (_, b), (_, links) = (flat(batch.column(i)) for i in range(1, 4))
            found = np.zeros(len(a), bool)
            sums = np.zeros((2, len(a) + 1), np.int64)
            if len(key):
                want = a.astype(np.int64) << 32 | b
                at = np.minimum(np.searchsorted(key, want), len(key) - 1)
                found = key[at] == want
                sums[0, 1:] = np.cumsum(np.where(found, links * best[at], 0))
                sums[1, 1:] = np.cumsum(np.where(found, links * n[at], 0))
            left = offsets(~found)[off].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(s[off[1:]] - s[off[:-1]]) for s in sums),
                 *(pa.ListArray.from_arrays(left, v[~found]) for v in (a, b, links))],
                names=["place", "n_best", "count_sum", "link_a", "link_b", "link_n"])

    done = rows.select("place", "link_a", "link_b", "link_n").mapInArrow(
        run, f"place long, n_best long, count_sum long, {LINKS}")
    rare = done.select("place", F.explode(F.arrays_zip("link_a", "link_b", "link_n")).alias("l")).select(
        "place", F.col("l.link_a").alias("a"), F.col("l.link_b").alias("b"), F.col("l.link_n").alias("links"))
    rare = rare.join(pairs.where(F.col("n") * HEAD < total), ["a", "b"]).select(
        "place", F.when(F.col("best"), F.col("links").cast("long")).otherwise(0).alias("n_best"),
        (F.col("links") * F.col("n")).alias("count_sum"))
    return done.select("place", "n_best", "count_sum").unionByName(rare).groupBy("place").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def link_report(aligned: DataFrame) -> DataFrame:
    """Sizes, link counts and digests of ``align``'s rows."""
    rows = saved(linked(aligned).withColumn("place", F.monotonically_increasing_id()), "align-rows")
    pairs = saved(pair_counts(rows), "align-counts")
    return rows.join(with_counts(rows, pairs), "place").select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
