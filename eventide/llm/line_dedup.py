"""Line dedup: range-partitioned hashes, first occurrences streamed, bitmaps.

1. Each document is split into lines where it lies; a line whose key (stripped
   of ASCII white space, A-Z lower-cased) has at least ``min_chars`` code points
   gives ``(128-bit hash of the key, document, place)``.  No text is moved.
2. These rows are range-partitioned and sorted by (hash, document, place).  The
   range is over all three, so a line that a third of the rows share is dealt
   over many partitions.
3. Each partition streams its rows in order.  A run of one hash keeps the rows
   of its first document; rows of later documents are dropped.  The
   first and the last run of a partition may go on in its neighbours: their
   (hash, smallest, largest document), two rows a partition, are gathered first.
4. Dropped places are grouped by document into a compressed keep bitmap.

Ids may be of any type: they are compared as bytes that sort as the ids do (whole
numbers by value, strings by code point, other types by their text).

Edge cases: null and empty texts are one empty line; a null id counts as one
document after all others; rows that share id and text are one document and
each get a row; rows that share only the id are one document for the choice of lines
too, but have bitmaps of their own; a key within one document only keeps all its lines;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.llm.common import LOWER, fresh, quoted, text_hash, texts
from eventide.session import ensure_checkpoint_dir

MIN_CHARS = 10

KEYS = "key binary, owner binary, h long, place int"


def owner_key(doc_id: Column, kind: str) -> Column:
    """The id as bytes in the order of ids; a null id comes last."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        flipped = doc_id.cast("long").bitwiseXOR(F.lit(-2**63))  # negative numbers first
        value = F.unhex(F.lpad(F.hex(flipped), 16, "0"))
    else:
        value = F.encode(doc_id.cast("string"), "UTF-8")
    return F.when(doc_id.isNull(), F.unhex(F.lit("01"))).otherwise(F.concat(F.unhex(F.lit("00")), value))


def line_key(line: bytes) -> bytes:
    return line.strip().translate(LOWER)


def long_enough(key: bytes, min_chars: int) -> bool:
    # a UTF-8 byte 10xxxxxx continues a code point
    return len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars)


def bitmap(n: int, dropped: np.ndarray) -> bytes:
    """n keep bits, place 0 first, zlib-compressed."""
    keep = np.ones(n, np.uint8)
    keep[dropped] = 0
    return zlib.compress(np.packbits(keep).tobytes(), 6)


def keep_bits(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8), count=n).astype(bool)


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """``(key, owner, h, place)`` of each line whose key is long enough."""
    def split(batches):
        for batch in batches:
            keys, at, places = [], [], []
            for i, x in enumerate(batch.column(2)):
                for place, line in enumerate((x.as_py() or b"").split(b"\n")):
                    key = line_key(line)
                    if long_enough(key, min_chars):
                        keys.append(xxhash.xxh3_128_digest(key))
                        at.append(i)
                        places.append(place)
            where = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), batch.column(0).take(where), batch.column(1).take(where),
                 pa.array(places, pa.int32())], names=["key", "owner", "h", "place"])

    return docs.select("owner", "h", F.col("text").cast("binary").alias("body")).mapInArrow(split, KEYS)


def _runs(batch) -> tuple[list[int], list[bytes], list[bytes]]:
    """Starts of the runs of equal keys in a sorted batch, the keys, the owners."""
    keys, owners = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    return [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1])], keys, owners


def _edges(batches):
    """A partition's first and last run: key, smallest and largest owner."""
    open_key, low, high, first = None, b"", b"", None
    for batch in batches:
        if not batch.num_rows:
            continue
        starts, keys, owners = _runs(batch)
        for s, e in zip(starts, [*starts[1:], len(keys)]):
            if keys[s] != open_key:
                if first is None and open_key is not None:
                    first = (open_key, low, high)
                open_key, low = keys[s], owners[s]
            high = owners[e - 1]
    rows = [] if open_key is None else [(open_key, low, high)] if first is None else [first, (open_key, low, high)]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()),
                                      pa.array([r[2] for r in rows], pa.binary())], names=["key", "low", "high"])


def drops(hashes: DataFrame, partitions: int) -> DataFrame:
    """``(owner, h, place)`` of each line that goes.  The sorted rows are
    checkpointed: both passes over them must see the same partitions."""
    ensure_checkpoint_dir(hashes.sparkSession)
    ordered = hashes.repartitionByRange(partitions, "key", "owner", "place").sortWithinPartitions("key", "owner", "place")
    return stream_drops(ordered.checkpoint())


def stream_drops(ordered: DataFrame) -> DataFrame:
    """The drops of rows that each partition holds in order, whatever the cut
    between partitions is."""
    edges: dict[bytes, tuple[bytes, bytes]] = {}
    for r in ordered.mapInArrow(_edges, "key binary, low binary, high binary").groupBy("key").agg(
            F.min("low").alias("low"), F.max("high").alias("high")).toLocalIterator():
        edges[bytes(r.key)] = (bytes(r.low), bytes(r.high))
    shared = ordered.sparkSession.sparkContext.broadcast(edges)

    def stream(batches):
        known, open_key, owner = shared.value, None, b""
        for batch in batches:
            if not batch.num_rows:
                continue
            starts, keys, owners = _runs(batch)
            go = [False] * len(keys)
            for s, e in zip(starts, [*starts[1:], len(keys)]):
                if keys[s] != open_key:
                    open_key = keys[s]
                    owner = known[open_key][0] if open_key in known else owners[s]
                if e - s > 1 or owners[s] != owner:
                    go[s:e] = [x != owner for x in owners[s:e]]
            mask = pa.array(go, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(mask) for i in (1, 2, 3)], names=["owner", "h", "place"])

    return ordered.mapInArrow(stream, "owner binary, h long, place int")


def line_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, partitions: int | None = None, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``(owner, h, n_dropped, n_bits, keep)`` of the documents that lose lines:
    the compressed keep bitmap covers the lines up to the last dropped
    one (``n_bits``); later lines stay."""
    own = texts(docs, id_col, text_col)
    own = own.select(owner_key(F.col("doc_id"), dict(own.dtypes)["doc_id"]).alias("owner"), text_hash().alias("h"), "text")
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    gone = drops(line_hashes(own, min_chars), n).groupBy("owner", "h").agg(F.collect_set("place").alias("places"))

    def pack(batches):
        for batch in batches:
            sets = [np.sort(np.array(x.as_py(), np.int64)) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([int(s[-1]) + 1 for s in sets], pa.int64()),
                 pa.array([bitmap(int(s[-1]) + 1, s) for s in sets], pa.binary())],
                names=["owner", "h", "n_dropped", "n_bits", "keep"])

    return gone.mapInArrow(pack, "owner binary, h long, n_dropped long, n_bits long, keep binary")


def kept_text(text: bytes, n_bits: int | None, keep: bytes | None) -> tuple[int, bytes]:
    """Number of lines before, and the text of the lines that stay."""
    lines = text.split(b"\n")
    if not n_bits:
        return len(lines), text
    bits = keep_bits(keep, n_bits)
    return len(lines), b"\n".join([x for i, x in enumerate(lines) if i >= n_bits or bits[i]])


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> tuple[DataFrame, list[str]]:
    """All columns of ``docs`` and, last, three of the bitmap; their names."""
    cols = docs.columns
    names = fresh(cols, "n_dropped", "n_bits", "keep")
    owner, h = fresh([*cols, *names], "owner", "h")
    maps = bitmaps.select(F.col("owner").alias(owner), F.col("h").alias(h),
                          *[F.col(x).alias(y) for x, y in zip(("n_dropped", "n_bits", "keep"), names)])
    on = (owner_key(docs["doc_id"], dict(docs.dtypes)["doc_id"]) == maps[owner]) & (text_hash(docs["text"]) == maps[h])
    return docs.join(maps, on, "left").select(*[docs[quoted(c)] for c in cols], *names), names


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, kept)`` of each document row."""
    joined, _ = with_bitmaps(texts(docs), bitmaps)
    joined = joined.select("doc_id", F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"), "n_bits", "keep",
                           F.col("text").cast("binary").alias("body"))

    def keep(batches):
        for batch in batches:
            done = [kept_text(b.as_py() or b"", n.as_py(), k.as_py())
                    for b, n, k in zip(batch.column(4), batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([d[0] for d in done], pa.int64()), batch.column(1),
                 pa.array([d[1] for d in done], pa.binary())], names=["doc_id", "n_lines", "n_dropped", "kept"])

    return joined.mapInArrow(keep, f"doc_id {dict(joined.dtypes)['doc_id']}, n_lines long, n_dropped long, kept binary")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the kept lines as text and, where lines went, their length
    as ``n_chars``; columns and rows as given."""
    cols = docs.columns
    joined, (_, n_bits, keep) = with_bitmaps(docs, line_bitmaps(docs, min_chars))
    at = cols.index("text")
    sent = joined.select(*[F.col("text").cast("binary").alias("text") if c == "text" else F.col(quoted(c)) for c in cols],
                         F.col(n_bits).alias(n_bits), F.col(keep).alias(keep))

    def shorten(batches):
        for batch in batches:
            *given, bits, keeps = batch.columns
            given[at] = pa.array([None if (x := b.as_py()) is None else kept_text(x, n.as_py(), k.as_py())[1]
                                  for b, n, k in zip(given[at], bits, keeps)], pa.binary())
            yield pa.RecordBatch.from_arrays([*given, bits], names=[*cols, n_bits])

    schema = T.StructType([T.StructField("text", T.BinaryType()) if f.name == "text" else f for f in docs.schema]
                          + [T.StructField(n_bits, T.LongType())])
    done = sent.mapInArrow(shorten, schema).withColumn("text", F.col("text").cast("string"))
    if "n_chars" in cols:
        done = done.withColumn("n_chars", F.when(F.col(n_bits).isNull(), F.col("n_chars")).otherwise(
            F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return done.select(*map(quoted, cols))
