"""SimHash near-dedup with bit-sliced comparison.

1. **Fingerprints** (a map over whole texts): lower-cased words, word shingles,
   XXH64 with seed 42; a bit of the fingerprint is 1 if it is set in
   over half of the shingles' hashes.
2. **Nodes**: distinct fingerprints with their smallest document; groups of
   exact copies, however large, shrink to one row by partial aggregation.
3. **Candidates**: the 64 bits are cut into ``radius + 2`` bands; two
   fingerprints within the radius agree in at least two of them, so each node
   goes to one bucket for each pair of bands (32 bits for radius 2).  A
   bucket of more than ``BUCKET`` nodes is dealt anew by the same rule on the bits
   that it does not share yet; after that 48 bits agree, so it holds
   at most 65,536 nodes, whatever the data.
4. **Bit-sliced comparison**: the nodes of many buckets lie side by side; plane
   j holds bit j of 64 nodes a word.  For each shift s all nodes are compared with their
   s-th successor at once: the XOR of plane and shifted plane goes into a
   carry-save counter (ones, twos, over), and words of 64 comparisons
   are abandoned once every lane is over the radius or outside its bucket.
   Links found are contracted inside the task: what leaves it is one link a node.
5. **Components** of the links by alternating large-star and small-star steps.

Edge cases: null and empty texts have fingerprint zero and are linked like any
other; fewer words than a shingle are one shingle; equal rows each get a row;
a null id never becomes a representative unless its component has no
other; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import LOWER, dropped, fresh, quoted, saved, text_hash, texts

SHINGLE = 3
RADIUS = 2
SEED = 42
# Nodes that are compared with each other in one bucket; larger ones are split.
BUCKET = 4096
# Share of all rows from which a fingerprint is hot, and the keys that its rows are dealt over.
HOT = 1024
SALTS = 64
# Shingles hashed at a time, rows compared at a time.
PIECE = 1 << 16


def shingles_of(words: list[bytes], size: int):
    """The text's shingles as slices of one byte string."""
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [joined[a:b] for a, b in zip(starts[:len(words) - size + 1].tolist(), ends[size - 1:].tolist())]


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    parts = shingles_of(text.translate(LOWER).split(), size) if text else []
    if not parts:
        return 0
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for i in range(0, len(parts), PIECE):
        raw = b"".join([digest(p, SEED) for p in parts[i:i + PIECE]])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(parts)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, h, fp)`` of each row; ``fp`` is the 64 bits as a long."""
    body = texts(docs, id_col, text_col).select("doc_id", text_hash().alias("h"), F.col("text").cast("binary").alias("body"))

    def run(batches):
        for batch in batches:
            fps = [fingerprint(x.as_py(), shingle) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())],
                                             names=["doc_id", "h", "fp"])

    return body.mapInArrow(run, f"doc_id {dict(body.dtypes)['doc_id']}, h long, fp long")


def bands(bits: list[int], n: int) -> list[list[int]]:
    """``bits`` cut into n runs of nearly equal length."""
    cuts = [len(bits) * i // n for i in range(n + 1)]
    return [bits[a:b] for a, b in zip(cuts, cuts[1:])]


def mask_of(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


def tables_of(radius: int) -> list[tuple[list[int], list[list[int]]]]:
    """For each pair of bands: its bits, and for a further split the pairs
    of bands of the other bits."""
    out = []
    for two in combinations(bands(list(range(64)), radius + 2), 2):
        first = two[0] + two[1]
        rest = [b for b in range(64) if b not in first]
        out.append((first, [a + b for a, b in combinations(bands(rest, radius + 2), 2)]))
    return out


def _bucket(no: int, bits: list[int], fp: str = "fp") -> Column:
    return F.struct(F.lit(no).alias("no"), F.col(fp).bitwiseAND(F.lit(mask_of(bits))).alias("at"))


def buckets(nodes: DataFrame, radius: int, bucket: int) -> DataFrame:
    """``(no, at, fp)``: every node in its buckets, large ones split."""
    tables = tables_of(radius)
    dealt = nodes.select("fp", F.explode(F.array(*[_bucket(k, bits) for k, (bits, _) in enumerate(tables)])).alias("b")).select(
        F.col("b.no").alias("no"), F.col("b.at").alias("at"), "fp")
    large = dealt.groupBy("no", "at").count().where(F.col("count") > bucket).select(
        F.col("no").alias("no2"), F.col("at").alias("at2"))
    per = len(tables[0][1])
    split = F.when(F.col("no2").isNull(), F.array(F.struct("no", "at")))
    for k, (bits, subs) in enumerate(tables):
        split = split.when(F.col("no") == k, F.array(*[
            _bucket(len(tables) + k * per + j, bits + sub) for j, sub in enumerate(subs)]))
    return dealt.join(large, (dealt["no"] == large["no2"]) & (dealt["at"] == large["at2"]), "left").select(
        F.explode(split).alias("b"), "fp").select(F.col("b.no").alias("no"), F.col("b.at").alias("at"), "fp")


def _lanes(bits: np.ndarray) -> np.ndarray:
    """Bits along the last axis packed 64 to a word, the first lowest."""
    n = bits.shape[-1]
    wide = np.zeros((*bits.shape[:-1], -(-n // 64) * 64), np.uint8)
    wide[..., :n] = bits
    return np.packbits(wide, axis=-1, bitorder="little").view("<u8")


def within(planes: np.ndarray, valid: np.ndarray, s: int, radius: int) -> np.ndarray:
    """Lanes i among ``valid`` whose distance to lane i + s is at most the
    radius (under 4), as words of 64 lanes."""
    words = np.flatnonzero(valid)
    out = np.zeros_like(valid)
    if not len(words):
        return out
    ahead, bit = words + s // 64, s % 64
    width = planes.shape[1]
    one, two = np.minimum(ahead, width - 1), np.minimum(ahead + 1, width - 1)
    ones = np.zeros(len(words), np.uint64)
    twos, over, live = ones.copy(), ~valid[words], words
    for j in range(planes.shape[0]):
        row = planes[j]
        other = row[one] >> np.uint64(bit)
        if bit:
            other |= row[two] << np.uint64(64 - bit)
        d = row[live] ^ other
        carry = ones & d
        ones ^= d
        over |= twos & carry
        twos ^= carry
        if radius < 3:
            # a count is over the radius if it is 3 (radius 2), 2 (1) or 1 (0)
            over |= ones & twos if radius == 2 else twos if radius == 1 else ones | twos
        if j % 4 == 3:  # abandon the words in which every lane is over
            some = over != np.uint64(0xFFFFFFFFFFFFFFFF)
            if not some.all():
                live, one, two = live[some], one[some], two[some]
                ones, twos, over = ones[some], twos[some], over[some]
                if not len(live):
                    return out
    out[live] = ~over
    return out


def contract(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[i] and b[i]; label[x] is the root of x's set, the smallest."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def links_of(group: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) among rows sorted by bucket number ``group``: every
    row's component within its bucket by distances up to the radius."""
    n = len(fp)
    label = np.arange(n)
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.concatenate((starts, [n])))
    rest = np.arange(n)[np.repeat(sizes > 1, sizes)]
    size_of = np.repeat(sizes, sizes)
    shift, planes = 1, None
    while len(rest):
        if planes is None:
            g, x = group[rest], fp[rest].view(np.uint64)
            bits = np.unpackbits(x.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            planes = _lanes(np.ascontiguousarray(bits.T))
        valid = np.zeros(len(rest), np.uint8)
        valid[:-shift] = g[:-shift] == g[shift:]
        hit = within(planes, _lanes(valid), shift, radius)
        where = np.flatnonzero(hit)
        if len(where):
            lanes = np.unpackbits(hit[where].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, lane = np.nonzero(lanes)
            i = where[row] * 64 + lane
            contract(label, rest[i], rest[i + shift])
        shift += 1
        keep = size_of[rest] > shift
        if keep.sum() * 2 <= len(rest):  # leave the buckets that this shift goes beyond
            rest, planes = rest[keep], None
    moved = np.flatnonzero(label != np.arange(n))
    return fp[moved], fp[label[moved]]


def links(nodes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """``(u, v)``: links between distinct fingerprints whose components are
    those of all pairs within the radius."""
    if not 0 <= radius <= 3:
        raise ValueError("the radius must be 0 to 3")
    dealt = buckets(nodes, radius, bucket)
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        count = 0

        def flush(last: bool):
            nonlocal held, count
            no, at, fp = (np.concatenate(c) for c in zip(*held))
            new = np.concatenate(([True], (no[1:] != no[:-1]) | (at[1:] != at[:-1])))
            cut = len(fp) if last else int(np.flatnonzero(new)[-1])
            u, v = links_of(np.cumsum(new[:cut]), fp[:cut], radius)
            held, count = [(no[cut:], at[cut:], fp[cut:])], len(fp) - cut
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            count += batch.num_rows
            if count >= PIECE:
                yield flush(False)
        if count:
            yield flush(True)

    return dealt.repartition(n, "no", "at").sortWithinPartitions("no", "at", "fp").mapInArrow(run, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of all nodes but the roots: each component's root is its
    smallest node.  Alternates large-star and small-star until the edges are
    stars; every step is a partial aggregate and a join on the node."""
    def stars(pairs: DataFrame, both: bool) -> DataFrame:
        """Of each node u: its neighbours (small: those below it) all point to
        the smallest of them or u."""
        if both:
            pairs = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u").alias("c"), F.least("u", "m").alias("m"))
        joined = pairs.join(least, pairs["u"] == least["c"])
        if both:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
                least.select(F.col("c").alias("u"), F.col("m").alias("v")))
        return out.where("u != v").distinct()

    def mark(pairs: DataFrame):
        return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    edges = saved(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "links")
    before = mark(edges)
    while before[0]:
        old, edges = edges, saved(stars(stars(edges, True), False), "stars")
        dropped(old)
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, bucket: int = BUCKET,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, h, fp, root, component_id)`` of each row: ``root`` names the
    component by its smallest fingerprint, ``component_id`` by the smallest
    id reachable by links of at most ``radius`` differing bits."""
    fps = saved(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    nodes = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    roots = components(links(nodes.select("fp", "least"), radius, bucket))
    with_root = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = with_root.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r")
    ids = with_root.join(smallest, with_root["root"] == smallest["r"]).select(F.col("fp").alias("f"), "root", "component_id")

    # fingerprints with one in HOT of all rows (at most HOT of them) are dealt over SALTS keys
    total = nodes.agg(F.sum("n")).first()[0] or 0
    hot = [r.fp for r in nodes.where((F.col("n") * HOT >= total) & (F.col("n") > SALTS)).select("fp").collect()]
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    rows = fps.withColumn("salt", F.when(F.col("fp").isin(hot), spread).otherwise(0))
    every = F.when(F.col("f").isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    ids = ids.withColumn("s", F.explode(every))
    return rows.join(ids, (rows["fp"] == ids["f"]) & (rows["salt"] == ids["s"])).select("doc_id", "h", "fp", "root", "component_id")


def report(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _identity(doc_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit(""))


def dedup_near(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component: the smallest id's (of rows that
    share it, the one with the smallest text hash, once); columns as given.

    The join and the removal of repeated rows have the same key, so texts are
    shuffled once."""
    cols = docs.columns
    d, h, own_d, own_h = fresh(cols, "d", "h", "own_d", "own_h")
    chosen = near_duplicates(docs, shingle, radius).groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "h")).alias("k")).select(
        _identity(F.col("k.doc_id")).alias(d), F.col("k.h").alias(h))
    keyed = docs.withColumn(own_d, _identity(docs["doc_id"])).withColumn(own_h, text_hash(docs["text"]))
    rows = keyed.join(chosen, (keyed[own_d] == chosen[d]) & (keyed[own_h] == chosen[h]), "left_semi")
    return rows.dropDuplicates([own_d, own_h]).select(*map(quoted, cols))
