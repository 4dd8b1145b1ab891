"""SimHash near-dedup with covering locality-sensitive hashing.

A fingerprint has 64 bits. For a radius r, every bit gets a vector of r + 1 bits, and each non-zero
vector v names a table that keeps the bits whose vectors are odd against v. Two fingerprints that
differ in r places or fewer miss at most r vectors, to all of which some v is even; in the table of v
they collide. So no link within the radius is lost.

Equal fingerprints are one node. A bucket of few nodes is compared in a task; a larger one is cut by
blocks of the bits in which its members still differ: r differing bits leave one of r + 1 blocks
equal, so again no link is lost, and buckets shrink until they are small. Components come from
contracting the links round by round.

Defined results: a text without words, or null, has the fingerprint 0 and is linked like any other.
Repeated rows are in one component. A null id never is a component's name unless all its ids are
null. An empty table gives an empty result. Columns of the input are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.llm.common import column, packed, stored, unpacked

# Shingle length, hash seed, and the number of differing bits that still links.
SHINGLE, SEED, RADIUS = 3, 42, 3
# members of a bucket that one task compares with one another
COMPARED_AT_ONCE = 512
# bits of a byte value, and all of them by lane
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint_text(text: bytes) -> int:
    """Unsigned 64-bit fingerprint of a UTF-8 text."""
    words = text.lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    if len(words) <= SHINGLE:
        parts = [b" ".join(words)]
    else:
        parts = [b"%b %b %b" % w for w in zip(words, words[1:], words[2:])]
    digest, n = xxhash.xxh64_intdigest, len(parts)
    hashes = np.fromiter([digest(p, SEED) for p in parts], np.uint64, n)
    lanes = hashes.view(np.uint8).reshape(n, 8).astype(np.int64) + 256 * np.arange(8)
    counts = np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BITS  # by byte and bit
    return sum(1 << int(b) for b in np.flatnonzero(2 * counts.ravel() > n))


@F.arrow_udf(T.LongType())
def _fingerprint(texts: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint_text(t or b"") for t in texts.to_pylist()], np.uint64).view(np.int64))


def fingerprint(text: Column) -> Column:
    """Fingerprint as a signed long of the same bits."""
    return _fingerprint(text.cast("binary"))


def masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """One mask a table: bit i stays for table v if the vector of i is odd against v.

    Vectors run evenly through the non-zero ones, so every table keeps about half of the bits.
    """
    vectors = [i % (2 ** (radius + 1) - 1) + 1 for i in range(bits)]
    odd = lambda x: bin(x).count("1") & 1
    return [sum(1 << i for i, p in enumerate(vectors) if odd(p & v)) for v in range(1, 2 ** (radius + 1))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def bucket_links(buckets: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within the radius, in rows that are sorted by bucket; rows are compared at growing distance."""
    left, right = [], []
    gap = 1
    alive = np.arange(len(values))
    while len(alive):
        alive = alive[alive + gap < len(values)]
        alive = alive[buckets[alive] == buckets[alive + gap]]
        near = np.bitwise_count(values[alive] ^ values[alive + gap]) <= radius
        left.append(values[alive[near]])
        right.append(values[alive[near] + gap])
        gap += 1
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def _compare(radius: int, most: int):
    """Links of small buckets; a batch may end within a bucket, whose at most ``most`` rows are carried on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_b, held_v = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def out(b: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
            x, y = bucket_links(b, v, radius)
            if len(x):
                ends = [pa.array(np.minimum(x, y).view(np.int64)), pa.array(np.maximum(x, y).view(np.int64))]
                yield pa.RecordBatch.from_arrays(ends, ["a", "b"])

        for batch in batches:
            b = np.concatenate([held_b, batch.column(0).to_numpy(zero_copy_only=False)])
            v = np.concatenate([held_v, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if not len(b):
                continue
            others = np.flatnonzero(b != b[-1])
            whole = others[-1] + 1 if len(others) else 0
            yield from out(b[:whole], v[:whole])
            held_b, held_v = b[whole:], v[whole:]
        yield from out(held_b, held_v)

    return run


def _block(bits: Column, j: int, n: int) -> Column:
    """Mask of every n-th of the bits, from the j-th on."""
    chosen = F.filter(bits, lambda x, i: i % n == j)
    return F.aggregate(chosen, F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(x))


def links(nodes: DataFrame, radius: int = RADIUS, most: int = COMPARED_AT_ONCE) -> DataFrame:
    """(a, b): enough pairs of distinct fingerprints ``f`` within the radius to connect all that are linked.

    Every pair of a compared bucket within the radius is there; where the members of a bucket differ in
    so few bits that all are linked, each is linked with the smallest.
    """
    tables = F.array(*(F.lit(_signed(m)) for m in masks(radius)))
    keyed = nodes.select("f", F.posexplode(tables).alias("t", "m")).select("f", F.xxhash64("t", F.col("f").bitwiseAND(F.col("m"))).alias("k"))
    found = []
    while True:
        keyed = stored(keyed)
        sizes = keyed.groupBy("k").agg(
            F.count(F.lit(1)).alias("n"), F.bit_or("f").bitwiseXOR(F.bit_and("f")).alias("differ"), F.min("f").alias("least")
        )
        shared = keyed.join(sizes.where("n > 1"), "k")
        small = shared.where(F.col("n") <= most).select("k", "f").repartition("k").sortWithinPartitions("k")
        found.append(stored(small.mapInArrow(_compare(radius, most), "a long, b long")))
        large = stored(shared.where(F.col("n") > most).select("k", "f", "differ", "least"))
        if large.isEmpty():
            break
        few = F.bit_count("differ") <= radius
        found.append(large.where(few & (F.col("f") != F.col("least"))).select(F.least("f", "least").alias("a"), F.greatest("f", "least").alias("b")))
        # number the differing bits, deal them to radius + 1 blocks; a key is what a block holds
        bits = F.filter(F.array(*(F.lit(_signed(1 << i)) for i in range(64))), lambda x: F.col("differ").bitwiseAND(x) != 0)
        blocks = [_block(bits, j, radius + 1) for j in range(radius + 1)]
        cut = large.where(~few).select("k", "f", F.array(*blocks).alias("blocks"))
        cut = cut.select("k", "f", F.posexplode("blocks").alias("j", "m"))
        keyed = cut.select("f", F.xxhash64("k", "j", F.col("f").bitwiseAND(F.col("m"))).alias("k"))
    return reduce(DataFrame.unionByName, found).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the ends of ``edges`` (a, b): equal roots are connected.

    A round points every node to the least of its neighbours, follows pointers to their ends, and
    contracts the links; each round leaves at most half of the linked nodes.
    """
    edges = stored(edges)
    roots = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root"))
    while not edges.isEmpty():
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        points = stored(both.groupBy(F.col("a").alias("x")).agg(F.min("b").alias("p")).select("x", F.least("x", "p").alias("p")))
        while True:
            jumped = points.alias("s").join(points.alias("t"), F.col("s.p") == F.col("t.x"))
            on = stored(jumped.select("s.x", F.col("t.p").alias("p"), (F.col("s.p") != F.col("t.p")).alias("moved")))
            points = on.select("x", "p")
            if on.where("moved").isEmpty():
                break
        roots = stored(roots.join(points, F.col("root") == F.col("x"), "left").select("node", F.coalesce("p", "root").alias("root")))
        of_a, of_b = (points.select(F.col("x").alias(e), F.col("p").alias(f"p{e}")) for e in "ab")
        ends = edges.join(of_a, "a").join(of_b, "b")
        edges = stored(ends.where("pa != pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    return roots


def _rooted(named: DataFrame, radius: int) -> DataFrame:
    """(f, root, component_id) of every fingerprint of ``named`` (doc_id, f)."""
    nodes = stored(named.groupBy("f").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes.select("f"), radius))
    joined = nodes.join(roots, F.col("f") == F.col("node"), "left").select("f", "least", F.coalesce("root", "f").alias("root"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return stored(joined.join(least, "root").select("f", "root", "component_id"))


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, f, component_id) of every row: its fingerprint, and the smallest id of its component."""
    named = stored(docs.select(column(docs, doc_id).alias("doc_id"), fingerprint(column(docs, text)).alias("f")))
    return named.join(_rooted(named, radius).drop("root"), "f").select("doc_id", "f", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, null ids last, then by a hash of the text.

    The id does not name the row, for ids may repeat or be null: rows go by a hash of id and text.
    """
    ids, body = column(docs, doc_id), column(docs, text)
    named = stored(docs.select(ids.alias("doc_id"), F.xxhash64(body).alias("h"), F.xxhash64(ids, body).alias("row"), fingerprint(body).alias("f")))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h", "row")).getField("row").alias("kept_row")
    keep = named.join(_rooted(named, radius), "f").groupBy("root").agg(first).select("kept_row")
    rows, row = packed(docs), F.col("row")
    kept = rows.join(keep, F.xxhash64(row.getField(doc_id), row.getField(text)) == F.col("kept_row"))
    # rows with the same id and text are copies of one another
    copies = Window.partitionBy("kept_row").orderBy(F.lit(0))
    kept = kept.select("row", "kept_row", F.row_number().over(copies).alias("n")).where("n = 1")
    return unpacked(kept.select("row"), docs.columns)


def as_hex(f: Column) -> Column:
    return F.lpad(F.lower(F.hex(f)), 16, "0")
