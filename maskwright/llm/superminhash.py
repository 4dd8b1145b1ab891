"""MinHash near-dedup with SuperMinHash signatures.

A document is the set of its two-word shingles. Every shingle visits the 128 registers of a signature in
an order of its own; the j-th register it visits gets the rank j plus a random fraction if that is less
than what it holds. Ranks of one shingle are all different, which makes the signature vary less than
independent hashes would. All shingles of a batch take their j-th step together, and a document stops at
the first step after which no register holds a rank above j: later steps could not lower one.

Documents with equal sets are one node. Four registers form a band; nodes that agree in one of the 32
bands are candidates. A pair of similarity 0.8 misses all bands with a probability of 5e-8; one that
agrees in less than 0.6 of its registers is dropped (less than 1e-8 for such a pair). All others are
confirmed on the shingles themselves.

Buckets are not multiplied out. First, each member is confirmed with the least node of its bucket, and
union-find, in tasks and then by contraction over the corpus, groups what is linked. In buckets that
still hold several groups, the signatures of members of different groups are compared; of the pairs that
may be linked only a spanning forest of the groups leaves the task, the likeliest pairs first, and is
confirmed. Groups that these pairs connect are a family. If a family is still not one group, all its
members of different groups are compared by their whole sets, and again only a forest leaves the task.
So no link is lost, pairs never outnumber members, and a large bucket or family is cut into tiles, of the
members outside its largest group against all.

Defined results: a text that is null or has no words has an empty set and is linked with nothing. A text
of one word has that word as its only shingle. Null ids do not name a component unless all its ids are
null; a row is kept if its id names its component, so rows of one id and set are kept together, and those
with a null id are not, unless they have no words. Repeated rows are in one component. An empty table
gives an empty result. Only the id and the text are read. A very long text is handled by one task, in
memory proportional to it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.llm.common import column, stored
from maskwright.llm.fingerprints import components

# Similarity that links, in percent.
SIMILAR = 80
REGISTERS, BAND = 128, 4
# registers that must agree before two sets are compared
AGREEING = 77
# words that are hashed together; members that one task compares with one another
WORDS_AT_ONCE, COMPARED_AT_ONCE = 1 << 16, 1024
# shingles of the members that one task compares whole
SHINGLES_AT_ONCE = 4_000_000

_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW = np.uint64(0xFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit generator: every input bit changes every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def registers(hashes: np.ndarray, documents: np.ndarray, n: int, size: int = REGISTERS) -> np.ndarray:
    """Signatures of n documents; ``documents`` says which one each distinct shingle hash belongs to.

    A register holds the rank in its upper half and the fraction in its lower one.
    """
    values = np.full(n * size, _FULL, np.uint64)
    order = np.tile(np.arange(size, dtype=np.uint8 if size <= 256 else np.int32), (len(hashes), 1))
    rows = np.arange(len(hashes))
    for j in range(size):
        if not len(hashes):
            break
        z = _mixed(hashes + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        k = j + ((z & _LOW) * np.uint64(size - j) >> np.uint64(32)).astype(np.int64)
        chosen = order[rows, k]
        order[rows, k] = order[:, j]
        np.minimum.at(values, documents * size + chosen, np.uint64(j << 32) | (z >> np.uint64(32)))
        open_ = values.reshape(n, size).max(axis=1) >= np.uint64((j + 1) << 32)
        going = open_[documents]
        if 2 * np.count_nonzero(going) < len(going):
            hashes, documents, order = hashes[going], documents[going], order[going]
            rows = np.arange(len(hashes))
    return values.reshape(n, size)


def shingle_hashes(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of the distinct shingles, by document and hash."""
    known = {w: xxhash.xxh64_intdigest(w) for w in set(chain.from_iterable(words))}
    sizes = np.array([len(ws) for ws in words], np.int64)
    flat = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.uint64, int(sizes.sum()))
    document = np.repeat(np.arange(len(words)), sizes)
    joined = _mixed(flat[:-1] * np.uint64(3) + np.uint64(1)) + flat[1:] * np.uint64(0x9E3779B97F4A7C15)
    inside = document[:-1] == document[1:]
    single = sizes[document] == 1
    hashes = np.concatenate([_mixed(joined[inside]), _mixed(flat[single] ^ np.uint64(0x5851F42D4C957F2D))])
    owner = np.concatenate([document[:-1][inside], document[single]])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], owner[new]


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()  # bytes: only A-Z change, only ASCII white space splits


def sketches(texts: list[bytes | None]) -> Iterator[dict]:
    """Per text: size of its set, digest of the set, and the signature with 16 bits a register."""
    group: list[list[bytes]] = []
    held = 0

    def done() -> Iterator[dict]:
        hashes, owner = shingle_hashes(group)
        sizes = np.bincount(owner, minlength=len(group))
        ends = np.cumsum(sizes)
        short = (_mixed(registers(hashes, owner, len(group))) >> np.uint64(48)).astype("<u2")
        for i, size in enumerate(sizes.tolist()):
            if size:
                yield {"n": size, "s": xxhash.xxh128_digest(hashes[ends[i] - size : ends[i]].tobytes()), "sig": short[i].tobytes()}
            else:
                yield {"n": 0, "s": None, "sig": None}

    for t in texts:
        words = words_of(t)
        if group and held + len(words) > WORDS_AT_ONCE:
            yield from done()
            group, held = [], 0
        group.append(words)
        held += len(words)
    if group:
        yield from done()


_ARROW = pa.struct([("n", pa.int64()), ("s", pa.binary()), ("sig", pa.binary())])


@F.arrow_udf(T.StructType([T.StructField("n", T.LongType()), T.StructField("s", T.BinaryType()), T.StructField("sig", T.BinaryType())]))
def _sketch(texts: pa.Array) -> pa.Array:
    return pa.array(list(sketches(texts.to_pylist())), _ARROW)


def _matrix(signatures: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(signatures.to_pylist()), "<u2").reshape(len(signatures), -1)


@F.arrow_udf(T.IntegerType())
def _agreeing(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array((_matrix(a) == _matrix(b)).sum(axis=1).astype(np.int32))


class Forest:
    """Union-find over nodes; a link between two nodes that are already together is not needed."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = x = up[p]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _shingles(text: bytes) -> set:
    words = words_of(text)
    return set(zip(words, words[1:])) if len(words) > 1 else set(words)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among candidate pairs (a, b, ta, tb), as far as they join what the task has not joined yet."""
    forest, last, own = Forest(), None, set()
    for batch in batches:
        a, b, ta, tb = (c.to_pylist() for c in batch.columns)
        out = []
        for x, y, tx, ty in zip(a, b, ta, tb):
            if forest.find(x) == forest.find(y):
                continue
            if x != last:
                last, own = x, _shingles(tx)
            other = _shingles(ty)
            common = len(own & other)
            if 100 * common >= SIMILAR * (len(own) + len(other) - common) and forest.join(x, y):
                out.append((x, y))
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], ["a", "b"])


def _may_link(a: Column, b: Column) -> Column:
    """Sizes that allow the similarity."""
    return 100 * F.least(a, b) >= SIMILAR * F.greatest(a, b)


def spanning(i: np.ndarray, j: np.ndarray, weight: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Places of edges (i, j) that connect all labels the edges connect, heaviest first, without a circle."""
    forest, chosen, left = Forest(), [], np.arange(len(i))
    while True:
        a, b = label[i[left]], label[j[left]]
        left, a, b = left[a != b], a[a != b], b[a != b]
        if not len(left):
            return np.sort(np.concatenate([np.zeros(0, np.int64), *chosen]))
        heaviest = np.full(len(label), -1)
        key = weight[left].astype(np.int64) * len(left) + np.arange(len(left))
        np.maximum.at(heaviest, a, key)
        np.maximum.at(heaviest, b, key)
        at = np.unique(heaviest[heaviest >= 0] % len(left))
        for x, y in zip(a[at].tolist(), b[at].tolist()):
            forest.join(x, y)
        chosen.append(left[at])
        label = np.array([forest.find(x) for x in label.tolist()])


def _by_bucket(work: Callable[[list[np.ndarray]], Iterator[pa.RecordBatch]], read: Callable[[pa.RecordBatch], list[np.ndarray]]):
    """Run ``work`` on rows sorted by their first column, whole buckets at a time; an unfinished one is carried on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = read(batch)
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            others = np.flatnonzero(cols[0] != cols[0][-1])
            whole = int(others[-1]) + 1 if len(others) else 0
            if whole:
                yield from work([c[:whole] for c in cols])
            held = [c[whole:] for c in cols]
        if held is not None:
            yield from work(held)

    return run


def _near(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, ra, rb) that connect the groups of a bucket, in rows (g, node, root, n, sig), compared at growing distance."""
    g, node, root, n, sig = cols
    left, right, weight = [], [], []
    alive, gap = np.arange(len(g)), 1
    while len(alive):
        alive = alive[alive + gap < len(g)]
        alive = alive[g[alive] == g[alive + gap]]
        i, j = alive, alive + gap
        apart = (root[i] != root[j]) & (100 * np.minimum(n[i], n[j]) >= SIMILAR * np.maximum(n[i], n[j]))
        i, j = i[apart], j[apart]
        agreeing = (sig[i] == sig[j]).sum(axis=1)
        near = agreeing >= AGREEING
        left.append(i[near])
        right.append(j[near])
        weight.append(agreeing[near])
        gap += 1
    if left:
        i, j = np.concatenate(left), np.concatenate(right)
        used = spanning(i, j, np.concatenate(weight), np.unique(root, return_inverse=True)[1])
        i, j = i[used], j[used]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node[i], node[j], root[i], root[j])], ["a", "b", "ra", "rb"])


def _linked(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) between the groups of a tile, in rows (g, root, text), by the whole sets."""
    g, root, text = cols
    edges = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1], [True]])).tolist()
    forest, out = Forest(), []
    for start, end in zip(edges, edges[1:]):
        roots = root[start:end].tolist()
        hashes, owner = shingle_hashes([words_of(t) for t in text[start:end]])
        ids = np.unique(hashes, return_inverse=True)[1]
        starts = np.searchsorted(owner, np.arange(end - start + 1))
        sizes, mark = np.diff(starts), np.zeros(len(ids) + 1, bool)
        for i in range(end - start - 1):
            own = ids[starts[i] : starts[i + 1]]
            mark[own] = True
            common = np.add.reduceat(mark[ids[starts[i + 1] :]], starts[i + 1 : -1] - starts[i + 1], dtype=np.int64)
            similar = 100 * common >= SIMILAR * (sizes[i] + sizes[i + 1 :] - common)
            out += [(roots[i], roots[j]) for j in (np.flatnonzero(similar) + i + 1).tolist() if forest.join(roots[i], roots[j])]
            mark[own] = False
    yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])


_compare = _by_bucket(_near, lambda b: [c.to_numpy(zero_copy_only=False) for c in b.columns[:4]] + [_matrix(b.column(4))])
_settle = _by_bucket(_linked, lambda b: [c.to_numpy(zero_copy_only=False) for c in b.columns])


def _bands(nodes: DataFrame, *columns: str) -> DataFrame:
    """One row a band: its key ``k``."""
    width = 2 * BAND  # bytes
    keys = [F.xxhash64(F.lit(i), F.substring("sig", width * i + 1, width)) for i in range(REGISTERS // BAND)]
    return nodes.select(*columns, F.explode(F.array(*keys)).alias("k"))


def _with_texts(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, text) of nodes with their ``row``; of rows with the same id and text one is enough."""
    return texts.join(nodes.select("node", "row"), "row").groupBy("node").agg(F.any_value("text").alias("text"))


def _confirmed(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) of candidate pairs, by the shingles of the two texts."""
    used = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node")
    found = stored(_with_texts(used, texts))
    of_b = pairs.select("a", "b").join(found.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    both = of_b.join(found.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    return both.select("a", "b", "ta", "tb").mapInArrow(_confirm, "a long, b long")


def first_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b): each member of a bucket with the least node of it, if sizes and signatures allow a link."""
    keyed = _bands(nodes, "node")
    least = keyed.groupBy("k").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("members")).where("members > 1")
    pairs = keyed.join(least.select("k", "a"), "k").where("node != a").select("a", F.col("node").alias("b")).distinct()
    for end in "ab":
        own = nodes.select(F.col("node").alias(end), F.col("n").alias(f"n{end}"), F.col("sig").alias(f"s{end}"))
        pairs = pairs.join(own, end)
    near = pairs.where(_may_link(F.col("na"), F.col("nb"))).withColumn("agreeing", _agreeing("sa", "sb"))
    return near.where(F.col("agreeing") >= AGREEING).select("a", "b")


def tiled(members: DataFrame, most: int) -> DataFrame:
    """(g, node) of members (k, node, root, n) of buckets with several groups: each pair of different groups meets in a tile g.

    The tiles of a bucket are (members outside its largest group) x (all members), dealt by hash, so that
    one holds about ``most`` members and their shingles fit in memory; a small bucket is one tile.
    """
    by_root = members.groupBy("k", "root").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("n"))
    buckets = by_root.groupBy("k").agg(
        F.count(F.lit(1)).alias("groups"), F.sum("members").alias("members"), F.sum("n").alias("n"), F.max_by("root", "members").alias("main"),
        F.sum("members").alias("all"), F.max("members").alias("largest"),
    )
    # parts of half a tile: by members, or by shingles where texts are long
    parts = lambda share: F.ceil(share * F.greatest(F.col("members") * 2 / most, F.col("n") * 2 / SHINGLES_AT_ONCE)).cast("int")
    whole = (F.col("members") <= most) & (F.col("n") <= SHINGLES_AT_ONCE)
    aside = F.greatest((F.col("all") - F.col("largest")) / F.col("all"), F.lit(0.0))
    buckets = buckets.where("groups > 1").select("k", "main", F.when(whole, 1).otherwise(parts(F.lit(1.0))).alias("outer"), F.when(whole, 0).otherwise(parts(aside)).alias("inner"))
    inside = members.select("k", "node", "root").join(buckets, "k").withColumn("aside", F.col("root") != F.col("main"))
    spot = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "node"), n).cast("int")
    as_outer = F.transform(F.sequence(F.lit(0), F.col("inner") - 1), lambda i: F.xxhash64("k", i, spot(F.col("outer"), "outer")))
    as_inner = F.transform(F.sequence(F.lit(0), F.col("outer") - 1), lambda o: F.xxhash64("k", spot(F.col("inner"), "inner"), o))
    tiles = F.when(F.col("inner") == 0, F.array("k")).when(F.col("aside"), F.array_distinct(F.concat(as_outer, as_inner))).otherwise(as_outer)
    return inside.select("node", F.explode(tiles).alias("g"))


def further_pairs(grouped: DataFrame, most: int = COMPARED_AT_ONCE) -> DataFrame:
    """(a, b, ra, rb): pairs that connect all groups which share a bucket and whose sizes and signatures allow a link.

    ``grouped`` has (node, root, n, sig). Only enough pairs to connect the groups come out, the likeliest first.
    """
    tiles = tiled(_bands(grouped, "node", "root", "n"), most)
    placed = tiles.join(grouped, "node").select("g", "node", "root", "n", "sig")
    return placed.repartition("g").sortWithinPartitions("g").mapInArrow(_compare, "a long, b long, ra long, rb long").distinct()


def settled(grouped: DataFrame, families: DataFrame, texts: DataFrame, most: int = COMPARED_AT_ONCE) -> DataFrame:
    """Links (a, b) between the groups of ``grouped`` (node, row, root, first, n) that one family (node, root) of ``first`` holds."""
    inside = grouped.join(families.select(F.col("node").alias("first"), F.col("root").alias("k")), "first")
    inside = stored(inside.select("k", "node", "row", "root", "n"))
    tiles = stored(tiled(inside, most))
    wanted = inside.join(tiles.select("node").distinct(), "node", "left_semi")
    own = stored(_with_texts(wanted, texts).join(inside.select("node", "root"), "node"))
    placed = tiles.join(own, "node").select("g", "root", "text")
    return placed.repartition("g").sortWithinPartitions("g").mapInArrow(_settle, "a long, b long").distinct()


def _merged(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``nodes`` with the ``root`` that ``roots`` (node, root) has for theirs, if any."""
    top = roots.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return stored(nodes.join(top, "root", "left").withColumn("root", F.coalesce("top", "root")).drop("top"))


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = COMPARED_AT_ONCE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    ids, body = column(docs, doc_id), column(docs, text)
    row = F.xxhash64(ids, body).alias("row")
    sketched = docs.select(ids.alias("doc_id"), row, _sketch(body.cast("binary")).alias("sketch"))
    rows = stored(sketched.select("doc_id", "row", "sketch.*"))
    nodes = rows.where("n > 0").groupBy("s", "n", "sig").agg(F.min("doc_id").alias("least"), F.min("row").alias("row"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()))
    texts = docs.select(row, body.cast("binary").alias("text"))
    # links with the least of each bucket, then the likeliest between the groups they make
    grouped = _merged(nodes.withColumn("root", F.col("node")), components(_confirmed(stored(first_pairs(nodes)), nodes, texts)))
    likely = stored(further_pairs(grouped.select("node", "root", "n", "sig"), most))
    families = components(likely.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    roots = grouped.select("node", "root")
    of = lambda e: roots.select(F.col("node").alias(e), F.col("root").alias(f"r{e}"))
    links = _confirmed(likely, nodes, texts).join(of("a"), "a").join(of("b"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    grouped = _merged(grouped.withColumn("first", F.col("root")), components(links))
    # what is left: groups that may be linked, but not by their likeliest pair
    rest = settled(grouped, families, texts, most)
    rooted = _merged(grouped.select("s", "least", "root"), components(rest))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("s", "component_id")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    out = rows.join(named, "s", "left").select("doc_id", F.col("n").alias("n_shingles"), component)
    return out.withColumn("kept", (F.col("n_shingles") == 0) | F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
