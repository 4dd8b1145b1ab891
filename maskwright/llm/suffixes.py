"""Suffix-array dedup by bucket-pointer refinement over sampled suffixes.

A byte goes if a string of LENGTH bytes that covers it also starts elsewhere. Suffixes are sampled so
that equal strings are sampled alike: in every window of GRAMS starts, the q-gram of the least hash is
an anchor. A string is then named by its anchor and the offset of the anchor in it, and

1. anchors are put in buckets by their q-gram; buckets of one anchor are done;
2. a bucket is refined by the identifier (hash) of all bytes that the anchor's strings cover: anchors
   that agree in it agree in all their strings, which are repeated;
3. the classes that are left of a bucket are refined by the identifiers of the strings at each offset
   of the anchor, which the same prefix sums give for all offsets.

Each step sorts only what the step before has left, by identifiers it has given. Buckets and classes
of very many anchors are counted with map-side combination; what is joined back to a class of very many
is broadcast, as there are few such classes, so no group is gathered in one task. Smaller ones are refined
in sorted partitions.

The identifiers are hashes of the strings and stand in for the bucket identifiers of suffixes at later
offsets: those would need a row, and its shuffle, for every byte of text. A bucket's 64 bits and a class's
further, independent 64 bits hold together.

Defined results: a null text is empty, and a text shorter than LENGTH keeps all its bytes. Ids may be of any
type. Rows are known by 80 bits of hashes of id and text; equal rows are copies of one another, as any equal texts are. Matches never
cross rows. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.common import by_document, column, slices, stored

# Fixed value: bytes of a string that counts as repeated.
LENGTH = 200
# starts among which one anchor is chosen (a power of two), and the bytes of its q-gram
GRAMS = 128
Q = LENGTH - GRAMS + 1
# anchors of a bucket that are sorted in one partition; beyond it, they are counted and joined
MOST_IN_BUCKET = 100_000
# a bucket is counted and joined only if it has more than that, and than this part of all anchors
HOT_BUCKETS = 10_000
# classes of a bucket that are compared at every offset in one partition
MOST_CLASSES = 20_000
# bytes that are hashed together
BYTES_AT_ONCE = 2 << 20

_U = np.uint64


class Hasher:
    """Hashes of any slices of a buffer from prefix sums: two independent families."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 1 << 64, 256, dtype=_U)
        self.base = int(rng.integers(0, 1 << 63)) * 2 + 1
        self.up = np.ones(0, _U)
        self.down = np.ones(0, _U)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            size = 1 << max(16, n.bit_length())

            def run(x: int) -> np.ndarray:
                out = np.full(size, x, _U)
                out[0] = 1
                return np.cumprod(out, dtype=_U)

            self.up, self.down = run(self.base), run(pow(self.base, -1, 1 << 64))

    def sums(self, raw: np.ndarray) -> np.ndarray:
        n = len(raw)
        self.powers(n + 1)
        out = np.zeros(n + 1, _U)
        np.cumsum(self.table[raw] * self.down[:n], dtype=_U, out=out[1:])
        return out

    def slices(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((sums[end] - sums[start]) * self.up[start] + (end - start).astype(_U))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(29))


_HASHERS: list[Hasher] = []


def _hashers() -> list[Hasher]:
    if not _HASHERS:
        _HASHERS.extend([Hasher(101), Hasher(202)])
    return _HASHERS


def _slide(f: np.ufunc, a: np.ndarray) -> np.ndarray:
    """f over every GRAMS values in a row."""
    k = 1
    while k < GRAMS:
        a = f(a[:-k], a[k:])
        k *= 2
    return a


def anchors_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text number, position, least and greatest offset, q-gram hash, class hash) of the anchors.

    The offset of an anchor in a string that starts at s is position - s; the string's least q-gram hash
    is then the anchor's. Texts are hashed one behind the other, with no start across two of them.
    """
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, _U, _U))
    texts = list(texts)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    raw = np.frombuffer(b"".join(texts), np.uint8)
    n = len(raw)
    if n < LENGTH:
        return none
    begin = np.cumsum(size) - size
    first, second = _hashers()
    sums = first.sums(raw)
    grams = _mixed((sums[Q:] - sums[: n - Q + 1]) * first.up[: n - Q + 1] + _U(Q))
    rough = (grams >> _U(33)).astype(np.uint32) + np.uint32(1)  # 0 stands for no string
    least = _slide(np.minimum, rough)  # by start of a string
    text_of = np.repeat(np.arange(len(texts)), size)
    end = begin + size
    whole = np.arange(len(least)) + LENGTH <= end[text_of[: len(least)]]
    # a gram is an anchor if it is the least of a string that lies in one text
    edge = np.zeros(GRAMS - 1, np.uint32)
    top = _slide(np.maximum, np.concatenate([edge, np.where(whole, least, 0), edge]))
    at = np.flatnonzero(rough == top)
    # offsets: from the last start that no smaller gram behind spoils, to the first
    value, owner = rough[at], text_of[at]
    low = np.maximum(at - (GRAMS - 1), begin[owner])
    high = np.minimum(at, end[owner] - LENGTH)
    step = 1
    while step < len(at):
        near = at[step:] - at[:-step] < GRAMS
        if not near.any():
            break
        after = np.flatnonzero(near & (value[:-step] < value[step:])) + step
        low[after] = np.maximum(low[after], at[after - step] + 1)
        ahead = np.flatnonzero(near & (value[step:] < value[:-step]))
        high[ahead] = np.minimum(high[ahead], at[ahead + step] - GRAMS)
        step += 1
    good = (low <= high) & (at + Q <= end[owner])
    at, owner, low, high = at[good], owner[good], low[good], high[good]
    covered = second.slices(second.sums(raw), low, high + LENGTH)
    return owner, at - begin[owner], at - high, at - low, grams[at], covered


def _chunks(texts: list[bytes]) -> Iterator[tuple[list[bytes], list[int], list[int]]]:
    """Pieces of about BYTES_AT_ONCE together, with their texts' numbers and where they start in them.

    Pieces of a longer text overlap so that every string is whole in exactly one of them.
    """
    parts, of, base, total = [], [], [], 0
    for i, t in enumerate(texts):
        for start in range(0, max(1, len(t) - LENGTH + 1), BYTES_AT_ONCE):
            piece = t[start : start + BYTES_AT_ONCE + LENGTH - 1]
            if parts and total + len(piece) > BYTES_AT_ONCE:
                yield parts, of, base
                parts, of, base, total = [], [], [], 0
            parts.append(piece)
            of.append(i)
            base.append(start)
            total += len(piece)
    yield parts, of, base


# place: position, least and greatest offset, and 16 bits of the text's hash, in one long
def _place(at: np.ndarray, low: np.ndarray, high: np.ndarray, tag: np.ndarray) -> np.ndarray:
    return at << 30 | low << 23 | high << 16 | tag


def _identity(docs: DataFrame, doc_id: str, text: str) -> tuple[Column, Column]:
    """What a row is known by, whatever its id's type: a hash of id and text, and 16 bits of one of the text alone."""
    t = column(docs, text)
    return F.xxhash64(column(docs, doc_id), t).alias("d"), F.xxhash64(t).bitwiseAND(F.lit(0xFFFF)).alias("tag")


def anchors(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(q, c, d, place) of all anchors: bucket, class, document, place."""

    def work(columns: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        ids, tags = (c.to_numpy(zero_copy_only=False) for c in columns[:2])
        texts = [t or b"" for t in columns[2].to_pylist()]
        for parts, of, base in _chunks(texts):
            owner, at, low, high, q, c = anchors_of(parts)
            row = np.array(of, np.int64)[owner]
            place = _place(at + np.array(base, np.int64)[owner], low, high, tags[row])
            # the class holds for equal ranges of offsets only
            c = _mixed(c + (low << 7 | high).astype(_U))
            out = [q.view(np.int64), c.view(np.int64), ids[row], place]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["q", "c", "d", "place"])

    d, tag = _identity(docs, doc_id, text)
    long_enough = docs.where(F.octet_length(column(docs, text)) >= LENGTH)
    return by_document(long_enough, [d, tag, column(docs, text).cast("binary").alias("t")], "q long, c long, d long, place long", work)


def refine_classes(found: DataFrame, most: int = MOST_IN_BUCKET) -> DataFrame:
    """(q, c, d, place, n_class, n_classes, singles, speaks) of the anchors whose q-gram occurs again.

    n_class: anchors of the class; n_classes: classes in the bucket; singles: how many of one anchor;
    speaks: true for one anchor of each class.
    """
    sizes = stored(found.groupBy("q").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    # a bucket is hot beyond a share of all anchors: so there are at most HOT_BUCKETS of them
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    most = max(most, total // HOT_BUCKETS)
    hot_q = sizes.where(F.col("n") > most).select("q")
    # sorted within the partitions that the join makes anyway; hot buckets do not get there
    usual = found.join(F.broadcast(hot_q), "q", "left_anti").join(sizes.where(F.col("n") <= most).select("q"), "q")
    by_class, by_bucket = Window.partitionBy("q", "c").orderBy("d", "place"), Window.partitionBy("q")
    whole = by_class.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    usual = usual.select("q", "c", "d", "place", F.count(F.lit(1)).over(whole).alias("n_class"), (F.row_number().over(by_class) == 1).alias("speaks"))
    of_bucket = [
        F.count_if("speaks").over(by_bucket).alias("n_classes"),
        F.count_if(F.col("n_class") == 1).over(by_bucket).alias("singles"),
    ]
    usual = usual.select("q", "c", "d", "place", "n_class", *of_bucket, "speaks")
    if hot_q.isEmpty():
        return usual
    # their counts are combined before they are shuffled, and joined back
    hot = stored(found.join(F.broadcast(hot_q), "q", "left_semi").select("q", "c", "d", "place"))
    classes = stored(hot.groupBy("q", "c").agg(F.count(F.lit(1)).alias("n_class"), F.min(F.struct("d", "place")).alias("first")))
    # a class of more than ``most`` anchors is a hot bucket's, so there are at most HOT_BUCKETS of these, too
    large = F.broadcast(classes.where(F.col("n_class") > most))
    buckets = classes.groupBy("q").agg(F.count(F.lit(1)).alias("n_classes"), F.count_if(F.col("n_class") == 1).alias("singles"))
    in_large = hot.join(large, ["q", "c"])
    others = hot.join(large.select("q", "c"), ["q", "c"], "left_anti").join(classes.where(F.col("n_class") <= most), ["q", "c"])
    joined = in_large.unionByName(others).join(F.broadcast(buckets), "q")
    speaks = (F.col("d") == F.col("first.d")) & (F.col("place") == F.col("first.place"))
    return usual.unionByName(joined.select("q", "c", "d", "place", "n_class", "n_classes", "singles", speaks.alias("speaks")))


def _unplace(place: np.ndarray) -> tuple[np.ndarray, ...]:
    return place >> 30, place >> 23 & 127, place >> 16 & 127, place & 0xFFFF


SPAN = "d long, tag long, start long, end long"


def _spans(d: np.ndarray, tag: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (d, tag, start, end)], ["d", "tag", "start", "end"])


def _contexts(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The anchors ``wanted`` (q, many, hot, d, tag, place) with the bytes that their strings cover."""

    def work(columns: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        texts, ids, lists = columns
        q, place, many, hot = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        of = np.repeat(np.arange(len(lengths)), lengths)
        at, low, high, _ = _unplace(place)
        bodies = texts.to_pylist()
        cut = [bodies[i][a:b] for i, a, b in zip(of.tolist(), (at - high).tolist(), (at - low + LENGTH).tolist())]
        out = [pa.array(x) for x in (q, many, ids.to_numpy(zero_copy_only=False)[of], place, hot)] + [pa.array(cut, pa.binary())]
        for some in slices(out, 5000):
            yield pa.RecordBatch.from_arrays(some, ["q", "many", "d", "place", "hot", "bytes"])

    d, tag = _identity(docs, doc_id, text)
    named = docs.where(F.octet_length(column(docs, text)) >= LENGTH).select(d, tag, column(docs, text).cast("binary").alias("t"))
    lists = wanted.groupBy("d", "tag").agg(F.collect_list(F.struct("q", "place", "many", "hot")).alias("l"))
    # equal rows have equal strings: the first of them stands for all
    one = named.join(lists, ["d", "tag"]).dropDuplicates(["d", "tag"])
    return by_document(one, [F.col("t"), F.col("d"), F.col("l")], "q long, many boolean, d long, place long, hot boolean, bytes binary", work)


def _offset_hashes(bodies: list[bytes], low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By offset: the numbers of the anchors that have a string there, and the strings' hashes."""
    hasher = _hashers()[1]
    sums = hasher.sums(np.frombuffer(b"".join(bodies), np.uint8))
    size = np.fromiter(map(len, bodies), np.int64, len(bodies))
    origin = np.cumsum(size) - size + high  # where the string of offset 0 would start
    for offset in range(GRAMS):
        here = np.flatnonzero((low <= offset) & (offset <= high))
        if len(here):
            start = origin[here] - offset
            yield offset, here, hasher.slices(sums, start, start + LENGTH)


def _repeated(q: np.ndarray, many: np.ndarray, place: np.ndarray, bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(anchor number, offset) of the strings that two anchors of a bucket share, or one that stands for many has."""
    _, low, high, _ = _unplace(place)
    rows, offsets = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    weight = 1 + many.astype(np.int64)
    for offset, here, hashes in _offset_hashes(bodies, low, high):
        order = np.lexsort((hashes, q[here]))
        here, hashes = here[order], hashes[order]
        new = np.ones(len(here), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (q[here][1:] != q[here][:-1])
        group = np.cumsum(new) - 1
        total = np.bincount(group, weight[here])[group]
        hit = here[(total > 1) & ~many[here]]
        rows.append(hit)
        offsets.append(np.full(len(hit), offset))
    return np.concatenate(rows), np.concatenate(offsets)


def _string_spans(d: np.ndarray, place: np.ndarray, row: np.ndarray, offset: np.ndarray) -> pa.RecordBatch:
    """Spans of strings, those of neighbouring offsets as one."""
    order = np.lexsort((offset, row))
    row, offset = row[order], offset[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row))[: len(first)] - 1
    at, _, _, tag = _unplace(place[row[first]])
    return _spans(d[row[first]], tag, at - offset[last], at - offset[first] + LENGTH)


def refine_offsets(pieces: DataFrame) -> DataFrame:
    """Spans of the strings that the classes of a bucket share. ``pieces``: q, many, d, place, hot, bytes."""

    def whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
            if len(t):
                q, many, d, place = (t.column(i).to_numpy() for i in range(4))
                row, offset = _repeated(q, many, place, t.column(4).to_pylist())
                if len(row):
                    yield _string_spans(d, place, row, offset)

        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            q = held.column(0).to_numpy()
            # the last bucket may go on in the next batch; a bucket has a bounded number of classes
            others = np.flatnonzero(q != q[-1]) if len(q) else q
            if len(others) > 5000:
                yield from done(held.slice(0, others[-1] + 1))
                held = held.slice(others[-1] + 1)
        if held is not None:
            yield from done(held)

    def every_string(columns: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        q, many, d, place = (c.to_numpy(zero_copy_only=False) for c in columns[:4])
        _, low, high, _ = _unplace(place)
        for offset, here, hashes in _offset_hashes(columns[4].to_pylist(), low, high):
            out = [q[here], hashes.view(np.int64), np.full(len(here), offset), many[here], d[here], place[here]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["q", "s", "offset", "many", "d", "place"])

    names = ["q", "many", "d", "place", "bytes"]
    small = pieces.where("NOT hot").select(names)
    spans = small.repartition("q").sortWithinPartitions("q").mapInArrow(whole_buckets, SPAN)
    # buckets of very many classes: every string is an identifier of its own, counted and joined back
    hot = pieces.where("hot")
    if hot.isEmpty():
        return spans
    strings = stored(by_document(hot, [F.col(c) for c in names], "q long, s long, offset long, many boolean, d long, place long", every_string))
    shared = strings.groupBy("q", "s", "offset").agg(F.sum(F.when(F.col("many"), 2).otherwise(1)).alias("n")).where("n > 1").drop("n")
    start = F.expr("shiftright(place, 30) - offset")
    return spans.unionByName(
        strings.where("NOT many").join(shared, ["q", "s", "offset"]).select("d", F.expr("place & 65535").alias("tag"), start.alias("start"), (start + LENGTH).alias("end"))
    )


def repeated_spans(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", in_bucket: int = MOST_IN_BUCKET, classes: int = MOST_CLASSES
) -> DataFrame:
    """(d, tag, start, end): bytes of repeated strings; spans may overlap."""
    refined = stored(refine_classes(anchors(docs, doc_id, text), in_bucket).where("n_class > 1 OR n_classes > 1"))
    at, low, high = "shiftright(place, 30)", "(shiftright(place, 23) & 127)", "(shiftright(place, 16) & 127)"
    same = refined.where("n_class > 1").selectExpr("d", "place & 65535 AS tag", f"{at} - {high} AS start", f"{at} - {low} + {LENGTH} AS end")
    # one anchor of each class goes on, where a bucket has several classes and at least one of a single anchor
    open_ = refined.where("speaks AND n_classes > 1 AND singles > 0")
    open_ = open_.selectExpr("q", "n_class > 1 AS many", "d", "place", "place & 65535 AS tag", f"n_classes > {classes} AS hot")
    return same.unionByName(refine_offsets(stored(_contexts(docs, open_, doc_id, text))))


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", in_bucket: int = MOST_IN_BUCKET, classes: int = MOST_CLASSES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256) of every row; ``kept`` is binary: a cut may split a character."""

    def work(columns: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        ids, texts, lists = columns
        rows = []
        for body, spans in zip(texts.to_pylist(), lists.to_pylist()):
            body, cut, n, end, pieces = body or b"", 0, 0, -1, []
            last = 0
            for s in sorted((x["start"], x["end"]) for x in spans or ()):
                if s[0] > end:
                    pieces.append(body[last : s[0]])
                    n += 1
                    cut += s[1] - s[0]
                    end = last = s[1]
                elif s[1] > end:
                    cut += s[1] - end
                    end = last = s[1]
            kept = b"".join([*pieces, body[last:]])
            rows.append((len(body), cut, n, kept, hashlib.sha256(kept).hexdigest()))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        out = [ids, *(pa.array(c, t) for c, t in zip(zip(*rows), types))]
        yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    spans = repeated_spans(docs, doc_id, text, in_bucket, classes)
    lists = spans.groupBy("d", "tag").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    d, tag = _identity(docs, doc_id, text)
    named = docs.select(d, tag, column(docs, doc_id).alias("doc_id"), column(docs, text).cast("binary").alias("t"))
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
    return by_document(named.join(lists, ["d", "tag"], "left"), [F.col("doc_id"), F.col("t"), F.col("spans")], schema, work)
