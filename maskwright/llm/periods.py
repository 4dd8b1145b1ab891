"""Periodic runs of words, found by block convolution.

A run is a stretch of words with smallest period q that no neighbouring word extends, of at least 24
words and 3 periods. At the scale B (8, 16, 32, ...) every B-th place starts a block, and the periods
from B to 2B - 1 (from 1, at the first scale) are looked for: a run repeats, q words later, at least
2q of its words, so one block of the scale lies in them whole and stands again q words on.

Where a block stands again is read off the sum of squared differences between the block and each place
of the window behind it: sums of squares from prefix sums, products by convolution. The convolution is
a number-theoretic transform modulo 65537, done as matrix products whose sums stay below 2^53 and thus
are exact integers. No difference means zero. A zero that is only a multiple of the modulus costs a
useless seed and nothing else: each (place, distance) seeds an extension to both sides, by hashes of
stretches, and every run is then compared word by word; if a hash was wrong, the batch is extended by
comparing words.

A block longer than 32 768 words is not needed at the larger scales: its first 32 768 words are
searched in windows of that length, so documents may have any length.

Multiples of a run's period give the same stretch, and only they do; the least one is kept.

Defined results: a null text, or one without words, has no words and no runs. Repeated rows get equal
results; columns of the input are kept, and one called like the new column is replaced. An empty table
gives an empty result. A very long text is handled by one task, with some 200 bytes a word. Of runs
with the same exponent the strongest is the one with the least start, then period.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.llm.common import WORD, column, computed_once

# What counts as a run.
LEAST_WORDS, LEAST_PERIODS = 24, 3
# A prime whose transforms have up to 65 536 places, and a primitive root of it.
PRIME, GENERATOR = 65537, 3
FIRST_BLOCK, LONGEST_BLOCK = 8, 32768
# words that are searched together, and numbers that one step of a transform handles
WORDS_AT_ONCE, NUMBERS_AT_ONCE = 1 << 17, 1 << 17

_RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(_RUN)),
        T.StructField("strongest", _RUN),
        T.StructField("collapsed", T.StringType()),
    ]
)


@cache
def _generated() -> np.ndarray:
    """Powers of the generator, from 0 on."""
    powers = np.ones(1, np.int64)
    while len(powers) < PRIME - 1:
        powers = np.concatenate([powers, powers * pow(GENERATOR, len(powers), PRIME) % PRIME])
    return powers


@cache
def _tables(size: int, inverse: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matrices of a transform in two steps, and the factors between them: powers of a root of the size."""
    a = 1 if size <= 64 else 1 << (size.bit_length() // 2)
    b = size // a
    root = (PRIME - 1) // size * (-1 if inverse else 1)  # as an exponent of the generator

    def powers(exponent: int, rows: int, columns: int) -> np.ndarray:
        return _generated()[np.arange(rows)[:, None] * np.arange(columns) * exponent % (PRIME - 1)].astype(np.float64)

    return powers(root * b, a, a), powers(root, a, b), powers(root * a, b, b)


def _reduce(x: np.ndarray) -> np.ndarray:
    """In place: whole numbers below 2^53 to ones of the same class, at most the prime in size."""
    x -= np.floor(x * (1.0 / PRIME)) * PRIME
    return x


def transform(rows: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Number-theoretic transform of every row (unscaled, if inverse); the length is a power of two."""
    n, size = rows.shape
    outer, between, inner = _tables(size, inverse)
    a, b = between.shape
    if a == 1:
        return _reduce(rows @ inner)
    x = _reduce(np.matmul(outer, rows.reshape(n, a, b)))
    x *= between
    x = _reduce(np.matmul(_reduce(x), inner))
    return x.transpose(0, 2, 1).reshape(n, size)


def occurrences(values: np.ndarray, starts: np.ndarray, block: int, lag: int, lags: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start, distance) of blocks that may stand again at a distance of ``lag`` to ``lag + lags - 1``.

    ``values`` are numbers below the prime. All true places are among the results.
    """
    size = 1 << (block + lags - 2).bit_length()
    squares = np.concatenate([[0], np.cumsum(values * values)])
    reach = int(starts.max(initial=0)) + lag + size + block + 1
    padded = np.zeros(max(reach, len(values)), np.float64)
    padded[: len(values)] = values
    squares = np.pad(squares, (0, max(0, reach - len(squares))), mode="edge")
    for at in range(0, len(starts), max(1, NUMBERS_AT_ONCE // size)):
        s = starts[at : at + max(1, NUMBERS_AT_ONCE // size)]
        own = np.zeros((len(s), size))
        own[:, :block] = padded[s[:, None] + np.arange(block)]
        ahead = padded[s[:, None] + lag + np.arange(size)]
        products = _reduce(transform(own, True) * transform(ahead))
        products = transform(products, True)[:, :lags]  # sums of products, times the size
        places = s[:, None] + lag + np.arange(lags)
        sums = (squares[s + block] - squares[s])[:, None] + squares[places + block] - squares[places]
        rest = _reduce((sums % PRIME) * float(size) - 2.0 * products)
        row, d = np.nonzero((rest == 0) | (rest == PRIME) | (rest == -PRIME))
        yield s[row], d + lag


class Stretches:
    """Equal stretches of words: lengths by hashes of prefixes."""

    def __init__(self, ids: np.ndarray, base: int = 0x9E3779B97F4A7C15):
        with np.errstate(over="ignore"):
            mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            mixed ^= mixed >> np.uint64(29)
            steps = np.full(len(ids) + 1, base, np.uint64)
            steps[0] = 1
            self.powers = np.cumprod(steps, dtype=np.uint64)
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * self.powers[:-1], dtype=np.uint64)])

    def _equal(self, at: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
        left = (self.sums[at + n] - self.sums[at]) * self.powers[d]
        return left == self.sums[at + d + n] - self.sums[at + d]

    def around(self, at: np.ndarray, d: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The stretch [left, right) around each place whose words all stand again at the distance."""
        left, right = at.copy(), at.copy()
        step = 1 << int((end - begin).max(initial=1)).bit_length()
        while step:
            go = np.flatnonzero(right + step + d <= end)
            go = go[self._equal(right[go], d[go], step)]
            right[go] += step
            go = np.flatnonzero(left - step >= begin)
            go = go[self._equal(left[go] - step, d[go], step)]
            left[go] -= step
            step >>= 1
        return left, right


def _around_by_words(ids: np.ndarray, at: np.ndarray, d: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``Stretches.around``, by comparing words."""
    left, right = at.copy(), at.copy()
    for i, (s, q, b, e) in enumerate(zip(at.tolist(), d.tolist(), begin.tolist(), end.tolist())):
        other = np.flatnonzero(ids[b : e - q] != ids[b + q : e]) + b
        k = int(np.searchsorted(other, s))
        left[i] = other[k - 1] + 1 if k else b
        right[i] = other[k] if k < len(other) else e - q
    return left, right


def _seeds(ids: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place, distance, document) of blocks that stand again, scale by scale."""
    values = ids % PRIME
    sizes = np.diff(offsets)
    longest = int(sizes.max(initial=0))
    scale = FIRST_BLOCK
    while max(LEAST_WORDS, LEAST_PERIODS * scale) <= longest:
        block = min(scale, LONGEST_BLOCK)
        starts = np.arange(0, len(ids) - scale + 1, scale)
        document = np.searchsorted(offsets, starts, "right") - 1
        first = 1 if scale == FIRST_BLOCK else scale
        fits = (sizes[document] >= max(LEAST_WORDS, LEAST_PERIODS * first)) & (starts + first + block <= offsets[document + 1])
        starts = starts[fits]
        lags = 2 * scale - first if scale == FIRST_BLOCK else block
        for lag in range(first, 2 * scale, lags):
            for s, d in occurrences(values, starts, block, lag, lags):
                doc = np.searchsorted(offsets, s, "right") - 1
                inside = s + d + block <= offsets[doc + 1]
                yield s[inside], d[inside], doc[inside]
        scale *= 2


def find_runs(ids: np.ndarray, offsets: np.ndarray, base: int = 0x9E3779B97F4A7C15) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each document, by start and period.

    ``ids`` are the words of all documents, one after the other; document i has the words from
    ``offsets[i]`` to ``offsets[i + 1] - 1``.
    """
    stretches = Stretches(ids, base)
    out: list[list[tuple[int, int, int]]] = []
    for by_words in (False, True):
        found = []
        for s, d, doc in _seeds(ids, offsets):
            begin, end = offsets[doc], offsets[doc + 1]
            left, right = _around_by_words(ids, s, d, begin, end) if by_words else stretches.around(s, d, begin, end)
            long = (right > left) & (right + d - left >= np.maximum(LEAST_WORDS, LEAST_PERIODS * d))
            found.append(np.unique(np.stack([left[long], right[long] + d[long], d[long], doc[long]], axis=1), axis=0))
        rows = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 4), np.int64)
        same = np.all(rows[1:, :2] == rows[:-1, :2], axis=1)
        least = np.concatenate([[True], ~same]) if len(rows) else np.zeros(0, bool)
        base_of = rows[np.flatnonzero(least)[np.cumsum(least) - 1], 2] if len(rows) else rows[:, 2]
        sound = not np.any(rows[:, 2] % np.maximum(base_of, 1))
        rows = rows[least]
        out = [[] for _ in range(len(offsets) - 1)]
        for left, end, d, doc in rows.tolist():
            begin, stop = int(offsets[doc]), int(offsets[doc + 1])
            sound = (
                sound
                and np.array_equal(ids[left : end - d], ids[left + d : end])
                and (left == begin or ids[left - 1] != ids[left - 1 + d])
                and (end == stop or ids[end] != ids[end - d])
            )
            out[doc].append((left - begin, end - left, d))
        if sound:
            break
    return out


def _strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    if not runs:
        return words
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(kept).tolist()]


def runs_of_texts(texts: list[bytes | None], base: int = 0x9E3779B97F4A7C15) -> Iterator[dict]:
    """One result a text; texts are searched together up to a number of words."""
    group: list[list[bytes]] = []
    held = 0

    def done() -> Iterator[dict]:
        offsets = np.concatenate([[0], np.cumsum([len(words) for words in group])]).astype(np.int64)
        numbers: dict[bytes, int] = defaultdict(count().__next__)
        ids = np.fromiter(map(numbers.__getitem__, chain.from_iterable(group)), np.int64, offsets[-1])
        for words, runs in zip(group, find_runs(ids, offsets, base)):
            yield {
                "n_words": len(words),
                "runs": [dict(zip(_RUN.names, r)) for r in runs],
                "strongest": dict(zip(_RUN.names, best)) if (best := _strongest(runs)) else None,
                "collapsed": b" ".join(_collapsed(words, runs)).decode("utf-8", "replace"),
            }

    for t in texts:
        words = (t or b"").split()  # bytes: only ASCII white space splits
        if group and held + len(words) > WORDS_AT_ONCE:
            yield from done()
            group, held = [], 0
        group.append(words)
        held += len(words)
    if group:
        yield from done()


_ARROW_RUN = pa.struct([(n, pa.int64()) for n in _RUN.names])
_ARROW = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(_ARROW_RUN)), ("strongest", _ARROW_RUN), ("collapsed", pa.string())])


@F.arrow_udf(RESULT)
def _runs(texts: pa.Array) -> pa.Array:
    return pa.array(list(runs_of_texts(texts.to_pylist())), _ARROW)


def collapse(docs: DataFrame, text: str = "text", name: str = "periods") -> DataFrame:
    """``docs`` with a struct: n_words, runs, the strongest run (greatest length / period), and the text whose runs keep one period."""
    value = _runs(column(docs, text).cast("binary"))
    kept = [column(docs, c) for c in docs.columns if c != name]
    return docs.select(*kept, value.alias(name))


def repeated_tail(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text): every tenth document by its crc gets a tail that repeats a few of its words.

    With h the crc32 of the decimal id and g = floor(h / 10): if h is a multiple of 10, word i of n becomes
    word a + (i - a) % p from a = g % n on, where p = 1 + floor((n - a) / (3 + g % 8)). A null id changes nothing.
    """
    h = F.crc32(column(docs, doc_id).cast("string").cast("binary"))
    t = column(docs, text)
    docs = docs.select(column(docs, doc_id).alias("doc_id"), t.alias("text"), (h / 10).cast("long").alias("g"), (h % 10 == 0).alias("tail"))
    docs = computed_once(docs, "words", F.when(F.col("tail"), F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    docs = docs.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    docs = docs.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    a, p, words = F.col("a"), F.col("p"), F.col("words")

    def moved(w: Column, i: Column) -> Column:
        return F.when(i < a, w).otherwise(F.get(words, (a + F.pmod(i - a, p)).cast("int")))

    tail = F.array_join(F.transform(words, moved), " ")
    return docs.select("doc_id", F.when(F.col("tail") & (F.col("n") > 0), tail).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame, name: str = "periods") -> DataFrame:
    """Per document the number of runs, the strongest one, and digests of the runs and of the collapsed text."""
    s, best = F.col(name), F.col(name)["strongest"]
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform(s["runs"], lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size(s["runs"]).cast("long").alias("n_runs"),
        *(best[n].alias(n) for n in _RUN.names),
        F.expr(f"1000 * {name}.strongest.length div {name}.strongest.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(s["collapsed"].cast("binary"), 256).alias("collapsed_sha256"),
    )
