"""Source divergence audit over terms found by iceberg prefix refinement.

A term is a longest run of letters A-Z, in either case, and characters beyond ASCII; only A-Z are
lower-cased. A language keeps the terms that stand in at least three of its documents (rows). Which ones
these are is found by byte prefixes: prefixes of 8 bytes first, then, of terms whose prefix is in enough
documents, 16 bytes, 32 and so on, until only whole terms remain. A term shorter than a level is whole
there, and counted as such.

One pass over the texts feeds all levels. Within a document the distinct terms are sorted; a term shares
some bytes with the one before it, and makes a new prefix only at levels beyond those. So a term's counts
of documents, by the first level at which it is new, add up, over all terms of a prefix, to its number of
distinct documents, and can be combined in the task, before anything is shuffled. The levels run over
these counts, which terms leave for good when their prefix fails, or when they are whole.

Each language, and each of its sources, then has a probability for each kept term, in whole billionths.
Sources are compared by f = (p - q)^2 / q, rounded down, summed over all kept terms. Terms that a source
lacks all have the same probability there, so the sum is split: terms of both sources are joined, those
of one are read off its counts, the rest is multiplied. The contract asks for each pair of sources of a
language, so a term met by s sources gives s^2 joined rows, which are summed before they are shuffled.

Defined results: null text, language or source are read as ''. Groups without terms occur as any other;
without kept terms their pairs have the value 0. Repeated rows are documents of their own; the id is not
read. An empty table gives an empty result; columns besides the three named are ignored. A very long text
is handled by one task, in memory proportional to it.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.common import column, stored

# Documents that a kept term needs, parts of a whole, ranks of the terms that are listed.
LEAST_DOCUMENTS, BILLION, TOP = 3, 1_000_000_000, 200
# bytes of the first prefix; each level doubles them
FIRST_LEVEL = 8
# terms, by source, that a task holds before it hands them on, and rows of a batch
HELD, ROWS_AT_ONCE = 1_500_000, 20_000

# Fixed value: bytes that terms consist of, upper case in lower case; all others part terms.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def level_of(last: bytes, term: bytes) -> int:
    """First level at which the prefixes of two different terms differ."""
    level, size = 0, FIRST_LEVEL
    while last[:size] == term[:size]:
        level, size = level + 1, 2 * size
    return level


def new_terms(words: list[bytes]) -> Iterator[tuple[int, set[bytes]]]:
    """(level, terms): the distinct words of a document by the first level at which their prefix is new in it."""
    terms = set(words)
    # a shorter term is its own first prefix, which no other term has
    long = sorted(t for t in terms if len(t) >= FIRST_LEVEL)
    later: dict[int, set[bytes]] = defaultdict(set)
    for last, term in zip(long, long[1:]):
        if last[:FIRST_LEVEL] == term[:FIRST_LEVEL]:
            later[level_of(last, term)].add(term)
    yield 0, terms.difference(*later.values())
    yield from later.items()


_COUNTS = "lang binary, term binary, documents array<long>, sources array<binary>, occurrences array<long>"
_LONGS = pa.list_(pa.int64())
_ROW = pa.schema([("lang", pa.binary()), ("term", pa.binary()), ("documents", _LONGS), ("sources", pa.list_(pa.binary())), ("occurrences", _LONGS)])


class Held:
    """Counts of a language in a task: documents by level and term, occurrences by source and term."""

    def __init__(self) -> None:
        self.documents: dict[int, Counter] = defaultdict(Counter)
        self.occurrences: dict[bytes, Counter] = defaultdict(Counter)

    def add(self, source: bytes, words: list[bytes]) -> None:
        self.occurrences[source].update(words)
        for level, terms in new_terms(words):
            self.documents[level].update(terms)

    def rows(self, lang: bytes) -> Iterator[pa.RecordBatch]:
        """A row a term; one with a null term lists the sources."""
        number = {t: i for i, t in enumerate(set().union(*self.documents.values()))}
        place = lambda terms: np.fromiter(map(number.__getitem__, terms), np.int64, len(terms))
        by_level = np.zeros((len(number), max(self.documents, default=0) + 1), np.int64)
        for level, terms in self.documents.items():
            by_level[place(terms), level] = np.fromiter(terms.values(), np.int64, len(terms))
        names, sources = list(self.occurrences), list(self.occurrences.values())
        term = np.concatenate([place(c) for c in sources])
        source = np.repeat(np.arange(len(names)), [len(c) for c in sources])
        n = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for c in sources])
        order = np.argsort(term, kind="stable")
        ends = np.searchsorted(term[order], np.arange(len(number) + 1)).astype(np.int32)
        width = by_level.shape[1]
        yield pa.RecordBatch.from_pylist([{"lang": lang, "sources": names, "documents": [], "occurrences": [0] * len(names)}], _ROW)
        cols = [
            pa.repeat(pa.scalar(lang, pa.binary()), len(number)),
            pa.array(list(number), pa.binary()),
            pa.ListArray.from_arrays(pa.array(np.arange(len(number) + 1, dtype=np.int32) * np.int32(width)), pa.array(by_level.ravel())),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(names, pa.binary()).take(pa.array(source[order]))),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(n[order])),
        ]
        table = pa.RecordBatch.from_arrays(cols, schema=_ROW)
        for at in range(0, len(number), ROWS_AT_ONCE):
            yield table.slice(at, ROWS_AT_ONCE)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by language and term, combined in the task."""
    held: dict[bytes, Held] = defaultdict(Held)
    size = 0
    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            own = held[lang]
            before = len(own.occurrences[source])
            own.add(source, text.translate(_LETTERS).split())
            size += len(own.occurrences[source]) - before
            if size > HELD:
                for name, counts in held.items():
                    yield from counts.rows(name)
                held.clear()
                size = 0
    for name, counts in held.items():
        yield from counts.rows(name)


def counted(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, term, documents by level, sources, occurrences), combined by task only: one key may have several rows."""
    read = [F.coalesce(column(docs, c).cast("string"), F.lit("")).cast("binary").alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))]
    return docs.select(*read).mapInArrow(_count, _COUNTS)


def refined(counts: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term) of the terms of ``counts`` that stand in at least ``least`` documents of their language."""
    going, kept = counts.where("term IS NOT NULL").select("lang", "term", "documents"), []
    for level in count():
        size = FIRST_LEVEL << level
        added = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
        new = F.when(F.octet_length("term") < size, added(F.col("documents"))).otherwise(added(F.slice("documents", 1, level + 1)))
        prefixed = going.select("*", F.substring("term", 1, size).alias("prefix"))
        counted_ = prefixed.groupBy("lang", "prefix").agg(F.sum(new).alias("n"))
        frequent = stored(counted_.where(F.col("n") >= least).select("lang", "prefix"))
        # a prefix below the level's size is a whole term
        whole = F.octet_length("prefix") < size
        kept.append(frequent.where(whole).select("lang", F.col("prefix").alias("term")))
        longer = frequent.where(~whole)
        if longer.isEmpty():
            return reduce(DataFrame.unionByName, kept)
        going = stored(prefixed.where(~whole).join(longer, ["lang", "prefix"], "left_semi").drop("prefix"))


def _probability(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 1) / (total + terms)), exact: by longs while the product fits, else by decimals."""
    wide = lambda c: c.cast("decimal(28,0)")
    n, total, terms = (c.cast("long") for c in (n, total, terms))
    parts = (wide(n) + 1) * F.lit(BILLION).cast("decimal(10,0)")
    exact = F.call_function("div", parts.cast("decimal(38,0)"), (wide(total) + wide(terms)).cast("decimal(38,0)"))
    return 1 + F.when(n < BILLION, F.call_function("div", (n + 1) * BILLION, total + terms)).otherwise(exact)


def _term_value(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q) of whole numbers up to 10^9 + 1: the square fits in a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def _by_term(spread: DataFrame) -> DataFrame:
    """The terms that a source holds more often than its language, the most telling first."""
    f = _term_value(F.col("p"), F.col("q"))
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    telling = spread.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), f.alias("value"))
    return telling.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= TOP)


def _by_pair(spread: DataFrame, groups: DataFrame) -> DataFrame:
    """For each source of a language each other one, with f summed over all kept terms."""
    own = groups.select("lang", "source", "held", "terms", F.col("p0").alias("own0"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("held").alias("other_held"), F.col("p0").alias("other0"))
    pairs = stored(own.join(other, "lang").where("source != item"))
    # terms of both: what they add, and what they would add if one side lacked them
    mine = spread.select("lang", "term", "source", "p", F.col("p0").alias("own0"))
    theirs = spread.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("other0"))
    value = _term_value(F.col("p"), F.col("q"))
    without = _term_value(F.col("p"), F.col("other0")) + _term_value(F.col("own0"), F.col("q"))
    both = mine.join(theirs, ["lang", "term"]).where("source != item").groupBy("lang", "source", "item")
    both = both.agg(F.count(F.lit(1)).alias("common"), F.sum(value - without).alias("both"))
    # terms of one side, by their probability: each against the one that the other side has for what it lacks
    levels = spread.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("n"))
    only = pairs.select("lang", "source", "item", "other0").join(levels, ["lang", "source"])
    only = only.groupBy("lang", "source", "item").agg(F.sum(F.col("n") * _term_value(F.col("p"), F.col("other0"))).alias("mine"))
    theirs = levels.withColumnsRenamed({"source": "item", "p": "q"})
    lacked = pairs.select("lang", "source", "item", "own0").join(theirs, ["lang", "item"])
    lacked = lacked.groupBy("lang", "source", "item").agg(F.sum(F.col("n") * _term_value(F.col("own0"), F.col("q"))).alias("theirs"))
    key = ["lang", "source", "item"]
    joined = pairs.join(both, key, "left").join(only, key, "left").join(lacked, key, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    neither = F.col("terms") - F.col("held") - F.col("other_held") + zero("common")
    rest = F.when(neither > 0, neither * _term_value(F.col("own0"), F.col("other0"))).otherwise(0)
    summed = joined.select("lang", "source", F.lit("pair").alias("part"), "item", (zero("both") + zero("mine") + zero("theirs") + rest).alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return summed.withColumn("rank", F.row_number().over(best))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` compares a source with the others of its language, ``term`` with the language."""
    counts = stored(counted(docs, text, lang, source))
    listed = counts.where("term IS NOT NULL").join(stored(refined(counts)), ["lang", "term"], "left_semi")
    each = listed.select("lang", "term", F.explode(F.arrays_zip("sources", "occurrences")).alias("s"))
    by_source = each.groupBy("lang", "term", F.col("s.sources").alias("source")).agg(F.sum("s.occurrences").alias("n"))
    texts = [F.col(c).cast("string").alias(c) for c in ("lang", "source", "term")]
    # rows of a term are together already; one of them stands for it
    of_term = Window.partitionBy("lang", "term")
    by_source = by_source.withColumns({"lang_n": F.sum("n").over(of_term), "first": F.min("source").over(of_term) == F.col("source")})
    by_source = stored(by_source.select(*texts, "n", "lang_n", "first"))
    langs = by_source.groupBy("lang").agg(F.sum(F.col("first").cast("long")).alias("terms"), F.sum("n").alias("lang_total"))
    totals = by_source.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("held"))
    occurring = counts.where("term IS NULL").select("lang", F.explode("sources").alias("source")).select(*texts[:2]).distinct()
    groups = occurring.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "held", "terms", "lang_total"])
    p0 = F.when(F.col("terms") > 0, _probability(F.lit(0), F.col("total"), F.col("terms"))).otherwise(1).alias("p0")
    groups = stored(groups.select("*", p0))
    joined = by_source.join(groups, ["lang", "source"])
    p = _probability(F.col("n"), F.col("total"), F.col("terms")).alias("p")
    q = _probability(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q")
    spread = stored(joined.select("lang", "source", "term", p, q, "p0"))
    return _by_pair(spread, groups).unionByName(_by_term(spread))
