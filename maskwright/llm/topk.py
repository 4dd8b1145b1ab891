"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector of whole numbers is summarised by the mean and the deviation of its segments, at several
resolutions. For two vectors, the sum over segments of length * (mean * mean + deviation * deviation)
is an upper bound of their inner product, hence a lower bound of their distance, and the finer the
segments, the closer. Candidates whose coarse bound falls short of a query's k-th best score so far
are left; the rest is tested at the next resolution, and survivors are scored exactly.

The vectors are written once as whole numbers. Queries go out in blocks of a fixed size, several blocks
to a pass over all rows, so that the statistics of a row serve all of them; each task keeps the k best of
its rows for each query, and these are ranked over all tasks.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part, as
rows without an id. Components missing in the shorter of two vectors count 0. A query's own row is told
by its id; of several queries with one id, that of the least vector is asked. Equal scores are ordered by id; rows equal in id and vector count once each, so they may
take several ranks. Components beyond the range of long count as the nearest long; scores are exact, and
one beyond that range is shown, and ranked, as the nearest long. Vectors of any length are taken whole. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.common import column, stored

# queries of a block, and blocks of a pass; with their statistics they are what a task holds of all queries
QUERIES_AT_ONCE = 1024
BLOCKS_AT_ONCE = 8
# rows that are compared together with a block
ROWS_AT_ONCE = 1024
# pairs of a query and a row that finer bounds and exact scores are computed for together
PAIRS_AT_ONCE = 1 << 16
# products of lengths up to which inner products fit a long; beyond it they are taken in Python's integers
LONG_SAFE = 2.0**62
# segments of a vector, from coarse to fine
RESOLUTIONS = (1, 4, 16)


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of the components as long; null where the vector takes no part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    usable = vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False))
    return F.when(usable, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of ``width`` numbers; shorter vectors are filled with 0, longer ones cut, as a query has no more."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.values.to_numpy(zero_copy_only=False)[vectors.offsets[0].as_py() : vectors.offsets[-1].as_py()]
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    start = np.cumsum(lengths) - lengths
    for i, (a, n) in enumerate(zip(start.tolist(), lengths.tolist())):
        out[i, : min(n, width)] = flat[a : a + min(n, width)]
    return out


def segment_statistics(vectors: np.ndarray, parts: int) -> np.ndarray:
    """Means and deviations of the segments, times the root of their lengths, side by side.

    The product of two such rows bounds the inner product of their vectors from above.
    """
    edges = np.linspace(0, vectors.shape[1], min(parts, vectors.shape[1]) + 1).astype(int)
    sizes = np.diff(edges)
    x = vectors.astype(np.float64)
    mean = np.add.reduceat(x, edges[:-1], axis=1) / sizes
    spread = x - np.repeat(mean, sizes, axis=1)
    deviation = np.sqrt(np.add.reduceat(spread * spread, edges[:-1], axis=1) / sizes)
    return np.hstack([mean, deviation]) * np.sqrt(np.hstack([sizes, sizes]))


def inner_products(a: np.ndarray, b: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Products of the rows of two matrices, exact where ``bound`` (the product of their lengths) allows a long."""
    score = np.einsum("ij,ij->i", a, b)
    limits = np.iinfo(np.int64)
    for i in np.flatnonzero(bound > LONG_SAFE).tolist():
        whole = sum(x * y for x, y in zip(a[i].tolist(), b[i].tolist()))
        score[i] = min(max(whole, limits.min), limits.max)
    return score


class Rows:
    """Rows that are compared together, with statistics that serve every block of queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.levels = [segment_statistics(vectors, p) for p in RESOLUTIONS]
        self.lengths = np.linalg.norm(vectors.astype(np.float64), axis=1)


class Block:
    """Queries of one block, their statistics, and the k best of the rows seen so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.levels = [segment_statistics(vectors, p) for p in RESOLUTIONS]
        self.lengths = np.linalg.norm(vectors.astype(np.float64), axis=1)
        n = len(ids)
        self.least = np.iinfo(np.int64).min
        self.scores = np.full((n, k), self.least)
        self.found = np.full((n, k), np.iinfo(np.int64).max)
        # a score that k rows are known to reach: lower ones need not be looked at
        self.floor = np.full(n, -np.inf) if floor is None else floor
        self.compared = 0

    def add(self, rows: Rows) -> None:
        """Take rows in: bounds from coarse to fine, then exact scores of what survives.

        The coarse bounds are one product of matrices; surviving pairs go on in parts of a fixed size.
        """
        least = np.maximum(self.floor, np.where(self.scores[:, -1] > self.least, self.scores[:, -1].astype(np.float64), -np.inf))
        # what rounding may take from a bound
        product = self.lengths[:, None] * rows.lengths
        margin = 1e-9 * product + 1e-6
        q, r = np.nonzero(self.levels[0] @ rows.levels[0].T + margin >= least[:, None])
        for at in range(0, len(q), PAIRS_AT_ONCE):
            a, b = q[at : at + PAIRS_AT_ONCE], r[at : at + PAIRS_AT_ONCE]
            keep = self.ids[a] != rows.ids[b]
            a, b = a[keep], b[keep]
            for mine, theirs in zip(self.levels[1:], rows.levels[1:]):
                near = np.einsum("ij,ij->i", mine[a], theirs[b]) + margin[a, b] >= least[a]
                a, b = a[near], b[near]
            self.compared += len(a)
            if len(a):
                self._keep(a, rows.ids[b], inner_products(self.vectors[a], rows.vectors[b], product[a, b]))

    def _keep(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        touched = np.unique(q)
        place = np.repeat(touched, self.k)
        all_q = np.concatenate([place, q])
        all_s = np.concatenate([self.scores[touched].ravel(), score])
        all_i = np.concatenate([self.found[touched].ravel(), ids])
        order = np.lexsort((all_i, ~all_s, all_q))  # ~s orders from high to low without overflow
        all_q, all_s, all_i = all_q[order], all_s[order], all_i[order]
        first = np.searchsorted(all_q, touched)
        rows = first[:, None] + np.arange(self.k)
        self.scores[touched], self.found[touched] = all_s[rows], all_i[rows]

    def best(self) -> pa.RecordBatch:
        full = self.found < np.iinfo(np.int64).max
        q = np.repeat(self.ids, self.k).reshape(full.shape)[full]
        return pa.RecordBatch.from_arrays([pa.array(q), pa.array(self.found[full]), pa.array(self.scores[full])], ["query_id", "vec_id", "score"])


def _search(blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int):
    width = max(vectors.shape[1] for _, vectors, _ in blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [Block(ids, vectors, k, floor) for ids, vectors, floor in blocks]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                rows = Rows(part.column(0).to_numpy(), _matrix(part.column(1), width))
                for block in asked:
                    block.add(rows)
        for block in asked:
            yield block.best()

    return run


def _wide(vectors: list[list[int]], width: int) -> np.ndarray:
    return _matrix(pa.array(vectors, pa.list_(pa.int64())), width)


def _floor(sample: list, ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Scores that k rows of a sample reach; they bound the k-th best of all rows from below."""
    block = Block(ids, vectors, k)
    for at in range(0, len(sample), ROWS_AT_ONCE):
        part = sample[at : at + ROWS_AT_ONCE]
        block.add(Rows(np.array([r.id for r in part], np.int64), _wide([r.v for r in part], vectors.shape[1])))
    return np.where(block.scores[:, -1] > block.least, block.scores[:, -1].astype(np.float64), -np.inf)


def search(
    rows: DataFrame,
    queries: DataFrame,
    k: int = 5,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    scale: int = 256,
    sample: int = 2048,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of each query.

    Queries come to the driver pass by pass, each of at most BLOCKS_AT_ONCE blocks of QUERIES_AT_ONCE rows,
    and go out with that pass's tasks; its results are written as they are done. A bounded sample of rows
    gives each query a first threshold.
    """
    named = lambda df: df.select(column(df, vec_id).cast("long").alias("id"), whole_numbers(column(df, vector), scale).alias("v")).where(
        "id IS NOT NULL AND v IS NOT NULL"
    )
    spark, candidates = rows.sparkSession, stored(named(rows))
    known = candidates.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    schema = "query_id long, vec_id long, score long"
    parts: list[DataFrame] = []

    def run(asked: list) -> None:
        # one width for a pass, so that a row is laid out once for all its blocks
        width = max(len(r.v) for r in asked)
        blocks = []
        for at in range(0, len(asked), QUERIES_AT_ONCE):
            some = asked[at : at + QUERIES_AT_ONCE]
            ids, vectors = np.array([r.id for r in some], np.int64), _wide([r.v for r in some], width)
            blocks.append((ids, vectors, _floor(known, ids, vectors, k)))
        best = candidates.mapInArrow(_search(blocks, k), schema)
        ranked = best.select("*", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).alias("rank"))
        parts.append(stored(ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")))

    asked: list = []
    for row in named(queries).groupBy("id").agg(F.min("v").alias("v")).toLocalIterator():
        asked.append(row)
        if len(asked) == QUERIES_AT_ONCE * BLOCKS_AT_ONCE:
            run(asked)
            asked = []
    if asked:
        run(asked)
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return reduce(DataFrame.unionByName, parts)
