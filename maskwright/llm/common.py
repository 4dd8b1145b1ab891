"""Helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: a word is a longest run without the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

# Rows of text that one Arrow batch may hold; Spark also ends a batch by bytes where it is told to.
TEXT_ROWS_PER_BATCH = 1000


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Only a local master may do without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="maskwright-llm-")
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: lost executors then cost no recomputation."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column that later expressions refer to and never compute again: projections stay apart from a generator."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def n_words(text: Column) -> Column:
    """Words of a text as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def column(df: DataFrame, name: str) -> Column:
    """The column called exactly ``name``, also where the name holds dots."""
    return df[f"`{name}`"]


def packed(df: DataFrame) -> DataFrame:
    """All columns as one struct ``row``, so that columns which an operator adds meet none of the same name."""
    return df.select(F.struct(*(column(df, c) for c in df.columns)).alias("row"))


def unpacked(df: DataFrame, columns: list[str], **added: Column) -> DataFrame:
    """The columns of ``row`` and those added; an added one takes the place of one of the same name."""
    kept = [F.col("row").getField(c).alias(c) for c in columns if c not in added]
    return df.select(*kept, *(v.alias(k) for k, v in added.items()))


def slices(arrays: list[pa.Array], rows: int) -> Iterator[list[pa.Array]]:
    """Equally long arrays, cut alike into pieces of some rows."""
    for at in range(0, len(arrays[0]), rows):
        yield [a.slice(at, rows) for a in arrays]


def slices_by_size(arrays: list[pa.Array], texts: pa.Array, most: int) -> Iterator[list[pa.Array]]:
    """Equally long arrays, cut alike into pieces of about ``most`` bytes of text; a longer text is alone."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield [a.slice(start, i - start) for a in arrays]
            start, total = i, 0
        total += size
    if sizes:
        yield [a.slice(start) for a in arrays]


def by_document(
    df: DataFrame, columns: list[Column], schema: str, work: Callable[[list[pa.Array]], Iterator[pa.RecordBatch]]
) -> DataFrame:
    """Run ``work`` over Arrow batches of the given columns; bounded rows at a time, one output for any input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.columns, TEXT_ROWS_PER_BATCH):
                yield from work(part)

    return df.select(*columns).mapInArrow(run, schema)
