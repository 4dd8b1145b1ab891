"""Running a stream to its end and keeping what it writes replay-safe.

Every micro-batch writes to its own ``batch=N`` folder in overwrite mode, so a batch that is run
again after a failure replaces itself instead of appending twice. Tables that are updated rather
than appended to are read as "last batch wins per key". Their batches are runs of level 0; every so many
runs of a level are merged into one of the next, which holds one row a key. So a version is written
again once a level, that is a logarithmic number of times, and a reader meets few runs of each level.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.session import checkpoint_root

# runs of a level that are merged into one of the next
COMPACT_EVERY = 8

BatchWriter = Callable[[DataFrame, int], None]


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def file_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream over ``<folder>/<name>.parquet`` (or every ``<name>*.parquet``); each may be a file or a folder of files.

    A folder of files may be partitioned: a stream over a pattern finds the columns in folder names by ``basePath`` only.
    """
    path = f"{folder}/{name}*.parquet"
    base = {"basePath": folder} if _exists(spark, folder) else {}  # no such path: ``folder`` is a pattern itself
    reader = spark.readStream.schema(spark.read.options(**base).parquet(path).schema).options(**base)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run(stream: DataFrame, out: str, write: BatchWriter, mode: str = "append") -> None:
    """Process all available input, then stop."""
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()


def batch_folder(out: str, table: str, batch_id: int) -> str:
    return f"{out}/{table}/batch={batch_id}"


def save(df: DataFrame, out: str, table: str, batch_id: int, by: Sequence[str] = ()) -> str:
    path = batch_folder(out, table, batch_id)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return path


def table(spark: SparkSession, out: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{out}/{name}")


def last_version(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of several versions of a key, the one of the latest batch."""
    rest = [c for c in df.columns if c not in keys and c != "batch"]
    best = F.max_by(F.struct(*rest), "batch").alias("_v")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_v.{c}").alias(c) for c in rest])


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _level(name: str, level: int) -> str:
    return name if level == 0 else f"{name}-compact{level if level > 1 else ''}"


def _merged(spark: SparkSession, out: str, name: str, runs: list[tuple[int, int]], keys: Sequence[str]) -> DataFrame:
    """Last version of every key in runs (level, last batch)."""
    read = lambda level, batch: spark.read.parquet(batch_folder(out, _level(name, level), batch)).withColumn("batch", F.lit(batch))
    return last_version(reduce(DataFrame.unionByName, (read(*r) for r in runs)), keys)


def save_version(
    df: DataFrame,
    out: str,
    name: str,
    batch_id: int,
    keys: Sequence[str],
    every: int | None = None,
    retire: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Save a batch's new versions of some keys; the batch that completes ``every`` runs of a level merges them.

    ``retire`` drops versions that nobody will ask for; what it drops must stay dropped later. A batch that
    is run again reads the same runs and writes the same merged ones again.
    """
    save(df, out, name, batch_id)
    every = every or COMPACT_EVERY
    level, batches = 1, every
    while (batch_id + 1) % batches == 0:
        below = [(level - 1, batch_id - i * (batches // every)) for i in range(every)]
        one = _merged(df.sparkSession, out, name, [r for r in below if _exists(df.sparkSession, batch_folder(out, _level(name, r[0]), r[1]))], keys)
        save(retire(one) if retire else one, out, _level(name, level), batch_id)
        level, batches = level + 1, batches * every


def runs_upto(spark: SparkSession, out: str, name: str, upto: int, every: int | None = None) -> list[tuple[int, int]]:
    """Runs (level, last batch) that together hold all batches to ``upto``, newest first: the highest level at each end."""
    every = every or COMPACT_EVERY
    there = lambda level, batch: _exists(spark, batch_folder(out, _level(name, level), batch))
    found, end = [], upto
    while end >= 0:
        level = 0
        while (end + 1) % every ** (level + 1) == 0 and there(level + 1, end):
            level += 1
        if level or there(0, end):
            found.append((level, end))
        end -= every**level
    return found


def _newest_batch(spark: SparkSession, out: str, name: str) -> int:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/{name}")
    names = [s.getPath().getName() for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)]
    return max(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))


def latest(spark: SparkSession, out: str, name: str, keys: Sequence[str], upto: int | None = None, every: int | None = None) -> DataFrame:
    """Last version of every key, as of batch ``upto`` or the newest one."""
    upto = _newest_batch(spark, out, name) if upto is None else upto
    return _merged(spark, out, name, runs_upto(spark, out, name, upto, every), keys)
