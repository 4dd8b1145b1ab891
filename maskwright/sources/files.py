"""File and corpus sources."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions.text import FILE_EXTENSIONS, extension_of, extract_text, mime_of
from maskwright.session import SPREAD

# folders that written files are dealt over: each is listed by one task
FOLDERS = 256
# tasks that read the files of a folder, at most: so many a core, or so many if that is more
TASKS_A_CORE, LEAST_TASKS = 32, 512
# bytes that a task reads where fewer tasks do, and bytes that a file counts as besides its own
TASK_BYTES, FILE_COST = 16 << 20, 1 << 19
# bytes of files, and files, of one Arrow batch; a larger file is alone
BATCH_BYTES, BATCH_FILES = 1 << 20, 1000


def corpus(df: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """``(id, text, …)``; a missing text is an empty one."""
    return df.withColumnRenamed(id_col, "id").withColumn("text", F.coalesce(text, F.lit("")))


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out evenly, where the session asks for it with a number of partitions.

    A file is split for I/O, so one small file keeps one core busy while a scan needs them all. Larger
    inputs have splits enough (``spark.sql.files.maxPartitionBytes``), and nothing is shuffled.
    """
    wanted = None if df.isStreaming else df.sparkSession.conf.get(SPREAD, None)
    return df.repartition(int(wanted)) if wanted else df


def _settle(store: FileSystem, path: str, parts: list[str]) -> None:
    """The parts become the file ``path``. It may be done again: parts go only when the file is whole."""
    try:
        whole = parts[0]
        if len(parts) > 1:
            whole = f"{path.rpartition('/')[0]}/_{uuid.uuid4().hex}"
            with store.open_output_stream(whole) as out:
                for part in parts:
                    with store.open_input_stream(part) as f:
                        while some := f.read(1 << 20):
                            out.write(some)
        store.move(whole, path)
        for part in parts[len(parts) == 1 :]:
            store.delete_file(part)
    except OSError:
        gone = any(x.type == FileType.NotFound for x in store.get_file_info(parts))
        if not gone or store.get_file_info(path).type != FileType.File:
            raise


def _by_file(df: DataFrame, root: str, key: str) -> None:
    """One file per key; a file appears when it is whole, so a task may run again.

    Texts are written where they are read, one part for each path of an Arrow batch, and only the names of the parts are
    shuffled: a part that is alone becomes the file, others are strung together.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = FileSystem.from_uri(root)
        folders = set()
        for batch in batches:
            lines, parts = {}, []
            for path, line in zip(batch.column("path").to_pylist(), batch.column("line")):
                lines.setdefault(path, []).append(line)
            for path in lines:
                folder = path.rpartition("/")[0]
                if folder not in folders:
                    store.create_dir(f"{top}/{folder}", recursive=True)
                    folders.add(folder)
                parts.append(f"{folder}/_{uuid.uuid4().hex}")
                with store.open_output_stream(f"{top}/{parts[-1]}") as out:
                    for line in lines[path]:
                        out.write(line.as_buffer())
            yield pa.record_batch([pa.array([*lines], pa.string()), pa.array(parts, pa.string())], ["path", "part"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = FileSystem.from_uri(root)
        n = 0
        for batch in batches:
            for path, parts in zip(batch.column("path").to_pylist(), batch.column("parts").to_pylist()):
                _settle(store, f"{top}/{path}", [f"{top}/{part}" for part in parts])
            n += batch.num_rows
        yield pa.record_batch([pa.array([n], pa.int64())], ["n"])

    file = F.concat(F.lit(f"{key}="), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(".txt"))
    path = F.concat(F.pmod(F.xxhash64(file), F.lit(FOLDERS)).cast("string"), F.lit("/"), file)
    line = F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).cast("binary")
    parts = df.select(path.alias("path"), line.alias("line")).mapInArrow(write, "path string, part string")
    paths = parts.groupBy("path").agg(F.collect_list("part").alias("parts"))
    paths.mapInArrow(settle, "n long").agg(F.sum("n")).collect()


def write_files(df: DataFrame, root: str, key: str) -> None:
    """The ``text`` of every row as a line of the file of its ``key``, a number: one file a key below ``root``.

    Spark's writer makes a folder for every key, and renames and lists each; it only serves where the store of
    ``root`` is none that Arrow opens.
    """
    try:
        FileSystem.from_uri(root)
    except (OSError, pa.ArrowInvalid):
        df.select(key, F.col("text").alias("value")).repartition(key).write.partitionBy(key).text(root)
    else:
        _by_file(df, root, key)


def key_of(path: Column, key: str) -> Column:
    """The key of a file of ``write_files``; null for the file of rows without one."""
    return F.nullif(F.regexp_extract(path, rf"/{key}=(-?[0-9]+)(?:\.txt$|/)", 1), F.lit("")).cast("long")


def _binary(spark: SparkSession, root: str) -> DataFrame:
    """Every file below ``root``, listed by Spark in the driver. Spark counts a file as 4 MB at least
    (``spark.sql.files.openCostInBytes``), so that a few small ones fill a split; a task here reads several splits, row by row."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return found.coalesce(_most_tasks(spark))


def _most_tasks(spark: SparkSession) -> int:
    return max(LEAST_TASKS, TASKS_A_CORE * spark.sparkContext.defaultParallelism)


def _opened(spark: SparkSession, root: str) -> tuple[str, str] | None:
    """``root`` as a URI and as Spark writes it in paths; None unless it is a folder, no pattern, in a store that Arrow opens."""
    if set("{}[]*?\\") & set(root):
        return None
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    path = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path)
    uri = path.toUri().toString()
    try:
        store, top = FileSystem.from_uri(uri)
        return (uri, path.toString().rstrip("/")) if store.get_file_info(top).type == FileType.Directory else None
    except (OSError, pa.ArrowInvalid):
        return None


def _hidden(name: str, folder: bool) -> bool:
    """Whether Spark passes over a file or folder of this name."""
    if folder and name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _walked(spark: SparkSession, uri: str, named: str) -> DataFrame:
    """What Spark's reader lists, ``(path, modificationTime, length)``, found by tasks: a task lists ``root``, then every
    folder in it is walked by one. A task holds the names of one folder at a time, the driver none."""

    def walk(deep: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def entries(store: FileSystem, top: str, folder: str) -> list[tuple[str, int | None, int | None]]:
            """Of a folder: files, and folders without a length."""
            found = []
            for x in store.get_file_info(FileSelector(f"{top}{folder}/")):
                if x.type in (FileType.File, FileType.Directory) and not _hidden(x.base_name, x.type == FileType.Directory):
                    if x.type == FileType.Directory:
                        found.append((f"{folder}/{x.base_name}", None, None))
                    elif x.size:
                        found.append((f"{folder}/{x.base_name}", x.mtime_ns // 1_000_000, x.size))
            return found

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, top = FileSystem.from_uri(uri)
            top = top.rstrip("/")
            for batch in batches:
                yield pa.record_batch(batch.filter(pc.is_valid(batch.column("length"))).columns, names)
                folders = batch.filter(pc.is_null(batch.column("length"))).column("path").to_pylist()
                while folders:
                    found = entries(store, top, folders.pop())
                    if deep:
                        folders += [path for path, _, length in found if length is None]
                        found = [x for x in found if x[2] is not None]
                    for i in range(0, len(found), 10_000):
                        columns = zip(*found[i : i + 10_000])
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))], names)

        return run

    names, rows = ["path", "at", "length"], "path string, at long, length long"
    root = spark.range(1, numPartitions=1).select(F.lit("").alias("path"), F.lit(None).cast("long").alias("at"), F.lit(None).cast("long").alias("length"))
    inside = root.mapInArrow(walk(False), rows).repartition(4 * spark.sparkContext.defaultParallelism, "path")
    path = F.concat(F.lit(named), "path").alias("path")
    return inside.mapInArrow(walk(True), rows).select(path, F.timestamp_millis("at").alias("modificationTime"), "length")


def _loaded(files: DataFrame, uri: str, named: str) -> DataFrame:
    """The rows of ``_walked`` with the ``content`` of each file, read by as many tasks as the files are worth."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = FileSystem.from_uri(uri)
        top = top.rstrip("/")
        for batch in batches:
            start, size, contents = 0, 0, []

            def held() -> pa.RecordBatch:
                rows = batch.slice(start, len(contents)).columns
                return pa.record_batch([*rows, pa.array(contents, pa.binary())], ["path", "length", "content"])

            for i, path in enumerate(batch.column("path").to_pylist()):
                with store.open_input_file(f"{top}{path[len(named):]}") as f:
                    content = f.read()
                if contents and (size + len(content) > BATCH_BYTES or len(contents) == BATCH_FILES):
                    yield held()
                    start, size, contents = i, 0, []
                size += len(content)
                contents.append(content)
            if contents:
                yield held()

    n, cost = files.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("length") + FILE_COST), F.lit(0))).first()
    spark = files.sparkSession
    tasks = min(_most_tasks(spark), max(1, min(n, spark.sparkContext.defaultParallelism), cost // TASK_BYTES))
    return files.select("path", "length").repartition(tasks, "path").mapInArrow(load, "path string, length long, content binary")


def _listed(spark: SparkSession, root: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The files below ``root``, and what adds their ``content`` to rows of them."""
    opened = _opened(spark, root)
    if opened is None:
        return _binary(spark, root), lambda files: files
    return _walked(spark, *opened), lambda files: _loaded(files, *opened)


def supported_files(spark: SparkSession, root: str) -> DataFrame:
    """Recursive listing of the supported files, without their content."""
    listed, _ = _listed(spark, root)
    return (
        listed.select("path", "modificationTime", "length")
        .withColumn("extension", extension_of(F.col("path")))
        .filter(F.col("extension").isin(*FILE_EXTENSIONS))
    )


def read_files(spark: SparkSession, root: str, max_bytes: int | None = None) -> DataFrame:
    """Text of every supported file. With ``max_bytes`` (the upload limit is MAX_BYTES), larger files
    carry an error code and are never loaded, since their length comes from the listing."""
    files, loaded = _listed(spark, root)
    files = files.filter(extension_of(F.col("path")).isin(*FILE_EXTENSIONS))
    small = loaded(files if max_bytes is None else files.filter(F.col("length") <= max_bytes)).withColumn("mime", mime_of(F.col("path")))
    none = F.lit(None).cast("string")
    ok = small.select("path", "length", "mime", extract_text(F.col("content"), F.col("mime")).alias("text"), none.alias("error_code"))
    if max_bytes is None:
        return ok
    big = files.filter(F.col("length") > max_bytes).withColumn("mime", mime_of(F.col("path")))
    big = big.select("path", "length", "mime", none.alias("text"), F.lit("FILE_TOO_LARGE").alias("error_code"))
    return ok.unionByName(big)
