"""Tables that operators make on the way: in the shared folder, gone when nothing reads them any more."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_OPEN: list[set[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; in local mode one of its own where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if "own" not in _OWN:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        _OWN["own"] = "file://" + tempfile.mkdtemp(prefix="graphloom-")
    return _OWN["own"]


def reliable(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read back: lineage ends there, and what a lost executor held is read again."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _OPEN:
        _OPEN[-1].add(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that reliable() makes inside are deleted at the end, but those that a DataFrame given to the yielded function
    reads: what the caller returns."""
    made: set[str] = set()
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        files = df.inputFiles()
        kept.update(p for p in made if any(p.rsplit("/", 1)[1] in f for f in files))
        return df

    _OPEN.append(made)
    try:
        yield keep
    finally:
        _OPEN.remove(made)
        for path in made - kept:
            delete(spark, path)
        if _OPEN:
            _OPEN[-1].update(kept)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """Batches of texts in parts of a few rows: what a task makes of a part as Python objects is gone before the next."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def bytes_of(df: DataFrame) -> int:
    """Spark's estimate of the size of df."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def in_file_order(df: DataFrame, file: str, row: str) -> DataFrame:
    """df, as read from Parquet, with where each row stands: the number of its file, in the order of paths, and its place there."""
    paths = sorted(r[0] for r in df.select("_metadata.file_path").distinct().collect())  # as many as files
    numbers = df.sparkSession.createDataFrame([(p, i) for i, p in enumerate(paths)], f"file_path string, {file} int")
    rows = df.select("*", F.col("_metadata.row_index").alias(row), F.col("_metadata.file_path").alias("file_path"))
    return rows.join(F.broadcast(numbers), "file_path").drop("file_path")


def spread(df: DataFrame, limit: int = 256 << 20) -> DataFrame:
    """df dealt over all cores where it is a small table, which may be a single file and so a single task; a large one
    stays where it is read."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if bytes_of(df) <= limit else df


def dealt(df: DataFrame, size: int = 8 << 20) -> DataFrame:
    """df dealt over tasks of about size bytes by a hash of its rows, however few files or row groups it is read from: for
    steps whose work on a row is far more than moving it."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-bytes_of(df) // size)), F.xxhash64(*df.columns))
