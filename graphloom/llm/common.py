"""Shared pieces of the training-data operators: the exchange folder, Arrow text kernels, compact blobs.

All kernels work on the UTF-8 bytes of an Arrow string column.  Words are found for a whole slice of documents at
once, so the cost is a few numpy passes over the bytes and not a Python loop over the words.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 1 << 20
_OWN_DIR: dict[str, str] = {}

# --------------------------------------------------------------------------- exchange folder


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode an own one where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if "own" not in _OWN_DIR:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        _OWN_DIR["own"] = "file://" + tempfile.mkdtemp(prefix="graphloom-")
    return _OWN_DIR["own"]


_OPEN: list[list[str]] = []


def cut(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there, and a lost executor costs
    a re-read only."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    if _OPEN:
        _OPEN[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def scrap(spark: SparkSession, path: str) -> None:
    """Deletes a table made by cut() that no later plan reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """The tables that cut() makes inside go at the end, but those given to the function that it yields."""
    made: list[str] = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._table_path)
        return df

    _OPEN.append(made)
    try:
        yield keep
    finally:
        _OPEN.remove(made)
        for path in made:
            if path not in kept:
                scrap(spark, path)
            elif _OPEN:
                _OPEN[-1].append(path)


def fanout(df: DataFrame, target: int = 16 << 20) -> int:
    """Number of hash buckets: the session's shuffle partitions, or more where the input's size asks for it."""
    conf = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    try:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # no statistics on this kind of plan
        size = 0
    return max(conf, min(size // target, 1 << 20) if size < 1 << 60 else 0, 1)


def need(docs: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, cast; other columns, whatever their names, are left behind."""
    return docs.select(*[F.col(f"`{k}`").cast(v).alias(k) for k, v in kinds.items()])


def free(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df doesn't have, case aside."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def map_rows(df: DataFrame, run, columns: list[str]) -> DataFrame:
    """mapInArrow(run) for a function that keeps the first len(columns) columns of df; their names may hold anything."""
    kept = T.StructType([T.StructField(f"c{i}", df.schema.fields[i].dataType) for i in range(len(columns))])
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(run, kept).toDF(*columns)


def tidy(run):
    """run, and at its end free memory goes back to the system: workers are used again, and several wait side by side."""

    @functools.wraps(run)
    def each(data):
        if isinstance(data, pa.Table):
            return _freed(run(data))
        return _streamed(run, data)

    return each


def _streamed(run, batches):
    yield from run(batches)
    _freed()


def _freed(value=None):
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries lack it
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    return value


def fold_of(column: str, parts: int):
    """crc32 of the id as text, modulo parts (null ids: -1)."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % parts, F.lit(-1)).cast("int")


# --------------------------------------------------------------------------- Arrow text


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about limit bytes; a longer row stands alone."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A word is what lies between these bytes.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: For words of letters, digits and anything beyond ASCII.
NONWORD = np.zeros(256, bool)
NONWORD[:128] = True
NONWORD[48:58] = NONWORD[97:123] = False

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)
_SHINGLE = _RNG.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES + 4096)
        made = []
        for base in (_BASE, _BASE_INV):
            p = np.full(size, base & (2**64 - 1), np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        if size > 8 * SLICE_BYTES:
            return made[0], made[1]
        _POWERS[:] = made
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(buf: np.ndarray, offs: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of a slice of rows, A-Z lowered: 64-bit hash, start byte, and for each row the first word (n + 1 longs)."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    low = LOWER[buf]
    gap = sep[low]
    fresh = np.zeros(n + 1, bool)
    fresh[offs] = True
    start = ~gap
    start[1:] &= gap[:-1] | fresh[1:n]
    end = ~gap
    end[:-1] &= gap[1:] | fresh[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    power, inverse = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[low] * power[:n], out=total[1:])
    h = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return h, starts, np.searchsorted(starts, offs)


def word_ends(buf: np.ndarray, offs: np.ndarray, sep: np.ndarray) -> np.ndarray:
    """End bytes (exclusive) of the words that words() finds."""
    gap = sep[LOWER[buf]]
    fresh = np.zeros(len(buf) + 1, bool)
    fresh[offs] = True
    end = ~gap
    if len(buf):
        end[:-1] &= gap[1:] | fresh[1 : len(buf)]
    return np.flatnonzero(end) + 1


def shingles(h: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of width consecutive words and each row's offset; a row of fewer, but some, words has one for them all."""
    sizes = np.diff(first)
    counts = np.where(sizes >= width, sizes - width + 1, np.minimum(sizes, 1))
    to = np.concatenate(([0], np.cumsum(counts)))
    out = np.zeros(to[-1], np.uint64)
    if len(h) >= width:
        rolled = np.zeros(len(h) - width + 1, np.uint64)
        for k in range(width):
            rolled += h[k : len(h) - width + 1 + k] * _SHINGLE[k]
        whole = sizes >= width
        pick = np.repeat(first[:-1][whole] - to[:-1][whole], counts[whole])
        at = np.repeat(whole, counts)
        out[at] = mix(rolled[np.flatnonzero(at) + pick])
    for i in np.flatnonzero((sizes > 0) & (sizes < width)):
        own = h[first[i] : first[i + 1]]
        with np.errstate(over="ignore"):
            out[to[i]] = mix(np.array([(own * _SHINGLE[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))], np.uint64))[0]
    return out, to


# --------------------------------------------------------------------------- blobs


def pack(a: np.ndarray) -> bytes:
    """Numbers as compressed bytes."""
    return zlib.compress(np.ascontiguousarray(a).tobytes(), 1)


def unpack(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), dtype)


def pack_sorted(h: np.ndarray, drop: int = 8) -> bytes:
    """Sorted 64-bit hashes without their drop lowest bits: the differences' bytes, low planes first (the high ones are
    mostly zero)."""
    d = np.diff(h >> np.uint64(drop), prepend=np.uint64(0))
    planes = d.view(np.uint8).reshape(-1, 8)
    used = int(planes.any(0).nonzero()[0][-1]) + 1 if len(d) and d.any() else 1
    low = min(4, used)
    return bytes([low, used]) + planes[:, :low].tobytes() + zlib.compress(np.ascontiguousarray(planes[:, low:used].T).tobytes(), 1)


def unpack_sorted(b: bytes, n: int) -> np.ndarray:
    low, used = b[0], b[1]
    planes = np.zeros((n, 8), np.uint8)
    planes[:, :low] = np.frombuffer(b, np.uint8, n * low, 2).reshape(n, low)
    if used > low:
        planes[:, low:used] = np.frombuffer(zlib.decompress(b[2 + n * low :]), np.uint8).reshape(used - low, n).T
    return np.cumsum(planes.reshape(-1).view(np.uint64), dtype=np.uint64)


def table(schema: str, **columns) -> pa.RecordBatch:
    """A record batch of plain lists or arrays; schema: name type, ... of Spark's long, int, double, string, binary, boolean."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    names = [x.split() for x in schema.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(columns[n], kinds[k]) for n, k in names], [n for n, _ in names])
