"""Shared helpers: text buffers, chunking, staged tables, id hashing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on; a longer document is a step of its own.
STEP_BYTES = 1 << 20
#: Ids up to this many are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 500_000
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def staging_root(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; where that is unset, a temporary one, but only
    in local mode: on a cluster each executor would write to a disk of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tallyframe-")
        spark.sparkContext._conf.set("spark.checkpoint.dir", root)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended: the cluster cleans its folder
        pass


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` begins with."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name = f"_{name}"
    return name


def without(docs: DataFrame, id_col: str, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is not null and not in ``gone`` (staged, distinct ``id``).

    Up to BROADCAST_IDS ids are counted and broadcast, so that no text moves; more meet by a shuffle.
    """
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    key = fresh(docs, "id")
    return docs.where(F.col(id_col).cast("long").isNotNull()).join(gone.select(F.col("id").alias(key)), F.col(id_col).cast("long") == F.col(key), "left_anti")


def least_row(df: DataFrame, keys: list[str], columns: list[str], text_col: str) -> DataFrame:
    """Of rows with equal keys, the least by text and then by all columns; summed up before the shuffle."""
    whole = F.struct(*columns)
    best = F.min_by(whole, F.struct(F.col(text_col).cast("string"), F.to_json(whole)))
    return df.groupBy(*keys).agg(best.alias("row")).select("row.*")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts travel in batches of at most so many rows, from here on, so that neither side holds
    much. The setting is read when a plan runs, after the stage has returned, so it stays with the
    session; a smaller one that is already set is kept."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def released(run):
    """``run`` over batches; when a task ends, memory that its worker no longer needs goes back."""
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_bucket(column: str, n: int):
    """crc32 of the id as text, modulo n: the fixed split into learning and held-out rows."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(n)


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string or binary array; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    kind = array.type
    if array.null_count:
        array = array.fill_null(b"" if pa.types.is_binary(kind) or pa.types.is_large_binary(kind) else "")
    wide = pa.types.is_large_string(kind) or pa.types.is_large_binary(kind)
    _, at, data = array.buffers()
    size = 8 if wide else 4
    offsets = np.frombuffer(at, np.int64 if wide else np.int32, len(array) + 1, array.offset * size) if len(array) else np.zeros(1, np.int64)
    return offsets.astype(np.int64), np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def steps(offsets: np.ndarray, limit: int = STEP_BYTES, rows: int = 1 << 14):
    """Ranges (i, j) of at most so many rows with at most ``limit`` bytes, or one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n, i + rows)
        yield i, j
        i = j


def each_text(array: pa.Array):
    """The bytes of every row, null as empty."""
    offsets, data = buffers(array)
    view, at = memoryview(data), offsets.tolist()
    for i in range(len(at) - 1):
        yield bytes(view[at[i]:at[i + 1]])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), vectorised."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_rng = np.random.default_rng(20240229)
BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 3
UNBASE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**n modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        out = np.full(max(n + 1, 1 << 16), base, np.uint64)
        out[0] = 1
        _powers[base] = have = np.cumprod(out, dtype=np.uint64)
    return have[:n + 1]


#: A second polynomial, independent of the first.
BYTE_VALUES_2 = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE_2 = 0xC2B2AE3D27D4EB4F | 3
UNBASE_2 = pow(BASE_2, -1, 1 << 64)


def prefix_sums(values: np.ndarray, base: int = BASE) -> np.ndarray:
    """Sums of values times powers of the base, modulo 2**64; entry i covers values[:i]."""
    out = np.empty(len(values) + 1, np.uint64)
    out[0] = 0
    np.cumsum(values * powers(base, len(values))[:-1], out=out[1:])
    return out


def prefix_hash(data: np.ndarray) -> np.ndarray:
    return prefix_sums(BYTE_VALUES[data])


def names_of(sums: np.ndarray, start: np.ndarray, end: np.ndarray, unbase: int = UNBASE) -> np.ndarray:
    """Hashes of what lies from start to end, the same wherever it stands."""
    return mix((sums[end] - sums[start]) * powers(unbase, len(sums))[start] + (end - start).astype(np.uint64))


BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True


def word_edges(text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, stops) of words, runs of bytes without ASCII white space, and where each text of
    ``at`` begins among them; no word crosses two texts."""
    blank = BLANK[text]
    open_, close = ~blank, ~blank
    open_[1:] &= blank[:-1]
    close[:-1] &= blank[1:]
    edges = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(text))]
    open_[edges] |= ~blank[edges]
    close[edges - 1] |= ~blank[edges - 1]
    starts, stops = np.flatnonzero(open_), np.flatnonzero(close) + 1
    return starts, stops, np.searchsorted(starts, at)
