"""Shared ground of the training-data operators: inputs, shared tables, chunks.

Null rules used by every operator here: a null text counts as the empty text; a
null ``doc_id`` is reported as null and ordered before every other id.
Operators select the columns they need first, or name their working columns apart
from all columns of the input (free_prefix), so extra columns of any name cannot clash.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id while ids are compared as plain integers.
NULL_ID = -(2**63)
_made: list[tuple[SparkSession, str]] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free_prefix(docs: DataFrame, base: str) -> str:
    """base, with as many underscores before it as keep it apart from the beginnings of all columns."""
    while any(c.lower().startswith(base.lower()) for c in docs.columns):
        base = f"_{base}"
    return base


def join_one(many: DataFrame, one: DataFrame, key: str, total: int) -> DataFrame:
    """many joined to the row of one that has its key, without a task for any one key.

    one has a row per key and n, the rows of many that have that key; total: the rows of many. A key
    of more than a thousandth of them is broadcast: there are at most a thousand such keys.
    """
    hot = few(one.where(F.col("n") * 1000 > total).drop("n"), 64 * total)
    rest = many.join(F.broadcast(hot.select(key)), key, "left_anti").join(one.where(F.col("n") * 1000 <= total).drop("n"), key)
    return many.join(F.broadcast(hot), key).unionByName(rest)


def id_and_text(docs: DataFrame) -> DataFrame:
    """The two columns most operators work on: doc_id as long, text without nulls."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo folds (null id: the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset and the
    master is local, as in tests, a folder on this machine takes its place.
    """
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that the driver and the executors share")
        got = getattr(spark, "_own_shared_folder", None) or f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark._own_shared_folder = got
    return got


def bounded_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Limits the session's Arrow batches to so many bytes, for tables with rows of a megabyte."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, "64m")
    size = int(re.sub(r"\D", "", now)) << {"k": 10, "m": 20, "g": 30}.get(now.rstrip("bB")[-1:].lower(), 0)
    if size > most or size <= 0:
        spark.conf.set(key, str(most))


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written once as a table in the shared folder, and read again.

    This cuts the lineage: a lost executor costs only the tasks it was running.
    The tables are removed when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    if not _made:
        atexit.register(_remove)
    _made.append((spark, path))
    del df
    for _ in range(2):  # lets Spark delete the shuffle files that nothing refers to any more
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.1)
    return spark.read.schema(schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Removes a table made by stored() whose readers have all ended."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        for i, (spark, p) in enumerate(_made):
            if p.split(":", 1)[-1].replace("///", "/") == path.split(":", 1)[-1].replace("///", "/"):
                _delete(spark, p)
                del _made[i]
                break


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _remove() -> None:
    while _made:
        spark, path = _made.pop()
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before this; nothing is left to do then
            return


def ids_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.asarray(column.fill_null(NULL_ID)).astype(np.int64)


def id_array(ids) -> pa.Array:
    a = np.asarray(ids, np.int64)
    return pa.array(a, pa.int64(), mask=a == NULL_ID)


def doc_batches(batches: Iterator[pa.RecordBatch], rows: int = 1024, size: int = 4 << 20) -> Iterator[tuple[np.ndarray, list[bytes], pa.RecordBatch]]:
    """Slices of at most ``rows`` documents and about ``size`` bytes: ids, texts as UTF-8 bytes, and the slice itself.

    A single longer text forms a slice of its own; it is never cut.
    """
    for batch in batches:
        at = batch.schema.get_field_index("text")
        if not batch.num_rows:
            continue
        col = batch.column(at).cast(pa.large_binary())
        for lo, hi in slices(np.asarray(pa.compute.binary_length(col).fill_null(0)), rows, size):
            part = batch.slice(lo, hi - lo)
            yield ids_of(part.column(part.schema.get_field_index("doc_id"))), [x or b"" for x in col.slice(lo, hi - lo).to_pylist()], part
    trim()


def slices(lengths: np.ndarray, rows: int, size: int) -> Iterator[tuple[int, int]]:
    """First and last (exclusive) of slices of at most so many rows and about size bytes in all, from the rows' lengths; a longer row is a slice of its own."""
    ends, lo = np.cumsum(lengths), 0
    while lo < len(ends):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, min(lo + rows, int(np.searchsorted(ends, before + size, "right"))))
        yield lo, hi
        lo = hi


def trim() -> None:
    """Gives memory that Python and Arrow have freed back to the system, where the C library can."""
    global _libc
    pa.default_memory_pool().release_unused()
    if _libc is None:
        try:
            _libc = ctypes.CDLL("libc.so.6").malloc_trim
        except (OSError, AttributeError):
            _libc = id  # another C library: nothing to do
    _libc(0)


_libc = None


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def few(df: DataFrame, n_bytes: int, each: int = 8 << 20) -> DataFrame:
    """df in fewer partitions, without a shuffle, if the session's number of them would leave less than each of n_bytes to a task.

    At least four tasks a core stay. The driver keeps an entry for every task of many past jobs, so
    small tables that are used in job after job should not have hundreds of them.
    """
    spark = df.sparkSession
    n = max(4 * spark.sparkContext.defaultParallelism, -(-n_bytes // each))
    return df.coalesce(n) if n < int(spark.conf.get("spark.sql.shuffle.partitions")) else df


def parts_for(spark: SparkSession, n_bytes: int, each: int = 4 << 20, least: int = 128) -> int:
    """A number of hash buckets that keeps each near ``each`` bytes; a power of two."""
    n = max(least, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // each))
    return 1 << (n - 1).bit_length()
