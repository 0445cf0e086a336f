"""What the operators share: the shared scratch folder, tables written there, text buffers of Arrow arrays, files."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_made: dict[str, SparkSession] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which the driver and all executors share, as a full URI.

    A path without a scheme is one of the cluster's default file system. Where the setting is missing, a local session
    gets a temporary folder of its own; a cluster without it is refused.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="quire-")
        context.setCheckpointDir(root)
    path = context._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString()


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder below the shared one; it goes when the driver's Python ends, or with ``forget``."""
    path = f"{scratch_root(spark).rstrip('/')}/quire-{uuid.uuid4().hex}/{tag}"
    _made[path.rsplit("/", 1)[0]] = spark
    return path


def forget(spark: SparkSession | None = None) -> None:
    """Delete the scratch folders made so far (of one session, or all)."""
    for path, owner in list(_made.items()):
        if spark is None or owner is spark:
            _made.pop(path)
            remove(owner, path)


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may have ended
        return


atexit.register(forget)


def written(df: DataFrame, tag: str) -> DataFrame:
    """df, computed once and read back from a table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def superseded(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 2)[0] for f in df.inputFiles()}:
            for path in [p for p in _made if p.split(":")[-1].lstrip("/") == folder.split(":")[-1].lstrip("/")]:
                _made.pop(path)
                remove(spark, path)


def swept(spark: SparkSession) -> None:
    """Has the driver collect its garbage, so that the shuffle files of plans that are gone leave the disk now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of the session's Python operators hold at most so many rows: buffers of tens of MB leave the JVM's and the workers' allocators in pieces that they don't give back."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", min(rows, int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) or rows))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def text_of(column: str | Column = "text") -> Column:
    """The column as a string; null counts as empty."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit(""))


def remainder(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the fold of a row."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(-1))


def fresh(taken: list[str], stem: str) -> str:
    """A column name like stem that none of those taken equals, case aside."""
    low, name = {t.lower() for t in taken}, stem
    while name.lower() in low:
        name += "_"
    return name


def raw_texts(array: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each value, without making strings; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    if len(array) == 0:
        return
    wide = pa.types.is_large_string(array.type)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].tolist()
    view = memoryview(data) if data is not None else memoryview(b"")
    for a, b in zip(at, at[1:]):
        yield bytes(view[a:b])


_BASE, PIECE = 0x9E3779B97F4A7C15, 1 << 20
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]  # of the base and of its inverse


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word between spaces: a polynomial in its bytes, from differences of sums over the text, about PIECE bytes at a time."""
    out, at = [], 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        b = np.frombuffer(text, np.uint8, end - at, at)
        if len(_powers[0]) <= len(b):
            for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
                steps = np.full(len(b) + 1, base, np.uint64)
                steps[0] = 1
                _powers[i] = np.multiply.accumulate(steps)
        shown = np.zeros(len(b) + 2, np.int8)
        shown[1:-1] = b != 32
        turns = np.diff(shown)
        starts, ends = np.flatnonzero(turns > 0), np.flatnonzero(turns < 0)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _powers[0][: len(b)], out=sums[1:])
        out.append(mixed((sums[ends] - sums[starts]) * _powers[1][starts]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def release() -> None:
    """Gives memory that this worker no longer uses back to the system; Arrow's and the C library's allocators keep it else."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it that a folder's URI or plain path names."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


#: Bytes up to which a written table is broadcast, and parts that a key is split into where it is not.
SMALL, SALTS = 32 << 20, 16


def stored_bytes(df: DataFrame) -> int:
    """Bytes that the plan of a table read from files says it has."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def joined_small(big: DataFrame, small: DataFrame, key: str, spread: str) -> DataFrame:
    """The equi-join of big with a written table: broadcast if that is SMALL, else with each key dealt into SALTS parts by big's column spread, as a key may hold a third of big."""
    if stored_bytes(small) <= SMALL:
        return big.join(F.broadcast(small), key)
    salt = fresh([*big.columns, *small.columns], "salt")
    parts = small.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return big.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(SALTS))).join(parts, [key, salt]).drop(salt)


def without(big: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of big whose keys a written table lacks: broadcast if that is SMALL, so that big isn't moved."""
    return big.join(F.broadcast(small) if stored_bytes(small) <= SMALL else small, keys, "left_anti")


def has_rows(df: DataFrame) -> bool:
    return not df.isEmpty()
