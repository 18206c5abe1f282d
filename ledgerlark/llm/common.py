"""Helpers shared by the training-data operators: shared-folder tables, words, hashes of words and shingles."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What parts words: space and the five ASCII control characters from tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"
#: Bytes and rows of text that a Python task turns into arrays at a time; a longer document is taken whole.
SLICE_BYTES, SLICE_ROWS = 1 << 19, 4096


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it. Only a session with a local master
    may do without and gets a temporary one: its tasks run in the driver, so that any folder is shared."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        found = _own[app] = _own.get(app) or f"file://{tempfile.mkdtemp(prefix='ledgerlark-')}"
    return found.rstrip("/")


#: Removes an execution's shuffle files when it has ended, so that disk holds one step's shuffles and not all of them.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet to the shared folder and reads it back, so lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*written: DataFrame) -> None:
    """Deletes tables that materialize() wrote, once nothing that is still to run reads them."""
    for df in written:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(rows: DataFrame, key: str, by: list[str], name: str, size: str | None = None) -> DataFrame:
    """rows, written, with pos, the place of each in its key, from 0, ascending by the columns `by` (nulls first), and
    key_rows, the rows of its key; with a column of sizes these are sums of sizes in place of rows.

    Rows are dealt by ranges of (key, by), so a hot key takes many tasks; rows that are equal in all of these are told
    apart by an added number, so they take many tasks too. Only a row per key and range is summed in key order.
    """
    order = [F.col(key).asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in by), F.col("row_no")]
    ranged = rows.withColumn("row_no", F.monotonically_increasing_id()).repartitionByRange(*order)
    ranged = materialize(ranged.withColumn("range_no", F.spark_partition_id()), name)
    amount = F.lit(1).cast("bigint") if size is None else F.col(size)
    ahead = (Window.unboundedPreceding, -1)
    held = ranged.groupBy(key, "range_no").agg(F.sum(amount).alias("held"))
    before = Window.partitionBy(key).orderBy("range_no").rowsBetween(*ahead)
    starts = held.select(F.col(key).alias("of_key"), F.col("range_no").alias("of_range"), F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"), F.sum("held").over(Window.partitionBy(key)).alias("key_rows"))
    within = Window.partitionBy(key, "range_no").orderBy(*order[1:]).rowsBetween(*ahead)
    placed = ranged.withColumn("pos", F.coalesce(F.sum(amount).over(within), F.lit(0)))
    placed = placed.join(starts, F.col(key).eqNullSafe(F.col("of_key")) & (F.col("range_no") == F.col("of_range")))
    out = materialize(placed.withColumn("pos", F.col("start") + F.col("pos")).drop("of_key", "of_range", "range_no", "start", "row_no"), name)
    discard(ranged)
    return out


def words_of(text: Column) -> Column:
    """The words of a text as an array; null for a null text."""
    return F.array_remove(F.split(text, SPACES), "")


def held_out(doc_id: Column) -> Column:
    """True for the documents that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


# ---- hashes in numpy; all arithmetic is modulo 2**64 ----

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
_BASE = 0x5851F42D4C957F2D
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = (x ^ (x >> _U(31))) * _ODD[0]
    x = (x ^ (x >> _U(29))) * _ODD[1]
    return x ^ (x >> _U(32))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD[2])
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse."""
    if len(_powers["up"]) < n:
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n + n // 4, base, dtype=np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Prefix sums p of a polynomial hash: bytes [a, b) hash to (p[b] - p[a]) * base**-a."""
    out = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[buf] * powers(len(buf))[0], out=out[1:])
    return out


def buffers(column: pa.Array, slice_bytes: int = SLICE_BYTES, slice_rows: int = SLICE_ROWS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a string column into (first row, end row, bytes, offsets); a null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    if not len(column):
        return
    offs = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < len(column):
        hi = min(lo + slice_rows, max(lo + 1, int(np.searchsorted(offs, offs[lo] + slice_bytes, "right")) - 1), len(column))
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every word of the documents that offs cuts buf into."""
    if not len(buf):
        return (np.zeros(0, dtype=np.int64),) * 3
    inside = ~_IS_SPACE[buf]
    first = offs[:-1][offs[:-1] < len(buf)]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    start[first] = inside[first]
    end[:-1] &= ~inside[1:]
    before = first[first > 0] - 1
    end[before] = inside[before]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


def lowered(buf: np.ndarray) -> np.ndarray:
    """A-Z as a-z; every other byte as it is."""
    return _LOWER[buf]


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    p = prefix_hash(buf)
    return mix((p[end] - p[start]) * powers(len(buf) + 1)[1][start] + (end - start).astype(np.uint64))


def shingle_sets(buf: np.ndarray, offs: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each document the sorted distinct hashes of its k-word shingles; the whole sequence as one with fewer words."""
    start, end, doc = word_spans(buf, offs)
    h = word_hashes(buf, start, end)
    bounds = np.searchsorted(doc, np.arange(len(offs)))
    n = max(len(h) - k + 1, 0)
    rolled = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        rolled += h[i : i + n] * _ODD[i]
    rolled = mix(rolled + _U(k))
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi - lo >= k:
            yield np.unique(rolled[lo : hi - k + 1])
        elif hi > lo:
            yield mix(np.array([(h[lo:hi] * _ODD[: hi - lo]).sum(dtype=np.uint64) + _U(hi - lo)], dtype=np.uint64))
        else:
            yield np.zeros(0, dtype=np.uint64)


def blobs(values: list[bytes]) -> pa.Array:
    return pa.array(values, type=pa.binary())
