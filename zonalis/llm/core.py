"""What the operators share: the shared folder, staged tables, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that one numpy step works on; longer texts are hashed piece by piece.
SLICE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder of its own; any
    other session the warehouse folder, which its executors can reach too.
    """
    conf = spark.conf
    folder = conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            folder = "file://" + tempfile.mkdtemp(prefix="zonalis-")
        else:
            folder = conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_zonalis"
        conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the session ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


#: Rows of a few long integers that a staged file holds at least, if their number is known.
FILE_ROWS = 500_000


def stage(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there,
    and a lost executor costs no more than a reread. ``rows``: their number, if the
    caller knows it, so that a small table becomes few files."""
    path = new_path(df.sparkSession, name)
    if rows is not None:
        df = df.coalesce(1 + rows // FILE_ROWS)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in df.inputFiles()[:1]:
        p = jvm.org.apache.hadoop.fs.Path(f).getParent()
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Texts that Python gets at a time where its memory is short; Spark's default is 10000.
BATCH_ROWS = 1000


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS):
    """What runs within sends Arrow batches of at most ``rows`` rows: the JVM, outside its
    heap, and the Python worker of each task hold a batch of whole texts each."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(old)) if int(old) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def sweep(spark: SparkSession) -> None:
    """Let the driver collect the plans that nothing refers to any more: executors then delete
    the shuffle files of finished stages, which else stay on their disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release() -> None:
    """Give freed memory back to the system: workers live on between stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary or string array and its offsets, from 0; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each hold about ``limit`` bytes, or one text."""
    for batch in batches:
        _, offsets = flat_bytes(batch.column(batch.schema.get_field_index(text)))
        i, n = 0, batch.num_rows
        while i < n:
            j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1))
            yield batch.slice(i, j - i)
            i = j


def plain(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns named ``c0, c1, ...``, as Arrow functions want no dots in names."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))


def binary_column(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary array whose rows are runs of ``flat``, ``counts`` elements each."""
    at = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts * flat.dtype.itemsize, out=at[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())


def starts(counts: np.ndarray) -> np.ndarray:
    """Where each run begins, and the end of all."""
    at = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=at[1:])
    return at


class Bloom:
    """A filter of ``2**n`` bits, packed, whatever it holds: full, it lets all pass."""

    SLICES = 64

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits
        self.n = len(bits).bit_length() + 2

    @staticmethod
    def slots(ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        from .hashing import mix

        h = mix(ids.astype(np.int64).view(np.uint64))
        return (h & np.uint64((1 << n) - 1)).astype(np.int64), (h >> np.uint64(64 - n)).astype(np.int64)

    @staticmethod
    def mark(bits: np.ndarray, at: np.ndarray) -> None:
        np.bitwise_or.at(bits, at >> 3, np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)))

    def find(self, ids: np.ndarray) -> np.ndarray:
        a, b = self.slots(ids, self.n)
        on = (self.bits[a >> 3] >> (a & 7).astype(np.uint8)) & (self.bits[b >> 3] >> (b & 7).astype(np.uint8))
        return (on & np.uint8(1)).view(bool)


def bloom(ids: DataFrame, key=None, n: int = 24) -> Bloom:
    """A filter of ``2**n`` bits of the integers in the first column of ``ids``, or of what
    ``key`` makes of a batch; merged by slices on the executors. Tasks send a slice's
    places where it holds few, else its bits."""
    part = (1 << n) // Bloom.SLICES

    def mark(batches):
        bits = np.zeros((1 << n) // 8, np.uint8)
        for batch in batches:
            for at in Bloom.slots(key(batch) if key else batch.column(0).to_numpy(), n):
                Bloom.mark(bits, at)
        rows = bits.reshape(Bloom.SLICES, -1)
        for i in np.flatnonzero(rows.any(1)):
            at = np.flatnonzero(np.unpackbits(rows[i], bitorder="little"))
            few = 4 * len(at) < rows.shape[1]
            raw = at.astype("<u4").tobytes() if few else rows[i].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([int(i)]), pa.array([bool(few)]), pa.array([raw], pa.binary())], ["slice", "few", "bits"])
        del bits, rows
        release()

    def merge(table):
        bits = np.zeros(part // 8, np.uint8)
        for few, raw in zip(table["few"].to_pylist(), table["bits"].to_pylist(), strict=True):
            if few:
                Bloom.mark(bits, np.frombuffer(raw, "<u4").astype(np.int64))
            else:
                bits |= np.frombuffer(raw, np.uint8)
        return pa.table([table["slice"].slice(0, 1), pa.array([bits.tobytes()], pa.binary())], ["slice", "bits"])

    got = ids.mapInArrow(mark, "slice long, few boolean, bits binary").groupBy("slice").applyInArrow(merge, "slice long, bits binary").toArrow()
    bits = np.zeros((Bloom.SLICES, part // 8), np.uint8)
    for i, x in zip(got["slice"].to_pylist(), got["bits"], strict=True):
        bits[i] = np.frombuffer(x.as_buffer(), np.uint8)
    del got
    release()
    return Bloom(bits.ravel())
