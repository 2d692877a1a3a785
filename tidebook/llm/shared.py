"""Where operators keep intermediate tables, and texts packed into chunks."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm import textkit

#: Texts of about this many bytes form a chunk, the unit that asks and is answered; a longer text stands alone.
CHUNK_BYTES = 8 << 20
#: Bytes of text from which chunks and buckets grow with the root of the input, so that the rows that they exchange grow
#: in proportion to it, up to chunks of MAX_GROWTH times CHUNK_BYTES.
GROWTH_BYTES, MAX_GROWTH = 1 << 30, 8.0

#: Up to so many row numbers are broadcast; beyond, the join is left to Spark.
BROADCAST_ROWS = 1_000_000

#: Rows and bytes of an Arrow batch while an operator writes a table.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20

CHUNK_SCHEMA = "chunk long, docs long, words long, bytes long, blob binary"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidebook-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def bound_batches(spark: SparkSession) -> dict[str, str]:
    """Bounds the Arrow batches of a session in rows and bytes, as rows with whole texts are large; the settings before."""
    before = {}
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        before[key] = spark.conf.get(key)
        spark.conf.set(key, str(most))
    return before


def release() -> None:
    """Gives memory that earlier tasks of this Python worker have freed back to the system, as workers live on from stage
    to stage."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Bounded batches while a table is written."""
    before = bound_batches(spark)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes a table into the shared folder and reads it back: lineage is cut, and a lost executor costs no rework."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, name: str = "numbered", **more: Column) -> DataFrame:
    """A written table of docs, each row as a struct `doc` under a number `row`, with what `more` names; see unpacked."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    return materialize(rows.select("doc", F.monotonically_increasing_id().alias("row"), *(c.alias(k) for k, c in more.items())), name)


def unpacked(rows: DataFrame) -> DataFrame:
    """The columns of the docs of numbered()."""
    return rows.select(*(F.col(f"doc.`{f.name}`").alias(f.name) for f in rows.schema["doc"].dataType.fields))


def hash_buckets(h: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each 64-bit hash; ascending with the hash."""
    return ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def pack(values: np.ndarray) -> bytes:
    """Bytes of fixed-width numbers, plane by plane: sorted hashes then compress well in the shuffle."""
    width = values.dtype.itemsize
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T).tobytes()


def unpack(data: bytes, dtype: str) -> np.ndarray:
    kind = np.dtype(dtype)
    planes = np.frombuffer(data, np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def squeeze(values: np.ndarray) -> bytes:
    """pack() and compressed: for numbers that are mostly small."""
    plain = pack(values)
    return len(plain).to_bytes(8, "little") + (pa.compress(plain, "zstd", asbytes=True) if plain else b"")


def unsqueeze(data: bytes, dtype: str) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    return unpack(pa.decompress(data[8:], size, "zstd", asbytes=True) if size else b"", dtype)


def chunked(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, **more: Column) -> DataFrame:
    """The rows (doc_id, text, and what `more` names) of a table, packed into compressed chunks and written to the shared folder.

    Chunks are named once, when they are written, so a later pass or a repeated task finds the same rows under
    the same name.  Each row keeps its place; equal or null ids are no trouble.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seq = 0
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            words = sum(len(textkit.Words(d, o).start) for _, _, d, o in textkit.slices(table.column("text")))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
                out.write_table(table)
            row = [[(part << 32) + seq], [table.num_rows], [words], [size], [sink.getvalue().to_pybytes()]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int64(),) * 4 + (pa.binary(),), strict=True)], ["chunk", "docs", "words", "bytes", "blob"])

        for batch in batches:
            for first, end, data, _ in textkit.slices(batch.column("text"), chunk_bytes // 4):
                held.append(batch.slice(first, end - first))
                size += len(data)
                if size >= chunk_bytes:
                    yield flush()
                    held, size, seq = [], 0, seq + 1
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(c.alias(k) for k, c in more.items()))
    return materialize(rows.mapInArrow(write, CHUNK_SCHEMA), "chunks")


def unblob(blob: bytes) -> pa.Table:
    """The rows of a chunk."""
    return pa.ipc.open_stream(blob).read_all().combine_chunks()


def growth(docs: DataFrame, most: float = MAX_GROWTH) -> float:
    """The factor by which chunks and buckets of these texts are larger than their least size."""
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return min(most, max(1.0, (total / GROWTH_BYTES) ** 0.5))


def bucket_count(spark: SparkSession, items: int, per_bucket: int) -> int:
    """Buckets of at most about per_bucket items, and enough of them for every task to have some."""
    return max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-items // per_bucket))
