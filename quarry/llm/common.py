"""What the operators share: the shared folder, tables written there, and Arrow helpers."""

from __future__ import annotations

import ctypes
import struct as binary
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import checkpoints

def shared_dir(spark: SparkSession, name: str | None = None) -> str:
    """A folder under ``spark.checkpoint.dir``, with its scheme, which all executors can reach; a new one without a ``name``."""
    base = checkpoints(spark)
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{base}/{name or f'quarry-{uuid.uuid4().hex}'}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.makeQualified(path).toString()


def opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    """Arrow's file system for a path with its scheme, and the path there."""
    return pa.fs.FileSystem.from_uri(path)


def stored(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{folder or shared_dir(spark)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which a cluster sets to fit its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, as ``alias=name``; any others, whatever they are called, are left out."""
    return df.select(*(F.col(f"`{name}`").alias(alias) for alias, name in columns.items()))


def field(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


_SIMPLE = {t.simpleString(): t for t in (T.LongType(), T.IntegerType(), T.StringType(), T.BinaryType(), T.BooleanType(), T.DoubleType())}


def struct(*fields: tuple[str, T.DataType | str]) -> T.StructType:
    """A schema; types may be given by name, those but the simplest only where there is a session."""
    kinds = ((n, t if isinstance(t, T.DataType) else _SIMPLE.get(t) or T._parse_datatype_string(t)) for n, t in fields)
    return T.StructType([T.StructField(n, t) for n, t in kinds])


def raw(column: pa.Array) -> pa.Array:
    """A string column as UTF-8 bytes; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return pc.fill_null(column.cast(kind), b"")


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` has about ``most`` bytes in each, or one row."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(lengths):
            if total and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


#: What a worker keeps from task to task, and the module whose tasks it had last.
_TABLES: list[dict] = []
_OWNER = [""]


def worker_table() -> dict:
    """A table that a worker keeps from task to task, as long as they are of the same operator."""
    _TABLES.append(table := {})
    return table


def turned_to(module: str) -> None:
    """Called in a worker as a task starts: tables of another operator's tasks are given up."""
    if _OWNER[0] != module:
        _OWNER[0] = module
        for table in _TABLES:
            table.clear()


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, before which the worker gives up other operators' tables, and after which it gives the memory that it freed back to the system."""
    module = run.__module__

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turned_to(module)
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU library alone
                trim(0)

    return wrapped


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """Columns given in any form, cast to the schema."""
    arrays = []
    for f in schema:
        x = columns[f.name]
        arrays.append(x.cast(f.type) if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, type=f.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def bundle(*arrays: np.ndarray) -> bytes:
    """Arrays as one zstandard frame, the bytes of each significance together."""
    head = bytes([len(arrays)]) + b"".join(binary.pack("<ccQ", x.dtype.kind.encode(), bytes([x.itemsize]), len(x)) for x in arrays)
    planes = [np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes() if len(x) else b"" for x in arrays]
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(planes))


def unbundle(data: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(data)
    at, out = 1 + 10 * data[0], []
    for k in range(data[0]):
        kind, size, n = binary.unpack_from("<ccQ", data, 1 + 10 * k)
        x = np.frombuffer(data, np.uint8, n * size[0], at).reshape(size[0], n).T
        out.append(np.ascontiguousarray(x).view(f"{kind.decode()}{size[0]}").ravel() if n else np.zeros(0, f"{kind.decode()}{size[0]}"))
        at += n * size[0]
    return out


def small(x: np.ndarray) -> np.ndarray:
    """As unsigned integers of 32 bits, or 64 if need be."""
    return x.astype(np.uint32 if not len(x) or int(x.max()) < 1 << 32 else np.uint64)
