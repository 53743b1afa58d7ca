"""Token-ID output: files of independent zstandard frames with a trailing seek table.

A file holds the ids of many documents, little-endian unsigned 32-bit integers one document after the
other, as zstandard frames that end at document ends (a document longer than ``FRAME_MOST`` spans
several).  Last comes the seek table of the zstandard seekable format: a skippable frame with each
frame's compressed and decompressed size and the low half of its XXH64.  Every zstandard tool can
decompress such a file whole; ``TokenFile`` decompresses only the frames of the documents it is asked for.

Documents are dealt by ranges of their id, so that file after file, and within each, ids ascend
(nulls first; documents with one id by the hash of their text).  A task writes one file, under
another name first, and its name depends on the number of its range alone, so a task that runs again
writes the same file.  What comes back from the tasks, and is stored, is the index: a row per document.

Cases: null text is empty and has the end id alone; repeated rows and ids are kept as documents of
their own; an empty table gives no file; other columns are not read.
"""

from __future__ import annotations

import struct as binary
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_schema, batch_of, field, opened, pick, raw, shared_dir, slices, stored, struct, trimmed
from .words import encode_texts

# Fixed values of the zstandard seekable format.
SKIPPABLE, SEEKABLE, WITH_CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
#: Bytes of ids after which a frame ends with its document, and that no frame exceeds.
FRAME, FRAME_MOST = 1 << 17, 1 << 23


class TokenFileWriter:
    def __init__(self, out, level: int = 3):
        self.out, self.zstd = out, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.entries: list[tuple[int, int, int]] = []
        self.parts: list[bytes] = []
        self.size = 0

    def add(self, ids: bytes) -> None:
        self.parts.append(ids)
        self.size += len(ids)
        if self.size >= FRAME:
            self._flush()

    def _flush(self) -> None:
        data = b"".join(self.parts)
        self.parts, self.size = [], 0
        for lo in range(0, len(data), FRAME_MOST):
            part = data[lo : lo + FRAME_MOST]
            frame = self.zstd.compress(part)
            self.entries.append((len(frame), len(part), xxhash.xxh64_intdigest(part) & 0xFFFFFFFF))
            self.out.write(frame)

    def close(self) -> None:
        self._flush()
        table = b"".join(binary.pack("<III", *x) for x in self.entries) + binary.pack("<IBI", len(self.entries), WITH_CHECKSUMS, SEEKABLE)
        self.out.write(binary.pack("<II", SKIPPABLE, len(table)) + table)


class TokenFile:
    """Random access to a file's ids; the frame read last is kept."""

    def __init__(self, file, size: int):
        self.file, self.zstd = file, zstandard.ZstdDecompressor()
        file.seek(size - 9)
        n, flags, magic = binary.unpack("<IBI", file.read(9))
        if magic != SEEKABLE or flags != WITH_CHECKSUMS:
            raise ValueError("no seek table with checksums")
        file.seek(size - 9 - 12 * n)
        table = np.frombuffer(file.read(12 * n), "<u4").reshape(n, 3)
        self.checks = table[:, 2]
        self.at = np.concatenate([[0], np.cumsum(table[:, 0], dtype=np.int64)])
        self.starts = np.concatenate([[0], np.cumsum(table[:, 1], dtype=np.int64)])
        self.last: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self.last[0] != k:
            self.file.seek(int(self.at[k]))
            data = self.zstd.decompress(self.file.read(int(self.at[k + 1] - self.at[k])))
            if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.checks[k]:
                raise ValueError(f"frame {k} is damaged")
            self.last = (k, data)
        return self.last[1]

    def read(self, start: int, length: int) -> bytes:
        """Bytes from ``start`` of the decompressed whole."""
        out, k = [], int(np.searchsorted(self.starts, start, "right")) - 1
        while length:
            lo = start - int(self.starts[k])
            part = self.frame(k)[lo : lo + length]
            out.append(part)
            start, length, k = start + len(part), length - len(part), k + 1
        return b"".join(out)


@dataclass(frozen=True)
class TokenTable:
    """Written files: ``folder`` and the stored index (id, shard, first id in the shard, number of ids)."""

    folder: str
    index: DataFrame
    id_col: str

    def starts(self) -> DataFrame:
        """The number of ids in all files before each (a row per file)."""
        sums = self.index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
        return sums.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))

    def read(self, wanted: DataFrame | None = None) -> DataFrame:
        """The index's rows (or those of it in ``wanted``) with ``ids``, each document's ids as bytes, from the files."""
        index, folder, id_col = self.index if wanted is None else wanted, self.folder, self.id_col
        schema = struct((id_col, field(index, id_col)), ("shard", "int"), ("first", "bigint"), ("n_tokens", "bigint"), ("ids", "binary"))
        arrow = arrow_schema(schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            file, shard = None, None
            for batch in batches:
                cols = {n: batch.column(n).to_pylist() for n in ("shard", "first", "n_tokens")}
                ids, size, lo = [], 0, 0
                for i in range(batch.num_rows):
                    if cols["shard"][i] != shard:
                        shard = cols["shard"][i]
                        fs, path = opened(shard_path(folder, shard))
                        raw_file = fs.open_input_file(path)
                        file = TokenFile(raw_file, raw_file.size())
                    ids.append(file.read(4 * cols["first"][i], 4 * cols["n_tokens"][i]))
                    size += len(ids[-1])
                    if size > 4 << 20 or i + 1 == batch.num_rows:
                        part = batch.slice(lo, i + 1 - lo)
                        yield batch_of(arrow, ids=ids, **{n: part.column(n) for n in arrow.names[:-1]})
                        ids, size, lo = [], 0, i + 1

        files = (self.index.agg(F.max("shard")).first()[0] or 0) + 1  # a task for each, however small the index
        dealt = index.select(*arrow.names[:-1]).repartition(files, "shard").sortWithinPartitions("shard", "first")
        return dealt.mapInArrow(trimmed(run), schema)


def shard_path(folder: str, shard: int) -> str:
    return f"{folder}/tokens-{shard:07d}.zst"


def write_tokens(df: DataFrame, vocabulary: str, end: int = 1, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> TokenTable:
    """Encodes every text by the tokenizers library's file ``vocabulary``, adds ``end``, and writes token files in ascending order of id."""
    spark: SparkSession = df.sparkSession
    base = folder or shared_dir(spark)
    files = f"{base}/files"
    schema = struct((id_col, field(df, id_col)), ("shard", "int"), ("first", "bigint"), ("n_tokens", "bigint"))
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard, first, writer = task.partitionId(), 0, None
        for batch in slices(batches, "text"):
            if writer is None:
                fs, path = opened(shard_path(files, shard))
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                own = f"{path}.{task.taskAttemptId()}"
                out = fs.open_output_stream(own)
                writer = TokenFileWriter(out)
            encoded = encode_texts(raw(batch.column("text")).to_pylist(), vocabulary, end)
            sizes = np.array([len(x) // 4 for x in encoded], np.int64)
            for x in encoded:
                writer.add(x)
            yield batch_of(arrow, shard=np.full(len(sizes), shard), first=first + np.cumsum(sizes) - sizes, n_tokens=sizes, **{id_col: batch.column("id")})
            first += int(sizes.sum())
        if writer is not None:
            writer.close()
            out.close()
            fs.move(own, path)

    docs = pick(df, id=id_col, text=text_col).withColumn("tie", F.xxhash64("text"))
    dealt = docs.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    return TokenTable(files, stored(dealt.mapInArrow(trimmed(run), schema), "index", base), id_col)


def token_digest(df: DataFrame, vocabulary: str, end: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes token files, reads them back, and gives each document's place, length and CRC-32 from them."""
    table = write_tokens(df, vocabulary, end, id_col, text_col)
    schema = struct((id_col, field(df, id_col)), ("shard", "int"), ("first", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint"))
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            yield batch_of(arrow, n_tokens=[len(x) // 4 for x in ids], ids_crc32=[zlib.crc32(x) for x in ids], **{n: batch.column(n) for n in arrow.names[:3]})

    read = table.read().mapInArrow(trimmed(run), schema)
    start = (F.col("before") + F.col("first")).alias("start")
    return read.join(table.starts(), "shard").select(id_col, start, "n_tokens", "ids_crc32")
