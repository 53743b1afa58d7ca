"""Packing documents into sequences: shortest-pack-first over the histogram of lengths.

Documents are encoded, cut into pieces of at most the sequence's size, and counted by length.  The
histogram, of as many entries as a sequence has tokens, is packed on the driver: lengths go longest
first, each into the packs that are shortest so far, and packs of one content are one pattern with a
count.  Then a piece finds its place by its rank among the pieces of its length: the patterns divide
the ranks of a length between them.

A rank is the piece's number within its task, kept with the stored pieces, plus the pieces of that
length in earlier tasks, so no length is sorted or gathered, however many documents share it.  There
are at most two patterns more for each length, and a pattern has at most sqrt(2 * size) different lengths,
which bounds the table that is sent to the tasks.

Cases: null text is empty and has the end id alone; a longer document is cut after every ``size``
ids; repeated rows and ids are packed as documents of their own; an empty table gives no piece; other columns
are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, batch_of, field, pick, raw, slices, stored, struct, trimmed
from .words import encode_texts

SIZE = 2048


@dataclass
class Pattern:
    count: int
    lengths: dict[int, int]  # length: times, longest first


def shortest_pack_first(histogram: dict[int, int], size: int = SIZE) -> list[Pattern]:
    """Patterns that together take each length as often as the histogram has it."""
    open_packs: list[list[Pattern]] = [[] for _ in range(size + 1)]  # by room left
    for length in sorted(histogram, reverse=True):
        if not 0 < length <= size:
            raise ValueError(f"length {length} does not fit")
        left, moved = histogram[length], []
        for room in range(size, length - 1, -1):  # the shortest packs first
            while left and open_packs[room]:
                pack = open_packs[room].pop()
                # Together the packs take what is left, and each no more than fits.
                times = min(room // length, -(-left // pack.count))
                full = min(pack.count, left // times)
                if full < pack.count:
                    open_packs[room].append(Pattern(pack.count - full, pack.lengths))
                moved.append((room - times * length, Pattern(full, pack.lengths | {length: times})))
                left -= full * times
            if not left:
                break
        if left:
            times = size // length
            for count, k in ((left // times, times), (1, left % times)):
                if count and k:
                    moved.append((size - k * length, Pattern(count, {length: k})))
        for room, pack in moved:
            open_packs[room].append(pack)
    return [p for packs in open_packs for p in packs]


def places(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """A row for each length of each pattern: the ranks from ``rank`` on are dealt ``times`` to a sequence."""
    rows, taken, sequence = [], {}, 0
    for p in patterns:
        offset = 0
        for length, times in p.lengths.items():
            rank = taken.get(length, 0)
            rows.append((length, rank, times, sequence, offset))
            taken[length] = rank + p.count * times
            offset += times * length
        sequence += p.count
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "times", "sequence", "offset"), table.T, strict=True))


def pieces(df: DataFrame, vocabulary: str, size: int = SIZE, end: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's pieces, with the task that made each and the piece's rank there among those of its length."""
    schema = struct(
        (id_col, field(df, id_col)), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("doc_tokens", "bigint"), ("task", "int"), ("rank", "bigint"),
    )
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in slices(batches, "text"):
            cols: dict[str, list] = {n: [] for n in arrow.names}
            for i, ids in zip(batch.column("id").to_pylist(), encode_texts(raw(batch.column("text")).to_pylist(), vocabulary, end), strict=True):
                for lo in range(0, len(ids), 4 * size):
                    part = ids[lo : lo + 4 * size]
                    n = len(part) // 4
                    for name, x in zip(arrow.names, (i, lo // 4, n, zlib.crc32(part), len(ids) // 4, task, int(seen[n])), strict=True):
                        cols[name].append(x)
                    seen[n] += 1
            yield batch_of(arrow, **cols)

    return pick(df, id=id_col, text=text_col).mapInArrow(trimmed(run), schema)


def pack(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """Stored ``pieces`` with ``sequence_id`` and ``offset``; within a sequence offsets leave no gap."""
    spark = cut.sparkSession
    counts = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("task")
    before = counts.select("length", "task", (F.sum("n").over(earlier) - F.col("n")).alias("before"))
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``size`` rows
    table = spark.sparkContext.broadcast(places(shortest_pack_first(histogram, size)))
    ranked = cut.join(before, ["length", "task"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before", "task")
    schema = struct(*((f.name, f.dataType) for f in ranked.schema if f.name != "rank"), ("sequence_id", "bigint"), ("offset", "bigint"))
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        firsts = np.searchsorted(t["length"], np.arange(size + 2))
        for batch in batches:
            length, rank = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            lo, hi = firsts[length], firsts[length + 1] - 1
            while (open_ := lo < hi).any():  # the last row of this length whose first rank is not above ours
                mid = (lo + hi + 1) // 2
                ok = t["rank"][mid] <= rank
                lo, hi = np.where(open_ & ok, mid, lo), np.where(open_ & ~ok, mid - 1, hi)
            nth, slot = np.divmod(rank - t["rank"][lo], t["times"][lo])
            yield batch_of(arrow, sequence_id=t["sequence"][lo] + nth, offset=t["offset"][lo] + slot * length, **{n: batch.column(n) for n in arrow.names[:-2]})

    return ranked.mapInArrow(trimmed(run), schema)


def pack_documents(df: DataFrame, vocabulary: str, size: int = SIZE, end: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    cut = stored(pieces(df, vocabulary, size, end, id_col, text_col), "pieces")
    return pack(cut, size).select(id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
