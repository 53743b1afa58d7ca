"""Byte-level BPE by merge replay over the whole corpus's distinct pieces.

Texts are cut into pieces by the vocabulary's pattern.  A part of a few MB of text numbers its own distinct pieces
and waits, as their numbers, in the shared folder; it sends its pieces, compressed, to shards by hash, where
a piece is encoded once, however many parts and texts have it.  ``replay`` lays a shard's pieces
side by side, indexes every adjacent pair of tokens by its positions, and applies the merges in rank order, each to all
its positions at once, updating only the neighbours that a merge touches.  The ids go back to the parts that
asked, which put their texts together.  A frequent piece is sent once by each part, never for each time it occurs; there are as many
shards as the bytes of the texts ask for, and a shard is read as a stream, of which ``TOGETHER`` bytes are in memory.

Cases: null text is empty and has no token; very long texts are encoded whole, each as a part of its own at most; repeated
rows and ids are kept; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cached_property
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch_of, bundle, field, opened, pick, shared_dir, slices, small, stored, struct, trimmed, unbundle, worker_table

#: Bytes of text after which a part ends with its slice of the input, bytes of text for each shard, and bytes of pieces that are replayed together.
PART, SHARD, TOGETHER = 8 << 20, 8 << 20, 4 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of a token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Merges:
    """A vocabulary's merges: every way to put two tokens together to a third, and its rank."""

    NONE = 1 << 30

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.shift = np.int64(max(ranks.values(), default=0) + 1)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                if (a := ranks.get(token[:cut])) is not None and (b := ranks.get(token[cut:])) is not None:
                    pairs[a * int(self.shift) + b] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()] + [self.NONE], np.int64)
        self.byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; NONE where there is no merge, or no token (-1)."""
        key = a * self.shift + b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        hit = (a >= 0) & (b >= 0) & (self.keys[at] == key) if len(self.keys) else np.zeros(len(a), bool)
        return np.where(hit, self.values[at], self.NONE)

    def one(self, piece: bytes) -> list[int]:
        """A single piece, merge by merge."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(a + b, self.NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == self.NONE:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[x] for x in parts]


def grouped(keys: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The values of each key."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    starts = [0, *cuts.tolist()]
    for key, lo, hi in zip(keys[starts].tolist(), starts, [*starts[1:], len(keys)], strict=True):
        yield key, values[lo:hi]


def replay(pieces: list[bytes], merges: Merges) -> list[bytes]:
    """Token ids of each piece, as little-endian unsigned 32-bit integers, by the merges of all pieces in rank order.

    The pieces stand one after the other with a gap between them, as linked lists of tokens.  ``index``
    maps the rank of each pair that occurs to the positions of its left token.  A merge is applied to
    all its positions at once; then only the pairs beside them are ranked anew and put in the index.
    Where a merge makes a pair of a lower rank, its piece is encoded by itself.
    """
    if not pieces:
        return []
    text = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces], np.int64)
    owner = np.repeat(np.arange(len(pieces)), sizes)
    at = np.arange(len(text)) + owner
    n = len(text) + len(pieces)
    token = np.full(n + 1, -1, np.int64)
    token[at] = merges.byte[text]
    right, left = np.arange(1, n + 2), np.arange(-1, n)
    right[n] = n
    rank = np.full(n + 1, merges.NONE, np.int64)
    rank[:n] = merges.of(token[:n], token[1:])
    index: defaultdict[int, list[np.ndarray]] = defaultdict(list)
    there = np.flatnonzero(rank < merges.NONE)
    if len(there):
        for r, spots in grouped(rank[there], there):
            index[r].append(spots)
    queue = list(index)
    heapify(queue)
    alone: list[np.ndarray] = []
    while queue:
        r = heappop(queue)
        spots = index.pop(r)
        spots = np.unique(np.concatenate(spots)) if len(spots) > 1 else np.sort(spots[0])
        spots = spots[rank[spots] == r]
        if not len(spots):
            continue
        # In a chain of positions that overlap, such as of one letter repeated, every other one merges.
        linked = np.concatenate([[False], right[spots[:-1]] == spots[1:]])
        if linked.any():
            k = np.arange(len(spots))
            spots = spots[(k - np.maximum.accumulate(np.where(linked, 0, k))) % 2 == 0]
        gone = right[spots]
        after = right[gone]
        # Of two that touch, the left one comes first and meets the right one's token as it was.
        touch = np.flatnonzero(after[:-1] == spots[1:])
        if len(touch) and (low := merges.of(np.full(len(touch), r), token[after[touch]]) < r).any():
            alone.append(spots[touch[low]])
        token[spots], token[gone] = r, -1
        rank[gone] = merges.NONE
        right[spots], left[after] = after, spots
        before = left[spots]
        before = before[before >= 0]
        beside = np.concatenate([spots, before[token[before] >= 0]])
        beside = np.unique(beside)
        new = rank[beside] = merges.of(token[beside], token[right[beside]])
        found = new < merges.NONE
        if found.any():
            beside, new = beside[found], new[found]
            if (low := new < r).any():
                alone.append(beside[low])
            for k, spots in grouped(new, beside):
                if k not in index:
                    heappush(queue, k)
                index[k].append(spots)
    kept = token[at] >= 0
    ends = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], np.cumsum(sizes)])]
    ids = token[at[kept]].astype("<u4").tobytes()
    ends = (4 * ends).tolist()
    out = [ids[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    if alone:
        of = np.full(n + 1, -1, np.int64)
        of[at] = owner
        for k in np.unique(of[np.concatenate(alone)]).tolist():
            out[k] = np.array(merges.one(pieces[k]), "<u4").tobytes()
    return out


class ByteBpe:
    """A rank file; its merges, and its tokens."""

    def __init__(self, path: str):
        self.ranks = read_ranks(path)

    @cached_property
    def merges(self) -> Merges:
        return Merges(self.ranks)

    @cached_property
    def tokens(self) -> list[bytes]:
        tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        return tokens

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_coders: dict[str, ByteBpe] = worker_table()


def coder(path: str) -> ByteBpe:
    """The worker's coder for a file."""
    if path not in _coders:
        _coders[path] = ByteBpe(path)
    return _coders[path]


# -- the corpus ----------------------------------------------------------------------------------------


class Numbers(dict):
    """Numbers things in the order in which they are first asked for."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, x) -> int:
        self[x] = n = len(self)
        self.new.append(x)
        return n


class Part:
    """Texts as the numbers of their stretches, and each distinct stretch as the numbers of its pieces.

    A stretch stands between single spaces, with the space before it, or is a piece as a tuple of one.  The line end put
    before a text has no space before it, and makes one piece, if white space does not follow; its texts
    have ``skip`` 1 for it.  Where a stretch has white space at an end, the pattern could match that together with
    what is beside it: such a text is cut as a whole.
    """

    def __init__(self, find: Callable[[str], list[str]]):
        self.find = find
        self.pieces, self.stretches = Numbers(), Numbers()
        self.flat: list[int] = []
        self.counts: list[int] = []
        self.unfit: set[int] = set()
        self.texts: list[np.ndarray] = []
        self.skip: list[int] = []

    def _cut(self) -> None:
        new, self.stretches.new = self.stretches.new, []
        for x in new:
            if isinstance(x, tuple):
                found = x
            else:
                line = x[:1] == "\n"
                rest = x[1:] if line else x
                if not rest or rest[0].isspace() or rest[-1].isspace():
                    self.unfit.add(len(self.counts))
                    found = ()
                else:
                    found = self.find(x if line else " " + x)
            self.flat += map(self.pieces.__getitem__, found)
            self.counts.append(len(found))

    def add(self, texts: list[str]) -> None:
        number = self.stretches.__getitem__
        rows = [list(map(number, ("\n" + x).replace("\n", " \n")[1:].split(" "))) for x in texts]
        self._cut()
        for text, row in zip(texts, rows, strict=True):
            whole = not self.unfit.isdisjoint(row)
            if whole:
                row = [number((p,)) for p in self.find(text)]
            self.skip.append(0 if whole else 1)
            self.texts.append(np.array(row, np.uint32))
        self._cut()

    def packed(self, ids: pa.Array, shard: np.ndarray) -> bytes:
        sink = pa.BufferOutputStream()
        batch = pa.RecordBatch.from_arrays([ids], ["id"])
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        sizes = small(np.fromiter(map(len, self.texts), np.int64, len(self.texts)))
        rows = small(np.concatenate(self.texts))
        flat, counts = (small(np.array(x, np.int64)) for x in (self.flat, self.counts))
        return bundle(rows, sizes, np.array(self.skip, np.uint8), flat, counts, small(shard), np.frombuffer(sink.getvalue(), np.uint8))


_MESSAGE = struct(("part", "bigint"), ("shard", "bigint"), ("data", "binary"))


def _parts(docs: DataFrame, pattern: str, shards: int, folder: str) -> DataFrame:
    """A row with the file of each part (shard -1), and one for each of its messages: the distinct pieces of a shard."""
    arrow = arrow_schema(_MESSAGE)

    def emit(name: int, attempt: int, part: Part, ids: list[pa.Array]) -> pa.RecordBatch:
        pieces = [p.encode() for p in part.pieces]
        shard = np.fromiter(map(zlib.crc32, pieces), np.int64, len(pieces)) % shards
        path = f"{folder}/part-{name}-{attempt}"
        fs, file = opened(path)
        fs.create_dir(file.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(file) as out:
            out.write(part.packed(pa.concat_arrays(ids), shard))
        order = np.argsort(shard, kind="stable")
        to, starts = np.unique(shard[order], return_index=True)
        rows = []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(pieces)], strict=False):
            some = [pieces[i] for i in order[a:b].tolist()]
            rows.append(bundle(np.frombuffer(b"".join(some), np.uint8), small(np.fromiter(map(len, some), np.int64, len(some)))))
        return batch_of(arrow, part=[name] * (len(rows) + 1), shard=[-1, *to.tolist()], data=[path.encode(), *rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, find, k = TaskContext.get(), regex.compile(pattern).findall, 0
        part, ids, size = Part(find), [], 0
        for batch in slices(batches, "text"):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            part.add(texts)
            ids.append(batch.column("id"))
            size += sum(map(len, texts))
            if size >= PART:
                yield emit(task.partitionId() << 32 | k, task.taskAttemptId(), part, ids)
                part, ids, size, k = Part(find), [], 0, k + 1
        if ids:
            yield emit(task.partitionId() << 32 | k, task.taskAttemptId(), part, ids)

    return docs.mapInArrow(trimmed(run), _MESSAGE)


def strings(data: np.ndarray, length: np.ndarray) -> pa.Array:
    at = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(at), pa.py_buffer(data)])


def _replayed(messages: DataFrame, path: str) -> DataFrame:
    """Each message answered: how many ids each of its pieces has, and the ids.

    A partition's messages come shard by shard.  What was replayed for the messages before is known, up to ``TOGETHER`` bytes.
    """
    arrow = arrow_schema(_MESSAGE)

    def answer(waiting: list[tuple[int, int, pa.Array]], known: dict[bytes, bytes], merges: Merges) -> pa.RecordBatch:
        found = pa.chunked_array([x for _, _, x in waiting]).combine_chunks().dictionary_encode()
        distinct = found.dictionary.to_pylist()
        new = [p for p in distinct if p not in known]
        if sum(map(len, known)) > TOGETHER:
            known.clear()
            new = distinct
        known.update(zip(new, replay(new, merges), strict=True))
        ids = [known[p] for p in distinct]
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        token = np.frombuffer(b"".join(ids), "<u4")
        start, index, rows, a = np.cumsum(length) - length, found.indices.to_numpy(), [], 0
        for _, _, x in waiting:
            k = index[a : a + len(x)]
            a += len(x)
            rows.append(bundle(small(length[k]), token[spread(start[k], length[k])]))
        return batch_of(arrow, part=[part for part, _, _ in waiting], shard=[shard for _, shard, _ in waiting], data=rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, known, waiting, size = coder(path).merges, {}, [], 0
        for batch in batches:
            for part, shard, data in zip(*(batch.column(c) for c in ("part", "shard", "data")), strict=True):
                text, length = unbundle(data.as_py())
                waiting.append((part.as_py(), shard.as_py(), strings(text, length)))
                size += len(text)
                if size >= TOGETHER:
                    yield answer(waiting, known, merges)
                    waiting, size = [], 0
        if waiting:
            yield answer(waiting, known, merges)

    return messages.repartition("shard").sortWithinPartitions("shard").mapInArrow(trimmed(run), _MESSAGE)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of runs, one run after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _put_together(table: pa.Table) -> tuple[pa.Array, list[bytes]]:
    """The ids of a part's documents, and each one's token ids as little-endian unsigned 32-bit integers."""
    data = dict(zip(table.column("shard").to_pylist(), table.column("data").to_pylist(), strict=True))
    fs, name = opened(data.pop(-1).decode())
    with fs.open_input_file(name) as file:
        rows, sizes, skip, flat, counts, shard, stream = unbundle(file.read())
    with pa.ipc.open_stream(pa.py_buffer(stream)) as read:
        ids = read.read_all().column("id").combine_chunks()
    answers = [unbundle(data[s]) for s in sorted(data)]
    none = [np.zeros(0, np.uint32)]
    token = np.concatenate(none + [x for _, x in answers])
    # The pieces by shard, in the order in which they were sent.
    sent = np.argsort(shard, kind="stable")
    n = np.concatenate(none + [x for x, _ in answers]).astype(np.int64)
    length, start = np.zeros((2, len(shard)), np.int64)
    length[sent], start[sent] = n, np.cumsum(n) - n
    counts = counts.astype(np.int64)
    place = (np.cumsum(counts) - counts)[rows]
    pieces = flat[spread(place, counts[rows])]
    at = np.concatenate([[0], np.cumsum(counts[rows])])[np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])]
    n = length[pieces]
    until = np.concatenate([[0], np.cumsum(n)])
    token = token[spread(start[pieces], n)].tobytes()
    starts, ends = (4 * until[at[:-1] + skip]).tolist(), (4 * until[at[1:]]).tolist()
    return ids, [token[a:b] for a, b in zip(starts, ends, strict=True)]


def _encoded(df: DataFrame, path: str, pattern: str, id_col: str, text_col: str, schema, columns: Callable[[list[bytes]], dict]) -> DataFrame:
    """``id_col`` and what ``columns`` makes of the token ids of each part's texts."""
    arrow = arrow_schema(schema)
    folder = shared_dir(df.sparkSession)
    docs = pick(df, id=id_col, text=text_col)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = stored(_parts(docs, pattern, max(1, -(-size // SHARD)), f"{folder}/files"), "pieces", folder)
    answers = _replayed(parts.where("shard >= 0"), path)

    def run(table: pa.Table) -> pa.Table:
        ids, coded = _put_together(table)
        return pa.Table.from_batches([batch_of(arrow, **{id_col: ids}, **columns(coded))])

    return answers.union(parts.where("shard < 0")).groupBy("part").applyInArrow(run, schema)


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids``, an array of integers."""
    schema = struct((id_col, field(df, id_col)), ("ids", "array<int>"))
    return _encoded(df, path, pattern, id_col, text_col, schema, lambda coded: {"ids": [np.frombuffer(x, "<i4") for x in coded]})


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``data``, the bytes that the ids stand for; null ids stand for none."""
    arrow = arrow_schema(schema := struct((id_col, field(df, id_col)), ("data", "binary")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            data = [bpe.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield batch_of(arrow, **{id_col: batch.column("id"), "data": data})

    return pick(df, id=id_col, ids=ids_col).mapInArrow(trimmed(run), schema)


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text, then decodes its ids; digests of both."""
    schema = struct((id_col, field(df, id_col)), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string"))

    def columns(coded: list[bytes]) -> dict:
        bpe = coder(path)
        return {
            "n_tokens": [len(x) // 4 for x in coded], "ids_sha256": [hashlib.sha256(x).hexdigest() for x in coded],
            "decoded_sha256": [hashlib.sha256(bpe.decode(x)).hexdigest() for x in coded],
        }

    return _encoded(df, path, pattern, id_col, text_col, schema, columns)
