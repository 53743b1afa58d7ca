"""Repeated substrings: maximal repeat groups from the common-prefix interval tree of an enhanced suffix array.

Every byte that lies in a string of ``length`` bytes which also starts anywhere else, in the same text or
another, is found.  The corpus is cut so that equal strings meet, without a suffix array of it all:

1. Each window of ``length`` bytes has an anchor: the k-mer of least hash in it, the leftmost if there are two.
   Equal windows have equal anchors at equal places, and so equal bytes from the anchor to the further end of the window.  At least half
   a window of these, to the left or to the right, is the context of the anchor.  Windows that follow each other and share
   an anchor and its side are one segment.  Within a slice of the input, equal segments are one at once, with all their
   places known as repeats; so what is sent of a passage that is very common is one row for each slice.
2. Segments go by their anchor with its context: common words alone don't bring segments together.  A segment that occurs twice is repeated whole.  One representative of every
   other, and of those if other segments have the same anchor, is fetched from its text.
3. The segments of an anchor form, with those of other anchors, a small text.  Its suffixes are sorted by prefix
   doubling; longest common prefixes of neighbours make intervals, which a stack scan visits inner first.  An interval of
   at least ``length`` whose suffixes are not all preceded by one character is a maximal repeat with all its
   occurrences.  (The start of a segment counts as a character of its own: what comes before is in another segment.)
4. An anchor with more than ``hot`` different segments is not gathered: its segments are cut by the k-mer of the next least hash in each window,
   which equal windows share as well, and go through steps 2 and 3 by both, and so on until no group is larger.

Texts are kept with a number of their own, and segments are told apart by 128-bit hashes of their bytes.

Cases: null text is empty; texts shorter than ``length`` have no repeat; rows of one id and text are texts of
their own, and repeat each other; texts of any length are scanned whole, in pieces; an empty table gives an empty
table; other columns are not read, or kept as they are by ``removed``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, batch_of, field, pick, raw, shared_dir, slices, stored, struct, trimmed

LENGTH = 200
KMER = 16
HOT = 10_000
#: Bytes of a slice, of a piece of a long text, and of the small texts whose suffixes are sorted.
SLICE, PIECE, TEXT = 2 << 20, 2 << 20, 1 << 19
#: No UTF-8 text has this byte.
END = 0xFF

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_CODE = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hashes of any stretches of a text, from prefix sums."""

    _powers = _inverses = np.ones(0, np.uint64)

    def __init__(self, text: np.ndarray):
        n = len(text) + 1
        if len(Rolling._powers) < n:
            size = max(n, max(SLICE, PIECE) + 4096)
            for name, base in (("_powers", _BASE), ("_inverses", _BASE_INVERSE)):
                x = np.full(size, base, np.uint64)
                x[0] = 1
                setattr(Rolling, name, np.cumprod(x))
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(_CODE[text] * self._powers[: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self._inverses[start])

    def kmers(self, k: int) -> np.ndarray:
        n = max(len(self.sums) - k, 0)
        return _mixed((self.sums[k:] - self.sums[:n]) * self._inverses[:n])


def segments(text: np.ndarray, ends: np.ndarray, length: int = LENGTH, k: int = KMER) -> tuple[np.ndarray, ...]:
    """Segments of texts that stand one after the other: (index of text, start, end, hash of anchor and context, hash and length of segment)."""
    none = np.zeros(0, np.int64)
    if len(text) < length:
        return none, none, none, none, none
    rolling = Rolling(text)
    h = rolling.kmers(k)
    bits = np.uint64(28)
    least = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    width, reach = length - k + 1, 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    anchor = (least & np.uint64((1 << 28) - 1)).astype(np.int64)
    owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[: len(anchor)]
    at = np.flatnonzero(np.arange(len(anchor)) + length <= ends[owner])
    if not len(at):
        return none, none, none, none, none
    half = (length - k) // 2
    left = anchor[at] - at >= half  # half of the window or more is before the anchor
    new = np.concatenate([[True], (anchor[at[1:]] != anchor[at[:-1]]) | (owner[at[1:]] != owner[at[:-1]]) | (left[1:] != left[:-1])])
    lo, hi = at[new], at[np.concatenate([new[1:], [True]])] + length
    near, left = anchor[lo], left[new]
    key = rolling.of(np.where(left, near - half, near), np.where(left, near + k, near + length - half))
    seg = (rolling.of(lo, hi) & ~np.uint64(0xFFFF)) | (hi - lo).astype(np.uint64)
    return owner[lo], lo, hi, key.view(np.int64), seg.view(np.int64)


# -- the enhanced suffix array of a small text ---------------------------------------------------------


def _ranks(high: np.ndarray, low: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the pairs, and each one's rank; equal pairs have equal ranks. ``low`` has so many bits at most."""
    n = len(high)
    key = (high.astype(np.uint64) << np.uint64(bits)) | low.astype(np.uint64)
    index = max(n - 1, 1).bit_length()
    if int(key.max()).bit_length() + index <= 64:  # sorted as one integer with the position
        key = np.sort((key << np.uint64(index)) | np.arange(n, dtype=np.uint64))
        order = (key & np.uint64((1 << index) - 1)).astype(np.int64)
        key >>= np.uint64(index)
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
    rank = np.empty(n, np.int32)
    rank[order] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]), dtype=np.int32)
    return order, rank


def sorted_windows(text: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` ordered by the ``depth`` characters from each on, or more. After the text comes END."""
    n = len(text)
    first = np.concatenate([text, np.full(5, END, np.uint8)]).astype(np.uint64)
    high = (first[:n] << np.uint64(16)) | (first[1 : n + 1] << np.uint64(8)) | first[2 : n + 2]
    low = (first[3 : n + 3] << np.uint64(8)) | first[4 : n + 4]
    _, rank = _ranks(high, low, 16)
    known = 5
    while known < depth:
        bits = int(rank.max()).bit_length()
        last = 2 * known >= depth
        at = starts if last else np.arange(n)
        beyond = at + known
        second = np.where(beyond < n, rank[np.minimum(beyond, n - 1)] + 1, 0)
        order, ranks = _ranks(rank[at], second, bits + 1)
        if last:
            return starts[order]
        rank = ranks
        known *= 2
    return starts[np.argsort(rank[starts], kind="stable")]


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Characters that the suffixes at a and b share, ``most`` at most."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    out = np.zeros(len(a), np.int64)
    live = np.flatnonzero(most > 0)
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        same = words[np.minimum(x, len(text))] == words[np.minimum(y, len(text))]
        n = np.where(same.all(axis=1), 8, same.argmin(axis=1))
        out[live] = np.minimum(out[live] + n, most[live])
        live = live[(n == 8) & (out[live] < most[live])]
    return out


def intervals(order: list[int], prefix: list[int], before: list[int], length: int) -> Iterator[tuple[int, int, int, list[int]]]:
    """Stack scan: (common length, first, last, suffixes that no inner repeat has) of each maximal repeat, inner ones first.

    ``prefix[i]`` is what suffixes i-1 and i share; ``before`` the character before each, END for none.
    """
    # An open interval: its common length, first suffix, the character before all of its suffixes (-1 if they differ), those not yet given out.
    stack: list[list] = []

    def close(node: list, last: int):
        if node[0] >= length and node[2] == -1:
            found = node[3]
            node[3] = []
            return (node[0], node[1], last, found)
        return None

    n = len(order)
    for i in range(n + 1):
        shared = prefix[i] if 0 < i < n else 0
        if i:
            c = before[i - 1]
            child: list | None = [1 << 62, i - 1, -1 if c == END else c, [order[i - 1]]]  # the suffix alone
        else:
            child = None
        while child is not None:
            # The child belongs to the deepest interval it shares more with than with what follows.
            if stack and stack[-1][0] > shared:
                top = stack.pop()
                top[2] = top[2] if top[2] == child[2] else -1
                top[3] += child[3]
                if found := close(top, i - 1):
                    yield found
                child = top
            elif stack and stack[-1][0] == shared:
                top = stack[-1]
                top[2] = top[2] if top[2] == child[2] else -1
                top[3] += child[3]
                child = None
            else:
                if shared >= length:
                    stack.append([shared, child[1], child[2], child[3]])
                child = None


def repeats(text: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> Iterator[tuple[int, np.ndarray, list[int]]]:
    """Maximal repeats of at least ``length`` within segments of a text, each of which ends before an END at ``ends``.

    Gives the length, all occurrences, and the occurrences that no longer repeat was given for before.
    """
    lengths = np.diff(ends, prepend=-1) - 1
    owner = np.repeat(np.arange(len(ends)), lengths + 1)
    starts = np.flatnonzero(np.arange(len(text)) + length <= ends[owner])
    if len(starts) < 2:
        return
    order = sorted_windows(text, starts, max(int(lengths.max()), length))
    left = ends[owner[order]] - order
    shared = common_prefixes(text, order[:-1], order[1:], np.minimum(left[:-1], np.minimum(left[1:], length)))
    linked = shared == length
    group = np.concatenate([[0], np.cumsum(~linked)])
    before = np.where(order > 0, text[np.maximum(order, 1) - 1], END)
    first = np.flatnonzero(np.concatenate([[True], ~linked]))
    low, high = np.minimum.reduceat(before, first), np.maximum.reduceat(before, first)
    size = np.diff(first, append=len(order))
    # Where one character precedes all suffixes of a group, the repeat is part of one that starts before.
    keep = ((size > 1) & ((low != high) | (high == END)))[group]
    order, group, before, left = order[keep], group[keep], before[keep], left[keep]
    if not len(order):
        return
    same = group[1:] == group[:-1]
    most = np.where(same, np.minimum(left[:-1], left[1:]), 0)
    prefix = np.concatenate([[0], common_prefixes(text, order[:-1], order[1:], most)])
    for common, lo, hi, new in intervals(order.tolist(), prefix.tolist(), before.tolist(), length):
        yield common, order[lo : hi + 1], new


# -- the distributed steps -----------------------------------------------------------------------------


_SEGMENTS = struct(("key", "bigint"), ("seg", "bigint"), ("seg2", "bigint"), ("size", "int"), ("n", "int"), ("uid", "bigint"), ("lo", "bigint"))


def _segment_batch(data: bytes, lo: np.ndarray, hi: np.ndarray, key: np.ndarray, uid: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Segments of ``data``, which are at ``at`` in the text ``uid``: ``n`` is 2 for one that is there again, 0 for such another place of it."""
    digests = b"".join(map(xxhash.xxh3_128_digest, map(data.__getitem__, map(slice, lo.tolist(), hi.tolist()))))
    seg, seg2 = np.frombuffer(digests, np.int64).reshape(-1, 2).T
    order = np.lexsort((seg2, seg, key))
    key, seg, seg2, uid, at, size = (x[order] for x in (key, seg, seg2, uid, at, hi - lo))
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (seg[1:] != seg[:-1]) | (seg2[1:] != seg2[:-1])
    again = np.append(~new[1:], np.zeros(min(len(new), 1), bool))
    n = np.where(new, 1 + again, 0)
    # Further places need not meet anything: they are dealt evenly.
    key = np.where(new, key, _mixed(uid.view(np.uint64) + at.astype(np.uint64)).view(np.int64))
    return batch_of(arrow_schema(_SEGMENTS), key=key, seg=seg, seg2=seg2, size=size, n=n, uid=uid, lo=at)


def _segment_rows(docs: DataFrame, length: int) -> DataFrame:
    """Segments of all texts, equal ones of a slice as one."""

    def emit(pieces: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        ends, data = np.cumsum([len(x) for _, _, x in pieces]), b"".join(x for _, _, x in pieces)
        owner, lo, hi, key, _ = segments(np.frombuffer(data, np.uint8), ends, length)
        uid = np.array([u for u, _, _ in pieces], np.int64)[owner]
        base = np.array([b for _, b, _ in pieces], np.int64) - np.concatenate([[0], ends[:-1]])
        return _segment_batch(data, lo, hi, key, uid, lo + base[owner])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, size = [], 0
        for batch in slices(batches, "text", SLICE):
            for uid, text in zip(batch.column("uid").to_pylist(), raw(batch.column("text")).to_pylist(), strict=True):
                for at in range(0, max(len(text) - length + 1, 0), PIECE):
                    part = text[at : at + PIECE + length - 1]
                    if size + len(part) > SLICE and pieces:
                        yield emit(pieces)
                        pieces, size = [], 0
                    pieces.append((uid, at, part))
                    size += len(part)
        if pieces:
            yield emit(pieces)

    return docs.select("uid", "text").mapInArrow(trimmed(run), _SEGMENTS)


def _split(found: DataFrame, length: int, level: int) -> DataFrame:
    """The segments of groups that are too large, cut by the k-mer of the next least hash: ``level`` of each window's are taken already."""
    width = length - KMER + 1

    def emit(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        parts: list[list[np.ndarray]] = [[] for _ in range(5)]
        base = 0
        for key, uid, at, data in rows:
            h = Rolling(np.frombuffer(data, np.uint8)).kmers(KMER)
            rank = h >> np.uint64(28)
            taken = np.unique(rank[:width])[:level]  # all windows of a segment have these
            rank = np.where(np.isin(rank, taken), np.uint64((1 << 36) - 1), rank)
            least = np.lib.stride_tricks.sliding_window_view(rank, width).argmin(axis=1) + np.arange(len(rank) - width + 1)
            new = np.ones(len(least), bool)
            new[1:] = least[1:] != least[:-1]
            lo = np.flatnonzero(new)
            hi = np.append(lo[1:], len(least)) - 1 + length
            own = _mixed(h[least[lo]] ^ _mixed(np.array([key], np.int64).view(np.uint64)))
            for part, x in zip(parts, (lo + base, hi + base, own.view(np.int64), np.full(len(lo), uid), lo + at), strict=True):
                part.append(x)
            base += len(data)
        return _segment_batch(b"".join(x for *_, x in rows), *map(np.concatenate, parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "data", TEXT):
            if batch.num_rows:
                yield emit(list(zip(*(batch.column(n).to_pylist() for n in ("key", "uid", "lo", "data")), strict=True)))

    return found.mapInArrow(trimmed(run), _SEGMENTS)


def _resolved(rows: DataFrame) -> DataFrame:
    """Segments that are repeated whole (``whole``), and those to be compared with others of their anchor (``compare``).

    Rows come ordered by key and segment, and are looked at as they come; what is kept from one batch
    to the next is one row.
    """
    arrow = arrow_schema(schema := T.StructType([f for f in _SEGMENTS if f.name != "n"] + list(struct(("whole", "boolean"), ("compare", "boolean")))))
    names = _SEGMENTS.names

    def emit(c: dict, whole: np.ndarray, compare: np.ndarray) -> pa.RecordBatch:
        keep = np.flatnonzero(whole | compare)
        return batch_of(arrow, whole=whole[keep], compare=compare[keep], **{n: c[n][keep] for n in names if n != "n"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, others = {n: np.zeros(0, np.int64) for n in names}, False  # the last segment's first row; whether its key has had another
        for batch in batches:
            c = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in names}
            done = c["n"] == 0
            if done.any():
                yield emit({n: x[done] for n, x in c.items()}, np.ones(done.sum(), bool), np.zeros(done.sum(), bool))
            c = {n: np.concatenate([held[n], c[n][~done]]) for n in names}
            if not len(c["key"]):
                continue
            new_key = np.concatenate([[True], c["key"][1:] != c["key"][:-1]])
            new = new_key | np.concatenate([[True], (c["seg"][1:] != c["seg"][:-1]) | (c["seg2"][1:] != c["seg2"][:-1])])
            at = np.flatnonzero(new)
            pair, key = np.cumsum(new) - 1, np.cumsum(new_key) - 1
            total = np.add.reduceat(c["n"], at)[pair]
            pairs = np.bincount(key[at])
            mixed = pairs > 1
            mixed[0] |= others
            last = int(at[-1])
            rest = np.ones(len(new), bool)
            rest[last] = False  # the representative of what may go on in the next batch waits
            out = {n: x[rest] for n, x in c.items()}
            yield emit(out, (total >= 2)[rest], (new & mixed[key])[rest])
            others = bool(mixed[-1])
            held = {n: x[last : last + 1].copy() for n, x in c.items()}
            held["n"][0] = total[last]
        if len(held["key"]):
            yield emit(held, held["n"] >= 2, np.array([others]))

    return rows.repartition("key").sortWithinPartitions("key", "seg", "seg2").mapInArrow(trimmed(run), schema)


def _packed(docs: DataFrame, others: list[str]) -> DataFrame:
    """``docs`` with the text as a zstandard frame, which makes the shuffles by ``uid`` smaller."""
    fields = [(n, field(docs, n)) for n in ("uid", *others)]
    arrow = arrow_schema(schema := struct(*fields, ("packed", "binary")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in slices(batches, "text"):
            yield batch_of(arrow, packed=[pack(x) for x in raw(batch.column("text")).to_pylist()], **{n: batch.column(n) for n, _ in fields})

    return docs.select("uid", "text", *others).mapInArrow(trimmed(run), schema)


def _fetched(docs: DataFrame, compared: DataFrame) -> DataFrame:
    """``compared`` with the bytes of the segments as ``data``."""
    names = ["key", "seg", "seg2", "size", "lo", "whole"]
    wanted = compared.groupBy("uid").agg(F.collect_list(F.struct(*names)).alias("wanted"))
    joined = _packed(docs, []).join(wanted.hint("shuffle_hash"), "uid")
    arrow = arrow_schema(schema := struct(*((n, field(compared, n)) for n in ("uid", *names)), ("data", "binary")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i in range(batch.num_rows):
                text, w = unpack(batch.column("packed")[i].as_py()), batch.column("wanted")[i].values
                cols = {n: w.field(n) for n in names}
                data = [text[a : a + n] for a, n in zip(cols["lo"].to_pylist(), cols["size"].to_pylist(), strict=True)]
                yield batch_of(arrow, data=data, uid=[batch.column("uid")[i].as_py()] * len(data), **cols)

    return joined.mapInArrow(trimmed(run), schema)


def _compared(found: DataFrame, length: int, groups: bool = False) -> DataFrame:
    """Spans of repeats among the segments of each anchor; several anchors make one small text.

    With ``groups`` all occurrences of every repeat: ``repeat`` (a number for those of one task), its length, the segment and the place there.
    """
    spans = (("uid", "bigint"), ("lo", "bigint"), ("hi", "bigint"))
    arrow = arrow_schema(schema := struct(*((("repeat", "string"), ("length", "int"), ("seg", "bigint"), ("seg2", "bigint"), ("at", "int")) if groups else spans)))

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        end = bytes([END])
        text = np.frombuffer(b"".join(x + end for *_, x in rows), np.uint8)
        ends = np.cumsum([len(x) + 1 for *_, x in rows]) - 1
        begins = np.concatenate([[0], ends[:-1] + 1])
        out = []
        for common, every, new in repeats(text, ends, length):
            if groups:
                name = xxhash.xxh3_128_hexdigest(text[every[0] : every[0] + common].tobytes())
                for at in every.tolist():
                    _, seg, seg2, _, _, _, _ = rows[k := int(np.searchsorted(ends, at))]
                    out.append((name, common, seg, seg2, at - int(begins[k])))
                continue
            for at in new:
                k = int(np.searchsorted(ends, at))
                _, _, _, uid, lo, whole, _ = rows[k]
                if not whole:
                    out.append((uid, lo + at - int(begins[k]), lo + at - int(begins[k]) + common))
        return batch_of(arrow, **dict(zip(arrow.names, zip(*out, strict=True) if out else [()] * len(arrow.names), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in ("key", "seg", "seg2", "uid", "lo", "whole", "data")), strict=True):
                if size >= TEXT and row[0] != rows[-1][0]:
                    yield emit(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[-1])
        if rows:
            yield emit(rows)

    return found.drop("size").repartition("key").sortWithinPartitions("key").mapInArrow(trimmed(run), schema)


def _identified(df: DataFrame, folder: str, uid: str = "uid") -> DataFrame:
    """The table kept with a number of its own for every row, whatever its id."""
    return stored(df.withColumn(uid, F.monotonically_increasing_id()), "texts", folder)


def _found(docs: DataFrame, folder: str, length: int, hot: int, groups: bool = False) -> tuple[list[DataFrame], list[DataFrame]]:
    """What is found among the segments of each group, and all places of repeated segments, by level."""
    results, wholes, level = [], [], 0
    found = stored(_resolved(_segment_rows(docs, length)), "segments-0", folder)
    while True:
        wholes.append(found)
        compare = found.where("compare").drop("compare")
        large = compare.groupBy("key").count().where(F.col("count") > hot).select("key")
        if level > length - KMER or not large.take(1):  # beyond, windows have no further k-mer
            results.append(stored(_compared(_fetched(docs, compare), length, groups), f"found-{level}", folder))
            return results, wholes
        large = stored(large, f"large-{level}", folder)
        results.append(stored(_compared(_fetched(docs, compare.join(large, "key", "left_anti")), length, groups), f"found-{level}", folder))
        level += 1
        found = stored(_resolved(_split(_fetched(docs, compare.join(large, "key", "left_semi")), length, level)), f"segments-{level}", folder)


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, tables)


def _spans(docs: DataFrame, folder: str, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """``uid`` and ``spans``, an array of (lo, hi) in bytes that may overlap, of every text with a repeat."""
    results, wholes = _found(docs, folder, length, hot)
    whole = _union([x.where("whole").select("uid", "lo", (F.col("lo") + F.col("size")).alias("hi")) for x in wholes])
    return _union(results).union(whole).groupBy("uid").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def repeat_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """All occurrences of every maximal repeat of ``length`` bytes or more within segments: ``repeat`` (a 128-bit hash of it), ``length``, the id, and ``lo`` in bytes.

    A longer repeat is there as the repeats of the segments that it spans, which overlap.
    """
    folder = shared_dir(df.sparkSession)
    docs = _identified(pick(df, id=id_col, text=text_col), folder)
    results, wholes = _found(docs, folder, length, hot, groups=True)
    places = stored(_union([x.select("seg", "seg2", "size", "uid", "lo", "whole") for x in wholes]).distinct(), "places", folder)
    name = F.concat(F.hex("seg"), F.lit(":"), F.hex("seg2"))
    equal = places.where("whole").select(name.alias("repeat"), F.col("size").alias("length"), "uid", "lo")
    inner = _union(results).join(places, ["seg", "seg2"]).select("repeat", "length", "uid", (F.col("lo") + F.col("at")).alias("lo"))
    return equal.union(inner).distinct().join(docs.select("uid", F.col("id").alias(id_col)), "uid").select("repeat", "length", id_col, "lo")


def merged(spans: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the spans' union, ascending and apart."""
    if not spans.is_valid:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lo, hi = (spans.values.field(n).to_numpy() for n in ("lo", "hi"))
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.concatenate([[True], lo[1:] > hi[:-1]])
    return lo[new], hi[np.concatenate([new[1:], [True]])]


def _kept(text: bytes, lo: np.ndarray, hi: np.ndarray) -> bytes:
    cuts = [0, *np.stack([lo, hi], axis=1).ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """What is removed from each text, and the SHA-256 of what is left of its bytes."""
    folder = shared_dir(df.sparkSession)
    docs = _identified(pick(df, id=id_col, text=text_col), folder)
    spans = _spans(docs, folder, **options)
    joined = _packed(docs, ["id"]).join(spans.hint("shuffle_hash"), "uid", "left").select("id", "packed", "spans")
    schema = struct((id_col, field(df, id_col)), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string"))
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows: dict[str, list] = {n: [] for n in arrow.names[1:]}
            for i in range(batch.num_rows):
                text = unpack(batch.column("packed")[i].as_py())
                lo, hi = merged(batch.column("spans")[i])
                for n, x in zip(rows, (len(text), int((hi - lo).sum()), len(lo), hashlib.sha256(_kept(text, lo, hi)).hexdigest()), strict=True):
                    rows[n].append(x)
            yield batch_of(arrow, **{id_col: batch.column("id")}, **rows)

    return joined.mapInArrow(trimmed(run), schema)


def removed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``df`` without the repeats in ``text_col``; characters that a repeat cuts in two go whole. A null text stays null."""
    uid, own = (next(n for n in map(f"{name}{{}}".format, range(len(df.columns) + 1)) if n not in df.columns) for name in ("uid", "spans"))
    folder = shared_dir(df.sparkSession)
    kept = _identified(df, folder, uid)
    spans = _spans(pick(kept, uid=uid, text=text_col), folder, **options).withColumnsRenamed({"uid": uid, "spans": own})
    joined = kept.join(spans.hint("shuffle_hash"), uid, "left").select(*(F.col(f"`{n}`") for n in df.columns), own)
    at, last = df.columns.index(text_col), len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            texts = batch.column(at).to_pylist()
            for i in np.flatnonzero(batch.column(last).is_valid().to_numpy(zero_copy_only=False)).tolist():
                texts[i] = _kept(texts[i].encode(), *merged(batch.column(last)[i])).decode(errors="ignore")
            columns = [batch.column(k) for k in range(last)]
            columns[at] = pa.array(texts, type=batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([batch.schema.field(k) for k in range(last)]))

    return joined.mapInArrow(trimmed(run), df.schema)
