"""SimHash near-duplicates by anchor-point covering.

A text's fingerprint has 64 bits: the majority, over its word shingles, of each bit of their hashes.
Fingerprints that differ in few bits are found through anchors.  The anchors are the words of a
covering code: the direct product of perfect [23, 12] Golay codes over blocks of 23 bits, in which
every block lies within ``RADIUS`` = 3 of exactly one code word.  A fingerprint is at home at its nearest
anchor and is also sent to every anchor within the radius plus the threshold.  If two
fingerprints differ in ``t`` bits or fewer, then each is among those sent to the other's home: with
``e`` differing bits in a block, its distance to the other's code word there is ``RADIUS + e`` at most,
and the ``e`` of all blocks sum to ``t`` at most.  Only fingerprints at one anchor are compared, each
visitor with those at home there.

Equal fingerprints are one before anything is sent, so a group of copies, however large, counts once.
With two blocks there are 2**24 anchors and 61 copies of a fingerprint on average for a threshold of 2.

Cases: null text is empty; a text without words has fingerprint zero, linked like any other; a text with
fewer words than a shingle is one shingle; very long texts are hashed whole, some shingles at a time; repeated rows have one fingerprint and component; rows
that share an id are one node; rows of
null id keep a null component unless linked with others; an empty table gives an empty table; other
columns are not read, or kept as they are by ``deduplicated``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch_of, field, pick, raw, slices, stored, struct, trimmed
from .components import components

SHINGLE = 3
DISTANCE = 2
SEED = 42
BLOCK, RADIUS = 23, 3
#: Blocks that the code covers, from the lowest bit on.
BLOCKS = 2
#: Fingerprints that a task sends to their anchors, and bytes of shingle hashes that are summed at once.
DEALT, SUMMED = 20_000, 1 << 20
# Fixed value: the generator polynomial of the perfect binary Golay code.
GOLAY = 0b110001110101


def shingles(text: bytes, shingle: int = SHINGLE) -> Iterator[bytes]:
    """A text's word shingles, with repeats; the whole sequence of fewer words."""
    words = text.lower().split()
    if len(words) > shingle:
        return map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return iter([b" ".join(words)] if words else [])


def fingerprints(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """Of each text, as unsigned 64-bit integers."""
    out = np.zeros(len(texts), np.uint64)
    for k, text in enumerate(texts):
        n, ones = 0, np.zeros(64, np.int64)
        digests = map(xxhash.xxh64_digest, shingles(text, shingle), repeat(SEED))
        while part := b"".join(islice(digests, SUMMED // 8)):
            n += len(part) // 8
            ones += np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        if n:
            out[k] = np.packbits(2 * ones > n).view(">u8")[0]
    return out


@cache
def _errors(most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each cost 0..most, the error patterns of a block by syndrome: (offsets, patterns).

    Cost 0 is the one pattern of weight RADIUS or less; cost e > 0 those of weight RADIUS + e.
    """
    one = []
    for i in range(BLOCK):
        x = 1 << i
        for d in range(i, BLOCK - 13, -1):
            if x >> d & 1:
                x ^= GOLAY << (d - 11)
        one.append(x)
    out = []
    for cost in range(most + 1):
        weights = range(RADIUS + 1) if cost == 0 else [RADIUS + cost]
        found = []
        for w in weights:
            for at in combinations(range(BLOCK), w):
                s = p = 0
                for i in at:
                    s ^= one[i]
                    p |= 1 << i
                found.append((s, p))
        table = np.array(sorted(found), np.int64)
        out.append((np.searchsorted(table[:, 0], np.arange(2049)), table[:, 1]))
    return out


@cache
def _syndromes() -> np.ndarray:
    """Remainder of every block by the code's generator."""
    x = np.arange(1 << BLOCK, dtype=np.int64)
    for d in range(BLOCK - 1, 10, -1):
        x = np.where(x >> d & 1, x ^ (GOLAY << (d - 11)), x)
    return x.astype(np.int16)


def _costs(blocks: int, most: int) -> list[tuple[int, ...]]:
    if not blocks:
        return [()]
    return [(c, *rest) for c in range(most + 1) for rest in _costs(blocks - 1, most - c)]


def anchors(fps: np.ndarray, distance: int, blocks: int = BLOCKS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index of a fingerprint, anchor) pairs: its home with distance 0, else all within the radius plus ``distance``."""
    mask = (1 << BLOCK) - 1
    parts = [((fps >> np.uint64(BLOCK * k)) & np.uint64(mask)).astype(np.int64) for k in range(blocks)]
    synd = [_syndromes()[p].astype(np.int64) for p in parts]
    errors = _errors(distance)
    for costs in _costs(blocks, distance):
        index = np.arange(len(fps))
        anchor = np.zeros(len(fps), np.int64)
        for k, cost in enumerate(costs):
            offsets, patterns = errors[cost]
            s = synd[k][index]
            n = offsets[s + 1] - offsets[s]
            at = np.repeat(offsets[s] - np.cumsum(n) + n, n) + np.arange(n.sum())
            index, anchor = np.repeat(index, n), np.repeat(anchor, n)
            anchor |= (parts[k][index] ^ patterns[at]) << (BLOCK * k)
        yield index, anchor


def at_anchors(fps: DataFrame, distance: int, blocks: int = BLOCKS) -> DataFrame:
    """``fp`` and ``rep`` of a table at each ``anchor`` within the radius plus ``distance`` (its home with 0)."""
    arrow = arrow_schema(schema := struct(("anchor", "bigint"), ("fp", "bigint"), ("rep", field(fps, "rep"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                fp, rep = part.column("fp"), part.column("rep")
                for index, anchor in anchors(fp.to_numpy(zero_copy_only=False).view(np.uint64), distance, blocks):
                    yield batch_of(arrow, anchor=anchor, fp=fp.take(pa.array(index)), rep=rep.take(pa.array(index)))

    return fps.select("fp", "rep").mapInArrow(trimmed(run), schema)


def links(fps: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """``a`` and ``b``, the ``rep`` of every two fingerprints that differ in ``distance`` bits or fewer, once for each pair."""
    fps = fps.repartition(-(-fps.count() // DEALT) or 1)  # each makes many rows
    home = at_anchors(fps, 0, blocks).select("anchor", F.col("fp").alias("home_fp"), F.col("rep").alias("a"))
    guests = at_anchors(fps, distance, blocks).select("anchor", "fp", F.col("rep").alias("b"))
    near = (F.col("home_fp") < F.col("fp")) & (F.bit_count(F.col("home_fp").bitwiseXOR(F.col("fp"))) <= distance)
    met = guests.join(home.hint("shuffle_hash"), "anchor").where(near)
    return met.select("a", "b")


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, blocks: int = BLOCKS
) -> DataFrame:
    """``id_col``, ``fp`` (64 bits as a signed integer) and ``component``, the smallest id that is reachable by links."""
    arrow = arrow_schema(schema := struct(("id", field(df, id_col)), ("fp", "bigint")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fps = fingerprints(raw(batch.column("text")).to_pylist(), shingle)
            yield batch_of(arrow, id=batch.column("id"), fp=fps.view(np.int64))

    docs = stored(pick(df, id=id_col, text=text_col).mapInArrow(trimmed(run), schema), "fingerprints")
    fps = stored(docs.groupBy("fp").agg(F.min("id").alias("rep")), "distinct")
    roots = components(links(fps.where("rep is not null"), distance, blocks))
    classes = fps.join(roots, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component"))
    return docs.join(classes, "fp").select(F.col("id").alias(id_col), "fp", "component")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``df`` with one document of each component: that of the least id and, of rows that share it, of the least hash of the text.

    Rows that share an id are not copies for that.  Rows of null id, which nothing can name, all stay.
    """
    node = next(n for n in map("node{}".format, range(len(df.columns) + 1)) if n not in df.columns)
    key, hashed = F.col(f"`{id_col}`"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    marked = df.where(key.isNotNull()).withColumn(node, hashed)
    texts = marked.groupBy(node).agg(F.first(F.col(f"`{text_col}`")).alias("text"), F.min(key).alias("id")).withColumnRenamed(node, "node")
    found = near_duplicates(texts, "node", "text", **options).select("node", "component")
    kept = found.join(texts.select("node", "id"), "node").groupBy("component").agg(F.min(F.struct("id", "node")).alias("row")).select(F.col("row.id").alias(f"{node}_id"), F.col("row.node").alias(f"{node}_kept"))
    some = marked.join(kept, (key == kept[f"{node}_id"]) & (F.col(node) == kept[f"{node}_kept"]), "left_semi")
    return some.dropDuplicates([id_col, node]).drop(node).unionByName(df.where(key.isNull()))
