"""Joins by a condition within hash buckets, in cells: a block of a bucket's rows on the left meets one on the right.

A bucket's rows are cut into blocks of about ``BLOCK`` rows, by ranges of the value and, where one range has more, by
turns.  Every row has one block of its own and is sent to a cell for each block of the other side that it may match,
so every two rows of a bucket that may match meet in exactly one cell, and a cell is small whatever the bucket is.  If
the condition is an order of two whole numbers, blocks that lie the wrong way round never meet.  What is counted
beforehand only shapes the blocks: a row has its place even if it wasn't there then.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Up to so many pairs of rows a join is left to Spark.
PLAIN = 1 << 26
#: Rows of a block; pairs and rows for a task, at about.
BLOCK, PAIRS, ROWS = 1 << 10, 1 << 22, 1 << 18
#: Buckets are counted in so many classes, each side's values by so many shares.
CLASSES, SHARES = 128, 16
MOST_TASKS = 1 << 16
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
#: What can't be hashed.
_OPAQUE = ("map<", "variant")


def _cuts(left: DataFrame, right: DataFrame, keys: tuple[str, str], ranges: bool) -> list[int] | None:
    """Where the values are cut into ranges; None if the pairs are few."""
    counts = []
    for at, (df, key) in enumerate(zip((left, right), keys, strict=True)):
        x = F.col(key).cast("bigint")
        found = [F.min(x), F.max(x), F.percentile_approx(x, [k / SHARES for k in range(1, SHARES)], 1000)] if ranges else [F.lit(None).cast(t) for t in ("bigint", "bigint", "array<bigint>")]
        counts.append(df.agg(F.lit(at).alias("at"), F.count(key).alias("n"), *(c.alias(a) for c, a in zip(found, ("low", "high", "shares"), strict=True))))
    (n, *some), (m, *others) = (row[1:] for row in sorted(counts[0].union(counts[1]).collect()))
    if n * m <= PLAIN:
        return None
    return sorted({x for low, high, shares in (some, others) for x in (low, high, high + 1, *shares) if x < 1 << 63}) if ranges else []


def _dealt(counts: Sequence[int]) -> list[tuple[int, int]]:
    """The first block of each range and the number of them; neighbours share one while there is room, but not with the ranges before or after all rows."""
    there = [k for k, n in enumerate(counts) if n]
    places, last, room, zone = [], -1, 0, None
    for k, n in enumerate(counts):
        here = (k >= there[0]) + (k > there[-1]) if there else 0
        if here != zone or n > room:
            blocks = max(-(-n // BLOCK), 1)
            places.append((last + 1, blocks))
            last, room = last + blocks, BLOCK - n if blocks == 1 else -1
        else:
            places.append((last, 1))
            room -= n
        zone = here
    return places


def _met(places: list[tuple[int, int]], order: str | None, own: str) -> list[tuple[int, int]]:
    """For each range of one side, ``own``, the first and last block of the other's ``places`` that it may match."""
    end = sum(places[-1]) - 1
    if order is None:
        return [(0, end)] * len(places)
    return [(first, end) if order[0] == own else (0, first + n - 1) for first, n in places]


def _plan(rows: list, ranges: int, order: str | None) -> tuple[list[list[tuple[int, ...]]], int, int]:
    """Of each side, by class and range: first own block, number of them, first and last block met; then pairs and rows in all, at about."""
    most, total = ({s: [[0] * ranges for _ in range(CLASSES)] for s in "lr"} for _ in range(2))
    for side, group, at, m, n in rows:
        most[side][group][at], total[side][group][at] = m, n
    tables, pairs, sent = {"l": [], "r": []}, 0, 0
    for group in range(CLASSES):
        places = {s: _dealt(most[s][group]) for s in "lr"}
        for own, other in ("lr", "rl"):
            for at, (place, met) in enumerate(zip(places[own], _met(places[other], order, own), strict=True)):
                tables[own].append((group, at, *place, *met))
                sent += total[own][group][at] * (met[1] - met[0] + 1)
        up = {k: [0, *accumulate(x["r"][group])] for k, x in (("most", most), ("total", total))}
        for at in range(ranges):
            low, high = (0, ranges) if order is None else (at, ranges) if order == "lr" else (0, at + 1)
            pairs += min(most["l"][group][at] * (up["total"][high] - up["total"][low]), total["l"][group][at] * (up["most"][high] - up["most"][low]))
    return [tables["l"], tables["r"]], pairs, sent


def join(left: DataFrame, right: DataFrame, keys: tuple[str, str], buckets: int, condition: Column, order: str | None, strategy: str | None) -> DataFrame | None:
    """The rows of ``left`` and ``right``, whose columns have different names, with equal remainders for which the condition holds; None if Spark had better do it.

    ``order`` is "lr" if the condition has the left value at or below the right one, "rl" for the reverse, None for any other.
    """
    sides = dict(zip("lr", (left, right), strict=True))
    key = dict(zip("lr", keys, strict=True))
    whole = all(isinstance(sides[s].schema[key[s]].dataType, _WHOLE) for s in "lr")
    order = order if whole else None
    cuts = _cuts(left, right, keys, order is not None)
    if cuts is None:
        return None
    bucket = {s: F.col(key[s]) % buckets for s in "lr"}
    hashed = {s: bucket[s].cast("bigint") if whole else F.xxhash64(bucket[s].cast("double")) for s in "lr"}
    group = {s: F.pmod(hashed[s], F.lit(CLASSES)).cast("int") if whole else F.lit(0) for s in "lr"}
    at = {s: sum((F.when(F.col(key[s]) >= x, 1).otherwise(0) for x in cuts), F.lit(0)) for s in "lr"}
    some = {s: sides[s].where(F.col(key[s]).isNotNull()) for s in "lr"}
    counts = [
        some[s].groupBy(hashed[s].alias("hash"), group[s].alias("class"), at[s].alias("range")).count()
        .groupBy(F.lit(s).alias("side"), "class", "range").agg(F.max("count"), F.sum("count"))
        for s in "lr"
    ]
    tables, pairs, sent = _plan(counts[0].union(counts[1]).collect(), len(cuts) + 1, order)
    tasks = min(max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), pairs // PAIRS + 1, sent // ROWS + 1), MOST_TASKS)
    cells = {}
    for s, rows in zip("lr", tables, strict=True):
        df, turn = some[s], F.lit(0)
        if any(row[3] > 1 for row in rows):  # rows of a task take turns in an order that is the same if it is repeated
            df = df.sortWithinPartitions(F.xxhash64(*(f.name for f in df.schema if not any(x in f.dataType.simpleString() for x in _OPAQUE))))
            df, turn = df.select("*", F.monotonically_increasing_id().alias("turn")), F.pmod("turn", "blocks").cast("int")
        where = F.broadcast(df.sparkSession.createDataFrame(rows, "class int, range int, block bigint, blocks int, first bigint, last bigint"))
        df = df.join(where, (group[s] == F.col("class")) & (at[s] == F.col("range")))
        df = df.select(*sides[s].columns, bucket[s].alias(f"{s}_bucket"), hashed[s].alias("hash"), (F.col("block") + turn).alias("own"), F.explode(F.sequence("first", "last")).alias("met"))
        df = df.select("*", F.shiftleft("own" if s == "l" else "met", 32).bitwiseOR(F.col("met" if s == "l" else "own")).alias(f"{s}_place"))
        cells[s] = df.select(*sides[s].columns, f"{s}_bucket", f"{s}_place", F.xxhash64("hash", f"{s}_place").alias(f"{s}_cell")).repartition(tasks, f"{s}_cell")
    # one key, never a constant: with other keys, or fewer, Spark would deal the rows anew, to few tasks; so what makes it exact isn't written as an equality
    same = (F.col("l_cell") == F.col("r_cell")) & F.col("l_place").between(F.col("r_place"), F.col("r_place")) & F.col("l_bucket").between(F.col("r_bucket"), F.col("r_bucket"))
    return cells["l"].join(cells["r"].hint(strategy or "merge"), same & condition, "inner").select(*left.columns, *right.columns)
