"""Document fingerprints: a homomorphic multiset hash of paragraphs, in DataFrame expressions alone.

A paragraph is a line, or a sentence of one.  Each is hashed to a wide vector, and a document's
fingerprint is the sum of its paragraphs' vectors, every lane modulo 2**32.  So the order of
paragraphs does not matter, how often each occurs does, and a paragraph is inserted or deleted by adding
or subtracting its vector (``combined``), without the rest of the document.

The first ``WIDE`` lanes are the halves of ``WIDE / 2`` hashes of the paragraph's bytes, each by a seed of its own: equal sums
mean equal multisets, but for chance over all the lanes' bits.  The
others, two to an integer, count for each of ``SIGNS`` bits of two of those hashes how many paragraphs have it set.
Taken as sums of +1 and -1 they are a sketch of the multiset, whose scalar products estimate how
much two documents share: that is ``likeness``, 2ab / (aa + bb), between 0 and 1.

Cases: null text is empty; an empty text has one empty paragraph; equal texts have equal fingerprints;
very long texts are hashed whole (a lane is exact up to 2**31 paragraphs); ties in id go by the text's
hash; null ids come last; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field, partitions, pick

WIDE, SIGNS = 16, 128
#: Ends of paragraphs: line ends, and the space after a sentence.
ENDS = r"\n|(?<=[.!?]) "
MASK = (1 << 32) - 1
_PAIR = (1 << 32) | 1


def vector(text: Column) -> Column:
    """A text's fingerprint as an array of integers: WIDE lanes, then SIGNS / 2 pairs of counts, and the number of paragraphs."""
    def lanes(hashes: Column) -> Column:
        def total(seed: int, lane) -> Column:
            return F.aggregate(F.element_at(hashes, seed + 1), F.lit(0).cast("bigint"), lambda acc, h: acc + lane(h))

        low = [total(k, lambda h: h.bitwiseAND(F.lit(MASK))).bitwiseAND(F.lit(MASK)) for k in range(WIDE // 2)]
        high = [total(k, lambda h: F.shiftrightunsigned(h, 32)).bitwiseAND(F.lit(MASK)) for k in range(WIDE // 2)]
        signs = [total(k, lambda h, i=i: F.shiftrightunsigned(h, i).bitwiseAND(F.lit(_PAIR))) for k in range(SIGNS // 64) for i in range(32)]
        return F.array(*low, *high, *signs, F.size(F.element_at(hashes, 1)).cast("bigint"))

    # As the variables of lambdas, paragraphs and hashes are computed once for all lanes.
    def hashed(paragraphs: Column) -> Column:
        def of(seed: int) -> Column:
            return F.transform(paragraphs, lambda p: F.xxhash64(F.lit(seed), p))

        return F.array(*map(of, range(WIDE // 2)))

    def once(x: Column, use) -> Column:
        return F.element_at(F.transform(F.array(x), use), 1)

    return once(F.split(text, ENDS), lambda paragraphs: once(hashed(paragraphs), lanes))


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """The vector of both multisets, or with ``sign`` -1 of the first without the second."""
    def add(x: Column, y: Column) -> Column:
        low = (x.bitwiseAND(F.lit(MASK)) + sign * y.bitwiseAND(F.lit(MASK))).bitwiseAND(F.lit(MASK))
        high = (F.shiftrightunsigned(x, 32) + sign * F.shiftrightunsigned(y, 32)).bitwiseAND(F.lit(MASK))
        return F.shiftleft(high, 32).bitwiseOR(low)

    return F.zip_with(a, b, add)


def text_of(vec: Column) -> Column:
    """A vector as hexadecimal digits."""
    wide = F.transform(F.slice(vec, 1, WIDE), lambda x: F.lpad(F.hex(x), 8, "0"))
    signs = F.transform(F.slice(vec, WIDE + 1, SIGNS // 2), lambda x: F.lpad(F.hex(x), 16, "0"))
    return F.lower(F.concat(F.array_join(wide, ""), F.array_join(signs, ""), F.lpad(F.hex(F.element_at(vec, -1)), 16, "0")))


def likeness(a: Column, b: Column) -> Column:
    """2ab / (aa + bb) of the two sketches, held between 0 and 1; exactly 1 for equal vectors."""
    def sums(x: Column, y: Column) -> Column:
        n, m = F.element_at(x, -1), F.element_at(y, -1)
        lanes = F.zip_with(F.slice(x, WIDE + 1, SIGNS // 2), F.slice(y, WIDE + 1, SIGNS // 2), lambda p, q: (
            (2 * p.bitwiseAND(F.lit(MASK)) - n).cast("double") * (2 * q.bitwiseAND(F.lit(MASK)) - m)
            + (2 * F.shiftrightunsigned(p, 32) - n).cast("double") * (2 * F.shiftrightunsigned(q, 32) - m)
        ))
        return F.aggregate(lanes, F.lit(0.0), lambda acc, v: acc + v)

    size = sums(a, a) + sums(b, b)
    return F.when(a == b, 1.0).when(size == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * sums(a, b) / size)))


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``fingerprint`` (its digits) of every row; no shuffle."""
    return pick(df, **{id_col: id_col, "text": text_col}).select(id_col, text_of(vector(F.coalesce("text", F.lit("")))).alias("fingerprint"))


def _bucket(key: Column, bounds: list) -> Column:
    """The number of bounds below the key, found in two steps; 0 for null."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    group = F.size(F.filter(F.array(*(F.lit(g[-1]) for g in groups)), lambda x: x < key))
    inner = F.array(*(F.array(*map(F.lit, g)) for g in groups))
    found = group * step + F.size(F.filter(F.element_at(inner, group + 1), lambda x: x < key))
    return F.when(key.isNull(), 0).when(group >= len(groups), len(bounds)).otherwise(found)


def with_next(rows: DataFrame, key: str, tie: str, columns: list[str]) -> DataFrame:
    """``rows`` with ``next_`` columns: those of the row that follows by descending key, and of the first row after the last.

    Rows are dealt to buckets by quantiles of the key, as many as the session has shuffle partitions; each is a partition of its own.
    Each bucket also gets the first row of the bucket below, so that every row finds its follower in
    its own bucket: the rows are shuffled once, and no task sees more than a bucket.
    """
    if not isinstance(field(rows, key), T.NumericType):
        raise TypeError(f"{key} must be a number")
    n = partitions(rows.sparkSession)
    cuts = [i / n for i in range(1, n)]
    bounds = sorted(set((rows.select(F.percentile_approx(key, cuts, max(10_000, 20 * n))).first()[0] if cuts else None) or []))
    bucket = _bucket(F.col(key), bounds)
    firsts = {r.b: r.first for r in rows.select(bucket.alias("b"), key).groupBy("b").agg(F.max(key).alias("first")).collect()}
    used = sorted(firsts)
    above = dict(zip(used, [*used[1:], used[0]], strict=True)) if used else {}
    slots = range(len(bounds) + 1)
    kind = field(rows, key)
    first = F.element_at(F.array(*(F.lit(firsts.get(b)).cast(kind) for b in slots)), F.col("_b") + 1)
    guest = F.element_at(F.array(*(F.lit(above.get(b, 0)) for b in slots)), F.col("_b") + 1)
    at = lambda b, g: F.struct(b.alias("bucket"), F.lit(g).alias("guest"))
    own = at(F.col("_b"), False)
    dealt = rows.withColumn("_b", bucket).withColumn("_at", F.explode(F.when(F.col(key).eqNullSafe(first), F.array(own, at(guest, True))).otherwise(F.array(own))))
    placed = dealt.withColumn("_b", F.col("_at.bucket")).repartitionById(len(bounds) + 1, "_b")
    order = Window.partitionBy("_b").orderBy(F.col("_at.guest"), F.col(key).desc_nulls_last(), F.col(tie))
    followed = placed.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns))
    return followed.where("not _at.guest").drop("_b", "_at")


def edited_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text's fingerprint, that of its edited text, and their likeness to it and to the next document's.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the
    next document by descending id.
    """
    docs = pick(df, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit(""))).select("id", "text", F.xxhash64("text").alias("tie"))
    pairs = with_next(docs.withColumn("vec", vector(F.col("text"))), "id", "tie", ["text", "vec"])
    half = F.shiftright("n_chars", 1)
    parts = pairs.withColumn("n_chars", F.length("text")).withColumn("edited", F.concat(F.expr("left(text, n_chars - shiftright(n_chars, 1))"), F.left("next_text", half)))
    both = parts.withColumn("edited_vec", vector(F.col("edited")))
    return both.select(
        F.col("id").alias(id_col), F.col("n_chars").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), text_of(F.col("vec")).alias("fingerprint"),
        text_of(F.col("edited_vec")).alias("edited_fingerprint"), likeness(F.col("vec"), F.col("edited_vec")).alias("near_edited"), likeness(F.col("vec"), F.col("next_vec")).alias("near_next"),
    )
