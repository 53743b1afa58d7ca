"""Language ID by compression: the language whose dictionary makes a text smallest.

Each language's dictionary is raw content for zstandard: labelled text, at most ``SAMPLE`` bytes.  A text
is cut into blocks of ``BLOCK`` bytes, at white space where there is some near, each block is compressed
with every dictionary, and the sizes are summed, so that a long text counts whole without becoming its
own dictionary.  The smallest sum names the language.  Its margin over the next best, relative to that,
is the score after scaling to 0..1; ``identify`` rejects what has no letter or too small a margin.

Training takes, for each language, labelled documents in the order of a hash of their text until they
have ``SAMPLE`` bytes, and at most ``ROWS`` of them; each gives ``part`` characters from its middle.  All dictionaries,
``SAMPLE`` bytes each, are sent to all tasks, so more than ``LANGUAGES`` different labels are refused.

Cases: a null text, or one without a letter, is ``UNKNOWN`` with score 0, as is every text if nothing is
labelled; with one language alone every text with letters is of it, with score 1; equal sizes go to the
language with most labelled documents, with score 0; repeated rows are kept; an empty table gives an
empty table; other columns are not read, or kept as they are by ``filtered``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, batch_of, field, pick, slices, struct, trimmed

UNKNOWN = "und"
#: Bytes of a language's dictionary, and documents that it may come from.
SAMPLE, ROWS = 96_000, 400
#: The most languages, and the groups that each language's documents are dealt to before its first ones are taken from the first of all groups.
LANGUAGES, GROUPS = 500, 32
BLOCK = 1024
#: Compression levels of long texts, and of those up to SHORT characters, where every match counts.
LEVEL, SHORT_LEVEL, SHORT = 3, 19, 300
#: Relative margin that gives score 1, and the least score that is not rejected.
SURE, LEAST = 0.15, 0.01

_other = re.compile(r"[\W\d_]+")


def plain(text: str) -> str:
    """Lower-case letters, and single spaces for anything else."""
    return _other.sub(" ", text.lower())


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, rows: int = ROWS, part: int = BLOCK) -> dict[str, bytes]:
    """Dictionaries of at most ``sample`` bytes by language, the most frequent first, from at most ``rows`` documents of each; null labels and texts are left out."""
    counts = pick(df, lang=lang_col).where("lang is not null").groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    often = {r.lang: r.n for r in counts}
    docs = pick(df, text=text_col, lang=lang_col).where("lang is not null and text is not null").withColumn("h", F.xxhash64("text"))
    # Copies have one hash.  A group's first rows are taken before those of all groups meet: that is rows * GROUPS for a language at most.
    least = docs.select("lang", "h", F.pmod("h", F.lit(GROUPS)).alias("group")).distinct()
    for keys in (["lang", "group"], ["lang"]):
        order = Window.partitionBy(*keys).orderBy("h")
        least = least.withColumn("n", F.row_number().over(order)).where(F.col("n") <= rows).drop("n")
    middle = F.expr(f"substring(text, greatest(1, cast(length(text) / 2 - {part // 2} as int)), {part})")
    parts = docs.join(F.broadcast(least.select("lang", "h")), ["lang", "h"]).select("lang", "h", middle.alias("part"))  # rows * LANGUAGES at most
    chosen = parts.groupBy("lang", "h").agg(F.min("part").alias("part")).collect()
    out: dict[str, bytes] = {}
    for r in sorted(chosen, key=lambda r: (r.lang, r.h)):
        if len(out.setdefault(r.lang, b"")) < sample:
            out[r.lang] += plain(r.part).encode()[: sample - len(out[r.lang])]
    return dict(sorted(out.items(), key=lambda x: (-often.get(x[0], 0), x[0])))


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.names = list(dictionaries)
        self.coders = {level: [self._coder(dictionaries[name], level) for name in self.names] for level in (LEVEL, SHORT_LEVEL)}

    @staticmethod
    def _coder(content: bytes, level: int) -> zstandard.ZstdCompressor:
        d = zstandard.ZstdCompressionDict(content.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False)

    @staticmethod
    def blocks(data: bytes) -> Iterator[bytes]:
        at = 0
        while at < len(data):
            end = at + BLOCK
            if end < len(data) and (space := data.rfind(b" ", at + BLOCK // 2, end)) > 0:
                end = space
            yield data[at:end]
            at = end

    def sizes(self, text: str) -> list[int]:
        text = plain(text)
        blocks = list(self.blocks(text.encode()))
        coders = self.coders[SHORT_LEVEL if len(text) <= SHORT else LEVEL]
        return [sum(len(c.compress(b)) for b in blocks) for c in coders]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.names or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        sizes = sorted(zip(self.sizes(text), self.names, strict=True), key=lambda x: x[0])
        if len(sizes) == 1:
            return sizes[0][1], 1.0
        return sizes[0][1], min(1.0, (sizes[1][0] - sizes[0][0]) / sizes[1][0] / SURE)


def predict(df: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``lang_pred`` and ``score``; no narrow margin is rejected here."""
    arrow = arrow_schema(schema := struct((id_col, field(df, id_col)), ("lang_pred", "string"), ("score", "double")))
    sent = df.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(sent.value)
        for batch in slices(batches, "text"):
            found = [model.predict(x) for x in batch.column("text").to_pylist()]
            yield batch_of(arrow, lang_pred=[x for x, _ in found], score=[s for _, s in found], **{id_col: batch.column("id")})

    return pick(df, id=id_col, text=text_col).mapInArrow(trimmed(run), schema)


def identify(df: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """``predict``, where a score under ``least`` makes the language ``UNKNOWN``."""
    narrow = F.col("score") < least
    return predict(df, dictionaries, id_col, text_col).withColumn("lang_pred", F.when(narrow, UNKNOWN).otherwise(F.col("lang_pred")))


def filtered(df: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", least: float = LEAST) -> DataFrame:
    """``df`` without the rows that ``identify`` rejects; with no dictionary at all, only without texts that are null or have no letter."""
    at = df.columns.index(text_col)
    sent = df.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(sent.value)
        for batch in slices(batches, text_col):
            texts = batch.column(at).to_pylist()
            if not model.names:
                yield batch.filter(pa.array([bool(x) and any(map(str.isalpha, x)) for x in texts], pa.bool_()))
                continue
            found = [model.predict(x) for x in texts]
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in found], pa.bool_()))

    return df.mapInArrow(trimmed(run), df.schema)


def held_out(id_col: str = "doc_id"):
    """Documents that are kept from training: crc32 of the id as text has remainder 2 by 4; a null id is one of them."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(True))


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Trains on the documents that are not held out and predicts all."""
    dictionaries = train(df.where(~held_out(id_col)), text_col, lang_col)
    return predict(df, dictionaries, id_col, text_col).select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")
